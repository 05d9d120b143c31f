"""Personal data by bootstrapped contextual extraction (DataFrame functions only).

Fixed patterns find the base spans, which are the seeds. The words beside the seeds are lexical patterns. Other strings of a
fitting shape (candidates) stand beside words too, so mentions form a graph of patterns and instances. It is worked
through in rounds: a pattern is as good as the share of its known instances that are of its kind; a candidate is believed as
far as its patterns are. Believed candidates are known instances in the next round and may bring in patterns that met no seed,
until a round believes no more. They become spans of the patterns' kind.
"""

from pyspark.sql import Column, DataFrame, functions as F

from sourcemart.llm.common import broadcast_if, settle
from sourcemart.llm.line_frequency import let

KINDS = ("email", "ip", "card", "phone")
MIN_SEEDS = 5          # distinct seeds, or candidates believed before, that a pattern must have met
PATTERN_SCORE = 0.8    # of a pattern that may discover
BELIEF = 0.9           # of a candidate that becomes a span
PRIOR = 1.0            # instances counted against every pattern
CONTEXT_CHARS = 60
BROADCAST_ROWS = 200_000

# The base patterns. Possessive and atomic forms and the borders before a run match the same strings as the
# plain forms, leftmost and without overlap, and keep the time linear and the stack flat on very long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?>(?:\.[A-Za-z0-9-]++){1,64})++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11}(?>(?:[\x20-]?[0-9]){1,64})*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Candidates: at-signs spelled out or without a domain; chains of seven digits or more.
AT_LIKE = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{2,64}+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,64}+){0,8}"
DIGIT_CHAIN = r"(?<![A-Za-z0-9])[(+]?[0-9](?:[\x20().-]{0,2}[0-9]){6}(?>(?:[\x20().-]{0,2}[0-9]){1,64})*+(?![A-Za-z0-9])"

MENTION = "array<struct<start:int,end:int,value:string,left:string,right:string>>"


def _word(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"[^\p{L}0-9]+", ""))


def located(text: Column, pattern: str) -> Column:
    """Matches of the pattern with their places (code points) and the words before and after them.

    A match starts where the texts between the matches, and the matches before it, end.
    """
    def beside(gaps):
        parts = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m, i: F.struct(
            F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("n"), m.alias("value"),
            _word(F.regexp_extract(F.right(F.get(gaps, i), F.lit(CONTEXT_CHARS)), r"(\S+)\s*$", 1)).alias("left"),
            _word(F.regexp_extract(F.left(F.get(gaps, i + 1), F.lit(CONTEXT_CHARS)), r"^\s*(\S+)", 1)).alias("right")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(MENTION).alias("out"))

        def add(done, p):
            at = done["at"] + p["gap"]
            one = F.array(F.struct(at.alias("start"), (at + p["n"]).alias("end"), p["value"].alias("value"),
                                   p["left"].alias("left"), p["right"].alias("right"))).cast(MENTION)
            return F.struct((at + p["n"]).alias("at"), F.concat(done["out"], one).alias("out"))

        return F.aggregate(parts, start, add, lambda done: done["out"])

    return let(F.split(text, pattern, -1), beside)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = lambda c, i: F.when(i % 2 == 0, c).otherwise(F.when(c > 4, c * 2 - 9).otherwise(c * 2))
    each = F.transform(F.split(F.reverse(number), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    return F.aggregate(F.transform(each, doubled), F.lit(0), lambda a, b: a + b) % 10 == 0


def _within(text: Column, low: int, high: int) -> Column:
    return F.length(digits(text)).between(low, high)


def base_mentions(text: Column) -> dict[str, Column]:
    """Valid matches per kind."""
    none = F.array().cast(MENTION)
    part = lambda p: let(F.ltrim(p, F.lit("0")), lambda q: (F.length(q) <= 3) & (F.coalesce(q.try_cast("int"), F.lit(0)) <= 255))
    return {
        "email": F.when(F.contains(text, F.lit("@")), located(text, EMAIL)).otherwise(none),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), F.filter(
            located(text, IP), lambda m: F.forall(F.split(m["value"], r"\."), part))).otherwise(none),
        "card": F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), F.filter(
            located(text, CARD), lambda m: _within(m["value"], 12, 19) & luhn(digits(m["value"])))).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(
            located(text, PHONE), lambda m: _within(m["value"], 9, 15))).otherwise(none),
    }


def candidate_mentions(text: Column) -> Column:
    none = F.array().cast(MENTION)
    at_like = F.when(text.rlike(r"@|\(at\)|\[at\]"), located(text, AT_LIKE)).otherwise(none)
    chains = F.when(text.rlike(r"[0-9](?:[\x20().-]{0,2}[0-9]){6}"), located(text, DIGIT_CHAIN)).otherwise(none)
    return F.concat(at_like, chains)


def fits(kind: Column, value: Column) -> Column:
    """Whether a candidate has the form of a kind: only then patterns of that kind may claim it."""
    n = F.length(digits(value))
    at = value.rlike(r"@|\(at\)|\[at\]")
    dotted = value.rlike(r"^[0-9]{1,4}(?:\.[0-9]{1,4}){3}$")
    return (F.when(kind == "email", at).when(kind == "ip", dotted).when(kind == "card", ~at & ~dotted & n.between(12, 19))
            .otherwise(~at & ~dotted & n.between(7, 15)))


def graph(rows: DataFrame) -> DataFrame:
    """Edges (pattern, instance, seed): each distinct string beside each distinct word; ``seed`` is its kind or null."""
    side = lambda m, kind: F.array(
        F.struct(F.concat(F.lit("<"), m["left"]).alias("pattern"), m["value"].alias("instance"), kind.alias("seed")),
        F.struct(F.concat(F.lit(">"), m["right"]).alias("pattern"), m["value"].alias("instance"), kind.alias("seed")))
    # Lambdas of one argument: a second one would be the index.
    of = lambda column, kind: F.flatten(F.transform(column, lambda m: side(m, kind)))
    seeds = [of(k, F.lit(k)) for k in KINDS]
    others = of("candidates", F.lit(None).cast("string"))
    edges = rows.filter(F.greatest(F.size("candidates"), *[F.size(k) for k in KINDS]) > 0)
    edges = edges.select(F.explode(F.concat(*seeds, others)).alias("e")).select("e.pattern", "e.instance", "e.seed")
    # Values travel as hashes; a group of copies is one edge.
    return (edges.filter(F.length("pattern") > 1).withColumn("shape", F.when(F.col("seed").isNull(), F.concat_ws(",", *[
        F.when(fits(F.lit(k), F.col("instance")), F.lit(k)) for k in KINDS])))
        .withColumn("instance", F.xxhash64("instance")).groupBy("pattern", "instance", "seed", "shape").agg(F.lit(1).alias("one")).drop("one"))


def believed_candidates(rows: DataFrame) -> DataFrame:
    """(instance, kind): candidates whose belief passed BELIEF in some round; a candidate keeps the kind it was first given.

    In every round: score(pattern, kind) = its known instances of that kind / (its known instances + PRIOR);
    belief(candidate, kind) = 1 - product over its patterns of that kind of (1 - score). Candidates that aren't believed yet
    speak neither for a pattern nor against it. Every round but the last believes one candidate more at least.
    """
    edges = settle(graph(rows), "edges")
    known = settle(edges.filter("seed is not null").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count("*").alias("n")), "known")
    open_edges = settle(edges.filter("seed is null").select("pattern", "instance", F.split("shape", ",").alias("shape")), "open")
    believed = None
    while True:
        total = known.groupBy("pattern").agg(F.sum("n").alias("all"))
        scores = settle(known.filter(F.col("n") >= MIN_SEEDS).join(total, "pattern")
                        .select("pattern", "kind", (F.col("n") / (F.col("all") + PRIOR)).alias("score"))
                        .filter(F.col("score") >= PATTERN_SCORE / 2), "scores")
        doubt = F.sum(F.log1p(-F.least("score", F.lit(0.999))))
        belief = (open_edges.join(broadcast_if(scores, BROADCAST_ROWS), "pattern").filter(F.array_contains("shape", F.col("kind")))
                  .groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("belief"), F.max("score").alias("best"))
                  .filter((F.col("belief") >= BELIEF) & (F.col("best") >= PATTERN_SCORE)))
        sure = settle(belief.groupBy("instance").agg(F.max_by("kind", F.struct("belief", "kind")).alias("kind")), "sure")
        if believed is None:
            believed = new = sure
        else:
            new = settle(sure.join(believed, "instance", "left_anti"), "new")
            believed = settle(believed.unionByName(new), "believed")
        if new.isEmpty():
            return believed
        met = open_edges.join(broadcast_if(new, BROADCAST_ROWS), "instance").groupBy("pattern", "kind").agg(F.count("*").alias("n"))
        known = settle(known.unionByName(met).groupBy("pattern", "kind").agg(F.sum("n").alias("n")), "known")


def find_personal_data(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row of ``docs``: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found.

    Counts and digest are of the base spans; ``spans`` adds the discovered ones (``n_found``), written kind:start:end by start, end
    exclusive, in code points. Null texts are empty: no spans. Repeated rows get equal results and teach patterns once, as
    distinct strings count. Columns besides the two named are not read.
    """
    whole = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = whole.select("id", "row", *[c.alias(k) for k, c in base_mentions(F.col("text")).items()], candidate_mentions(F.col("text")).alias("candidates"))
    free = lambda m: ~F.exists(F.concat(*KINDS), lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    found = settle(found.withColumn("candidates", F.filter("candidates", free)), "mentions")
    sure = believed_candidates(found)
    order = {k: i for i, k in enumerate(KINDS)}
    number = lambda kind: F.when(kind == "email", 0).when(kind == "ip", 1).when(kind == "card", 2).otherwise(3)
    open_mentions = found.filter(F.size("candidates") > 0).select("row", F.explode("candidates").alias("m")).select(
        "row", "m.start", "m.end", F.xxhash64("m.value").alias("instance"))
    discovered = (open_mentions.join(broadcast_if(sure, BROADCAST_ROWS), "instance").groupBy("row").agg(F.collect_list(F.struct(
        F.col("start"), number(F.col("kind")).alias("k"), F.col("end"))).alias("discovered")))
    numbered = lambda k: F.transform(k, lambda m: F.struct(m["start"].alias("start"), F.lit(order[k]).alias("k"), m["end"].alias("end")))
    base = F.sort_array(F.concat(*map(numbered, KINDS)))
    written = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat(
        F.element_at(F.array(*map(F.lit, KINDS)), s["k"] + 1), F.lit(":"), s["start"], F.lit(":"), s["end"])))
    kind = "array<struct<start:int,k:int,end:int>>"
    joined = found.withColumn("base", base.cast(kind)).join(discovered, "row", "left")
    more = F.coalesce(F.col("discovered").cast(kind), F.array().cast(kind))
    return joined.select(
        F.col("id").alias(id_col), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.encode(written(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        written(F.sort_array(F.array_union(F.col("base"), more))).alias("spans"), F.size(more).cast("long").alias("n_found"))
