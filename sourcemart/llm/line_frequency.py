"""Quality rules by cross-document line frequency (DataFrame functions only).

Counts per text come first (words, symbols, repeated lines and windows). Then every normalised line is hashed, the distinct
documents that hold it are counted per host, lines above the host's limit are removed from the texts, and documents that keep
too little are rejected. Exact copies of a text count as one document, so a copied article doesn't turn its own lines into boilerplate.
"""

from pyspark.sql import Column, DataFrame, functions as F

from sourcemart.llm.common import free_name, settle

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20          # of a text, and of what is left after lines were removed
REPEAT_PERCENT = 30
LIMIT_SHARE = 0.10      # a line is boilerplate of its host when more than this share of the host's documents hold it
LIMIT_LEAST = 30        # and more than this number
LEFT_SHARE = 0.30       # a document that keeps less than this share of its words is depleted
BROADCAST_ROWS = 500_000


def let(value: Column, body) -> Column:
    """``body`` of the value, which is worked out once per row however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def repeated_window_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in a ``width``-word window found twice or more among the words."""
    none = F.lit(0).cast("long")

    def covered(places):
        gaps = F.transform(F.sequence(F.lit(1), F.size(places)), lambda i: F.least(
            F.lit(width), F.coalesce(F.get(places, i) - F.get(places, i - 1), F.lit(width))))
        return F.aggregate(gaps, none, lambda a, g: a + g)

    def places_of_repeats(ordered):
        at = F.sequence(F.lit(0), F.size(ordered) - 1)
        same = lambda i, j: F.coalesce(F.get(ordered, i)["h"] == F.get(ordered, j)["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(at, lambda i: same(i, i - 1) | same(i, i + 1)),
                                        lambda i: F.get(ordered, i)["i"]))

    def of_hashes(hashes):
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), none).otherwise(
            let(let(ordered, places_of_repeats), covered))

    def of_words(w):
        starts = F.sequence(F.lit(1), F.size(w) - (width - 1))
        return F.when(F.size(w) <= width, none).otherwise(
            let(F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, F.lit(width)))), of_hashes))

    return let(words, of_words)


def line_hash(line: Column) -> Column:
    return F.xxhash64(normalised(line))


def normalised(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.btrim(line, F.lit(SPACE_CHARS)), SPACE, " "))


def text_counts(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source") -> DataFrame:
    """One pass over the texts: the counts, a digest of the text, and the distinct normalised lines with their words."""
    raw = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
                      F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    split = raw.withColumn("words", words_of(F.col("text"))).withColumn(
        "lines", F.filter(F.split("text", "\n"), lambda s: F.btrim(s, F.lit(SPACE_CHARS)) != ""))
    size = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1
    symbols = F.when(F.col("text").rlike(r"[#*$%&|<>]"), F.length("text") - F.length(F.translate("text", SYMBOLS, "")))
    return split.select(
        "id", "host", "row", F.xxhash64("text").alias("digest"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        F.coalesce(symbols, F.lit(0)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("words")).alias("n_repeat_words"),
        F.array_distinct(F.transform(F.transform("lines", normalised), lambda s: F.struct(
            F.xxhash64(s).alias("h"), size(s).alias("w")))).alias("lines"))


def frequent_lines(counted: DataFrame, limit_share=LIMIT_SHARE, limit_least=LIMIT_LEAST) -> DataFrame:
    """(host, h): lines held by more distinct documents of the host than its limit."""
    hosts = counted.select("host", "digest").groupBy("host").agg(F.count_distinct("digest").alias("docs"))
    held = (counted.select("host", "digest", F.explode("lines.h").alias("h")).groupBy("host", "h")
            .agg(F.count_distinct("digest").alias("held")).filter(F.col("held") > limit_least))
    return held.join(hosts, "host").filter(F.col("held") > F.col("docs") * limit_share).select("host", "h")


def with_host_lines(rows: DataFrame, counted: DataFrame, limit_share=LIMIT_SHARE, limit_least=LIMIT_LEAST) -> DataFrame:
    """``rows`` with ``gone``: the boilerplate lines of their ``host``, null if it has none.

    A line held by more than a share of a host's documents: so there are at most 1 / share times as many as a document has
    distinct lines on average, and a host's lines fit in one array.
    """
    lines = settle(frequent_lines(counted, limit_share, limit_least), "boilerplate")
    by_host = lines.groupBy("host").agg(F.collect_list("h").alias("gone"))
    return rows.join(F.broadcast(by_host) if lines.count() <= BROADCAST_ROWS else by_host, "host", "left")


def without_boilerplate(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source", limit_share=LIMIT_SHARE,
                        limit_least=LIMIT_LEAST) -> DataFrame:
    """All rows of ``docs`` with their columns, each text without the lines that are boilerplate of its host.

    The lines left stay as they are and in their order; a text without such lines, a null one too, is not touched.
    """
    host, gone = free_name(docs, "host"), free_name(docs, "gone")
    counted = settle(text_counts(docs, id_col, text_col, host_col).select("host", "digest", "lines"), "counts")
    lines = with_host_lines(counted.select("host").distinct(), counted, limit_share, limit_least).filter("gone is not null")
    lines = settle(lines.select(F.col("host").alias(host), F.col("gone").alias(gone)), "hosts")
    held = F.split(text_col, "\n")
    own = F.array_intersect(F.transform(held, line_hash), F.col(gone))
    left = let(own, lambda mine: F.when(F.size(mine) == 0, F.col(text_col)).otherwise(
        F.array_join(F.filter(held, lambda s: ~F.array_contains(mine, line_hash(s))), "\n")))
    few = lines.agg(F.coalesce(F.sum(F.size(gone)), F.lit(0))).first()[0] <= BROADCAST_ROWS
    rows = docs.withColumn(host, F.coalesce(F.col(host_col).cast("string"), F.lit(""))).join(F.broadcast(lines) if few else lines, host, "left")
    return rows.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(left)).select(*docs.columns)


def quality_rules(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source", limit_share=LIMIT_SHARE,
                  limit_least=LIMIT_LEAST, left_share=LEFT_SHARE, min_words=MIN_WORDS) -> DataFrame:
    """One row per row of ``docs``: id, counts, base_failed, removed_words, kept.

    Null or blank texts have no words and fail. A null host is a host of its own. Removal is measured over the distinct
    lines of a document: it is depleted if what is left has under ``min_words`` words or under ``left_share`` of its words.
    Rows repeated whole are each judged, and count as one document. Columns besides the three named are not read.
    """
    counted = settle(text_counts(docs, id_col, text_col, host_col), "counts")
    words = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda a, s: a + s["w"])
    own = F.array_intersect("lines.h", F.coalesce("gone", F.array().cast("array<bigint>")))
    removed = let(own, lambda mine: F.when(F.size(mine) == 0, F.lit(0).cast("long")).otherwise(
        words(F.filter("lines", lambda s: F.array_contains(mine, s["h"])))))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    left = F.col("all_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((left < min_words) | (left < left_share * F.col("all_words")))
    return (with_host_lines(counted, counted, limit_share, limit_least)
            .withColumn("all_words", words("lines")).withColumn("removed_words", removed).drop("lines", "gone")
            .withColumn("base_failed", failed)
            .select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "removed_words", (~F.col("base_failed") & ~depleted).alias("kept")))
