"""N-gram Jaccard join by grouped prefixes, and the components its links form.

1. Each text becomes the set of its word shingles; equal sets are one class, of which one row goes on.
2. Shingles have one global order: rare before frequent ones, which a first pass over all sets finds. Two sets as similar as asked
   share a shingle among the first n - ceil(t n) + 1 of each (prefix filter), and their sizes are close (size filter). Long
   sets even share many of these, by a bound that follows from their sizes (count filter).
3. Classes of the same prefix and size form a group. Groups that share rare shingles are paired, filtered by size, place and
   count, and only then expanded into pairs of members.
4. Frequent prefix shingles may be shared by any number of classes, so there all pairs are never made: first everybody is
   paired with one pivot per shingle and size band. When these links are known, only pairs of classes that are still in
   different components are made, each class outside its band's main component against the others.
5. Pairs pass a parity sketch (which loses no similar pair) and are then verified on the whole sets: first one pair of each
   class, then those of the others that still cross components.
Links inside a component add nothing to it, so the components are those of all links.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from sourcemart.llm.common import Tally, broadcast_if, bytes_of, free_name, runs, settle, shingle_sets, smaller

FREQUENT_SHARE = 2.0 ** -20  # a shingle with this share of the counted entries is frequent: at most 1/share of them
FREQUENT_LEAST = 5
SKETCH_WORDS = 8             # 64-bit words of a sketch
BROADCAST_ROWS = 1_000_000
SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]
BEFORE = 4                   # frequent shingles before its own that an entry carries


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1 if n else 0


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    with np.errstate(over="ignore"):
        first = np.add.reduce(s * np.uint64(0x9E3779B97F4A7C15)) if len(s) else np.uint64(0)
        x = (s ^ (s >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        second = np.bitwise_xor.reduce(x ^ (x >> np.uint64(32))) if len(s) else np.uint64(0)
    return int(np.int64(np.uint64(first).astype(np.int64))), int(np.uint64(second).astype(np.int64))


def _sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the counts of shingles per bit: sets that differ in d shingles differ in at most d bits."""
    bits = np.bincount((s >> np.uint64(40)).astype(np.int64) % (64 * SKETCH_WORDS), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def frequent_shingles(docs: DataFrame, text_col: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles sorted by hash, their ranks from less to more frequent), by the sets that hold them.

    A task leaves out what it saw once. That may leave a shingle out, which changes the order and hence the work, not the
    result: any global order gives the same links.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(1 << 19)

        def more_than_once(found):
            for batch in found:
                yield batch.filter(pc.greater(batch.column(1), 1))

        for batch in smaller(batches):
            texts = bytes_of(batch.column(0))
            for a, b in runs(texts):
                tally.add(*np.unique(np.concatenate(shingle_sets(texts[a:b], width)), return_counts=True))
            yield from more_than_once(tally.batches(False, ["key", "n"]))
        yield from more_than_once(tally.batches(True, ["key", "n"]))

    counts = settle(docs.select(text_col).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "shingles")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.filter(F.col("n") >= max(FREQUENT_LEAST, total * FREQUENT_SHARE)).toArrow()
    keys, n = found["key"].to_numpy().view(np.uint64), found["n"].to_numpy()
    by_count = np.lexsort((keys, n))
    ranks = np.empty(len(keys), dtype=np.int64)
    ranks[by_count] = np.arange(len(keys))
    order = np.argsort(keys)
    return keys[order], ranks[order]


def sets_of(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """One row per row of docs: id, row, n, d1, d2 (digest), sketch words, light and heavy prefix shingles in order."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, text_col, width))
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, row long, n int, d1 long, d2 long, {', '.join(s + ' long' for s in SKETCH)}, light array<long>, heavy array<long>"
    names = ["id", "row", "n", "d1", "d2", *SKETCH, "light", "heavy"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ranks = frequent.value
        seen = np.zeros(1 << 20, dtype=bool)
        seen[known >> np.uint64(44)] = True
        row = TaskContext.get().partitionId() << 40
        for batch in smaller(batches):
            texts = bytes_of(batch.column(1))
            sizes, first, second, sketches, light, heavy = [], [], [], [], [], []
            for a, b in runs(texts):
                for s in shingle_sets(texts[a:b], width):
                    p = prefix_length(len(s), percent)
                    maybe = np.flatnonzero(seen[s >> np.uint64(44)])
                    at = np.searchsorted(known, s[maybe])
                    hit = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == s[maybe]) if len(known) else np.zeros(0, dtype=bool)
                    if hit.any():
                        rare = np.delete(s, maybe[hit])
                        common = known[at[hit]][np.argsort(ranks[at[hit]])]
                    else:
                        rare, common = s, s[:0]
                    light.append(rare[:p].view(np.int64))
                    heavy.append(common[:max(0, p - len(rare))].view(np.int64))
                    sizes.append(len(s))
                    x, y = _digest(s)
                    first.append(x)
                    second.append(y)
                    sketches.append(_sketch(s))
            n = len(texts)
            if not n:
                continue
            words = np.array(sketches).reshape(n, SKETCH_WORDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.arange(row, row + n)), pa.array(sizes, pa.int32()), pa.array(first, pa.int64()), pa.array(second, pa.int64()),
                 *[pa.array(np.ascontiguousarray(words[:, i])) for i in range(SKETCH_WORDS)], _lists(light), _lists(heavy)], names=names)
            row += n

    return docs.select(id_col, text_col).mapInArrow(make, schema)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)))


# ---- candidate pairs ------------------------------------------------------------------------------------------------

def close_sizes(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(F.col(a), F.col(b)) >= percent * F.greatest(F.col(a), F.col(b))


def close_sketches(a: str, b: str, percent: int) -> Column:
    """No similar pair differs in more bits: |A xor B| <= (|A| + |B|) (100 - t) / (100 + t)."""
    apart = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SKETCH[1:]),
                F.bit_count(F.col(f"{a}.{SKETCH[0]}").bitwiseXOR(F.col(f"{b}.{SKETCH[0]}"))))
    return apart * (100 + percent) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (100 - percent)


def ordered_pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def least_shared_prefix(a: str, b: str, percent: int) -> Column:
    """Shingles that the prefixes of two similar sets share at least.

    The prefix that ends first lies, as far as the other set has it, in the other's prefix; at most n - overlap of its
    shingles are missing there.
    """
    overlap = F.ceil(percent * (F.col(a) + F.col(b)) / (100 + percent) - 1e-9)
    length = lambda n: F.col(n) - F.ceil(F.col(n) * percent / 100 - 1e-9) + 1
    return F.least(length(a) - F.col(a) + overlap, length(b) - F.col(b) + overlap)


def light_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes whose groups share a rare prefix shingle; rare bounds how many classes can share one."""
    grouped = classes.filter(F.size("light") > 0).withColumn("prefix", F.xxhash64("light", "heavy"))
    groups = grouped.groupBy("n", "prefix").agg(F.min("rep").alias("gid"), F.count("*").alias("members"))
    many = settle(groups.filter("members > 1").select("n", "prefix", "gid"), "groups")
    few = broadcast_if(many, BROADCAST_ROWS)
    member = grouped.select("rep", "n", "prefix").join(few, ["n", "prefix"]).select("gid", "rep")
    later = member.filter("rep <> gid").select(F.col("rep").alias("_rep"))
    heads = grouped.join(broadcast_if(settle(later, "later"), BROADCAST_ROWS), F.col("rep") == F.col("_rep"), "left_anti")
    entries = heads.select("rep", "n", F.size("heavy").alias("heavy"), F.posexplode("light").alias("at", "key"))
    # One shuffle by shingle serves the count and the join. A rare shingle's entries are few by definition.
    shared = entries.repartition("key")
    x, y = shared.alias("x"), shared.alias("y")
    overlap = F.least("x.at", "y.at") + 1 + F.least(F.col("x.n") - 1 - F.col("x.at"), F.col("y.n") - 1 - F.col("y.at"))
    enough = overlap * (100 + percent) >= percent * (F.col("x.n") + F.col("y.n"))
    pairs = (x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & close_sizes("x.n", "y.n", percent) & enough)
             .groupBy(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
             .agg(F.count("*").alias("shared"), F.first("x.n").alias("na"), F.first("y.n").alias("nb"), F.first("x.heavy").alias("ha"), F.first("y.heavy").alias("hb"))
             .filter(F.col("shared") + F.least("ha", "hb") >= least_shared_prefix("na", "nb", percent)).select("a", "b"))
    if many.isEmpty():
        return pairs
    same = settle(member, "members").select("gid", "rep")
    pairs = pairs.union(many.select(F.col("gid").alias("a"), F.col("gid").alias("b")))
    for side in ("a", "b"):
        names = same.select(F.col("gid").alias("_gid"), F.col("rep").alias("_rep"))
        pairs = pairs.join(broadcast_if(names, BROADCAST_ROWS), F.col(side) == F.col("_gid"), "left").withColumn(
            side, F.coalesce("_rep", side)).drop("_gid", "_rep")
    return pairs.filter("a <> b").select(*ordered_pair(F.col("a"), F.col("b"))).distinct()


def heavy_entries(classes: DataFrame, percent: int) -> DataFrame:
    """Frequent prefix shingles with the class's size band and the shingles before them; similar sets are in the same or in neighbouring bands."""
    band = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(percent / 100))).cast("int")
    return (classes.filter(F.size("heavy") > 0)
            .select(F.size("light").alias("rare"), "heavy", F.posexplode("heavy").alias("at", "key"), band.alias("band"), "rep", "n", *SKETCH)
            .withColumn("before", F.slice("heavy", F.greatest(F.lit(1), F.col("at") + 1 - BEFORE), F.least(F.lit(BEFORE), F.col("at"))))
            .withColumn("at", F.col("at") + F.col("rare")).drop("rare", "heavy"))


def first_shared(a: str, b: str, percent: int) -> Column:
    """Whether a shingle stands early enough in both prefixes to be the first that two similar sets share.

    As many shared ones as the count filter asks for must fit behind it. A pair whose first one is rare is a light pair.
    """
    least = least_shared_prefix(f"{a}.n", f"{b}.n", percent)
    length = lambda x: F.col(f"{x}.n") - F.ceil(F.col(f"{x}.n") * percent / 100 - 1e-9) + 1
    return (F.col(f"{a}.at") <= length(a) - least) & (F.col(f"{b}.at") <= length(b) - least)


def star_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Each class with the pivot of its shingle and band."""
    pivots = (entries.groupBy("key", "band").agg(F.min(F.struct("rep", "n", "at", *SKETCH)).alias("p"), F.count("*").alias("held"))
              .filter("held > 1").select("key", "band", "p.*"))
    x, y = pivots.alias("x"), entries.alias("y")
    return (x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.rep") != F.col("y.rep"))
                   & close_sizes("x.n", "y.n", percent) & first_shared("x", "y", percent) & close_sketches("x", "y", percent))
            .select(*ordered_pair(F.col("x.rep"), F.col("y.rep"))).distinct())


def crossing_pairs(entries: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs that share a frequent shingle across components: whoever is outside a band's main component against all there.

    Both roles of a pair would find it, and so would every shingle they share. It is made in one role, and not at a shingle
    with a shared one shortly before it: that one stands earlier in both prefixes and passes wherever this one does.
    """
    named = labels.select(F.col("node").alias("rep"), "label")
    marked = settle(entries.join(broadcast_if(named, BROADCAST_ROWS), "rep", "left").withColumn("label", F.coalesce("label", "rep")), "marked")
    per_label = marked.groupBy("key", "band", "label").agg(F.count("*").alias("held"))
    main = per_label.groupBy("key", "band").agg(F.max_by("label", F.struct("held", "label")).alias("main"))
    hosts = marked.join(main, ["key", "band"])
    visits = marked.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    visitors = visits.join(main, ["key", "band"])
    out = None
    for left, right in ((visitors.filter("label <> main"), hosts), (visitors.filter("label = main"), hosts.filter("label <> main"))):
        x, y = left.alias("x"), right.alias("y")
        found = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.rep") < F.col("y.rep"))
                       & (F.col("x.label") != F.col("y.label")) & close_sizes("x.n", "y.n", percent) & first_shared("x", "y", percent)
                       & close_sketches("x", "y", percent) & ~F.arrays_overlap("x.before", "y.before"))
        found = found.select(*ordered_pair(F.col("x.rep"), F.col("y.rep")))
        out = found if out is None else out.union(found)
    return out.distinct()


# ---- verification and components ------------------------------------------------------------------------------------

def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """Pairs that are as similar as asked, on the whole sets of both. Only texts in question are read into sets again."""
    asked = settle(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
                   .join(classes.select("rep", "id", "n", "d1", "d2"), "rep"), "asked")
    ids = asked.select(F.col("id").alias("_id")).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        broadcast_if(ids, BROADCAST_ROWS), F.col("id").eqNullSafe(F.col("_id")), "left_semi")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in smaller(batches):
            found = bytes_of(batch.column(0))
            sets = [s for a, b in runs(found) for s in shingle_sets(found[a:b], width)]
            digests = [_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(s) for s in sets], pa.int32()), pa.array([d[0] for d in digests], pa.int64()),
                 pa.array([d[1] for d in digests], pa.int64()), _lists([s.view(np.int64) for s in sets])], names=["n", "d1", "d2", "members"])

    sets = texts.select("text").mapInArrow(make, "n int, d1 long, d2 long, members array<long>")
    # Sets get their class, and what they are asked for, where they are made; then the sets of b travel to those of a.
    held = sets.join(broadcast_if(asked.select("n", "d1", "d2", "rep"), BROADCAST_ROWS), ["n", "d1", "d2"]).select("rep", "members")
    sources = settle(pairs.select(F.col("a").alias("rep")).distinct(), "sources")
    x = held.join(broadcast_if(sources, BROADCAST_ROWS), "rep").select(F.col("rep").alias("a"), F.col("members").alias("ma"))
    y = held.withColumnRenamed("rep", "b").join(broadcast_if(pairs, BROADCAST_ROWS), "b").select("a", "b", F.col("members").alias("mb"))
    shared = F.size(F.array_intersect("ma", "mb"))
    union = F.size("ma") + F.size("mb") - F.col("shared")
    # An id that occurs more than once may bring a set twice.
    return y.join(x, "a").withColumn("shared", shared).filter(100 * F.col("shared") >= percent * union).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component, for nodes that have links.

    Every round takes the smallest label among the neighbours and then that label's own label, so labels travel distances
    that double; each round is a table in shared storage.
    """
    links = settle(links, "links")
    both = links.union(links.select("b", "a")).toDF("node", "other")
    labels = settle(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")).withColumn("moved", F.lit(True)), "labels")
    while not labels.filter("moved").isEmpty():
        now = labels.select("node", "label")
        near = (both.join(now.toDF("other", "near"), "other").groupBy("node").agg(F.min("near").alias("near")))
        nearer = now.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = now.toDF("label", "further")
        labels = settle(nearer.join(jump, "label").select("node", F.least("label", "further").alias("label"),
                                                          (F.least("label", "further") < F.col("old")).alias("moved")), "labels")
    return labels.select("node", "label")


def similar_components(docs: DataFrame, width: int, percent: int, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id.

    Words are runs of other than ASCII white space, A-Z as a-z. Two texts link when 100 * shared >= percent * union of their
    distinct ``width``-word shingles; shorter texts are one shingle. Null texts and texts without words have none, link with
    nothing and are components of their own. ``component_id`` is the smallest id in the component; a null id is never the
    smallest unless all are null. Repeated rows are in one component. Other columns are not read.
    """
    rows = settle(sets_of(docs, id_col, text_col, width, percent), "rows")
    key = ["n", "d1", "d2"]
    best = (rows.filter("n > 0").groupBy(*key).agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("best"), F.count("*").alias("held"))
            .filter("held > 1").select(*key, F.col("best.row").alias("best")))
    # Only sets held more than once meet the rows again, so a set with very many copies is reduced where its rows are.
    copies = rows.filter("n > 0").select(*key, "row").join(broadcast_if(settle(best, "best"), BROADCAST_ROWS), key).filter("row <> best").select("row")
    # Copies are few beside the rows, whose prefixes stay where they are.
    classes = rows.filter("n > 0").join(broadcast_if(settle(copies, "copies"), BROADCAST_ROWS), "row", "left_anti").withColumnRenamed("row", "rep")
    sketches = classes.select("rep", "n", *SKETCH)
    light = settle(light_pairs(classes, percent), "light")
    x, y = sketches.alias("x"), sketches.alias("y")
    light = (light.join(x, F.col("a") == F.col("x.rep")).join(y, F.col("b") == F.col("y.rep"))
             .filter(close_sketches("x", "y", percent)).select("a", "b"))
    entries = heavy_entries(classes, percent)
    pairs = settle(light.union(star_pairs(entries, percent)).distinct(), "pairs")
    check = lambda asked, purpose: settle(verified(asked, classes, docs, id_col, text_col, width, percent), purpose)
    # A group of k similar classes has k^2 / 2 pairs; one pair of each class nearly always tells its component.
    first = settle(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")
    links = check(first, "links")
    labels = components(links)
    label = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))
    crosses = F.coalesce("label_a", "a") != F.coalesce("label_b", "b")
    open_pairs = pairs.join(first, ["a", "b"], "left_anti").join(label("a"), "a", "left").join(label("b"), "b", "left").filter(crosses).select("a", "b")
    rest = settle(open_pairs.union(crossing_pairs(entries, labels, percent)).distinct(), "crossing")
    if not rest.isEmpty():
        more = check(rest, "more")
        if not more.isEmpty():
            labels = components(links.union(more))
    named = classes.select("n", "d1", "d2", "id", "rep").join(labels, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("label", "rep"))
    named = settle(named.select("n", "d1", "d2", "id", "label"), "named")
    # Most components are one class; only the others need the smallest id of several.
    lowest = named.groupBy("label").agg(F.min("id").alias("component_id"))
    named = named.select("n", "d1", "d2", "label").join(lowest, "label").select("n", "d1", "d2", "component_id")
    return (rows.select("id", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left")
            .select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
                    F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id")))


def drop_near_duplicates(docs: DataFrame, width: int, percent: int, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of ``docs``, with all columns, that have the smallest id of their component.

    Ids are taken to name one text: rows repeated whole stay or go together, and where an id has several texts its rows go
    only if none of them stays. Rows with a null id stay.
    """
    found = settle(similar_components(docs, width, percent, id_col, text_col), "components")
    stays = F.max(F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
    gone = found.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(stays.alias("stays")).filter(~F.col("stays"))
    mine = free_name(docs, "_id")
    gone = settle(gone.select(F.col("_id").alias(mine)), "gone")
    return docs.join(broadcast_if(gone, BROADCAST_ROWS), F.col(id_col) == F.col(mine), "left_anti")
