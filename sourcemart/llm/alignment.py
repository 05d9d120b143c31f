"""Alignment of two tokenizers by divide and conquer at shared cuts, and counts of the id pairs it links.

Both tokenizers spell the same bytes, so byte offsets where a token of each ends cut a text into groups. An interval of
tokens is cut at the common end nearest to its middle, found by bisecting the ends of the other tokenizer for a candidate
and going outward from there; both halves are cut again, and an interval without a common end inside is a group. All
intervals of a level, of many texts, are cut together.

Texts are aligned once, where they are read, and leave a row with their linked id pairs. Spark counts the documents of each
pair. Pairs of a bounded table of the most frequent ones are then looked up there, all others by a join.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sourcemart.llm.common import process_cache, runs, settle, smaller
from sourcemart.llm.tokens import TwoCodecs

PROBES = 8                 # steps outward from the middle, all intervals together; the few left are searched one by one
FREQUENT_ROWS = 1 << 20    # id pairs looked up in a broadcast table
PAIR_BLOCK = 1 << 21       # links expanded together
IDS_B = 1 << 15            # ids of the second tokenizer are below this


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, a0, a1, b0, b1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups (a0, a1, b0, b1) in order, as ranges of tokens, of intervals given as ranges whose last tokens end together.

    ``ends_a`` and ``ends_b`` are the byte ends of all tokens, increasing.
    """
    done = []
    while len(a0):
        whole = (a1 - a0 == 1) | (b1 - b0 == 1)
        done.append((a0[whole], a1[whole], b0[whole], b1[whole]))
        a0, a1, b0, b1 = (x[~whole] for x in (a0, a1, b0, b1))
        if not len(a0):
            break
        middle = (a0 + a1 - 2) >> 1
        cut, place = np.full(len(a0), -1), np.empty(len(a0), dtype=np.int64)
        active = np.arange(len(a0))
        for step in range(2 * PROBES - 1):
            at = middle[active] + (step + 1) // 2 * (1 if step % 2 else -1)
            inside = (at >= a0[active]) & (at <= a1[active] - 2)
            end = ends_a[np.where(inside, at, 0)]
            found = np.searchsorted(ends_b, end)  # not beyond: the interval ends on both sides later
            hit = inside & (ends_b[found] == end)
            cut[active[hit]], place[active[hit]] = at[hit], found[hit]
            active = active[~hit]
            if not len(active):
                break
        for i in active[(a1 - a0)[active] > PROBES].tolist():  # ends further out than the probes went
            inner = ends_a[a0[i]:a1[i] - 1]
            found = np.searchsorted(ends_b, inner)
            common = np.flatnonzero(ends_b[found] == inner)
            if len(common):
                best = common[np.abs(common + a0[i] - middle[i]).argmin()]
                cut[i], place[i] = a0[i] + best, found[best]
        leaf = cut < 0
        done.append((a0[leaf], a1[leaf], b0[leaf], b1[leaf]))
        a0, a1, b0, b1, cut, place = (x[~leaf] for x in (a0, a1, b0, b1, cut, place))
        halves = lambda low, high: np.stack([low, high], axis=1).ravel()  # in order, so that searches go on nearby
        a0, a1, b0, b1 = halves(a0, cut + 1), halves(cut + 1, a1), halves(b0, place + 1), halves(place + 1, b1)
    groups = [np.concatenate([d[k] for d in done]) if done else np.empty(0, dtype=np.int64) for k in range(4)]
    order = np.argsort(groups[0])
    return tuple(g[order] for g in groups)


class Aligned:
    """Tokens of some texts and their groups. Texts without tokens have no group."""

    def __init__(self, codecs: TwoCodecs, texts: list[str]):
        sides = [codecs.ids(t) for t in texts]
        self.n_a, self.n_b = (np.array([len(s[k]) for s in sides], dtype=np.int64) for k in (0, 1))
        self.a, self.b = (np.concatenate([s[k] for s in sides] or [np.empty(0, dtype=np.int32)]).astype(np.int64) for k in (0, 1))
        last_a, last_b = np.cumsum(self.n_a), np.cumsum(self.n_b)
        some = np.flatnonzero(self.n_a)
        self.a0, self.a1, self.b0, self.b1 = shared_cuts(
            np.cumsum(codecs.size_a[self.a]), np.cumsum(codecs.size_b[self.b]),
            (last_a - self.n_a)[some], last_a[some], (last_b - self.n_b)[some], last_b[some])
        self.first = np.searchsorted(self.a0, np.append(last_a - self.n_a, len(self.a)))  # first group of each text, and the end
        self.links = (self.a1 - self.a0) * (self.b1 - self.b0)                            # per group

    def n_groups(self) -> np.ndarray:
        return np.diff(self.first)

    def n_links(self) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(self.links)])
        return total[self.first[1:]] - total[self.first[:-1]]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, id pair, links), distinct within a block of about PAIR_BLOCK links; a text may go on in the next block."""
        owner = np.repeat(np.arange(len(self.n_a)), np.diff(self.first))
        wide = self.b1 - self.b0
        # An A token and its group's B tokens: one entry per A token, in order.
        of = np.repeat(np.arange(len(self.a0)), self.a1 - self.a0)
        token = np.arange(len(of)) if len(of) == len(self.a) else np.concatenate([np.arange(p, q) for p, q in zip(self.a0, self.a1)])
        total = np.concatenate([[0], np.cumsum(wide[of])])
        start = 0
        while start < len(of):
            end = max(start + 1, int(np.searchsorted(total, total[start] + PAIR_BLOCK, side="right")) - 1)
            group, sizes = of[start:end], wide[of[start:end]]
            begin = np.cumsum(sizes) - sizes
            b = self.b[np.repeat(self.b0[group] - begin, sizes) + np.arange(int(sizes.sum()))]
            key = np.repeat((owner[group] << 31) + self.a[token[start:end]] * IDS_B, sizes) + b
            key, n = np.unique(key, return_counts=True)
            yield key >> 31, key & ((1 << 31) - 1), n
            start = end

    def merged_pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, id pair, links) in order, each pair of a text once."""
        parts = list(self.pairs())
        if len(parts) == 1:
            return parts[0]
        text, pair, times = (np.concatenate([p[k] for p in parts] or [np.empty(0, dtype=np.int64)]) for k in range(3))
        key, back = np.unique(text << 31 | pair, return_inverse=True)
        total = np.zeros(len(key), dtype=np.int64)
        np.add.at(total, back, times)
        return key >> 31, key & ((1 << 31) - 1), total

    def digests(self, names: list[bytes]) -> list[str]:
        """SHA-256 of the groups of each text, written as ``a1,a2|b1;a3|b2,b3``; '' without tokens."""
        half = len(names) // 4
        of_a = np.repeat(np.arange(len(self.a0)), self.a1 - self.a0)
        of_b = np.repeat(np.arange(len(self.b0)), self.b1 - self.b0)
        tokens = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        tokens[np.arange(len(self.a)) + self.b0[of_a]] = self.a * 2 + (np.arange(len(self.a)) == self.a1[of_a] - 1)
        tokens[np.arange(len(self.b)) + self.a1[of_b]] = 2 * half + self.b * 2 + (np.arange(len(self.b)) == self.b1[of_b] - 1)
        out, at = [], 0
        for n in (self.n_a + self.n_b).tolist():
            out.append(hashlib.sha256(b"".join([names[t] for t in tokens[at:at + n].tolist()])[:-1]).hexdigest() if n else "")
            at += n
        return out


def group_names(ids: int) -> list[bytes]:
    """By 2 * id + last: the text of an A token in its group; then the same of B tokens."""
    names = []
    for last in (b"|", b";"):
        for i in range(ids):
            names += [b"%d," % i, b"%d%s" % (i, last)]
    return names


def _codecs() -> TwoCodecs:
    kept = process_cache()
    if "two codecs" not in kept:
        kept["two codecs"] = TwoCodecs()
    return kept["two codecs"]


def _aligned(texts: list[str]) -> Iterator[tuple[int, int, Aligned]]:
    for a, b in runs([t.encode() for t in texts]):
        yield a, b, Aligned(_codecs(), texts[a:b])


def aligned_rows(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b, n_groups, n_links, groups_sha256, and its linked id pairs (A id * 2^15 +
    B id, each once, in order) with the number of links of each."""
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = process_cache()
        spelled = kept["group names"] = kept.get("group names") or group_names(max(len(_codecs().bytes_a), len(_codecs().bytes_b)))
        for batch in smaller(batches, 256):
            for a, b, aligned in _aligned([t or "" for t in batch.column(0).to_pylist()]):
                text, pair, times = aligned.merged_pairs()
                offsets = pa.array(np.searchsorted(text, np.arange(b - a + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (pair, times)]
                counts = [aligned.n_a, aligned.n_b, aligned.n_groups(), aligned.n_links()]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), *[pa.array(c) for c in counts],
                                                  pa.array(aligned.digests(spelled), pa.string()), *lists], names=names)

    return docs.select(F.col(text_col).alias("_text"), id_col).mapInArrow(rows, schema)


def frequent_from(counts: DataFrame, rows: int) -> int:
    """The least power of two so that at most ``rows`` pairs are held by at least as many documents."""
    levels = counts.groupBy((F.length(F.bin("n")) - 1).alias("level")).agg(F.count("*").alias("rows")).collect()  # at most 64
    kept, least = 0, 1 << 62
    for level, n in sorted(((r["level"], r["rows"]) for r in levels), reverse=True):
        kept += n
        if kept > rows:
            return least
        least = 1 << level
    return 1


def align(docs: DataFrame, id_col="doc_id", text_col="text", frequent_rows=FREQUENT_ROWS) -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts that are null or empty, or whose tokens spell other bytes than space + text, have no tokens: zeros and ''. Each
    repeated row is a document of its own. Ids of any type, null included, are carried along; other columns are not read.
    No rows give no rows.
    """
    spark = docs.sparkSession
    aligned = settle(aligned_rows(docs, id_col, text_col), "aligned")
    counted = settle(aligned.select(F.explode("pairs").alias("pair")).groupBy(F.col("pair").cast("long").alias("pair")).agg(F.count("*").alias("n")), "pairs")
    best = counted.groupBy(F.shiftright("pair", 15).alias("a")).agg(F.max("n").alias("most"))  # one row per id of the vocabulary
    counts = settle(counted.join(F.broadcast(best), F.shiftright("pair", 15) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")
    least = frequent_from(counts, frequent_rows)
    known = counts.filter(F.col("n") >= least).toArrow()  # at most frequent_rows
    order = np.argsort(known["pair"].to_numpy())
    shared = spark.sparkContext.broadcast((known["pair"].to_numpy()[order].astype(np.int32), known["n"].to_numpy()[order], known["best"].to_numpy()[order]))
    sums = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, {', '.join(s + ' long' for s in sums)}, groups_sha256 string, row long, pairs array<int>, times array<int>"
    names = ["id", *sums, "groups_sha256", "row", "pairs", "times"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, is_best = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in smaller(batches, 512):
            lists, size = batch.column("pairs"), batch.num_rows
            sizes = np.diff(lists.offsets.to_numpy())
            owner, pair, times = np.repeat(np.arange(size), sizes), lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            hit = pairs[at] == pair if len(pairs) else np.zeros(len(pair), dtype=bool)
            total, best_links = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
            np.add.at(total, owner[hit], n[at[hit]] * times[hit])
            np.add.at(best_links, owner[hit], is_best[at[hit]] * times[hit])
            rest = pa.array(np.searchsorted(owner[~hit], np.arange(size + 1)).astype(np.int32))
            rare = [pa.ListArray.from_arrays(rest, pa.array(x[~hit].astype(np.int32))) for x in (pair, times)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")] + [pa.array(best_links), pa.array(total)]
                + [batch.column("groups_sha256"), pa.array(np.arange(row, row + size)), *rare], names=names)
            row += size

    looked = aligned.mapInArrow(look_up, schema)
    if least > 1:  # some pairs are not in the table
        looked = settle(looked, "looked")
        rare = (looked.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumn("pair", F.col("pairs").cast("long"))
                .join(counts.filter(F.col("n") < least), "pair").groupBy("row").agg(
                    F.sum(F.col("n") * F.col("times")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best")))
        looked = looked.join(rare, "row", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))})
    return looked.select(F.col("id").alias(id_col), *sums, "groups_sha256")
