"""Collocations by counting phrases in burst tries whose subtrees are spilled as sorted runs.

A word's id is a 64-bit hash of language and word; the table of words, which is counted first, proves that no two words
share one. Phrases grow by a word a pass: only where both of its shorter phrases are frequent can a longer one be, and a
bounded bitmap tells tasks which may be. A task counts in hash containers under a shallow trie over word ids: a path of ids
is put in order by the upper bits of its first word's id and then by its hash, and a container of such a range bursts into
sixteen when it grows, so a hot first word ends up in many. When the trie holds too much, its largest subtrees leave whole, as
sorted runs. Runs of all tasks meet in partitions by path, are sorted and merged there.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sourcemart.llm.common import CHUNK_BYTES, LOWER, bytes_of, mix, runs, settle, smaller

LEAST = 10            # occurrences of a candidate
WIDEST = 3            # words of a candidate, at most
TOP = 2000            # phrases reported per language
SHADOW = 50           # percent of a phrase's occurrences inside one longer candidate that drop it
PREFIX = 16           # bits of the first word's id by which paths are put in order
BURST = 1 << 15       # paths of a container that becomes sixteen
MOST_ENTRIES = 1 << 20  # paths of a task's trie; spilled down to half
MOST_WORDS = 200_000  # of a task's table of words
MAP_BITS = 1 << 27    # of a bitmap, at most: 16 MB
UNKNOWN = "und"
BASE = 0x9E3779B97F4A7C15 | 1
SEEDS = (0x51ED270B, 0x2545F491, 0x6C62272E)

IS_BREAK = np.zeros(256, dtype=bool)
IS_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
IS_GAP = IS_BREAK.copy()
IS_GAP[list(b" \t")] = True


# ---- words of a run of texts ----------------------------------------------------------------------------------------

def _cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-case bytes of all texts, starts, ends of their words)."""
    blob = LOWER[np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", dtype=np.uint8)]
    gap = IS_GAP[blob]
    edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    return blob, edges[::2], edges[1::2]


def _hashes(blob: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: eight bytes a step, for all ranges that are as long."""
    lengths = ends - starts
    out = mix(lengths.astype(np.uint64) * np.uint64(BASE))
    padded = np.concatenate([blob, np.zeros(8, dtype=np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (len(blob), 8), (1, 1))
    active, step = np.arange(len(starts)), 0
    while len(active):
        eight = np.ascontiguousarray(words[starts[active] + step]).view("<u8").ravel()
        over = np.minimum(lengths[active] - step, 8).astype(np.uint64)
        eight &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - over * np.uint64(8))
        out[active] = mix((out[active] ^ eight) * np.uint64(BASE))
        step += 8
        active = active[lengths[active] > step]
    return out


def _language_keys(langs: list[str], seed: int) -> np.ndarray:
    """A 64-bit key per language name."""
    kinds = {lang: int(_hashes(np.frombuffer(lang.encode() + b"\0", dtype=np.uint8), np.array([0]), np.array([len(lang.encode()) + 1]))[0]) for lang in set(langs)}
    return mix(np.array([kinds[lang] for lang in langs], dtype=np.uint64) ^ np.uint64(seed))


def word_ids(texts: list[bytes], langs: list[str], seed: int):
    """(ids of all words, whether each word and the next are in one piece, starts, ends, text of each word, bytes)."""
    blob, starts, ends = _cut(texts)
    borders = np.cumsum([1] + [len(t) + 1 for t in texts])
    owner = np.searchsorted(borders, starts, side="right") - 1
    ids = mix(_hashes(blob, starts, ends) ^ _language_keys(langs, seed)[owner]) if len(starts) else np.empty(0, dtype=np.uint64)
    breaks = np.concatenate([[0], np.cumsum(IS_BREAK[blob], dtype=np.int32)])
    joined = breaks[starts[1:]] == breaks[ends[:-1]] if len(starts) else np.empty(0, dtype=bool)
    return ids, joined, starts, ends, owner, blob


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[str]]]:
    """Texts with their languages, in runs of about CHUNK_BYTES."""
    for batch in smaller(batches):
        texts, langs = bytes_of(batch.column(0)), [UNKNOWN if x is None else x for x in batch.column(1).to_pylist()]
        for a, b in runs(texts, CHUNK_BYTES):
            yield texts[a:b], langs[a:b]


# ---- the trie -------------------------------------------------------------------------------------------------------

def path_hash(paths: list[np.ndarray]) -> np.ndarray:
    out = paths[0]
    for p in paths[1:]:
        out = mix(out * np.uint64(BASE) + p)
    return out


def path_keys(paths: list[np.ndarray]) -> np.ndarray:
    """Where paths stand in the trie: the upper PREFIX bits of the first word's id, then a hash of the whole path."""
    return (paths[0] >> np.uint64(64 - PREFIX) << np.uint64(64 - PREFIX)) | (path_hash(paths) >> np.uint64(PREFIX))


def merged(keys: np.ndarray, paths: list[np.ndarray], counts: np.ndarray | None = None):
    """(keys, distinct paths, their counts) in the order of the keys. Different paths of one key stay apart."""
    order = np.argsort(keys, kind="stable")
    keys, paths = keys[order], [p[order] for p in paths]
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for p in paths:
        new[1:] |= p[1:] != p[:-1]
    first = np.flatnonzero(new)
    sums = np.diff(np.append(first, len(order))) if counts is None else np.add.reduceat(counts[order], first) if len(first) else counts
    return keys[first], [p[first] for p in paths], sums


class Container:
    """Paths of one key range with their counts, in the order of their hashes; what was added since lies beside them."""

    def __init__(self, parts=()):
        self.parts = list(parts)
        self.settled = self.held = sum(len(p[0]) for p in self.parts)

    def add(self, part) -> None:
        self.parts.append(part)
        self.held += len(part[0])

    def settle(self):
        if len(self.parts) > 1:
            keys, counts = (np.concatenate([p[k] for p in self.parts]) for k in (0, 2))
            paths = [np.concatenate(side) for side in zip(*[p[1] for p in self.parts])]
            self.parts = [merged(keys, paths, counts)]
        self.settled = self.held = sum(len(p[0]) for p in self.parts)
        return self.parts[0] if self.parts else None


class BurstTrie:
    """Counts of id sequences in containers under a trie over the digits (of four bits) of their keys.

    A container that grows beyond ``burst`` paths is replaced by one per next digit. Leaves are kept by their lower bounds;
    a path belongs to the last one whose bound is not above its key. When more than ``most`` paths are held, the largest of
    the sixteen subtrees leave whole.
    """

    def __init__(self, words: int, burst: int = BURST, most: int = MOST_ENTRIES):
        self.words, self.burst, self.most = words, burst, most
        self.bounds, self.depths, self.leaves = [0], [0], [Container()]

    @property
    def held(self) -> int:
        return sum(leaf.held for leaf in self.leaves)

    def add(self, keys: np.ndarray, paths: list[np.ndarray], counts: np.ndarray) -> None:
        """Adds paths in the order of their keys."""
        cuts = [0, *np.searchsorted(keys, np.array(self.bounds[1:], dtype=np.uint64)).tolist(), len(keys)]
        for i in range(len(self.leaves) - 1, -1, -1):  # from the last, as a burst moves those behind it
            start, end = cuts[i], cuts[i + 1]
            if start < end:
                leaf = self.leaves[i]
                leaf.add((keys[start:end], [p[start:end] for p in paths], counts[start:end]))
                if leaf.held > 2 * leaf.settled + self.burst // 2:
                    leaf.settle()
                    if leaf.settled > self.burst and self.depths[i] < 16:
                        self._split(i)

    def _split(self, i: int) -> None:
        keys, paths, counts = self.leaves[i].settle()
        shift = 60 - 4 * self.depths[i]
        bounds = [self.bounds[i] + (digit << shift) for digit in range(16)]
        cuts = [0, *np.searchsorted(keys, np.array(bounds[1:], dtype=np.uint64)).tolist(), len(keys)]
        parts = [Container([(keys[a:b].copy(), [p[a:b].copy() for p in paths], counts[a:b].copy())]) for a, b in zip(cuts, cuts[1:])]
        self.bounds[i:i + 1], self.depths[i:i + 1], self.leaves[i:i + 1] = bounds, [self.depths[i] + 1] * 16, parts

    def spill(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """Sorted runs of whole subtrees, the largest first, until half is left; all of them, in order, at the end."""
        if not last and self.held <= self.most:
            return
        for leaf in self.leaves:
            leaf.settle()
        subtrees: dict[int, list[int]] = {}
        for i, bound in enumerate(self.bounds):
            subtrees.setdefault(bound >> 60 if self.depths[i] else 0, []).append(i)
        size = lambda root: sum(self.leaves[i].held for i in subtrees[root])
        names = [f"w{k + 1}" for k in range(self.words)] + ["n"]
        gone: set[int] = set()
        for root in sorted(subtrees) if last else sorted(subtrees, key=size, reverse=True):
            if not last and 2 * self.held <= self.most:
                break
            for i in subtrees[root]:
                for _, paths, counts in self.leaves[i].parts:
                    for a in range(0, len(counts), 1 << 16):
                        yield pa.RecordBatch.from_arrays([pa.array(c[a:a + (1 << 16)].view(np.int64)) for c in (*paths, counts)], names=names)
                self.leaves[i] = Container()
            gone.add(root)
        kept = [i for i in range(len(self.leaves)) if not (self.depths[i] > 1 and self.bounds[i] >> 60 in gone and self.bounds[i] & ((1 << 60) - 1))]
        self.depths = [min(self.depths[i], 1) if self.bounds[i] >> 60 in gone else self.depths[i] for i in kept]
        self.bounds, self.leaves = [self.bounds[i] for i in kept], [self.leaves[i] for i in kept]


# ---- counts ---------------------------------------------------------------------------------------------------------

def count_words(docs: DataFrame, text_col: str, lang_col: str, seed: int) -> DataFrame:
    """(id, lang, word, n) of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}
        named: dict[int, tuple[str, bytes]] = {}

        def give() -> pa.RecordBatch:
            ids = np.fromiter(held, dtype=np.uint64, count=len(held)).view(np.int64)
            langs, words = zip(*(named[i] for i in held))
            made = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()),
                                               pa.array(list(held.values()), pa.int64())], names=["id", "lang", "word", "n"])
            held.clear()
            named.clear()
            return made

        for texts, langs in _slices(batches):
            ids, _, starts, ends, owner, blob = word_ids(texts, langs, seed)
            ids, at, counts = np.unique(ids, return_index=True, return_counts=True)
            raw = blob.tobytes()
            for i, n, s, e, o in zip(ids.tolist(), counts.tolist(), starts[at].tolist(), ends[at].tolist(), owner[at].tolist()):
                if i in held:
                    held[i] += n
                else:
                    held[i], named[i] = n, (langs[o], raw[s:e])
            if len(held) > MOST_WORDS:
                yield give()
        if held:
            yield give()

    found = docs.select(text_col, F.col(lang_col).cast("string")).mapInArrow(count, "id long, lang string, word string, n long")
    return found.groupBy("id", "lang", "word").agg(F.sum("n").alias("n"))


def checked_words(docs: DataFrame, text_col: str, lang_col: str) -> tuple[DataFrame, int]:
    """(words, seed): counts of all words under a seed by which no two of them share an id."""
    for seed in SEEDS:
        words = settle(count_words(docs, text_col, lang_col, seed), "words")
        if words.groupBy("id").count().filter("count > 1").isEmpty():
            return words, seed
    raise RuntimeError("Word ids collide under every seed")


def bitmap(frequent: DataFrame, columns: list[str]) -> np.ndarray:
    """Bits at the hashes of the paths; at most MAP_BITS, so large inputs only see more chance hits, which cost time."""
    bits = 1 << 16
    wanted = 16 * frequent.count()
    while bits < min(wanted, MAP_BITS):
        bits *= 2

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = path_hash([c.to_numpy().view(np.uint64) for c in batch.columns]) & np.uint64(bits - 1)
            yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64))], names=["at"])

    parts = (frequent.select(*columns).mapInArrow(places, "at long").groupBy(F.shiftright("at", 15).alias("part"))
             .agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit((1 << 15) - 1))).alias("set")).collect())  # at most 16 MB
    out = np.zeros(bits // 8, dtype=np.uint8)
    for part in parts:
        piece = np.frombuffer(bytes(part["set"]), dtype=np.uint8)
        out[part["part"] << 12:(part["part"] + 1) << 12] = piece[:len(out)]
    return out


def may_hold(bits: np.ndarray, paths: list[np.ndarray]) -> np.ndarray:
    at = path_hash(paths) & np.uint64(8 * len(bits) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def count_phrases(docs: DataFrame, text_col: str, lang_col: str, seed: int, words: int, shorter: np.ndarray, least: int) -> DataFrame:
    """(w1, ..., n): phrases of ``words`` words with at least ``least`` occurrences, of which ``shorter`` may hold both shorter ones."""
    bits = docs.sparkSession.sparkContext.broadcast(shorter)
    path = [f"w{k + 1}" for k in range(words)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, trie = bits.value, BurstTrie(words)
        for texts, langs in _slices(batches):
            ids, joined, *_ = word_ids(texts, langs, seed)
            n = len(ids) - words + 1
            if n < 1:
                continue
            part = [ids[k:len(ids) - words + 2 + k] for k in range(words - 1)]  # all phrases that are a word shorter
            good = may_hold(known, part)
            whole = good[:-1] & good[1:]
            for k in range(words - 1):
                whole &= joined[k:k + n]
            at = np.flatnonzero(whole)
            if len(at):
                paths = [ids[at + k] for k in range(words)]
                trie.add(*merged(path_keys(paths), paths))
                yield from trie.spill()
        yield from trie.spill(last=True)

    found = docs.select(text_col, F.col(lang_col).cast("string")).mapInArrow(count, ", ".join(f"{w} long" for w in path) + ", n long")
    counted = found.repartition(*path).sortWithinPartitions(*path).groupBy(*path).agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least)


# ---- scores ---------------------------------------------------------------------------------------------------------

def cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exactly, for counts below 10^15; at most 1000000."""
    exact = lambda c: c.cast("decimal(15,0)")
    above = (F.lit(1_000_000).cast("decimal(7,0)") * exact(a) * exact(a)).cast("decimal(38,0)")
    return F.call_function("div", above, (exact(left) * exact(right)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, text_col="text", lang_col="lang", least=LEAST, top=TOP, shadow=SHADOW) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language.

    Null texts are empty, a null language is 'und'. Words are runs of other than space, tab and the signs that end a piece;
    a phrase lies within a piece. A language without phrases of ``least`` occurrences has no row; repeated rows count as
    often as they occur. Columns besides the two named are not read. No rows give no rows.
    """
    words, seed = checked_words(docs, text_col, lang_col)
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = settle(words.filter(F.col("n") >= least), "frequent")
    count = lambda size, shorter: settle(count_phrases(docs, text_col, lang_col, seed, size, shorter, least), f"phrases{size}")
    pairs = count(2, bitmap(frequent, ["id"]))
    triples = count(3, bitmap(pairs, ["w1", "w2"]))
    one = lambda side: frequent.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("word").alias(f"word_{side}"))
    two = lambda x, y: pairs.select(F.col("w1").alias(x), F.col("w2").alias(y), F.col("n").alias(f"n_{x}{y}"))
    # A pair that lies in a triple with half of its occurrences goes.
    inside = (triples.select("n", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("pair"))
              .groupBy("pair").agg(F.max("n").alias("longer")).select("pair.w1", "pair.w2", "longer"))
    kept = (pairs.join(inside, ["w1", "w2"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < shadow * F.col("n")))
            .join(frequent.select(F.col("id").alias("w1"), "lang", F.col("n").alias("l"), F.col("word").alias("word_w1")), "w1").join(one("w2"), "w2"))
    scored = kept.select("lang", F.concat_ws(" ", "word_w1", "word_w2").alias("phrase"), F.col("n").alias("a"), "l", F.col("n_w2").alias("r"),
                         cut_score(F.col("n"), F.col("l"), F.col("n_w2")).alias("score"))
    three = (triples.join(two("w1", "w2"), ["w1", "w2"]).join(two("w2", "w3"), ["w2", "w3"])
             .join(frequent.select(F.col("id").alias("w1"), "lang", F.col("n").alias("n_w1"), F.col("word").alias("word_w1")), "w1")
             .join(one("w2"), "w2").join(one("w3"), "w3"))
    three = three.withColumns({"s1": cut_score(F.col("n"), F.col("n_w1"), F.col("n_w2w3")), "s2": cut_score(F.col("n"), F.col("n_w1w2"), F.col("n_w3"))})
    early = F.col("s1") <= F.col("s2")
    scored = scored.unionByName(three.select(
        "lang", F.concat_ws(" ", "word_w1", "word_w2", "word_w3").alias("phrase"), F.col("n").alias("a"),
        F.when(early, F.col("n_w1")).otherwise(F.col("n_w1w2")).alias("l"), F.when(early, F.col("n_w2w3")).otherwise(F.col("n_w3")).alias("r"),
        F.least("s1", "s2").alias("score")))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)  # cut per task before the shuffle too
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
