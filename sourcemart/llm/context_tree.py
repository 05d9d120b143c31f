"""Language-model scores of texts by context-tree weighting over bytes.

A byte is eight binary decisions, each in the context of the bytes before it. For every context up to DEPTH bytes and every
decision a Krichevsky-Trofimov estimate counts the two outcomes; the weighted probability of a context is half its own
estimate and half the product over its longer contexts, so all depths are mixed by how well they code the training texts.
Estimates depend on counts alone, in any order, so Spark counts all byte grams of the corpus and the tree is weighted once.

Every context of the training texts is a node, however rare. Grams are dealt out by the bytes nearest to the coded one, so a
task holds whole subtrees and weighs them block by block; only contexts of up to SPLIT bytes, whose number is bounded by
their length, are weighted on the driver. What comes of it is the log10 probability of every gram that any text holds. Texts
are scored where they are read: the most frequent grams are looked up in a broadcast table, all others by a join.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from sourcemart.llm.common import Tally, bytes_of, runs, settle, smaller, word_hashes

DEPTH = 5
SPLIT = 2                # contexts of up to this many bytes are weighted on the driver (at most 256 ** SPLIT), longer ones in tasks
BLOCK = 1 << 16          # grams that a task weighs together; the subtree of one context of SPLIT + 1 bytes stays whole
COMMON_GRAMS = 1 << 20   # grams looked up in a broadcast table, others by a join
WORD_SHARE = 2.0 ** -21  # words at least this frequent are looked up in a broadcast table (at most 1/WORD_SHARE), others by a join
START, END = 0xFE, 0xFF  # bytes that no UTF-8 text holds: before and after every text
END_WORD = -1            # key of the end token among the words' hashes


# ---- counts ---------------------------------------------------------------------------------------------------------

def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(padded bytes of the texts, places of the bytes that are coded): each text and its end, after ``depth`` starts."""
    pad, end = bytes([START]) * depth, bytes([END])
    data = np.frombuffer(b"".join([pad + t + end for t in texts]), dtype=np.uint8)
    return data, np.flatnonzero(data != START)


def gram_codes(texts: list[bytes], depth: int) -> np.ndarray:
    """Each coded byte below the ``depth`` bytes before it, the nearest one lowest."""
    data, at = grams(texts, depth)
    code = np.zeros(len(at), dtype=np.uint64)
    for k in range(depth, -1, -1):
        code = (code << np.uint64(8)) | data[at - k]
    return code


def gram_counts(docs: DataFrame, text_col: str, depth: int, learn: Column | None = None) -> DataFrame:
    """(code, n, seen): how often each byte follows each ``depth`` bytes in the texts that are learned from, and in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = Tally(), Tally()  # of texts that are scored only, and learned from

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            for learned, tally in enumerate(tallies):
                for batch in tally.batches(last, ["code", "seen"]):
                    n = batch.column(1) if learned else pa.array(np.zeros(batch.num_rows, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([batch.column(0), n, batch.column(1)], names=["code", "n", "seen"])

        for batch in smaller(batches):
            texts, learned = bytes_of(batch.column(0)), batch.column(1).to_pylist()
            for of in (False, True):
                mine = [t for t, l in zip(texts, learned) if l == of]
                for a, b in runs(mine):
                    tallies[of].add(*np.unique(gram_codes(mine[a:b], depth), return_counts=True))
            yield from out(False)
        yield from out(True)

    learned = F.lit(True) if learn is None else F.coalesce(learn.cast("boolean"), F.lit(False))
    counted = docs.select(F.col(text_col), learned.alias("_learned")).mapInArrow(count, "code long, n long, seen long")
    return counted.groupBy("code").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n): hashes of words with their counts; one end token per text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, ends = Tally(), 0
        for batch in smaller(batches):
            texts = bytes_of(batch.column(0))
            ends += len(texts)
            for a, b in runs(texts):
                tally.add(*np.unique(word_hashes(texts[a:b])[0], return_counts=True))
            yield from tally.batches(False, ["word", "n"])
        yield from tally.batches(True, ["word", "n"])
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END_WORD]), pa.array([ends])], names=["word", "n"])

    return docs.select(text_col).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---- the tree, whole -----------------------------------------------------------------------------------------------
# For few contexts: all decisions of all contexts side by side.

def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series at x + 8."""
    y, product = x + 8, np.ones_like(x)
    for k in range(8):
        product = product * (x + k)
    inverse = 1 / (y * y)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - np.log(product)


def decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones of the 255 binary decisions of a byte, per row of 256 byte counts."""
    zeros, ones = np.empty((len(counts), 255)), np.empty((len(counts), 255))
    level = counts.astype(np.float64)
    for bits in range(7, -1, -1):
        first, size = (1 << bits) - 1, 1 << bits
        zeros[:, first:first + size], ones[:, first:first + size] = level[:, 0::2], level[:, 1::2]
        level = level[:, 0::2] + level[:, 1::2]
    return zeros, ones


def estimate(counts: np.ndarray, rows: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Krichevsky-Trofimov, per row of byte counts and decision: log probability of the counts, probability of a one next."""
    block, one = np.empty((len(counts), 255)), np.empty((len(counts), 255), dtype=np.float32)
    for a in range(0, len(counts), rows):
        zeros, ones = decisions(counts[a:a + rows])
        n = zeros + ones
        block[a:a + rows] = log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(n + 1)
        one[a:a + rows] = (ones + 0.5) / (n + 1)
    return block, one


@dataclass
class Tree:
    """log10 probabilities per node and byte, and what is needed to walk from a node to a longer context.

    Node 0 is no node, node 1 the empty context. ``links`` has (node, byte before it, longer node).
    """

    table: np.ndarray
    links: np.ndarray
    depth: int

    def children(self) -> np.ndarray:
        out = np.zeros((len(self.table), 256), dtype=np.int32)
        out[self.links[:, 0], self.links[:, 1]] = self.links[:, 2]
        return out.ravel()


def byte_probabilities(ones: np.ndarray) -> np.ndarray:
    """log10 probabilities of the 256 bytes from the probabilities of a one at each decision."""
    out = np.zeros((len(ones), 1))
    for bits in range(8):
        first, size = (1 << bits) - 1, 1 << bits
        p = ones[:, first:first + size].astype(np.float64)
        wider = np.empty((len(ones), 2 * size))
        wider[:, 0::2], wider[:, 1::2] = out + np.log10(1 - p), out + np.log10(p)
        out = wider
    return out.astype(np.float32)


def weigh(levels: list[tuple[np.ndarray, np.ndarray]]) -> Tree:
    """``levels[d]``: sorted contexts of d bytes and their byte counts (n x 256). Contexts' shorter forms are present."""
    depth = len(levels) - 1
    parent, byte = [None] * (depth + 1), [None] * (depth + 1)
    for d in range(1, depth + 1):
        codes = levels[d][0]
        parent[d] = np.searchsorted(levels[d - 1][0], codes & np.uint64((1 << 8 * (d - 1)) - 1))
        byte[d] = (codes >> np.uint64(8 * (d - 1))).astype(np.int64)
    # From the longest contexts down: weighted probabilities, and how much a node's own estimate counts.
    own, rest, leaf, weighted = [None] * (depth + 1), [None] * (depth + 1), [None] * (depth + 1), None
    for d in range(depth, -1, -1):
        counts = levels[d][1]
        block, own[d] = estimate(counts)
        leaf[d], total = np.ones(block.shape, dtype=np.float32), block
        if d < depth and len(levels[d + 1][0]):
            longer, left = np.zeros_like(block), counts.astype(np.float64).copy()
            np.add.at(longer, parent[d + 1], weighted)
            np.subtract.at(left, parent[d + 1], levels[d + 1][1])
            other, rest[d] = estimate(left)
            longer += other
            inner = np.unique(parent[d + 1])
            both = np.logaddexp(block[inner], longer[inner])
            leaf[d][inner] = np.exp(np.clip(block[inner] - both, -700, 0))
            total = block.copy()
            total[inner] = both - np.log(2)
        weighted = total
    # From the empty context up: what shorter contexts have said, and the weight that is left.
    tables, links, base = [np.zeros((1, 256), dtype=np.float32)], [], 1
    said, left = np.zeros_like(own[0]), np.ones_like(own[0])
    for d in range(depth + 1):
        if d:
            said, left = said[parent[d]], left[parent[d]]
            links.append(np.stack([base + parent[d], byte[d], base + len(levels[d - 1][0]) + np.arange(len(byte[d]))], axis=1))
            base += len(levels[d - 1][0])
        said = said + left * leaf[d] * own[d]
        left = left * (1 - leaf[d])
        final = said + (left * rest[d] if rest[d] is not None else 0)
        tables.append(byte_probabilities(np.clip(final, 1e-7, 1 - 1e-7)))
    links = np.concatenate(links) if links else np.empty((0, 3), dtype=np.int64)
    return Tree(np.concatenate(tables), links.astype(np.int64), depth)


def text_scores(tree: Tree, children: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """log10 probability of each text, its end included."""
    data, at = grams(texts, tree.depth)
    node = np.ones(len(at), dtype=np.int32)
    best = node
    for k in range(1, tree.depth + 1):
        node = np.take(children, (node << 8) | data[at - k])
        best = np.where(node > 0, node, best)
    values = np.take(tree.table.ravel(), best.astype(np.int64) * 256 + data[at]).astype(np.float64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.add.reduceat(values, np.concatenate([[0], ends[:-1]]))


# ---- the tree, in parts ---------------------------------------------------------------------------------------------
# Decisions that occur, by sorted keys: context << 8 | decision. Those without counts in training give even odds.

def shorter(keys: np.ndarray, depth: int) -> np.ndarray:
    """The decisions in contexts one byte shorter than ``depth``."""
    return ((keys >> 8) & ((1 << 8 * (depth - 1)) - 1)) << 8 | keys & 255


def code_decisions(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the decisions of all codes, the place of each code's eight among them, and their outcomes."""
    bit = np.arange(8)
    byte = (code & 255)[:, None]
    keys, at = np.unique((code >> 8)[:, None] << 8 | ((1 << bit) - 1 + (byte >> (8 - bit))), return_inverse=True)
    return keys, at.reshape(-1, 8), (byte >> (7 - bit)) & 1


def climb(keys, zeros, ones, longer, depth: int, to: int):
    """Weighs the contexts of ``depth`` bytes, then shorter ones up to ``to`` bytes. ``longer``: log probability by contexts
    longer than ``depth``; none if there are none. Returns per length (place in the next shorter, weight of the own estimate,
    own estimate), and of the shortest keys, zeros, ones and weighted log probability."""
    steps = []
    while True:
        n = zeros + ones
        block = log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(n + 1.0)
        own, leaf, weighted = (ones + 0.5) / (n + 1), np.ones(len(keys)), block
        if longer is not None:
            both = np.logaddexp(block, longer)
            leaf, weighted = np.exp(np.clip(block - both, -700, 0)), both - np.log(2)
        if depth == to:
            return steps + [(None, leaf, own)], keys, zeros, ones, weighted
        keys, up = np.unique(shorter(keys, depth), return_inverse=True)
        steps.append((up, leaf, own))
        zeros, ones, longer = (np.bincount(up, x, len(keys)) for x in (zeros, ones, weighted))
        depth -= 1


def descend(steps, said: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From what contexts shorter than the shortest have said, and the weight they left, to the same after the longest."""
    for up, leaf, own in reversed(steps):
        if up is not None:
            said, left = said[up], left[up]
        said, left = said + left * leaf * own, left * (1 - leaf)
    return said, left


def blocks(batches: Iterator[pa.RecordBatch], group: int) -> Iterator[list[np.ndarray]]:
    """Columns of rows (code, ...), sorted by the context's last ``group`` bytes, in blocks that part none of these."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        size += batch.num_rows
        if size >= BLOCK:
            columns = [np.concatenate(c) for c in zip(*held)]
            suffix = (columns[0] >> 8) & ((1 << 8 * group) - 1)
            cut = int(np.flatnonzero(suffix != suffix[-1])[-1]) + 1 if suffix[0] != suffix[-1] else 0
            if cut:
                yield [c[:cut] for c in columns]
            held, size = [[c[cut:] for c in columns]], size - cut
    if size:
        yield [np.concatenate(c) for c in zip(*held)]


def gram_scores(docs: DataFrame, text_col="text", learn: Column | None = None, depth=DEPTH, split=SPLIT) -> DataFrame:
    """(code, seen, value): how often a gram stands in ``docs``, and the log10 probability of its last byte by the tree of all
    texts for which ``learn`` holds; without any, every byte is equally likely. ``depth``: up to 6."""
    split = min(split, depth - 1)
    group = split + 1
    counts = settle(gram_counts(docs, text_col, depth, learn), "grams")
    dealt = (counts.withColumn("suffix", F.expr(f"shiftright(code, 8) & {(1 << 8 * group) - 1}L"))
             .repartition("suffix").sortWithinPartitions("suffix").drop("suffix"))

    def subtrees(code: np.ndarray, n: np.ndarray):
        keys, at, bit = code_decisions(code)
        zeros, ones = (np.bincount(at.ravel(), (n[:, None] * (bit == x)).ravel(), len(keys)) for x in (0, 1))
        return at, bit, climb(keys, zeros, ones, None, depth, group)

    def upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, n, _ in blocks(batches, group):
            _, _, (_, keys, zeros, ones, weighted) = subtrees(code, n)
            keys, up = np.unique(shorter(keys, group), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys)] + [pa.array(np.bincount(up, x, len(keys))) for x in (zeros, ones, weighted)],
                                             names=["key", "zeros", "ones", "longer"])

    sums = dealt.mapInArrow(upper, "key long, zeros double, ones double, longer double").groupBy("key").agg(
        *[F.sum(c).alias(c) for c in ("zeros", "ones", "longer")])
    top = sums.toArrow()  # at most 255 decisions of 256 ** split contexts
    order = np.argsort(top["key"].to_numpy())
    keys, zeros, ones, longer = (top[c].to_numpy()[order] for c in ("key", "zeros", "ones", "longer"))
    steps, first = climb(keys, zeros, ones, longer, split, 0)[:2]
    shared = docs.sparkSession.sparkContext.broadcast((keys, *descend(steps, np.zeros(len(first)), np.ones(len(first)))))

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, said, left = shared.value
        for code, n, seen in blocks(batches, group):
            at, bit, (steps, keys, *_) = subtrees(code, n)
            place = np.searchsorted(known, shorter(keys, group))
            one = np.clip(descend(steps, said[place], left[place])[0], 1e-7, 1 - 1e-7)[at]
            value = np.log10(np.where(bit == 1, one, 1 - one)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(seen), pa.array(value)], names=["code", "seen", "value"])

    return settle(dealt.mapInArrow(values, "code long, seen long, value double"), "values")


def common_grams(scored: DataFrame, most: int) -> Column:
    """Which rows of ``gram_scores`` are the most frequent ones: as many steps of their counts as hold at most ``most``."""
    step = F.floor(F.log2("seen") * 16)
    least = 1 << 20
    for row in scored.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # 16 steps for each doubling of a count
        most -= row["count"]
        if most < 0:
            break
        least = row.step
    return step >= least


# ---- scores ---------------------------------------------------------------------------------------------------------

def score_texts(docs: DataFrame, learn: Column | None = None, id_col="doc_id", text_col="text", carry: dict[str, Column] | None = None,
                depth=DEPTH, word_share=WORD_SHARE, common_most=COMMON_GRAMS) -> DataFrame:
    """One row per row of ``docs``: id, (carry), n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    The tree (of every context) and the word counts are learned from the rows for which ``learn`` holds (all by default). A null text is empty:
    its end alone is scored. Repeated rows are scored, and learned from, as often as they occur. Without training texts
    every byte has the same probability and the base counts one more than no tokens. Other columns are not read.
    """
    spark = docs.sparkSession
    training = docs.filter(learn) if learn is not None else docs
    values = gram_scores(docs, text_col, learn, depth)
    is_common = common_grams(values, common_most)
    table = values.filter(is_common).select("code", "value").toArrow()  # at most `common_most` rows
    by_code = np.argsort(table["code"].to_numpy())
    words = settle(word_counts(training, text_col), "words")
    total, kinds_of_word = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    common = words.filter(F.col("n") >= max(1.0, total * word_share)).toArrow()  # at most 1/word_share rows
    order = np.argsort(common["word"].to_numpy().view(np.uint64))
    shared = spark.sparkContext.broadcast((table["code"].to_numpy().view(np.uint64)[by_code], table["value"].to_numpy()[by_code],
                                            common["word"].to_numpy().view(np.uint64)[order], common["n"].to_numpy()[order]))
    carry = carry or {}
    extra = len(carry)
    columns = docs.select(F.col(id_col), F.col(text_col).alias("_text"), *[c.alias(n) for n, c in carry.items()])
    kinds, names = dict(columns.dtypes), [id_col, *carry]
    own = ["row", "gram", "word", "n_tokens", "n_known", "gained", "score", "n_bytes"]
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", row long, gram boolean, word long, n_tokens long, n_known long, gained double, score double, n_bytes long"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, chances, known, counts = shared.value
        gain = np.log10(counts + 1.0)
        end = np.searchsorted(known, np.uint64(END_WORD & (2 ** 64 - 1)))
        end_known = end < len(known) and known[end] == np.uint64(END_WORD & (2 ** 64 - 1))
        row = TaskContext.get().partitionId() << 40
        for batch in smaller(batches):
            texts = bytes_of(batch.column(1))
            n_tokens, n_known, gained, scores = [], [], [], []
            rare = {False: ([], []), True: ([], [])}  # keys and rows of words, of grams
            for a, b in runs(texts):
                hashes, first, _ = word_hashes(texts[a:b])
                owner = np.repeat(np.arange(b - a), np.diff(first))
                at = np.searchsorted(known, hashes)
                at[at == len(known)] = 0
                hit = known[at] == hashes if len(known) else np.zeros(len(hashes), dtype=bool)
                n_tokens.append(np.diff(first) + 1)
                n_known.append(np.bincount(owner[hit], minlength=b - a) + int(end_known))
                gained.append(np.bincount(owner[hit], weights=gain[at[hit]], minlength=b - a) + (gain[end] if end_known else 0.0))
                rare[False][0].append(hashes[~hit].view(np.int64))
                rare[False][1].append(owner[~hit] + (row + a))
                held, again = np.unique(gram_codes(texts[a:b], depth), return_inverse=True)
                at = np.searchsorted(codes, held)
                at[at == len(codes)] = 0
                hit = codes[at] == held if len(codes) else np.zeros(len(held), dtype=bool)
                chance = np.where(hit, chances[at], 0.0) if len(codes) else np.zeros(len(held))
                ends = np.cumsum([len(t) + 1 for t in texts[a:b]])
                scores.append(np.add.reduceat(chance[again], np.concatenate([[0], ends[:-1]])))
                if not hit.all():
                    missed = np.flatnonzero(~hit[again])
                    rare[True][0].append(held[again[missed]].view(np.int64))
                    rare[True][1].append(np.searchsorted(ends, missed, side="right") + (row + a))
            rows = np.arange(row, row + len(texts), dtype=np.int64)
            row += len(texts)
            if not texts:
                continue
            kept = [batch.column(0)] + [batch.column(2 + k) for k in range(extra)]
            joined = lambda parts: pa.array(np.concatenate(parts))
            # A row's own key matches no word, so that it isn't dealt out with others like it.
            own_key = (rows * 2862933555777941757 + 3037000493).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                kept + [pa.array(rows), pa.array(np.zeros(len(rows), dtype=bool)), pa.array(own_key), joined(n_tokens).cast(pa.int64()), joined(n_known).cast(pa.int64()), joined(gained),
                        joined(scores), pa.array([len(t) + 1 for t in texts], pa.int64())], names=names + own)
            for gram, (keys, owners) in rare.items():
                if not keys:
                    continue
                keys, owners = np.concatenate(keys), np.concatenate(owners)
                for a in range(0, len(keys), 1 << 18):
                    part = keys[a:a + (1 << 18)]
                    empty = [pa.nulls(len(part), c.type) for c in kept]
                    yield pa.RecordBatch.from_arrays(
                        empty + [pa.array(owners[a:a + (1 << 18)]), pa.array(np.full(len(part), gram)), pa.array(part),
                                 pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.float64()),
                                 pa.nulls(len(part), pa.float64()), pa.nulls(len(part), pa.int64())], names=names + own)

    rare_words = words.filter(F.col("n") < max(1.0, total * word_share)).select(F.lit(False).alias("gram"), "word", F.log10(F.col("n") + 1).alias("_gain"))
    rare_grams = values.filter(~is_common).select(F.lit(True).alias("gram"), F.col("code").alias("word"), F.col("value").alias("_gain"))
    scored = columns.mapInArrow(score, schema).join(rare_words.union(rare_grams), ["gram", "word"], "left").filter(
        F.col("n_tokens").isNotNull() | F.col("_gain").isNotNull())
    of_text, of_gram = F.col("n_tokens").isNotNull(), F.col("gram")
    scale = float(np.log10(float(total + kinds_of_word + 1)))
    sums = scored.groupBy("row").agg(
        *[F.max(n).alias(n) for n in names], F.max("n_tokens").alias("n_tokens"),
        F.sum(F.when(of_text, F.col("n_known")).otherwise(F.when(of_gram, 0).otherwise(1))).cast("long").alias("n_known"),
        F.sum(F.when(of_text, F.col("gained")).when(~of_gram, F.col("_gain"))).alias("gained"),
        F.sum(F.when(of_text, F.col("score")).when(of_gram, F.col("_gain"))).alias("score"), F.max("n_bytes").alias("n_bytes"))
    return sums.select(*names, "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"),
                       (F.col("gained") - F.col("n_tokens") * scale).alias("base_score"), "score",
                       (-F.col("score") / F.col("n_bytes") * float(np.log2(10))).alias("bits_per_byte"))
