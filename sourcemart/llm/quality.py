"""Quality of texts by nearest-neighbour voting over latent-semantic vectors.

Terms are trigrams of character classes and repetitions of words, so any language is judged by form. A bounded sample of
labelled rows gives term weights, the latent directions (by their eigenvectors) and the labelled vectors. These are
broadcast; each block of documents is multiplied with all of them, exactly, and the nearest vote by their cosine.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sourcemart.llm.common import bytes_of, hash_share, runs, smaller, word_hashes

LABELLED = 4096     # rows the classifier is fitted on, at most
DIRECTIONS = 48
NEIGHBOURS = 25
SHARPNESS = 8.0     # a neighbour's vote is its cosine to this power
CUTOFF = 0.3
BLOCK = 512

CLASSES = 11
_KIND = np.full(256, 10, dtype=np.int64)     # other punctuation
_KIND[list(b" ")] = 0
_KIND[list(b"\t\n\x0b\x0c\r")] = 1
_KIND[97:123] = 2
_KIND[128:] = 2
_KIND[65:91] = 3
_KIND[48:58] = 4
_KIND[list(b".")] = 5
_KIND[list(b",")] = 6
_KIND[list(b"!?")] = 7
_KIND[list(b"|")] = 8
_KIND[list(b"#*$%&<>")] = 9
DISTANCES = (1, 2, 3, 4, 6, 8)
TERMS = CLASSES ** 3 + 2 * (len(DISTANCES) + 1)


def terms(texts: list[bytes]) -> np.ndarray:
    """Term counts per text: character-class trigrams; words by the distance to their last occurrence nearby; the same for
    pairs of words."""
    n = len(texts)
    kinds = _KIND[np.frombuffer(b"  ".join(texts) + b"  ", dtype=np.uint8)]
    code = kinds[:-2] * (CLASSES * CLASSES) + kinds[1:-1] * CLASSES + kinds[2:]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    inside = np.ones(int(sizes.sum()) + 2 * n, dtype=bool)  # not the trigrams that begin between two texts
    ends = np.cumsum(sizes + 2)
    inside[ends - 1] = inside[ends - 2] = False
    code = code[inside[:len(code)]]
    cubes = np.bincount(np.repeat(np.arange(n), sizes) * CLASSES ** 3 + code, minlength=n * CLASSES ** 3).reshape(n, CLASSES ** 3)
    cubes[:, 0] = 0
    hashes, first, _ = word_hashes(texts, lower=False)
    owner = np.repeat(np.arange(n), np.diff(first))
    wide = len(DISTANCES) + 1
    near = np.zeros((n, 2 * wide))
    for k, series in enumerate((hashes, hashes[:-1] * np.uint64(3) + hashes[1:])):
        place = np.full(len(series), wide - 1)
        for d in reversed(range(len(DISTANCES))):
            gap = DISTANCES[d]
            if len(series) > gap:
                same = (series[gap:] == series[:-gap]) & (owner[gap:len(series)] == owner[:len(series) - gap])
                place[gap:][same] = d
        whole = owner[:len(series)] == owner[len(owner) - len(series):]  # not a pair of two texts' words
        at = (owner[:len(series)] * wide + place)[whole]
        near[:, k * wide:(k + 1) * wide] = np.bincount(at, minlength=n * wide).reshape(n, wide)
    return np.hstack([cubes, near]).astype(np.float32)


def weighted(counts: np.ndarray) -> np.ndarray:
    """Square roots of relative frequencies, apart for trigrams and repetitions."""
    parts = []
    for part in (counts[:, :CLASSES ** 3], counts[:, CLASSES ** 3:]):
        parts.append(np.sqrt(part / np.maximum(part.sum(axis=1, keepdims=True), 1)))
    return np.hstack(parts)


@dataclass
class Voters:
    """What is broadcast: at most LABELLED vectors and TERMS x DIRECTIONS weights."""

    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def parts(self) -> tuple:
        return self.project, self.vectors, self.labels

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray, directions=DIRECTIONS) -> "Voters":
        x = weighted(counts)
        held = (x > 0).sum(axis=0)
        weight = np.where(held > 0, np.log((1 + len(x)) / (1 + held)) + 1, 0).astype(np.float32)
        x = unit(x * weight)
        _, axes = np.linalg.eigh(x.T.astype(np.float64) @ x)
        project = (weight[:, None] * axes[:, ::-1][:, :directions]).astype(np.float32)
        return cls(project, unit(weighted(counts) @ project), labels.astype(np.float32))

    def score(self, counts: np.ndarray, neighbours=NEIGHBOURS, sharpness=SHARPNESS) -> np.ndarray:
        prior = float(self.labels.mean())
        out = np.empty(len(counts))
        for a in range(0, len(counts), BLOCK):
            near = unit(weighted(counts[a:a + BLOCK]) @ self.project) @ self.vectors.T
            if near.shape[1] > neighbours:  # all that are as near as the last neighbour vote
                last = np.partition(near, -neighbours, axis=1)[:, -neighbours][:, None]
                near = np.where(near >= last, near, 0)
            votes = np.maximum(near, 0) ** sharpness
            total = votes.sum(axis=1)
            out[a:a + BLOCK] = np.where(total > 0, votes @ self.labels / np.maximum(total, 1e-30), prior)
        return np.clip(out, 0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def labelled_counts(docs: DataFrame, labels: DataFrame, learn: Column | None, id_col: str, text_col: str, label_col: str, most: int):
    """Term counts and mean labels of at most ``most`` labelled ids, drawn by the hash of the id; of an id with several texts
    the first in order counts."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = (known.filter(learn) if learn is not None else known).groupBy(F.col(id_col).alias("_id")).agg(F.avg(F.col(label_col)).alias("_label"))
    known = known.withColumn("_share", hash_share(F.lit(11), "_id"))
    n = known.count()
    if not n:
        return None
    drawn = known.filter(F.col("_share") < min(1.0, 1.25 * most / n)).orderBy("_share", "_id").limit(most)
    found = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text")).join(F.broadcast(drawn), F.col("_key") == F.col("_id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in smaller(batches):
            texts, out = bytes_of(batch.column(1)), []
            for a, b in runs(texts):
                out += [row.tobytes() for row in terms(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["label", "terms"])

    once = found.groupBy("_id", "_label").agg(F.min("_text").alias("_text"))  # ids may be repeated in docs
    rows = once.select("_label", "_text").mapInArrow(count, "label double, terms binary").collect()
    rows = sorted((r["label"], bytes(r["terms"])) for r in rows)
    if not rows:
        return None
    return np.array([np.frombuffer(t, dtype=np.float32) for _, t in rows]), np.array([v for v, _ in rows])


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col="doc_id", text_col="text",
                  label_col="quality", carry: dict[str, Column] | None = None, labelled=LABELLED, cutoff=CUTOFF) -> DataFrame:
    """One row per row of ``docs``: id, score in [0, 1], predicted 0 or 1 (and the columns of ``carry``).

    Learns from rows of ``labels`` for which ``learn`` holds; several labels of an id count by their mean, null labels not
    at all. Empty and null texts are neighbours of none and get the mean label, as does every text where no label is known
    (0.5 without any). Equal texts get equal scores. Columns besides those named are not read.
    """
    spark = docs.sparkSession
    found = labelled_counts(docs, labels, learn, id_col, text_col, label_col, labelled)
    shared = spark.sparkContext.broadcast(Voters.fit(*found).parts() if found else None)  # plain arrays
    carry = carry or {}
    extra = len(carry)
    columns = docs.select(F.col(id_col), F.col(text_col).alias("_text"), *[c.alias(n) for n, c in carry.items()])
    kinds, names = dict(columns.dtypes), [id_col, *carry]
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", score double, predicted int"

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(*shared.value) if shared.value else None
        for batch in smaller(batches):
            texts = bytes_of(batch.column(1))
            scores = np.full(len(texts), 0.5)
            for a, b in runs(texts) if voters else ():
                scores[a:b] = voters.score(terms(texts[a:b]))
            kept = [batch.column(0)] + [batch.column(2 + k) for k in range(extra)]
            yield pa.RecordBatch.from_arrays(
                kept + [pa.array(scores), pa.array((scores >= cutoff).astype(np.int32))], names=names + ["score", "predicted"])

    return columns.mapInArrow(vote, schema)


def keep_good(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns."""
    carried = {f"_c{i}": F.col(c) for i, c in enumerate(docs.columns)}
    scored = score_quality(docs, labels, id_col=id_col, text_col=text_col, carry=carried, **options)
    return scored.filter("predicted = 1").select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
