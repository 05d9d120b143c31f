"""Language of a text by hierarchical discrimination: first the family, then one-versus-one linear SVMs within it."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sourcemart.llm.common import LOWER, bytes_of, runs, settle, smaller
from sourcemart.llm.svm import OneVersusOne

BUCKETS_LOG2 = 11
PER_LANGUAGE = 500   # labelled texts the machines are fitted on, per language
MOST_LABELLED = 6000  # and in all
MOST_LANGUAGES = 512  # the most frequent ones are learned
FAMILY_SIZE = 24      # languages without a family form families of this size, by their codes
STEEPNESS = 2.0
UNKNOWN = "und"

# ISO 639-1 codes by language family.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl no nb nn sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "bn gu hi mr ne pa si ur",
    "semitic": "am ar he mt",
    "turkic": "az kk ky tr tt ug uz",
    "uralic": "et fi hu",
    "austronesian": "id jv mg ms su tl",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def letter_trigrams(texts: list[bytes], log2: int = BUCKETS_LOG2) -> np.ndarray:
    """Per text the square roots of the counts of hashed trigrams of letters and word borders, of length one."""
    blob = np.frombuffer(b"  " + b"  ".join(texts) + b"  ", dtype=np.uint8)
    low = LOWER[blob]
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    low = np.where(letter, low, np.uint8(32)).astype(np.uint32)
    code = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
    bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - log2)
    keep = letter[1:-1]  # grams around a letter
    sizes = np.array([len(t) + 2 for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(bucket)]
    size = 1 << log2
    at = owner[keep[: len(owner)]] * size + bucket[: len(owner)][keep[: len(owner)]]
    counts = np.sqrt(np.bincount(at, minlength=len(texts) * size).reshape(len(texts), size)).astype(np.float32)
    return counts / np.maximum(np.sqrt((counts ** 2).sum(axis=1, keepdims=True)), 1e-9)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def families_of(languages: list[str]) -> dict[str, str]:
    """The family of each language. Unlisted ones are a family each while they are few; more are put together in the order
    of their codes, so that duels stay at most about (languages / FAMILY_SIZE)^2 / 2 + languages * FAMILY_SIZE / 2."""
    rest = sorted({code for code in languages if code.lower() not in FAMILY_OF})
    size = 1 if len(rest) <= FAMILY_SIZE else FAMILY_SIZE
    found = {code: f"rest {i // size}" for i, code in enumerate(rest)}
    return {code: FAMILY_OF.get(code.lower()) or found[code] for code in languages}


class Hierarchy:
    """A machine between families and one within each family of two or more languages."""

    def __init__(self, x: np.ndarray, languages: list[str]):
        x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
        family_of = families_of(languages)
        families = [family_of[code] for code in languages]
        self.family = OneVersusOne.fit(x, families)
        self.within = {}
        for name in self.family.names:
            at = [i for i, f in enumerate(families) if f == name]
            self.within[name] = OneVersusOne.fit(x[at], [languages[i] for i in at])

    def parts(self) -> tuple:
        """Plain names and arrays, for a broadcast."""
        plain = lambda m: (m.names, m.pairs, m.weights)
        return plain(self.family), {k: plain(m) for k, m in self.within.items()}

    @classmethod
    def of(cls, parts: tuple) -> "Hierarchy":
        made = cls.__new__(cls)
        made.family, made.within = OneVersusOne(*parts[0]), {k: OneVersusOne(*m) for k, m in parts[1].items()}
        return made

    def predict(self, x: np.ndarray, steepness: float = STEEPNESS) -> tuple[list[str], np.ndarray]:
        x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
        family, margin = self.family.predict(x)
        language = np.empty(len(x), dtype=object)
        for k, name in enumerate(self.family.names):
            at = np.flatnonzero(family == k)
            if len(at):
                machine = self.within[name]
                best, least = machine.predict(x[at])
                language[at] = np.array(machine.names, dtype=object)[best]
                margin[at] = np.minimum(margin[at], least)
        return list(language), 1 / (1 + np.exp(-steepness * np.clip(margin, -30, 30)))


def _vectors(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray]]:
    for a, b in runs(texts):
        yield a, b, letter_trigrams(texts[a:b])


def labelled_vectors(docs: DataFrame, text_col: str, lang_col: str, per_language: int, most: int) -> list[tuple[str, bytes]]:
    """(language, vector) of at most ``most`` distinct labelled texts: per language those of the smallest hashes, the same in
    every run."""
    known = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit(17), F.col(text_col)).alias("key"))
    known = known.filter("lang is not null and text is not null")
    kinds = settle(known.select("lang", "key").distinct(), "labelled")
    counts = {r["lang"]: r["n"] for r in kinds.groupBy("lang").agg(F.count("*").alias("n"))
              .orderBy(F.desc("n"), "lang").limit(min(most, MOST_LANGUAGES)).collect()}
    if not counts:
        return []
    each = max(1, min(per_language, most // len(counts)))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("key"))  # cut per task before the shuffle too
    drawn = kinds.filter(F.col("lang").isin(list(counts))).withColumn("place", first).filter(F.col("place") <= each).select("lang", "key")
    sample = known.join(F.broadcast(drawn), ["lang", "key"]).groupBy("lang", "key").agg(F.min("text").alias("text"))  # at most ``most`` rows

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in smaller(batches):
            texts, out = bytes_of(batch.column(1)), []
            for a, b, x in _vectors(texts):
                out += [row.astype(np.float16).tobytes() for row in x]
            good = pa.array([has_letter(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["lang", "vector"]).filter(good)

    found = sample.select("lang", "text").mapInArrow(vectors, "lang string, vector binary")
    return sorted((r["lang"], bytes(r["vector"])) for r in found.collect())


def identify(docs: DataFrame, learn: Column | None = None, id_col="doc_id", text_col="text", lang_col="lang",
             carry: dict[str, Column] | None = None, per_language=PER_LANGUAGE, most=MOST_LABELLED) -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score (and the columns of ``carry``).

    Machines are fitted on a bounded sample of the distinct texts of rows where ``learn`` holds (all by default) and the
    language is known, of at most MOST_LANGUAGES languages, the most frequent ones.
    A text that is null or has no letter is ``und`` with score 0; without any labelled row all are. With one known language
    every other text is that one, with score 1. Texts that are equal get equal results; other columns are not read.
    """
    spark = docs.sparkSession
    sample = labelled_vectors(docs.filter(learn) if learn is not None else docs, text_col, lang_col, per_language, most)
    model = None
    if sample:
        x = np.array([np.frombuffer(v, dtype=np.float16) for _, v in sample], dtype=np.float32)
        model = Hierarchy(x, [lang for lang, _ in sample])
    shared = spark.sparkContext.broadcast(model.parts() if model else None)  # bounded: one weight vector per pair of sampled languages
    carry = carry or {}
    extra = len(carry)
    columns = docs.select(F.col(id_col), F.col(text_col).alias("_text"), *[c.alias(name) for name, c in carry.items()])
    kinds = dict(columns.dtypes)
    names = [id_col, *carry]
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", lang_pred string, score double"

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hierarchy = Hierarchy.of(shared.value) if shared.value else None
        for batch in smaller(batches):
            column = batch.column(1)
            texts, languages, scores = bytes_of(column), [], []
            for a, b, x in _vectors(texts) if hierarchy else ():
                found, score = hierarchy.predict(x)
                languages += found
                scores += score.tolist()
            if not hierarchy:
                languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            for i, text in enumerate(column.to_pylist()):
                if not has_letter(text):
                    languages[i], scores[i] = UNKNOWN, 0.0
            kept = [batch.column(0)] + [batch.column(2 + k) for k in range(extra)]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(languages, pa.string()), pa.array(scores, pa.float64())],
                                             names=names + ["lang_pred", "score"])

    return columns.mapInArrow(predict, schema)

