"""Gram postings and BM25 over two weighted columns, computed from the rows or kept as an index.

An index row holds *distinct* grams, so a term frequency is 0 or 1, and a row that holds a search term holds all its
grams. The score of a hit therefore needs only the row's gram count and the corpus statistics of the query's grams:
one reduction over the corpus, no postings join.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sourcemart.functions.grams import gram_number, index_grams, query_grams
from sourcemart.functions.text import all_terms, normalize_literal
from sourcemart.session import settle

# BM25 constants, column weights and the floor of the inverse document frequency.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
WEIGHT = {"name_norm": 8.0, "all_norm": 1.0}


def with_gram_count(docs: DataFrame) -> DataFrame:
    """Adds the number of index grams in both columns. Meant for ingest: the column is stored with the row."""
    return docs.withColumn("gram_count", gram_number("name_norm") + gram_number("all_norm"))


def postings(docs: DataFrame, column: str, key="id") -> DataFrame:
    """(key, gram), each once. Exploded from one row, so no group is ever built."""
    return docs.select(key, F.explode(index_grams(column)).alias("gram"))


def candidates(post: DataFrame, terms: list[str], key="id") -> DataFrame:
    """Keys that hold every gram of every term: a superset of the exact matches, to be checked with ``contains``."""
    wanted = sorted({g for t in terms for g in query_grams(t)})
    hits = post.filter(F.col("gram").isin(*wanted)).groupBy(key).agg(F.count("*").alias("n"))
    return hits.filter(F.col("n") == len(wanted)).select(key)


def corpus_statistics(docs: DataFrame, columns: list[str], grams: list[str]) -> DataFrame:
    """One row: number of rows, all grams, and per column the number of rows that hold each query gram."""
    rows = [F.count_if(F.contains(F.col(c), F.lit(g))).cast("double").alias(f"n{i}_{j}")
            for i, c in enumerate(columns) for j, g in enumerate(grams)]
    return docs.agg(F.count("*").cast("double").alias("rows"), F.sum("gram_count").cast("double").alias("grams"), *rows)


def bm25(gram_count, weight: float, rows: float, grams: float, holding: list[float]) -> Column:
    """Score of a row that holds every query gram; lower is better."""
    idf = [math.log((rows - n + 0.5) / (n + 0.5)) for n in holding]
    return weighted_score(F.lit(sum(i if i > 0 else IDF_FLOOR for i in idf)), gram_count, F.lit(weight), rows, grams)


def weighted_score(idf: Column, gram_count, weight: Column, rows: float, grams: float) -> Column:
    """The score from the sum of a query's inverse document frequencies, which may differ from row to row."""
    average = grams / rows if rows else 1.0
    length = F.col(gram_count) if isinstance(gram_count, str) else gram_count
    return -idf * (weight * F.lit(K1 + 1)) / (weight + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / F.lit(average)))


def rarity(held, rows: float) -> Column:
    """Inverse document frequency of a gram that ``held`` rows of ``rows`` hold."""
    found = F.log((F.lit(rows) - held + F.lit(0.5)) / (held + F.lit(0.5)))
    return F.when(found > 0, found).otherwise(F.lit(IDF_FLOOR))


def relevance(docs: DataFrame, terms: list[str], column: str = "all_norm") -> DataFrame:
    """Rows that hold every term, with ``score``. The statistics of the query are one row on the driver."""
    occurrences = [g for t in terms for g in query_grams(t)]
    distinct = sorted(set(occurrences))
    stats = corpus_statistics(docs, [column], distinct).first()
    holding = {g: stats[f"n0_{j}"] for j, g in enumerate(distinct)}
    # A gram that occurs in two terms of the query counts twice.
    score = bm25("gram_count", WEIGHT[column], stats["rows"], stats["grams"] or 0.0, [holding[g] for g in occurrences])
    return docs.filter(all_terms(column, terms)).withColumn("score", score)


# ---- the stored index -----------------------------------------------------------------------------------------------

COLUMNS = ("name_norm", "all_norm")
SCAN_SHARE = 0.1  # a rarest gram that more of the rows hold doesn't narrow the search: then the rows are scanned


@dataclass
class StoredIndex:
    """A text index as tables below one folder, written in segments and merged when read.

    rows        one per text: key, carried columns, both normalized texts, gram_count
    postings    (column, gram, keys): the keys of a block of texts that hold it, each key once, range-sorted so that a gram is
                read from few row groups
    frequencies (column, gram, n): rows that hold it, per segment; less what the segment made invalid
    gone        (key, before): rows of that key in segments below ``before`` are no longer valid
    segments    one row per segment with its totals, written last: without it a segment isn't there

    Texts are normalized and cut into grams once, when they come in. A segment appended under known keys replaces their rows.
    """

    spark: SparkSession
    path: str
    key: str
    totals: dict[int, tuple[int, int, int]]  # segment -> rows, grams, keys gone

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "StoredIndex":
        found = spark.read.parquet(f"{path}/segments").collect()  # one row per segment
        return cls(spark, path, found[0]["key"], {r["segment"]: (r["rows"], r["grams"], r["gone"]) for r in found})

    @classmethod
    def build(cls, docs: DataFrame, path: str, key="id", name="name", text="text") -> "StoredIndex":
        """docs(key, name, text, ...): all other columns are carried. Keys are unique and not null."""
        return cls(docs.sparkSession, path, key, {}).append(docs, name, text)

    # -- writing --------------------------------------------------------------------------------------------------------

    def append(self, docs: DataFrame, name="name", text="text") -> "StoredIndex":
        """A new segment; rows whose key is known already are replaced."""
        fresh = settle(_prepared(docs, self.key, name, text), "segment")
        rows, grams = fresh.filter("gram IS NULL").agg(F.count("*"), F.coalesce(F.sum("gram_count"), F.lit(0))).first()
        old = self.rows().select(self.key, "gram_count").join(fresh.filter("gram IS NULL").select(self.key), self.key, "left_semi") if self.totals else None
        return self._commit(fresh, rows, grams, old)

    def remove(self, keys: DataFrame) -> "StoredIndex":
        """A segment without rows that makes the rows of ``keys`` invalid."""
        old = self.rows().select(self.key, "gram_count").join(keys.select(self.key), self.key, "left_semi")
        return self._commit(None, 0, 0, old)

    def _commit(self, fresh: DataFrame | None, rows: int, grams: int, old: DataFrame | None) -> "StoredIndex":
        number = max(self.totals, default=-1) + 1
        write = lambda frame, part: frame.write.mode("overwrite").parquet(f"{self.path}/{part}/segment={number}")
        gone, gone_grams, counts = 0, 0, None
        if old is not None:
            old = settle(old, "gone")
            gone, gone_grams = old.agg(F.count("*"), F.coalesce(F.sum("gram_count"), F.lit(0))).first()
            if gone:
                counts = self.postings().join(old.select(self.key), self.key, "left_semi").groupBy("column", "gram").agg((-F.count("*")).alias("n"))
                counts = settle(counts, "counts")
        if fresh is not None:
            write(fresh.filter("gram IS NULL").drop(*BLOCK), "rows")
            blocks = fresh.filter("gram IS NOT NULL").select(*BLOCK)
            order = ["column", "gram", F.get("keys", F.lit(0))]
            write(blocks.repartitionByRange(*order).sortWithinPartitions(*order), "postings")
            made = blocks.groupBy("column", "gram").agg(F.sum(F.size("keys")).alias("n"))
            counts = made if counts is None else made.unionByName(counts)
        if counts is not None:
            write(counts.groupBy("column", "gram").agg(F.sum("n").alias("n")), "frequencies")
        if gone:
            write(old.select(self.key, F.lit(number).alias("before")), "gone")
        totals = self.spark.createDataFrame([(self.key, rows - gone, grams - gone_grams, gone)], "key string, rows long, grams long, gone long")
        write(totals.coalesce(1), "segments")
        return StoredIndex(self.spark, self.path, self.key, {**self.totals, number: (rows - gone, grams - gone_grams, gone)})

    # -- reading --------------------------------------------------------------------------------------------------------

    def _part(self, part: str, segments: list[int]) -> DataFrame:
        paths = [f"{self.path}/{part}/segment={n}" for n in segments]
        return self.spark.read.option("basePath", f"{self.path}/{part}").parquet(*paths)

    def _filled(self, part: str) -> DataFrame:
        return self._part(part, [n for n, (rows, _, gone) in sorted(self.totals.items()) if rows + gone or n == 0])

    def _valid(self, found: DataFrame) -> DataFrame:
        """Rows or postings of all segments without those that a later segment replaced or removed."""
        later = [n for n, (_, _, gone) in self.totals.items() if gone]
        if later:
            gone = self._part("gone", later).groupBy(F.col(self.key).alias("_gone")).agg(F.max("before").alias("_before"))
            found = found.join(gone, (F.col(self.key) == F.col("_gone")) & (F.col("segment") < F.col("_before")), "left_anti")
        return found.drop("segment")

    def rows(self) -> DataFrame:
        return self._valid(self._filled("rows"))

    def postings(self, asked: DataFrame | None = None) -> DataFrame:
        """(column, gram, key), each once; with asked(column, gram, ...) the rows of that frame with the keys of their grams."""
        blocks = self._filled("postings")
        found = blocks if asked is None else asked.join(blocks, ["column", "gram"])
        return self._valid(found.withColumn(self.key, F.explode("keys")).drop("keys"))

    def frequencies(self) -> DataFrame:
        """(column, gram, n) over all segments."""
        written = [n for n, (rows, _, gone) in self.totals.items() if rows or gone or n == 0]
        found = self._part("frequencies", written).groupBy("column", "gram").agg(F.sum("n").alias("n"))
        return found.filter("n > 0")

    def size(self) -> tuple[float, float]:
        """(rows, all grams)."""
        return float(sum(t[0] for t in self.totals.values())), float(sum(t[1] for t in self.totals.values()))

    def find(self, terms: list[str], column: str = "all_norm", scan_share: float = SCAN_SHARE) -> DataFrame:
        """Rows that hold every term, with ``score``. The rarest gram's postings say which rows are looked at."""
        occurrences = [g for t in terms for g in query_grams(t)]
        if not occurrences:
            return self.rows().withColumn("score", F.lit(None).cast("double"))
        asked = self.frequencies().filter((F.col("column") == column) & F.col("gram").isin(*set(occurrences)))
        held = {r["gram"]: float(r["n"]) for r in asked.collect()}  # the query's own grams
        rows, grams = self.size()
        found = self.rows()
        if any(g not in held for g in occurrences):
            return found.filter(F.lit(False)).withColumn("score", F.lit(0.0))
        rarest = min(held, key=lambda g: (held[g], g))
        if held[rarest] <= scan_share * rows:
            holding = self.postings().filter((F.col("column") == column) & (F.col("gram") == rarest)).select(self.key)
            found = found.join(holding, self.key, "left_semi")
        score = bm25("gram_count", WEIGHT[column], rows, grams, [held[g] for g in occurrences])
        return found.filter(all_terms(column, terms)).withColumn("score", score)


BLOCK = ["column", "gram", "keys"]
BLOCK_ROWS, BLOCK_CHARS = 1 << 11, 1 << 21  # at most so many texts in a block, and no more once they have so many characters
TABLE = 1 << 26  # bytes of a table of grams and texts; where it would be larger, grams are sorted


def _prepared(docs: DataFrame, key: str, name: str, text: str) -> DataFrame:
    """In one pass over the texts, rows (key, carried columns, normalized texts, gram_count) and blocks of postings (column, gram,
    keys), each with nulls for the other's columns."""
    carried = [c for c in docs.columns if c not in (name, text)]
    kinds = dict(docs.dtypes)
    of_row = ", ".join(f"`{c}` {kinds[c]}" for c in carried) + ", name_norm string, all_norm string, gram_count long"
    names = carried + [*COLUMNS, "gram_count", *BLOCK]

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            start = 0
            both = [[normalize_literal(v) for v in whole.column(k).to_pylist()] for k in (0, 1)]
            sizes = [len(a or "") + len(b or "") for a, b in zip(*both)]
            while start < whole.num_rows:
                end, chars = start, 0
                while end < whole.num_rows and end - start < BLOCK_ROWS and chars < BLOCK_CHARS:
                    chars += sizes[end]
                    end += 1
                batch = whole.slice(start, end - start)
                sides = [side[start:end] for side in both]
                start = end
                keys, counts, blocks = batch.column(2 + carried.index(key)), np.zeros(batch.num_rows, dtype=np.int64), []
                for column, side in zip(COLUMNS, sides):
                    grams, first, owners = gram_owners(side)
                    counts += np.bincount(owners, minlength=batch.num_rows)
                    held = pa.ListArray.from_arrays(pa.array(first, pa.int32()), keys.take(pa.array(owners)))
                    blocks.append([pa.array([column] * len(grams), pa.string()), pa.array(grams, pa.string()), held])
                kept = [batch.column(2 + i) for i in range(len(carried))] + [pa.array(side, pa.string()) for side in sides] + [pa.array(counts)]
                block_types = [pa.string(), pa.string(), pa.list_(keys.type)]
                yield pa.RecordBatch.from_arrays(kept + [pa.nulls(batch.num_rows, t) for t in block_types], names=names)
                for block in blocks:
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(block[0]), c.type) for c in kept] + block, names=names)

    schema = f"{of_row}, column string, gram string, keys array<{kinds[key]}>"
    # Rows are dealt out by key first: texts come in few large row groups, and rows of one key meet later segments by it.
    return docs.select(F.col(name).alias("_name"), F.col(text).alias("_text"), *carried).repartition(key).mapInArrow(prepare, schema)


def gram_owners(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(grams, first, owners): the distinct grams of ``gram_set`` over at most BLOCK_ROWS texts; ``owners[first[i]:first[i + 1]]`` are
    the places of the texts that hold gram i."""
    points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t or "") for t in texts])
    inside = np.flatnonzero(owner[1:] == owner[:-1])
    # Characters are numbered from 1 as they sort, so a gram is a pair of numbers, with 0 for no second character.
    seen = np.zeros(0x110000, dtype=bool)
    seen[points] = True
    letters = np.flatnonzero(seen)
    number = np.zeros(0x110000, dtype=np.int64)
    number[letters] = np.arange(1, len(letters) + 1)
    letter, kinds = number[points], len(letters) + 1
    code = letter * kinds
    found = np.concatenate([code * len(texts) + owner, (code[:-1] + letter[1:])[inside] * len(texts) + owner[:-1][inside]])
    if kinds * kinds * len(texts) <= TABLE:
        table = np.zeros(kinds * kinds * len(texts), dtype=bool)
        table[found] = True
        found = np.flatnonzero(table)
    else:
        found = np.sort(found)
        found = found[np.flatnonzero(np.diff(found, prepend=-1))]
    code, owners = np.divmod(found, max(1, len(texts)))
    first = np.flatnonzero(np.diff(code, prepend=-1))
    chars = ["", *map(chr, letters.tolist())]
    grams = [chars[c // kinds] + chars[c % kinds] for c in code[first].tolist()]
    return grams, np.append(first, len(found)), owners
