"""Helpers the operators of this folder share: scratch tables, folds, Arrow batches, word and shingle hashes."""

import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CHUNK_BYTES = 1 << 18  # texts are worked on in runs of about this size; a longer text is a run of its own


# ---- scratch tables -------------------------------------------------------------------------------------------------

def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only where that is unset, on a local master, one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that every executor and the driver can reach")
        named = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def settle(df: DataFrame, purpose: str) -> DataFrame:
    """Rows written once as a table in the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a settled table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if name.startswith(("file:", "hdfs:", "s3", "abfs", "gs:", "viewfs:")):
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if(df: DataFrame, most: int) -> DataFrame:
    """A broadcast hint, given only after the rows of a settled or small frame were counted against ``most``."""
    return F.broadcast(df) if df.count() <= most else df


def process_cache() -> dict:
    """What a Python process keeps between tasks. Functions travel to the executors by value, so their own globals don't."""
    return vars(sys.modules.setdefault("llm_process_cache", types.ModuleType("llm_process_cache")))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


# ---- columns --------------------------------------------------------------------------------------------------------

def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text modulo ``folds``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds


def hash_share(*columns) -> Column:
    """A number in [0, 1) that depends on the columns alone: for samples that any run draws alike."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


# ---- Arrow batches --------------------------------------------------------------------------------------------------

def smaller(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that a worker holds the objects of few rows at a time; memory is given back at the end."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
    give_back()


def give_back() -> None:
    """Empties what a worker keeps by key and returns free memory to the system: workers outlive their tasks."""
    for kept in process_cache().values():
        if hasattr(kept, "forget"):
            kept.forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def runs(texts: list[bytes], size: int = CHUNK_BYTES, most: int = 512) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``size`` bytes, at most ``most`` texts each."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= size or i + 1 - start >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


# ---- hashes of words ------------------------------------------------------------------------------------------------

SPACES = b" \t\n\x0b\x0c\r"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True
BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, at least ``n`` of each. Those for a usual run of texts are kept."""
    kept = process_cache()
    if "powers" in kept and len(kept["powers"][0]) >= n:
        return kept["powers"]
    usual = CHUNK_BYTES * 3 // 2
    made = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        table = np.full(max(n, usual), base, dtype=np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        made.append(table)
    if n <= usual:
        kept["powers"] = tuple(made)
    return tuple(made)


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of non-space bytes) of the texts, in order, the first word of each text with one
    more entry at the end, and the words' lengths in bytes. A-Z count as a-z if ``lower``."""
    blob = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    if lower:
        blob = LOWER[blob]
    space = IS_SPACE[blob]
    edge = space[1:] != space[:-1]
    edges = np.flatnonzero(edge) + 1
    starts, ends = edges[::2], edges[1::2]
    up, down = _power_tables(len(blob) + 1)
    sums = np.empty(len(blob) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((blob.astype(np.uint64) + np.uint64(1)) * up[: len(blob)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    lengths = ends - starts
    hashes = mix(hashes ^ (lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    places = np.cumsum([1] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(starts, places), lengths


class Tally:
    """Counts of 64-bit keys within a task, given out whenever they pass ``most`` distinct keys."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.parts, self.held = most, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        if len(keys):
            self.parts.append((keys, counts))
            self.held += len(keys)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        keys, counts = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.parts, self.held = [(keys[first], np.add.reduceat(counts, first))], len(first)
        return self.parts[0]

    def batches(self, last: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
        """Rows to give out now; all of them at the end."""
        if 2 * self.held < 3 * self.most and not last:
            return
        keys, counts = self.merged()
        if len(keys) >= self.most or last:
            self.parts, self.held = [], 0
            for a in range(0, len(keys), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a:a + (1 << 18)].view(np.int64)), pa.array(counts[a:a + (1 << 18)])], names=names)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``width``-word shingles; a shorter text is one shingle, one without
    words is empty."""
    hashes, first, _ = word_hashes(texts)
    n = len(hashes) - width + 1
    if n > 0:
        mixed = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            mixed = mix(mixed * np.uint64(0xD6E8FEB86659FD93) + hashes[k:k + n] + np.uint64(k + 1))
    else:
        mixed = np.empty(0, dtype=np.uint64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(mixed[a:b - width + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for h in hashes[a:b]:
                    whole = mix(np.array([whole * np.uint64(0xC2B2AE3D27D4EB4F) + h]))[0]
            out.append(np.array([whole], dtype=np.uint64))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out
