"""Order-aware hashes of texts that compose: the hash of a whole follows from hash and length of its parts, in any grouping.

A text's hash is the sum of (byte + 1) * base^place modulo a prime, for two primes of 31 bits. A part that begins at some
place of the whole adds its own hash times base^place, so parts are summed like numbers and no text has to be put together.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

PRIMES = (2_147_483_629, 2_147_483_587)
BASES = (1_103_515_245, 1_566_083_941)
BLOCK = 1 << 14


def _powers(base: int, prime: int) -> np.ndarray:
    out = np.ones(BLOCK, dtype=np.uint64)
    for i in range(1, BLOCK):
        out[i] = int(out[i - 1]) * base % prime
    return out


def _hash(data: bytes, powers: np.ndarray, base: int, prime: int) -> int:
    values, total, scale, step = np.frombuffer(data, dtype=np.uint8), 0, 1, pow(base, BLOCK, prime)
    for start in range(0, len(values), BLOCK):
        part = values[start:start + BLOCK].astype(np.uint64) + np.uint64(1)
        total = (total + int((part * powers[:len(part)]).sum()) * scale) % prime  # below 2^54
        scale = scale * step % prime
    return total


def with_text_hash(df: DataFrame, text: str) -> DataFrame:
    """``df`` without the text but with its ``_h1``, ``_h2`` and ``_bytes``; null is empty."""
    carried = [c for c in df.columns if c != text]
    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in carried] + ["_h1 long", "_h2 long", "_bytes long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [_powers(b, p) for b, p in zip(BASES, PRIMES)]
        for batch in batches:
            data = [(v or "").encode() for v in batch.column(len(carried)).to_pylist()]
            hashes = [pa.array([_hash(d, t, b, p) for d in data], pa.int64()) for t, b, p in zip(tables, BASES, PRIMES)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(carried))] + [*hashes, pa.array(list(map(len, data)), pa.int64())],
                                             names=carried + ["_h1", "_h2", "_bytes"])

    return df.select(*carried, text).mapInArrow(run, schema)


def shifted(df: DataFrame, place: str) -> DataFrame:
    """``_h1`` and ``_h2`` as parts of a whole in which they begin at byte ``place``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = batch.column(place).to_numpy().astype(np.uint64), {}
            for name, base, prime in zip(("_h1", "_h2"), BASES, PRIMES):
                value, square, left = batch.column(name).to_numpy().astype(np.uint64), base, at.copy()
                while left.any():
                    value = np.where(left & np.uint64(1), value * np.uint64(square) % np.uint64(prime), value)
                    square, left = square * square % prime, left >> np.uint64(1)
                out[name] = pa.array(value.astype(np.int64))
            yield pa.RecordBatch.from_arrays([out.get(n, batch.column(n)) for n in batch.schema.names], names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def summed(name: str) -> Column:
    """The hash of a whole from its shifted parts."""
    return F.pmod(F.sum(name), F.lit(PRIMES[("_h1", "_h2").index(name)]))
