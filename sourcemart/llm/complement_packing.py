"""Best-fit packing by exact complements.

Documents are encoded where they are read; only those longer than a window are cut. How many pieces have each length (at
most one number per length up to the window) is all that reaches the driver. There the longest length opens a window and an
index of single lengths, sums of pairs and, through them, of triples tells which combination fills the gap exactly; it is
consumed as often as the counts of its lengths allow, so the plan has a bounded number of steps whatever the input. While no
combination fills the gap, the longest piece that fits goes in. Lengths that never come to an exact fill are packed best fit
at the end, whole classes of equal windows at a time. Pieces then find their place by their ordinal within their length.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from sourcemart.llm.common import process_cache, settle, smaller
from sourcemart.llm.tokens import WordCodec

WINDOW = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"


# ---- pieces ---------------------------------------------------------------------------------------------------------

def pieces(docs: DataFrame, id_col="doc_id", text_col="text", window=WINDOW, end_id=END_ID, vocabulary=VOCABULARY, with_ids=False) -> DataFrame:
    """Documents' ids in pieces: id, piece, start, length, ids_crc32, task, place (and ids).

    ``place`` counts the pieces of one length within one task.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, task int, place long" + ", ids binary" * with_ids
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * with_ids
    names = ["id", "piece", "start", "length", "ids_crc32", "task", "place"] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, name = process_cache(), f"words:{vocabulary}"
        codec = kept[name] = kept.get(name) or WordCodec(vocabulary)
        task, seen = TaskContext.get().partitionId(), np.zeros(window + 1, dtype=np.int64)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in smaller(batches, 256):
            index, out = [], []
            for i, ids in enumerate(codec.ids_of([text or "" for text in batch.column(1).to_pylist()])):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * window)):
                    part = ids[at:at + 4 * window]
                    length = len(part) // 4
                    index.append(i)
                    out.append((piece, at // 4, length, zlib.crc32(part), task, int(seen[length])) + (part,) * with_ids)
                    seen[length] += 1
            columns = list(zip(*out)) if out else [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(index, pa.int64()))] + [pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    return docs.select(id_col, text_col).mapInArrow(cut, schema)


# ---- the plan -------------------------------------------------------------------------------------------------------

class Stock:
    """Counts per length with an index of the sums that two different lengths in stock make."""

    def __init__(self, counts: dict[int, int], window: int):
        self.window, self.left = window, np.zeros(window + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.has = self.left > 0
        spread = np.fft.irfft(np.fft.rfft(self.has.astype(float), 2 * window + 2) ** 2, 2 * window + 2)
        self.sums = np.rint(spread[:window + 1]).astype(np.int64)  # ordered pairs of lengths by their sum
        doubles = np.flatnonzero(self.has)
        doubles = doubles[2 * doubles <= window]
        self.sums[2 * doubles] -= 1                                # of different lengths

    def change(self, length: int, by: int) -> None:
        self.left[length] += by
        now = bool(self.left[length] > 0)
        if now != self.has[length]:
            others = self.has.copy()
            others[length] = False
            self.sums[length:] += (2 if now else -2) * others[:self.window + 1 - length]
            self.has[length] = now

    def longest(self, most: int) -> int:
        """The longest length in stock up to ``most``; 0 if there is none."""
        found = self.has[:most + 1][::-1]
        at = int(found.argmax()) if len(found) else 0
        return most - at if len(found) and found[at] else 0

    def pair(self, total: int, most: int) -> tuple[int, int] | None:
        """Two lengths of up to ``most`` that make ``total``: the most unlike ones, as short pieces fit anywhere later."""
        if not (self.sums[total] > 0 or total % 2 == 0 and self.left[total // 2] > 1):
            return None
        low, high = total // 2 + 1, min(total - 1, most)
        if high >= low:
            both = self.has[low:high + 1] & self.has[total - high:total - low + 1][::-1]
            at = int(both[::-1].argmax())
            if both[::-1][at]:
                return high - at, total - high + at
        half = total // 2
        return (half, half) if total % 2 == 0 and half <= most and self.left[half] > 1 else None

    def exact(self, gap: int) -> list[int] | None:
        """One, two or three lengths in stock whose sum is the gap."""
        if gap == 0:
            return []
        if self.has[gap]:
            return [gap]
        found = self.pair(gap, gap)
        if found:
            return list(found)
        low, high = -(-gap // 3), gap - 2
        if high < low:
            return None
        rest = self.sums[gap - high:gap - low + 1][::-1] > 0  # by first length from low to high
        rests = np.arange(gap - low, gap - high - 1, -1)
        rest |= (rests % 2 == 0) & (self.left[rests // 2] > 1)
        for first in (low + np.flatnonzero(self.has[low:high + 1] & rest)[::-1]).tolist():
            self.change(first, -1)
            found = self.pair(gap - first, first)
            self.change(first, 1)
            if found:
                return [first, *found]
        return None


@dataclass
class Plan:
    """Rows (length, first ordinal, end ordinal, pieces per window, first window, offset), one per use of a length."""

    rows: list[tuple[int, int, int, int, int, int]]
    used: dict[int, int]
    windows: int = 0

    def put(self, length: int, per: int, first_window: int, times: int, offset: int) -> None:
        start = self.used.get(length, 0)
        self.used[length] = start + per * times
        self.rows.append((length, start, start + per * times, per, first_window, offset))


def exact_fill(stock: Stock, plan: Plan) -> dict[int, int]:
    """Consumes combinations that fill windows exactly; returns the counts of the lengths for which none was found."""
    residual = {}
    while longest := stock.longest(stock.window):
        taken, gap = {longest: 1}, stock.window - longest
        stock.change(longest, -1)
        while (found := stock.exact(gap)) is None:
            fits = stock.longest(gap)
            if not fits:
                break
            # Three pieces can't fill a gap of more than three times the longest: go there at once.
            n = max(1, min(int(stock.left[fits]), (gap - 3 * fits) // fits))
            taken[fits] = taken.get(fits, 0) + n
            stock.change(fits, -n)
            gap -= n * fits
        for length, n in taken.items():
            stock.change(length, n)
        if found is None:
            residual[longest] = int(stock.left[longest])
            stock.change(longest, -residual[longest])
            continue
        for length in found:
            taken[length] = taken.get(length, 0) + 1
        times, offset = min(int(stock.left[length]) // n for length, n in taken.items()), 0
        for length, n in sorted(taken.items(), reverse=True):
            plan.put(length, n, plan.windows, times, offset)
            stock.change(length, -n * times)
            offset += n * length
        plan.windows += times
    return residual


def best_fit(counts: dict[int, int], window: int, plan: Plan) -> None:
    """Longest first into the windows with the smallest gap that takes a piece; windows of one gap are handled together."""
    open_windows: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]  # by gap: (first window, number)
    some = np.zeros(window + 1, dtype=bool)

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            open_windows[gap].append((first, n))
            some[gap] = True

    def fill(length: int, n: int, gap: int, first: int, windows: int) -> int:
        """Puts up to ``n`` pieces into equal windows, each filled up before the next; returns how many are left."""
        per = gap // length
        full = min(windows, n // per)
        if full:
            plan.put(length, per, first, full, window - gap)
            leave(gap - per * length, first, full)
            n -= per * full
        if full < windows and n:
            plan.put(length, n, first + full, 1, window - gap)
            leave(gap - n * length, first + full, 1)
            n, full = 0, full + 1
        leave(gap, first + full, windows - full)
        return n

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            gaps = some[length:]
            at = int(gaps.argmax())
            if not gaps[at]:
                break
            gap = length + at
            first, windows = open_windows[gap].pop()
            some[gap] = bool(open_windows[gap])
            n = fill(length, n, gap, first, windows)
        if n:
            needed = -(-n // (window // length))
            first, plan.windows = plan.windows, plan.windows + needed
            fill(length, n, window, first, needed)


def complement_plan(counts: dict[int, int], window: int = WINDOW) -> Plan:
    plan = Plan([], {})
    stock = Stock({length: n for length, n in counts.items() if n}, window)
    best_fit(exact_fill(stock, plan), window, plan)
    return plan


# ---- places ---------------------------------------------------------------------------------------------------------

def pack_best_fit(docs: DataFrame, id_col="doc_id", text_col="text", window=WINDOW, end_id=END_ID, vocabulary=VOCABULARY, with_ids=False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A null or empty text is the end id alone. A document of up to ``window`` ids is one piece; longer ones are full pieces
    and a rest. Repeated rows are packed as often as they occur; ids of any type, null included, are carried along. Columns
    besides the two named are not read. No rows give no rows.
    """
    spark = docs.sparkSession
    cut = settle(pieces(docs, id_col, text_col, window, end_id, vocabulary, with_ids), "pieces")
    per_task = settle(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    counts = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    rows = np.array(sorted(complement_plan(counts, window).rows), dtype=np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(rows)  # bounded by the lengths, not by the pieces
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = dict(cut.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in own) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        keys = (plan[:, 0] << 48) + plan[:, 1]
        for batch in batches:
            length, ordinal = batch.column("length").to_numpy(), batch.column("ordinal").to_numpy()
            use = plan[np.searchsorted(keys, (length << 48) + ordinal, side="right") - 1]
            step = ordinal - use[:, 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in own] + [pa.array(use[:, 4] + step // use[:, 3]), pa.array(use[:, 5] + step % use[:, 3] * length)],
                names=own + ["sequence_id", "offset"])

    found = cut.join(shifts, ["length", "task"]).select(*own, (F.col("place") + F.col("shift")).alias("ordinal"))
    return found.mapInArrow(place, schema).withColumnRenamed("id", id_col)
