"""Packing token sequences into windows by minimum bin slack.

Texts are encoded where they are read; a document longer than a window is cut into full windows and a rest. Only the number
of pieces per length (at most one number per length up to the window) reaches the driver. There a bitset subset-sum finds
the multiset of remaining lengths that fills a window closest to its capacity; the choice is backtracked into counts per
length and repeated as often as the counts allow, so the plan has no more steps than lengths run out, whatever the input.
Pieces find their place by their ordinal within their length, counted per task and added up by a prefix over the tasks.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sourcemart.llm.common import process_cache, settle, smaller

WINDOW = 1024
END_ID = 0
STRETCH_ROWS = 16_384  # rows whose pieces are packed together where the order counts


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes. Nothing is kept between texts: looking words up in a table
    of bounded size took longer than encoding them again."""

    def __init__(self, ranks_path: str, pattern: str):
        import base64
        import tiktoken
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encode = tiktoken.Encoding("ids", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def ids(self, text: str) -> bytes:
        return np.array(self.encode(text), dtype="<u4").tobytes()


def public_encoder(ranks_name: str) -> Encoder:
    """The worker's encoder of a public vocabulary file, read once per worker."""
    import public_tokenizers
    kept = process_cache()
    if ranks_name not in kept:
        kept[ranks_name] = Encoder(public_tokenizers.path(ranks_name), public_tokenizers.PATTERN)
    return kept[ranks_name]


def pieces(docs: DataFrame, id_col="doc_id", text_col="text", window=WINDOW, end_id=END_ID,
           ranks_name="byte_bpe_50k.tiktoken", with_ids=False) -> DataFrame:
    """Pieces of at most ``window`` ids: id, start, length, ids_crc32, doc_tokens, task, place (and ids).

    ``place`` counts the pieces of one length within one task.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, task int, place long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = public_encoder(ranks_name), TaskContext.get().partitionId(), np.zeros(window + 1, dtype=np.int64)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in smaller(batches, 256):
            index, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encoder.ids(text or "") + end
                n = len(ids) // 4
                for start in range(0, n, window):
                    part = ids[4 * start:4 * (start + window)]
                    length = len(part) // 4
                    index.append(i)
                    out.append((start, length, zlib.crc32(part), n, task, int(seen[length])) + (part,) * with_ids)
                    seen[length] += 1
            columns = list(zip(*out)) if out else [()] * (6 + with_ids)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * with_ids
            arrays = [batch.column(0).take(pa.array(index, pa.int64()))]
            arrays += [pa.array(list(c), t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "start", "length", "ids_crc32", "doc_tokens", "task", "place"] + ["ids"] * with_ids)

    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts per length of the multiset whose sum comes closest to ``capacity`` from below.

    Bit ``s`` of a set says that the sum ``s`` can be reached. Counts are split into powers of two; each step's set is kept
    and walked back from the best sum.
    """
    mask, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, power = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(power, left)
            wider = reach | (reach << (length * take)) & mask
            if wider != reach:
                steps.append((length, take, reach))
                reach = wider
            left -= take
            power *= 2
        if reach >> capacity & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def slack_plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first ordinal, end ordinal, per window, first window, offset): where pieces of each length go.

    Each window is opened by the longest piece left, as short pieces fill gaps more easily.
    """
    left = {length: n for length, n in counts.items() if n}
    used, plan, windows = dict.fromkeys(left, 0), [], 0
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        chosen = fullest({k: v for k, v in rest.items() if v and k <= window - longest}, window - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times, offset = min(left[k] // n for k, n in chosen.items()), 0
        for length, n in sorted(chosen.items(), reverse=True):
            plan.append((length, used[length], used[length] + n * times, n, windows, offset))
            used[length] += n * times
            left[length] -= n * times
            offset += length * n
            if not left[length]:
                del left[length]
        windows += times
    return plan


def pack(docs: DataFrame, id_col="doc_id", text_col="text", window=WINDOW, end_id=END_ID,
         ranks_name="byte_bpe_50k.tiktoken", with_ids=False) -> DataFrame:
    """Pieces with their place: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A null text is empty and holds the end id alone. Repeated rows are packed as often as they occur; ids of any type,
    null included, are carried along. Columns besides the two named are not read. No rows give no rows.
    """
    spark = docs.sparkSession
    cut = settle(pieces(docs, id_col, text_col, window, end_id, ranks_name, with_ids), "pieces")
    per_task = settle(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    counts = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    plan = F.broadcast(plan_frame(spark, counts, window))  # bounded by the lengths, not by the pieces
    ordinal = F.col("place") + F.col("shift")
    step = ordinal - F.col("first")
    placed = cut.join(shifts, ["length", "task"]).join(plan, "length").filter((ordinal >= F.col("first")) & (ordinal < F.col("last")))
    return placed.select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
        (F.col("window") + F.floor(step / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + step % F.col("per") * F.col("length")).cast("long").alias("offset"), *["ids"] * with_ids)


def pack_in_order(docs: DataFrame, positions: DataFrame, id_col="doc_id", text_col="text", window=WINDOW, end_id=END_ID,
                  ranks_name="byte_bpe_50k.tiktoken", stretch_rows=STRETCH_ROWS) -> DataFrame:
    """As ``pack``, but windows are filled from ``stretch_rows`` consecutive positions each, so that their order is that of
    ``positions`` (id, position). ``sequence_id`` rises with the stretch: its upper bits are the stretch.

    Only pieces, without their ids, meet the positions. A stretch is one group; its size is bounded by its rows. A row
    whose id has no position belongs to a last stretch of its id's hash; an id that occurs more than once takes its first.
    """
    cut = pieces(docs, id_col, text_col, window, end_id, ranks_name).drop("task", "place")
    place = positions.groupBy(F.col(id_col).alias("_id")).agg(F.min("position").alias("position"))
    placed = cut.join(place, F.col("id").eqNullSafe(F.col("_id")), "left").drop("_id")
    last = (1 << 30) + F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    placed = placed.withColumn("stretch", F.coalesce(F.floor(F.col("position") / stretch_rows), last).cast("long"))
    kinds = dict(cut.dtypes)
    own = ["id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = ", ".join(f"{n} {kinds[n]}" for n in own) + ", sequence_id long, offset long"

    def fill(key, rows):
        order = np.lexsort((rows["start"].to_numpy(), rows["position"].fill_null(0).to_numpy()))
        rows = rows.take(pa.array(order))
        length = rows["length"].to_numpy()
        by_length = np.argsort(length, kind="stable")
        lengths, first, n = np.unique(length[by_length], return_index=True, return_counts=True)
        plan = np.array(sorted(slack_plan(dict(zip(lengths.tolist(), n.tolist())), window)), dtype=np.int64)
        ordinal = np.empty(len(length), dtype=np.int64)
        ordinal[by_length] = np.arange(len(length)) - np.repeat(first, n)
        use = plan[np.searchsorted((plan[:, 0] << 40) + plan[:, 1], (length << 40) + ordinal, side="right") - 1]
        step = ordinal - use[:, 1]
        local = use[:, 4] + step // use[:, 3]
        # Windows in the order of the earliest piece each holds.
        earliest = np.full(int(local.max()) + 1, len(local))
        np.minimum.at(earliest, local, np.arange(len(local)))
        number = np.empty(len(earliest), dtype=np.int64)
        number[np.argsort(earliest)] = np.arange(len(earliest))
        columns = [rows[c] for c in own] + [pa.array((key[0].as_py() << 32) + number[local]), pa.array(use[:, 5] + step % use[:, 3] * length)]
        return pa.Table.from_arrays(columns, names=own + ["sequence_id", "offset"])

    return placed.groupBy("stretch").applyInArrow(fill, schema).withColumnRenamed("id", id_col)


def plan_frame(spark: SparkSession, counts: dict[int, int], window: int = WINDOW) -> DataFrame:
    return spark.createDataFrame(slack_plan(counts, window), "length long, first long, last long, per long, window long, at long")
