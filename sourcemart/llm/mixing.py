"""Mixing sources to target weights by a Pfair schedule (DataFrame functions only).

Documents of a source are put in a fixed random order and cut into blocks. Let fluid time run in which every source that is
not yet out gets its share of each slot by its weight; block k of a source may run from the slot in which the fluid share
reaches k - 1 blocks (release) to the slot in which it reaches k (deadline). One block runs per slot, earliest deadline first.
Then no source is ever a whole block away from its share. When a source runs out, the others share its weight. Releases and
deadlines are exact: weights are ratios of whole numbers. The schedule is a table of one row per block, made in slot order
and written in parts, so the driver holds the sources and one part. Documents find their block by their number within their
source. Every document stays.
"""

import heapq
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sourcemart.llm.common import broadcast_if, free_name, settle, shared_folder

PERIOD = 1000        # of whole parts, for weights that repeat
BLOCK_ROWS = 16
POWER = 0.7          # default target weight of a source: its number of documents to this power
BUCKET_ROWS = 512    # rows that are numbered together, until MOST_BUCKETS is reached
MOST_BUCKETS = 20_000
PART_BLOCKS = 200_000  # blocks of the schedule that are written together
BROADCAST_ROWS = 50_000
LEVEL_SEED = 20_241


def shares(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Weights as whole parts of the period: largest remainders, at least one part each."""
    period = max(period, 2 * len(weights))
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    parts = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))
    i = 0
    while sum(parts.values()) < period:
        parts[order[i % len(order)]] += 1
        i += 1
    while sum(parts.values()) > period:
        parts[max(parts, key=lambda s: (parts[s], s))] -= 1
    return parts


def whole(weights: dict[str, float]) -> dict[str, int]:
    """The same weights, exactly, as whole numbers."""
    ratios = {s: w.as_integer_ratio() for s, w in weights.items()}
    common = max((below for _, below in ratios.values()), default=1)  # powers of two, or one
    return {s: above * (common // below) for s, (above, below) in ratios.items()}


def schedule(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[str, int]]:
    """(source, number of its block), slot by slot.

    At fluid time v a source has had min(weight * v, its blocks), so block k ends at v = k / weight, in the slot
    finished blocks + open weight * v, where sources that were out by v are finished and the others open.
    """
    weight = whole({s: float(weights[s]) for s, n in blocks.items() if n})
    # In order of running out, as fractions n / weight: two are compared by a key that is exact.
    scale = 1 << 2 * max((w.bit_length() for w in weight.values()), default=0)
    ends = sorted((blocks[s] * scale // w, s) for s, w in weight.items())
    keys, finished, open_weight = [k for k, _ in ends], [0], [sum(weight.values())]
    for _, s in ends:
        finished.append(finished[-1] + blocks[s])
        open_weight.append(open_weight[-1] - weight[s])

    def window(s, k):
        """Release of block k + 1 and deadline of block k."""
        at = bisect_left(keys, k * scale // weight[s])
        quotient, over = divmod(open_weight[at] * k, weight[s])
        return finished[at] + quotient, finished[at] + quotient + (over > 0)

    waiting = [(0, s, 1) for s in weight]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    for slot in range(sum(blocks[s] for s in weight)):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (window(s, k)[1], s, k))
        _, s, k = heapq.heappop(ready)
        yield s, k - 1
        if k < blocks[s]:
            heapq.heappush(waiting, (window(s, k)[0], s, k + 1))


def period_slots(parts: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source, in order, over one period of the parts."""
    slots: dict[str, list[int]] = {s: [] for s in parts}
    for slot, (s, _) in enumerate(schedule(parts, parts)):
        slots[s].append(slot)
    return slots


def schedule_table(spark: SparkSession, counts: dict[str, int], target: dict[str, float], block_rows: int) -> DataFrame:
    """(_source, _block, slot, _first): one row per block; ``_first`` is the position of its first row."""
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    path, slot, start = f"{shared_folder(spark)}/schedule-{uuid.uuid4().hex}", 0, 0
    run = schedule(blocks, target)
    schema = pa.schema([("_source", pa.string()), ("_block", pa.int64()), ("slot", pa.int64()), ("_first", pa.int64())])
    while slot % PART_BLOCKS == 0:  # ends with a part that isn't full, be it empty
        part = list(islice(run, PART_BLOCKS))
        starts = []
        for s, k in part:
            starts.append(start)
            start += min(block_rows, counts[s] - k * block_rows)
        columns = [[s for s, _ in part], [k for _, k in part], range(slot, slot + len(part)), starts]
        spark.createDataFrame(pa.table(list(map(pa.array, columns, schema.types)), schema=schema)).write.mode("append").parquet(path)
        slot += len(part)
        if not part:
            break
    return spark.read.schema("_source string, _block long, slot long, _first long").parquet(path)


def numbered_in_source(docs: DataFrame, id_col: str, source_col: str, seed: int):
    """(rows, counts): every row's number within its source in a fixed random order; rows per source.

    Rows are dealt to buckets of about equal size, so a source of any size is numbered by many tasks.
    """
    keyed = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_source"),
                        F.monotonically_increasing_id().alias("_row"))
    keyed = settle(keyed.withColumn("_order", F.xxhash64(F.lit(seed), "_id", F.when(F.col("_id").isNull(), F.col("_row")))), "mix")
    counts = {r["_source"]: r["n"] for r in keyed.groupBy("_source").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return keyed.withColumn("_number", F.lit(0).cast("long")), counts
    rows = max(BUCKET_ROWS, -(-sum(counts.values()) // MOST_BUCKETS))
    spark = docs.sparkSession
    small = F.broadcast if len(counts) + MOST_BUCKETS <= BROADCAST_ROWS else lambda frame: frame
    many = small(spark.createDataFrame([(s, -(-n // rows)) for s, n in counts.items()], "_source string, _buckets int"))
    # The upper bits of the order choose the bucket, so buckets follow one another in the order.
    share = F.shiftrightunsigned("_order", 11) / F.lit(float(1 << 53))
    dealt = keyed.join(many, "_source").withColumn("_bucket", F.least(F.floor(share * F.col("_buckets")), F.col("_buckets") - 1).cast("int"))
    sizes = dealt.groupBy("_source", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_source", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_source", "_bucket").orderBy(F.shiftrightunsigned("_order", 11), "_order", "_id", "_row")) - 1
    inside = dealt.withColumn("_place", place)
    # Bounded: at most MOST_BUCKETS plus one per source.
    return inside.join(small(starts), ["_source", "_bucket"]).withColumn("_number", (F.col("_place") + F.col("_start")).cast("long")), counts


def mix_positions(docs: DataFrame, weights: dict[str, float] | None = None, id_col="doc_id", source_col="source",
                  block_rows=BLOCK_ROWS, power=POWER, seed=LEVEL_SEED) -> DataFrame:
    """One row per row of ``docs``: id, source, block, slot, position, weight.

    ``position`` numbers the mixed rows from 0 without gaps. ``weights`` names target weights per source, for sources not
    named (and by default) the number of documents to ``power``, scaled alike. A null source is the source ''. Repeated
    rows keep their places beside each other's; null ids are placed by where they were read. No rows give no rows.
    """
    if weights and any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    numbered, counts = numbered_in_source(docs, id_col, source_col, seed)
    target = {s: float((weights or {}).get(s, n ** power)) for s, n in counts.items()}
    total = sum(target.values()) or 1.0
    spark = docs.sparkSession
    blocks = schedule_table(spark, counts, target, block_rows)
    weight = spark.createDataFrame([(s, w / total) for s, w in target.items()], "_source string, weight double")
    weight = F.broadcast(weight) if len(target) <= BROADCAST_ROWS else weight
    placed = (numbered.withColumn("_block", F.floor(F.col("_number") / block_rows))
              .join(broadcast_if(blocks, BROADCAST_ROWS), ["_source", "_block"]).join(weight, "_source"))
    return placed.select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_block").cast("long").alias("block"), "slot",
                         (F.col("_first") + F.col("_number") % block_rows).cast("long").alias("position"), "weight")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, id_col="doc_id", source_col="source", **options) -> DataFrame:
    """All rows of ``docs`` with their columns, range-sorted into the mixed order.

    Rows are found again by id; an id that occurs more than once takes the place of its first occurrence each time.
    """
    mine, place = free_name(docs, "_id"), free_name(docs, "_position")
    places = (mix_positions(docs, weights, id_col, source_col, **options).groupBy(F.col(id_col).alias(mine))
              .agg(F.min("position").alias(place)))
    return docs.join(places, F.col(id_col).eqNullSafe(F.col(mine))).orderBy(place).drop(mine, place)
