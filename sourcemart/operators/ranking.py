"""Ranks, top-k and paging that hold when one group has a third of all rows."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sourcemart.session import settle

LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number within a partition in its lower 33 bits


HOT_ROWS = 1 << 20  # a group with more rows is numbered in slices
BUCKETS = 1 << 14   # hashes of groups that are counted to see whether any group can be hot


def numbered(df: DataFrame, group: list[str], order: list, name: str = "rank", hot_rows: int = HOT_ROWS) -> DataFrame:
    """row_number over (partition by group order by order) without a hot group in one task.

    Groups of up to ``hot_rows`` rows are numbered by a window. Larger ones, and the whole table where there is no group, are
    numbered in slices. ``order`` must be total, or ties get an arbitrary order (as in any row_number).
    """
    if not group:
        return _sliced(df, group, order, name)
    hot, rows = _hot_groups(df, group, hot_rows)
    window = F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")
    if hot is None:
        return df.withColumn(name, window)
    large = hot.agg(F.sum("_rows")).first()[0]
    # At most one row per ``hot_rows`` rows of the table.
    keys = F.broadcast(hot.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]))
    sliced = _sliced(df.join(keys, _same(group), "left_semi"), group, order, name)
    return sliced if large == rows else sliced.unionByName(df.join(keys, _same(group), "left_anti").withColumn(name, window))


def _same(group: list[str], *more: Column) -> Column:
    return reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + list(more))


def _hot_groups(df: DataFrame, group: list[str], hot_rows: int) -> tuple[DataFrame | None, int]:
    """((group, _rows) of the groups with more than ``hot_rows`` rows, or None; all rows). Groups are counted one by one only where
    their hash bucket has that many rows."""
    keys = df.select(*group, F.pmod(F.xxhash64(*group), F.lit(BUCKETS)).alias("_bucket"))
    sums = keys.groupBy("_bucket").count().collect()  # at most BUCKETS rows
    full = [r["_bucket"] for r in sums if r["count"] > hot_rows]
    rows = sum(r["count"] for r in sums)
    if not full:
        return None, rows
    hot = settle(keys.filter(F.col("_bucket").isin(full)).groupBy(*group).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > hot_rows), "hot")
    return (None if hot.isEmpty() else hot), rows


def _sliced(df: DataFrame, group: list[str], order: list, name: str) -> DataFrame:
    """Numbers in few and large groups.

    Rows are range-sorted by (group, order), which cuts a hot group into many slices; a small table of slice sizes then
    turns the place within a slice into the place within the group. The sorted rows are fixed in shared storage once, so both
    branches and retried tasks agree on the slices.
    """
    ordered = settle(df.orderBy(*group, *order).withColumn("_slot", F.monotonically_increasing_id()))
    ordered = (ordered.withColumn("_slice", F.shiftright("_slot", LOCAL_BITS))
               .withColumn("_place", F.col("_slot").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))))
    sizes = ordered.groupBy(*group, "_slice").agg(F.min("_place").alias("_start"), F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_slice").alias("_s"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_start") + 1).alias("_shift"))
    # At most a row per slice and one per group: the sorted rows stay where they are.
    match = _same(group, F.col("_slice") == F.col("_s"))
    return ordered.join(F.broadcast(shifts), match).withColumn(name, F.col("_place") + F.col("_shift")).select(*df.columns, name)


def top_per_group(df: DataFrame, group: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """Best k of each group with their rank. Spark limits each group before the shuffle as well as after it."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k).withColumn(name, F.col(name).cast("long"))


def latest(df: DataFrame, key: list[str], version: list) -> DataFrame:
    """The row of the highest version of each key: a reduction, with partial results before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_row"))
    return best.select(*key, "_row.*")


def price_order(amount, descending=False) -> Column:
    """Price order in which unknown prices come last both ways."""
    amount = F.col(amount) if isinstance(amount, str) else amount
    return amount.desc_nulls_last() if descending else amount.asc_nulls_last()


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """One page. Sort and limit become a single top-k step."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_info(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One row beside a page: total, and the offset of the next page or null."""
    total = F.count("*")
    return df.agg(total.alias("total"), F.lit(offset).cast("long").alias("offset"), F.lit(limit).cast("long").alias("limit"),
                  F.when(total > offset + limit, F.lit(offset + limit).cast("long")).alias("next_offset"))


def diversify(df: DataFrame, group: list[str], bucket: str, rank: str, name="shown") -> DataFrame:
    """Round robin over buckets in the order in which they first appear in the ranking.

    Meant for a bounded candidate list per ``group`` (a retrieval plan's fused hits).
    """
    within = Window.partitionBy(*group, bucket).orderBy(rank)
    whole = Window.partitionBy(*group, bucket)
    turns = df.withColumn("_turn", F.row_number().over(within)).withColumn("_first", F.min(rank).over(whole))
    order = Window.partitionBy(*group).orderBy("_turn", "_first")
    return turns.withColumn(name, F.row_number().over(order).cast("long")).drop("_turn", "_first")


FEW_BUCKETS = 64


def diversify_all(df: DataFrame, bucket: str, rank: str | list[str], name="shown", few: int = FEW_BUCKETS) -> DataFrame:
    """``diversify`` over any number of rows, which ``rank`` (columns, ascending) orders: places within the buckets by ``numbered``.

    Rows without a bucket are a bucket of their own. Where there are no more than ``few`` buckets, all places follow from their
    sizes: before turn t each has shown its first t - 1 rows. Else the rows are numbered once more.
    """
    rank = [rank] if isinstance(rank, str) else rank
    turns = numbered(df, [bucket], rank, "_turn")
    buckets = turns.groupBy(bucket).agg(F.max("_turn").alias("_n"), F.min(F.struct(*rank)).alias("_first"))
    head = buckets.orderBy("_first").limit(few + 1).select(bucket, "_n").collect()
    if len(head) > few:
        first = buckets.select(F.col(bucket).alias("_bucket"), "_first")
        turns = turns.join(first, F.col(bucket).eqNullSafe(F.col("_bucket"))).drop("_bucket")
        return numbered(turns, [], ["_turn", "_first"], name).drop("_turn", "_first")
    turn = F.col("_turn")
    shown = reduce(lambda a, b: a + b, [F.least(F.lit(r["_n"]), turn - 1) for r in head], F.lit(0).cast("long"))
    kind = dict(df.dtypes)[bucket]
    before = F.lit(0)  # buckets that come no later within a turn and still have a row in it
    places = []
    for r in head:
        before = before + F.when(F.lit(r["_n"]) >= turn, 1).otherwise(0)
        places.append(F.when(F.col(bucket).eqNullSafe(F.lit(r[bucket]).cast(kind)), before))
    return turns.withColumn(name, shown + (F.coalesce(*places) if places else F.lit(0))).drop("_turn")


def group_representatives(df: DataFrame, plan: list[str], group: str, rank: str, row_id: str, sample: int = 3, offer=()) -> DataFrame:
    """First hit of each product group with the number of members, the first others and whether more exist. ``offer`` names
    columns of the others that ``alternative_offers`` gives beside their ids.

    A row without group stands for itself. Groups may be hot: the first ``sample``+1 members come from a limited
    window, the count from a reduction.
    """
    key = F.coalesce(F.concat(F.lit("group:"), F.col(group).cast("string")), F.concat(F.lit("row:"), F.col(row_id).cast("string")))
    keyed = df.withColumn("_key", key)
    counts = keyed.groupBy(*plan, "_key").agg(F.count("*").alias("matching_offers"))
    first = top_per_group(keyed, plan + ["_key"], [rank], sample + 1, "_member")
    sorted_others = F.sort_array(F.collect_list(F.struct("_member", row_id, *offer)))  # at most ``sample`` of a group
    others = first.filter("_member > 1").groupBy(*plan, "_key").agg(sorted_others.alias("_others"))
    heads = first.filter("_member = 1").drop("_member")
    kinds = dict(df.dtypes)
    found = (heads.join(counts, plan + ["_key"]).join(others, plan + ["_key"], "left").drop("_key")
             .withColumn("alternative_ids", F.coalesce(F.transform("_others", lambda s: s[row_id]), F.array().cast(f"array<{kinds[row_id]}>")))
             .withColumn("alternatives_more", F.col("matching_offers") > sample + 1))
    if offer:
        fields = ",".join(f"{c}:{kinds[c]}" for c in (row_id, *offer))
        offers = F.transform("_others", lambda s: F.struct(*[s[c].alias(c) for c in (row_id, *offer)]))
        found = found.withColumn("alternative_offers", F.coalesce(offers, F.array().cast(f"array<struct<{fields}>>")))
    return found.drop("_others")
