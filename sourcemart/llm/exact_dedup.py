"""Exact deduplication by a tree merge of sorted digest runs (DataFrame functions only).

Every scan partition yields one run: the digests it holds, each with the best row and the number of rows. Runs then meet in
binomial rounds: in a round, ``fan_in`` neighbouring runs exchange rows by (run group, digest), are sorted and merged, and
each digest keeps its best row. After the last round there is one run group, still spread over all partitions by digest.
A group of any size shrinks to one row per run before the first exchange, so a hot digest costs as much as any other.
"""

from pyspark.sql import Column, DataFrame, functions as F

from sourcemart.llm.common import broadcast_if, free_name, settle

RUNS = 512  # scan partitions are folded onto this many runs: a power of FAN_IN
FAN_IN = 8
SPACE = r"[\x20\x09-\x0D]+"
BROADCAST_ROWS = 1_000_000  # ids; 8 to 16 MB


def normalised(text: Column) -> Column:
    """The text without any ASCII white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def _merge(runs: DataFrame) -> DataFrame:
    """Equal digests of a run group become one row: the best row by (most characters, smallest id), all rows counted."""
    return runs.groupBy("run", "sha", "size").agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def digest_groups(docs: DataFrame, id_col="doc_id", text_col="text", runs=RUNS, fan_in=FAN_IN) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): each row with its digest, and per digest its best row and size.

    Digests count as equal when the SHA-256 and the length of the normalised text agree.
    """
    whole = F.coalesce(F.col(text_col), F.lit(""))
    marked = docs.select(
        F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text"), F.length(whole).alias("chars"),
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    rows = settle(marked.select(
        "id", "row", (F.col("part") % runs).alias("run"), F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("sha"),
        F.length("text").alias("size"), "chars"), "digests")
    level = _merge(rows.select("run", "sha", "size", F.lit(1).cast("long").alias("n"), F.struct(
        (-F.col("chars")).alias("chars"), F.col("id").isNull().alias("unknown"), "id", "row").alias("best")))
    left = runs
    while left > 1:
        left = -(-left // fan_in)
        exchanged = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).repartition("run", "sha", "size")
        level = _merge(exchanged.sortWithinPartitions("run", "sha", "size"))
    return rows, level.select("sha", "size", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"),
                              F.col("n").alias("group_size"))


def exact_duplicates(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Null texts are empty texts, and all texts of white space are equal to them. Of equal texts the one with the most code
    points stays, then the smallest id; a null id loses to any other, and of rows repeated whole one stays. Other columns,
    whatever their names, are not read. No rows give no rows.
    """
    rows, groups = digest_groups(docs, id_col, text_col)
    return rows.join(groups, ["sha", "size"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Texts don't travel: the rows that go are found by id and dropped where they are read. Ids that occur more than once
    (or are null) don't name a row; only for those, texts are compared again beside the best row of their group.
    """
    found = settle(exact_duplicates(docs, id_col, text_col), "copies").select(
        F.col(id_col).alias("_id"), F.col("kept").alias("_kept"), F.col("text_sha256").alias("_sha"))
    per_id = found.groupBy("_id").agg(F.count("*").alias("_n"), F.max("_kept").alias("_any"))
    unclear = settle(per_id.filter("_n > 1 or _id is null").select("_id"), "unclear")
    gone = settle(per_id.filter("_n = 1 and _id is not null and not _any").select("_id"), "gone")
    mine, sha_name = free_name(docs, "_id"), free_name(docs, "_text_sha")
    same = F.col(id_col).eqNullSafe(F.col(mine))
    ids = lambda found: broadcast_if(found.withColumnRenamed("_id", mine), BROADCAST_ROWS)
    out = docs.join(ids(gone), F.col(id_col) == F.col(mine), "left_anti")
    if unclear.isEmpty():
        return out
    sha = F.sha2(F.encode(normalised(F.col(text_col)), "UTF-8"), 256)
    kept = found.filter("_kept").select(F.col("_id").alias(mine), F.col("_sha").alias(sha_name + "_kept")).distinct()
    again = docs.join(ids(unclear), same, "left_semi").withColumn(sha_name, sha)
    again = again.join(kept, same & (F.col(sha_name) == F.col(sha_name + "_kept")), "left_semi")
    chars = F.length(F.coalesce(F.col(text_col), F.lit("")))
    best = again.groupBy(sha_name).agg(F.max_by(F.struct(*docs.columns), chars).alias("_row"))
    return out.join(ids(unclear), same, "left_anti").unionByName(best.select("_row.*"))
