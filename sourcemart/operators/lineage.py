"""Quote series: which source is current, which is latest, what replaces what."""

from pyspark.sql import DataFrame, Window, functions as F

from sourcemart.functions.text import date_in_quote, normalize
from sourcemart.operators.ranking import latest


def series_heads(sources: DataFrame) -> DataFrame:
    """Per series over active sources: newest date, how many sources have it, how many have no date.

    Dates are counted first and the counts reduced per series, so a hot series shrinks to its distinct dates.
    """
    active = sources.filter("state = 'active' AND series IS NOT NULL")
    dated = active.groupBy("series", "issued_on").agg(F.count("*").alias("n"))
    return dated.groupBy("series").agg(
        F.max("issued_on").alias("newest"),
        F.coalesce(F.max_by("n", "issued_on"), F.lit(0)).alias("at_newest"),
        F.coalesce(F.sum(F.when(F.col("issued_on").isNull(), F.col("n"))), F.lit(0)).alias("undated"))


def latest_sources(sources: DataFrame) -> DataFrame:
    """Active, dated, fully imported, and no other active source of the series is undated or as new. Ties: none."""
    heads = series_heads(sources).filter("undated = 0 AND at_newest = 1").select("series", F.col("newest").alias("issued_on"))
    return (sources.filter("state = 'active' AND import_status = 'ready'")
            .join(heads, ["series", "issued_on"], "left_semi"))


def latest_only(obs: DataFrame, sources: DataFrame) -> DataFrame:
    return obs.join(latest_sources(sources).select("doc_id"), "doc_id", "left_semi")


def ambiguous_series(sources: DataFrame) -> DataFrame:
    return series_heads(sources).filter("undated > 0 OR at_newest > 1").select("series")


def partial_newest(sources: DataFrame) -> DataFrame:
    """Newest active sources of their series that are not fully imported."""
    heads = series_heads(sources).select("series", F.col("newest").alias("issued_on"))
    return (sources.filter("state = 'active' AND import_status <> 'ready'")
            .join(heads, ["series", "issued_on"], "left_semi"))


def without_version(sources: DataFrame) -> DataFrame:
    return sources.filter("coalesce(state, 'active') = 'active' AND (series IS NULL OR issued_on IS NULL)")


def nearest_earlier(sources: DataFrame) -> DataFrame:
    """Each dated source with the newest strictly earlier date of its series and the lowest source id on that date.

    Dates are made distinct first, so what a series brings to one task is bounded by the calendar: a row a day.
    """
    dates = (sources.filter("series IS NOT NULL AND issued_on IS NOT NULL")
             .groupBy("series", "issued_on").agg(F.min("doc_id").alias("first_doc")))
    before = Window.partitionBy("series").orderBy("issued_on")
    chain = dates.select("series", "issued_on", F.lag("issued_on").over(before).alias("earlier_on"), F.lag("first_doc").over(before).alias("earlier_doc"))
    return sources.join(chain, ["series", "issued_on"], "left")


def current_state(log: DataFrame) -> DataFrame:
    """Append-only source log -> last revision per source."""
    return latest(log, ["doc_id"], ["revision"])


def classify_updates(current: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(doc_id, revision, status, series, issued_on, supersedes, supersedes_revision) with an outcome.

    ``current``: doc_id, revision, series, issued_on, state, import_status. Null request fields mean unchanged.
    """
    old = current.select("doc_id", *[F.col(c).alias(f"old_{c}") for c in ("revision", "series", "issued_on", "state", "import_status")])
    other = current.select(F.col("doc_id").alias("supersedes"),
                           *[F.col(c).alias(f"other_{c}") for c in ("revision", "series", "issued_on")])
    repeated = requests.groupBy("doc_id").agg(F.count("*").alias("n"))
    known = requests.join(repeated, "doc_id").join(old, "doc_id", "left").join(other, "supersedes", "left")
    after_state = F.coalesce("status", "old_state")
    after_series = F.coalesce("series", "old_series")
    after_date = F.coalesce("issued_on", "old_issued_on")
    replaces = F.col("supersedes").isNotNull()
    outcome = F.coalesce(
        F.when(F.col("old_revision").isNull(), "unknown_source"),
        F.when(F.col("n") > 1, "duplicate_source"),
        F.when(F.coalesce(F.col("status"), F.lit("active")).isin("active", "withdrawn") == F.lit(False), "use_supersedes"),
        F.when(F.col("revision") != F.col("old_revision"), "revision_conflict"),
        F.when(replaces & (F.col("supersedes") == F.col("doc_id")), "supersedes_itself"),
        F.when(replaces & ~F.col("supersedes_revision").eqNullSafe(F.col("other_revision")), "superseded_revision_conflict"),
        F.when(replaces & (F.col("old_import_status") != "ready"), "partial_import"),
        F.when(replaces & ~F.coalesce((after_state == "active") & (after_series == F.col("other_series"))
                                      & (after_date > F.col("other_issued_on")), F.lit(False)), "not_newer_in_series"),
        F.lit("applied"))
    return known.select(*requests.columns, "old_revision", after_state.alias("after_state"), after_series.alias("after_series"),
                        after_date.alias("after_issued_on"), outcome.alias("outcome"))


def state_rows(current: DataFrame, classified: DataFrame) -> DataFrame:
    """Log rows of an accepted batch: each updated source, and each source it retires, one revision on."""
    done = classified.filter("outcome = 'applied'")
    updated = done.select("doc_id", (F.col("old_revision") + 1).alias("revision"), F.col("after_series").alias("series"),
                          F.col("after_issued_on").alias("issued_on"), F.col("after_state").alias("state"),
                          F.lit(None).cast(dict(classified.dtypes)["doc_id"]).alias("superseded_by"))
    retired = (done.filter("supersedes IS NOT NULL")
               .select(F.col("supersedes").alias("doc_id"), F.col("doc_id").alias("superseded_by"))
               .join(current.select("doc_id", "revision", "series", "issued_on"), "doc_id")
               .select("doc_id", (F.col("revision") + 1).alias("revision"), "series", "issued_on",
                       F.lit("superseded").alias("state"), "superseded_by"))
    return updated.unionByName(retired)


def dated_evidence(requests: DataFrame) -> DataFrame:
    """requests(doc_id, issued_on, quotes array) -> those whose date stands in no quote."""
    quotes = requests.select("doc_id", "issued_on", F.explode_outer("quotes").alias("quote"))
    found = (quotes.withColumn("norm", normalize("quote"))
             .groupBy("doc_id", "issued_on").agg(F.bool_or(date_in_quote("issued_on", "norm")).alias("found")))
    return found.filter("issued_on IS NOT NULL AND NOT found").select("doc_id", "issued_on")
