"""Counts for orientation: facets, statistics, coverage. All are reductions with partial results before the shuffle."""

from pyspark.sql import Column, DataFrame, functions as F

from sourcemart.functions.prices import basis_conflict
from sourcemart.operators.overlay import lacks


def facet(obs: DataFrame, field: str, query: str = "") -> DataFrame:
    """value, count of each non-empty value that holds the query literally."""
    value = F.col(field).cast("string")
    return (obs.filter((value != "") & F.contains(value, F.lit(query)))
            .groupBy(value.alias("value")).agg(F.count("*").alias("count")))


def facet_order(facets: DataFrame) -> list:
    return [F.col("count").desc(), F.col("value").asc()]


def price_facet(prices: DataFrame, query: str = "") -> DataFrame:
    """Per (field, label) the number of usable amounts."""
    kept = prices.filter(F.contains("field", F.lit(query)) | F.contains("label", F.lit(query)))
    return kept.groupBy("field", "label").agg(F.count("amount").alias("numeric_count"))


def category_facet(obs: DataFrame, tags: DataFrame, query_norm: str = "", value_norm="value") -> DataFrame:
    """Products per category over the row's own category and category tags; a product counts once per category.

    Distinct (category, product) pairs are reduced first, so the hot category's products spread over all tasks.
    """
    both = (obs.select("id", F.col("category").alias("value"))
            .unionByName(tags.filter("kind = 'category'").select("id", "value")))
    return (both.filter((F.col("value") != "") & F.contains(F.lower(F.col(value_norm)), F.lit(query_norm)))
            .distinct().groupBy("value").agg(F.count("*").alias("count")))


def tag_facet(tags: DataFrame, kind: str | None = None, query: str = "") -> DataFrame:
    kept = tags.filter(F.contains("value", F.lit(query)))
    if kind:
        kept = kept.filter(F.col("kind") == kind)
    return kept.groupBy("kind", "value", "origin").agg(F.count("*").alias("count"))


def stats(obs: DataFrame, source_key="doc_id") -> DataFrame:
    """One row: products, sources, categories, brands. Each distinct count is over its own reduced key set."""
    return obs.agg(F.count("*").alias("products"), F.count_distinct(source_key).alias("sources"),
                   F.count_distinct("category").alias("categories"), F.count_distinct("brand").alias("brands"))


def price_coverage(prices: DataFrame, products: DataFrame, field: str) -> DataFrame:
    """One row: numeric amounts of a field, unusable (products without one), rows whose label names another role."""
    zero = F.lit(0).cast("long")
    conflict = F.count_if(F.coalesce(basis_conflict("field", "label"), F.lit(False)))
    offered = prices.filter(F.col("field") == field).agg(
        F.count("amount").alias("numeric"), zero.alias("total"), conflict.alias("basis_conflicts"))
    total = products.agg(zero.alias("numeric"), F.count("*").alias("total"), zero.alias("basis_conflicts"))
    return offered.unionByName(total).agg(
        F.sum("numeric").alias("numeric"), (F.sum("total") - F.sum("numeric")).alias("unusable"),
        F.sum("basis_conflicts").alias("basis_conflicts"))


def quality(obs: DataFrame, facts: DataFrame, tags: DataFrame, sources: DataFrame, links: DataFrame) -> DataFrame:
    """Whole-pool coverage as (metric, n) rows, from one reduction per product and one per series.

    What observations, facts, tags and links say about a product meets in one row of sums and flags; sources meet per
    series and date. Every input is read once.
    """
    fields = ("brand", "supplier", "category")
    by_rule = F.coalesce((F.col("category_origin") == "rule") & F.contains("category", F.lit("/")), F.lit(False)) if "category_origin" in obs.columns else F.lit(False)
    source = lambda f: F.col(f).cast("string") if f in obs.columns else F.lit(None).cast("string")
    one, no, unknown = F.lit(1).cast("long"), F.lit(0).cast("long"), F.lit(None).cast("string")

    def said(frame, **own):
        blank_row = {"rows": no, "unruled": no, "tagged": no, "enriched": no, "linked": no, "reviewed": no, **{f"lacks_{f}": no for f in fields}, **{f"own_{f}": unknown for f in fields}}
        return frame.select("id", *[c.alias(n) for n, c in {**blank_row, **own}.items()])

    rows = said(obs, rows=one, unruled=(~by_rule).cast("long"), **{f"lacks_{f}": lacks(source(f)).cast("long") for f in fields})
    rows = rows.unionByName(said(facts, enriched=one, reviewed=(F.col("field") == "category").cast("long"), **{f"own_{f}": F.when(F.col("field") == f, F.col("value")) for f in fields}))
    rows = rows.unionByName(said(tags, tagged=one)).unionByName(said(links, linked=one))
    sums = ["rows", "unruled", "linked", *[f"lacks_{f}" for f in fields]]
    product = rows.groupBy("id").agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in ("tagged", "enriched", "reviewed")], *[F.max(f"own_{f}").alias(f"own_{f}") for f in fields])
    missing = lambda f: F.when(F.col(f"own_{f}").isNull(), F.col(f"lacks_{f}")).when(lacks(f"own_{f}"), F.col("rows")).otherwise(0)
    products = {"products": F.sum("rows"), **{f"missing_{f}": F.sum(missing(f)) for f in fields}, "tagged_products": F.sum("tagged"), "enriched_products": F.sum("enriched"),
                "grouped_products": F.sum("linked"), "categories_needing_review": F.sum(F.when(F.col("reviewed") == 0, F.col("unruled")).otherwise(0))}
    return _as_metrics(product, products).unionByName(_as_metrics(*_series_metrics(sources)))


def _series_metrics(sources: DataFrame) -> tuple[DataFrame, dict]:
    active, open_file = F.col("state") == "active", F.col("import_status") != "ready"
    unversioned = (F.coalesce("state", F.lit("active")) == "active") & (F.col("series").isNull() | F.col("issued_on").isNull())
    dated = sources.groupBy("series", "issued_on").agg(
        F.count_if(active).alias("n"), F.count_if(active & open_file).alias("partial"), F.count_if(open_file).alias("incomplete"), F.count_if(unversioned).alias("unversioned"))
    undated = F.when(F.col("issued_on").isNull(), F.col("n")).otherwise(0)
    newest = F.max(F.when((F.col("n") > 0) & F.col("issued_on").isNotNull(), F.struct("issued_on", "n", "partial")))
    series = dated.groupBy("series").agg(newest.alias("newest"), F.sum(undated).alias("undated"), F.sum("incomplete").alias("incomplete"), F.sum("unversioned").alias("unversioned"))
    known = F.col("series").isNotNull()
    ambiguous = known & ((F.col("undated") > 0) | F.coalesce(F.col("newest.n") > 1, F.lit(False)))
    return series, {"incomplete_files": F.sum("incomplete"), "sources_without_version": F.sum("unversioned"), "ambiguous_quote_series": F.count_if(ambiguous),
                    "partial_newest_quotes": F.sum(F.when(known, F.coalesce("newest.partial", F.lit(0))).otherwise(0))}


def _as_metrics(frame: DataFrame, metrics: dict) -> DataFrame:
    wide = frame.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in metrics.items()])
    return wide.unpivot([], list(metrics), "metric", "n")


# Warnings of a retrieval, in order, each with the condition it reports.
def coverage_warnings(coverage, hard: dict, price: dict | None = None, unknown_terms=False, clipped=False, group_clipped=False):
    """Warnings as an array column over a one-row coverage frame with the metrics as columns. Flags are values or columns."""
    bounded = "minimum" in hard or "maximum" in hard
    price = price or {}
    latest = F.lit(bool(hard.get("latest")))

    def some(name):
        return F.col(name) > 0

    def flag(value):
        return value if isinstance(value, Column) else F.lit(bool(value))

    rules = [
        (some("missing_brand") | some("missing_supplier") | some("missing_category"), "incomplete_metadata"),
        (some("incomplete_files"), "partial_source_imports"),
        (F.lit(bool(price)) & (F.col("unusable") > 0) if price else F.lit(False),
         "unknown_or_complex_prices_excluded_from_budget" if bounded else "some_prices_unusable_for_comparison"),
        (F.col("basis_conflicts") > 0 if price else F.lit(False), "legacy_price_role_conflicts_use_verified_source_labels"),
        (latest & some("sources_without_version"), "unknown_source_versions_excluded"),
        (latest & some("ambiguous_quote_series"), "ambiguous_quote_series_excluded"),
        (latest & some("partial_newest_quotes"), "newest_source_incomplete"),
        (F.lit(bool(hard.get("exclude_categories"))), "unknown_categories_excluded_from_negative_filter"),
        (F.lit(bool(hard.get("attributes"))), "unknown_attributes_do_not_satisfy_hard_conditions"),
        (flag(unknown_terms), "some_quote_terms_unknown"),
        (flag(clipped), "bounded_candidates_not_exhaustive"),
        (flag(group_clipped), "group_offers_clipped_use_paginated_search"),
    ]
    return coverage.select("*", F.array_compact(F.array(*[F.when(c, F.lit(word)) for c, word in rules])).alias("warnings"))
