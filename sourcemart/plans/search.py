"""One search: hard filters, text terms, an explicit price basis, an order and a page.

The function only composes a plan. Column predicates of the parts reach the part scan, those of the offer the offer
scan; other tables are met on reduced keys; wide columns are kept out of sorts by the top-k step.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from sourcemart.functions.grams import query_grams
from sourcemart.functions.prices import PRICE_ROLES, resolve_price
from sourcemart.functions.text import normalize, normalize_literal, snippet
from sourcemart.operators import filters, lineage
from sourcemart.operators.ranking import numbered, page, price_order, top_per_group
from sourcemart.operators.textindex import WEIGHT, bm25, corpus_statistics

SORTS = ("relevance", "price-asc", "price-desc")


@dataclass
class Pool:
    """The frames a search may use. ``item_key`` is the observation column that tags, facts and links refer to.

    observations: id, doc_id, record_key, name, brand, category, *_norm columns, prices map.
    synonyms: (kind, term) -> list of displays, a small driver-side dictionary looked up for the query's own words.
    offers: price role -> the observations with a price of that role as ``price`` and ``amount``, or None where the source of
    the observations can't tell them apart before it reads them.
    """
    observations: DataFrame
    sources: DataFrame | None = None
    tags: DataFrame | None = None
    facts: DataFrame | None = None
    links: DataFrame | None = None
    terms: DataFrame | None = None
    stale: DataFrame | None = None
    synonyms: dict | None = None
    item_key: str = "id"
    offers: Callable[[str], DataFrame | None] | None = None

    def words(self, kind: str, term: str) -> list[str]:
        return (self.synonyms or {}).get((kind, normalize_literal(term)), [term])


def lookup_synonyms(table: DataFrame, wanted: list[tuple[str, str]]) -> dict:
    """Groups of the asked (kind, term) pairs only; a query has at most ten words and a group at most eight terms."""
    asked = F.lit(False)
    for kind, term in wanted:
        asked = asked | ((F.col("kind") == kind) & (F.col("term") == normalize_literal(term)))
    groups = table.filter(asked).select("kind", F.col("term").alias("asked"), "group_key")
    rows = groups.join(table.select("kind", "group_key", "term", "display"), ["kind", "group_key"]).collect()
    found = {}
    for row in sorted(rows, key=lambda r: r["term"]):
        found.setdefault((row["kind"], row["asked"]), []).append(row["display"])
    return found


def with_overlay(pool: Pool, obs: DataFrame | None = None) -> DataFrame:
    """Overlay values win over the source's for category, brand and supplier, also in the normalized columns.

    The overlay is normalized on its own few rows, not on every observation.
    """
    obs = pool.observations if obs is None else obs
    if pool.facts is None:
        return obs
    fields = [f for f in ("category", "brand", "supplier") if f in obs.columns]
    wide = pool.facts.filter(F.col("field").isin(*fields)).groupBy(F.col("id").alias(pool.item_key)).agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"_{f}") for f in fields])
    merged = obs.join(wide.select("*", *[normalize(f"_{f}").alias(f"_{f}_norm") for f in fields]), pool.item_key, "left")
    for f in fields:
        known = F.col(f"_{f}").isNotNull()
        merged = merged.withColumn(f, F.when(known, F.col(f"_{f}")).otherwise(F.col(f).cast("string")))
        if f"{f}_norm" in obs.columns:
            merged = merged.withColumn(f"{f}_norm", F.when(known, F.col(f"_{f}_norm")).otherwise(F.col(f"{f}_norm")))
    return merged.drop(*[f"_{f}" for f in fields], *[f"_{f}_norm" for f in fields])


def hard_filter(pool: Pool, *, exclude=(), scope="name", price_field=None, minimum=None, maximum=None, category=None,
                categories=(), exclude_categories=(), brand=None, supplier=None, has_image=False, source=None, series=None,
                tags=(), tag_mode="all", tag_origin=None, tag_groups=(), attributes=(), latest=False, include_history=False,
                price_labels=(), price_terms=None, product_group=None, sort="relevance") -> DataFrame:
    """Observations that satisfy every hard condition, with ``price`` and ``amount`` of the asked price field."""
    if latest and include_history:
        raise ValueError("latest and include_history cannot be combined")
    if sort not in SORTS:
        raise ValueError("Unsupported sort")
    if (minimum is not None or maximum is not None or sort != "relevance" or price_labels or price_terms) and not price_field:
        raise ValueError("Prices need an explicit price field")
    key = pool.item_key
    # A canonical role keeps only rows that have its price, so they may be chosen where they are read.
    offered = pool.offers(price_field) if pool.offers and price_field in PRICE_ROLES else None
    obs = with_overlay(pool, offered)
    if price_field:
        # explode of a one-element array keeps every row and makes the price a column of its own; as a plain
        # expression it would be worked out again in every condition that reads it.
        if offered is None:
            obs = obs.withColumn("price", F.explode(F.array(resolve_price("prices", price_field)))).withColumn("amount", F.col("price")["amount"])
        obs = filters.by_price(obs, "amount", minimum, maximum)
        if price_labels:
            obs = filters.by_price_label(obs, list(price_labels), F.col("price")["label"])
        else:
            obs = filters.on_price_basis(obs, price_field, F.col("price")["label"])
        if price_terms:
            obs = filters.by_terms_of_offer(obs, pool.terms, price_field, price_terms, key)
    if exclude:
        obs = obs.filter(filters.no_terms(filters.SCOPE_COLUMN[scope], [normalize_literal(t) for t in exclude]))
    for value in ([category] if category else []) + list(categories):
        obs = filters.by_category(obs, pool.words("category", value), tags=pool.tags, key=key)
    if exclude_categories:
        words = [w for c in exclude_categories for w in pool.words("category", c)]
        obs = filters.without_categories(obs, words, overlay=pool.facts, tags=pool.tags, key=key)
    for field, value in (("brand", brand), ("supplier", supplier)):
        if value:
            obs = obs.filter(F.col(f"{field}_norm").isin(*[normalize_literal(w) for w in pool.words(field, value)]))
    if has_image:
        obs = obs.filter("has_image")
    if source is not None:
        obs = obs.filter(F.col("doc_id") == source)
    if product_group is not None:
        obs = filters.in_group(obs, pool.links, product_group, key)
    for group in [{"tags": list(tags), "mode": tag_mode, "origin": tag_origin}, *tag_groups]:
        if group.get("tags"):
            obs = filters.by_tags(obs, pool.tags, group["tags"], group.get("mode", "all"), group.get("origin"), pool.synonyms, key)
    for condition in attributes:
        obs = filters.by_attribute(obs, pool.facts, key=key, **condition)
    if pool.stale is not None:
        obs = filters.fresh_only(obs, pool.stale)
    if pool.sources is not None:
        if latest:
            obs = lineage.latest_only(obs, pool.sources)
        elif not include_history:
            obs = filters.current_only(obs, pool.sources)
        if series is not None:
            obs = filters.in_series(obs, pool.sources, series)
    return obs


def hits(pool: Pool, query="", scope="name", sort="relevance", **hard) -> DataFrame:
    """Every match, unordered, with ``amount`` (asked price), ``score`` (text relevance) where there are terms."""
    kept = hard_filter(pool, scope=scope, sort=sort, **hard)
    terms = filters.search_terms(query)
    if not terms:
        return kept
    column = filters.SCOPE_COLUMN[scope]
    if sort != "relevance":
        return kept.filter(filters.all_terms(column, terms))
    # Statistics are those of the whole pool, not of what the filters leave.
    occurrences = [g for t in terms for g in query_grams(t)]
    distinct = sorted(set(occurrences))
    stats = corpus_statistics(pool.observations, [column], distinct).first()
    holding = {g: stats[f"n0_{j}"] for j, g in enumerate(distinct)}
    score = bm25("gram_count", WEIGHT[column], stats["rows"], stats["grams"] or 0.0, [holding[g] for g in occurrences])
    return kept.filter(filters.all_terms(column, terms)).withColumn("score", score)


def search(pool: Pool, query="", scope="name", sort="relevance", limit=10, offset=0, price_field=None, **hard) -> DataFrame:
    """One page of results, shaped for display.

    Without terms, results browse: the first of every category, then the second of every category, and so on.
    """
    found = hits(pool, query, scope, sort, price_field=price_field, **hard)
    terms = filters.search_terms(query)
    if sort != "relevance":
        result = page(found, [price_order("amount", sort == "price-desc"), "id"], limit, offset)
    elif terms:
        result = page(found, ["score", "id"], limit, offset)
    else:
        result = page(browse_rank(found, limit + offset), ["browse_rank", "doc_id", "record_key", "id"], limit, offset)
    if terms and scope == "all":
        result = result.withColumn("evidence", snippet("name_norm", "all_norm", terms))
    return result


def browse_rank(obs: DataFrame, k: int | None = None) -> DataFrame:
    """Place of a row within its category, in source order. With ``k`` only what a page of k rows can hold."""
    order = ["doc_id", "record_key", "id"]
    if k is not None:
        return top_per_group(obs, ["category"], order, k, "browse_rank")
    return numbered(obs, ["category"], order, "browse_rank")


def enrich_hits(hits: DataFrame, tags: DataFrame, facts: DataFrame, key="id", shown: int = 5) -> DataFrame:
    """A page of hits with tags (first five and their number), overlay values with their origin, and attributes.

    Tags and facts are cut to the page's few products before anything is gathered; the gathered tags are limited
    per product in the window, the rest is only counted.
    """
    wanted = hits.select(F.col(key).alias("id")).distinct()
    own_tags, own_facts = tags.join(wanted, "id", "left_semi"), facts.join(wanted, "id", "left_semi")
    counts = own_tags.groupBy(F.col("id").alias(key)).agg(F.count("*").alias("tag_count"))
    first = (top_per_group(own_tags, ["id"], ["kind", "value", "origin"], shown, "_n").groupBy(F.col("id").alias(key))
             .agg(F.sort_array(F.collect_list(F.struct("kind", "value", "origin"))).alias("tags")))
    fields = [f for f in ("category", "brand", "supplier") if f in hits.columns]
    wide = own_facts.groupBy(F.col("id").alias(key)).agg(
        *[F.max(F.when(F.col("field") == f, F.struct("value", "origin"))).alias(f"_{f}") for f in fields],
        F.map_from_entries(F.collect_list(F.when(F.col("field").startswith("attr."), F.struct(
            "field", F.struct("value", "number", "unit", "origin"))))).alias("attributes"))
    merged = hits.join(counts, key, "left").join(first, key, "left").join(wide, key, "left")
    for f in fields:
        merged = (merged.withColumn(f"{f}_origin", F.coalesce(F.col(f"_{f}.origin"), F.lit("source")))
                  .withColumn(f, F.coalesce(F.col(f"_{f}.value"), F.col(f).cast("string"))).drop(f"_{f}"))
    return (merged.withColumn("tag_count", F.coalesce("tag_count", F.lit(0)))
            .withColumn("tags", F.coalesce("tags", F.array().cast("array<struct<kind:string,value:string,origin:string>>"))))


def details(wanted: DataFrame, obs: DataFrame, sources: DataFrame, tags: DataFrame, key="id") -> tuple[DataFrame, DataFrame]:
    """wanted(position, id) -> (full rows with source state and tag count, unknown or repeated ids)."""
    repeated = wanted.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit("repeated").alias("problem"))
    unknown = wanted.join(obs.select("id"), "id", "left_anti").select("id", F.lit("unknown").alias("problem"))
    rows = wanted.join(obs, "id").join(sources, "doc_id", "left")
    counts = tags.groupBy(F.col("id").alias(key)).agg(F.count("*").alias("tag_count"))
    return (rows.join(counts, key, "left").withColumn("tag_count", F.coalesce("tag_count", F.lit(0))), unknown.unionByName(repeated))
