"""Hard filters. Each takes the observations and returns the rows that satisfy it; unknown never satisfies.

Conditions on the row's own columns are plain predicates, so Catalyst moves them to the scan. Conditions on other
tables are semi and anti joins on reduced keys, so a product with a million tags is still one key.
"""

from pyspark.sql import Column, DataFrame, functions as F

from sourcemart.functions.prices import PRICE_ROLES, price_basis
from sourcemart.functions.text import all_terms, as_column, no_terms, normalize, normalize_literal, path_prefix
from sourcemart.functions.units import canonical_literal

SCOPE_COLUMN = {"name": "name_norm", "all": "all_norm"}
UNSORTED = "未分类"


def search_terms(query: str) -> list[str]:
    return normalize_literal(query).split()


def by_terms(obs: DataFrame, query: str, scope: str = "name", exclude=()) -> DataFrame:
    """Every word of the query occurs, no excluded term does, in the scope's column."""
    column = SCOPE_COLUMN[scope]
    kept = all_terms(column, search_terms(query)) & no_terms(column, [normalize_literal(t) for t in exclude])
    return obs.filter(kept)


def by_price(obs: DataFrame, amount="amount", minimum=None, maximum=None) -> DataFrame:
    """Closed range; a row without an amount is in no range."""
    if minimum is None and maximum is None:
        return obs
    if minimum is not None and maximum is not None and minimum > maximum:
        raise ValueError("Minimum price exceeds maximum")
    condition = as_column(amount).isNotNull()
    if minimum is not None:
        condition = condition & (as_column(amount) >= F.lit(float(minimum)))
    if maximum is not None:
        condition = condition & (as_column(amount) <= F.lit(float(maximum)))
    return obs.filter(condition)


def in_category(values: list[str], column="category") -> Column:
    """Below any of the given categories. ``column`` holds the normalized category; absent is not below any."""
    condition = F.lit(False)
    for value in values:
        condition = condition | path_prefix(column, normalize_literal(value))
    return F.coalesce(condition, F.lit(False))


def _category_tags(tags: DataFrame) -> DataFrame:
    return tags.filter("kind = 'category'").select("id", normalize("value").alias("tag"))


def by_category(obs: DataFrame, values: list[str], column="category_norm", tags: DataFrame | None = None, key="id") -> DataFrame:
    """In the subtree by the row's own (overlay or source) category or by a category tag."""
    own = in_category(values, column)
    if tags is None:
        return obs.filter(own)
    tagged = (_category_tags(tags).filter(in_category(values, "tag")).select(F.col("id").alias(key)).distinct()
              .withColumn("_tagged", F.lit(True)))
    return obs.join(tagged, key, "left").filter(own | F.col("_tagged").isNotNull()).drop("_tagged")


def without_categories(obs: DataFrame, values: list[str], column="category_norm", source_column="category",
                       overlay: DataFrame | None = None, tags: DataFrame | None = None, key="id") -> DataFrame:
    """Outside every given subtree, and the category is known: overlay, category tag, or a hierarchical source value."""
    known = F.coalesce(F.contains(source_column, F.lit("/")), F.lit(False))
    kept = obs
    if overlay is not None:
        reviewed = overlay.filter("field = 'category'").select(F.col("id").alias(key)).distinct().withColumn("_reviewed", F.lit(True))
        kept = kept.join(reviewed, key, "left")
        known = known | F.col("_reviewed").isNotNull()
    if tags is not None:
        marks = (_category_tags(tags).groupBy(F.col("id").alias(key))
                 .agg(F.lit(True).alias("_tagged"), F.bool_or(in_category(values, "tag")).alias("_excluded")))
        kept = kept.join(marks, key, "left")
        known = known | F.col("_tagged").isNotNull()
        kept = kept.filter(~F.coalesce("_excluded", F.lit(False)))
    return kept.filter(known & ~in_category(values, column)).select(*obs.columns)


def by_tags(obs: DataFrame, tags: DataFrame, wanted: list[str], mode="all", origin=None, synonyms=None, key="id") -> DataFrame:
    """Tags written ``kind:value``; all or any of them, optionally of one origin, each widened by its synonyms, however it
    is written."""
    groups = {(k, normalize_literal(term)): words for (k, term), words in (synonyms or {}).items()}
    widened = lambda kind, value: groups.get((f"tag:{kind}", normalize_literal(value)), [value])
    pairs = [(i, kind, normalize_literal(word)) for i, tag in enumerate(wanted)
             for kind, value in [tag.split(":", 1)] for word in widened(kind, value)]
    value = normalize("value")
    hit = F.array_compact(F.array(*[F.when((F.col("kind") == kind) & (F.col("norm") == word), F.lit(i))
                                    for i, kind, word in pairs]))
    kinds = sorted({kind for _, kind, _ in pairs})
    some = tags.filter(F.col("kind").isin(*kinds))
    if origin:
        some = some.filter(F.col("origin") == origin)
    matched = (some.withColumn("norm", value).select("id", F.explode(hit).alias("want"))
               .groupBy("id").agg(F.count_distinct("want").alias("n"))
               .filter(F.col("n") >= (len(wanted) if mode == "all" else 1)))
    return obs.join(matched.select(F.col("id").alias(key)), key, "left_semi")


def by_attribute(obs: DataFrame, facts: DataFrame, field: str, minimum=None, maximum=None, unit=None, value=None, key="id") -> DataFrame:
    """Source-made attribute: a text value, or a range after conversion of the unit."""
    found = facts.filter((F.col("field") == field) & (F.col("origin") == "source"))
    if value is not None:
        found = found.filter(F.col("number").isNull() & (normalize("value") == normalize_literal(value)))
    else:
        if unit is None or (minimum is None and maximum is None):
            raise ValueError("A measured attribute needs a unit and a bound")
        for bound, low in ((minimum, True), (maximum, False)):
            if bound is not None:
                number, canonical = canonical_literal(bound, unit)
                found = found.filter((F.col("unit") == canonical)
                                     & (F.col("number") >= number if low else F.col("number") <= number))
    return obs.join(found.select(F.col("id").alias(key)), key, "left_semi")


def by_price_label(obs: DataFrame, labels: list[str], label="label") -> DataFrame:
    return obs.filter(as_column(label).isin(*labels))


def on_price_basis(obs: DataFrame, price_field: str, label="label") -> DataFrame:
    """Drop rows whose label names another role than the canonical one asked for; unnamed labels stay."""
    if price_field not in PRICE_ROLES:
        return obs
    return obs.filter(as_column(label).isNotNull() & F.coalesce(price_basis(label) == price_field, F.lit(True)))


def by_terms_of_offer(obs: DataFrame, terms: DataFrame, price_field: str, wanted: dict, key="id") -> DataFrame:
    """terms(id, field, terms map<string,struct<value,quote>>): equality on each named term."""
    found = terms.filter(F.col("field") == price_field)
    for term, value in wanted.items():
        found = found.filter(F.try_element_at("terms", F.lit(term))["value"] == F.lit(str(value)))
    return obs.join(found.select(F.col("id").alias(key)), key, "left_semi")


def current_only(obs: DataFrame, sources: DataFrame) -> DataFrame:
    """Hide rows of withdrawn and superseded sources; a source without state counts as active."""
    return obs.join(sources.filter("state <> 'active'").select("doc_id"), "doc_id", "left_anti")


def fresh_only(obs: DataFrame, stale: DataFrame) -> DataFrame:
    return obs.join(stale.select("doc_id"), "doc_id", "left_anti")


def in_series(obs: DataFrame, sources: DataFrame, series) -> DataFrame:
    return obs.join(sources.filter(F.col("series") == series).select("doc_id"), "doc_id", "left_semi")


def in_group(obs: DataFrame, links: DataFrame, group, key="id") -> DataFrame:
    return obs.join(links.filter(F.col("group_id") == group).select(F.col("id").alias(key)), key, "left_semi")
