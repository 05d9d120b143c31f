"""Judgements beside the sources: append-only logs, current views, and writes that are checked before they happen."""

from pyspark.sql import Column, DataFrame, functions as F

from sourcemart.functions.text import as_column, near_equal, normalize
from sourcemart.functions.units import quantities, to_canonical, whole_quantity
from sourcemart.operators.ranking import latest

FACT = ["value", "number", "unit", "origin", "quote", "reason"]
FIELD_SHAPE = "^(brand|category|supplier|attr\\.[a-z][a-z0-9_]{0,39})$"
UNSORTED = "未分类"
# Labels that state a field explicitly.
STATED_LABELS = {
    "brand": "品牌|brand", "supplier": "供应商|供货商|supplier", "attr.capacity": "容量|capacity",
    "attr.weight": "净重|重量|weight", "attr.power": "功率|power", "attr.material": "材质|material",
}
MEASURED = ["attr.capacity", "attr.weight", "attr.power"]


# -- current views -----------------------------------------------------------------------------------------------

def current_facts(log: DataFrame) -> DataFrame:
    """Last revision per (id, field); a cleared fact (null value) is gone."""
    return latest(log, ["id", "field"], ["revision"]).filter("value IS NOT NULL")


def revisions(log: DataFrame) -> DataFrame:
    return log.groupBy("id").agg(F.max("revision").alias("revision"))


def profiles(log: DataFrame) -> DataFrame:
    """Revision and map of current facts per product, the number shown instead of the text where there is one."""
    shown = F.coalesce(F.col("number").cast("string"), F.col("value"))
    facts = current_facts(log).groupBy("id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", F.struct(shown.alias("value"), "unit", "origin"))))).alias("facts"))
    return revisions(log).join(facts, "id", "left")


def effective(obs: DataFrame, facts: DataFrame, fields=("category", "brand", "supplier"), key="id") -> DataFrame:
    """Overlay value where there is one, else the source's. One reduced row per product joins once for all fields."""
    wide = facts.filter(F.col("field").isin(*fields)).groupBy(F.col("id").alias(key)).agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"_{f}") for f in fields])
    merged = obs.join(wide, key, "left")
    for f in fields:
        source = F.col(f) if f in obs.columns else F.lit(None).cast("string")
        merged = merged.withColumn(f, F.coalesce(F.col(f"_{f}"), source.cast("string"))).drop(f"_{f}")
    return merged


def needs_category_review(obs: DataFrame, facts: DataFrame) -> DataFrame:
    """No overlay category, and the source's is not a hierarchy made by a rule."""
    reviewed = facts.filter("field = 'category'").select("id")
    by_rule = F.coalesce((F.col("category_origin") == "rule") & F.contains("category", F.lit("/")), F.lit(False))
    return obs.filter(~by_rule).join(reviewed, "id", "left_anti")


def lacks(column) -> Column:
    value = as_column(column)
    return value.isNull() | value.isin("", UNSORTED)


def review_queue(obs: DataFrame, facts: DataFrame, field: str) -> DataFrame:
    if field == "category":
        return needs_category_review(obs, facts)
    return effective(obs, facts, (field,)).filter(lacks(field))


# -- facts ---------------------------------------------------------------------------------------------------------

def validate_facts(records: DataFrame, products: DataFrame) -> DataFrame:
    """records(id, revision, field, value, number, unit, origin, quote, reason) with ``problem`` (null: sound).

    products(id, own_text). Every fact must quote its own product; a measured value must stand in the quote.
    """
    joined = records.join(products.select("id", "own_text"), "id", "left")
    joined = (joined.withColumn("_quote", normalize("quote")).withColumn("_value", normalize("value"))
              .withColumn("_unit", normalize("unit")))
    measured = F.col("unit").isNotNull()
    # A column of its own: it is read many times below.
    joined = joined.withColumn("_canonical", to_canonical(F.col("number"), F.col("_unit")))
    canonical = F.col("_canonical")
    stated = F.exists(quantities("_quote"), lambda q: (q["unit"] == canonical["unit"]) & near_equal(q["number"], canonical["number"]))
    clears = F.col("value").isNull() & F.col("number").isNull()
    literal = (F.col("origin") == "source") | (F.col("field") != "category")
    problem = F.coalesce(
        F.when(F.col("own_text").isNull(), "unknown_product"),
        F.when(~F.col("field").rlike(FIELD_SHAPE), "bad_field"),
        F.when(~F.coalesce(F.length("quote").between(1, 1000) & F.contains("own_text", "quote"), F.lit(False)), "quote_not_in_source"),
        F.when(~F.coalesce(F.col("origin").isin("source", "inferred") & F.length("reason").between(1, 500), F.lit(False)), "bad_origin_or_reason"),
        F.when(clears, F.when(measured, "unit_without_value")),
        F.when(measured & ~clears & (~F.col("field").startswith("attr.") | (F.col("origin") != "source")), "measured_needs_source"),
        F.when(measured & ~clears & canonical.isNull(), "unsupported_quantity"),
        F.when(measured & ~clears & ~F.coalesce(stated, F.lit(False)), "quantity_not_in_quote"),
        F.when(~measured & ~clears & ~F.length(F.trim("value")).between(1, 160), "bad_value"),
        F.when(~measured & ~clears & literal & ~F.contains("_quote", "_value"), "value_not_in_quote"))
    number = F.when(measured, canonical["number"])
    # Settled before the columns it reads are renamed: inside a lambda a name may mean the new column of the same select.
    settled = joined.withColumn("problem", problem)
    return settled.select(
        "id", "revision", "field", F.when(measured, number.cast("string")).otherwise(F.trim("value")).alias("value"),
        number.alias("number"), F.when(measured, canonical["unit"]).alias("unit"), "origin", "quote", "reason", "problem")


def classify_enrich(current: DataFrame, revs: DataFrame, records: DataFrame) -> DataFrame:
    """Checked fact rows with ``changed`` and the product's outcome: unchanged, applied, conflict or invalid.

    Identical facts are unchanged even at an old revision; a change needs the current revision.
    """
    old = current.select("id", "field", *[F.col(c).alias(f"_{c}") for c in FACT], F.lit(True).alias("_had"))
    same = F.lit(True)
    for c in FACT:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    clears = F.col("value").isNull()
    changed = F.when(clears, F.col("_had").isNotNull()).otherwise(~(F.col("_had").isNotNull() & same))
    rows = records.join(old, ["id", "field"], "left").withColumn("changed", changed)
    identity = F.lit(False)
    for c in ("value", "number", "unit"):
        identity = identity | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    rows = rows.withColumn("identity", F.col("changed") & identity
                           & (F.col("field").isin("brand", "category") | F.col("field").startswith("attr.")))
    rows = rows.drop("_had", *[f"_{c}" for c in FACT])
    verdict = (rows.groupBy("id").agg(F.bool_or(F.col("problem").isNotNull()).alias("_bad"), F.bool_or("changed").alias("_any"),
                                      F.max("revision").alias("_asked"), F.count("*").alias("_n"),
                                      F.count_distinct("field").alias("_fields"))
               .join(revs.select("id", F.col("revision").alias("_now")), "id", "left")
               .select("id", F.coalesce("_now", F.lit(0)).alias("current_revision"),
                       F.when(F.col("_bad") | (F.col("_n") != F.col("_fields")), "invalid").when(~F.col("_any"), "unchanged")
                       .when(F.col("_asked") != F.coalesce("_now", F.lit(0)), "conflict").otherwise("applied").alias("outcome")))
    return rows.join(verdict, "id")


def fact_rows(classified: DataFrame) -> DataFrame:
    """Log rows of an accepted batch."""
    return (classified.filter("outcome = 'applied' AND changed")
            .select("id", (F.col("current_revision") + 1).alias("revision"), "field", *FACT))


def groups_to_dissolve(classified: DataFrame, links: DataFrame) -> DataFrame:
    """Product groups with a member whose identity (brand, category, attributes) changed."""
    touched = classified.filter("outcome = 'applied' AND identity").select("id").distinct()
    return links.join(touched, "id", "left_semi").select("group_id").distinct()


def dissolve(links: DataFrame, groups: DataFrame) -> DataFrame:
    return links.join(groups, "group_id", "left_anti")


def derive(products: DataFrame, known: DataFrame) -> DataFrame:
    """products(id, own_text[, brand, supplier]) -> facts that the text states explicitly, once, under a label.

    Only fields not yet known; a measured field must be exactly one quantity.
    """
    found = []
    for field, labels in STATED_LABELS.items():
        pattern = f"(?iU)(?:^|\\n)\\s*(?:{labels})\\s*[：:]\\s*([^\\n]+)"
        values = F.array_distinct(F.transform(F.regexp_extract_all("own_text", F.lit(pattern), F.lit(1)),
                                              lambda v: F.regexp_replace(v, "(?U)^\\s+|\\s+$", "")))
        quote = F.regexp_replace(F.regexp_extract("own_text", pattern, 0), "(?U)^\\s+|\\s+$", "")
        stated = F.size(values) == 1
        if field in ("brand", "supplier") and field in products.columns:
            stated = stated & (F.coalesce(F.col(field).cast("string"), F.lit("")) == "")
        found.append(F.when(stated, F.struct(F.lit(field).alias("field"), F.get(values, F.lit(0)).alias("value"), quote.alias("quote"))))
    rows = (products.select("id", F.explode(F.array_compact(F.array(*found))).alias("f")).select("id", "f.*")
            .join(known.select("id", "field"), ["id", "field"], "left_anti")
            .withColumn("measure", whole_quantity(normalize("value"))))
    usable = F.when(F.col("field").isin(*MEASURED), F.col("measure").isNotNull()).otherwise(F.length("value").between(1, 160))
    measured = F.col("field").isin(*MEASURED)
    return rows.filter(usable).select(
        "id", "field", F.when(measured, F.col("measure.number").cast("string")).otherwise(F.col("value")).alias("value"),
        F.when(measured, F.col("measure.number")).alias("number"), F.when(measured, F.col("measure.unit")).alias("unit"),
        F.lit("source").alias("origin"), "quote", F.lit("原文明确标注的字段").alias("reason"))


# -- tags and synonyms -------------------------------------------------------------------------------------------

def annotate(entries: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entries(seq, id, kind, value, origin, reason, evidence) -> (tags, rejects); the last entry of a tag wins."""
    joined = (entries.join(products.select("id", "own_text"), "id", "left")
              .withColumn("_v", normalize("value")).withColumn("_e", normalize("evidence")))
    problem = F.coalesce(
        F.when(F.col("own_text").isNull(), "unknown_product"),
        F.when(~F.col("kind").rlike("^[a-z][a-z0-9_]{0,39}$") | ~F.length("value").between(1, 120), "bad_kind_or_value"),
        F.when(~F.coalesce(F.length("evidence").between(1, 1000) & F.contains("own_text", "evidence"), F.lit(False)), "evidence_not_in_source"),
        F.when(~F.col("origin").isin("source", "inferred") | ~F.length("reason").between(1, 500), "bad_origin_or_reason"),
        F.when((F.col("origin") == "source") & ~F.contains("_e", "_v"), "source_tag_not_in_evidence"))
    checked = joined.withColumn("problem", problem).drop("own_text", "_v", "_e")
    return (latest(checked.filter("problem IS NULL").drop("problem"), ["id", "kind", "value"], ["seq"]).drop("seq"),
            checked.filter("problem IS NOT NULL"))


def vocabulary(records: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """records(kind, terms array, reason), existing(kind, term, group_key, display) -> (synonym rows, rejects).

    A group that already holds one of the terms must be taken over whole.
    """
    keyed = records.withColumn("_row", F.sha2(F.to_json(F.struct("kind", "terms")), 256))
    terms = (keyed.select("_row", "kind", "reason", F.explode("terms").alias("display"))
             .withColumn("display", F.trim("display")).withColumn("term", normalize("display")))
    group = terms.groupBy("_row", "kind", "reason").agg(
        F.sort_array(F.collect_set("term")).alias("terms"), F.count("*").alias("n"))
    group_key = F.substring(F.sha2(F.concat(F.lit('["'), F.array_join("terms", '","'), F.lit('"]')), 256), 1, 24)
    held = (terms.join(existing.select("kind", "term", "group_key"), ["kind", "term"]).select("_row", "kind", "group_key").distinct()
            .join(existing.select("kind", "group_key", F.col("term").alias("member")), ["kind", "group_key"]))
    missing = held.join(terms.select("_row", F.col("term").alias("member")), ["_row", "member"], "left_anti").select("_row").distinct()
    problem = F.coalesce(
        F.when(~F.col("kind").rlike("^(query|brand|supplier|category|tag:[a-z][a-z0-9_]*)$"), "unknown_kind"),
        F.when((F.size("terms") != F.col("n")) | ~F.col("n").between(2, 8), "terms_not_distinct"),
        F.when(F.col("_missing"), "incomplete_existing_group"))
    checked = (group.join(missing.withColumn("_missing", F.lit(True)), "_row", "left")
               .withColumn("group_key", group_key).withColumn("problem", problem))
    good = checked.filter("problem IS NULL").select("_row", "group_key")
    return (terms.join(good, "_row").select("kind", "term", "group_key", "display", "reason"),
            checked.filter("problem IS NOT NULL").select("kind", "terms", "problem"))


def expand_synonyms(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """terms(kind, term) -> every display of the term's group, else the term itself."""
    norm = terms.withColumn("_norm", normalize("term"))
    groups = synonyms.select("kind", F.col("term").alias("_norm"), "group_key")
    displays = synonyms.select("kind", "group_key", F.col("term").alias("_member"), "display")
    return (norm.join(groups, ["kind", "_norm"], "left").join(displays, ["kind", "group_key"], "left")
            .select("kind", "term", F.coalesce("display", "term").alias("expanded")))


# -- groups --------------------------------------------------------------------------------------------------------

def group_verdicts(members: DataFrame, links: DataFrame, attributes: DataFrame | None = None) -> DataFrame:
    """members(group_id, id, brand, model, variant, own_text, quote) -> one row per group with ``problem``.

    Same SKU means one brand, one model, one variant and equal attributes. Two different values are seen as
    min < max, so a group is never collected.
    """
    rows = members
    for c in ("brand", "model", "variant"):
        rows = rows.withColumn(f"_{c}", F.nullif(normalize(c), F.lit("")))
    before = links.select("id", F.col("group_id").alias("_linked"))
    rows = rows.join(before, "id", "left")
    stats = rows.groupBy("group_id").agg(
        F.count("*").alias("members"), F.count_distinct("id").alias("_ids"),
        (F.min("_brand") < F.max("_brand")).alias("_b"),
        (F.min("_model") < F.max("_model")).alias("_m"), (F.min("_variant") < F.max("_variant")).alias("_v"),
        F.bool_or(F.col("_brand").isNull() | F.col("_model").isNull()).alias("_unknown"),
        F.bool_or(~F.coalesce(F.contains("own_text", "quote"), F.lit(False))).alias("_unquoted"),
        F.bool_or(F.coalesce(F.col("_linked") != F.col("group_id"), F.lit(False))).alias("_elsewhere"),
        F.count_if(F.col("_linked").eqNullSafe(F.col("group_id"))).alias("_kept"))
    held = links.groupBy("group_id").agg(F.count("*").alias("_held"))
    stats = stats.join(held, "group_id", "left")
    differs = F.lit(False)
    if attributes is not None:
        spread = (members.select("group_id", "id").join(attributes.filter("field LIKE 'attr.%'"), "id")
                  .groupBy("group_id", "field").agg((F.min(F.struct("value", "unit")) < F.max(F.struct("value", "unit"))).alias("d"))
                  .groupBy("group_id").agg(F.bool_or("d").alias("_attr")))
        stats = stats.join(spread, "group_id", "left")
        differs = F.coalesce("_attr", F.lit(False))
    problem = F.coalesce(
        F.when((F.col("members") < 2) | (F.col("members") != F.col("_ids")), "bad_members"),
        F.when(F.coalesce("_held", F.lit(0)) > F.col("_kept"), "existing_member_missing"),
        F.when(F.col("_unquoted"), "evidence_not_in_source"),
        F.when(F.col("_elsewhere"), "member_of_other_group"),
        F.when(F.coalesce("_b", F.lit(False)) | F.coalesce("_m", F.lit(False)) | F.coalesce("_v", F.lit(False)) | differs, "conflicting_identity"),
        F.when(F.col("_unknown"), "brand_or_model_unknown"))
    return stats.select("group_id", "members", problem.alias("problem"))


# -- offer terms ---------------------------------------------------------------------------------------------------

# Wording that establishes a currency, and wording for order minimums.
CURRENCY_WORDS = {"CNY": ["CNY", "RMB", "人民币"], "USD": ["USD", "美元"], "EUR": ["EUR", "欧元"], "HKD": ["HKD", "港币", "港元"]}
INCLUDED_WORD = {"tax": "税", "shipping": "运"}
MINIMUM_LABELS = "起订量|起订数量|最低订货量|最小订货量|\\bMOQ\\b"
PIECE_WORDS = "件|只|个|套|箱|盒|台|包"


def term_established(key, value, quote, quote_norm) -> Column:
    """Whether a quote establishes a term's value; another mention of the number or word does not."""
    key, value, quote, norm = (as_column(c) for c in (key, value, quote, quote_norm))
    currency = F.lit(False)
    for code, words in CURRENCY_WORDS.items():
        spoken = F.lit(False)
        for word in words:
            spoken = spoken | F.contains(norm, F.lit(word.casefold()))
        currency = currency | ((value == code) & spoken)

    def carried(word):
        out = F.lit(False)
        for prefix in ("不含", "未含", "未"):
            out = out | F.contains(quote, F.lit(prefix + word))
        return F.when(value == "excluded", out).otherwise((value == "included") & F.contains(quote, F.lit("含" + word)) & ~out)

    minimum = F.concat(F.lit(f"(?i)(?:{MINIMUM_LABELS})\\s*[：:]?\\s*"), value, F.lit("(?![\\d.])|(?<![\\d.])"), value,
                       F.lit(f"\\s*(?:{PIECE_WORDS})?\\s*起订"))
    whole = value.rlike("^[1-9]\\d*$")
    return F.coalesce(
        F.when(key == "currency", currency).when(key == "tax", carried(INCLUDED_WORD["tax"]))
        .when(key == "shipping", carried(INCLUDED_WORD["shipping"]))
        .when(key == "moq", whole & F.regexp_like(quote, F.when(whole, minimum).otherwise(F.lit("$^"))))
        .when(key == "unit", F.length(value).between(1, 40) & F.contains(quote, value)), F.lit(False))


def classify_terms(current: DataFrame, requests: DataFrame, products: DataFrame) -> DataFrame:
    """requests(id, field, revision, terms map<string,struct<value,quote>>) merged into the current terms.

    current(id, field, revision, terms); products(id, own_text, prices map). Outcome unchanged / applied / conflict / invalid.
    """
    facts = (requests.select("id", "field", F.explode("terms").alias("key", "t")).select("id", "field", "key", "t.*")
             .join(products.select("id", "own_text", "prices"), "id", "left").withColumn("_norm", normalize("quote")))
    sound = (F.coalesce(F.contains("own_text", "quote"), F.lit(False)) & F.coalesce(F.map_contains_key("prices", F.col("field")), F.lit(False))
             & term_established("key", "value", "quote", "_norm"))
    verdict = facts.groupBy("id", "field").agg(F.bool_and(sound).alias("_ok"))
    old = current.select("id", "field", F.col("revision").alias("_revision"), F.col("terms").alias("_terms"))
    joined = requests.join(verdict, ["id", "field"], "left").join(old, ["id", "field"], "left")
    empty = F.create_map().cast(requests.schema["terms"].dataType)
    before = F.coalesce("_terms", empty)
    # Later keys win: drop the old entries that are given again.
    merged = F.map_concat(F.map_filter(before, lambda k, _: ~F.map_contains_key("terms", k)), F.col("terms"))
    joined = joined.withColumn("_merged", merged)

    def entries(terms):
        return F.sort_array(F.map_entries(terms))

    now = F.coalesce("_revision", F.lit(0))
    return joined.select(
        "id", "field", F.col("_merged").alias("terms"), (now + 1).alias("next_revision"),
        F.when(~F.coalesce("_ok", F.lit(False)), "invalid").when(entries(F.col("_merged")) == entries(before), "unchanged")
        .when(now != F.col("revision"), "conflict").otherwise("applied").alias("outcome"))


# -- audit ---------------------------------------------------------------------------------------------------------

def audit(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows that differ between two versions, with both values."""
    b = before.select(*key, F.col(value).alias("before"), F.lit(True).alias("_b"))
    a = after.select(*key, F.col(value).alias("after"), F.lit(True).alias("_a"))
    both = b.join(a, key, "full")
    kind = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return both.withColumn("change", kind).filter("change IS NOT NULL").drop("_a", "_b")


def history(events: DataFrame, kind: str, entity) -> DataFrame:
    """Events of one entity, to be paged newest first; the payload only as its length."""
    return (events.filter((F.col("entity_type") == kind) & (F.col("entity_id") == entity))
            .withColumn("payload_chars", F.length("payload").cast("long")).drop("payload"))
