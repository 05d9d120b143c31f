"""Hard filters on observations."""

from pyspark.sql import functions as F

from sourcemart.checks.base import check, sql
from sourcemart.functions.text import all_terms
from sourcemart.operators import filters, lineage, sessions
from sourcemart.operators.overlay import effective
from sourcemart.plans.search import Pool, hard_filter


@check("f_terms_and", r"""SELECT doc_id FROM documents
    WHERE strpos(replace(lower(text), 'ß', 'ss'), 'the') > 0 AND strpos(replace(lower(text), 'ß', 'ss'), 'tion') > 0""")
def _(t):
    return t.library().find(filters.search_terms("The  TION"), filters.SCOPE_COLUMN["all"]).select(F.col("id").alias("doc_id"))


@check("f_scope", sql("""SELECT id, strpos(name_norm, 'm-1') > 0 AND strpos(name_norm, 'red') > 0 AS in_name FROM obs
    WHERE strpos(all_norm, 'red') > 0 AND strpos(all_norm, 'm-1') > 0""", "obs"))
def _(t):
    found = filters.by_terms(t.observations(), "red M-1", "all")
    return found.select("id", all_terms(filters.SCOPE_COLUMN["name"], filters.search_terms("red m-1")).alias("in_name"))


@check("f_exclude", sql("SELECT id, name FROM obs WHERE strpos(all_norm, 'bolt') > 0 AND strpos(all_norm, 'promo') = 0 AND strpos(all_norm, 'blue') = 0", "obs"))
def _(t):
    return filters.by_terms(t.observations(), "bolt", "all", exclude=["PROMO", "blue"]).select("id", "name")


@check("f_price_range", sql("SELECT id, amount FROM obs WHERE field = 'retail_price' AND amount BETWEEN 1000 AND 2000", "obs"))
def _(t):
    priced = t.observations().filter("field = 'retail_price'")
    return filters.by_price(priced, "amount", 1000, 2000).select("id", "amount")


@check("f_category_tree", sql("""SELECT o.id, o.category FROM obs o WHERE o.category_norm = 'promo' OR starts_with(o.category_norm, 'promo/')
    OR EXISTS (SELECT 1 FROM events e WHERE e.user_id = o.group_id AND e.event_type = 'purchase'
               AND json_extract_string(e.props, '$.k') = '7')""", "obs"))
def _(t):
    tags = t.tags().filter("kind = 'purchase'").withColumn("kind", F.lit("category"))
    tags = tags.withColumn("value", F.when(F.col("value") == "7", F.lit("Promo/tagged")).otherwise(F.col("value")))
    return filters.by_category(t.observations(), ["PROMO"], tags=tags, key="group_id").select("id", "category")


@check("f_exclude_category", sql("""SELECT id, category FROM (SELECT o.id, o.category, coalesce(f.value, o.category) AS shown FROM obs o
    LEFT JOIN facts f ON f.id = o.group_id AND f.field = 'category')
    WHERE NOT (shown = 'reviewed/q0' OR starts_with(lower(shown), 'promo/') OR starts_with(lower(shown), 'small/'))""", "obs", "facts"))
def _(t):
    facts = t.facts()
    shown = effective(t.observations().withColumnRenamed("category", "own"), facts.filter("field = 'category'"), ("category",), "group_id")
    shown = shown.withColumn("category_norm", F.lower(F.coalesce("category", "own"))).withColumnRenamed("own", "source_category").drop("category")
    kept = filters.without_categories(shown, ["reviewed/q0", "promo", "SMALL"], source_column="source_category", overlay=facts, key="group_id")
    return kept.select("id", F.col("source_category").alias("category"))


@check("f_brand_supplier", sql("SELECT id, brand, supplier FROM obs WHERE brand IN ('Brand#3', 'Brand#7') AND supplier = 5", "obs"))
def _(t):
    obs = t.observations().withColumn("supplier_norm", F.col("supplier").cast("string"))
    pool = Pool(obs, synonyms={("brand", "brand#3"): ["Brand#3", "BRAND#7"]})
    return hard_filter(pool, brand="Brand#3", supplier="5").select("id", "brand", "supplier")


@check("f_has_image", sql("SELECT id FROM obs WHERE has_image", "obs"))
def _(t):
    return t.observations().filter("has_image").select("id")


@check("f_source", sql("SELECT id, record_key FROM obs WHERE doc_id = 77", "obs"))
def _(t):
    return t.observations().filter("doc_id = 77").select("id", "record_key")


@check("f_fresh", sql("SELECT id FROM obs WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 1000)", "obs"))
def _(t):
    stale = t.documents.filter("n_chars > 1000").select("doc_id")
    return filters.fresh_only(t.observations(), stale).select("id")


@check("f_tags", sql("""SELECT o.id FROM obs o
    WHERE EXISTS (SELECT 1 FROM tags t WHERE t.id = o.group_id AND t.kind = 'view' AND t.value IN ('7', '8') AND t.origin = 'source')
    AND EXISTS (SELECT 1 FROM tags t WHERE t.id = o.group_id AND t.kind = 'click' AND t.value = '9' AND t.origin = 'source')
    AND (EXISTS (SELECT 1 FROM tags t WHERE t.id = o.group_id AND t.kind = 'error' AND t.value = '1')
      OR EXISTS (SELECT 1 FROM tags t WHERE t.id = o.group_id AND t.kind = 'signup' AND t.value IN ('2', '3', '4', '5')))""", "obs", "tags"))
def _(t):
    tags = t.tags()
    kept = filters.by_tags(t.observations(), tags, ["view:7", "click:9"], "all", "source", {("tag:view", "7"): ["7", "8"]}, "group_id")
    return filters.by_tags(kept, tags, ["error:1", "signup:2", "signup:3", "signup:4", "signup:5"], "any", key="group_id").select("id")


@check("f_attr_range", sql("SELECT o.id FROM obs o WHERE EXISTS (SELECT 1 FROM facts f WHERE f.id = o.group_id AND f.field = 'attr.capacity' AND f.unit = 'ml' AND f.number >= 500)", "obs", "facts"))
def _(t):
    return filters.by_attribute(t.observations(), t.facts(), "attr.capacity", minimum=0.5, unit="L", key="group_id").select("id")


@check("f_attr_text", sql("SELECT o.id FROM obs o WHERE EXISTS (SELECT 1 FROM facts f WHERE f.id = o.group_id AND f.field = 'attr.material' AND f.value = 'steel')", "obs", "facts"))
def _(t):
    return filters.by_attribute(t.observations(), t.facts(), "attr.material", value="STEEL", key="group_id").select("id")


@check("f_price_label", sql("SELECT id, label FROM obs WHERE field = 'agent_price' AND label IN ('F')", "obs"))
def _(t):
    return filters.by_price_label(t.observations().filter("field = 'agent_price'"), ["F"]).select("id", "label")


@check("f_price_basis", sql("SELECT id FROM obs WHERE field = 'agent_price' AND (label = 'F' OR record_key > 4)", "obs"))
def _(t):
    # F: a label of the role itself; O: on the first lines a label of another role, else one that names none.
    written = (F.when(F.col("label") == "F", "代理价").when(F.col("record_key") <= 4, "零售价").otherwise("优惠价"))
    agent = t.observations().filter("field = 'agent_price'").withColumn("written", written)
    return filters.on_price_basis(agent, "agent_price", "written").select("id")


@check("f_terms", sql("""SELECT o.id FROM obs o WHERE EXISTS (SELECT 1 FROM events e WHERE e.user_id = o.group_id AND e.event_type = 'view'
    AND json_extract_string(e.props, '$.k') = '12')""", "obs"))
def _(t):
    k = F.get_json_object("props", "$.k")
    terms = t.events.filter("event_type = 'view'").select(
        F.col("user_id").alias("id"), F.lit("retail_price").alias("field"),
        F.create_map(F.lit("moq"), F.struct(k.alias("value"), F.lit("").alias("quote"))).alias("terms"))
    return filters.by_terms_of_offer(t.observations(), terms, "retail_price", {"moq": 12}, "group_id").select("id")


@check("f_current", sql("SELECT id FROM obs WHERE doc_id NOT IN (SELECT doc_id FROM sources WHERE state <> 'active')", "obs", "sources"))
def _(t):
    return filters.current_only(t.observations(), t.sources()).select("id")


@check("f_latest", sql("SELECT id, doc_id FROM obs WHERE doc_id IN (SELECT doc_id FROM latest)", "obs", "latest"))
def _(t):
    return lineage.latest_only(t.observations(), t.sources()).select("id", "doc_id")


@check("f_series", sql("SELECT id FROM obs WHERE doc_id IN (SELECT doc_id FROM sources WHERE series = 11)", "obs", "sources"))
def _(t):
    return filters.in_series(t.observations(), t.sources(), 11).select("id")


@check("f_group", sql("SELECT id FROM obs WHERE group_id = 42", "obs"))
def _(t):
    links = t.items().select("id", F.col("id").alias("group_id"))
    return filters.in_group(t.observations().withColumnRenamed("group_id", "item"), links, 42, "item").select("id")


@check("f_literal_title", "SELECT c_custkey, c_name FROM customer WHERE strpos(lower(c_name), lower('#00000010')) > 0")
def _(t):
    listed = sessions.session_list(
        t.customer.select(F.col("c_custkey").alias("session_id"), F.col("c_name").alias("title"), F.lit("open").alias("state")),
        t.orders.select(F.col("o_custkey").alias("session_id"), F.lit(True).alias("selected")), "#00000010")
    return listed.select(F.col("session_id").alias("c_custkey"), F.col("title").alias("c_name"))
