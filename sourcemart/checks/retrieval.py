"""Search pages and multi-lane retrieval over the priced observations."""

from pyspark.sql import functions as F

from sourcemart.checks.aggregates import LIBRARY
from sourcemart.checks.base import check, sql
from sourcemart.operators import facets
from sourcemart.operators.ranking import page, top_per_group
from sourcemart.plans import batch, retrieval, search
from sourcemart.plans.search import Pool

SYNONYMS = {("query", "red"): ["red", "blue"]}
PLAN = {"version": 1, "hard": {"price_field": "retail_price", "minimum": 500, "maximum": 3000, "exclude_categories": ["promo"]},
        "lanes": [{"query": "red"}, {"query": "bolt", "scope": "name"}, {"query": "", "category": "large"}, {"query": "", "tags": ["view:7", "click:9"]}],
        "limit": 20, "per_lane": 30}


def pool(t, **frames):
    """Observations with prices, their sources, and the item tags and facts, which refer to the observation's part."""
    return Pool(t.priced(), sources=t.sources(), item_key="group_id", synonyms=SYNONYMS, offers=t.offers, **frames)


def run(t, **changes):
    return retrieval.retrieve(pool(t, tags=t.tags()), {**PLAN, **changes}, link="group_id")


# Ranks follow the gram count: every hit of a lane holds all grams of its query, so its score depends on length alone.
LANES = """gchars AS (SELECT id, col, generate_subscripts(l, 1) AS i, unnest(l) AS c FROM (
      SELECT id, 0 AS col, string_split(name_norm, '') AS l FROM items UNION ALL SELECT id, 1, string_split(all_norm, '') FROM items)),
    glen AS (SELECT id, count(DISTINCT (col, g)) AS grams FROM (SELECT id, col, unnest([c, c || lead(c) OVER (PARTITION BY id, col ORDER BY i)]) AS g FROM gchars) WHERE g IS NOT NULL GROUP BY 1),
    base AS (SELECT obs.*, glen.grams FROM obs JOIN sources USING (doc_id) JOIN glen ON glen.id = obs.group_id WHERE field = 'retail_price' AND amount BETWEEN 500 AND 3000
      AND sources.state = 'active' AND NOT starts_with(category_norm, 'promo/')),
    hit AS (SELECT 0 AS lane, *, true AS textual FROM base WHERE strpos(all_norm, 'red') > 0 UNION ALL SELECT 1, *, true FROM base WHERE strpos(all_norm, 'blue') > 0
      UNION ALL SELECT 2, *, true FROM base WHERE strpos(name_norm, 'bolt') > 0 UNION ALL SELECT 3, *, false FROM base WHERE starts_with(category_norm, 'large/')
      UNION ALL SELECT 4, *, false FROM base WHERE group_id IN (SELECT id FROM tags WHERE kind = 'view' AND value = '7') AND group_id IN (SELECT id FROM tags WHERE kind = 'click' AND value = '9')),
    keyed AS (SELECT *, CASE WHEN textual THEN grams ELSE row_number() OVER (PARTITION BY lane, category ORDER BY doc_id, record_key, id) END AS k FROM hit),
    placed AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY k, CASE WHEN NOT textual THEN doc_id END, CASE WHEN NOT textual THEN record_key END, id) AS rank FROM keyed),
    ranked AS (SELECT * FROM placed WHERE rank <= 30),
    fused AS (SELECT id, any_value(category) AS category, any_value(group_id) AS group_id, list_sum(list_transform(list_sort(list({'l': lane, 'r': rank})), lambda p: cast(1 AS DOUBLE) / (60 + p.r))) AS score,
      string_agg(cast(lane AS VARCHAR), ',' ORDER BY lane) AS lanes FROM ranked GROUP BY id),
    ordered AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM fused),
    members AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY place) AS m, count(*) OVER (PARTITION BY group_id) AS offers FROM ordered),
    heads AS (SELECT *, split_part(category, '/', 1) AS top FROM members WHERE m = 1),
    turns AS (SELECT *, row_number() OVER (PARTITION BY top ORDER BY place) AS turn, min(place) OVER (PARTITION BY top) AS first_place FROM heads),
    shown AS (SELECT *, row_number() OVER (ORDER BY turn, first_place) AS shown FROM turns)"""


def lanes_sql(body):
    return sql("", "obs", "sources", "tags").rstrip() + ",\n" + LANES + "\n" + body


@check("search", sql("""SELECT id, name, amount FROM obs JOIN sources USING (doc_id) WHERE field = 'retail_price' AND amount BETWEEN 500 AND 5000 AND starts_with(category_norm, 'small/')
    AND strpos(name_norm, 'red') > 0 AND strpos(all_norm, 'red') > 0 AND state = 'active' ORDER BY amount NULLS LAST, id LIMIT 50""", "obs", "sources"))
def flagship(t):
    """Cheapest current retail offers of one category whose name holds a word."""
    return search.search(pool(t), "RED", price_field="retail_price", minimum=500, maximum=5000, category="Small", sort="price-asc", limit=50).select("id", "name", "amount")


@check("result_shape", sql("""SELECT id, name, category, brand, doc_id || '/' || record_key AS source, label AS price_label, CASE WHEN amount IS NULL THEN '更新中' ELSE printf('%.2f', amount) END AS price_value
    FROM obs WHERE field = 'agent_price' AND doc_id IN (SELECT doc_id FROM latest) AND strpos(name_norm, 'ring') > 0""", "obs", "latest"))
def _(t):
    hits = search.hits(pool(t), "ring", price_field="agent_price", latest=True).filter("price IS NOT NULL")
    return hits.select("id", "name", "category", "brand", F.concat_ws("/", "doc_id", "record_key").alias("source"), F.col("price.label").alias("price_label"), F.col("price.value").alias("price_value"))


@check("result_enrich", sql("""SELECT o.id, coalesce(f.value, o.category) AS category, CASE WHEN f.value IS NULL THEN 'source' ELSE 'inferred' END AS category_origin,
    coalesce(g.tags, '') AS tags, coalesce(g.n, 0) AS tag_count, a.number AS capacity FROM (SELECT * FROM obs ORDER BY amount NULLS LAST, id LIMIT 40) o
    LEFT JOIN facts f ON f.id = o.group_id AND f.field = 'category' LEFT JOIN facts a ON a.id = o.group_id AND a.field = 'attr.capacity'
    LEFT JOIN (SELECT id, count(*) AS n, string_agg(kind || ':' || value, ',' ORDER BY kind, value) FILTER (WHERE r <= 5) AS tags FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY kind, value) AS r FROM tags) GROUP BY 1) g ON g.id = o.group_id""", "obs", "facts", "tags"))
def _(t):
    shown = page(t.observations().select("id", "group_id", "category", "amount"), [F.col("amount").asc_nulls_last(), "id"], 40)
    return search.enrich_hits(shown, t.tags(), t.facts(), "group_id").select(
        "id", "category", "category_origin", F.array_join(F.transform("tags", lambda g: F.concat(g["kind"], F.lit(":"), g["value"])), ",").alias("tags"),
        "tag_count", F.try_element_at("attributes", F.lit("attr.capacity"))["number"].alias("capacity"))


@check("details", sql("""SELECT position, o.id, o.name, o.amount, s.state, (SELECT count(*) FROM tags g WHERE g.id = o.group_id) AS tag_count FROM (
    SELECT id, row_number() OVER (ORDER BY amount DESC NULLS LAST, id) AS position FROM obs) c JOIN obs o USING (id) JOIN sources s USING (doc_id) WHERE position <= 100""", "obs", "sources", "tags"))
def _(t):
    wanted = top_per_group(t.observations().select("id", "amount").withColumn("_all", F.lit(1)), ["_all"], [F.col("amount").desc_nulls_last(), "id"], 100, "position")
    found, _ = search.details(wanted.select("position", "id"), t.observations(), t.sources(), t.tags(), "group_id")
    return found.select("position", "id", "name", "amount", "state", "tag_count")


@check("retrieve", lanes_sql("SELECT shown, id, floor(score * 1000000000 + cast(0.5 AS DOUBLE)) / 1000000000 AS score FROM shown WHERE shown <= 20"))
def _(t):
    return run(t).items.select("shown", "id", (F.floor(F.col("fused") * F.lit(1e9) + F.lit(0.5)) / F.lit(1e9)).alias("score"))


@check("lane_report", lanes_sql("SELECT cast(l AS BIGINT) AS lane, (SELECT count(*) FROM hit WHERE lane = l) AS total, (SELECT count(*) FROM ranked WHERE lane = l) AS returned FROM range(5) AS r(l)"))
def _(t):
    return run(t).lanes.select(F.col("lane").cast("long").alias("lane"), "total", "returned")


@check("matched_lanes", lanes_sql("SELECT id, lanes FROM shown WHERE shown <= 20"))
def _(t):
    return run(t).items.select("id", F.array_join(F.transform("matched_lanes", lambda l: l.cast("string")), ",").alias("lanes"))


@check("offer_alternatives", lanes_sql("""SELECT s.id, s.offers AS matching_offers, coalesce(string_agg(m.id, ',' ORDER BY m.m), '') AS alternatives, s.offers > 4 AS more
    FROM shown s LEFT JOIN members m ON m.group_id = s.group_id AND m.m BETWEEN 2 AND 4 WHERE s.shown <= 20 GROUP BY s.id, s.offers"""))
def _(t):
    return run(t).items.select("id", "matching_offers", F.array_join("alternative_ids", ",").alias("alternatives"), F.col("alternatives_more").alias("more"))


@check("lane_expand", """WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part),
    pairs AS (SELECT x.a || ' ' || x.b AS asked, y.a || ' ' || x.b AS query, row_number() OVER (PARTITION BY x.a, x.b ORDER BY y.a) AS n
      FROM w x JOIN (SELECT DISTINCT a FROM w) y ON length(x.a) = length(y.a))
    SELECT asked, query FROM pairs WHERE n <= 4""")
def _(t):
    # The query log: every item name is a query; first words of equal length are synonyms of each other.
    words = t.part.select(F.element_at(F.split("p_name", " "), 1).alias("word")).distinct()
    groups = words.select(F.lit("query").alias("kind"), F.col("word").alias("term"), F.length("word").cast("string").alias("group_key"), F.col("word").alias("display"))
    log = t.part.select(F.col("p_name").alias("query")).distinct()
    return retrieval.expand_log(log, groups).select(F.col("query").alias("asked"), F.col("expanded").alias("query"))


@check("coverage_warnings", sql("""SELECT concat_ws(',', 'incomplete_metadata', CASE WHEN (SELECT count(*) FROM sources WHERE import_status <> 'ready') > 0 THEN 'partial_source_imports' END,
    CASE WHEN (SELECT count(*) FROM obs) > (SELECT count(amount) FROM obs WHERE field = 'retail_price') THEN 'unknown_or_complex_prices_excluded_from_budget' END,
    CASE WHEN (SELECT count(*) FROM heads WHERE undated > 0 OR at_newest > 1) > 0 THEN 'ambiguous_quote_series_excluded' END,
    CASE WHEN (SELECT count(*) FROM sources s JOIN heads h ON h.series = s.series AND h.newest = s.issued_on WHERE s.state = 'active' AND s.import_status <> 'ready') > 0 THEN 'newest_source_incomplete' END,
    'unknown_categories_excluded_from_negative_filter') AS warnings""", "obs", "heads"))
def _(t):
    items = t.items().withColumn("supplier", F.lit("")).withColumn("category_origin", F.lit("source"))
    counts = facets.quality(items, t.facts(), t.tags(), t.sources(), t.items().filter("size < 10").select("id"))
    price = facets.price_coverage(t.prices(), t.prices(), "retail_price").unpivot([], ["numeric", "unusable", "basis_conflicts"], "metric", "n")
    long = counts.unionByName(price)
    names = ["missing_brand", "missing_supplier", "missing_category", "incomplete_files", "sources_without_version", "ambiguous_quote_series", "partial_newest_quotes", "unusable", "basis_conflicts"]
    wide = long.agg(*[F.max(F.when(F.col("metric") == n, F.col("n"))).alias(n) for n in names])
    hard = {"price_field": "retail_price", "maximum": 100, "latest": True, "exclude_categories": ["x"]}
    return facets.coverage_warnings(wide, hard, price=True).select(F.array_join("warnings", ",").alias("warnings"))


@check("truncated", lanes_sql("SELECT (SELECT max(c) FROM (SELECT count(*) AS c FROM hit GROUP BY lane)) > 30 OR (SELECT count(*) FROM heads) > 20 AS truncated"))
def _(t):
    return retrieval.truncated(run(t))


def offer_terms(t):
    """Known terms of the retail price: the error events of an item give them, one key per value."""
    k = F.get_json_object("props", "$.k").cast("int")
    names = F.array(*map(F.lit, retrieval.QUOTE_TERMS))
    one = t.events.filter("event_type = 'error'").select(F.col("user_id").alias("id"), names[k % 4].alias("term")).distinct()
    entry = F.struct("term", F.struct(F.lit("yes").alias("value"), F.lit("").alias("quote")))
    return one.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("terms")).select("id", F.lit("retail_price").alias("field"), "terms")


def whole_answer(t):
    asked = pool(t, tags=t.tags(), terms=offer_terms(t))
    found = retrieval.retrieve(asked, PLAN, link="group_id")
    return found, retrieval.evidence(found, asked, "retail_price")


TERMS = "terms AS (SELECT user_id AS id, list_sort(list(DISTINCT ['currency', 'unit', 'tax', 'shipping'][cast(json_extract_string(props, '$.k') AS INT) % 4 + 1])) AS terms FROM events WHERE event_type = 'error' GROUP BY 1)"


@check("retrieve_answer", lanes_sql(f"""SELECT shown, s.id, excerpt[1:240] AS excerpt, length(excerpt) AS facts_length, array_to_string(coalesce(terms, []), ',') AS terms,
    coalesce((SELECT string_agg(m.id || '@' || o.doc_id || '=' || coalesce(cast(cast(o.amount AS DECIMAL(18,2)) AS VARCHAR), '?'), ',' ORDER BY m.m) FROM members m JOIN obs o ON o.id = m.id WHERE m.group_id = s.group_id AND m.m BETWEEN 2 AND 4), '') AS offers
    FROM (SELECT shown.shown, shown.id, shown.group_id, array_to_string(list_filter([o.name, o.model, split_part(o.features, chr(10), 1), split_part(o.features, chr(10), 2), o.brand, cast(o.supplier AS VARCHAR), o.category],
      lambda x: x <> ''), chr(10)) AS excerpt FROM shown JOIN obs o ON o.id = shown.id WHERE shown.shown <= 20) s LEFT JOIN (WITH {TERMS} SELECT * FROM terms) t ON t.id = s.group_id"""))
def _(t):
    _, shown = whole_answer(t)
    offers = F.transform("alternative_offers", lambda o: F.concat(o["id"], F.lit("@"), o["doc_id"].cast("string"), F.lit("="), F.coalesce(o["amount"].cast("decimal(18,2)").cast("string"), F.lit("?"))))
    return shown.select("shown", "id", F.col("facts_excerpt").alias("excerpt"), "facts_length", F.array_join(F.sort_array(F.map_keys("offer_terms")), ",").alias("terms"), F.array_join(offers, ",").alias("offers"))


@check("retrieve_warnings", lanes_sql(f"""SELECT concat_ws(',', 'incomplete_metadata', CASE WHEN (SELECT count(*) FROM sources WHERE import_status <> 'ready') > 0 THEN 'partial_source_imports' END,
    CASE WHEN (SELECT count(*) FROM obs) > (SELECT count(amount) FROM obs WHERE field = 'retail_price') THEN 'unknown_or_complex_prices_excluded_from_budget' END, 'unknown_categories_excluded_from_negative_filter',
    CASE WHEN (SELECT bool_or(len(coalesce(terms, [])) < 4) FROM shown s LEFT JOIN (WITH {TERMS} SELECT * FROM terms) t ON t.id = s.group_id WHERE shown <= 20) THEN 'some_quote_terms_unknown' END,
    CASE WHEN cut THEN 'bounded_candidates_not_exhaustive' END, CASE WHEN (SELECT bool_or(offers > 4) FROM shown WHERE shown <= 20) THEN 'group_offers_clipped_use_paginated_search' END) AS warnings,
    cut AS truncated, (SELECT count(*) FROM fused) AS candidates, (SELECT count(*) FROM heads) AS groups
    FROM (SELECT (SELECT max(c) FROM (SELECT count(*) AS c FROM hit GROUP BY lane)) > 30 OR (SELECT count(*) FROM heads) > 20 AS cut)"""))
def _(t):
    found, shown = whole_answer(t)
    items = t.items().withColumn("supplier", F.lit("")).withColumn("category_origin", F.lit("source"))
    coverage = facets.quality(items, t.facts(), t.tags(), t.sources(), t.items().filter("size < 10").select("id"))
    price = facets.price_coverage(t.prices(), t.prices(), "retail_price").unpivot([], ["numeric", "unusable", "basis_conflicts"], "metric", "n")
    told = retrieval.answer_warnings(found, shown, PLAN, coverage.unionByName(price))
    return told.select(F.array_join("warnings", ",").alias("warnings"), "truncated", "candidates", "groups")


# A query log: every benchmark item asks for its longest word, for its first two words, and for its last word in the name.
LOG = f"""WITH {LIBRARY}, words AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
    asked AS (SELECT item_id, [list_sort(list_transform(w, lambda x: {{'n': -length(x), 'w': x}}))[1].w] AS terms, 'all' AS scope, 0 AS place FROM words
      UNION ALL SELECT item_id, w[1:2], 'all', 1 FROM words UNION ALL SELECT item_id, [w[-1]], 'name', 2 FROM words),
    lanes AS (SELECT item_id, terms, scope, min(place) AS lane FROM asked GROUP BY ALL),
    hit AS (SELECT q.item_id, lane, lib.id, l, d.lang FROM lanes q JOIN lib ON len(list_filter(terms, lambda t: strpos(CASE scope WHEN 'name' THEN name_norm ELSE all_norm END, t) = 0)) = 0
      JOIN lens USING (id) JOIN documents d ON d.doc_id = lib.id
      WHERE d.n_chars >= 100 * (q.item_id % 3) AND (q.item_id % 2 = 0 OR d.n_chars <= 20000) AND (q.item_id % 5 <> 0 OR d.lang <> 'en')),
    placed AS (SELECT *, row_number() OVER (PARTITION BY item_id, lane ORDER BY l, id) AS rank FROM hit),
    ranked AS (SELECT * FROM placed WHERE rank <= 20),
    fused AS (SELECT item_id, id, any_value(lang) AS lang, list_sum(list_transform(list_sort(list({{'l': lane, 'r': rank}})), lambda p: cast(1 AS DOUBLE) / (60 + p.r))) AS score,
      string_agg(cast(lane AS VARCHAR), ',' ORDER BY lane) AS lanes FROM ranked GROUP BY ALL),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS place, CASE WHEN item_id % 4 <> 0 THEN lang END AS top FROM fused),
    turns AS (SELECT *, row_number() OVER (PARTITION BY item_id, top ORDER BY place) AS turn, min(place) OVER (PARTITION BY item_id, top) AS first_place FROM ordered),
    shown AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY turn, first_place) AS shown FROM turns)
    """


def log_answers(t):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)
    longest = F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))[0]["w"]
    lane = lambda query, scope: F.struct(query.alias("query"), F.lit(scope).alias("scope"))
    n = F.col("item_id")
    plans = t.benchmark.select(
        n.cast("string").alias("plan_id"),
        F.array(lane(longest, "all"), lane(F.concat_ws(" ", F.slice(words, 1, 2)), "all"), lane(F.element_at(words, -1), "name")).alias("lanes"),
        (n % 3 * 100).cast("double").alias("minimum"), F.when(n % 2 != 0, F.lit(20000.0)).alias("maximum"), F.lit(None).cast("array<string>").alias("categories"),
        F.when(n % 5 == 0, F.array(F.lit("en"))).alias("exclude_categories"), F.lit(10).alias("limit"), F.lit(20).alias("per_lane"), (n % 4 != 0).alias("diversity"))
    return batch.retrieve_plans(t.library(), plans, "n_chars", "lang")


@check("retrieve_batch", LOG + """SELECT cast(item_id AS VARCHAR) AS plan_id, shown, id, lanes, floor(score * 1000000000 + cast(0.5 AS DOUBLE)) / 1000000000 AS score FROM shown WHERE shown <= 10""")
def _(t):
    return log_answers(t).items.select("plan_id", "shown", "id", F.array_join(F.transform("matched_lanes", lambda l: l.cast("string")), ",").alias("lanes"),
                                       (F.floor(F.col("fused") * F.lit(1e9) + F.lit(0.5)) / F.lit(1e9)).alias("score"))


@check("retrieve_batch_lanes", LOG + """SELECT cast(item_id AS VARCHAR) AS plan_id, cast(lane AS BIGINT) AS lane, array_to_string(terms, ' ') AS query,
    (SELECT count(*) FROM hit h WHERE h.item_id = q.item_id AND h.lane = q.lane) AS total, (SELECT count(*) FROM ranked r WHERE r.item_id = q.item_id AND r.lane = q.lane) AS returned,
    (SELECT coalesce(max(c), 0) FROM (SELECT count(*) AS c FROM hit h WHERE h.item_id = q.item_id GROUP BY h.lane)) > 20 OR (SELECT count(*) FROM fused f WHERE f.item_id = q.item_id) > 10 AS truncated
    FROM lanes q""")
def _(t):
    found = log_answers(t)
    return found.lanes.join(found.truncated, "plan_id").select("plan_id", F.col("lane").cast("long").alias("lane"), "query", "total", "returned", "truncated")
