"""Facets, statistics, coverage, fusion, relevance, usage."""

from pyspark.sql import functions as F

from sourcemart.checks.base import check, sql
from sourcemart.operators import facets, lineage, sessions
from sourcemart.operators.ranking import top_per_group
from sourcemart.plans.retrieval import fuse
from sourcemart.sources import intake
from sourcemart.streaming import tasks


@check("a_facet_count", sql("SELECT category AS value, count(*) AS count FROM obs WHERE category <> '' AND strpos(category, 'L') > 0 GROUP BY 1 ORDER BY 2 DESC, 1", "obs"))
def _(t):
    found = facets.facet(t.observations(), "category", "L")
    return found.orderBy(*facets.facet_order(found))


@check("a_facet_price", sql("SELECT field, label, count(amount) AS numeric_count FROM obs GROUP BY 1, 2", "obs"))
def _(t):
    return facets.price_facet(t.prices())


@check("a_facet_union", sql("""SELECT value, count(DISTINCT id) AS count FROM (SELECT id, coalesce((SELECT max(value) FROM facts f WHERE f.id = items.id AND f.field = 'category'), category) AS value FROM items
    UNION ALL SELECT id, 'purchase/' || value FROM tags WHERE kind = 'purchase') WHERE value <> '' GROUP BY 1""", "items", "facts", "tags"))
def _(t):
    from sourcemart.operators.overlay import effective
    tags = t.tags().filter("kind = 'purchase'").select("id", F.lit("category").alias("kind"), F.concat(F.lit("purchase/"), "value").alias("value"))
    return facets.category_facet(effective(t.items().select("id", "category"), t.facts(), ("category",)), tags)


@check("a_facet_tag", sql("SELECT kind, value, origin, count(*) AS count FROM tags WHERE strpos(value, '1') > 0 GROUP BY 1, 2, 3", "tags"))
def _(t):
    return facets.tag_facet(t.tags(), query="1")


@check("a_stats", sql("SELECT count(*) AS products, count(DISTINCT doc_id) AS sources, count(DISTINCT category) AS categories, count(DISTINCT brand) AS brands FROM obs", "obs"))
def _(t):
    return facets.stats(t.observations())


@check("a_quality", sql("""SELECT metric, cast(n AS BIGINT) AS n FROM (
    SELECT 'products' AS metric, count(*) AS n FROM items
    UNION ALL SELECT 'missing_brand', count(*) FROM items WHERE brand IS NULL OR brand = ''
    UNION ALL SELECT 'missing_supplier', count(*) FROM items
    UNION ALL SELECT 'missing_category', count(*) FROM items WHERE starts_with(category, 'PROMO/') AND id NOT IN (SELECT id FROM facts WHERE field = 'category')
    UNION ALL SELECT 'tagged_products', count(DISTINCT id) FROM tags
    UNION ALL SELECT 'incomplete_files', count(*) FROM sources WHERE import_status <> 'ready'
    UNION ALL SELECT 'enriched_products', count(DISTINCT id) FROM facts
    UNION ALL SELECT 'sources_without_version', count(*) FROM sources WHERE state = 'active' AND (series IS NULL OR issued_on IS NULL)
    UNION ALL SELECT 'grouped_products', count(*) FROM items WHERE size < 10
    UNION ALL SELECT 'categories_needing_review', count(*) FROM items WHERE id NOT IN (SELECT id FROM facts WHERE field = 'category') AND NOT (size > 25 AND strpos(category, '/') > 0 AND NOT starts_with(category, 'PROMO/'))
    UNION ALL SELECT 'ambiguous_quote_series', count(*) FROM heads WHERE undated > 0 OR at_newest > 1
    UNION ALL SELECT 'partial_newest_quotes', count(*) FROM sources s JOIN heads h ON h.series = s.series AND h.newest = s.issued_on WHERE s.state = 'active' AND s.import_status <> 'ready')""",
    "items", "facts", "tags", "heads"))
def _(t):
    promo = F.col("category").startswith("PROMO/")
    items = (t.items().withColumn("supplier", F.lit(""))
             .withColumn("category_origin", F.when(F.col("size") > 25, "rule").otherwise("source"))
             .withColumn("category", F.when(promo, "未分类").otherwise(F.col("category"))))
    return facets.quality(items, t.facts(), t.tags(), t.sources(), t.items().filter("size < 10").select("id"))


@check("a_ambiguous_series", sql("""SELECT series FROM sources s WHERE state = 'active' AND series IS NOT NULL GROUP BY series
    HAVING count(*) FILTER (WHERE issued_on IS NULL) > 0
    OR count(*) FILTER (WHERE issued_on = (SELECT max(x.issued_on) FROM sources x WHERE x.series = s.series AND x.state = 'active')) > 1""", "sources"))
def _(t):
    return lineage.ambiguous_series(t.sources())


@check("a_partial_newest", sql("""SELECT s.doc_id, s.series FROM sources s WHERE s.state = 'active' AND s.import_status <> 'ready'
    AND s.issued_on = (SELECT max(x.issued_on) FROM sources x WHERE x.series = s.series AND x.state = 'active')""", "sources"))
def _(t):
    return lineage.partial_newest(t.sources()).select("doc_id", "series")


@check("a_price_coverage", sql("""SELECT count(amount) FILTER (WHERE field = 'agent_price') AS numeric, count(*) - count(amount) FILTER (WHERE field = 'agent_price') AS unusable,
    count(*) FILTER (WHERE field = 'agent_price' AND label = 'O') AS basis_conflicts FROM obs""", "obs"))
def _(t):
    written = t.prices().withColumn("label", F.when(F.col("label") == "F", "代理价").otherwise("零售价"))
    return facets.price_coverage(written, written, "agent_price")


@check("a_issue_counts", """SELECT kind, count(*) AS n FROM (SELECT '非数值价格' AS kind FROM lineitem WHERE l_discount = cast(0.10 AS DOUBLE)
    UNION ALL SELECT '单元格错误' FROM lineitem WHERE l_tax = cast(0.08 AS DOUBLE)) GROUP BY 1""")
def _(t):
    issues = F.array_compact(F.array(
        F.when(F.col("l_discount") == 0.10, F.concat(F.lit("非数值价格:"), "l_linestatus")),
        F.when(F.col("l_tax") == 0.08, F.concat(F.lit("单元格错误:B"), "l_linenumber"))))
    return intake.issue_counts(t.lineitem.select(issues.alias("issues")))


def choices(t, *of_source):
    """Selections: one session per customer, the offers of its orders as candidates, offers in stock F selected."""
    return (t.identified(t.unnamed().join(t.sources().select("doc_id", "series", *of_source), "doc_id"))
            .select(F.col("series").alias("session_id"), "id", "doc_id", "record_key", "name", "model", "features", "category",
                    "amount", F.col("has_image").alias("selected"), *of_source))


@check("a_session_counts", sql("SELECT series AS session_id, count(*) AS candidates, count(*) FILTER (WHERE has_image) AS selected FROM obs JOIN sources USING (doc_id) GROUP BY 1", "obs", "sources"))
def _(t):
    return sessions.session_counts(choices(t))


@check("a_source_counts", sql("SELECT s.doc_id, count(o.id) AS products FROM sources s LEFT JOIN obs o USING (doc_id) GROUP BY 1", "sources", "obs"))
def _(t):
    listed = intake.source_listing(t.sources().select("doc_id"), t.observations(), t.sources().filter("state <> 'active'"))
    return listed.select("doc_id", "products")


@check("a_active_tasks", sql("""SELECT count(*) AS active FROM (SELECT task, arg_max(kind, seq) AS k,
    arg_max(kind, seq) FILTER (WHERE kind IN ('turn_started', 'turn_ended', 'error')) AS turn FROM tasks GROUP BY 1)
    WHERE turn = 'turn_started' OR k IN ('turn_started', 'question', 'answered')""", "tasks"))
def _(t):
    return tasks.active_tasks(tasks.fold_events(t.task_events().withColumnRenamed("request", "request_id"))).agg(F.count("*").alias("active"))


RANKS = """ranks AS (SELECT doc_id AS id, 0 AS lane, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents
    UNION ALL SELECT doc_id, 1, row_number() OVER (ORDER BY lang, doc_id) FROM documents
    UNION ALL SELECT doc_id, 2, row_number() OVER (ORDER BY source, doc_id) FROM documents)"""


@check("a_rrf", f"""WITH {RANKS} SELECT id, floor(list_sum(list_transform(list_sort(list({{'l': lane, 'r': rank}})), lambda p: cast(1 AS DOUBLE) / (60 + p.r))) * 1000000000 + cast(0.5 AS DOUBLE)) / 1000000000 AS score,
    string_agg(cast(lane AS VARCHAR), ',' ORDER BY lane) AS lanes FROM ranks WHERE rank <= 50 GROUP BY id""")
def _(t):
    d = t.documents.select(F.col("doc_id").alias("id"), "n_chars", "lang", "source")
    lanes = [[F.col("n_chars").desc(), "id"], ["lang", "id"], ["source", "id"]]
    ranked = None
    for number, order in enumerate(lanes):
        one = top_per_group(d.select("id", F.lit(number).alias("lane"), "n_chars", "lang", "source"), ["lane"], order, 50).select("id", "lane", "rank")
        ranked = one if ranked is None else ranked.unionByName(one)
    return fuse(ranked).select("id", (F.floor(F.col("fused") * F.lit(1e9) + F.lit(0.5)) / F.lit(1e9)).alias("score"),
                               F.array_join(F.transform("matched_lanes", lambda l: l.cast("string")), ",").alias("lanes"))


LIBRARY = r"""lib AS (SELECT doc_id AS id, trim(regexp_replace(replace(lower(split_part(text, chr(10), 1)), 'ß', 'ss'), '[\s\x{a0}\x{2000}-\x{200a}\x{3000}]+', ' ', 'g')) AS name_norm,
      trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[\s\x{a0}\x{2000}-\x{200a}\x{3000}]+', ' ', 'g')) AS all_norm FROM documents),
    toks AS (SELECT id, col, unnest([c, c || lead(c) OVER (PARTITION BY id, col ORDER BY i)]) AS g FROM (
      SELECT id, col, generate_subscripts(l, 1) AS i, unnest(l) AS c FROM (
        SELECT id, 0 AS col, string_split(name_norm, '') AS l FROM lib UNION ALL SELECT id, 1, string_split(all_norm, '') FROM lib))),
    grams AS (SELECT DISTINCT id, col, g FROM toks WHERE g IS NOT NULL AND g <> ''),
    lens AS (SELECT id, count(*) AS l FROM grams GROUP BY id),
    avgl AS (SELECT sum(l) * cast(1 AS DOUBLE) / (SELECT count(*) FROM lib) AS a FROM lens),
    corpus AS (SELECT count(*) AS n FROM lib)"""


@check("a_bm25", f"""WITH {LIBRARY}, q AS (SELECT unnest(['th', 'he', 'ti', 'io', 'on']) AS g),
    idf AS (SELECT g, CASE WHEN ln((n - d + cast(0.5 AS DOUBLE)) / (d + cast(0.5 AS DOUBLE))) <= 0 THEN cast(1e-6 AS DOUBLE)
        ELSE ln((n - d + cast(0.5 AS DOUBLE)) / (d + cast(0.5 AS DOUBLE))) END AS w
      FROM (SELECT q.g, (SELECT count(*) FROM grams WHERE grams.g = q.g AND col = 1) AS d, n FROM q, corpus))
    SELECT lib.id, floor(-(SELECT sum(w) FROM idf) * cast(2.2 AS DOUBLE) / (1 + cast(1.2 AS DOUBLE) * (cast(0.25 AS DOUBLE) + cast(0.75 AS DOUBLE) * lens.l / avgl.a)) * 1000000 + cast(0.5 AS DOUBLE)) / 1000000 AS score
    FROM lib JOIN lens USING (id), avgl WHERE strpos(all_norm, 'the') > 0 AND strpos(all_norm, 'tion') > 0""")
def _(t):
    found = t.library().find(["the", "tion"], "all_norm")
    return found.select("id", (F.floor(F.col("score") * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)).alias("score"))


@check("a_usage_max", """SELECT user_id AS thread, cast(max(floor(value * 100)) AS BIGINT) AS total, arg_max(event_id, (floor(value * 100), -event_id)) AS event_id FROM events WHERE event_type <> 'error' GROUP BY 1""")
def _(t):
    usage = t.events.select(F.col("user_id").alias("thread"), F.when(F.col("event_type") != "error", F.floor(F.col("value") * 100)).alias("total"), "event_id")
    return tasks.usage_max(usage, "event_id").select("thread", "total", "event_id")
