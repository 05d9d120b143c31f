"""Ranks, orders, pages and set operations."""

from pyspark.sql import functions as F

from sourcemart.checks.aggregates import LIBRARY, RANKS
from sourcemart.checks.base import check, sql
from sourcemart.operators import ranking, sets
from sourcemart.operators.ranking import latest, numbered, page, price_order, top_per_group
from sourcemart.plans.search import browse_rank
from sourcemart.sources.cells import assign_ids
from sourcemart.streaming import tasks

OBS_ORDER = ["doc_id", "record_key", "id"]


@check("w_interleave", sql("""SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY doc_id, record_key, id) AS browse_rank FROM obs""", "obs"))
def _(t):
    return browse_rank(t.observations().select("id", "category", "doc_id", "record_key")).select("id", "category", "browse_rank")


@check("w_lane_rank", sql("SELECT * FROM (SELECT id, field AS lane, row_number() OVER (PARTITION BY field ORDER BY amount NULLS LAST, id) AS rank FROM obs) WHERE rank <= 30", "obs"))
def _(t):
    rows = t.observations().select("id", F.col("field").alias("lane"), "amount")
    return top_per_group(rows, ["lane"], [price_order("amount"), "id"], 30).select("id", "lane", "rank")


@check("w_group_rep", sql("""SELECT group_id, max(id) FILTER (WHERE r = 1) AS id, count(*) AS matching_offers,
    coalesce(string_agg(id, ',' ORDER BY r) FILTER (WHERE r BETWEEN 2 AND 4), '') AS alternatives, count(*) > 4 AS more
    FROM (SELECT id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY amount NULLS LAST, id) AS r FROM obs) GROUP BY 1""", "obs"))
def _(t):
    rows = t.observations().select("id", "group_id", "amount").withColumn("place", F.struct(F.col("amount").isNull(), "amount", "id"))
    heads = ranking.group_representatives(rows, [], "group_id", "place", "id")
    return heads.select("group_id", "id", "matching_offers", F.array_join("alternative_ids", ",").alias("alternatives"), F.col("alternatives_more").alias("more"))


@check("w_diversity", sql("""SELECT id, row_number() OVER (ORDER BY turn, first_place) AS shown FROM (
    SELECT id, row_number() OVER (PARTITION BY top ORDER BY place) AS turn, min(place) OVER (PARTITION BY top) AS first_place
    FROM (SELECT id, split_part(category, '/', 1) AS top, row_number() OVER (ORDER BY amount DESC NULLS LAST, id) AS place FROM obs))""", "obs"))
def _(t):
    # Ids travel as their 32 bytes, which sort as the text does; the dearest come first and unknown prices last.
    rows = t.observations().select(F.unhex("id").alias("id"), F.element_at(F.split("category", "/"), 1).alias("top"),
                                   F.col("amount").isNull().alias("unknown"), (-F.col("amount")).alias("down"))
    shown = ranking.diversify_all(rows, "top", ["unknown", "down", "id"])
    return shown.select(F.lower(F.hex("id")).alias("id"), "shown")


@check("w_occurrence", sql("SELECT id, row_number() OVER (PARTITION BY doc_id, name ORDER BY record_key, id) - 1 AS occurrence FROM obs", "obs"))
def _(t):
    rows = t.observations().select("id", "doc_id", "name", "record_key")
    return numbered(rows, ["doc_id", "name"], ["record_key", "id"], "n").select("id", (F.col("n") - 1).alias("occurrence"))


@check("occurrence_id", sql("""SELECT obs_id, 'p_' || substr(sha256('["' || concat_ws('","', doc_id, field, identity, n) || '"]'), 1, 16) AS id FROM (
    SELECT id AS obs_id, doc_id, field, model AS identity, row_number() OVER (PARTITION BY doc_id, field, model ORDER BY record_key, id) - 1 AS n FROM obs)""", "obs"))
def _(t):
    # Rows are dealt out by source before ids are made.
    rows = t.identified(t.unnamed().repartition("doc_id")).select(
        F.col("id").alias("obs_id"), "doc_id", F.col("field").alias("sheet"), "name", "model", F.lit(None).cast("string").alias("variant"), "record_key")
    return assign_ids(rows, "doc_id", ["record_key", "obs_id"]).select("obs_id", "id")


@check("w_latest_revision", """SELECT user_id AS id, event_type AS field, event_id AS revision, value FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1""")
def _(t):
    log = t.events.select(F.col("user_id").alias("id"), F.col("event_type").alias("field"), F.col("event_id").alias("revision"), "value")
    return latest(log, ["id", "field"], ["revision"])


@check("w_series_order", sql("""SELECT doc_id, series, cast(dense_rank() OVER (PARTITION BY series ORDER BY issued_on DESC) AS BIGINT) AS place,
    count(*) OVER (PARTITION BY series, issued_on) AS ties FROM sources""", "sources"))
def _(t):
    dates = t.sources().groupBy("series", "issued_on").agg(F.count("*").alias("ties"))
    placed = numbered(dates, ["series"], [F.col("issued_on").desc()], "place")
    return t.sources().join(placed, ["series", "issued_on"]).select("doc_id", "series", "place", "ties")


@check("w_event_seq", sql("SELECT seq, task, row_number() OVER (PARTITION BY task ORDER BY seq) AS n FROM tasks", "tasks"))
def _(t):
    return numbered(t.task_events().select("seq", "task"), ["task"], ["seq"], "n")


@check("s_relevance", f"""WITH {LIBRARY} SELECT lib.id, row_number() OVER (ORDER BY lens.l, lib.id) AS place FROM lib JOIN lens USING (id)
    WHERE strpos(all_norm, 'tion') > 0 ORDER BY lens.l, lib.id LIMIT 50""")
def _(t):
    # All hits hold all query grams, so a shorter text scores better and equal lengths go by id.
    best = t.library().find(["tion"], "all_norm").withColumn("_all", F.lit(1))
    return top_per_group(best, ["_all"], ["score", "id"], 50, "place").select("id", "place")


@check("s_price", sql("""SELECT * FROM (SELECT id, 'up' AS way, amount FROM obs ORDER BY amount NULLS LAST, id LIMIT 100)
    UNION ALL SELECT * FROM (SELECT id, 'down', amount FROM obs ORDER BY amount DESC NULLS LAST, id LIMIT 100)""", "obs"))
def _(t):
    obs = t.observations().select("id", "amount")
    up = page(obs, [price_order("amount"), "id"], 100).select("id", F.lit("up").alias("way"), "amount")
    down = page(obs, [price_order("amount", True), "id"], 100).select("id", F.lit("down").alias("way"), "amount")
    return up.unionByName(down)


@check("s_source_order", sql("SELECT id, doc_id, field, record_key FROM obs ORDER BY doc_id, field, record_key, id", "obs"))
def _(t):
    return t.observations().select("id", "doc_id", "field", "record_key").orderBy("doc_id", "field", "record_key", "id")


@check("s_topk_lane", sql("""SELECT id, field, amount FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY amount NULLS LAST, id) AS r FROM obs)
    WHERE r <= 20 ORDER BY amount NULLS LAST, id LIMIT 30""", "obs"))
def _(t):
    best = top_per_group(t.observations().select("id", "field", "amount"), ["field"], [price_order("amount"), "id"], 20)
    return page(best, [price_order("amount"), "id"], 30).select("id", "field", "amount")


@check("s_page", sql("""SELECT id, total, CASE WHEN total > 60 THEN 60 END AS next_offset FROM (SELECT id, count(*) OVER () AS total, row_number() OVER (ORDER BY doc_id, record_key, id) AS r
    FROM obs WHERE field = 'agent_price') WHERE r BETWEEN 41 AND 60""", "obs"))
def _(t):
    agent = t.observations().filter("field = 'agent_price'").select("id", "doc_id", "record_key")
    info = ranking.page_info(agent, 20, 40)
    # The report is one row; it is attached to the page's twenty rows by a scalar subquery, not a join.
    rows = page(agent, OBS_ORDER, 20, 40)
    return rows.select("id", info.select("total").scalar().alias("total"), info.select("next_offset").scalar().alias("next_offset"))


@check("s_recent", sql("SELECT doc_id, strftime(issued_on, '%Y-%m-%d') AS issued_on FROM sources ORDER BY sources.issued_on DESC, doc_id DESC LIMIT 25", "sources"))
def _(t):
    recent = page(t.sources(), [F.col("issued_on").desc(), F.col("doc_id").desc()], 25)
    return recent.select("doc_id", F.date_format("issued_on", "yyyy-MM-dd").alias("issued_on"))


@check("s_cursor", sql("SELECT task, seq, kind FROM tasks WHERE task = 8 AND seq > 100 ORDER BY seq LIMIT 20", "tasks"))
def _(t):
    return tasks.read_since(t.task_events(), 8, 100, 20).select("task", "seq", "kind")


@check("u_union_all", sql("SELECT id, category AS value FROM items UNION ALL SELECT id, value FROM tags WHERE kind = 'view'", "items", "tags"))
def _(t):
    return sets.union_all(t.items().select("id", F.col("category").alias("value")), t.tags().filter("kind = 'view'").select("id", "value"))


@check("u_union_distinct", f"""WITH {RANKS} SELECT DISTINCT id FROM ranks WHERE rank <= 50 AND lane < 2""")
def _(t):
    d = t.documents.select(F.col("doc_id").alias("id"), "n_chars", "lang")
    return sets.union_distinct(page(d, [F.col("n_chars").desc(), "id"], 50).select("id"), page(d, ["lang", "id"], 50).select("id"))


@check("u_subset", "SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'error' AND value > 50 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click' AND value > 99)")
def _(t):
    wanted = t.events.filter("event_type = 'error' AND value > 50").select(F.col("user_id").alias("id")).distinct()
    return sets.offenders(wanted, t.events.filter("event_type = 'click' AND value > 99").select(F.col("user_id").alias("id")))


@check("u_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(t):
    return sets.difference(t.documents.select("doc_id"), t.labels.select("doc_id"))


@check("u_intersect", sql("SELECT id FROM obs WHERE field = 'retail_price' INTERSECT SELECT id FROM obs WHERE amount IS NULL", "obs"))
def _(t):
    obs = t.observations()
    return sets.intersection(obs.filter("field = 'retail_price'").select("id"), obs.filter("amount IS NULL").select("id"))
