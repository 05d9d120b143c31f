"""Join kinds. No broadcast is asked for: sizes are Catalyst's and AQE's to judge."""

from pyspark.sql import functions as F

from sourcemart.checks.base import check, sql
from sourcemart.operators import lineage
from sourcemart.operators.overlay import effective
from sourcemart.sources import cells
from sourcemart.sources.evidence import text_evidence


@check("j_inner_equi", sql("SELECT id, doc_id, state, import_status FROM obs JOIN sources USING (doc_id)", "obs", "sources"))
def _(t):
    return t.observations().join(t.sources(), "doc_id").select("id", "doc_id", "state", "import_status")


@check("j_left_outer", sql("SELECT s.doc_id, o.id, o.amount FROM sources s LEFT JOIN obs o ON o.doc_id = s.doc_id AND o.field = 'retail_price'", "sources", "obs"))
def _(t):
    retail = t.observations().filter("field = 'retail_price'").select("doc_id", "id", "amount")
    return t.sources().select("doc_id").join(retail, "doc_id", "left")


@check("j_semi", sql("SELECT id FROM items WHERE EXISTS (SELECT 1 FROM events e WHERE e.user_id = items.id AND e.value > 90)", "items"))
def _(t):
    hot = t.events.filter("value > 90").select(F.col("user_id").alias("id"))
    return t.items().select("id").join(hot, "id", "left_semi")


@check("j_anti", sql("SELECT id, name FROM items WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = items.id)", "items"))
def _(t):
    return t.items().select("id", "name").join(t.labels.select(F.col("doc_id").alias("id")), "id", "left_anti")


@check("j_nonequi_self", sql("""SELECT s.doc_id FROM sources s WHERE NOT EXISTS (SELECT 1 FROM sources o
    WHERE o.series = s.series AND o.doc_id <> s.doc_id AND (o.issued_on IS NULL OR o.issued_on >= s.issued_on))""", "sources"))
def _(t):
    # The same rule over sources of any state: newest date alone in its series.
    every = t.sources().withColumn("state", F.lit("active")).withColumn("import_status", F.lit("ready"))
    return lineage.latest_sources(every).select("doc_id")


@check("j_scalar_overlay", sql("SELECT o.id, coalesce((SELECT max(value) FROM facts f WHERE f.id = o.group_id AND f.field = 'category'), o.category) AS category FROM obs o", "obs", "facts"))
def _(t):
    return effective(t.observations().select("id", "group_id", "category"), t.facts(), ("category",), "group_id").select("id", "category")


@check("j_corr_max", sql("""SELECT s.doc_id, s.series, s.issued_on = (SELECT max(x.issued_on) FROM sources x WHERE x.series = s.series AND x.state = 'active') AS is_newest
    FROM sources s WHERE s.state = 'active'""", "sources"))
def _(t):
    s = t.sources()
    newest = lineage.series_heads(s).select("series", "newest")
    return s.filter("state = 'active'").join(newest, "series").select("doc_id", "series", (F.col("issued_on") == F.col("newest")).alias("is_newest"))


PARTS_PER_TASK = 100_000


def grid(t):
    """Parts as sheets of 25 rows below a header: 40 books to a thousand parts, two sheets each.

    A small file holds many parts, and every part becomes many cells; so parts are dealt out where they are read, else one or
    two tasks make and hold all cells.
    """
    p = t.part
    p = p.repartition(max(t.spark.sparkContext.defaultParallelism, -(-p.count() // PARTS_PER_TASK)), "p_partkey")
    place = F.col("p_partkey")
    return p.select(F.concat(F.lit("book-"), F.floor(place / 50)).alias("doc"), F.concat(F.lit("s"), F.floor(place % 50 / 25)).alias("sheet"),
                    (place % 25 + 2).cast("int").alias("row"), *p.columns)


GRID = """grid AS (SELECT 'book-' || (p_partkey // 50) AS doc, 's' || (p_partkey % 50 // 25) AS sheet, cast(p_partkey % 25 + 2 AS INT) AS "row", part.* FROM part)"""


@check("j_range", f"""WITH {GRID}, merges AS (SELECT doc, sheet, "row" AS top, "row" + 2 AS bottom, p_name FROM grid WHERE p_partkey % 5 = 1)
    SELECT g.doc, g.sheet, cast(g."row" AS BIGINT) AS "row", coalesce(m.p_name, g.p_name) AS value FROM grid g
    LEFT JOIN merges m ON m.doc = g.doc AND m.sheet = g.sheet AND g."row" BETWEEN m.top AND m.bottom""")
def _(t):
    g = grid(t)
    values = g.select("doc", "sheet", "row", F.lit(2).alias("col"), F.col("p_name").alias("value"), F.lit("s").alias("dtype"))
    merges = g.filter("p_partkey % 5 = 1").select("doc", "sheet", F.col("row").alias("top"), F.lit(2).alias("left"),
                                                  (F.col("row") + 2).alias("bottom"), F.lit(2).alias("right"))
    return cells.resolve_merges(values, merges).select("doc", "sheet", F.col("row").cast("long").alias("row"), "value")


@check("j_interval_overlap", f"""WITH {GRID}, r AS (SELECT doc, sheet, p_partkey AS region, "row" AS top, "row" + p_size % 3 AS bottom,
      p_size % 7 * 4 AS lft, p_size % 7 * 4 + 5 AS rgt FROM grid)
    SELECT a.doc, a.sheet, a.region, b.region AS other FROM r a JOIN r b ON a.doc = b.doc AND a.sheet = b.sheet AND a.region < b.region
    AND a.top <= b.bottom AND a.bottom >= b.top AND a.lft <= b.rgt AND a.rgt >= b.lft""")
def _(t):
    return cells.check_overlaps(regions(t))


def regions(t):
    left = (F.col("p_size") % 7 * 4).alias("left")
    return grid(t).select("doc", "sheet", F.col("p_partkey").alias("region"), F.col("row").alias("top"), left,
                          (F.col("row") + F.col("p_size") % 3).alias("bottom"), (F.col("p_size") % 7 * 4 + 5).alias("right"))


@check("j_nearest_earlier", sql("""SELECT s.doc_id, strftime((SELECT max(e.issued_on) FROM sources e WHERE e.series = s.series AND e.issued_on < s.issued_on), '%Y-%m-%d') AS earlier_on,
    (SELECT arg_max(e.doc_id, (e.issued_on, -e.doc_id)) FROM sources e WHERE e.series = s.series AND e.issued_on < s.issued_on) AS earlier_doc FROM sources s""", "sources"))
def _(t):
    return lineage.nearest_earlier(t.sources()).select("doc_id", F.date_format("earlier_on", "yyyy-MM-dd").alias("earlier_on"), "earlier_doc")


@check("j_containment", sql(r"""SELECT c.doc_id, c.ref, c.quote, coalesce(strpos(l.text, c.quote) > 0, false) AS holds
    FROM (SELECT doc_id, 'line:' || (1 + doc_id % 3) AS ref, 1 + doc_id % 3 AS n, substr(text, 3, 5) AS quote FROM documents) c
    LEFT JOIN (SELECT * FROM doclines WHERE regexp_matches(text, '[^\s\x1c-\x1f\x{85}\x{a0}\x{2000}-\x{200a}\x{3000}]')) l ON l.doc = c.doc_id AND l.n = c.n""", "doclines"))
def _(t):
    docs = t.documents
    claims = docs.select("doc_id", F.concat(F.lit("line:"), (1 + F.col("doc_id") % 3).cast("string")).alias("ref"), F.substring("text", 3, 5).alias("quote"))
    entries = text_evidence(docs.select(F.col("doc_id").alias("doc"), "text")).select(F.col("doc").alias("doc_id"), "ref", "text")
    return claims.join(entries, ["doc_id", "ref"], "left").select("doc_id", "ref", "quote", F.coalesce(F.contains("text", "quote"), F.lit(False)).alias("holds"))
