"""Overlays, lineage and lifecycle on items, labels and orders."""

from pyspark.sql import functions as F

from sourcemart.checks.base import check, sql
from sourcemart.functions.text import own_text
from sourcemart.operators import lineage, overlay, sessions
from sourcemart.operators.ranking import latest, page


def written(t):
    """Labels as the current facts log: a brand per labelled product, at revision 1, or 2 for toxic ones."""
    none = F.lit(None)
    return t.labels.select(
        F.col("doc_id").alias("id"), (F.col("toxic") + 1).cast("long").alias("revision"), F.lit("brand").alias("field"),
        F.concat(F.lit("Brand#"), F.col("quality")).alias("value"), none.cast("double").alias("number"), none.cast("string").alias("unit"),
        F.lit("source").alias("origin"), F.concat(F.lit("品牌：Brand#"), F.col("quality")).alias("quote"), F.lit("as stated").alias("reason"))


def edits(t):
    """One edit per labelled product at revision 1: every third repeats what is known, every seventh is unsound."""
    same = F.col("id") % 3 == 0
    return written(t).withColumn("revision", F.lit(1).cast("long")).withColumns({
        "value": F.when(same, F.col("value")).otherwise("Brand#9"), "quote": F.when(same, F.col("quote")).otherwise("品牌：Brand#9"),
        "problem": F.when(F.col("id") % 7 == 0, "unsound")})


@check("enrich", """SELECT doc_id AS id, cast(toxic + 1 AS BIGINT) AS current_revision, CASE WHEN doc_id % 7 = 0 THEN 'invalid' WHEN doc_id % 3 = 0 THEN 'unchanged'
    WHEN toxic = 1 THEN 'conflict' ELSE 'applied' END AS outcome FROM labels""")
def _(t):
    log = written(t)
    return overlay.classify_enrich(overlay.current_facts(log), overlay.revisions(log), edits(t)).select("id", "current_revision", "outcome")


@check("unlink_on_identity_change", sql("""SELECT DISTINCT name AS group_id FROM items JOIN labels ON doc_id = id WHERE id % 7 <> 0 AND id % 3 <> 0 AND toxic = 0 AND size < 3""", "items"))
def _(t):
    log = written(t)
    done = overlay.classify_enrich(overlay.current_facts(log), overlay.revisions(log), edits(t))
    links = t.items().filter("size < 3").select("id", F.col("name").alias("group_id"))
    return overlay.groups_to_dissolve(done, links)


def products(t):
    items = t.items().withColumn("supplier", F.lit(None).cast("string"))
    return items.withColumn("own_text", own_text(set(items.columns)))


@check("fact_rules", """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 1 THEN 'quantity_not_in_quote' WHEN 2 THEN 'unsupported_quantity' WHEN 3 THEN 'quote_not_in_source'
    WHEN 4 THEN 'measured_needs_source' WHEN 5 THEN 'bad_field' END AS problem, CASE WHEN p_partkey % 6 IN (0, 1, 3, 4, 5) THEN floor((p_size + CASE p_partkey % 6 WHEN 1 THEN 1 ELSE 0 END) * cast(1000 AS DOUBLE) / 1000 + cast(0.5 AS DOUBLE)) END AS number FROM part""")
def _(t):
    case = F.col("id") % 6
    size = F.col("size").cast("double")
    claims = t.items().select(
        "id", F.lit(0).cast("long").alias("revision"), F.when(case == 5, "capacity").otherwise("attr.capacity").alias("field"), F.lit(None).cast("string").alias("value"),
        (F.when(case == 1, size + 1).otherwise(size) / 1000).alias("number"), F.when(case == 2, "斗").otherwise("L").alias("unit"),
        F.when(case == 4, "inferred").otherwise("source").alias("origin"),
        F.when(case == 3, "容量：999升").otherwise(F.concat(F.lit("容量："), "size", F.lit("ml"))).alias("quote"), F.lit("as stated").alias("reason"))
    checked = overlay.validate_facts(claims, products(t))
    return checked.select("id", "problem", F.floor(F.col("number") + F.lit(0.5)).cast("double").alias("number"))


@check("derive", sql("""SELECT id, 'attr.capacity' AS field, cast(size AS DOUBLE) AS number, 'ml' AS unit, '容量：' || size || 'ml' AS quote FROM items WHERE id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT id, 'attr.material', NULL, NULL, '材质：' || p_type FROM items WHERE id NOT IN (SELECT doc_id FROM labels)""", "items"))
def _(t):
    return overlay.derive(products(t), t.facts()).select("id", "field", "number", "unit", "quote")


WORDS = ["red", "small", "bolt"]


@check("annotate", sql("""SELECT id, kind, word AS value, origin FROM (SELECT user_id AS id, event_type AS kind, word, CASE WHEN event_id % 2 = 0 THEN 'source' ELSE 'inferred' END AS origin,
      row_number() OVER (PARTITION BY user_id, event_type, word ORDER BY event_id DESC) AS r FROM (
        SELECT *, list_extract(['red', 'small', 'bolt'], cast(json_extract(props, '$.k') AS INT) % 3 + 1) AS word FROM events) e
      JOIN items ON items.id = e.user_id WHERE strpos(name, word) > 0) WHERE r = 1""", "items"))
def _(t):
    k = F.get_json_object("props", "$.k").cast("int")
    word = F.get(F.array(*[F.lit(w) for w in WORDS]), k % 3)
    entries = t.events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), F.col("event_type").alias("kind"), word.alias("value"),
                              F.when(F.col("event_id") % 2 == 0, "source").otherwise("inferred").alias("origin"), F.lit("seen").alias("reason"), word.alias("evidence"))
    return overlay.annotate(entries, products(t))[0].select("id", "kind", "value", "origin")


def brands(t):
    return t.part.select("p_brand", F.substring_index("p_brand", "#", -1).cast("int").alias("n")).distinct()


@check("synonyms", """WITH b AS (SELECT DISTINCT p_brand, cast(split_part(p_brand, '#', 2) AS INT) AS n FROM part WHERE cast(split_part(p_brand, '#', 2) AS INT) % 4 <> 1)
    SELECT 'brand' AS kind, lower(p_brand) AS term, p_brand AS display, substr(sha256('["' || lower(p_brand) || '","maker ' || n || '"]'), 1, 24) AS group_key FROM b
    UNION ALL SELECT 'brand', 'maker ' || n, 'Maker  ' || n, substr(sha256('["' || lower(p_brand) || '","maker ' || n || '"]'), 1, 24) FROM b""")
def _(t):
    b = brands(t)
    records = b.select(F.lit("brand").alias("kind"), F.array(F.col("p_brand"), F.concat(F.lit("Maker  "), "n")).alias("terms"), F.lit("same").alias("reason"))
    # Every second brand is known already: with a third name (must be taken over) or with one of the two.
    old = F.when(F.col("n") % 4 == 1, F.concat(F.lit("old "), "n")).otherwise(F.concat(F.lit("maker "), "n"))
    existing = b.filter("n % 2 = 1").select(F.lit("brand").alias("kind"), F.explode(F.array(F.lower("p_brand"), old)).alias("term"),
                                            F.concat(F.lit("g"), "n").alias("group_key"), F.col("p_brand").alias("display"))
    good, _ = overlay.vocabulary(records, existing)
    return good.select("kind", "term", "display", "group_key")


@check("expand_synonyms", """WITH b AS (SELECT DISTINCT p_brand, cast(split_part(p_brand, '#', 2) AS INT) // 5 AS g FROM part),
    p AS (SELECT DISTINCT p_brand, p_type, cast(split_part(p_brand, '#', 2) AS INT) // 5 AS g FROM part)
    SELECT p_type, p.p_brand AS term, b.p_brand AS expanded FROM p JOIN b USING (g) WHERE g < 4 UNION ALL SELECT p_type, p_brand, p_brand FROM p WHERE g >= 4""")
def _(t):
    groups = brands(t).filter("n < 20").select(F.lit("brand").alias("kind"), F.lower("p_brand").alias("term"), F.floor(F.col("n") / 5).cast("string").alias("group_key"), F.col("p_brand").alias("display"))
    asked = t.part.select("p_brand", "p_type").distinct()
    terms = asked.select(F.lit("brand").alias("kind"), F.col("p_brand").alias("term")).distinct()
    expanded = overlay.expand_synonyms(terms, groups)
    return asked.withColumnRenamed("p_brand", "term").join(expanded, "term").select("p_type", "term", "expanded")


@check("source_update", sql("""SELECT p.doc_id, CASE WHEN p.doc_id % 10 = 0 THEN 'revision_conflict' WHEN p.target = p.doc_id THEN 'supersedes_itself'
    WHEN p.target % 7 = 0 THEN 'superseded_revision_conflict' WHEN p.target IS NOT NULL AND p.import_status <> 'ready' THEN 'partial_import'
    WHEN p.target IS NOT NULL AND NOT coalesce(t.series = p.series AND p.issued_on > t.issued_on, false) THEN 'not_newer_in_series' ELSE 'applied' END AS outcome
    FROM (SELECT *, CASE WHEN doc_id % 4 = 0 THEN (doc_id + 1) % (SELECT count(*) FROM sources) WHEN doc_id % 4 = 1 THEN doc_id ELSE older END AS target FROM (
      SELECT s.*, (SELECT arg_max(e.doc_id, (e.issued_on, -e.doc_id)) FROM sources e WHERE e.series = s.series AND e.issued_on < s.issued_on) AS older FROM sources s)) p
    LEFT JOIN sources t ON t.doc_id = p.target""", "sources"))
def _(t):
    s = lineage.nearest_earlier(t.sources()).withColumn("revision", F.col("doc_id") % 3)
    current = s.select("doc_id", "revision", "series", "issued_on", "state", "import_status")
    total = t.orders.agg(F.count("*").alias("n")).scalar()
    target = F.when(F.col("doc_id") % 4 == 0, (F.col("doc_id") + 1) % total).when(F.col("doc_id") % 4 == 1, F.col("doc_id")).otherwise(F.col("earlier_doc"))
    requests = s.withColumn("target", target).select(
        "doc_id", F.when(F.col("doc_id") % 10 == 0, F.col("revision") + 1).otherwise(F.col("revision")).alias("revision"), F.lit("active").alias("status"),
        F.lit(None).cast("long").alias("series"), F.lit(None).cast("date").alias("issued_on"), F.col("target").alias("supersedes"),
        F.when(F.col("target") % 7 == 0, -1).otherwise(F.col("target") % 3).cast("long").alias("supersedes_revision"))
    return lineage.classify_updates(current, requests).select("doc_id", "outcome")


@check("link_group", sql("""SELECT gid AS group_id, count(*) AS members, CASE WHEN count(*) < 2 THEN 'bad_members'
    WHEN max(CASE WHEN id % 50 = 0 THEN 1 ELSE 0 END) = 1 THEN 'member_of_other_group' WHEN min(model) < max(model) OR min(brand) < max(brand) THEN 'conflicting_identity' END AS problem
    FROM (SELECT *, brand || '|' || name || CASE WHEN size % 2 = 0 THEN '|' || model ELSE '' END AS gid FROM items) GROUP BY 1""", "items"))
def _(t):
    p = products(t)
    gid = F.concat_ws("|", "brand", "name", F.when(F.col("size") % 2 == 0, F.col("model")))
    members = p.select(gid.alias("group_id"), "id", "brand", "model", F.lit(None).cast("string").alias("variant"), "own_text", F.col("name").alias("quote"))
    links = t.items().filter("id % 50 = 0").select("id", F.concat(F.lit("elsewhere-"), "size").alias("group_id"))
    return overlay.group_verdicts(members, links).select("group_id", "members", "problem")


@check("offer_terms", sql("""SELECT id, CASE WHEN id % 5 = 0 OR quality = 0 THEN 'invalid' WHEN toxic = 1 AND id % 2 = 0 THEN 'unchanged' WHEN toxic = 1 THEN 'conflict' ELSE 'applied' END AS outcome
    FROM items JOIN labels ON doc_id = id""", "items"))
def _(t):
    lab = t.labels.withColumnRenamed("doc_id", "id")
    p = t.items().join(lab, "id").withColumn("own_text", F.concat(F.lit("起订量："), "size", F.lit("只，含税")))
    p = p.withColumn("prices", F.create_map(F.lit("supply_price"), F.struct(F.lit("供货价").alias("label"), F.col("list_price").alias("amount"))))

    def moq(value, *more):
        def term(v, q):
            return F.struct(v.cast("string").alias("value"), q.alias("quote"))
        entries = [F.lit("moq"), term(value, F.col("own_text"))]
        for name, v in more:
            entries += [F.lit(name), term(F.lit(v), F.col("own_text"))]
        return F.create_map(*entries)

    # Known terms of toxic products: the same minimum; every other one also has a tax term that the request repeats.
    current = p.filter("toxic = 1").select("id", F.lit("supply_price").alias("field"), F.lit(1).cast("long").alias("revision"),
                                           F.when(F.col("id") % 2 == 0, moq(F.col("size"), ("tax", "included"))).otherwise(moq(F.col("size"))).alias("terms"))
    requests = p.select("id", F.when(F.col("id") % 5 == 0, "nowhere").otherwise("supply_price").alias("field"), F.lit(0).cast("long").alias("revision"),
                        moq(F.when(F.col("quality") == 0, F.col("size") * 10 + 1).otherwise(F.col("size")), ("tax", "included")).alias("terms"))
    return overlay.classify_terms(current, requests, p).select("id", "outcome")


def event_log(t):
    return t.events.select(F.col("user_id").alias("id"), F.concat(F.lit("attr."), "event_type").alias("field"), F.col("event_id").alias("revision"),
                           F.when(F.col("value") > 20, F.get_json_object("props", "$.k")).alias("value"), F.lit(None).cast("double").alias("number"),
                           F.lit(None).cast("string").alias("unit"), F.lit("source").alias("origin"))


@check("profile_view", """SELECT user_id AS id, max(event_id) AS revision, string_agg(field || '=' || k, ';' ORDER BY field) FILTER (WHERE r = 1 AND value > 20) AS facts FROM (
    SELECT *, 'attr.' || event_type AS field, json_extract_string(props, '$.k') AS k, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) GROUP BY 1""")
def _(t):
    shown = F.transform(F.sort_array(F.map_entries("facts")), lambda e: F.concat(e["key"], F.lit("="), e["value"]["value"]))
    return overlay.profiles(event_log(t)).select("id", "revision", F.array_join(shown, ";").alias("facts"))


@check("history", "SELECT event_id AS id, cast(length(props) AS BIGINT) AS payload_chars FROM events WHERE event_type = 'view' AND user_id = 8 ORDER BY event_id DESC LIMIT 10 OFFSET 2")
def _(t):
    events = t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("entity_type"), F.col("user_id").alias("entity_id"), F.col("props").alias("payload"))
    return page(overlay.history(events, "view", 8), [F.col("id").desc()], 10, 2).select("id", "payload_chars")


@check("audit_log", """WITH v AS (SELECT user_id AS id, event_type AS field, arg_max(json_extract_string(props, '$.k'), event_id) AS "after", arg_max(json_extract_string(props, '$.k'), event_id) FILTER (WHERE value <= 30) AS "before"
    FROM events GROUP BY 1, 2) SELECT id, field, "before", "after", CASE WHEN "before" IS NULL THEN 'added' ELSE 'changed' END AS change FROM v WHERE "before" IS DISTINCT FROM "after" """)
def _(t):
    log = t.events.select(F.col("user_id").alias("id"), F.col("event_type").alias("field"), "event_id", F.get_json_object("props", "$.k").alias("k"), "value")
    before, after = (latest(f, ["id", "field"], ["event_id"]) for f in (log.filter("value <= 30"), log))
    return overlay.audit(before, after, ["id", "field"], "k").select("id", "field", "before", "after", "change")


@check("review_queue", sql("""SELECT id, name FROM items WHERE id NOT IN (SELECT doc_id FROM labels) AND NOT (size > 25) ORDER BY name, id LIMIT 50 OFFSET 20""", "items"))
def _(t):
    items = t.items().withColumn("category_origin", F.when(F.col("size") > 25, "rule").otherwise("source"))
    return page(overlay.review_queue(items, t.facts(), "category"), ["name", "id"], 50, 20).select("id", "name")


@check("context_hash", sql("""SELECT o.id, sha256('{"source":"' || sha256('{"series":' || s.series || ',"issued_on":"' || strftime(s.issued_on, '%Y-%m-%d') || '","state":"active"}')
      || '","tags":' || coalesce('"' || f.folded || '"', 'null') || '}') AS context_hash
    FROM obs o JOIN sources s ON s.doc_id = o.doc_id AND s.state = 'active' LEFT JOIN (
      SELECT id, sum(cast('0x' || substr(h, 1, 15) AS HUGEINT)) || '-' || sum(cast('0x' || substr(h, 16, 15) AS HUGEINT)) AS folded FROM (
        SELECT id, sha256('{"kind":"' || kind || '","value":"' || value || '","origin":"' || origin || '"}') AS h FROM tags) GROUP BY 1) f ON f.id = o.group_id""", "obs", "sources", "tags"))
def _(t):
    rows = t.unnamed().select("doc_id", "record_key", "group_id", "supplier", "shipped")
    return t.identified(sessions.with_context(rows, t.sources(), tags=t.tags(), key="group_id")).select("id", "context_hash")
