import random

import pytest
from pyspark.sql import Window, functions as F

from sourcemart.checks import REGISTRY
from sourcemart.operators import facets, filters, governance, lineage, overlay, ranking, sessions, textindex
from sourcemart.functions.text import normalize
from sourcemart.plans import retrieval, search
from sourcemart.plans.search import Pool


# -- ranking ---------------------------------------------------------------------------------------------------------

def test_numbering_equals_a_window_with_a_hot_group(spark, rows):
    rng = random.Random(3)
    data = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.randint(0, 50), i) for i in range(3000)]
    frame = spark.createDataFrame(data, "g string, k int, id int").repartition(7)
    window = frame.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("k", "id")).cast("long"))
    assert rows(ranking.numbered(frame, ["g"], ["k", "id"])) == rows(window)
    assert rows(ranking.numbered(frame, ["g"], ["k", "id"], hot_rows=1000)) == rows(window)  # one hot group of four
    assert rows(ranking.numbered(frame, ["g"], ["k", "id"], hot_rows=100)) == rows(window)  # all are hot
    whole = frame.withColumn("rank", F.row_number().over(Window.orderBy(F.col("k").desc(), "id")).cast("long"))
    assert rows(ranking.numbered(frame, [], [F.col("k").desc(), "id"])) == rows(whole)


def test_turns_of_buckets_follow_from_their_sizes(spark, rows):
    rng = random.Random(5)
    data = [(rng.choice(["x"] * 5 + ["y", "y", "z", None]), rng.randint(0, 9), i) for i in range(400)]
    frame = spark.createDataFrame(data, "b string, k int, id int")
    placed = frame.withColumn("place", F.row_number().over(Window.orderBy("k", "id")))
    want = rows(ranking.diversify(placed, [], "b", "place").drop("place"))
    assert rows(ranking.diversify_all(frame, "b", ["k", "id"])) == want
    assert rows(ranking.diversify_all(frame, "b", ["k", "id"], few=2)) == want
    assert ranking.diversify_all(frame.limit(0), "b", ["k", "id"]).isEmpty()


def test_small_groups_are_numbered_in_one_shuffle(large):
    numbers = ranking.numbered(large.range(2000).select((F.col("id") % 900).alias("g"), "id"), ["g"], ["id"])
    assert len(moved_columns(numbers)) == 1


def test_top_per_group_limits_before_the_shuffle(spark):
    frame = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    top = ranking.top_per_group(frame, ["g"], [F.col("id").desc()], 2)
    assert top.count() == 6
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_latest_takes_whole_rows(spark, rows):
    frame = spark.createDataFrame([("a", 1, "x", None), ("a", 3, None, "z"), ("a", 2, "y", "y"), ("b", 1, "q", "q")], "k string, v int, p string, q string")
    assert rows(ranking.latest(frame, ["k"], ["v"])) == [("a", 3, None, "z"), ("b", 1, "q", "q")]


def test_unknown_prices_come_last_both_ways(spark):
    frame = spark.createDataFrame([(1, 5.0), (2, None), (3, 7.0)], "id int, amount double")
    assert [r["id"] for r in frame.orderBy(ranking.price_order("amount")).collect()] == [1, 3, 2]
    assert [r["id"] for r in frame.orderBy(ranking.price_order("amount", True)).collect()] == [3, 1, 2]


# -- lineage ---------------------------------------------------------------------------------------------------------

SOURCE = "doc_id string, revision long, series string, issued_on date, state string, import_status string"


def source(spark, *data):
    import datetime
    made = [(d, r, s, datetime.date.fromisoformat(on) if on else None, st, im) for d, r, s, on, st, im in data]
    return spark.createDataFrame(made, SOURCE)


@pytest.mark.parametrize("second, latest, ambiguous, partial", [
    (("b", 0, "s", "2026-09-01", "active", "ready"), ["b"], 0, 0), (("b", 0, "s", "2026-09-01", "active", "partial"), [], 0, 1),
    (("b", 0, "s", "2026-08-01", "active", "ready"), [], 1, 0), (("b", 0, "s", None, "active", "ready"), [], 1, 0),
    (("b", 0, "s", "2026-09-01", "withdrawn", "ready"), ["a"], 0, 0), (("b", 0, None, "2026-09-01", "active", "ready"), ["a"], 0, 0)])
def test_latest_needs_one_known_newest_complete_source(spark, second, latest, ambiguous, partial):
    s = source(spark, ("a", 0, "s", "2026-08-01", "active", "ready"), second)
    assert sorted(r["doc_id"] for r in lineage.latest_sources(s).collect()) == latest
    assert lineage.ambiguous_series(s).count() == ambiguous
    assert lineage.partial_newest(s).count() == partial


REQUEST = "doc_id string, revision long, status string, series string, issued_on date, supersedes string, supersedes_revision long"


@pytest.mark.parametrize("request_row, outcome", [
    (("b", 1, None, None, None, "a", 1), "applied"), (("b", 0, None, None, None, "a", 1), "revision_conflict"), (("b", 1, None, None, None, "a", 0), "superseded_revision_conflict"),
    (("b", 1, None, None, None, "b", 1), "supersedes_itself"), (("a", 1, None, None, None, "b", 1), "not_newer_in_series"), (("c", 1, None, None, None, "a", 1), "partial_import"),
    (("zz", 0, None, None, None, None, None), "unknown_source"), (("b", 1, "superseded", None, None, None, None), "use_supersedes"), (("b", 1, None, "other", None, "a", 1), "not_newer_in_series"),
    (("b", 1, "withdrawn", None, None, None, None), "applied")])
def test_source_updates(spark, request_row, outcome):
    current = source(spark, ("a", 1, "s", "2026-08-01", "active", "ready"), ("b", 1, "s", "2026-09-01", "active", "ready"), ("c", 1, "s", "2026-10-01", "active", "partial"))
    done = lineage.classify_updates(current, spark.createDataFrame([request_row], REQUEST))
    assert done.first()["outcome"] == outcome


def test_a_superseded_source_is_retired_by_its_replacement(spark, rows):
    current = source(spark, ("a", 1, "s", "2026-08-01", "active", "ready"), ("b", 1, "s", "2026-09-01", "active", "ready"))
    done = lineage.classify_updates(current, spark.createDataFrame([("b", 1, None, None, None, "a", 1)], REQUEST))
    assert rows(lineage.state_rows(current, done), "doc_id", "revision", "state", "superseded_by") == [("a", 2, "superseded", "b"), ("b", 2, "active", None)]


def test_dates_need_evidence(spark, rows):
    asked = spark.sql("SELECT 'a' AS doc_id, DATE'2026-08-01' AS issued_on, array('报价２０２６年8月1日') AS quotes UNION ALL SELECT 'b', DATE'2026-08-01', array('2026-08-02') UNION ALL SELECT 'c', DATE'2026-08-01', array()")
    assert rows(lineage.dated_evidence(asked), "doc_id") == [("b",), ("c",)]


# -- overlays --------------------------------------------------------------------------------------------------------

FACT = "id string, revision long, field string, value string, number double, unit string, origin string, quote string, reason string"
OWN = "远行保温杯\n品牌：远行\n容量：0.5L\n材质：不锈钢"


@pytest.fixture
def product(spark):
    return spark.createDataFrame([("p", OWN), ("q", "茶点礼盒")], "id string, own_text string")


def enrich(spark, product, log, *records):
    checked = overlay.validate_facts(spark.createDataFrame(list(records), FACT), product)
    return overlay.classify_enrich(overlay.current_facts(log), overlay.revisions(log), checked)


def outcomes(frame):
    return {r["id"]: r["outcome"] for r in frame.collect()}


def test_enrich_repeat_conflict_clear_and_history(spark, product, rows):
    log = spark.createDataFrame([], FACT)
    brand = ("p", 0, "brand", "远行", None, None, "source", "品牌：远行", "stated")
    first = enrich(spark, product, log, brand)
    assert outcomes(first) == {"p": "applied"}
    log = log.unionByName(overlay.fact_rows(first))
    assert rows(log, "revision", "value") == [(1, "远行")]
    assert outcomes(enrich(spark, product, log, brand)) == {"p": "unchanged"}
    other = ("p", 0, "brand", "保温", None, None, "source", "远行保温杯", "stated")
    assert outcomes(enrich(spark, product, log, other)) == {"p": "conflict"}
    clear = ("p", 1, "brand", None, None, None, "source", "品牌：远行", "wrong")
    cleared = enrich(spark, product, log, clear)
    log = log.unionByName(overlay.fact_rows(cleared))
    assert overlay.current_facts(log).isEmpty() and overlay.revisions(log).first()["revision"] == 2 and log.count() == 2


@pytest.mark.parametrize("fact, problem", [
    (("p", 0, "attr.capacity", None, 500.0, "ml", "source", "容量：0.5L", "r"), None), (("p", 0, "attr.capacity", None, 800.0, "ml", "source", "容量：0.5L", "r"), "quantity_not_in_quote"),
    (("p", 0, "attr.capacity", None, 500.0, "ml", "inferred", "容量：0.5L", "r"), "measured_needs_source"), (("q", 0, "brand", "远行", None, None, "source", "品牌：远行", "r"), "quote_not_in_source"),
    (("p", 0, "colour", "x", None, None, "source", "远行", "r"), "bad_field"), (("p", 0, "category", "家居/杯壶", None, None, "inferred", "保温杯", "r"), None),
    (("p", 0, "category", "家居/杯壶", None, None, "source", "保温杯", "r"), "value_not_in_quote"), (("z", 0, "brand", "x", None, None, "source", "x", "r"), "unknown_product"),
    (("p", 0, "brand", None, None, "ml", "source", "远行", "r"), "unit_without_value"), (("p", 0, "brand", "远行", None, None, "guess", "远行", "r"), "bad_origin_or_reason")])
def test_fact_rules(spark, product, fact, problem):
    assert overlay.validate_facts(spark.createDataFrame([fact], FACT), product).first()["problem"] == problem


def test_derive_takes_single_explicit_values_once(spark, product, rows):
    nothing = spark.createDataFrame([], "id string, field string")
    found = overlay.derive(product, nothing)
    assert rows(found, "field", "number", "unit") == [("attr.capacity", 500.0, "ml"), ("attr.material", None, None), ("brand", None, None)]
    assert overlay.derive(product, found.select("id", "field")).isEmpty()
    twice = spark.createDataFrame([("p", "容量：1L\n容量：2L"), ("q", "容量：1L左右")], "id string, own_text string")
    assert overlay.derive(twice, nothing).isEmpty()


def test_identity_change_dissolves_the_group(spark, product, rows):
    log = spark.createDataFrame([], FACT)
    done = enrich(spark, product, log, ("p", 0, "brand", "远行", None, None, "source", "品牌：远行", "stated"))
    links = spark.createDataFrame([("p", "g"), ("x", "g"), ("y", "h")], "id string, group_id string")
    gone = overlay.groups_to_dissolve(done, links)
    assert rows(gone) == [("g",)]
    assert rows(overlay.dissolve(links, gone), "id") == [("y",)]


def test_tags_quote_their_product(spark, product, rows):
    entries = spark.createDataFrame([(1, "p", "occasion", "新年", "inferred", "r", "远行"), (2, "p", "occasion", "新年", "inferred", "r2", "保温杯"), (3, "p", "material", "不锈钢", "source", "r", "材质：不锈钢"),
                                     (4, "p", "material", "铁", "source", "r", "材质：不锈钢"), (5, "q", "occasion", "x", "inferred", "r", "保温杯")],
                                    "seq int, id string, kind string, value string, origin string, reason string, evidence string")
    tags, rejects = overlay.annotate(entries, product)
    assert rows(tags, "kind", "value", "reason") == [("material", "不锈钢", "r"), ("occasion", "新年", "r2")]
    assert rows(rejects, "seq", "problem") == [(4, "source_tag_not_in_evidence"), (5, "evidence_not_in_source")]


def test_synonym_groups_are_extended_whole(spark, rows):
    none = spark.createDataFrame([], "kind string, term string, group_key string, display string")
    kind = "kind string, terms array<string>, reason string"
    good, bad = overlay.vocabulary(spark.createDataFrame([("query", ["充电宝", "移动电源"], "r")], kind), none)
    assert bad.isEmpty() and good.count() == 2
    _, bad = overlay.vocabulary(spark.createDataFrame([("query", ["充电宝", "便携电源"], "r")], kind), good)
    assert rows(bad, "problem") == [("incomplete_existing_group",)]
    more, bad = overlay.vocabulary(spark.createDataFrame([("query", ["充电宝", "便携电源", "移动电源"], "r")], kind), good)
    assert bad.isEmpty()
    asked = spark.createDataFrame([("query", "充电宝"), ("query", "杯")], "kind string, term string")
    assert rows(overlay.expand_synonyms(asked, more)) == [("query", "充电宝", "便携电源"), ("query", "充电宝", "充电宝"), ("query", "充电宝", "移动电源"), ("query", "杯", "杯")]
    assert search.lookup_synonyms(more, [("query", "充电宝")])[("query", "充电宝")] == ["便携电源", "充电宝", "移动电源"]


# -- sessions --------------------------------------------------------------------------------------------------------

def moved_columns(frame):
    """Columns that each exchange of the plan for large tables moves."""
    plan = frame._jdf.queryExecution().executedPlan()
    while plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.initialPlan()
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            found.append({node.output().apply(i).name() for i in range(node.output().size())})
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


@pytest.fixture
def large(spark):
    """Joins as for tables that are too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("key", ["freeze", "freeze_snapshot", "verify_drift", "seal", "context_hash", "occurrence_id", "public_view"])
def test_ids_are_made_after_the_shuffles(large, key):
    moved = moved_columns(REGISTRY[key].run(large, "/root/testdata/sf0.001"))
    assert moved and not [m for m in moved if "id" in m and "doc_id" in m]


def test_freezing_by_source_equals_freezing_by_id(spark, rows):
    price = "prices map<string,struct<label:string,value:string,amount:double,error:string>>"
    obs = spark.createDataFrame([(k, d, "g" + k, {"p": ("l", "1", 1.0, None)}, "h") for k, d in (("a", 1), ("b", 1), ("c", 2))], f"id string, doc_id int, item string, {price}, payload_hash string")
    sources = spark.createDataFrame([(1, 7, None, "active"), (2, 7, None, "withdrawn")], "doc_id int, series int, issued_on date, state string")
    chosen = spark.createDataFrame([("s", 1, "a", 0), ("s", 2, "c", 1), ("s", 1, "none", 2)], "session_id string, doc_id int, id string, position int")
    tags = spark.createDataFrame([("ga", "k", str(i), "source") for i in range(7)], "id string, kind string, value string, origin string")
    apart = sessions.freeze(obs, chosen, ["p"], sessions.context_hash(obs, sources), tags, "item")
    held = sessions.with_context(sessions.with_tags(obs, tags, "item"), sources, how="left")
    together = sessions.freeze(held, chosen, ["p"], by=("doc_id", "id"))
    assert rows(together) == rows(apart)
    assert rows(apart, "id", "problem") == [("a", None), ("c", "source_not_active"), ("none", "unknown_id")]


def test_selection_revision_membership_and_seal(spark, rows):
    table = spark.createDataFrame([("s", "春节 100%_", "open", 0, 1), ("t", "x", "sealed", 0, 1)], "session_id string, title string, state string, revision long, version long")
    choices = spark.createDataFrame([("s", "a", False, "h", "c"), ("s", "b", False, "h", None)], "session_id string, id string, selected boolean, payload_hash string, context_hash string")

    def ask(session, revision, ids):
        return spark.createDataFrame([(session, revision, ids)], "session_id string, revision long, ids array<string>")

    good = sessions.apply_selection(table, choices, ask("s", 0, ["a"]))
    assert rows(good, "outcome", "next_revision") == [("applied", 1)]
    chosen = sessions.selected_after(choices, good)
    assert rows(chosen, "id", "selected") == [("a", True), ("b", False)]
    for session, revision, ids, outcome in (("s", 1, ["a"], "conflict"), ("s", 0, ["zz"], "outside"), ("t", 0, [], "conflict"), ("u", 0, [], "unknown")):
        assert sessions.apply_selection(table, choices, ask(session, revision, ids)).first()["outcome"] == outcome
    same = spark.createDataFrame([("a", "h", "c"), ("b", "h", "c2")], "id string, payload_hash string, context_hash string")
    assert sessions.drift(chosen, same).isEmpty()
    moved = spark.createDataFrame([("a", "h", "c9"), ("b", "h9", "c2")], "id string, payload_hash string, context_hash string")
    assert rows(sessions.drift(chosen, moved), "id", "drift") == [("a", "context"), ("b", "payload")]
    assert rows(sessions.seal(table, chosen, sessions.drift(chosen, same)), "session_id", "outcome") == [("s", "sealed"), ("t", "empty")]
    assert rows(sessions.seal(table, chosen, sessions.drift(chosen, moved)), "outcome") == [("drifted",), ("empty",)]
    assert rows(sessions.session_list(table, chosen, "0%_"), "session_id", "candidates", "selected") == [("s", 2, 1)]


# -- retrieval -------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def shop(spark):
    data = [("1", "移动电源 A", "数码/移动电源", 80.0, "自带线", "80"), ("2", "便携电源 B", "数码/移动电源", 180.0, "自带线", "180"), ("3", "保温杯", "家居/杯壶", 120.0, "容量：0.5L\n不锈钢", "120"),
            ("4", "零食礼盒", "食品/零食", 90.0, "礼盒", "90"), ("5", "未知物品", None, None, "礼盒", "80/100")]
    raw = spark.createDataFrame(data, "id string, name string, reviewed string, amount double, features string, value string")
    obs = raw.select("id", F.lit("d").alias("doc_id"), F.col("id").cast("long").alias("record_key"), "name", F.lit("表").alias("category"), F.lit("").alias("brand"), "features",
                     F.create_map(F.lit("retail_price"), F.struct(F.lit("零售价").alias("label"), "value", "amount", F.lit(None).cast("string").alias("error"))).alias("prices"),
                     normalize("name").alias("name_norm"), normalize(F.concat_ws(" ", "name", "features", F.lit("表"))).alias("all_norm"), F.lit("表").alias("category_norm"), F.lit("").alias("brand_norm"))
    facts = raw.filter("reviewed IS NOT NULL").select("id", F.lit("category").alias("field"), F.col("reviewed").alias("value"), F.lit(None).cast("double").alias("number"),
                                                      F.lit(None).cast("string").alias("unit"), F.lit("inferred").alias("origin"))
    facts = facts.unionByName(spark.createDataFrame([("3", "attr.capacity", "500.0", 500.0, "ml", "source")], facts.schema))
    words = {("query", "充电宝"): ["充电宝", "便携电源", "移动电源"]}
    return Pool(textindex.with_gram_count(obs), facts=facts, synonyms=words)


def names(frame):
    return [r["name"] for r in frame.collect()]


def plan(**changes):
    return {"version": 1, "hard": {"price_field": "retail_price"}, "lanes": [{"query": ""}], "limit": 10, "per_lane": 10, **changes}


def test_synonyms_and_budget(shop):
    found = retrieval.retrieve(shop, plan(hard={"price_field": "retail_price", "maximum": 100}, lanes=[{"query": "充电宝"}]))
    assert names(found.items) == ["移动电源 A"]
    assert [r["query"] for r in found.lanes.orderBy("lane").collect()] == ["充电宝", "便携电源", "移动电源"]


def test_negative_categories_and_units(shop):
    hard = {"price_field": "retail_price", "maximum": 150, "exclude_categories": ["数码", "食品"]}
    ok = retrieval.retrieve(shop, plan(hard={**hard, "attributes": [{"field": "attr.capacity", "minimum": 0.5, "unit": "L"}]}))
    assert names(ok.items) == ["保温杯"]
    none = retrieval.retrieve(shop, plan(hard={**hard, "attributes": [{"field": "attr.capacity", "minimum": 501, "unit": "ml"}]}))
    assert names(none.items) == []


def test_limit_is_reported_and_categories_differ(shop):
    found = retrieval.retrieve(shop, plan(limit=2, per_lane=5))
    assert retrieval.truncated(found).first()[0] is True
    assert len({r["category"].split("/")[0] for r in found.items.collect()}) == 2


def test_price_sort_switches_diversity_off_and_unknown_comes_last(shop):
    found = retrieval.retrieve(shop, plan(hard={"price_field": "retail_price", "sort": "price-asc"}))
    assert names(found.items.orderBy("shown")) == ["移动电源 A", "零食礼盒", "保温杯", "便携电源 B", "未知物品"]


def test_several_plans_at_once(shop):
    items, lanes = retrieval.retrieve_all(shop, {"a": plan(lanes=[{"query": "礼盒"}]), "b": plan(lanes=[{"query": "杯"}, {"query": "电源", "scope": "name"}])})
    assert {(r["plan_id"], r["name"]) for r in items.collect()} == {("a", "零食礼盒"), ("a", "未知物品"), ("b", "保温杯"), ("b", "移动电源 A"), ("b", "便携电源 B")}
    assert lanes.count() == 3


@pytest.mark.parametrize("bad", [{"version": 2}, {"lanes": []}, {"lanes": [{"query": "x", "price_field": "y"}]}, {"limit": 0}, {"variants": 0}, {"limit": 5, "per_lane": 4}, {"extra": 1}])
def test_bad_plans(bad):
    with pytest.raises(ValueError):
        retrieval.check_plan(plan(**bad))


def test_expansion_is_cut_and_says_so(spark, rows):
    words = {("query", "a"): ["a", "b", "c"], ("query", "x"): ["x", "y"]}
    lanes, clipped = retrieval.expand_lanes([{"query": "a x"}], lambda k, t: words.get((k, t), [t]))
    assert [l["query"] for l in lanes] == ["a x", "a y", "b x", "b y"] and clipped
    log = spark.createDataFrame([("a x",), ("q",)], "query string")
    table = spark.createDataFrame([("query", t, g, t) for g, t in (("1", "a"), ("1", "b"), ("1", "c"), ("2", "x"), ("2", "y"))], "kind string, term string, group_key string, display string")
    assert rows(retrieval.expand_log(log, table), "query", "expanded") == [("a x", "a x"), ("a x", "a y"), ("a x", "b x"), ("a x", "b y"), ("q", "q")]


def test_search_modes(spark, shop):
    assert names(search.search(shop, "电源", price_field="retail_price", minimum=100, sort="price-desc")) == ["便携电源 B"]
    hit = search.search(shop, "礼盒 未知", scope="all").first()
    assert hit["evidence"] == "未知物品 礼盒 表" and hit["name"] == "未知物品"
    assert names(search.search(shop, limit=3)) == ["移动电源 A", "保温杯", "零食礼盒"]
    with pytest.raises(ValueError):
        search.search(shop, minimum=1)
    with pytest.raises(ValueError):
        search.search(shop, latest=True, include_history=True)


def test_postings_are_a_superset_of_the_matches(spark, shop):
    docs = shop.observations
    found = {r["id"] for r in textindex.candidates(textindex.postings(docs, "all_norm"), ["电源"]).collect()}
    assert found >= {r["id"] for r in docs.filter(F.contains("all_norm", F.lit("电源"))).collect()}


def test_price_basis_conflicts_are_dropped_unless_labels_are_given(spark):
    frame = spark.createDataFrame([(1, "代理价"), (2, "零售价"), (3, "价")], "id int, label string")
    assert [r["id"] for r in filters.on_price_basis(frame, "retail_price").collect()] == [2, 3]
    assert [r["id"] for r in filters.by_price_label(frame, ["代理价"]).collect()] == [1]


# -- governance ------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("text, rules", [
    ("-----BEGIN RSA PRIVATE " + "KEY-----", ["private-key"]), ("mail me@corp" + ".org", ["personal-email"]), ("mail me@example.com", []), ("ghp_" + "a" * 36, ["github-token"]),
    ("AKIA" + "ABCDEFGH12345678", ["aws-key"]), ("http://u:" + "p@host", ["credential-url"]), ("C:\\Users\\me" + "\\x", ["literal-user-path"]),
    ("api_key = '" + "abcdefgh12345'", ["secret-assignment"]), ("sk-" + "proj-" + "a" * 24, ["api-key"]), ("plain", [])])
def test_secret_rules(spark, text, rules):
    assert [r["rule"] for r in governance.audit_secrets(spark.createDataFrame([("l", text)], "location string, text string")).collect()] == rules


@pytest.mark.parametrize("path, private", [("a/b.PDF", True), ("x.local.json", True), (".env.test", True), ("data/x.md", True), ("src/data.md", False), (".pdf", False), ("a/.catalogue/x", True)])
def test_private_paths(spark, path, private):
    assert spark.createDataFrame([(path,)], "p string").select(governance.private_path("p")).first()[0] is private


def test_facet_counts_a_product_once_per_category(spark, rows):
    obs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "")], "id int, category string")
    tags = spark.createDataFrame([(1, "category", "a"), (3, "category", "b"), (3, "x", "a")], "id int, kind string, value string")
    assert rows(facets.category_facet(obs, tags)) == [("a", 2), ("b", 1)]


def test_text_hashes_compose_like_the_texts(spark):
    from sourcemart.functions import rolling
    import random
    rng = random.Random(12)
    texts = ["", "a", "é€😀" * 9_000, "x" * (rolling.BLOCK + 1)] + ["".join(rng.choice("ab é€") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    direct = [tuple(sum((b + 1) * pow(base, i, p) for i, b in enumerate(t.encode()[:50])) % p for base, p in zip(rolling.BASES, rolling.PRIMES)) for t in texts]
    made = rolling.with_text_hash(spark.createDataFrame([(i, t[:0] + t.encode()[:50].decode(errors="ignore")) for i, t in enumerate(texts)], "id int, t string"), "t").collect()
    short = {r["id"]: (r["_h1"], r["_h2"]) for r in made if len(texts[r["id"]].encode()) <= 50}
    assert all(short[i] == direct[i] for i in short)
    staged, parts = [], []
    for i, t in enumerate(texts):
        cuts = sorted(rng.randint(0, len(t)) for _ in range(rng.randint(0, 5)))
        staged.append((i, "t", t))
        parts += [(i, n, "t", t[a:b]) for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(t)]))]
    swapped = [(100, "t", "ab cd"), (101, "t", "abab"), (102, "t", "ab"), (103, "t", "ab")]
    parts += [(100, 0, "t", "cd"), (100, 1, "t", "ab"), (101, 0, "t", "ab"), (102, 0, "x", "a"), (102, 1, "t", "b"), (104, 0, "t", "z")]
    found = governance.reconcile_parts(spark.createDataFrame(staged + swapped, "id int, title string, text string"), spark.createDataFrame(parts, "id int, part int, title string, text string"))
    assert {r["id"]: r["problem"] for r in found.collect()} == {100: "text", 101: "text", 102: "title", 103: "not_published", 104: "not_staged"}


def test_offers_are_chosen_where_they_are_read(spark):
    """A canonical price role narrows the line scan itself, before the join; answers are those of the price map."""
    from sourcemart.model import Tables
    t = Tables(spark, "/root/testdata/sf0.001")
    whole, narrowed = Pool(t.priced(), item_key="group_id"), Pool(t.priced(), item_key="group_id", offers=t.offers)
    for hard in ({"price_field": "retail_price"}, {"price_field": "agent_price", "minimum": 500, "maximum": 3000}, {"price_field": "agent_price", "price_labels": ["F"]},
                 {"price_field": "supply_price", "maximum": 1500}, {"price_field": "reference_price_b"}):
        a, b = (search.hard_filter(pool, **hard).select("id", "amount", "price.label", "price.value") for pool in (whole, narrowed))
        assert a.count() == b.count() and a.exceptAll(b).isEmpty(), hard
    plan = search.hard_filter(narrowed, price_field="retail_price", minimum=500)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "l_returnflag" in line]
    assert len(scans) == 1 and "EqualTo(l_returnflag,N)" in scans[0]
