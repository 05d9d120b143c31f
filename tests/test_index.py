"""The stored text index and plan tables against brute force: segments, replaced and removed rows, bounds, and plan size."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from sourcemart.functions.grams import gram_set, query_grams, term_grams
from sourcemart.functions.text import normalize_literal
from sourcemart.operators import textindex
from sourcemart.operators.textindex import B, IDF_FLOOR, K1, WEIGHT, StoredIndex
from sourcemart.plans import batch
from sourcemart.session import scratch_path

SCHEMA = "id long, name string, text string, amount double, kind string"
FIRST = [(1, "Red Bolt", "a RED bolt,  of steel", 5.0, "a/x"), (2, "Blue bolt", "blue bolt of ﬁne steel", 7.0, "a/y"), (3, None, None, None, None),
         (4, "Straße", "strasse and street", 9.0, "b"), (5, "电源", "移动电源 bolt", 2.0, "b/z"), (6, "", "red red red", 1.0, "a")]
SECOND = [(2, "Green nut", "green nut, no longer blue", 8.0, "c"), (7, "Bolt", "bolt", 4.0, "a/x")]


class Brute:
    """The same index as a dictionary."""

    def __init__(self):
        self.rows = {}

    def put(self, rows):
        for key, name, text, amount, kind in rows:
            self.rows[key] = {"name_norm": normalize_literal(name), "all_norm": normalize_literal(text), "amount": amount, "kind": kind}

    def find(self, terms, column):
        n = len(self.rows)
        grams = {k: len(gram_set(r["name_norm"])) + len(gram_set(r["all_norm"])) for k, r in self.rows.items()}
        average = sum(grams.values()) / n
        total = 0.0
        for gram in [g for t in terms for g in query_grams(t)]:
            held = sum(gram in gram_set(r[column]) for r in self.rows.values())
            total += max(math.log((n - held + 0.5) / (held + 0.5)), 0) or IDF_FLOOR
        w = WEIGHT[column]
        return {k: -total * w * (K1 + 1) / (w + K1 * (1 - B + B * grams[k] / average)) for k, r in self.rows.items() if all(t in r[column] for t in terms)}


def same(got, want):
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def found(index, terms, column, **options):
    return {r["id"]: r["score"] for r in index.find(terms, column, **options).collect()}


QUERIES = [(["bolt"], "all_norm"), (["bolt"], "name_norm"), (["red", "bolt"], "all_norm"), (["strasse"], "name_norm"), (["fine"], "all_norm"), (["电"], "all_norm"),
           (["missing"], "all_norm"), (["e"], "all_norm"), (["blue"], "all_norm"), (["nut"], "name_norm")]


def test_segments_are_merged_when_read(spark):
    path, brute = scratch_path(spark, "index"), Brute()
    index = StoredIndex.build(spark.createDataFrame(FIRST, SCHEMA), path)
    brute.put(FIRST)
    steps = [lambda i: i, lambda i: i.append(spark.createDataFrame(SECOND, SCHEMA)), lambda i: i.remove(spark.createDataFrame([(1,), (99,)], "id long")),
             lambda i: i.append(spark.createDataFrame(FIRST[:1], SCHEMA)), lambda i: i.remove(spark.createDataFrame([], "id long"))]
    changes = [lambda: None, lambda: brute.put(SECOND), lambda: brute.rows.pop(1), lambda: brute.put(FIRST[:1]), lambda: None]
    for step, change in zip(steps, changes):
        index = step(index)
        change()
        index = StoredIndex.open(spark, path)
        assert index.size()[0] == len(brute.rows)
        for terms, column in QUERIES:
            want = brute.find(terms, column)
            same(found(index, terms, column), want)
            same(found(index, terms, column, scan_share=1.1), want)
            same(found(index, terms, column, scan_share=0.0), want)
        held = collections.Counter((c, g) for r in brute.rows.values() for c in WEIGHT for g in gram_set(r[c]))
        assert {(r["column"], r["gram"]): r["n"] for r in index.frequencies().collect()} == held
        assert index.postings().count() == sum(held.values())
    assert {r["id"]: r["kind"] for r in index.rows().collect()} == {k: r["kind"] for k, r in brute.rows.items()}


def test_a_segment_without_its_totals_is_not_there(spark):
    path = scratch_path(spark, "index")
    index = StoredIndex.build(spark.createDataFrame(FIRST, SCHEMA), path)
    index.rows().limit(2).write.parquet(f"{path}/rows/segment=1")  # a writer that died
    again = StoredIndex.open(spark, path)
    assert again.rows().count() == len(FIRST)
    again = again.append(spark.createDataFrame(SECOND, SCHEMA))
    assert again.rows().count() == len(FIRST) + 1 and StoredIndex.open(spark, path).totals == again.totals


def test_an_empty_index(spark):
    path = scratch_path(spark, "index")
    index = StoredIndex.build(spark.createDataFrame([], SCHEMA), path)
    assert found(index, ["bolt"], "all_norm") == {} and index.size() == (0.0, 0.0)
    assert found(index.append(spark.createDataFrame(FIRST, SCHEMA)), ["strasse"], "name_norm").keys() == {4}


def test_queries_normalise_nothing_and_read_few_postings(spark):
    path = scratch_path(spark, "index")
    index = StoredIndex.build(spark.createDataFrame(FIRST, SCHEMA), path)
    plan = index.find(["strasse"], "name_norm", scan_share=0.5)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "LeftSemi" in plan and "EqualTo(gram," in plan
    assert "postings" not in index.find(["e"], "all_norm", scan_share=0.1)._jdf.queryExecution().executedPlan().toString()


def test_term_grams(spark):
    terms = ["", "a", "ab", "abab", "电源x", "aaaa"]
    got = spark.createDataFrame([(t,) for t in terms], "t string").select("t", term_grams(F.col("t")).alias("g")).collect()
    assert {r["t"]: sorted(r["g"]) for r in got} == {t: query_grams(t) for t in terms}


# ---- plan tables ----------------------------------------------------------------------------------------------------

def brute_answers(brute, plans):
    items, reports, cut = {}, {}, {}
    for plan_id, lanes, low, high, wanted, unwanted, limit, per_lane, diverse in plans:
        seen, scores, matched = [], collections.defaultdict(float), collections.defaultdict(list)
        clipped = False
        below = lambda kind, names: any(kind == c or kind.startswith(c + "/") for c in names)
        for number, (query, scope) in enumerate(lanes):
            lane = (query, scope or "all")
            if lane in seen:
                continue
            seen.append(lane)
            terms = normalize_literal(query).split()
            scored = brute.find(terms, {"all": "all_norm", "name": "name_norm"}[lane[1]])
            kept = [k for k in scored for r in [brute.rows[k]]
                    if (low is None or r["amount"] is not None and r["amount"] >= low) and (high is None or r["amount"] is not None and r["amount"] <= high)
                    and (not wanted or r["kind"] is not None and below(r["kind"], wanted)) and (not unwanted or r["kind"] is not None and not below(r["kind"], unwanted))]
            ranked = sorted(kept, key=lambda k: (round(scored[k], 9), k))[:per_lane]
            reports[plan_id, number] = (query, len(kept), len(ranked))
            clipped |= len(kept) > len(ranked)
            for rank, k in enumerate(ranked, 1):
                scores[k] += 1 / (60 + rank)
                matched[k].append(number)
        order = sorted(scores, key=lambda k: (-scores[k], k))
        if diverse is not False:
            buckets = collections.OrderedDict()
            for k in order:
                buckets.setdefault((brute.rows[k]["kind"] or "").split("/")[0], []).append(k)
            order = []
            while any(buckets.values()):
                order += [held.pop(0) for held in buckets.values() if held]
        items.update({(plan_id, place): (k, matched[k]) for place, k in enumerate(order[:limit], 1)})
        cut[plan_id] = clipped or len(order) > limit
    return items, reports, cut


def random_plans(rng, n):
    words = ["bolt", "red", "blue steel", "e", "电", "nut", "missing", "RED  bolt", "strasse"]
    return [(f"p{i}", [(rng.choice(words), rng.choice(["all", "name", None])) for _ in range(rng.randint(1, 4))], rng.choice([None, None, 3.0]), rng.choice([None, 7.5]),
             rng.choice([None, [], ["a"], ["b", "c"]]), rng.choice([None, [], ["a/x"]]), rng.randint(1, 3), rng.randint(3, 4), rng.choice([True, False, None])) for i in range(n)]


def exchanges(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_a_table_of_plans(spark):
    index = StoredIndex.build(spark.createDataFrame(FIRST, SCHEMA), scratch_path(spark, "index")).append(spark.createDataFrame(SECOND, SCHEMA))
    brute = Brute()
    brute.put(FIRST)
    brute.put(SECOND)
    sizes = set()
    for n in (2, 200):
        plans = random_plans(random.Random(n), n)
        got = batch.retrieve_plans(index, spark.createDataFrame(plans, batch.PLANS), "amount", "kind")
        items, reports, cut = brute_answers(brute, plans)
        assert {(r["plan_id"], r["shown"]): (r["id"], r["matched_lanes"]) for r in got.items.collect()} == items
        assert {(r["plan_id"], r["lane"]): (r["query"], r["total"], r["returned"]) for r in got.lanes.collect()} == reports
        assert {r["plan_id"]: r["truncated"] for r in got.truncated.collect()} == cut
        lanes = batch.plan_lanes(batch.checked_plans(spark.createDataFrame(plans, batch.PLANS)))
        found = batch.matches(index, spark.createDataFrame(plans, batch.PLANS), lanes, "amount", "kind")
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        sizes.add((plan.count("Join "), plan.count("Aggregate "), plan.count("Relation ")))
    assert len(sizes) == 1


@pytest.mark.parametrize("bad", [
    ("p", [], None, None, None, None, 1, 1, True), ("p", [(" ", "all")], None, None, None, None, 1, 1, True), ("p", [("x", "body")], None, None, None, None, 1, 1, True),
    ("p", [("x", "all")], 2.0, 1.0, None, None, 1, 1, True), ("p", [("x", "all")], None, None, None, None, 2, 1, True), (None, [("x", "all")], None, None, None, None, 1, 1, True)])
def test_plans_that_are_refused(spark, bad):
    with pytest.raises(ValueError):
        batch.checked_plans(spark.createDataFrame([bad], batch.PLANS))


def test_an_id_names_one_plan(spark):
    plan = ("p", [("x", "all")], None, None, None, None, 1, 1, True)
    with pytest.raises(ValueError):
        batch.checked_plans(spark.createDataFrame([plan, plan], batch.PLANS))
    assert batch.checked_plans(spark.createDataFrame([], batch.PLANS)).count() == 0


@pytest.mark.parametrize("table", [0, 1 << 26])
def test_grams_of_a_block(monkeypatch, table):
    monkeypatch.setattr(textindex, "TABLE", table)
    texts = ["abab b", None, "", "ä充电宝\U0001f600a", "b", "\x00\U0010ffff"]
    grams, first, owners = textindex.gram_owners(texts)
    held = {(g, int(o)) for i, g in enumerate(grams) for o in owners[first[i]:first[i + 1]]}
    assert held == {(g, i) for i, t in enumerate(texts) for g in gram_set(t)} and len(owners) == len(held) and len(grams) == len(set(grams))
    assert [len(x) for x in textindex.gram_owners([None])] == [0, 1, 0]


def test_postings_are_kept_in_blocks(spark, tmp_path):
    docs = spark.createDataFrame([(i, "name", f"the same words {i % 3}") for i in range(50)], "id long, name string, text string").coalesce(1)
    index = textindex.StoredIndex.build(docs, str(tmp_path / "index"))
    blocks = spark.read.parquet(str(tmp_path / "index" / "postings"))
    assert blocks.filter("gram = 'sa'").count() < 50
    assert index.postings().filter("gram = 'sa'").count() == 50
    assert index.frequencies().filter("gram = 'sa' AND column = 'all_norm'").first()["n"] == 50
