"""A table of retrieval plans against a stored text index, in one plan of fixed size.

Lanes are rows, not expressions: their grams meet the index's frequencies, which give each lane its rarest grams and the
weight of its score; the rarest grams meet the postings, and rows that hold all of a lane's are checked against its words and
its plan's hard conditions. Matches are written once, without texts; totals, ranks, fusion and pages read that table. Neither
the number of exchanges nor that of scans depends on the number of plans.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sourcemart.functions.grams import term_grams
from sourcemart.functions.text import normalize
from sourcemart.operators.filters import SCOPE_COLUMN
from sourcemart.operators.ranking import diversify, top_per_group
from sourcemart.operators.textindex import WEIGHT, StoredIndex, rarity, weighted_score
from sourcemart.plans.retrieval import FUSION
from sourcemart.session import settle

LOOKED_UP = 3  # grams of a lane whose postings are intersected before texts are looked at
PLANS = """plan_id string, lanes array<struct<query:string,scope:string>>, minimum double, maximum double, categories array<string>,
    exclude_categories array<string>, limit int, per_lane int, diversity boolean"""


@dataclass
class BatchRetrieval:
    """Shown items per plan, one report per plan and lane, and one row per plan that says whether anything was left out."""
    items: DataFrame
    lanes: DataFrame
    truncated: DataFrame


def plan_lanes(plans: DataFrame) -> DataFrame:
    """(plan_id, lane, query, column, terms): each distinct lane of a plan once, numbered by its first place in the plan."""
    scope = F.create_map(*[F.lit(v) for pair in SCOPE_COLUMN.items() for v in pair])
    lanes = plans.select("plan_id", F.posexplode("lanes").alias("lane", "l")).select(
        "plan_id", "lane", F.col("l.query").alias("query"), scope[F.coalesce("l.scope", F.lit("all"))].alias("column"))
    lanes = lanes.groupBy("plan_id", "query", "column").agg(F.min("lane").alias("lane"))
    terms = F.filter(F.split(normalize("query"), " "), lambda t: t != "")
    return lanes.withColumn("terms", terms).select("plan_id", "lane", "query", "column", "terms")


def checked_plans(plans: DataFrame) -> DataFrame:
    """The plans, fixed once; refused when one is not a plan that lanes as rows can answer."""
    kept = settle(plans, "plans")
    words = F.forall("lanes", lambda l: F.coalesce(F.trim(l["query"]), F.lit("")) != "")
    scopes = F.forall("lanes", lambda l: F.coalesce(l["scope"], F.lit("all")).isin(*SCOPE_COLUMN))
    sound = F.coalesce((F.size("lanes") > 0) & words & scopes & (F.col("limit") >= 1) & (F.col("per_lane") >= F.col("limit"))
                       & (F.col("minimum").isNull() | F.col("maximum").isNull() | (F.col("minimum") <= F.col("maximum"))), F.lit(False))
    if not kept.filter(~sound | F.col("plan_id").isNull()).isEmpty() or not kept.groupBy("plan_id").count().filter("count > 1").isEmpty():
        raise ValueError("Each plan has an id of its own, lanes with words (a lane that browses is for a single plan), limit <= per_lane, minimum <= maximum")
    return kept


def matches(index: StoredIndex, plans: DataFrame, lanes: DataFrame, amount: str, category: str) -> DataFrame:
    """(plan_id, lane, key, score, category, amount): one row per lane and text that it and its plan's hard conditions accept."""
    rows, grams = index.size()
    key = index.key
    frequencies = index.frequencies()
    occurrences = lanes.select("plan_id", "lane", "column", F.explode("terms").alias("term")).select(
        "plan_id", "lane", "column", F.explode(term_grams(F.col("term"))).alias("gram"))
    known = occurrences.join(frequencies, ["column", "gram"], "left")
    # A lane with a gram that no row holds has no match; the sum counts a gram as often as the lane's words hold it.
    weights = known.groupBy("plan_id", "lane", "column").agg(
        F.sum(rarity(F.coalesce("n", F.lit(0)), rows)).alias("idf"), F.min(F.coalesce("n", F.lit(0))).alias("least"),
        F.slice(F.array_sort(F.collect_set(F.struct("n", "gram"))), 1, LOOKED_UP).alias("rarest")).filter("least > 0")
    asked = weights.select("plan_id", "lane", "column", F.size("rarest").alias("needed"), F.explode("rarest.gram").alias("gram"))
    candidates = (index.postings(asked).groupBy("plan_id", "lane", key)
                  .agg(F.count("*").alias("held"), F.max("needed").alias("needed")).filter("held = needed").select("plan_id", "lane", key))
    hard = plans.select("plan_id", "minimum", "maximum", "categories", "exclude_categories")
    checks = lanes.join(weights.select("plan_id", "lane", "idf"), ["plan_id", "lane"]).join(hard, "plan_id")
    found = candidates.join(index.rows(), key).join(checks, ["plan_id", "lane"])
    text = F.when(F.col("column") == SCOPE_COLUMN["name"], F.col("name_norm")).otherwise(F.col("all_norm"))
    weight = F.when(F.col("column") == SCOPE_COLUMN["name"], WEIGHT["name_norm"]).otherwise(WEIGHT["all_norm"])
    accepted = found.filter(F.forall("terms", lambda t: F.contains(text, t)) & _hard(F.col(amount), F.col(category)))
    return accepted.select("plan_id", "lane", key, weighted_score(F.col("idf"), "gram_count", weight, rows, grams).alias("score"),
                           F.col(category).alias("category"), F.col(amount).cast("double").alias("amount"))


def _hard(amount: Column, category: Column) -> Column:
    """The plan's conditions as columns; what is unknown satisfies none."""
    below = lambda wanted: F.exists(wanted, lambda c: (category == c) | F.startswith(category, F.concat(c, F.lit("/"))))
    within = (F.col("minimum").isNull() | F.coalesce(amount >= F.col("minimum"), F.lit(False))) & (
        F.col("maximum").isNull() | F.coalesce(amount <= F.col("maximum"), F.lit(False)))
    wanted = F.coalesce(F.size("categories") < 1, F.lit(True)) | F.coalesce(below("categories"), F.lit(False))
    unwanted = F.coalesce(F.size("exclude_categories") < 1, F.lit(True)) | F.coalesce(~below("exclude_categories"), F.lit(False))
    return within & wanted & unwanted


def retrieve_plans(index: StoredIndex, plans: DataFrame, amount: str, category: str) -> BatchRetrieval:
    """Every plan of ``plans`` (columns as in PLANS; null lists and bounds ask for nothing) over the index's rows.

    ``amount`` and ``category`` name carried columns of the index. Ranks within a lane go by score, then key; fused rows by
    their sum of 1 / (60 + rank), then key; with ``diversity`` a page takes the categories' first rows in turn.
    """
    key = index.key
    plans = checked_plans(plans)
    lanes = settle(plan_lanes(plans), "lanes")
    found = settle(matches(index, plans, lanes, amount, category), "matches")
    most = plans.agg(F.coalesce(F.max("per_lane"), F.lit(1))).first()[0]
    sizes = plans.select("plan_id", "limit", "per_lane", F.coalesce("diversity", F.lit(True)).alias("diversity"))
    ranked = top_per_group(found, ["plan_id", "lane"], ["score", key], most).join(sizes, "plan_id").filter(F.col("rank") <= F.col("per_lane"))
    ranked = settle(ranked, "ranked")  # at most lanes x per_lane rows
    places = F.sort_array(F.collect_list(F.struct("lane", "rank")))
    fused = (ranked.groupBy("plan_id", key).agg(places.alias("places"), *[F.max(c).alias(c) for c in ("category", "amount", "limit", "diversity")])
             .withColumn("fused", F.aggregate("places", F.lit(0.0), lambda s, p: s + F.lit(1.0) / (F.lit(FUSION) + p["rank"])))
             .withColumn("matched_lanes", F.transform("places", lambda p: p["lane"])).drop("places"))
    # A plan's fused rows are bounded by its own lanes and per_lane.
    ordered = top_per_group(fused, ["plan_id"], [F.col("fused").desc(), key], 1 << 30, "place")
    # A plan without diversity is one bucket, so its rows are shown as they are placed.
    bucket = F.when(F.col("diversity"), F.coalesce(F.element_at(F.split("category", "/"), 1), F.lit("")))
    shown = diversify(ordered.withColumn("_top", bucket), ["plan_id"], "_top", "place").drop("_top", "place")
    items = shown.filter(F.col("shown") <= F.col("limit")).drop("limit", "diversity")
    totals = found.groupBy("plan_id", "lane").agg(F.count("*").alias("total"))
    returned = ranked.groupBy("plan_id", "lane").agg(F.count("*").alias("returned"))
    reports = (lanes.select("plan_id", "lane", "query").join(totals, ["plan_id", "lane"], "left").join(returned, ["plan_id", "lane"], "left")
               .withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("total", "returned")}))
    clipped = reports.groupBy("plan_id").agg(F.bool_or(F.col("total") > F.col("returned")).alias("clipped"))
    beyond = fused.groupBy("plan_id").agg((F.count("*") > F.max("limit")).alias("beyond"))
    truncated = clipped.join(beyond, "plan_id", "left").select("plan_id", (F.col("clipped") | F.coalesce("beyond", F.lit(False))).alias("truncated"))
    return BatchRetrieval(items, reports, truncated)
