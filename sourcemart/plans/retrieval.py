"""Retrieval plans: shared hard filters, alternative lanes, fused by reciprocal rank.

All lanes of a plan are evaluated in one pass over the filtered observations: a lane is an expression, and a row
carries the lanes it satisfies. Only the best ``per_lane`` rows of a lane leave a task (limited window), so what is
fused, grouped and diversified is bounded by the plan's own lanes and ``per_lane``, whatever the data.
"""

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sourcemart.functions.grams import query_grams
from sourcemart.functions.text import facts_excerpt, own_text
from sourcemart.operators import filters
from sourcemart.operators.facets import coverage_warnings
from sourcemart.operators.ranking import diversify, group_representatives, page, price_order, top_per_group
from sourcemart.operators.textindex import WEIGHT, bm25, corpus_statistics
from sourcemart.plans.search import Pool, hard_filter
from sourcemart.session import settle

VARIANTS = 4  # default of a plan's ``variants``: forms of a lane's query that its synonyms may give; null for all
# Fixed value: the constant of the rank fusion.
FUSION = 60
# The terms without which a quote is not fully known.
QUOTE_TERMS = ("currency", "unit", "tax", "shipping")
CARRIED = ["name", "category", "brand", "doc_id", "record_key", "amount", "product_group"]
STABLE = ["doc_id", "record_key", "id"]


def check_plan(plan: dict) -> dict:
    """The plan with its defaults. ``limit``, ``per_lane`` and ``variants`` are the caller's to choose, as is the number of
    lanes; what is fused is bounded by lanes times ``per_lane``."""
    unknown = set(plan) - {"version", "hard", "lanes", "limit", "per_lane", "variants", "diversity", "group_products"}
    if unknown or plan.get("version") != 1:
        raise ValueError("Unknown retrieval plan; version 1 required")
    full = {"hard": {}, "limit": 10, "variants": VARIANTS, "diversity": True, "group_products": True, **plan}
    full.setdefault("per_lane", max(30, full["limit"]))
    if not isinstance(full.get("lanes"), list) or not full["lanes"]:
        raise ValueError("A plan has lanes")
    if any(set(lane) - {"query", "scope", "category", "tags"} for lane in full["lanes"]):
        raise ValueError("A lane has query, scope, category and tags only; hard filters hold for all lanes")
    if full["limit"] < 1 or full["per_lane"] < full["limit"] or full["variants"] is not None and full["variants"] < 1:
        raise ValueError("limit and variants are at least 1, per_lane at least limit")
    return full


def query_forms(query: str, words) -> list[str]:
    """All forms of a query, each word in each of its synonyms, in the order of the words' own lists."""
    forms = [""]
    for term in query.split():
        forms = [f"{form} {word}".lstrip() for form in forms for word in words("query", term)]
    return forms


def expand_lanes(lanes: list[dict], words, variants: int | None = VARIANTS) -> tuple[list[dict], bool]:
    """Every lane once per form of its query, equal lanes once; and whether ``variants`` left any form out."""
    widened = [(lane, query_forms(lane.get("query", ""), words)) for lane in lanes]
    made = {json.dumps(one, sort_keys=True): one for lane, forms in widened
            for one in ({**lane, "query": form} for form in forms[:variants])}
    return list(made.values()), any(len(forms) > len(forms[:variants]) for _, forms in widened)


def expand_log(log: DataFrame, synonyms: DataFrame, variants: int = VARIANTS) -> DataFrame:
    """log(query) -> (query, expanded, left_out): the same expansion for a whole table of queries.

    Synonyms meet the log's words by an equi join. Forms are built word by word, kept in order and cut to the first
    ``variants`` after each word, which gives the same first ones as the full product; ``left_out`` is the number of
    forms beyond them.
    """
    words = log.select("query", F.posexplode(F.filter(F.split(F.lower("query"), "(?U)\\s+"), lambda w: w != "")).alias("at", "word"))
    terms = synonyms.filter("kind = 'query'")
    forms = (terms.select(F.col("term").alias("word"), "group_key")
             .join(terms.select("group_key", F.col("term").alias("member"), "display"), "group_key")
             .groupBy("word").agg(F.transform(F.sort_array(F.collect_list(F.struct("member", "display"))), lambda m: m["display"]).alias("forms")))
    widened = words.join(forms, "word", "left").withColumn("forms", F.coalesce("forms", F.array("word")))
    lists = widened.groupBy("query").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "forms"))), lambda w: w["forms"]).alias("choices"))

    def longer(built, choices):
        combined = F.flatten(F.transform(built, lambda b: F.transform(choices, lambda c: F.ltrim(F.concat(b, F.lit(" "), c)))))
        return F.slice(combined, 1, variants)

    expanded = F.aggregate("choices", F.array(F.lit("")), longer)
    all_forms = F.aggregate("choices", F.lit(1).cast("long"), lambda n, forms: n * F.size(forms))
    kept = lists.withColumn("kept", expanded).withColumn("left_out", all_forms - F.size("kept"))
    return kept.select("query", F.explode("kept").alias("expanded"), "left_out")


def lane_hits(pool: Pool, plan: dict, lanes: list[dict], link: str | None) -> DataFrame:
    """(lane, id, sort keys, carried columns): one row per lane and matching observation."""
    hard = dict(plan["hard"])
    base = hard_filter(pool, **hard)
    if "amount" not in base.columns:
        base = base.withColumn("amount", F.lit(None).cast("double"))
    base = base.withColumn("product_group", F.col(link).cast("string") if link else F.lit(None).cast("string"))
    by_price = hard.get("sort", "relevance") != "relevance"
    grams = {(filters.SCOPE_COLUMN[lane.get("scope", "all")], g) for lane in lanes
             for t in filters.search_terms(lane["query"]) for g in query_grams(t)}
    columns, distinct = sorted({c for c, _ in grams}), sorted({g for _, g in grams})
    stats = corpus_statistics(pool.observations, columns, distinct).first() if grams and not by_price else None
    marks = []
    for number, lane in enumerate(lanes):
        column = filters.SCOPE_COLUMN[lane.get("scope", "all")]
        terms = filters.search_terms(lane["query"])
        accepted = filters.all_terms(column, terms)
        if lane.get("category"):
            own = filters.in_category(pool.words("category", lane["category"]), "category_norm")
            accepted = accepted & (own | F.array_contains("_category_lanes", number) if pool.tags is not None else own)
        if lane.get("tags"):
            accepted = accepted & F.array_contains("_tag_lanes", number)
        if terms and not by_price:
            holding = [stats[f"n{columns.index(column)}_{distinct.index(g)}"] for t in terms for g in query_grams(t)]
            score = bm25("gram_count", WEIGHT[column], stats["rows"], stats["grams"] or 0.0, holding)
        else:
            score = F.lit(None).cast("double")
        marks.append(F.when(accepted, F.struct(F.lit(number).alias("lane"), score.alias("score"))))
    base = _with_tag_lanes(_with_category_lanes(base, pool, lanes), pool, lanes)
    return base.select("id", *CARRIED, F.explode(F.array_compact(F.array(*marks))).alias("hit")).select("id", *CARRIED, "hit.*")


def _with_category_lanes(base: DataFrame, pool: Pool, lanes: list[dict]) -> DataFrame:
    """Adds the numbers of the lanes whose category the product carries as a tag."""
    wanted = [(n, pool.words("category", lane["category"])) for n, lane in enumerate(lanes) if lane.get("category")]
    if not wanted or pool.tags is None:
        return base
    marks = F.array_compact(F.array(*[F.when(filters.in_category(words, "norm"), F.lit(n)) for n, words in wanted]))
    rows = (pool.tags.filter("kind = 'category'").withColumn("norm", filters.normalize("value"))
            .select(F.col("id").alias(pool.item_key), F.explode(marks).alias("lane"))
            .groupBy(pool.item_key).agg(F.collect_set("lane").alias("_category_lanes")))
    return base.join(rows, pool.item_key, "left")


def _with_tag_lanes(base: DataFrame, pool: Pool, lanes: list[dict]) -> DataFrame:
    """Adds the numbers of the lanes whose tags the product has; one reduced row per product joins once."""
    wanted = [(n, tag) for n, lane in enumerate(lanes) for tag in lane.get("tags") or []]
    if not wanted:
        return base
    needed = {n: len(lane["tags"]) for n, lane in enumerate(lanes) if lane.get("tags")}
    hits = []
    for n, tag in wanted:
        kind, value = tag.split(":", 1)
        values = [filters.normalize_literal(w) for w in pool.words(f"tag:{kind}", value)]
        hits.append(F.when((F.col("kind") == kind) & F.col("norm").isin(*values), F.struct(F.lit(n).alias("lane"), F.lit(tag).alias("tag"))))
    kinds = sorted({tag.split(":", 1)[0] for _, tag in wanted})
    found = (pool.tags.filter(F.col("kind").isin(*kinds)).withColumn("norm", filters.normalize("value"))
             .select("id", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("id", "h.*").distinct()
             .groupBy("id", "lane").agg(F.count("*").alias("n")))
    complete = F.lit(False)
    for n, size in needed.items():
        complete = complete | ((F.col("lane") == n) & (F.col("n") == size))
    rows = found.filter(complete).groupBy(F.col("id").alias(pool.item_key)).agg(F.collect_set("lane").alias("_tag_lanes"))
    return base.join(rows, pool.item_key, "left")


def rank_lanes(hits: DataFrame, per_lane: int, sort: str) -> DataFrame:
    """Best rows of each lane with their rank: by price, by text relevance, or browsing over categories.

    A browsing lane shows the first of every category, then every second; a text lane goes by score, then id. Both
    pass the same two limited windows, so the hits are computed once.
    """
    if sort != "relevance":
        return top_per_group(hits, ["lane"], [price_order("amount", sort == "price-desc"), "id"], per_lane)
    browsing = F.col("score").isNull()
    stable = [F.when(browsing, F.col(c)) for c in STABLE[:2]] + ["id"]
    turn = top_per_group(hits.withColumn("_turns", F.when(browsing, F.col("category"))), ["lane", "_turns"], ["score", *stable], per_lane, "_n")
    keyed = turn.withColumn("_k", F.when(browsing, F.col("_n").cast("double")).otherwise(F.col("score")))
    return top_per_group(keyed, ["lane"], ["_k", *stable], per_lane).drop("_k", "_n", "_turns")


def fuse(ranked: DataFrame, key="id") -> DataFrame:
    """Sum of 1/(60+rank) over lanes, added in lane order so that the result does not depend on the plan's tasks."""
    carried = [c for c in ranked.columns if c not in (key, "lane", "rank", "score")]
    places = F.sort_array(F.collect_list(F.struct("lane", "rank")))
    return (ranked.groupBy(key).agg(places.alias("_places"), *[F.max(c).alias(c) for c in carried])
            .withColumn("fused", F.aggregate("_places", F.lit(0.0), lambda s, p: s + F.lit(1.0) / (F.lit(FUSION) + p["rank"])))
            .withColumn("matched_lanes", F.transform("_places", lambda p: p["lane"])).drop("_places"))


@dataclass
class Retrieval:
    """Shown items, one report row per lane, and all representatives before the limit."""
    items: DataFrame
    lanes: DataFrame
    groups: DataFrame
    limit: int


def retrieve(pool: Pool, plan: dict, link: str | None = None) -> Retrieval:
    """``link`` names the observation column that holds the reviewed product group."""
    plan = check_plan(plan)
    lanes, clipped = expand_lanes(plan["lanes"], pool.words, plan["variants"])
    sort = plan["hard"].get("sort", "relevance")
    # The lanes run once: ranks and totals read what they matched.
    matches = settle(lane_hits(pool, plan, lanes, link), "matches")
    ranked = settle(rank_lanes(matches, plan["per_lane"], sort), "ranked")  # at most lanes x per_lane rows from here on
    fused = fuse(ranked)
    order = [F.col("fused").desc(), "id"]
    if sort != "relevance":
        order = [price_order("amount", sort == "price-desc"), *order]
    ordered = top_per_group(fused.withColumn("_all", F.lit(1)), ["_all"], order, len(lanes) * plan["per_lane"], "place").drop("_all")
    group = "product_group" if plan["group_products"] else "_none"
    heads = group_representatives(ordered.withColumn("_none", F.lit(None).cast("string")), [], group, "place", "id", offer=["amount", "doc_id"]).drop("_none")
    if plan["diversity"] and sort == "relevance":
        heads = diversify(heads.withColumn("_top", F.element_at(F.split("category", "/"), 1)), [], "_top", "place").drop("_top")
    else:
        heads = heads.withColumn("shown", F.col("place"))
    return Retrieval(page(heads, ["shown"], plan["limit"]), lane_reports(matches, ranked, lanes, clipped), heads, plan["limit"])


def lane_reports(matches: DataFrame, ranked: DataFrame, lanes: list[dict], clipped: bool) -> DataFrame:
    """Per lane the number of matches and of rows that entered the fusion; a lane without matches has zeros."""
    spark = matches.sparkSession
    names = spark.createDataFrame([(n, lane["query"]) for n, lane in enumerate(lanes)], "lane int, query string")
    total = matches.groupBy("lane").agg(F.count("*").alias("total"))
    returned = ranked.groupBy("lane").agg(F.count("*").alias("returned"))
    return (names.join(total, "lane", "left").join(returned, "lane", "left")
            .select("lane", "query", F.coalesce("total", F.lit(0)).alias("total"),
                    F.coalesce("returned", F.lit(0)).alias("returned"), F.lit(clipped).alias("expansion_clipped")))


def truncated(found: Retrieval) -> DataFrame:
    """One row: whether anything was left out, by expansion, by a lane's bound or by the plan's limit."""
    lanes = found.lanes.agg(F.bool_or(F.col("expansion_clipped") | (F.col("total") > F.col("returned"))).alias("cut"))
    shown = found.groups.agg((F.count("*") > found.limit).alias("cut"))
    return lanes.unionByName(shown).agg(F.coalesce(F.bool_or("cut"), F.lit(False)).alias("truncated"))


def evidence(found: Retrieval, pool: Pool, price_field: str | None = None) -> DataFrame:
    """The shown items with ``facts_excerpt`` and ``facts_length`` of their own text and the known ``offer_terms`` of the
    asked price (a map, empty where nothing is known)."""
    ids = F.broadcast(found.items.select("id"))  # a page: at most the plan's limit
    own = pool.observations.join(ids, "id", "left_semi").select("id", F.col(pool.item_key).alias("_item"), facts_excerpt(own_text(set(pool.observations.columns))).alias("_facts"))
    items = found.items.join(own, "id").withColumns({"facts_excerpt": F.col("_facts.excerpt"), "facts_length": F.col("_facts.facts_length")}).drop("_facts")
    empty = F.create_map().cast("map<string,struct<value:string,quote:string>>")
    if pool.terms is None or not price_field:
        return items.drop("_item").withColumn("offer_terms", empty)
    known = pool.terms.filter(F.col("field") == price_field).select(F.col("id").alias("_item"), F.col("terms").alias("offer_terms"))
    return items.join(known, "_item", "left").drop("_item").withColumn("offer_terms", F.coalesce("offer_terms", empty))


def answer_warnings(found: Retrieval, shown: DataFrame, plan: dict, coverage: DataFrame) -> DataFrame:
    """One row: ``warnings``, ``truncated``, ``candidates`` and ``groups`` of a retrieval.

    ``shown`` is from ``evidence``, ``coverage`` holds (metric, n) rows as from ``quality`` and ``price_coverage``. What the
    warnings say about this answer (lanes or pages cut, terms unknown, offers left out of a group) is read off it.
    """
    hard = plan.get("hard", {})
    lacking = ~F.forall(F.array(*map(F.lit, QUOTE_TERMS)), lambda t: F.map_contains_key("offer_terms", t))
    own = [truncated(found).select(F.lit("clipped").alias("metric"), F.col("truncated").cast("long").alias("n")),
           shown.agg(F.coalesce(F.max(lacking.cast("long")), F.lit(0)).alias("n")).select(F.lit("unknown_terms").alias("metric"), "n"),
           shown.agg(F.coalesce(F.max(F.col("alternatives_more").cast("long")), F.lit(0)).alias("n")).select(F.lit("group_clipped").alias("metric"), "n"),
           found.groups.agg(F.coalesce(F.sum("matching_offers"), F.lit(0)).alias("candidates"), F.count("*").alias("groups")).unpivot([], ["candidates", "groups"], "metric", "n")]
    rows = reduce(DataFrame.unionByName, own, coverage)
    names = ["missing_brand", "missing_supplier", "missing_category", "incomplete_files", "sources_without_version", "ambiguous_quote_series",
             "partial_newest_quotes", "unusable", "basis_conflicts", "clipped", "unknown_terms", "group_clipped", "candidates", "groups"]
    wide = rows.agg(*[F.coalesce(F.max(F.when(F.col("metric") == n, F.col("n"))), F.lit(0)).alias(n) for n in names])
    priced = bool(hard.get("price_field"))
    said = coverage_warnings(wide, hard, price=priced or None, unknown_terms=(F.col("unknown_terms") > 0) & F.lit(priced),
                             clipped=F.col("clipped") > 0, group_clipped=F.col("group_clipped") > 0)
    return said.select("warnings", (F.col("clipped") > 0).alias("truncated"), "candidates", "groups")


def retrieve_all(pool: Pool, plans: dict[str, dict], link: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Several plans by name: (items, lane reports), each row with its plan's name."""
    found = {name: retrieve(pool, plan, link) for name, plan in plans.items()}

    def together(part):
        frames = [getattr(r, part).select(F.lit(name).alias("plan_id"), "*") for name, r in found.items()]
        return reduce(DataFrame.unionByName, frames)
    return together("items"), together("lanes")
