"""Frozen selections: candidates are snapshotted, membership moves by revision, and export checks for drift."""

from pyspark.sql import Column, DataFrame, functions as F

from sourcemart.functions.prices import resolve_price
from sourcemart.functions.text import canonical_hash, literal_in
from sourcemart.operators.ranking import latest, top_per_group

SNAPSHOT = ["id", "name", "model", "variant", "features", "category", "source_file", "locator", "image"]
SHOWN_TAGS = 5
TAGS = "array<struct<kind:string,value:string,origin:string>>"


def payload_hash(*columns: str) -> Column:
    return canonical_hash(*columns)


def context_hash(obs: DataFrame, sources: DataFrame, profiles: DataFrame | None = None, tags: DataFrame | None = None,
                 links: DataFrame | None = None, terms: DataFrame | None = None, key="id") -> DataFrame:
    """obs(id, doc_id[, key]) -> context_hash over source state, facts, tags, terms and group; only active sources qualify.

    Tags and facts of a product are folded into sums of row hashes (120 bits), so a product with any number of tags
    is reduced map-side, in any order, and never collected.
    """
    rows = obs.select(*dict.fromkeys(["id", "doc_id", key]))
    return with_context(rows, sources, profiles, tags, links, terms, key).select("id", "doc_id", "context_hash")


def with_context(rows: DataFrame, sources: DataFrame, profiles: DataFrame | None = None, tags: DataFrame | None = None,
                 links: DataFrame | None = None, terms: DataFrame | None = None, key="id", how="inner") -> DataFrame:
    """rows(doc_id, key, ...) with their ``context_hash``; with ``how="left"`` rows of other sources stay, with null.

    What belongs to products is joined first and sources last, so the rows then lie by source.
    """
    state = sources.filter("state = 'active'").select("doc_id", _json_hash("series", "issued_on", "state").alias("_source"))

    def fold(frame, name):
        row = frame.select(F.col("id").alias(key), _json_hash(*[c for c in frame.columns if c != "id"]).alias("h"))

        def part(start):
            return F.sum(F.conv(F.substring("h", start, 15), 16, 10).cast("decimal(20,0)")).cast("string")
        return row.groupBy(key).agg(F.concat_ws("-", part(1), part(16)).alias(name))

    parts = ["source"]
    for name, frame in (("facts", profiles), ("tags", tags), ("links", links), ("terms", terms)):
        if frame is not None:
            rows = rows.join(fold(frame, f"_{name}"), key, "left")
            parts.append(name)
    digest = _json_hash(*[F.col(f"_{p}").alias(p) for p in parts])
    return (rows.join(state, "doc_id", how).withColumn("context_hash", F.when(F.col("_source").isNotNull(), digest))
            .drop(*[f"_{p}" for p in parts]))


def _json_hash(*columns) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def with_tags(rows: DataFrame, tags: DataFrame, key="id") -> DataFrame:
    """rows(key, ...) with ``shown_tags``: the first SHOWN_TAGS of tags(id, kind, value, origin), whose id is the ``key``."""
    first = top_per_group(tags.select("id", "kind", "value", "origin"), ["id"], ["kind", "value", "origin"], SHOWN_TAGS, "_n")
    shown = first.groupBy(F.col("id").alias(key)).agg(F.sort_array(F.collect_list(F.struct("kind", "value", "origin"))).alias("shown_tags"))
    return rows.join(shown, key, "left").withColumn("shown_tags", F.coalesce("shown_tags", F.array().cast(TAGS)))


def freeze(obs: DataFrame, chosen: DataFrame, price_fields: list[str], contexts: DataFrame | None = None, tags: DataFrame | None = None, key="id",
           by=("id",)) -> DataFrame:
    """obs(id, ..., prices, payload_hash), chosen(session_id, id, position), contexts(id, context_hash), one row per id;
    tags(id, kind, value, origin), whose id is the ``key`` of obs. Without contexts or tags, obs may hold ``context_hash``
    (``with_context``) and ``shown_tags`` (``with_tags``) itself. ``by`` names the columns that obs and chosen are met on: the id,
    and before it what rows lie by already, such as the source.

    One row per candidate with its snapshot, hashes and ``problem``. A session is written only if none of its rows
    has a problem; both come from one pass. A snapshot holds those of the SNAPSHOT columns that ``obs`` has, the shown prices
    and the first SHOWN_TAGS tags.
    """
    if not 1 <= len(price_fields) <= 2 or len(set(price_fields)) != len(price_fields):
        raise ValueError("Choose one or two price fields")
    # Prices are resolved before the join: what travels is the shown prices, not the whole map.
    kept = [c for c in SNAPSHOT if c in obs.columns]
    if tags is not None:
        obs = with_tags(obs, tags, key)
    held = F.col("shown_tags") if "shown_tags" in obs.columns else F.array().cast(TAGS)
    context = [] if contexts is not None else ["context_hash"]
    priced = obs.select(*dict.fromkeys([*kept, *by, "payload_hash", *context]), held.alias("_tags"),
                        F.array(*[resolve_price(F.col("prices"), f) for f in price_fields]).alias("shown"))
    rows = chosen.join(priced, list(by), "left")
    if contexts is not None:
        rows = rows.join(contexts.select("id", "context_hash"), "id", "left")
    problem = F.coalesce(
        F.when(F.col("payload_hash").isNull(), "unknown_id"),
        F.when(F.exists("shown", lambda p: p.isNull()), "price_absent_or_ambiguous"),
        F.when(F.exists("shown", lambda p: p["error"].isNotNull()), "price_error"),
        F.when(F.col("context_hash").isNull(), "source_not_active"))
    return rows.select("session_id", "id", "position", "payload_hash", "context_hash",
                       F.struct(*kept, F.col("shown").alias("prices"), F.col("_tags").alias("tags")).alias("snapshot"),
                       F.lit(False).alias("selected"), problem.alias("problem"))


def apply_selection(sessions: DataFrame, choices: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(session_id, revision, ids array): applied, conflict (revision or state) or outside (foreign ids)."""
    wanted = requests.select("session_id", F.explode("ids").alias("id"))
    foreign = (wanted.join(choices.select("session_id", "id"), ["session_id", "id"], "left_anti")
               .select("session_id").distinct().withColumn("_foreign", F.lit(True)))
    now = sessions.select("session_id", "state", F.col("revision").alias("_now"))
    return (requests.join(now, "session_id", "left").join(foreign, "session_id", "left")
            .select("session_id", "revision", "ids",
                    F.when(F.col("state").isNull(), "unknown").when(F.col("_foreign"), "outside")
                    .when((F.col("state") != "open") | (F.col("_now") != F.col("revision")), "conflict")
                    .otherwise("applied").alias("outcome"),
                    F.when((F.col("state") == "open") & (F.col("_now") == F.col("revision")) & F.col("_foreign").isNull(),
                           F.col("_now") + 1).otherwise(F.col("_now")).alias("next_revision")))


def selected_after(choices: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Choices with the membership that the applied requests ask for."""
    done = verdicts.filter("outcome = 'applied'")
    asked = done.select("session_id", F.explode("ids").alias("id")).withColumn("_in", F.lit(True))
    touched = done.select("session_id").withColumn("_touched", F.lit(True))
    return (choices.join(touched, "session_id", "left").join(asked, ["session_id", "id"], "left")
            .withColumn("selected", F.when(F.col("_touched"), F.coalesce("_in", F.lit(False))).otherwise(F.col("selected")))
            .drop("_touched", "_in"))


def drift(choices: DataFrame, current: DataFrame, by=("id",)) -> DataFrame:
    """Choices whose payload or context is no longer as frozen. A null frozen context (older sessions) passes. ``by``: as in ``freeze``."""
    now = current.select(*by, F.col("payload_hash").alias("now_payload"), F.col("context_hash").alias("now_context"))
    reason = (F.when(~F.col("payload_hash").eqNullSafe(F.col("now_payload")), "payload")
              .when(F.col("context_hash").isNotNull() & ~F.col("context_hash").eqNullSafe(F.col("now_context")), "context"))
    return (choices.join(now, list(by), "left").withColumn("drift", reason).filter("drift IS NOT NULL")
            .drop("now_payload", "now_context"))


def seal(sessions: DataFrame, choices: DataFrame, drifted: DataFrame) -> DataFrame:
    """Per session: sealed, or why not. A closed session cannot be sealed, nor one with nothing selected or drifted."""
    chosen = choices.groupBy("session_id").agg(F.count_if("selected").alias("_chosen"))
    moved = drifted.filter("selected").select("session_id").distinct().withColumn("_moved", F.lit(True))
    return (sessions.join(chosen, "session_id", "left").join(moved, "session_id", "left")
            .select("session_id", F.col("state").alias("before"),
                    F.when(F.col("state") == "closed", "closed").when(F.coalesce("_chosen", F.lit(0)) == 0, "empty")
                    .when(F.col("_moved"), "drifted").otherwise("sealed").alias("outcome")))


def new_versions(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(session_id, title, close): a rename changes the title only; closing sets the state and moves the revision."""
    rows = sessions.join(requests.withColumnRenamed("title", "_title"), "session_id")
    bad = F.col("_title").isNotNull() & (~F.length("_title").between(1, 160) | ~F.col("_title").rlike("\\S"))
    return rows.filter(~bad).select(
        "session_id", F.coalesce("_title", "title").alias("title"),
        F.when(F.col("close"), F.lit("closed")).otherwise(F.col("state")).alias("state"),
        (F.col("revision") + F.when(F.col("close"), F.lit(1)).otherwise(F.lit(0))).alias("revision"),
        (F.col("version") + 1).alias("version"))


def current_sessions(log: DataFrame) -> DataFrame:
    return latest(log, ["session_id"], ["version"])


def session_counts(choices: DataFrame) -> DataFrame:
    return choices.groupBy("session_id").agg(F.count("*").alias("candidates"), F.count_if("selected").alias("selected"))


def session_list(sessions: DataFrame, choices: DataFrame, query: str = "", state: str | None = None) -> DataFrame:
    """Sessions whose title holds the query literally, with their counts."""
    kept = sessions
    if query.strip():
        kept = kept.filter(literal_in("title", query.strip()))
    if state:
        kept = kept.filter(F.col("state") == state)
    return (kept.join(session_counts(choices), "session_id", "left")
            .withColumn("candidates", F.coalesce("candidates", F.lit(0)))
            .withColumn("selected", F.coalesce("selected", F.lit(0))))


def reopen(sessions: DataFrame, choices: DataFrame, request: str = "reopen") -> tuple[DataFrame, DataFrame]:
    """New open sessions with the same candidates and selection; the id depends on the old one and the request."""
    fresh = F.concat(F.lit("s_"), F.substring(F.sha2(F.concat_ws("|", F.lit(request), F.col("session_id").cast("string")), 256), 1, 24))
    any_selected = choices.groupBy("session_id").agg(F.bool_or("selected").alias("_any"))
    opened = (sessions.join(any_selected, "session_id", "left").withColumn("reopened_from", F.col("session_id"))
              .withColumn("session_id", fresh).withColumn("state", F.lit("open"))
              .withColumn("revision", F.when(F.col("_any"), F.lit(1)).otherwise(F.lit(0)).cast("long")).drop("_any"))
    return opened, choices.join(sessions.select("session_id"), "session_id", "left_semi").withColumn("session_id", fresh)


def compare(choices: DataFrame, session_id, ids: list, fields: list[str]) -> DataFrame:
    """One row per field, one column per compared member (1 to 4 members of one session)."""
    if not 1 <= len(ids) <= 4 or len(set(ids)) != len(ids):
        raise ValueError("Compare 1 to 4 distinct members")
    rows = choices.filter((F.col("session_id") == session_id) & F.col("id").isin(*ids))
    long = rows.unpivot(["id"], [F.col(f).cast("string").alias(f) for f in fields], "field", "value")
    return long.groupBy("field").pivot("id", [str(i) for i in ids]).agg(F.max("value"))


def public_projection(choices: DataFrame, rank: str = "position") -> DataFrame:
    """What a reader outside may see: place in the list instead of ids, no source, evidence, tags or selection."""
    return choices.select("session_id", F.col(rank).cast("string").alias("public_id"), "name", "model", "features", "prices")


def live(views: DataFrame, now) -> DataFrame:
    """Published views before their expiry; no expiry means no end."""
    return views.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))
