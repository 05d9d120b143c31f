"""Task event streams: the event table read as a stream, folded, deduplicated, resumed."""

from pyspark.sql import functions as F

from sourcemart.checks.base import check, sql
from sourcemart.model import task_events
from sourcemart.operators.ranking import latest
from sourcemart.operators.sessions import live
from sourcemart.session import scratch_path
from sourcemart.sources.intake import read_new_files
from sourcemart.streaming import tasks


def event_stream(t):
    return read_new_files(t.spark, t.folder, t.events.schema, "{events.parquet}")


TURN_STATUS = ["completed", "interrupted", "failed", "stopped"]


def with_payload(events):
    """Task events with what the fold reads: turns end in every way, every third error stands for an artifact, half of them unverified."""
    kind, seq = F.col("kind"), F.col("seq")
    made = F.when((kind == "error") & (seq % 3 == 0), "artifact").otherwise(kind)
    status = F.element_at(F.array(*[F.lit(s) for s in TURN_STATUS]), (seq % 4 + 1).cast("int"))
    return events.select(
        "task", "seq", made.alias("kind"), F.col("request").alias("request_id"), F.when(kind == "turn_started", seq.cast("string")).alias("turn_id"),
        F.when(kind == "turn_ended", status).alias("status"), F.when(kind == "error", "failed here").alias("message"),
        F.when(made == "artifact", F.concat(F.lit("a"), seq % 7)).alias("artifact_id"), F.when(seq % 2 == 1, "receipt").alias("verification_ref"))


def with_data(events):
    """The same with the payload as JSON, as a stream delivers it."""
    rows = with_payload(events)
    return rows.select("task", "seq", "kind", F.to_json(F.struct(*rows.columns[3:])).alias("data"))


FOLDED = """evt AS (SELECT task, seq, CASE WHEN kind = 'error' AND seq % 3 = 0 THEN 'artifact' ELSE kind END AS kind, request, ['completed', 'interrupted', 'failed', 'stopped'][seq % 4 + 1] AS status
      FROM tasks WHERE NOT (kind = 'error' AND seq % 3 = 0 AND seq % 2 = 0)),
    e AS (SELECT task, max(seq) FILTER (WHERE kind = 'turn_ended') AS ended, max(seq) AS last_seq, count(*) AS revision, arg_max(kind, seq) FILTER (WHERE kind <> 'artifact') AS last_kind,
      max(seq) FILTER (WHERE kind <> 'artifact') AS decided, max(seq) FILTER (WHERE kind = 'artifact') AS made, min(seq) FILTER (WHERE kind = 'artifact') AS first_made,
      arg_max(status, seq) FILTER (WHERE kind = 'turn_ended') AS status,
      arg_max(kind, seq) FILTER (WHERE kind IN ('turn_started', 'turn_ended', 'error')) AS turn, max(seq) FILTER (WHERE kind = 'turn_started') AS started FROM evt GROUP BY 1),
    q AS (SELECT task, request, max(seq) AS at, arg_max(kind, seq) AS kind FROM evt WHERE kind IN ('question', 'answered') GROUP BY 1, 2),
    p AS (SELECT q.task, q.request FROM q JOIN e USING (task) WHERE q.kind = 'question' AND q.at > coalesce(e.ended, -1)),
    folded AS (SELECT e.task, CASE WHEN made > coalesce(decided, -1) AND coalesce(turn, '') <> 'turn_started' THEN 'completed' WHEN last_kind = 'turn_started' THEN 'running' WHEN last_kind = 'question' THEN 'awaiting_user'
        WHEN last_kind = 'error' THEN 'failed' WHEN last_kind = 'turn_ended' THEN CASE WHEN status = 'interrupted' THEN 'interrupted' WHEN status <> 'completed' THEN 'failed' WHEN first_made < ended THEN 'completed' ELSE 'ready' END
        WHEN n > 0 THEN 'awaiting_user' ELSE 'running' END AS state, CASE WHEN turn = 'turn_started' THEN cast(started AS VARCHAR) END AS active_turn, coalesce(n, 0) AS pending, revision, last_seq
      FROM e LEFT JOIN (SELECT task, count(*) AS n FROM p GROUP BY 1) USING (task))"""


def folded_sql(body):
    return sql("", "tasks").rstrip() + ",\n" + FOLDED + "\n" + body


WHOLE = folded_sql("SELECT * FROM folded")
SHOWN = ["task", "state", "active_turn", "pending", "revision", "last_seq"]


def streamed(t, events, purpose):
    facts = tasks.task_facts(tasks.read_payload(with_data(events)))
    return tasks.task_state(tasks.merge_facts(tasks.run_available(facts, scratch_path(t.spark, purpose), "update"))).select(*SHOWN)


@check("st_fold", WHOLE)
def _(t):
    return streamed(t, task_events(event_stream(t)), "fold")


@check("st_replay_guard", WHOLE)
def _(t):
    # Every event is delivered twice; the second delivery changes nothing.
    once = task_events(event_stream(t))
    return streamed(t, once.withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2)))).drop("delivery"), "replay")


@check("st_fold_batch", WHOLE)
def _(t):
    return tasks.fold_events(with_payload(t.task_events())).select(*SHOWN)


@check("st_dedup", sql("SELECT DISTINCT task, kind, request FROM tasks", "tasks"))
def _(t):
    events = task_events(event_stream(t)).select("ts", "task", "kind", "request")
    once, _ = tasks.dedup_available(events, ["task", "kind", "request"], scratch_path(t.spark, "dedup"))
    return once.select("task", "kind", "request")


@check("st_dedup_first", sql("SELECT task, kind, request, min(seq) AS seq FROM tasks GROUP BY 1, 2, 3", "tasks"))
def _(t):
    return tasks.dedup(t.task_events().select("task", "kind", "request", "seq"), ["task", "kind", "request"])


@check("st_concat_delta", "SELECT conv_id AS task, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY 1")
def _(t):
    kind = F.when(F.col("turn") == 0, "text_done").otherwise("text_delta")
    events = t.conversations.select(F.col("conv_id").alias("task"), F.lit("b1").alias("block"), F.col("turn").alias("seq"), kind.alias("kind"), "text")
    return tasks.concat_deltas(events).select("task", "text")


@check("st_block_upsert", """WITH b AS (SELECT user_id AS task, event_type || '-' || (cast(json_extract(props, '$.k') AS BIGINT) % 4) AS block, event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'artifact' ELSE 'text' END AS block_kind, value AS body FROM events),
    l AS (SELECT task, block, max(seq) AS seq, arg_max(block_kind, seq) AS block_kind, arg_max(body, seq) AS body FROM b GROUP BY 1, 2)
    SELECT * FROM l WHERE block_kind <> 'artifact' OR seq = (SELECT max(x.seq) FROM l x WHERE x.task = l.task AND x.block_kind = 'artifact')""")
def _(t):
    block = F.concat_ws("-", "event_type", (F.get_json_object("props", "$.k").cast("long") % 4).cast("string"))
    events = t.events.select(F.col("user_id").alias("task"), block.alias("block"), F.col("event_id").alias("seq"),
                             F.when(F.col("event_type") == "purchase", "artifact").otherwise("text").alias("block_kind"), F.col("value").alias("body"))
    return tasks.upsert_blocks(events)


@check("st_pending", folded_sql("SELECT task, request FROM p"))
def _(t):
    return tasks.pending_requests(t.task_events())


@check("st_usage_max", """SELECT thread, cast(total AS BIGINT) AS total, min(seq) AS seq FROM (SELECT user_id AS thread, floor(value * 100) AS total,
    max(floor(value * 100)) OVER (PARTITION BY user_id) AS best, event_id AS seq FROM events WHERE event_type <> 'error') WHERE total = best GROUP BY 1, 2""")
def _(t):
    usage = event_stream(t).select(F.col("user_id").alias("thread"), F.when(F.col("event_type") != "error", F.floor(F.col("value") * 100)).alias("total"), F.col("event_id").alias("seq"))
    rows = tasks.run_available(tasks.usage_stream(usage), scratch_path(t.spark, "usage"), "update")
    return latest(rows.withColumn("first", -F.col("seq")), ["thread"], ["total", "first"]).select("thread", "total", "seq")


@check("st_recover", folded_sql("""SELECT task, CASE WHEN state IN ('running', 'awaiting_user') THEN 'interrupted' ELSE state END AS state, CASE WHEN state IN ('running', 'awaiting_user') THEN 0 ELSE pending END AS pending,
    revision + CASE WHEN state IN ('running', 'awaiting_user') THEN 1 ELSE 0 END AS revision, (SELECT count(DISTINCT request) FROM tasks r WHERE r.task = folded.task AND r.kind = 'answered') AS failed_receipts FROM folded"""))
def _(t):
    events = t.task_events()
    receipts = events.filter("kind IN ('answered', 'error')").select("task", "request", F.when(F.col("kind") == "answered", "accepted").otherwise("completed").alias("state")).distinct()
    after, settled = tasks.recover(tasks.fold_events(with_payload(events)), receipts)
    failed = settled.filter("state = 'failed'").groupBy("task").agg(F.count("*").alias("failed_receipts"))
    return after.join(failed, "task", "left").select("task", "state", "pending", "revision", F.coalesce("failed_receipts", F.lit(0)).alias("failed_receipts"))


@check("st_status_merge", """WITH m AS (SELECT user_id AS task, arg_max(value, event_id) FILTER (WHERE event_type = 'view') AS v, arg_max(value, event_id) FILTER (WHERE event_type = 'click') AS c FROM events GROUP BY 1)
    SELECT task, cast(floor(v) AS BIGINT) AS state, cast(floor(c) AS BIGINT) AS progress, 'job' AS kind FROM m""")
def _(t):
    last = t.events.groupBy(F.col("user_id").alias("task")).agg(
        F.max_by("value", F.when(F.col("event_type") == "view", F.col("event_id"))).alias("v"), F.max_by("value", F.when(F.col("event_type") == "click", F.col("event_id"))).alias("c"))
    whole = [F.floor(c).cast("string") for c in ("v", "c")]
    current = last.select("task", F.create_map(F.lit("state"), F.lit("0"), F.lit("kind"), F.lit("job")).alias("payload"))
    changes = last.select("task", F.create_map(F.lit("state"), whole[0], F.lit("progress"), whole[1]).alias("payload"))
    merged, _ = tasks.merge_status(current, changes, ["task"])
    return merged.select("task", *[F.element_at("payload", F.lit(k)).cast("long").alias(k) for k in ("state", "progress")], F.element_at("payload", F.lit("kind")).alias("kind"))


@check("st_cursor_resume", sql("SELECT t.task, t.seq, t.kind FROM tasks t LEFT JOIN (SELECT task, max(seq) AS at FROM tasks WHERE kind = 'error' GROUP BY 1) c ON c.task = t.task WHERE t.seq > coalesce(c.at, -1)", "tasks"))
def _(t):
    events = t.task_events()
    delivered = events.filter("kind = 'error'").groupBy("task").agg(F.max("seq").alias("cursor"))
    return tasks.resume(events, delivered).select("task", "seq", "kind")


@check("st_action_guard", folded_sql("""SELECT task, seq, outcome FROM (SELECT a.*, CASE WHEN held = payload THEN 'replayed' WHEN held IS NOT NULL THEN 'conflict' WHEN f.revision <> expected OR busy THEN 'conflict'
      WHEN seq = first_value(seq) OVER good THEN 'accepted' WHEN request = first_value(request) OVER good AND payload = first_value(payload) OVER good THEN 'replayed' ELSE 'conflict' END AS outcome
    FROM (SELECT t.*, 'h' || (t.seq % 2) AS payload, CASE WHEN t.seq % 3 <> 0 THEN f.revision ELSE 0 END AS expected, r.held, t.seq % 5 = 0 AND (f.active_turn IS NOT NULL OR f.state IN ('running', 'awaiting_user')) AS busy,
        NOT (r.held IS NOT NULL OR t.seq % 3 = 0 OR (t.seq % 5 = 0 AND (f.active_turn IS NOT NULL OR f.state IN ('running', 'awaiting_user')))) AS candidate
      FROM tasks t JOIN folded f USING (task) LEFT JOIN (SELECT task, request, 'h' || min(seq % 2) AS held FROM tasks WHERE kind = 'answered' GROUP BY 1, 2) r ON r.task = t.task AND r.request = t.request
      WHERE t.kind = 'question') a JOIN folded f USING (task) WINDOW good AS (PARTITION BY a.task ORDER BY candidate DESC, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""))
def _(t):
    events = t.task_events()
    snapshots = tasks.fold_events(with_payload(events))
    receipts = events.filter("kind = 'answered'").groupBy("task", F.col("request").alias("request_id")).agg(F.concat(F.lit("h"), F.min(F.col("seq") % 2)).alias("payload_hash"))
    actions = events.filter("kind = 'question'").join(snapshots.select("task", "revision"), "task").select(
        "task", F.col("request").alias("request_id"), "seq", F.concat(F.lit("h"), F.col("seq") % 2).alias("payload_hash"),
        F.when(F.col("seq") % 3 != 0, F.col("revision")).otherwise(0).alias("expected_revision"), F.when(F.col("seq") % 5 == 0, "message").otherwise("select").alias("kind"))
    return tasks.accept_actions(snapshots, receipts, actions).select("task", "seq", "outcome")


@check("st_expiry", "SELECT event_id FROM events WHERE event_type = 'signup' OR ts + to_hours(cast(floor(value) AS INT)) > TIMESTAMP '2024-01-10 00:00:00'")
def _(t):
    ends = F.when(F.col("event_type") != "signup", F.col("ts") + F.make_dt_interval(hours=F.floor("value").cast("int")))
    return live(t.events.select("event_id", ends.alias("expires_at")), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")).select("event_id")
