"""STR operators, batch forms, on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.functions.numeric import n_rows
from draftlake.catalogue.registry import Tables, query
from draftlake.streaming import events as op



@query(
    "event_cursor",
    "SELECT event_id AS id, user_id AS job_id, ts, event_type AS type FROM events WHERE user_id = 7 AND event_id > 100 ORDER BY event_id LIMIT 500",
)
def event_cursor(t: Tables) -> DataFrame:
    """STR-1: the next page of one user's log (a page limit is the feature)."""
    e = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), "ts", F.col("event_type").alias("type"))
    return op.read_events_after(e, 7, 100)


def job_events(events: DataFrame) -> DataFrame:
    et = F.col("event_type")
    kind = F.when(et == "error", "error").when(et == "view", "progress").when((et == "signup") & (F.col("value") > 100), "log").otherwise("status")
    status = F.when(et == "click", "running").when(et == "purchase", "waiting_gate").when(et == "signup", "succeeded")
    data = F.struct(
        status.alias("status"), (F.col("value") / 20).alias("progress"), F.when(kind == "log", "cancellation requested").alias("message"),
        (F.get_json_object("props", "$.k").cast("int") < 50).alias("retry"),
    )
    return events.select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), kind.alias("type"), data.alias("data"))


@query(
    "job_state",
    """
    WITH e AS (SELECT *, CASE WHEN event_type = 'click' THEN 'running' WHEN event_type = 'purchase' THEN 'waiting_gate' WHEN event_type = 'signup' AND value <= 100 THEN 'succeeded' END AS st,
        CAST(json_extract(props, '$.k') AS INT) < 50 AS retry FROM events),
    a AS (SELECT user_id, arg_max(st, event_id) FILTER (st IS NOT NULL) AS last, max(event_id) FILTER (st IS NOT NULL) AS last_id, max(event_id) FILTER (event_type = 'error') AS err,
        arg_max(retry, event_id) FILTER (event_type = 'error') AS retry, coalesce(bool_or(event_type = 'signup' AND value > 100), false) AS cancel,
        arg_max(value / 20, event_id) FILTER (event_type = 'view') AS p, max(event_id) AS cursor, count(*) AS events,
        coalesce(max(event_id) FILTER (st = 'waiting_gate'), -1) AS gate FROM e GROUP BY 1),
    n AS (SELECT e.user_id, count(*) AS attempts FROM e JOIN a ON a.user_id = e.user_id AND event_id > gate WHERE st = 'running' GROUP BY 1),
    s AS (SELECT a.*, coalesce(attempts, 0) AS attempts, CASE WHEN coalesce(err > last_id, err IS NOT NULL AND last_id IS NULL, false)
        THEN CASE WHEN cancel THEN 'cancelled' WHEN retry AND coalesce(attempts, 0) < 3 THEN 'queued' ELSE 'failed' END ELSE coalesce(last, 'queued') END AS status FROM a LEFT JOIN n USING (user_id))
    SELECT user_id AS job_id, status, CASE WHEN status = 'succeeded' THEN 1 ELSE least(greatest(coalesce(p, 0), 0), 1) END AS progress, attempts,
      cancel AS cancel_requested, cursor, events, status IN ('succeeded', 'failed', 'cancelled') AS terminal FROM s
    """,
)
def job_state(t: Tables) -> DataFrame:
    """STR-2: state of every user's job folded from its events."""
    return op.job_state(job_events(t.events))


@query(
    "backlog",
    """
    WITH j AS (SELECT o_orderkey AS id, o_orderpriority AS queue, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'succeeded' END AS st,
        o_custkey % 5 AS pr, o_orderdate AS c, o_totalprice AS lease, o_custkey % 4 AS att FROM orders),
    r AS (SELECT *, st = 'queued' OR (st = 'running' AND lease < 200000) AS ok FROM j),
    n AS (SELECT queue, id AS next_job FROM r WHERE ok AND att < 3 QUALIFY row_number() OVER (PARTITION BY queue ORDER BY pr DESC, c, id) = 1)
    SELECT r.queue, count_if(st = 'queued') AS queued, count_if(st = 'running') AS running, count_if(st = 'running' AND lease < 200000) AS expired,
      count_if(ok AND att >= 3) AS exhausted, any_value(next_job) AS next_job FROM r LEFT JOIN n ON n.queue = r.queue GROUP BY r.queue
    """,
)
def backlog(t: Tables) -> DataFrame:
    """STR-3: orders as jobs of a priority queue."""
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("succeeded")
    jobs = t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("queue"), status.alias("status"), (F.col("o_custkey") % 5).alias("priority"),
        F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("lease_until"), (F.col("o_custkey") % 4).alias("attempts"), F.lit(3).alias("max_attempts"),
    )
    nxt, report = op.backlog(jobs, F.lit(200000.0))
    return report.join(nxt, "queue", "left")


@query(
    "gap_sessions",
    """
    WITH p AS (SELECT user_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_seen, ts AS back_at FROM events)
    SELECT user_id, last_seen, last_seen + INTERVAL 43200 SECOND AS lost_at, back_at FROM p WHERE back_at > last_seen + INTERVAL 43200 SECOND
    """,
)
def gap_sessions(t: Tables) -> DataFrame:
    """STR-4: users silent for more than twelve hours."""
    return op.silent_workers(t.events.select("user_id", "ts", "event_id"), ["user_id"], "ts", "event_id", 43200)


@query(
    "bursts",
    """
    WITH c AS (SELECT event_id, user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS failures FROM events)
    SELECT * FROM c WHERE failures >= 5
    """,
)
def bursts(t: Tables) -> DataFrame:
    """STR-5: users with five or more events within a day."""
    return op.failure_bursts(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", limit=5, window_s=86400)


@query(
    "work_list",
    """
    WITH r AS (SELECT doc_id, source, sha256('{"lang":"' || lang || '","n_chars":' || n_chars || ',"sha":"' || sha256(text) || '","source":"' || source || '"}') AS cache_key FROM documents),
    s AS (SELECT r.cache_key FROM r JOIN labels USING (doc_id) WHERE quality = 1)
    SELECT source, count_if(cache_key IN (SELECT cache_key FROM s)) AS hits, count_if(cache_key NOT IN (SELECT cache_key FROM s)) AS todo, min(cache_key) AS first_key FROM r GROUP BY 1
    """,
)
def work_list(t: Tables) -> DataFrame:
    """STR-6: documents whose result is stored and those still to do."""
    d = t.documents.withColumn("sha", F.sha2("text", 256))
    requests = d.select("doc_id", "source", op.cache_key(["source", "lang", "n_chars", "sha"]).alias("cache_key"))
    stored = requests.join(t.labels.filter("quality = 1").select("doc_id"), "doc_id", "left_semi")
    hits, todo = op.reusable_results(requests, stored)
    both = hits.withColumn("hit", F.lit(True)).unionByName(todo.withColumn("hit", F.lit(False)))
    return both.groupBy("source").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("todo"), F.min("cache_key").alias("first_key"))
