"""Event log, jobs, leases, failure bursts, work lists: batch forms and their streaming twins."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import StructField

from draftlake.functions.numeric import n_rows
from draftlake.functions.numeric import significant
from draftlake.functions.ordered import attach, scan, time_block
from draftlake.session import ROCKSDB

EVENT_LIMIT = 500
TERMINAL = ["succeeded", "failed", "cancelled"]


# ---------------------------------------------------------------- STR-1


def read_events_after(events: DataFrame, job: Column | str | int, cursor: int, limit: int = EVENT_LIMIT) -> DataFrame:
    """The next events of a job after a cursor, oldest first; a page of the log."""
    return events.filter((F.col("job_id") == job) & (F.col("id") > cursor)).orderBy("id").limit(limit)


def follow_events(
    spark: SparkSession, path: str, schema: str, handle: Callable[[DataFrame, int], None], checkpoint: str
):
    """Streaming reader of an append-only log folder; the checkpoint is the cursor."""
    stream = spark.readStream.schema(schema).parquet(path)
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---------------------------------------------------------------- STR-2


def _flat(events: DataFrame) -> DataFrame:
    return events.select("id", "job_id", "type", "data.status", "data.progress", "data.message", "data.retry")


def job_state(events: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Current state per job from its events (id, job_id, type, data struct<status,progress,message,
    retry>). Map-side combined aggregates only; nothing of a job's log is collected.

    A failure becomes cancelled when cancellation was requested, queued while attempts are left and
    a retry was asked for, otherwise failed. Attempts start again at every gate.
    """
    e, kind = _flat(events), F.col("type")
    is_status, is_error, is_progress = kind == "status", kind == "error", kind == "progress"
    gates = e.filter(is_status & (F.col("status") == "waiting_gate")).groupBy("job_id").agg(F.max("id").alias("gate_id"))
    runs = attach(e.filter(is_status & (F.col("status") == "running")), gates, ["job_id"], "left")
    tries = runs.filter(F.col("id") > F.coalesce("gate_id", F.lit(-1))).groupBy("job_id").agg(n_rows().alias("attempts"))
    out = e.groupBy("job_id").agg(
        F.max_by("status", F.when(is_status, F.col("id"))).alias("last"),
        F.max(F.when(is_status, F.col("id"))).alias("last_id"),
        F.max(F.when(is_error, F.col("id"))).alias("error_id"),
        F.max_by("retry", F.when(is_error, F.col("id"))).alias("retry"),
        F.bool_or((kind == "log") & (F.col("message") == "cancellation requested")).alias("cancel"),
        F.max_by("progress", F.when(is_progress, F.col("id"))).alias("progress"),
        F.max("id").alias("cursor"), n_rows().alias("events"),
    )
    out = attach(out, tries, ["job_id"], "left")
    attempts = F.coalesce("attempts", F.lit(0).cast("bigint"))
    pending = F.coalesce(F.col("error_id") > F.col("last_id"), F.col("error_id").isNotNull() & F.col("last_id").isNull())
    failed = (
        F.when(F.coalesce("cancel", F.lit(False)), "cancelled")
        .when(F.coalesce("retry", F.lit(False)) & (attempts < max_attempts), "queued")
        .otherwise("failed")
    )
    state = F.when(F.coalesce(pending, F.lit(False)), failed).otherwise(F.coalesce("last", F.lit("queued")))
    clipped = F.least(F.greatest(F.coalesce("progress", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return out.select(
        "job_id", state.alias("status"), F.when(state == "succeeded", 1.0).otherwise(clipped).alias("progress"),
        attempts.alias("attempts"), F.coalesce("cancel", F.lit(False)).alias("cancel_requested"), "cursor", "events",
    ).withColumn("terminal", F.col("status").isin(TERMINAL))


STATE = "status string, progress double, attempts bigint, cancel boolean, cursor bigint, events bigint, lease bigint"
NEW_JOB = ("queued", 0.0, 0, False, -1, 0, 0)
SHOWN = "status string, progress double, attempts bigint, cancel_requested boolean, cursor bigint, events bigint, terminal boolean, expired boolean"


def apply_event(state: tuple, event: tuple, max_attempts: int) -> tuple:
    """The state of a job after one event (id, type, status, progress, message, retry)."""
    status, progress, attempts, cancel, _, events, lease = state
    no, kind, said, share, message, retry = event
    if kind == "status":
        status = said
        attempts = 0 if status == "waiting_gate" else attempts + (status == "running")
    elif kind == "progress":
        progress = float(share)
    elif kind == "log":
        cancel = cancel or message == "cancellation requested"
    elif kind == "error":
        status = "cancelled" if cancel else "queued" if bool(retry) and attempts < max_attempts else "failed"
    return status, progress, int(attempts), bool(cancel), int(no), events + 1, lease


class JobProcessor(StatefulProcessor):
    """State of one job with its lease. Every event of a running job extends the lease to ``lease_ms``
    after it; if the watermark passes the lease first, the job is lost: it is queued again while
    attempts are left, cancelled if that was asked for, else failed. The state of an ended job goes
    away ``keep_ms`` after its last event, so that late repeats do not revive it before."""

    def __init__(self, key_field: StructField, max_attempts: int, lease_ms: int, keep_ms: int) -> None:
        self.key_field, self.max_attempts, self.lease_ms, self.keep_ms = key_field, max_attempts, lease_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)

    def close(self) -> None:
        pass

    def _timer(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at:
            self.handle.registerTimer(at)

    def _row(self, key: tuple, state: tuple, expired: bool) -> pd.DataFrame:
        status, progress, attempts, cancel, cursor, events, _ = state
        shown = 1.0 if status == "succeeded" else min(1.0, max(0.0, progress))
        names = [self.key_field.name, *(f.split()[0] for f in SHOWN.split(", "))]
        return pd.DataFrame([(key[0], status, shown, attempts, cancel, cursor, events, status in TERMINAL, expired)], columns=names)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.job.get()) if self.job.exists() else NEW_JOB
        out = []
        for r in pd.concat(list(rows)).sort_values("id").itertuples(index=False):
            if state[0] in TERMINAL and state[4] >= r.id:
                continue  # a repeat of an ended job
            if state[0] == "running" and 0 < state[6] < r.ms:  # the lease ran out before this event
                state = self._lost(state)
                out.append(self._row(key, state, True))
            state = apply_event(state, (r.id, r.type, r.status, r.progress, r.message, r.retry), self.max_attempts)
            span = self.lease_ms if state[0] == "running" else self.keep_ms if state[0] in TERMINAL else 0
            state = (*state[:6], max(int(r.ms) + span, state[6]) if span else 0)
        self.job.update(state)
        if self.lease_ms:
            self._timer(state[6])
        yield from [*out, self._row(key, state, False)]

    def _lost(self, state: tuple) -> tuple:
        status = "cancelled" if state[3] else "queued" if state[2] < self.max_attempts else "failed"
        return (status, *state[1:6], state[6] + self.keep_ms if status in TERMINAL else 0)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = tuple(self.job.get()) if self.job.exists() else NEW_JOB
        if state[6] != expiredTimerInfo.getExpiryTimeInMs():
            return  # extended in the meantime
        if state[0] in TERMINAL:
            self.job.clear()
            return
        state = self._lost(state)
        self.job.update(state)
        if state[6]:
            self.handle.registerTimer(state[6])
        yield self._row(key, state, True)


def _with_state(df: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, time: str = "EventTime") -> DataFrame:
    provider = df.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass")
    if provider != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    return df.groupBy(*keys).transformWithStateInPandas(processor, schema, "Update", time)


def stream_job_state(
    events: DataFrame, ts: str | None = None, max_attempts: int = 3, lease_s: int = 120, keep_s: int = 86_400, late: str = "10 minutes"
) -> DataFrame:
    """Streaming form: state per job in the RocksDB store; emits changed jobs (update mode). The log is
    append-only with growing ids, so a micro-batch continues where the last one ended. ``ts`` names the
    time of an event; leases run out and ended jobs are forgotten by it, as the watermark passes.
    Without it nothing runs out."""
    time = F.col(ts).cast("timestamp") if ts else F.lit(None).cast("timestamp")
    flat = events.select(time.alias("at"), "id", "job_id", "type", "data.status", "data.progress", "data.message", "data.retry")
    flat = (flat.withWatermark("at", late) if ts else flat).withColumn("ms", F.coalesce(F.unix_millis("at"), F.lit(0)))
    field = events.schema["job_id"]
    processor = JobProcessor(field, max_attempts, lease_s * 1000 if ts else 0, keep_s * 1000 if ts else 0)
    return _with_state(flat, ["job_id"], processor, f"job_id {field.dataType.simpleString()}, {SHOWN}", "EventTime" if ts else "None")


# ---------------------------------------------------------------- STR-3


def backlog(jobs: DataFrame, now: Column | float) -> tuple[DataFrame, DataFrame]:
    """(next, report): the next runnable job per queue (priority, then oldest) and, per queue, counts
    by state, expired leases and exhausted attempts. Both are combined aggregates."""
    expired = (F.col("status") == "running") & (F.col("lease_until") < now)
    runnable = (F.col("status") == "queued") | expired
    spent = runnable & (F.col("attempts") >= F.col("max_attempts"))
    order = F.struct((-F.col("priority")).alias("p"), "created_at", "id")
    nxt = jobs.filter(runnable & ~spent).groupBy("queue").agg(F.min_by("id", order).alias("next_job"))
    report = jobs.groupBy("queue").agg(
        F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(F.col("status") == "running").alias("running"),
        F.count_if(expired).alias("expired"), F.count_if(spent).alias("exhausted"),
    )
    return nxt, report


# ---------------------------------------------------------------- STR-4


def silent_workers(beats: DataFrame, keys: Sequence[str], ts: str, beat_id: str, lease_s: int) -> DataFrame:
    """Gaps between heartbeats longer than the lease: the worker counted as lost from lost_at on."""
    prev = scan(beats, keys, [ts, beat_id], time_block(F.col(ts)), previous={"last_seen": F.col(ts)})
    lost_at = F.col("last_seen") + F.expr(f"INTERVAL {int(lease_s)} SECONDS")
    return prev.filter(F.col(ts) > lost_at).select(*keys, "last_seen", lost_at.alias("lost_at"), F.col(ts).alias("back_at"))


def stream_sessions(beats: DataFrame, keys: Sequence[str], ts: str, lease_s: int, late: str = "10 minutes") -> DataFrame:
    """Streaming form: sessions of heartbeats without a gap of a lease; closed when the watermark passes."""
    window = F.session_window(F.col(ts), f"{int(lease_s)} seconds")
    out = beats.withWatermark(ts, late).groupBy(*keys, window.alias("w")).agg(n_rows().alias("beats"))
    return out.select(*keys, F.col("w.start").alias("first_seen"), F.col("w.end").alias("lost_at"), "beats")


# ---------------------------------------------------------------- STR-5


def failure_bursts(failures: DataFrame, client: str, ts: str, limit: int = 20, window_s: int = 300) -> DataFrame:
    """Failures with their count over the trailing window, where the limit is reached. Windows run per
    (client, block); a row also visits the next block as context when its window reaches there, so
    one noisy client is spread over blocks and counts stay exact."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    span, width = window_s * 1_000_000, max(3600, window_s) * 1_000_000
    marked = failures.withColumn("__us", us).withColumn("__home", F.floor(F.col("__us") / width))
    reach = F.floor((F.col("__us") + span) / width)
    copies = marked.withColumn("__blk", F.explode(F.sequence(F.col("__home"), reach)))
    w = W.partitionBy(client, "__blk").orderBy("__us").rangeBetween(-span, 0)
    out = copies.withColumn("failures", n_rows().over(w)).filter("__blk = __home")
    return out.filter(F.col("failures") >= limit).drop("__us", "__home", "__blk")


class BurstProcessor(StatefulProcessor):
    """Failures of one client. They wait until the watermark has passed them, so that none before them
    can still come, and are then counted in order over the trailing window; times older than the
    window leave the state, and a client without times keeps none."""

    def __init__(self, client: str, ts: str, limit: int, span_us: int) -> None:
        self.client, self.ts, self.limit, self.span = client, ts, limit, span_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint")
        self.recent = handle.getListState("recent", "us bigint")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        times = [(int(t),) for part in rows for t in part["us"]]
        self.waiting.appendList(times)
        self.handle.registerTimer(min(times)[0] // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(r[0] for r in self.waiting.get()) if self.waiting.exists() else []
        due, rest = [t for t in waiting if t < passed], [t for t in waiting if t >= passed]
        known = (sorted(r[0] for r in self.recent.get()) if self.recent.exists() else []) + due
        counts = [bisect_right(known, t) - bisect_left(known, t - self.span) for t in due]
        for state, times in ((self.waiting, rest), (self.recent, [t for t in known if t >= passed - self.span])):
            if times:
                state.put([(t,) for t in times])
            else:
                state.clear()
        if rest:
            self.handle.registerTimer(rest[0] // 1000 + 1)
        elif known:
            self.handle.registerTimer(known[-1] // 1000 + self.span // 1000 + 1)  # to forget the last ones
        found = [(key[0], pd.Timestamp(t, unit="us"), n) for t, n in zip(due, counts, strict=True) if n >= self.limit]
        if found:
            yield pd.DataFrame(found, columns=[self.client, self.ts, "failures"])


def stream_bursts(failures: DataFrame, client: str, ts: str, limit: int = 20, window_s: int = 300, late: str = "10 minutes") -> DataFrame:
    """Streaming form: (client, ts, failures) of the rows of ``failure_bursts``, each as soon as the
    watermark has passed it."""
    timed = failures.select(client, F.col(ts).cast("timestamp").alias("at")).withWatermark("at", late).withColumn("us", F.unix_micros("at"))
    kind = failures.schema[client].dataType.simpleString()
    return _with_state(timed, [client], BurstProcessor(client, ts, limit, window_s * 1_000_000), f"{client} {kind}, {ts} timestamp, failures bigint")


# ---------------------------------------------------------------- STR-6


def cache_key(cols: Sequence[str], numbers: Sequence[str] = ()) -> Column:
    """Key of a result: hash over stage, version, input, configuration and models."""
    parts = [significant(F.col(c)).alias(c) if c in numbers else F.col(c) for c in sorted(cols)]
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def reusable_results(requests: DataFrame, stage_runs: DataFrame, broken: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, work list) by cache_key; stored results with missing blobs (``broken``) do not count."""
    have = stage_runs.select("cache_key").distinct()
    if broken is not None:
        have = have.join(broken.select("cache_key"), "cache_key", "left_anti")
    return requests.join(have, "cache_key", "left_semi"), requests.join(have, "cache_key", "left_anti")


def stream_new_content(docs: DataFrame, keys: Sequence[str], ts: str, late: str = "1 day") -> DataFrame:
    """Streaming de-duplication by content within the watermark."""
    return docs.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))
