"""Streams give what the batch forms give."""

import datetime as dt
import random

from pyspark.sql import functions as F

from draftlake.streaming import events as ev

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id bigint, job_id string, type string, data struct<status:string,progress:double,message:string,retry:boolean>"


def log(spark):
    s = lambda v: (v, None, None, None)
    rows = [
        (1, "a", "status", s("running")), (2, "a", "progress", (None, 1.7, None, None)), (3, "a", "status", s("succeeded")),
        (4, "b", "status", s("running")), (5, "b", "error", (None, None, None, True)),
        (6, "c", "status", s("running")), (7, "c", "log", (None, None, "cancellation requested", None)), (8, "c", "error", (None, None, None, True)),
        (9, "d", "status", s("running")), (10, "d", "status", s("running")), (11, "d", "status", s("running")), (12, "d", "error", (None, None, None, True)),
        (13, "e", "status", s("running")), (14, "e", "status", s("waiting_gate")), (15, "f", "progress", (None, 0.25, None, None)),
    ]
    return spark.createDataFrame(rows, SCHEMA)


WANT = {
    "a": ("succeeded", 1.0, 1), "b": ("queued", 0.0, 1), "c": ("cancelled", 0.0, 1), "d": ("failed", 0.0, 3), "e": ("waiting_gate", 0.0, 0), "f": ("queued", 0.25, 0),
}


def test_job_state_batch(spark):
    assert {r.job_id: (r.status, r.progress, r.attempts) for r in ev.job_state(log(spark)).collect()} == WANT


def test_job_state_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    for lo, hi in ((1, 6), (7, 15)):
        log(spark).filter(F.col("id").between(lo, hi)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    changes = []
    q = ev.stream_job_state(stream).writeStream.outputMode("update").foreachBatch(lambda df, _: changes.extend(df.collect())).trigger(availableNow=True).start()
    q.awaitTermination(120)
    newest = {r.job_id: r for r in sorted(changes, key=lambda r: r.cursor)}
    assert {k: (r.status, r.progress, r.attempts) for k, r in newest.items()} == WANT
    batch = {r.job_id: r.asDict() for r in ev.job_state(log(spark)).collect()}
    assert not any(r.expired for r in newest.values())
    assert {k: {f: v for f, v in r.asDict().items() if f != "expired"} for k, r in newest.items()} == batch


def test_cursor_resumes(spark, tmp_path):
    src, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    seen = []
    for lo, hi in ((1, 6), (7, 15)):
        log(spark).filter(F.col("id").between(lo, hi)).coalesce(1).write.mode("append").parquet(src)
        ev.follow_events(spark, src, SCHEMA, lambda df, _: seen.extend(r.id for r in df.collect()), ck).awaitTermination(120)
    assert sorted(seen) == list(range(1, 16))
    page = ev.read_events_after(log(spark), "d", 9, 2)
    assert [r.id for r in page.collect()] == [10, 11]


def beats(spark):
    rows = [("w1", T0 + dt.timedelta(seconds=s)) for s in (0, 30, 60, 300, 310)] + [("w2", T0 + dt.timedelta(seconds=s)) for s in (0, 119, 5000)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, worker string, ts timestamp")


def test_silent_workers(spark, tmp_path):
    lost = {(r.worker, r.last_seen) for r in ev.silent_workers(beats(spark), ["worker"], "ts", "id", 120).collect()}
    assert lost == {("w1", T0 + dt.timedelta(seconds=60)), ("w2", T0 + dt.timedelta(seconds=119))}
    src = str(tmp_path / "in")
    beats(spark).coalesce(1).write.parquet(src)
    late = spark.createDataFrame([(99, "z", T0 + dt.timedelta(days=1))], "id int, worker string, ts timestamp")
    late.write.mode("append").parquet(src)
    stream = spark.readStream.schema("id int, worker string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    q = ev.stream_sessions(stream, ["worker"], "ts", 120).writeStream.outputMode("append").format("memory").queryName("sess").trigger(availableNow=True).start()
    q.awaitTermination(120)
    closed = {(r.worker, r.lost_at - dt.timedelta(seconds=120)) for r in spark.table("sess").collect()}
    # every loss of the batch form is a closed session; the streams also close the last sessions
    assert lost <= closed


def in_files(spark, tmp_path, df, parts):
    """A stream that reads the rows in files of the given part numbers, in their order."""
    src = str(tmp_path / "in")
    for n in range(parts):
        df.filter(F.col("part") == n).drop("part").coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(src)


def changes_of(out):
    rows = []
    q = out.writeStream.outputMode("update").foreachBatch(lambda df, n: rows.extend((n, r) for r in df.collect())).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return rows


def test_stream_bursts_are_exact(spark, tmp_path):
    r = random.Random(9)
    times = sorted(r.randrange(0, 4000) + r.choice([0, 0.25]) for _ in range(220))
    rows = [(i, f"c{r.randrange(3)}", T0 + dt.timedelta(seconds=t), min(3, max(0, int(t // 1000) + r.choice([0, 0, 0, -1]) + (1 if t % 1000 > 900 else 0)))) for i, t in enumerate(times)]
    rows += [(900 + k, "c0", T0 + dt.timedelta(seconds=77), 0) for k in range(9)] + [(999, "late", T0 + dt.timedelta(days=2), 4)]
    df = spark.createDataFrame(rows, "id int, client string, ts timestamp, part int")
    got = changes_of(ev.stream_bursts(in_files(spark, tmp_path, df, 5), "client", "ts", limit=8, window_s=300, late="3000 seconds"))
    want = ev.failure_bursts(df, "client", "ts", limit=8, window_s=300).collect()
    key = lambda x: (x.client, x.ts, x.failures)
    assert sorted(key(x) for _, x in got) == sorted(map(key, want)) and len(want) > 30


def leased(events, lease, attempts=3):
    """One job's state after its timed events in order, and after its lease ran out: sequential."""
    state, until = ev.NEW_JOB, None
    for t, event in events:
        if until is not None and t > until and state[0] == "running":
            state = ("cancelled" if state[3] else "queued" if state[2] < attempts else "failed", *state[1:])
        state = ev.apply_event(state, event, attempts)
        until = t + lease
    return "cancelled" if state[0] == "running" and state[3] else "queued" if state[0] == "running" and state[2] < attempts else "failed" if state[0] == "running" else state[0]


def test_leases_run_out_and_ended_jobs_go(spark, tmp_path):
    s = lambda v: ("status", v, None, None, None)
    p = ("progress", None, 0.5, None, None)
    cancel = ("log", None, None, "cancellation requested", None)
    logs = {  # seconds and event; files hold an hour each
        "lost": [(0, s("running")), (60, p)], "kept": [(0, s("running")), (90, p), (180, p), (200, s("succeeded"))],
        "again": [(0, s("running")), (4000, s("running")), (4100, s("succeeded"))], "spent": [(0, s("running")), (4000, s("running")), (8000, s("running"))],
        "gone": [(0, s("running")), (50, cancel)], "gate": [(0, s("running")), (9, s("waiting_gate"))],
    }
    rows, no = [], 0
    for t, job, e in sorted((t, job, e) for job, log_ in logs.items() for t, e in log_):
        rows.append((no := no + 1, job, e[0], e[1:], T0 + dt.timedelta(seconds=t), t // 3600))
    rows += [(1000 + k, "clock", "log", (None, None, "tick", None), T0 + dt.timedelta(hours=k, minutes=50), k) for k in range(6)]
    df = spark.createDataFrame(rows, f"{SCHEMA}, ts timestamp, part int")
    got = changes_of(ev.stream_job_state(in_files(spark, tmp_path, df, 6), "ts", lease_s=120, keep_s=600, late="10 seconds"))
    newest = {r.job_id: (n, r) for n, r in sorted(got, key=lambda x: (x[0], x[1].cursor, x[1].expired))}
    assert {j: newest[j][1].status for j in logs} == {j: leased([(t, (0, *e)) for t, e in log_], 120) for j, log_ in logs.items()}
    assert {j for j in logs if any(r.expired for _, r in got if r.job_id == j)} == {"lost", "again", "spent", "gone"}
    assert newest["spent"][1].status == "failed" and newest["lost"][1].attempts == 1


def test_stream_dedup(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("p", "x", T0), ("p", "x", T0 + dt.timedelta(minutes=1)), ("p", "y", T0), ("q", "x", T0)]
    spark.createDataFrame(rows, "project_id string, sha256 string, ts timestamp").write.parquet(src)
    stream = spark.readStream.schema("project_id string, sha256 string, ts timestamp").parquet(src)
    q = ev.stream_new_content(stream, ["project_id", "sha256"], "ts").writeStream.format("memory").queryName("fresh").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.project_id, r.sha256) for r in spark.table("fresh").collect()) == [("p", "x"), ("p", "y"), ("q", "x")]
