import hashlib

import pytest

from draftlake.operators import integrity as op

ENTRY = "archive_id string, pos int, name string, file_size bigint, compress_size bigint, mode int, flag_bits int, depth int"


def status(spark, rows):
    archives, entries = op.screen_archives(spark.createDataFrame(rows, ENTRY))
    return {r.archive_id: r.reasons for r in archives.collect()}, {(r.archive_id, r.name): r.status for r in entries.collect()}


def test_archives(spark):
    mb = 1024**2
    rows = [
        ("ok", 0, "A/plan.pdf", 100, 50, 0, 0, 1), ("ok", 1, "a/PLAN.pdf", 100, 50, 0, 0, 1), ("ok", 2, "a/", 0, 0, 0, 0, 1),
        ("ok", 3, "__MACOSX/x", 1, 1, 0, 1, 1), ("ok", 4, "./b.txt", 1, 1, 0o100644, 0, 1),
        ("link", 0, "x", 1, 1, 0o120777, 0, 1), ("up", 0, "a\\..\\x", 1, 1, 0, 0, 1), ("abs", 0, "C:/x", 1, 1, 0, 0, 1),
        ("enc", 0, "x", 1, 1, 0, 1, 1), ("bomb", 0, "x", 20 * mb, 1000, 0, 0, 1), ("deep", 0, "x", 1, 1, 0, 0, 4), ("dev", 0, "x", 1, 1, 0o020600, 0, 1),
    ]
    reasons, got = status(spark, rows)
    assert got["ok", "A/plan.pdf"] == "kept" and got["ok", "a/PLAN.pdf"] == "duplicate" and got["ok", "a/"] == "folder"
    assert got["ok", "__MACOSX/x"] == "junk" and got["ok", "./b.txt"] == "kept" and got["deep", "x"] == "too_deep"
    assert reasons["ok"] == [] and reasons["bomb"] == ["archive_ratio", "unsafe_entry"]
    assert all(got[a, n] == "refused" for a, n in got if a in ("link", "up", "abs", "enc", "bomb", "dev"))


def test_upload_cycle(spark):
    body = b"hello world, this is a plan"
    parts = [body[i : i + 10] for i in range(0, len(body), 10)]
    sha = hashlib.sha256(body).hexdigest()
    uploads = spark.createDataFrame([("u", len(body), 10, sha, "open"), ("v", 5, 10, "0" * 64, "complete")], "upload_id string, size bigint, chunk_size bigint, sha256 string, status string")
    rows = [("u", i, bytearray(p), hashlib.sha256(p).hexdigest(), i) for i, p in enumerate(parts)]
    rows += [
        ("u", 0, bytearray(b"0123456789"), None, -1), ("u", 1, bytearray(b"short"), None, 9), ("u", 7, bytearray(b"0123456789"), None, 9),
        ("u", 1, bytearray(b"0123456789"), "bad", 9), ("v", 0, bytearray(b"12345"), None, 1), ("w", 0, bytearray(b"1"), None, 1),
    ]
    chunks = spark.createDataFrame(rows, "upload_id string, idx bigint, data binary, sha256 string, arrival bigint")
    stored, refused = op.validate_chunks(uploads, chunks)
    assert sorted(r.reason for r in refused.collect()) == sorted(["wrong_size", "index_out_of_range", "checksum_mismatch", "not_open", "unknown_upload"])
    r = op.assemble_chunks(uploads.filter("upload_id = 'u'"), stored).first()
    assert r.verified and r.assembled_size == len(body) and r.parts == 3
    assert op.missing_chunks(uploads, stored.filter("idx <> 1")).filter("upload_id = 'u'").first().idx == 1
    assert not op.assemble_chunks(uploads, stored.filter("idx <> 1")).filter("upload_id = 'u'").first().verified


def test_dedupe_with_existing(spark):
    docs = spark.createDataFrame([("p", "x", 10, 1), ("p", "x", 11, 2), ("p", "y", 12, 3), ("q", "x", 13, 4)], "project_id string, sha256 string, doc_id int, arrival int")
    old = spark.createDataFrame([("p", "y", 5)], "project_id string, sha256 string, doc_id int")
    got = {r.doc_id: (r.document_id, r.deduplicated) for r in op.dedupe_by_content(docs, old).collect()}
    assert got == {10: (10, False), 11: (10, True), 12: (5, True), 13: (13, False)}


def test_fingerprint_ignores_noise(spark):
    df = spark.createDataFrame([(0.1 + 0.2, "a", 1), (0.3, "a", 2), (0.31, "a", 3)], "x double, t string, version int")
    f = [r.fingerprint for r in op.content_fingerprint(df).orderBy("version").collect()]
    assert f[0] == f[1] != f[2]


def test_purge(spark):
    tables = {
        "projects": spark.createDataFrame([("p", "P", "{1}", None), ("q", "Q", "{2}", None), ("r", "R", "{}", None)], "id string, name string, meta_json string, purged_at timestamp"),
        "jobs": spark.createDataFrame([("j1", "p", "succeeded"), ("j2", "q", "running"), ("j3", "r", "queued")], "id string, project_id string, status string"),
        "job_events": spark.createDataFrame([("j1",), ("j2",), ("j3",)], "job_id string"),
    }
    ids = spark.createDataFrame([("p",), ("q",)], "project_id string")
    left, refused = op.purge_project(tables, ids)
    assert [r.project_id for r in refused.collect()] == ["q"]
    assert sorted(r.job_id for r in left["job_events"].collect()) == ["j2", "j3"]
    got = {r.id: (r.name, r.purged_at is not None) for r in left["projects"].collect()}
    assert got == {"p": ("[purged]", True), "q": ("Q", False), "r": ("R", False)}


@pytest.mark.parametrize("size,stored,want", [(0, 0, "empty"), (5 * 1024**3, 0, "file_too_large"), (1, 50 * 1024**3, "project_full"), (1, 0, None)])
def test_quota(spark, size, stored, want):
    new = spark.createDataFrame([("p", size)], "project_id string, size bigint")
    usage = spark.createDataFrame([("p", stored)], "project_id string, stored_bytes bigint")
    assert op.quota_check(new, usage).first().refused == want


def test_chunks_of_closed_uploads_are_not_stored_and_not_met(spark):
    uploads = spark.range(6).selectExpr("id AS upload_id", "12L AS size", "10L AS chunk_size", "CASE WHEN id = 5 THEN NULL WHEN id % 2 = 0 THEN 'open' ELSE 'complete' END AS status")
    chunks = spark.range(60).selectExpr("id DIV 8 AS upload_id", "CASE WHEN id % 8 = 7 THEN NULL ELSE id % 8 - 1 END AS idx", "CASE id % 8 WHEN 1 THEN 10L WHEN 2 THEN 2L WHEN 3 THEN NULL ELSE 10L END AS size",
                                        "CASE WHEN id % 16 < 9 THEN 'a' END AS sha256", "CASE WHEN id % 16 = 1 THEN 'b' ELSE 'a' END AS actual_sha256", "id AS arrival")
    stored, refused = op.validate_chunks(uploads, chunks)
    gone = {r.arrival for r in refused.collect()}
    assert {(r.upload_id, r.idx) for r in stored.collect()} == {(i // 8, None if i % 8 == 7 else i % 8 - 1) for i in range(60) if i not in gone}
    assert "LeftOuter" not in stored._jdf.queryExecution().optimizedPlan().toString()
