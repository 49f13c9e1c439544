import gzip
import random
import json

from draftlake.operators import licences as lic
from draftlake.sources import catalog, files, sheets, sinks


def test_sniffing(spark):
    given = [
        (b"%PDF-1.7", "a", "pdf"), (b"\x89PNG\r\n", "a", "png"), (b"\xff\xd8\xff\xe0", "a", "jpeg"), (b"RIFF0000WEBPVP8", "a", "webp"), (b"II*\x00", "a", "tiff"),
        (b"\x00\x00\x00\x18ftypheic", "a", "heic"), (b"PK\x03\x04", "a", "zip"), (b"AC1032", "a", "dwg"), (b"ISO-10303-21;", "a", "ifc"),
        (b"AutoCAD Binary DXF", "a", "dxf"), (b"3D Geometry File Format ", "a", "3dm"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1zzRevit", "a", "rvt"),
        (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1zz", "a", "ole"), (b"\xff\xfe\xff\x0eSketchUp Model", "a", "skp"), (b"0\nSECTION\n2\nHEADER", "a", "dxf"),
        (b"\xef\xbb\xbf<?xml version='1.0'?><svg/>", "a", "svg"), (b"<?xml version='1.0'?><a/>", "a", "xml"), (b"# Title", "a", "md"), (b"text", "x.MD", "md"),
        ("düz metin".encode(), "a.txt", "txt"), (b"\xff\xfe\x00\x01", "a", None), (("é" * 5000 + "x").encode()[1:], "a", None), (("x" + "é" * 5000).encode(), "a", "txt"),
    ]
    df = spark.createDataFrame([(i, bytearray(b), n) for i, (b, n, _) in enumerate(given)], "i int, content binary, filename string")
    got = files.sniff_files(df).orderBy("i").collect()
    assert [r.kind for r in got] == [k for _, _, k in given]
    codes = {r.kind: r.error_code for r in got}
    assert codes["rvt"] == codes["skp"] == "unsupported_native" and codes["ole"] == codes[None] == codes["xml"] == "unsupported_type" and codes["pdf"] is None
    zips = spark.createDataFrame([(bytearray(b"PK"), "a", ["[Content_Types].xml", "xl/workbook.xml"]), (bytearray(b"PK"), "a", ["[Content_Types].xml", "word/vbaProject.bin"]), (bytearray(b"PK"), "a", ["x"])], "content binary, filename string, names array<string>")
    assert [(r.kind, r.accepted) for r in files.sniff_files(zips, names="names").collect()] == [("xlsx", True), ("docm", False), ("zip", True)]


def test_corpus(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 a")
    lines = [{"id": "1", "class": "section", "source": "scan", "lang": "tr", "file": "a.pdf", "gt": "{}"}, {"id": "2", "class": "detail", "source": "scan", "lang": "en", "file": "gone.pdf", "gt": "{}"}]
    (tmp_path / "labels.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = {r.id: r.size for r in files.scan_labelled_corpus(spark, str(tmp_path)).collect()}
    assert got == {"1": 10, "2": None}
    assert files.scan_files(spark, str(tmp_path)).count() == 2


def test_catalog_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("d1", "p", 7), ("d2", "q", 8)], "id string, project_id string, size int")
    full = df.selectExpr("id", "project_id", "'s' sha256", "'f' filename", "'pdf' kind", "'m' media_type", "size", "null parent_id", "'{}' meta_json", "current_timestamp() created_at")
    catalog.write_table(full, str(tmp_path), "documents")
    back = catalog.scan_catalog(spark, str(tmp_path), ["documents"])["documents"]
    assert {(r.id, r.project_id, r.size) for r in back.collect()} == {("d1", "p", 7), ("d2", "q", 8)}
    plan = back.filter("project_id = 'p'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(project_id" in plan


def test_analysis_json(spark):
    body = {"scale": {"value": 50.0}, "north": None, "title_block": {"fields": {"project": {"value": "Villa"}}}, "tags": [{"tag": "K1"}, {"tag": "P2"}]}
    df = spark.createDataFrame([(json.dumps(body),), (None,)], "analysis_json string")
    parsed = catalog.parse_json_columns(df, {"analysis_json": catalog.ANALYSIS_SCHEMA})
    cols = catalog.analysis_columns(parsed["analysis_json"])
    r = parsed.select(*[c.alias(n) for n, c in cols.items()]).collect()
    assert (r[0].scale, r[0].north_deg, r[0].title, r[0].tags, r[0].analysed) == (50.0, None, {"project": "Villa"}, 2, True)
    assert r[1].tags == 0 and not r[1].analysed


def test_sheet_budget(spark):
    df = spark.createDataFrame([("a", "s", [["1", "2"], ["", None], []]), ("b", "s", [["1"] * 9])], "doc string, sheet string, rows array<array<string>>")
    cells, over = sheets.explode_sheet_cells(df, ["doc", "sheet"], max_cells=5)
    assert [(r.row_index, r.col_index, r.value) for r in cells.collect()] == [(0, 0, "1"), (0, 1, "2")]
    assert [(r.doc, r.cells) for r in over.collect()] == [("b", 9)]


def test_upsert_and_manifest(spark, tmp_path):
    t = spark.createDataFrame([("k1", "open", "a", "n1"), ("k2", "resolved", "b", "n2")], "id string, status string, payload string, note string")
    u = spark.createDataFrame([("k1", "open", "A", "x"), ("k2", "open", "B", "x"), ("k3", "open", "C", "x")], "id string, status string, payload string, note string")
    got = {r.id: (r.status, r.payload, r.note) for r in sinks.upsert(t, u, ["id"], ["payload"]).collect()}
    assert got == {"k1": ("open", "A", "n1"), "k2": ("resolved", "b", "n2"), "k3": ("open", "C", "x")}
    ref = "struct<sha256:string,size:bigint>"
    views = spark.createDataFrame([("r", "v1", *[("s", 1)] * 4)], f"run_id string, view_id string, delivered_png {ref}, delivered_jpg {ref}, base_png {ref}, camera_json {ref}")
    names = [n for n, _ in sinks.RUN_FILES]
    runs = spark.createDataFrame([("r", *[None if n == "blend_file" else ("s", 2) for n in names])], "run_id string, " + ", ".join(f"{n} {ref}" for n in names))
    sinks.write_bundle_manifest(views, runs, str(tmp_path / "m"))
    paths = [r.path for r in spark.read.json(str(tmp_path / "m")).collect()]
    assert len(paths) == 11 and "renders/v1.png" in paths and "base/v1_cycles.png" in paths and "model/scene.blend" not in paths


def test_licences(spark):
    exprs = ["MIT", "GPL-3.0 OR MIT", "MIT AND GPL-3.0", "(Apache-2.0 AND BSD-3-Clause) OR X", "Apache-2.0 WITH LLVM-exception", "Own", "BSD"]
    df = spark.createDataFrame([(i, e) for i, e in enumerate(exprs)], "i int, e string")
    assert [r[0] for r in df.orderBy("i").select(lic.allowed_expression(df.e)).collect()] == [True, True, False, True, True, False, True]
    p = spark.createDataFrame(
        [("PyMuPDF", "1", "MIT", "", [], "app"), ("nvidia-cu", "1", None, "NVIDIA Proprietary Software", [], "app"), ("tool", "1", "GPL-3.0-only", "", [], "sub"), ("x", "1", None, None, ["License :: OSI Approved :: ISC License (ISCL)"], "app")],
        "name string, version string, expression string, license string, classifiers array<string>, env string",
    )
    got = {r.name: (r.spdx, r.problem) for r in lic.spdx_audit(p, arms_length=["sub"]).collect()}
    assert got["PyMuPDF"][1] == "explicitly blocked" and got["nvidia-cu"] == ("LicenseRef-NVIDIA-CUDA-EULA", None)
    assert got["tool"] == ("GPL-3.0-only", None) and got["x"] == ("ISC", None)


def test_upsert_stream(spark, tmp_path):
    path, src = str(tmp_path / "t"), str(tmp_path / "in")
    schema = "project_id string, id string, status string, payload_json string"
    spark.createDataFrame([("p", "k1", "open", "a"), ("p", "k2", "resolved", "b"), ("q", "k3", "open", "c")], schema).write.partitionBy("project_id").parquet(path)
    new = [("p", "k1", "open", "A1", 1), ("p", "k1", "open", "A2", 2), ("p", "k2", "open", "B", 3), ("p", "k9", "open", "N", 4)]
    spark.createDataFrame(new, schema + ", arrival bigint").write.parquet(src)
    stream = spark.readStream.schema(schema + ", arrival bigint").parquet(src)
    sinks.upsert_stream(stream, path, "project_id", ["project_id", "id"], ["payload_json"], str(tmp_path / "ck")).awaitTermination(120)
    got = {(r.project_id, r.id): (r.status, r.payload_json) for r in spark.read.parquet(path).collect()}
    assert got == {("p", "k1"): ("open", "A2"), ("p", "k2"): ("resolved", "b"), ("p", "k9"): ("open", "N"), ("q", "k3"): ("open", "c")}
    fresh = str(tmp_path / "fresh")  # a first run has no table
    stream = spark.readStream.schema(schema + ", arrival bigint").parquet(src)
    sinks.upsert_stream(stream, fresh, "project_id", ["project_id", "id"], ["payload_json"], str(tmp_path / "ck2")).awaitTermination(120)
    assert {(r.id, r.payload_json) for r in spark.read.parquet(fresh).collect()} == {("k1", "A2"), ("k2", "B"), ("k9", "N")}


def test_large_files_are_hashed_in_pieces(spark, tmp_path, monkeypatch):
    import hashlib
    import os

    rng = random.Random(4)
    noise = bytes(rng.choices([10, 13, 0, 65, 255], k=50_000)) + os.urandom(70_000)
    given = {
        "noise.bin": noise, "lines.txt": b"line\n" * 9_000, "open.txt": b"line\n" * 9_000 + b"end", "two ends.txt": b"x" * 20_000 + b"\n\n\n",
        "mark.md": b"\xef\xbb\xbf# head\n" + b"y\n" * 9_000, "mark2.txt": b"\xef\xbb\xbf" + b"z" * 30_000, "p.pdf": b"%PDF-1.7\n" + noise, "one.bin": b"q" * 30_000,
        "packed.gz": gzip.compress(noise), "small.md": b"# t", "a{b}[c]*.txt": b"glob\n" * 9_000, "k=v/deep.txt": b"deep\r\n" * 9_000, "half.txt": b"a" * 8191 + "\u20ac".encode() * 4_000,
    }
    for name, data in given.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    monkeypatch.setattr(files, "PIECE", 1_000)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # a file is read by several tasks
    try:
        columns = ["filename", "size", "sha256", "kind", "accepted", "error_code"]
        want = sorted(map(str, files.sniff_files(files.scan_files(spark, str(tmp_path))).select(columns).collect()))
        heads = files.scan_files(spark, str(tmp_path), whole=False, pieces_from=10_000)
        assert sorted(map(str, files.sniff_files(heads).select(columns).collect())) == want and len(want) == len(given)
        for r in heads.collect():
            data = given[r.path.split(tmp_path.name + "/")[1]]
            assert (bytes(r.content), r.sha256, r.size) == (data[: files.HEAD + 1], hashlib.sha256(data).hexdigest(), len(data))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
