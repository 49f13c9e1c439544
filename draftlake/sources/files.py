"""File scans: bytes, hashes, content types, labelled corpora."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD = 8192

# Leading bytes of each kind as alternatives of (place, bytes) pairs, first match wins;
# media types per kind.
MAGIC = [
    ("pdf", [[(0, b"%PDF-")]], "application/pdf"),
    ("png", [[(0, b"\x89PNG")]], "image/png"),
    ("jpeg", [[(0, b"\xff\xd8\xff")]], "image/jpeg"),
    ("webp", [[(0, b"RIFF"), (8, b"WEBP")]], "image/webp"),
    ("tiff", [[(0, b"II*\0")], [(0, b"MM\0*")]], "image/tiff"),
    ("heic", [[(4, b"ftyp" + brand)] for brand in (b"heic", b"heix", b"mif1", b"msf1", b"heim", b"heis", b"hevc")], "image/heic"),
    ("zip", [[(0, b"PK")]], "application/zip"),
    ("dwg", [[(0, b"AC10")], [(0, b"AC1.40")], [(0, b"AC1.50")], [(0, b"AC2.10")]], "image/vnd.dwg"),
    ("ifc", [[(0, b"ISO-10303-21")]], "application/x-step"),
    ("dxf", [[(0, b"AutoCAD Binary DXF")]], "image/vnd.dxf"),
    ("3dm", [[(0, b"3D Geometry File Format")]], "model/vnd.3dm"),
]
OLE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
REVIT_MARKS = ("BasicFileInfo".encode("utf-16-le"), b"Revit")
SKETCHUP_HEAD = b"\xff\xfe\xff\x0eSketchUp Model"
SKETCHUP_WIDE = "SketchUp".encode("utf-16-le")
MEDIA_TYPES = {
    **{k: m for k, _, m in MAGIC},
    "rvt": "application/vnd.autodesk.revit",
    "ole": "application/x-ole-storage",
    "skp": "application/vnd.sketchup.skp",
    "svg": "image/svg+xml",
    "xml": "application/xml",
    "md": "text/markdown",
    "txt": "text/plain",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "docm": "application/vnd.ms-word.document.macroEnabled.12",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xlsm": "application/vnd.ms-excel.sheet.macroEnabled.12",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "pptm": "application/vnd.ms-powerpoint.presentation.macroEnabled.12",
}
SUPPORTED = [
    "pdf", "dxf", "dwg", "ifc", "svg", "3dm", "png", "jpeg", "webp", "tiff", "heic", "zip",
    "docx", "xlsx", "xlsm", "pptx", "txt", "md",
]
NATIVE = ["rvt", "skp"]


#: A binary value holds at most this many bytes; larger files are listed without content.
MOST_BYTES = (1 << 31) - 1024


#: Larger files are read in pieces where only their head is wanted; lines are put together to so many bytes.
PIECES_FROM, PIECE = 64 << 20, 1 << 18
# Endings by which Spark's text reader unpacks a file instead of giving its bytes.
UNPACKED = ["gz", "bz2", "deflate", "snappy", "lz4", "zst", "passthrough"]


def scan_files(spark: SparkSession, root: str, hashed: bool = True, whole: bool = True, pieces_from: int = PIECES_FROM) -> DataFrame:
    """Every file below ``root``: path, name, size, content and SHA-256. Without ``hashed`` the
    content column can be pruned, so a listing does not read bytes.

    A file too large for one binary value is listed with null content and null hash instead of
    failing the scan; its bytes are hashed where it arrives, from the parts of its upload
    (``integrity.assemble_chunks``).

    Without ``whole`` the content is the head of the file, one byte more than its kind is told from, and a
    file over ``pieces_from`` bytes, of whatever size, is hashed in pieces. Packed files (``UNPACKED``) are
    still one value."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    named = lambda df: df.withColumnRenamed("length", "size").withColumn("filename", F.element_at(F.split("path", "/"), -1))

    def as_values(files: DataFrame) -> DataFrame:
        small = files.filter(F.col("length") <= MOST_BYTES)
        large = files.drop("content").filter(F.col("length") > MOST_BYTES).withColumn("content", F.lit(None).cast("binary"))
        df = named(small.unionByName(large))
        return df.withColumn("sha256", F.sha2("content", 256)) if hashed else df

    if whole:
        return as_values(read.load(root))
    # the length is judged before bytes are read, an ending when files are listed
    ending = f"[.]({'|'.join(UNPACKED)})$"
    some = as_values(read.load(root).filter(F.col("length") <= pieces_from))
    some = some.unionByName(as_values(read.option("pathGlobFilter", f"*.{{{','.join(UNPACKED)}}}").load(root).filter(F.col("length") > pieces_from)))
    some = some.withColumn("content", F.substring("content", 1, HEAD + 1))
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    far = named(plain.select("path", "modificationTime", "length", F.col("_metadata.file_path").alias("__file")))
    far = far.filter((F.col("size") > pieces_from) & ~F.col("path").rlike(ending))
    found = _piece_digests(spark, root, pieces_from, ending)
    return some.unionByName(far.join(found, "__file", "left").select(*[c for c in some.columns]))


def _piece_digests(spark: SparkSession, root: str, pieces_from: int, ending: str) -> DataFrame:
    """(__file, content, sha256) of large files: the head and the hash of all bytes. Tasks read parts of a
    file as lines ended by a line feed, whose bytes are left as they are; the parts are hashed in order in
    one task per file, which holds a hash state and no bytes."""
    text = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(root)
    at = "_metadata.file_{}".format
    lines = text.select(
        F.col(at("path")).alias("__file"), F.col(at("size")).alias("size"), F.col(at("block_start")).alias("start"), F.col("value").cast("binary").alias("line"),
    ).filter((F.col(at("size")) > pieces_from) & ~F.col(at("path")).rlike(ending))
    pieces = lines.mapInArrow(_pieces, "__file string, size bigint, start bigint, no bigint, data binary")
    ordered = pieces.repartition("__file").sortWithinPartitions("__file", "start", "no")
    return ordered.mapInArrow(_file_digests, "__file string, content binary, sha256 string")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one part of a file, each with its line feed, put together to pieces."""
    names = ["__file", "size", "start", "no", "data"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    key, held, size, no = None, [], 0, 0

    def piece() -> pa.RecordBatch:
        values = [*key, no, b"\n".join(held) + b"\n"]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    for batch in batches:
        file, total, start, line = (batch.column(i).to_pylist() for i in range(4))
        for k, data in zip(zip(file, total, start), line):
            if held and (k != key or size >= PIECE):
                yield piece()
                held, size, no = [], 0, no + 1
            if k != key:
                key, no = k, 0
            held.append(data)
            size += len(data) + 1
    if held:
        yield piece()


def _file_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Head and digest per file of an ordered partition. The reader drops a mark of the byte order and does
    not tell whether the last line has a line feed; the size of the file does."""
    mark, current, size = b"\xef\xbb\xbf", None, 0
    plain = marked = None
    head, seen = b"", 0

    def result() -> pa.RecordBatch:
        more, digest, first = size - seen, None, None
        for state, front in ((plain, b""), (marked, mark)):
            if more - len(front) in (0, -1):
                if more == len(front):
                    state.update(b"\n")
                digest, first = state.hexdigest(), (front + head)[: min(HEAD + 1, size)]
        columns = [pa.array([current], pa.string()), pa.array([first], pa.binary()), pa.array([digest], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["__file", "content", "sha256"])

    for batch in batches:
        pieces = batch.column(4)
        for file, n, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), range(batch.num_rows)):
            data = memoryview(pieces[k].as_buffer())  # the bytes stay in the batch
            if file != current:
                if current is not None:
                    yield result()
                current, size, head, seen = file, n, b"", 0
                plain, marked = hashlib.sha256(), hashlib.sha256(mark)
            body = data[:-1]  # the last line feed waits for the next piece
            for state in (plain, marked):
                if seen:
                    state.update(b"\n")
                state.update(body)
            if len(head) <= HEAD:
                head += bytes(data[: HEAD + 1 - len(head)])
            seen += len(data)
    if current is not None:
        yield result()


def _at(head: Column, place: int, mark: bytes) -> Column:
    """Whether the bytes stand at a place of a head given as hex text."""
    return F.substring(head, 2 * place + 1, 2 * len(mark)) == mark.hex().upper()


def _within(head: Column, mark: bytes) -> Column:
    """Whether the bytes stand anywhere in a head given as hex text; a byte is two digits."""
    return head.rlike(f"^(..)*{mark.hex().upper()}")


def _text_kind(content: Column, filename: Column) -> Column:
    """dxf / svg / xml / md / txt for UTF-8 heads; null for other bytes."""
    raw = F.substring(content, 1, HEAD)
    # a head may end inside a character: up to three trailing bytes of a longer file are ignored
    valid, text = F.is_valid_utf8(raw.cast("string")), raw.cast("string")
    for cut in (1, 2, 3):
        shorter = F.substring(content, 1, HEAD - cut).cast("string")
        valid = valid | ((F.length(content) > HEAD) & F.is_valid_utf8(shorter))
    body = F.regexp_replace(F.regexp_replace(text, "^﻿+", ""), r"^\s+", "")
    start = F.lower(F.substring(body, 1, 512))
    group_code = (
        body.startswith("0\n")
        | body.startswith("0\r\n")
        | F.regexp_replace(F.substring(text, 1, 40), "\r", "").startswith("  0\nSECTION")
    )
    markup = start.startswith("<?xml") | start.startswith("<svg")
    return F.when(
        valid,
        F.when(group_code & F.contains(F.substring(body, 1, 200), F.lit("SECTION")), "dxf")
        .when(markup & F.contains(F.lower(F.substring(body, 1, 4096)), F.lit("<svg")), "svg")
        .when(markup, "xml")
        .when(body.startswith("#") | F.lower(filename).endswith(".md"), "md")
        .otherwise("txt"),
    )


def container_kind(names: Column) -> Column:
    """Kind of a ZIP container from the names of its entries."""

    def holds(folder: str) -> Column:
        return F.exists(names, lambda n: n.startswith(f"{folder}/"))

    kind = F.lit("zip")
    office = F.array_contains(names, "[Content_Types].xml")
    for folder, plain, macro in (
        ("ppt", "pptx", "pptm"), ("xl", "xlsx", "xlsm"), ("word", "docx", "docm"),
    ):
        with_macro = F.array_contains(names, f"{folder}/vbaProject.bin")
        kind = F.when(office & holds(folder), F.when(with_macro, macro).otherwise(plain)).otherwise(kind)
    return kind


def media_type(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])[kind]


def sniff_files(
    files: DataFrame, content: str = "content", filename: str = "filename", names: str | None = None
) -> DataFrame:
    """Adds kind, media_type, accepted and error_code from the leading bytes; the name only tells
    Markdown from plain text. ``names`` is an optional array column of ZIP entry names."""
    head = F.hex(F.substring(F.col(content), 1, HEAD))
    kind = F.lit(None).cast("string")
    for k, choices, _ in MAGIC:
        found = reduce(or_, [reduce(and_, [_at(head, place, mark) for place, mark in marks]) for marks in choices])
        kind = F.coalesce(kind, F.when(found, k))
    revit = reduce(or_, [_within(head, mark) for mark in REVIT_MARKS])
    kind = F.coalesce(kind, F.when(_at(head, 0, OLE), F.when(revit, "rvt").otherwise("ole")))
    sketch = _at(head, 0, SKETCHUP_HEAD) | _within(F.substring(head, 1, 128), SKETCHUP_WIDE)
    kind = F.coalesce(kind, F.when(sketch, "skp"), _text_kind(F.col(content), F.col(filename)))
    if names is not None:
        kind = F.when((kind == "zip") & F.col(names).isNotNull(), container_kind(F.col(names))).otherwise(kind)
    out = files.withColumn("kind", kind)
    accepted = F.coalesce(F.col("kind").isin(SUPPORTED), F.lit(False))
    code = F.when(F.col("kind").isin(NATIVE), "unsupported_native").when(~accepted, "unsupported_type")
    return out.withColumns(
        {"media_type": media_type(F.col("kind")), "accepted": accepted, "error_code": code}
    )


def kind_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("kind", "accepted").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")
    )


CORPUS_SCHEMA = "id string, class string, source string, lang string, file string, gt string"


def join_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest lines joined with their files by name; a line without file keeps null bytes."""
    f = files.select(F.col("filename").alias("file"), "path", "size", "sha256")
    return manifest.join(f, "file", "left")


def scan_labelled_corpus(spark: SparkSession, root: str, manifest: str = "labels.jsonl") -> DataFrame:
    """Labelled corpus: JSON-lines manifest next to the data files."""
    lines = spark.read.schema(CORPUS_SCHEMA).json(f"{root}/{manifest}")
    files = scan_files(spark, root).filter(F.col("filename") != manifest)
    return join_manifest(lines, files)
