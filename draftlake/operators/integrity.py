"""Integrity, deduplication and retention."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.functions.numeric import significant
from draftlake.functions.ordered import attach
from draftlake.functions.text import REDACTED, SECRET_PATTERN

# Intake limits.
MAX_UPLOAD_BYTES = 4 * 1024**3
MAX_PROJECT_BYTES = 50 * 1024**3
ZIP_MAX_ENTRIES = 10_000
ZIP_MAX_TOTAL = 20 * 1024**3
ZIP_MAX_RATIO = 100.0
ZIP_MAX_DEPTH = 3
ZIP_RATIO_FLOOR = 10 * 1024**2
ENTRY_RATIO_FLOOR = 1024**2
JUNK_NAMES = ["__MACOSX/", ".DS_Store", "Thumbs.db", "desktop.ini"]


def dedupe_by_content(
    docs: DataFrame,
    existing: DataFrame | None = None,
    scope: Sequence[str] = ("project_id",),
    sha: str = "sha256",
    doc_id: str = "doc_id",
    arrival: str = "arrival",
) -> DataFrame:
    """Adds ``document_id`` (first holder of the same content in the scope) and ``deduplicated``.

    The holder comes from a map-side combined minimum, so many copies of one text reach the
    shuffle as one row per task; the join back is many-to-one and is split by adaptive skew join.
    """
    keys = [*scope, sha]
    holder = docs.groupBy(*keys).agg(F.min_by(doc_id, F.struct(arrival, doc_id)).alias("__new"))
    if existing is not None:
        known = existing.groupBy(*keys).agg(F.min(doc_id).alias("__old"))
        holder = holder.join(known, keys, "left")
    else:
        holder = holder.withColumn("__old", F.lit(None).cast(docs.schema[doc_id].dataType))
    holder = holder.select(*keys, F.coalesce("__old", "__new").alias("document_id"), "__old")
    joined = attach(docs, holder, keys)
    repeat = F.col("__old").isNotNull() | (F.col(doc_id) != F.col("document_id"))
    return joined.withColumn("deduplicated", repeat).drop("__old")


def content_groups(docs: DataFrame, scope: Sequence[str], sha: str, doc_id: str) -> DataFrame:
    """First holder and number of copies per content; no join back."""
    return docs.groupBy(*scope, sha).agg(
        F.min(doc_id).alias("document_id"), F.count(F.lit(1)).alias("copies")
    )


def chunk_count(size: Column, chunk_size: Column) -> Column:
    return F.floor((size + chunk_size - 1) / chunk_size).cast("bigint")


def missing_chunks(uploads: DataFrame, chunks: DataFrame) -> DataFrame:
    """(upload_id, idx) expected by the declared size but not received."""
    n = chunk_count(F.col("size"), F.col("chunk_size"))
    wanted = uploads.filter(n > 0).select("upload_id", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("idx"))
    return wanted.join(chunks.select("upload_id", "idx"), ["upload_id", "idx"], "left_anti")


def upload_status(uploads: DataFrame, chunks: DataFrame) -> DataFrame:
    """Received and missing counts per upload; complete when nothing is missing."""
    got = chunks.groupBy("upload_id").agg(F.count_distinct("idx").alias("received"))
    lack = missing_chunks(uploads, chunks).groupBy("upload_id").agg(
        F.count(F.lit(1)).alias("missing"), F.min("idx").alias("first_missing")
    )
    return (
        uploads.withColumn("chunks", chunk_count(F.col("size"), F.col("chunk_size")))
        .join(got, "upload_id", "left")
        .join(lack, "upload_id", "left")
        .fillna(0, ["received", "missing"])
        .withColumn("complete", F.col("missing") == 0)
    )


def validate_chunks(uploads: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored, refused). Chunks need an open upload, an index in range, the exact size and the
    declared digest; the last valid write per index is stored."""
    u = uploads.select("upload_id", F.col("size").alias("u_size"), "chunk_size", "status")
    n = chunk_count(F.col("u_size"), F.col("chunk_size"))
    expected = F.when(F.col("idx") < n - 1, F.col("chunk_size")).otherwise(
        F.col("u_size") - F.col("chunk_size") * (n - 1)
    )
    has_bytes = "data" in chunks.columns
    size = F.length("data").cast("bigint") if has_bytes else F.col("size")
    digest = F.sha2("data", 256) if has_bytes else F.col("actual_sha256")
    reason = (
        F.when(F.col("status").isNull(), "unknown_upload")
        .when(F.col("status") != "open", "not_open")
        .when((F.col("idx") < 0) | (F.col("idx") >= n), "index_out_of_range")
        .when(size != expected, "wrong_size")
        .when(F.col("sha256").isNotNull() & (digest != F.col("sha256")), "checksum_mismatch")
    )
    judged = chunks.join(u, "upload_id", "left").withColumn("reason", reason)
    refused = judged.filter(F.col("reason").isNotNull()).select(*chunks.columns, "reason")
    # what a chunk or an upload alone decides is decided before they meet
    broken = (F.col("idx") < 0) | (F.col("sha256").isNotNull() & (digest != F.col("sha256")))
    fit = chunks.filter(~F.coalesce(broken, F.lit(False))).join(u.filter("status = 'open'"), "upload_id")
    good = fit.withColumn("reason", reason).filter(F.col("reason").isNull()).select(*chunks.columns)
    rest = [c for c in chunks.columns if c not in ("upload_id", "idx")]
    stored = (
        good.groupBy("upload_id", "idx")
        .agg(F.max_by(F.struct(*rest), F.col("arrival")).alias("s"))
        .select("upload_id", "idx", "s.*")
    )
    return stored, refused


def _running_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digest per run of equal upload_id in an ordered partition; holds one hash state, no bytes."""
    current, state, size, parts = None, None, 0, 0
    for pdf in batches:
        out = []
        for uid, data in zip(pdf["upload_id"], pdf["data"]):
            if state is None or uid != current:
                if state is not None:
                    out.append((current, state.hexdigest(), size, parts))
                current, state, size, parts = uid, hashlib.sha256(), 0, 0
            state.update(data)
            size += len(data)
            parts += 1
        if out:
            yield pd.DataFrame(out, columns=["upload_id", "actual_sha256", "assembled_size", "parts"])
    if state is not None:
        yield pd.DataFrame(
            [(current, state.hexdigest(), size, parts)],
            columns=["upload_id", "actual_sha256", "assembled_size", "parts"],
        )


def assemble_chunks(uploads: DataFrame, chunks: DataFrame) -> DataFrame:
    """Digest of each upload's parts in index order, compared with the declared one.

    Parts stream through the task in order; only a hash state stays in memory, so an upload of the
    maximum size needs no large row. SHA-256 is sequential, hence one task per upload.
    """
    key_type = chunks.schema["upload_id"].dataType.simpleString()
    ordered = (
        chunks.select("upload_id", "idx", "data")
        .repartition("upload_id")
        .sortWithinPartitions("upload_id", "idx")
    )
    digests = ordered.mapInPandas(
        _running_digests,
        f"upload_id {key_type}, actual_sha256 string, assembled_size bigint, parts bigint",
    )
    verdict = F.coalesce(F.col("actual_sha256") == F.col("sha256"), F.lit(False))
    return uploads.join(digests, "upload_id", "left").withColumn("verified", verdict)


def screen_archives(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(archives, entries) with verdicts over ZIP listings.

    An archive is refused for its totals or for any unsafe entry; of accepted archives, junk,
    folders and repeated names are skipped. Duplicate names keep the first entry (lowest ``pos``).
    """
    size, packed, mode = F.col("file_size"), F.col("compress_size"), F.col("mode")
    path = F.replace("name", F.lit("\\"), F.lit("/"))
    clean = F.array_join(F.filter(F.split(path, "/"), lambda p: (p != "") & (p != ".")), "/")
    file_type = mode.bitwiseAND(F.lit(0o170000))
    junk = F.lit(False)
    for j in JUNK_NAMES:
        junk = junk | F.contains("name", F.lit(j))
    folder = path.endswith("/") | (clean == "")
    skipped_early = folder | junk
    reasons = F.array_compact(
        F.array(
            F.when(file_type == 0o120000, "symlink"),
            F.when(file_type.isin(0o020000, 0o060000, 0o010000, 0o140000), "device"),
            F.when(path.startswith("/") | path.rlike("^.:"), "absolute_path"),
            F.when(F.array_contains(F.split(path, "/"), ".."), "parent_path"),
            F.when(F.contains(path, F.lit("\u0000")), "invalid_name"),
            F.when(~skipped_early & (F.col("flag_bits").bitwiseAND(F.lit(1)) == 1), "encrypted"),
            F.when(
                ~skipped_early & (packed > 0) & (size / packed > ZIP_MAX_RATIO) & (size > ENTRY_RATIO_FLOOR),
                "entry_ratio",
            ),
        )
    )
    judged = entries.withColumns(
        {"clean_name": clean, "key": F.lower(clean), "unsafe": reasons,
         "skip": F.when(folder, "folder").when(junk, "junk")}
    )
    totals = judged.groupBy("archive_id").agg(
        F.count(F.lit(1)).alias("entries"),
        F.sum("file_size").alias("declared"),
        F.sum("compress_size").alias("packed"),
        F.max("depth").alias("depth"),
        F.count_if(F.size("unsafe") > 0).alias("unsafe_entries"),
    )
    archive_reasons = F.array_compact(
        F.array(
            F.when(F.col("entries") > ZIP_MAX_ENTRIES, "too_many_entries"),
            F.when(F.col("declared") > ZIP_MAX_TOTAL, "too_large"),
            F.when(
                (F.col("packed") > 0)
                & (F.col("declared") / F.col("packed") > ZIP_MAX_RATIO)
                & (F.col("declared") > ZIP_RATIO_FLOOR),
                "archive_ratio",
            ),
            F.when(F.col("unsafe_entries") > 0, "unsafe_entry"),
        )
    )
    archives = totals.withColumn("reasons", archive_reasons).withColumns(
        {"too_deep": F.col("depth") > ZIP_MAX_DEPTH, "accepted": F.size("reasons") == 0}
    )
    live = judged.filter(F.col("skip").isNull())
    first = live.groupBy("archive_id", "key").agg(F.min("pos").alias("first_pos"))
    marked = judged.join(first, ["archive_id", "key"], "left").join(
        archives.select("archive_id", "accepted", "too_deep"), "archive_id"
    )
    status = (
        F.when(~F.col("accepted"), "refused")
        .when(F.col("too_deep"), "too_deep")
        .when(F.col("skip").isNotNull(), F.col("skip"))
        .when(F.col("pos") != F.col("first_pos"), "duplicate")
        .otherwise("kept")
    )
    return archives, marked.withColumn("status", status).select(
        *entries.columns, "clean_name", "unsafe", "status"
    )


def missing_blobs(refs: DataFrame, blobs: DataFrame) -> DataFrame:
    """Reference rows (owner, sha256) whose blob is not stored."""
    return refs.join(blobs.select("sha256"), "sha256", "left_anti")


def usable_outputs(outputs: DataFrame, refs: DataFrame, blobs: DataFrame, owner: str) -> DataFrame:
    """Outputs with no missing blob reference."""
    broken = missing_blobs(refs, blobs).select(owner).distinct()
    return outputs.join(broken, owner, "left_anti")


def storage_usage(
    blobs: DataFrame, project: str = "project_id", sha: str = "sha256", size: str = "size"
) -> DataFrame:
    """Bytes per project, stored once per distinct content, and what identical copies would cost."""
    once = blobs.groupBy(project, sha).agg(
        F.max(size).alias("__size"), F.count(F.lit(1)).alias("__n")
    )
    return once.groupBy(project).agg(
        F.sum("__n").alias("files"),
        F.count(F.lit(1)).alias("blobs"),
        F.sum("__size").alias("stored_bytes"),
        F.sum((F.col("__n") - 1) * F.col("__size")).alias("reclaimable_bytes"),
    )


def quota_check(new: DataFrame, usage: DataFrame, project: str = "project_id") -> DataFrame:
    """Reason an upload of ``size`` bytes would be refused, or null."""
    used = F.coalesce(F.col("stored_bytes"), F.lit(0))
    reason = (
        F.when(F.col("size") <= 0, "empty")
        .when(F.col("size") > MAX_UPLOAD_BYTES, "file_too_large")
        .when(used + F.col("size") > MAX_PROJECT_BYTES, "project_full")
    )
    return new.join(usage.select(project, "stored_bytes"), project, "left").withColumn("refused", reason)


def content_fingerprint(
    df: DataFrame, exclude: Sequence[str] = ("created_at", "version"), name: str = "fingerprint"
) -> DataFrame:
    """SHA-256 of the row as JSON with sorted names, without volatile columns, doubles at 12
    significant digits."""
    cols = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        if f.name in exclude:
            continue
        c = F.col(f.name)
        if f.dataType.typeName() in ("double", "float"):
            c = significant(c)
        cols.append(c.alias(f.name))
    text = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    return df.withColumn(name, F.sha2(text, 256))


def reuse_versions(new: DataFrame, versions: DataFrame) -> DataFrame:
    """Newest stored extraction version with the same fingerprint, null when content is new."""
    stored = (
        versions.filter(F.col("origin") == "extraction")
        .groupBy("project_id", "plan_sha256")
        .agg(F.max_by("id", "number").alias("version_id"))
    )
    return new.join(stored, ["project_id", "plan_sha256"], "left")


# Tables without project_id and the parent that has it.
CHILD_TABLES = {
    "gates": ("run_id", "runs"),
    "job_events": ("job_id", "jobs"),
    "upload_chunks": ("upload_id", "uploads"),
}
PURGED = [
    "bundles", "gates", "runs", "stage_runs", "job_events", "jobs", "upload_chunks", "uploads",
    "review_items", "schedules", "page_analysis", "pages", "documents", "project_members",
]


def purge_project(
    tables: dict[str, DataFrame], ids: DataFrame, now: Column | None = None
) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables after the purge, refused ids). ``ids`` has project_id; projects with a running job
    are refused; child tables are reached through their parent; the project row is tombstoned."""
    busy = tables["jobs"].filter(F.col("status") == "running").select("project_id").distinct()
    refused = ids.join(busy, "project_id", "left_semi")
    gone = ids.join(busy, "project_id", "left_anti").select("project_id").distinct()
    out = dict(tables)
    for name in PURGED:
        if name not in tables:
            continue
        if name in CHILD_TABLES:
            key, parent = CHILD_TABLES[name]
            dead = tables[parent].join(gone, "project_id", "left_semi").select(F.col("id").alias(key))
            out[name] = tables[name].join(dead, key, "left_anti")
        else:
            out[name] = tables[name].join(gone, "project_id", "left_anti")
    if "projects" in tables:
        mark = gone.select(F.col("project_id").alias("id"), F.lit(True).alias("__gone"))
        p = tables["projects"].join(mark, "id", "left")
        hit = F.coalesce("__gone", F.lit(False))
        out["projects"] = p.withColumns(
            {
                "name": F.when(hit, "[purged]").otherwise(F.col("name")),
                "meta_json": F.when(hit, "{}").otherwise(F.col("meta_json")),
                "purged_at": F.when(hit, now if now is not None else F.current_timestamp()).otherwise(F.col("purged_at")),
            }
        ).select(*tables["projects"].columns)
    return out, refused


def verify_manifest(files: DataFrame, pinned: DataFrame, installed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(per file, per model): pinned files must exist and match; a model whose revision is already
    recorded is not checked again."""
    f = files.select("model", "path", F.col("sha256").alias("actual"))
    status = (
        F.when(F.col("actual").isNull(), "missing")
        .when(F.col("sha256").isNotNull() & (F.col("sha256") != F.col("actual")), "mismatch")
        .otherwise("ok")
    )
    per_file = pinned.join(f, ["model", "path"], "left").withColumn("status", status)
    model = per_file.groupBy("model").agg(
        F.max("revision").alias("revision"),
        F.every(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") != "ok").alias("bad_files"),
    )
    if installed is not None:
        have = installed.select("model", F.col("revision").alias("have"))
        model = model.join(have, "model", "left")
    else:
        model = model.withColumn("have", F.lit(None).cast("string"))
    outcome = (
        F.when(F.col("have") == F.col("revision"), "already")
        .when(F.col("ok"), "installed")
        .otherwise("failed")
    )
    return per_file, model.withColumn("outcome", outcome).drop("have")


def redact_secrets(
    df: DataFrame, cols: Sequence[str], pattern: str = SECRET_PATTERN, mark: str = REDACTED
) -> DataFrame:
    """Secrets in text columns replaced by a mark; ``redactions`` counts them per row."""
    hits = F.lit(0).cast("bigint")
    for c in cols:
        hits = hits + F.coalesce(F.regexp_count(F.col(c), F.lit(pattern)), F.lit(0))
    out = df.withColumn("redactions", hits)
    return out.withColumns({c: F.regexp_replace(F.col(c), pattern, mark) for c in cols})
