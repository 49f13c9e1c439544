"""Sinks: delivery manifests, licence report, guarded upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.session import cut_lineage

# Folder layout of a delivered run, per view and per run.
VIEW_FILES = [
    ("delivered_png", "renders/", ".png"),
    ("delivered_jpg", "renders/", ".jpg"),
    ("base_png", "base/", "_cycles.png"),
    ("camera_json", "cameras/", ".json"),
]
RUN_FILES = [
    ("glb", "model/scene.glb"),
    ("blend_file", "model/scene.blend"),
    ("plan_json", "plan/plan.json"),
    ("scene_manifest", "manifests/scene_manifest.json"),
    ("run_manifest", "manifests/run_manifest.json"),
    ("view_outcomes", "qa/view_outcomes.json"),
    ("qa_report", "qa/qa_report.html"),
    ("readme", "README.txt"),
]


def bundle_manifest(views: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, path, sha256, size): one row per delivered file.

    ``views`` has run_id, view_id and one struct(sha256, size) per VIEW_FILES name; ``runs`` has
    run_id and one struct per RUN_FILES name (null where the file does not exist)."""
    per_view = views.select(
        "run_id",
        F.inline(
            F.array(*[
                F.struct(
                    F.concat(F.lit(folder), F.col("view_id"), F.lit(end)).alias("path"),
                    F.col(c)["sha256"].alias("sha256"), F.col(c)["size"].alias("size"),
                )
                for c, folder, end in VIEW_FILES
            ])
        ),
    )
    per_run = runs.select(
        "run_id",
        F.inline(
            F.array(*[
                F.struct(
                    F.lit(path).alias("path"),
                    F.col(c)["sha256"].alias("sha256"), F.col(c)["size"].alias("size"),
                )
                for c, path in RUN_FILES
            ])
        ),
    )
    return per_view.unionByName(per_run).filter(F.col("sha256").isNotNull())


def write_bundle_manifest(views: DataFrame, runs: DataFrame, out: str) -> None:
    """Manifest files, one folder per run, sorted by path inside each file. Rows of a run are
    range-split, so one run with many views does not fall on one task."""
    m = bundle_manifest(views, runs)
    m.repartitionByRange("run_id", "path").sortWithinPartitions("run_id", "path").write.mode(
        "overwrite"
    ).partitionBy("run_id").json(out)


def license_report(packages: DataFrame, models: DataFrame) -> dict[str, DataFrame]:
    """Sorted licence tables: models with status and users, tools, packages by environment."""
    users = F.array_join(F.array_sort(F.coalesce("used_by", F.array().cast("array<string>"))), ", ")
    return {
        "models": models.select(
            "name", "license_id", "license_class",
            F.when(F.size("reasons") == 0, "allowed").otherwise(F.array_join("reasons", "; ")).alias("status"),
            users.alias("used_by"),
        ).orderBy("name"),
        "tools": packages.filter("kind = 'tool'").select("name", "version", "spdx").orderBy("name"),
        "packages": packages.filter("kind = 'package'")
        .select("env", "name", "version", "spdx", "problem")
        .orderBy("env", "name"),
    }


def write_license_report(packages: DataFrame, models: DataFrame, out: str) -> None:
    for name, df in license_report(packages, models).items():
        df.write.mode("overwrite").option("header", "true").csv(f"{out}/{name}")


def upsert(
    target: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    overwrite: Sequence[str],
    guard_open: bool = True,
) -> DataFrame:
    """Target after an upsert: new keys are inserted; on a key conflict only ``overwrite`` columns
    change, and with ``guard_open`` only while the stored row's status is still open."""
    keys = list(keys)
    t = target.withColumn("__t", F.lit(True)).alias("t")
    u = updates.withColumn("__u", F.lit(True)).alias("u")
    joined = t.join(u, keys, "full_outer")
    taken = F.col("u.__u").isNotNull()
    if guard_open:
        taken = taken & (F.col("t.status") == "open")
    cols = []
    for c in target.columns:
        if c in keys:
            cols.append(F.col(c))
            continue
        new = F.col(f"u.{c}") if c in updates.columns else F.lit(None).cast(target.schema[c].dataType)
        kept = F.when(taken, new).otherwise(F.col(f"t.{c}")) if c in overwrite else F.col(f"t.{c}")
        cols.append(F.when(F.col("t.__t").isNull(), new).otherwise(kept).alias(c))
    return joined.select(*cols)


def upsert_open(target: DataFrame, updates: DataFrame, keys: Sequence[str], payload: Sequence[str] = ("payload_json",)) -> DataFrame:
    """Review items: insert, or overwrite the payload while the stored item is still open."""
    return upsert(target, updates, keys, payload, guard_open=True)


def upsert_stream(stream: DataFrame, path: str, by: str, keys: Sequence[str], payload: Sequence[str], checkpoint: str):
    """Guarded upsert of a stream of review items into a partitioned table, one writer. A micro-batch
    only reads and rewrites the partitions it touches; of several items with one key the last one
    (``arrival``) counts. The new partitions are checkpointed before they replace what was read. A
    first run begins with an empty table. A key belongs to one partition, so ``by`` is part of it."""
    if by not in keys:
        raise ValueError("the partition column is part of the key")
    schema = stream.drop("arrival").schema
    stream.sparkSession.createDataFrame([], schema).write.mode("append").partitionBy(by).parquet(path)

    def apply(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys]
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), "arrival").alias("u")).select(*keys, "u.*").drop("arrival")
        stored = spark.read.schema(schema).parquet(path).select(*schema.names)
        touched = stored.join(last.select(by).distinct(), by, "left_semi")
        rewrite_partitions(cut_lineage(upsert_open(touched, last, keys, payload)), path, by)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rewrite_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replaces only the partitions present in ``df`` (one writer per table)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
