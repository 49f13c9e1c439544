"""The relational catalog: explicit schemas, typed reads and writes, JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Table and column names of the catalog.
TABLES = {
    "projects": "id string, name string, created_by string, created_at timestamp, latitude double, "
    "longitude double, timezone string, units string, meta_json string, purged_at timestamp",
    "project_members": "project_id string, user_id string, role string",
    "documents": "id string, project_id string, sha256 string, filename string, kind string, "
    "media_type string, size bigint, parent_id string, meta_json string, created_at timestamp",
    "uploads": "id string, project_id string, filename string, size bigint, sha256 string, "
    "chunk_size bigint, status string, created_by string, created_at timestamp, document_id string",
    "upload_chunks": "upload_id string, idx bigint, sha256 string, size bigint",
    "jobs": "id string, project_id string, kind string, queue string, status string, "
    "priority bigint, payload_json string, result_json string, error_json string, attempts bigint, "
    "max_attempts bigint, lease_owner string, lease_until double, heartbeat_at double, "
    "progress double, stage string, cancel_requested boolean, created_by string, "
    "created_at timestamp, started_at timestamp, finished_at timestamp",
    "job_events": "id bigint, job_id string, ts timestamp, type string, data_json string",
    "stage_runs": "cache_key string, project_id string, stage string, stage_version string, "
    "output_json string, manifest_json string, created_at timestamp, seconds double, "
    "vram_peak_mb double",
    "runs": "id string, project_id string, job_id string, config_json string, status string, "
    "result_json string, created_by string, created_at timestamp, plan_version string",
    "gates": "run_id string, gate string, status string, policy string, evidence_json string, "
    "decided_by string, decided_at timestamp, notes string",
    "bundles": "id string, project_id string, run_id string, job_id string, sha256 string, "
    "size bigint, status string, created_at timestamp",
    "audit_log": "id bigint, ts timestamp, user_id string, action string, target string, "
    "detail_json string, ip string",
    "pages": "id string, document_id string, project_id string, idx bigint, kind string, "
    "page_json string",
    "review_items": "id string, project_id string, kind string, subject_id string, status string, "
    "payload_json string, resolution_json string, created_at timestamp, resolved_by string, "
    "resolved_at timestamp",
    "page_analysis": "page_id string, project_id string, document_id string, label string, "
    "confidence double, needs_review boolean, override_label string, override_by string, "
    "analysis_json string, updated_at timestamp",
    "schedules": "id string, project_id string, source_page string, kind string, "
    "schedule_json string, updated_at timestamp",
    "plan_versions": "id string, project_id string, number bigint, parent_id string, "
    "root_id string, status string, origin string, plan_sha256 string, plan_ref_json string, "
    "issues_json string, extraction_json string, created_by string, created_at timestamp, "
    "approved_by string, approved_at timestamp",
    "plan_edits": "id string, project_id string, from_version string, to_version string, "
    "patch_json string, summary string, created_by string, created_at timestamp",
    "training_examples": "id string, project_id string, kind string, source_page string, "
    "plan_version string, payload_json string, training_use_allowed boolean, created_at timestamp",
}

ANALYSIS_SCHEMA = (
    "scale struct<value:double>, north struct<angle_deg:struct<value:double>>, "
    "title_block struct<fields:map<string,struct<value:string>>>, "
    "tags array<struct<tag:string,kind:string,bbox:array<double>,source:string>>, notes array<string>"
)
PAGE_SCHEMA = (
    "width_px double, height_px double, dpi double, meta map<string,string>, "
    "tiles array<struct<x:bigint,y:bigint,w:bigint,h:bigint>>"
)


def scan_catalog(spark: SparkSession, root: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Catalog tables under ``root`` with their declared schemas; project_id is a partition column
    where the table has one, so a project filter prunes folders."""
    return {
        n: spark.read.schema(TABLES[n]).parquet(f"{root}/{n}")
        for n in (names or list(TABLES))
    }


def write_table(df: DataFrame, root: str, name: str) -> None:
    """Appends to a catalog table; columns and types must match the declared ones."""
    spark = df.sparkSession
    want = spark.createDataFrame([], TABLES[name])
    typed = df.select(*[F.col(f.name).cast(f.dataType) for f in want.schema])
    w = typed.write.mode("append")
    w = w.partitionBy("project_id") if "project_id" in want.columns else w
    w.parquet(f"{root}/{name}")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
        for n, df in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def parse_json_columns(df: DataFrame, schemas: dict[str, str], strict: bool = False) -> DataFrame:
    """JSON text columns as typed structs. ``strict`` refuses malformed documents."""
    opts = {"mode": "FAILFAST"} if strict else {}
    return df.withColumns({c: F.from_json(F.col(c), s, opts) for c, s in schemas.items()})


def analysis_columns(analysis: Column) -> dict[str, Column]:
    """Null-safe projections of a parsed page analysis."""
    return {
        "scale": analysis["scale"]["value"],
        "north_deg": analysis["north"]["angle_deg"]["value"],
        "title": F.transform_values(analysis["title_block"]["fields"], lambda _, v: v["value"]),
        "tags": F.coalesce(F.size(analysis["tags"]), F.lit(0)).cast("bigint"),
        "analysed": analysis.isNotNull(),
    }
