"""SRC and SNK operators on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.catalogue.registry import Tables, query
from draftlake.sources.catalog import parse_json_columns, table_counts
from draftlake.sources.files import join_manifest, kind_totals, scan_files, sniff_files
from draftlake.sources.sheets import explode_sheet_cells
from draftlake.sources.sinks import bundle_manifest, license_report, upsert

GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@query("scans")
def scans(t: Tables) -> DataFrame:
    """SRC-1, SRC-2: the table files themselves as bytes: type, size, hash."""
    files = sniff_files(scan_files(t.spark, t.folder, whole=False))
    return files.select(
        "filename", "size", "sha256", "kind", "accepted", "error_code",
        F.hex(F.substring("content", 1, 4)).alias("magic"),
    )


@query(
    "sniffed_text",
    """
    WITH f AS (SELECT text AS body FROM documents UNION ALL SELECT html FROM pages),
    b AS (SELECT body, regexp_replace(body, '^\\s+', '') AS s FROM f),
    k AS (SELECT CASE
        WHEN s LIKE '%PDF-%' AND starts_with(s, '%PDF-') THEN 'pdf'
        WHEN starts_with(body, 'PK') THEN 'zip'
        WHEN lower(substr(s, 1, 512)) LIKE '<?xml%' OR lower(substr(s, 1, 512)) LIKE '<svg%'
          THEN CASE WHEN contains(lower(substr(s, 1, 4096)), '<svg') THEN 'svg' ELSE 'xml' END
        WHEN starts_with(s, '#') THEN 'md' ELSE 'txt' END AS kind,
        octet_length(encode(body)) AS size FROM b)
    SELECT kind, true AS accepted, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes
    FROM k GROUP BY kind
    """,
)
def sniffed_text(t: Tables) -> DataFrame:
    """SRC-2: every document and page as a file."""
    bodies = t.documents.select(F.col("text").alias("body")).unionAll(t.pages.select("html"))
    files = bodies.select(
        F.encode("body", "UTF-8").alias("content"), F.lit("x.txt").alias("filename")
    ).withColumn("size", F.length("content").cast("bigint"))
    return kind_totals(sniff_files(files))


@query(
    "catalog_counts",
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in GIVEN),
)
def catalog_counts(t: Tables) -> DataFrame:
    """SRC-4: rows per table."""
    return table_counts({n: getattr(t, n) for n in GIVEN})


@query(
    "manifest_join",
    """
    SELECT 'doc-' || l.doc_id || '.txt' AS file, CAST(l.quality AS VARCHAR) AS class,
      d.source, d.lang, d.n_chars AS size, sha256(d.text) AS sha256
    FROM labels l LEFT JOIN documents d USING (doc_id)
    """,
)
def manifest_join(t: Tables) -> DataFrame:
    """SRC-3: labelled manifest lines with the files they name."""
    name = lambda c: F.concat(F.lit("doc-"), F.col(c), F.lit(".txt"))
    manifest = t.labels.select(name("doc_id").alias("file"), F.col("quality").cast("string").alias("class"))
    docs = t.documents.withColumn("filename", name("doc_id"))
    files = docs.select(
        "filename", F.concat_ws("/", "source", "lang").alias("path"),
        F.col("n_chars").alias("size"), F.sha2("text", 256).alias("sha256"),
    )
    out = join_manifest(manifest, files)
    return out.select(
        "file", "class", F.split_part("path", F.lit("/"), F.lit(1)).alias("source"),
        F.split_part("path", F.lit("/"), F.lit(2)).alias("lang"), "size", "sha256",
    )


@query(
    "json_columns",
    """
    SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n,
      min(event_id) AS first_event
    FROM events GROUP BY ALL
    """,
)
def json_columns(t: Tables) -> DataFrame:
    """SRC-5: typed JSON column, projected and grouped."""
    e = parse_json_columns(t.events.select("event_id", "event_type", "props"), {"props": "k bigint"})
    return e.groupBy("event_type", F.col("props.k").alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event")
    )


@query(
    "sheet_cells",
    """
    WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS r FROM documents),
    k AS (SELECT l.*, max(CASE WHEN line <> '' THEN r END) OVER (PARTITION BY doc_id) AS last FROM l),
    c AS (SELECT doc_id, r - 1 AS row_index, string_split(line, ' ') AS cells FROM k WHERE r <= last)
    SELECT doc_id, count(*) AS n_rows, CAST(sum(len(cells)) AS BIGINT) AS n_cells,
      CAST(max(len(cells)) AS BIGINT) AS widest, CAST(NULL AS VARCHAR) AS error_code FROM c GROUP BY doc_id
    """,
)
def sheet_cells(t: Tables) -> DataFrame:
    """SRC-6: lines × words of each document as a cell grid; documents over the limit are reported."""
    grid = F.transform(F.split("text", "\n"), lambda line: F.split(line, " "))
    cells, refused = explode_sheet_cells(t.documents.select("doc_id", grid.alias("rows")), ["doc_id"])
    per_row = cells.groupBy("doc_id", "row_index").agg(F.count(F.lit(1)).alias("w"))
    kept = per_row.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("w").alias("n_cells"), F.max("w").alias("widest"), F.lit(None).cast("string").alias("error_code")
    )
    none = F.lit(None).cast("bigint")
    over = refused.select("doc_id", none.alias("n_rows"), F.col("cells").alias("n_cells"), none.alias("widest"), "error_code")
    return kept.unionByName(over)


@query(
    "delivery_manifest",
    """
    WITH v AS (SELECT o_custkey AS run_id, o_orderkey AS k, o_totalprice AS p FROM orders),
    f AS (
      SELECT run_id, 'renders' AS folder, k FROM v UNION ALL SELECT run_id, 'renders', k FROM v
      UNION ALL SELECT run_id, 'base', k FROM v UNION ALL SELECT run_id, 'cameras', k FROM v
      UNION ALL SELECT c_custkey, 'model', c_custkey FROM customer
      UNION ALL SELECT c_custkey, 'plan', c_custkey FROM customer WHERE c_acctbal >= 0
      UNION ALL SELECT c_custkey, 'qa', c_custkey FROM customer)
    SELECT run_id, folder, count(*) AS files, CAST(sum(k) AS BIGINT) AS bytes FROM f GROUP BY ALL
    """,
)
def delivery_manifest(t: Tables) -> DataFrame:
    """SNK-1: orders as views of a customer's run: files and bytes per folder of the manifest."""
    blob = lambda k, end: F.struct(
        F.sha2(F.concat(F.col(k).cast("string"), F.lit(end)), 256).alias("sha256"),
        F.col(k).alias("size"),
    )
    none = F.lit(None).cast("struct<sha256:string,size:bigint>")
    views = t.orders.select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderkey").cast("string").alias("view_id"),
        *[blob("o_orderkey", e).alias(c) for c, e in
          [("delivered_png", "p"), ("delivered_jpg", "j"), ("base_png", "b"), ("camera_json", "c")]],
    )
    runs = t.customer.select(
        F.col("c_custkey").alias("run_id"),
        blob("c_custkey", "g").alias("glb"),
        none.alias("blend_file"),
        F.when(F.col("c_acctbal") >= 0, blob("c_custkey", "p")).alias("plan_json"),
        none.alias("scene_manifest"), none.alias("run_manifest"), none.alias("view_outcomes"),
        blob("c_custkey", "q").alias("qa_report"), none.alias("readme"),
    )
    m = bundle_manifest(views, runs)
    return m.groupBy("run_id", F.split_part("path", F.lit("/"), F.lit(1)).alias("folder")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")
    )


@query(
    "licence_report",
    """
    SELECT p_brand AS env, 'part-' || p_partkey AS name, p_type AS version,
      CASE WHEN p_size > 40 THEN 'UNKNOWN' ELSE 'MIT' END AS spdx,
      CASE WHEN p_size > 40 THEN 'licence unknown' END AS problem
    FROM part
    """,
)
def licence_report(t: Tables) -> DataFrame:
    """SNK-2: parts as packages of an environment, sorted."""
    unknown = F.col("p_size") > 40
    packages = t.part.select(
        F.lit("package").alias("kind"), F.col("p_brand").alias("env"),
        F.concat(F.lit("part-"), F.col("p_partkey")).alias("name"), F.col("p_type").alias("version"),
        F.when(unknown, "UNKNOWN").otherwise("MIT").alias("spdx"),
        F.when(unknown, "licence unknown").alias("problem"),
    )
    models = packages.select(
        "name", F.col("spdx").alias("license_id"), F.lit("a").alias("license_class"),
        F.array("problem").alias("reasons"), F.array("env").alias("used_by"),
    )
    return license_report(packages, models)["packages"]


@query(
    "upsert_open",
    """
    WITH u AS (SELECT l_orderkey AS id, CAST(sum(l_quantity) AS BIGINT) AS payload
               FROM lineitem GROUP BY l_orderkey),
    t AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'open' ELSE 'resolved' END AS status,
          CAST(-1 AS BIGINT) AS payload FROM orders)
    SELECT coalesce(t.id, u.id) AS id, CASE WHEN t.id IS NULL THEN 'open' ELSE t.status END AS status,
      CASE WHEN t.id IS NULL THEN u.payload WHEN u.id IS NOT NULL AND t.status = 'open' THEN u.payload
           ELSE t.payload END AS payload
    FROM t FULL OUTER JOIN u ON t.id = u.id
    """,
)
def upsert_open(t: Tables) -> DataFrame:
    """SNK-3: new payloads only reach rows that are still open."""
    target = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "O", "open").otherwise("resolved").alias("status"),
        F.lit(-1).cast("bigint").alias("payload"),
    )
    updates = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.sum("l_quantity").cast("bigint").alias("payload")
    ).withColumn("status", F.lit("open"))
    return upsert(target, updates, ["id"], ["payload"])
