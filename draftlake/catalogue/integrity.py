"""DED operators on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.catalogue.registry import Tables, query
from draftlake.functions.text import SECRET_PATTERN
from draftlake.operators import integrity as op

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"


@query(
    "content_dedup",
    """
    SELECT doc_id, lang, min(doc_id) OVER (PARTITION BY lang, sha256(text)) AS document_id,
      doc_id <> min(doc_id) OVER (PARTITION BY lang, sha256(text)) AS deduplicated
    FROM documents
    """,
)
def content_dedup(t: Tables) -> DataFrame:
    """DED-1: the first document with the same text per language."""
    docs = t.documents.select(
        "doc_id", "lang", F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("arrival")
    )
    return op.dedupe_by_content(docs, scope=["lang"]).select("doc_id", "lang", "document_id", "deduplicated")


@query(
    "missing_sequence",
    """
    WITH u AS (SELECT l_orderkey AS upload_id, max(l_linenumber) AS n FROM lineitem GROUP BY 1)
    SELECT upload_id, i AS idx FROM u, generate_series(0, n - 1) g(i)
    WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = upload_id AND l.l_linenumber = i + 1)
    """,
)
def missing_sequence(t: Tables) -> DataFrame:
    """DED-2: line numbers missing below the highest one of each order."""
    uploads = t.lineitem.groupBy(F.col("l_orderkey").alias("upload_id")).agg(
        F.max("l_linenumber").cast("bigint").alias("size"), F.lit(1).cast("bigint").alias("chunk_size")
    )
    chunks = t.lineitem.select(
        F.col("l_orderkey").alias("upload_id"), (F.col("l_linenumber") - 1).cast("bigint").alias("idx")
    )
    return op.missing_chunks(uploads, chunks)


@query(
    "upload_progress",
    """
    WITH g AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS received FROM lineitem GROUP BY 1),
    e AS (SELECT o_orderkey, i FROM orders, generate_series(1, 7) s(i)),
    m AS (SELECT o_orderkey, count(*) AS missing FROM e
          WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = e.o_orderkey AND l.l_linenumber = e.i)
          GROUP BY 1)
    SELECT o_orderkey AS upload_id, coalesce(received, 0) AS received, coalesce(missing, 0) AS missing,
      coalesce(missing, 0) = 0 AS complete
    FROM orders LEFT JOIN g ON l_orderkey = o_orderkey LEFT JOIN m USING (o_orderkey)
    """,
)
def upload_progress(t: Tables) -> DataFrame:
    """DED-2: received and missing lines of every order, seven expected."""
    uploads = t.orders.select(
        F.col("o_orderkey").alias("upload_id"), F.lit(7).cast("bigint").alias("size"),
        F.lit(1).cast("bigint").alias("chunk_size"),
    )
    chunks = t.lineitem.select(
        F.col("l_orderkey").alias("upload_id"), (F.col("l_linenumber") - 1).cast("bigint").alias("idx")
    )
    return op.upload_status(uploads, chunks).select("upload_id", "received", "missing", "complete")


@query(
    "chunk_checks",
    """
    WITH j AS (SELECT l.*, l_linenumber - 1 AS idx, CASE
        WHEN o_orderkey IS NULL THEN 'unknown_upload'
        WHEN o_orderstatus = 'F' THEN 'not_open'
        WHEN l_linenumber - 1 >= 5 THEN 'index_out_of_range'
        WHEN l_quantity <> CASE WHEN l_linenumber - 1 < 4 THEN 10 ELSE 2 END THEN 'wrong_size'
        WHEN l_returnflag = 'N' THEN 'checksum_mismatch' END AS reason
      FROM lineitem l LEFT JOIN orders ON o_orderkey = l_orderkey),
    s AS (SELECT * FROM j WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY l_orderkey, idx
          ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1)
    SELECT reason, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM j WHERE reason IS NOT NULL GROUP BY 1
    UNION ALL SELECT 'stored', count(*), CAST(sum(l_partkey) AS BIGINT) FROM s
    """,
)
def chunk_checks(t: Tables) -> DataFrame:
    """DED-3: lines as chunks of an order of 42 units, 10 per chunk; last write per index wins."""
    uploads = t.orders.select(
        F.col("o_orderkey").alias("upload_id"), F.lit(42).cast("bigint").alias("size"),
        F.lit(10).cast("bigint").alias("chunk_size"),
        F.when(F.col("o_orderstatus") == "F", "complete").otherwise("open").alias("status"),
    )
    chunks = t.lineitem.select(
        F.col("l_orderkey").alias("upload_id"), (F.col("l_linenumber") - 1).cast("bigint").alias("idx"),
        F.col("l_quantity").cast("bigint").alias("size"), F.col("l_returnflag").alias("sha256"),
        F.when(F.col("l_returnflag") == "N", "x").otherwise(F.col("l_returnflag")).alias("actual_sha256"),
        F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice").alias("arrival"),
        F.col("l_partkey").alias("part"),
    )
    stored, refused = op.validate_chunks(uploads, chunks)
    totals = lambda d: d.agg(F.count(F.lit(1)).alias("n"), F.sum("part").alias("parts"))
    return totals(refused.groupBy("reason")).unionByName(totals(stored).withColumn("reason", F.lit("stored")))


@query(
    "chunk_reassembly",
    """
    SELECT conv_id AS upload_id, sha256(string_agg(text, '' ORDER BY turn)) AS actual_sha256,
      CAST(sum(octet_length(encode(text))) AS BIGINT) AS assembled_size, count(*) AS parts,
      count(*) = 1 AS verified
    FROM conversations GROUP BY conv_id
    """,
)
def chunk_reassembly(t: Tables) -> DataFrame:
    """DED-4: turns of a conversation joined in order; declared hash = that of the first turn."""
    c = t.conversations
    uploads = c.groupBy(F.col("conv_id").alias("upload_id")).agg(
        F.sha2(F.min_by("text", "turn"), 256).alias("sha256")
    )
    chunks = c.select(
        F.col("conv_id").alias("upload_id"), F.col("turn").alias("idx"), F.encode("text", "UTF-8").alias("data")
    )
    return op.assemble_chunks(uploads, chunks).drop("sha256")


@query(
    "archive_screen",
    """
    WITH e AS (SELECT source || '-' || lang AS archive_id, doc_id AS pos, lang || '/' || n_chars || '.txt' AS name,
        n_chars * 1024 AS file_size,
        (length(text) - length(replace(text, 'k', ''))) * 1024 AS compress_size FROM documents),
    j AS (SELECT *, compress_size > 0 AND file_size / compress_size > 100 AND file_size > 1048576 AS bad FROM e),
    a AS (SELECT archive_id, sum(file_size) AS d, sum(compress_size) AS p, count_if(bad) AS u FROM j GROUP BY 1),
    v AS (SELECT archive_id, (p > 0 AND d / p > 100 AND d > 10485760) AS r, u > 0 AS s FROM a),
    m AS (SELECT j.*, v.r OR v.s AS refused, min(pos) OVER (PARTITION BY j.archive_id, lower(name)) AS f
          FROM j JOIN v USING (archive_id))
    SELECT archive_id, CASE WHEN refused THEN 'refused' WHEN pos <> f THEN 'duplicate' ELSE 'kept' END AS status,
      count(*) AS n, CAST(sum(file_size) AS BIGINT) AS bytes FROM m GROUP BY ALL
    """,
)
def archive_screen(t: Tables) -> DataFrame:
    """DED-5: documents as entries of one archive per source and language."""
    entries = t.documents.select(
        F.concat_ws("-", "source", "lang").alias("archive_id"), F.col("doc_id").alias("pos"),
        F.concat("lang", F.lit("/"), "n_chars", F.lit(".txt")).alias("name"),
        (F.col("n_chars") * 1024).alias("file_size"),
        ((F.length("text") - F.length(F.replace("text", F.lit("k"), F.lit("")))) * 1024).cast("bigint").alias("compress_size"),
        F.lit(0).alias("mode"), F.lit(0).alias("flag_bits"), F.lit(1).alias("depth"),
    )
    _, judged = op.screen_archives(entries)
    return judged.groupBy("archive_id", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("bytes")
    )


@query(
    "blob_refs",
    """
    WITH missing AS (SELECT l_orderkey FROM lineitem
        WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 45))
    SELECT o_orderstatus, count(*) AS outputs,
      count_if(o_orderkey NOT IN (SELECT l_orderkey FROM missing)) AS usable
    FROM orders GROUP BY 1
    """,
)
def blob_refs(t: Tables) -> DataFrame:
    """DED-6: an order is reusable when every part it refers to is stored."""
    refs = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("sha256"))
    blobs = t.part.filter("p_size < 45").select(F.col("p_partkey").alias("sha256"))
    outputs = t.orders.select("o_orderkey", "o_orderstatus")
    ok = op.usable_outputs(outputs, refs, blobs, "o_orderkey").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("usable")
    )
    total = outputs.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("outputs"))
    return total.join(ok, "o_orderstatus", "left").fillna(0, ["usable"])


@query(
    "storage_usage",
    """
    WITH b AS (SELECT source, sha256(text) AS s, max(n_chars) AS size, count(*) AS n FROM documents GROUP BY 1, 2),
    u AS (SELECT source, CAST(sum(n) AS BIGINT) AS files, count(*) AS blobs, CAST(sum(size) AS BIGINT) AS stored_bytes,
      CAST(sum((n - 1) * size) AS BIGINT) AS reclaimable_bytes FROM b GROUP BY 1)
    SELECT u.*, CASE WHEN stored_bytes * 1048576 > 5368709120 THEN 'file_too_large'
      WHEN stored_bytes + stored_bytes * 1048576 > 53687091200 THEN 'project_full' END AS refused FROM u
    """,
)
def storage_usage(t: Tables) -> DataFrame:
    """DED-7: bytes stored once per distinct text and source, and a quota verdict."""
    blobs = t.documents.select("source", F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("size"))
    usage = op.storage_usage(blobs, project="source")
    new = usage.select("source", (F.col("stored_bytes") * 1048576).alias("size"))
    verdict = op.quota_check(new, usage, project="source").select("source", "refused")
    return usage.join(verdict, "source")


@query(
    "fingerprints",
    """
    WITH f AS (SELECT p_partkey, sha256('{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_size":' || p_size
      || ',"p_type":"' || p_type || '"}') AS fingerprint FROM part)
    SELECT fingerprint, count(*) AS n, max(p_partkey) AS newest FROM f GROUP BY 1
    """,
)
def fingerprints(t: Tables) -> DataFrame:
    """DED-8: parts with equal content apart from key and price."""
    f = op.content_fingerprint(t.part, exclude=["p_partkey", "p_retailprice"])
    return f.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.max("p_partkey").alias("newest"))


@query(
    "purge_children",
    """
    WITH gone AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0
        AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 250000)),
    dead AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT k FROM gone))
    SELECT 'job_events' AS table_name, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM dead)
    UNION ALL SELECT 'jobs', count(*) FROM orders WHERE o_custkey NOT IN (SELECT k FROM gone)
    UNION ALL SELECT 'tombstones', count(*) FROM gone
    UNION ALL SELECT 'refused', count(*) FROM customer WHERE c_acctbal < 0 AND c_custkey NOT IN (SELECT k FROM gone)
    """,
)
def purge_children(t: Tables) -> DataFrame:
    """DED-9: customers in debt purged with orders and lines, unless an order is running."""
    running = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 250000)
    tables = {
        "projects": t.customer.select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
            F.lit("{}").alias("meta_json"), F.lit(None).cast("timestamp").alias("purged_at"),
        ),
        "jobs": t.orders.select(
            F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("id"),
            F.when(running, "running").otherwise("succeeded").alias("status"),
        ),
        "job_events": t.lineitem.select(F.col("l_orderkey").alias("job_id")),
    }
    ids = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("project_id"))
    left, refused = op.purge_project(tables, ids)
    count = lambda d, n: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n")
    return (
        count(left["job_events"], "job_events")
        .unionByName(count(left["jobs"], "jobs"))
        .unionByName(count(left["projects"].filter("name = '[purged]'"), "tombstones"))
        .unionByName(count(refused, "refused"))
    )


@query(
    "pinned_files",
    """
    WITH f AS (SELECT l_orderkey, min(l_linestatus) AS s FROM lineitem GROUP BY 1),
    j AS (SELECT o_custkey AS model, CASE WHEN s IS NULL THEN 'missing'
        WHEN CASE o_orderstatus WHEN 'P' THEN NULL ELSE o_orderstatus END <> s THEN 'mismatch' ELSE 'ok' END AS st
      FROM orders LEFT JOIN f ON l_orderkey = o_orderkey)
    SELECT model, count_if(st <> 'ok') AS bad_files, count_if(st <> 'ok') = 0 AS ok,
      CASE WHEN count_if(st <> 'ok') = 0 THEN 'installed' ELSE 'failed' END AS outcome FROM j GROUP BY model
    """,
)
def pinned_files(t: Tables) -> DataFrame:
    """DED-10: orders as pinned files of a customer, lines as what is on disk."""
    pinned = t.orders.select(
        F.col("o_custkey").alias("model"), F.col("o_orderkey").alias("path"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("sha256"),
        F.lit("r1").alias("revision"),
    )
    disk = t.lineitem.groupBy(F.col("l_orderkey").alias("path")).agg(F.min("l_linestatus").alias("sha256"))
    owner = t.orders.select(F.col("o_custkey").alias("model"), F.col("o_orderkey").alias("path"))
    files = disk.join(owner, "path")
    return op.verify_manifest(files, pinned)[1].drop("revision")


@query(
    "redacted_text",
    rf"""
    WITH p AS (SELECT source, text, regexp_extract_all(text, '{SECRET_PATTERN}|{EMAIL}') AS hits,
        regexp_replace(text, '{SECRET_PATTERN}|{EMAIL}', '[REDACTED]', 'g') AS clean FROM documents)
    SELECT source, CAST(sum(len(hits)) AS BIGINT) AS redactions, count_if(len(hits) > 0) AS documents,
      CAST(sum(length(clean)) AS BIGINT) AS chars, min(sha256(clean)) AS first_hash FROM p GROUP BY source
    """,
)
def redacted_text(t: Tables) -> DataFrame:
    """DED-11: secrets and addresses replaced over whole texts, totals per source."""
    r = op.redact_secrets(t.spread("documents").select("source", "text"), ["text"], f"{SECRET_PATTERN}|{EMAIL}")
    return r.groupBy("source").agg(
        F.sum("redactions").alias("redactions"),
        F.count_if(F.col("redactions") > 0).alias("documents"),
        F.sum(F.length("text")).alias("chars"),
        F.min(F.sha2("text", 256)).alias("first_hash"),
    )


@query(
    "reused_versions",
    """
    WITH v AS (SELECT p_size AS project, p_partkey AS id, p_partkey % 7 AS number, p_brand || p_type AS content, p_partkey % 3 > 0 AS kept FROM part),
    s AS (SELECT project, content, max(number * 1000000000 + id) % 1000000000 AS version FROM v WHERE kept GROUP BY ALL)
    SELECT v.id AS part, s.version FROM v LEFT JOIN s ON s.project = v.project AND s.content = v.content WHERE NOT kept
    """,
)
def reused_versions(t: Tables) -> DataFrame:
    """DED-8: new parts meet the newest stored one of equal brand and type in their size class."""
    f = op.content_fingerprint(t.part.select("p_brand", "p_type", "p_partkey", "p_size"), exclude=["p_partkey", "p_size"], name="plan_sha256")
    rows = f.select(F.col("p_size").alias("project_id"), "plan_sha256", F.col("p_partkey").alias("id"), F.struct(F.col("p_partkey") % 7, "p_partkey").alias("number"))
    stored = rows.filter("id % 3 > 0").withColumn("origin", F.lit("extraction"))
    return op.reuse_versions(rows.filter("id % 3 = 0").select("project_id", "plan_sha256", "id"), stored).select(F.col("id").alias("part"), F.col("version_id").alias("version"))
