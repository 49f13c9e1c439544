"""WIN operators on the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.functions.numeric import n_rows
from draftlake.catalogue.registry import Tables, query
from draftlake.operators import windows as op



def order_versions(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "superseded").when(F.col("o_orderstatus") == "P", "approved").otherwise("draft")
    return t.orders.select(
        F.col("o_custkey").alias("project_id"), F.substring("o_orderpriority", 1, 1).alias("root_id"),
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("number"), status.alias("status"),
    )


@query(
    "latest_per_key",
    """
    WITH v AS (SELECT o_custkey AS project_id, substr(o_orderpriority, 1, 1) AS root_id, o_orderkey AS id,
      CASE o_orderstatus WHEN 'F' THEN 'superseded' WHEN 'P' THEN 'approved' ELSE 'draft' END AS status FROM orders)
    SELECT 'latest' AS kind, project_id, NULL AS root_id, id, status FROM v WHERE status <> 'superseded' QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY id DESC) = 1
    UNION ALL SELECT 'head', project_id, root_id, id, status FROM v QUALIFY row_number() OVER (PARTITION BY project_id, root_id ORDER BY id DESC) = 1
    UNION ALL SELECT 'working', project_id, root_id, id, status FROM v QUALIFY row_number() OVER (PARTITION BY project_id, root_id ORDER BY status = 'approved' DESC, id DESC) = 1
    """,
)
def latest_per_key(t: Tables) -> DataFrame:
    """WIN-1: latest, head and working version of every customer."""
    v = order_versions(t)
    pick = lambda d, kind, root: d.select(F.lit(kind).alias("kind"), "project_id", root.alias("root_id"), "id", "status")
    return (
        pick(op.latest_version(v), "latest", F.lit(None).cast("string"))
        .unionByName(pick(op.head_version(v), "head", F.col("root_id")))
        .unionByName(pick(op.working_version(v), "working", F.col("root_id")))
    )


@query(
    "numbering",
    """
    WITH e AS (SELECT o_custkey, max(o_orderkey) AS top FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT n.o_orderkey AS k, n.o_custkey, coalesce(top, 0) + row_number() OVER (PARTITION BY n.o_custkey ORDER BY o_orderkey) AS number
    FROM orders n LEFT JOIN e ON e.o_custkey = n.o_custkey WHERE o_orderstatus <> 'F'
    """,
)
def numbering(t: Tables) -> DataFrame:
    """WIN-2: new orders of a customer numbered after the finished ones."""
    old = t.orders.filter("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("number"))
    new = t.orders.filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("k"), "o_custkey")
    return op.next_numbers(old, new, "o_custkey", "number", "k", F.floor(F.col("k") / 1024))


@query(
    "approved_versions",
    """
    WITH v AS (SELECT o_custkey AS project_id, o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'superseded' WHEN 'P' THEN 'approved' ELSE 'draft' END AS status FROM orders),
    a AS (SELECT o_custkey, max(o_orderkey) AS id FROM orders GROUP BY 1),
    bad AS (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 48), ok AS (SELECT * FROM a WHERE id NOT IN (SELECT l_orderkey FROM bad)),
    r AS (SELECT CASE WHEN v.id IN (SELECT id FROM ok) THEN 'approved' WHEN project_id IN (SELECT o_custkey FROM ok) AND status = 'approved' THEN 'superseded' ELSE status END AS status, * EXCLUDE (status) FROM v)
    SELECT status, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM r GROUP BY 1 UNION ALL SELECT 'refused', count(*), CAST(sum(id) AS BIGINT) FROM a WHERE id IN (SELECT l_orderkey FROM bad)
    """,
)
def approved_versions(t: Tables) -> DataFrame:
    """WIN-3: each customer's newest order approved, unless a large line blocks it."""
    v = order_versions(t).withColumns({"approved_by": F.lit(None).cast("string"), "approved_at": F.lit(None).cast("bigint")})
    approvals = t.orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("id")).select(
        "id", F.lit("user").alias("approved_by"), F.lit(1).cast("bigint").alias("approved_at")
    )
    issues = t.lineitem.select(
        F.col("l_orderkey").alias("version_id"), F.when(F.col("l_quantity") >= 48, "error").otherwise("warning").alias("severity")
    )
    out, refused = op.approve(v, approvals, issues)
    total = lambda d: d.agg(n_rows().alias("n"), F.sum("id").alias("ids"))
    return total(out.groupBy("status")).unionByName(total(refused).withColumn("status", F.lit("refused")))


@query(
    "validity_history",
    """
    SELECT o_orderkey, o_custkey, o_orderdate, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to,
      lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) IS NULL AS current FROM orders
    """,
)
def validity_history(t: Tables) -> DataFrame:
    """WIN-3: orders of a customer as consecutive validity periods."""
    return op.validity_history(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], "o_orderdate", "o_orderkey")


@query(
    "edit_lineage",
    """
    SELECT a.conv_id || '-' || a.turn AS version_id, CAST(a.turn - b.turn + 1 AS INTEGER) AS depth, b.conv_id || '/' || b.turn AS edit_id,
      b.conv_id || '-' || (b.turn - 1) AS from_version, b.conv_id || '-' || b.turn AS to_version
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn <= a.turn AND b.turn > 0 WHERE a.role = 'assistant'
    """,
)
def edit_lineage(t: Tables) -> DataFrame:
    """WIN-4: turns as edits; the chain of every assistant turn back to the first turn."""
    vid = lambda turn: F.concat("conv_id", F.lit("-"), turn)
    c = t.conversations
    versions = c.select(
        vid(F.col("turn")).alias("id"), vid(F.lit(0)).alias("root_id"),
        F.when(F.col("role") == "assistant", "approved").otherwise("draft").alias("status"),
    )
    edits = c.filter("turn > 0").select(
        vid(F.col("turn") - 1).alias("from_version"), vid(F.col("turn")).alias("to_version"), F.concat_ws("/", "conv_id", "turn").alias("edit_id")
    )
    return op.edit_lineage(versions, edits)


@query(
    "change_replay",
    """
    WITH o AS (SELECT user_id || '-' || coalesce(CAST(json_extract(props, '$.k') AS VARCHAR), '') AS entity, event_id AS seq, event_type AS t FROM events),
    s AS (SELECT *, last_value(CASE WHEN t = 'error' THEN -1 WHEN t <> 'signup' THEN seq END IGNORE NULLS) OVER (PARTITION BY entity ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v,
      last_value(CASE WHEN t = 'error' THEN -1 WHEN t <> 'signup' THEN seq END IGNORE NULLS) OVER (PARTITION BY entity ORDER BY seq) AS after FROM o),
    e AS (SELECT entity, min(CASE WHEN t IN ('signup', 'error') AND coalesce(v, -1) = -1 THEN seq END) AS refused_at, max_by(after, seq) AS v, max_by(v, seq) FILTER (t = 'signup') AS w FROM s GROUP BY entity)
    SELECT entity, refused_at, CASE WHEN refused_at IS NOT NULL THEN '{}' ELSE '{' || concat_ws(',', CASE WHEN v > 0 OR v = 0 THEN '"v":' || v END, CASE WHEN w IS NOT NULL THEN '"w":' || w END) || '}' END AS doc FROM e
    """,
)
def change_replay(t: Tables) -> DataFrame:
    """WIN-5: events as a change log per user and key: most set a member, a signup copies it, an error
    removes it; copying or removing an absent member refuses the log."""
    kind = F.when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "signup", "copy").otherwise("add")
    ops = t.events.select(
        F.concat_ws("-", "user_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))).alias("entity"), F.col("event_id").alias("seq"),
        kind.alias("op"), F.when(kind == "copy", "/w").otherwise("/v").alias("path"), F.when(kind == "copy", "/v").alias("from_path"),
        F.when(kind == "add", F.col("event_id").cast("string")).alias("value"),
    )
    base = ops.filter(F.lit(False)).select("entity", F.lit("{}").alias("doc"))
    state, refused = op.replay_changes(base, ops)
    return state.join(refused.withColumnRenamed("seq", "refused_at"), "entity", "left").select("entity", "refused_at", "doc")


@query(
    "best_source",
    """
    WITH r AS (SELECT doc_id, lang AS project_id, source AS level_name, n_chars AS walls, CASE WHEN n_chars > 6000 THEN 2 WHEN n_chars > 3000 THEN 3 ELSE 4 END AS rk FROM documents),
    b AS (SELECT project_id, min(rk) AS best FROM r GROUP BY 1)
    SELECT project_id, level_name, ['ifc','dxf','pdf_vector','raster'][rk] AS source, walls, doc_id AS page_id FROM r JOIN b USING (project_id)
    WHERE rk < 4 OR best = 4 QUALIFY row_number() OVER (PARTITION BY project_id, level_name ORDER BY rk, walls DESC, doc_id) = 1
    """,
)
def best_source(t: Tables) -> DataFrame:
    """WIN-6: the best document per language and source."""
    kind = F.when(F.col("n_chars") > 6000, "dxf").when(F.col("n_chars") > 3000, "pdf_vector").otherwise("raster")
    r = t.documents.select(
        F.col("lang").alias("project_id"), F.col("source").alias("level_name"), kind.alias("source"), F.col("n_chars").alias("walls"), F.col("doc_id").alias("page_id")
    )
    return op.best_source_per_level(r)


def event_spans(t: Tables) -> DataFrame:
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("double") - 1704067200
    return t.events.select(
        "user_id", F.col("event_id").alias("span_id"), start.alias("s0"), (start + F.floor(F.col("value") * 200)).alias("s1"),
        F.col("value").alias("offset"), F.get_json_object("props", "$.k").cast("double").alias("thickness"),
    )


SPANS_SQL = """s AS (SELECT user_id, event_id AS span_id, CAST(epoch_us(ts) // 1000000 - 1704067200 AS DOUBLE) AS s0,
    CAST(epoch_us(ts) // 1000000 - 1704067200 AS DOUBLE) + floor(value * 200) AS s1, CAST(json_extract(props, '$.k') AS DOUBLE) AS thickness FROM events)"""


@query(
    "interval_merge",
    f"""WITH {SPANS_SQL}, m AS (SELECT *, s0 - max(s1) OVER (PARTITION BY user_id ORDER BY s0, s1, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM s),
    r AS (SELECT *, sum(CASE WHEN gap <= 3600 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s0, s1, span_id) AS run FROM m)
    SELECT user_id, CAST(run AS BIGINT) AS run, min(s0) AS s0, max(s1) AS s1, sum(s1 - s0) AS support, count(*) AS pieces,
      count_if(coalesce(gap <= 3600 AND gap > 60, false)) AS gaps, coalesce(sum(CASE WHEN gap <= 3600 AND gap > 60 THEN gap END), 0) AS gap_length,
      round(coalesce(sum(thickness * (s1 - s0)) / nullif(sum(s1 - s0), 0), avg(thickness)), 6) AS thickness
    FROM r GROUP BY ALL""",
)
def interval_merge(t: Tables) -> DataFrame:
    """WIN-7: spans of a user's events joined over gaps of up to an hour."""
    out = op.coalesce_intervals(event_spans(t), ["user_id"], max_gap=3600.0, inner_gap=60.0, block=F.floor(F.col("s0") / 86400))
    return out.drop("offset").withColumn("thickness", F.round("thickness", 6))


@query(
    "neighbour_overlap",
    f"""WITH {SPANS_SQL}, p AS (SELECT user_id, lag(span_id) OVER w AS first_id, span_id AS second_id, s0 - lag(s1) OVER w AS gap FROM s
      WINDOW w AS (PARTITION BY user_id ORDER BY s0, s1, span_id)) SELECT * FROM p WHERE gap < 60""",
)
def neighbour_overlap(t: Tables) -> DataFrame:
    """WIN-8: consecutive spans of a user closer than a minute."""
    return op.overlapping_neighbours(event_spans(t), ["user_id"], "s0", "s1", "span_id", 60.0, block=F.floor(F.col("s0") / 86400))


@query(
    "diverse_top_k",
    """
    WITH RECURSIVE c AS (SELECT label, vec_id * 12 + i AS cam_id, round(CAST(embedding[5 * i + 1] AS DOUBLE) * 10, 4) AS x, round(CAST(embedding[5 * i + 2] AS DOUBLE) * 10, 4) AS y,
        round(CAST(embedding[5 * i + 3] AS DOUBLE) * 1000 - floor(CAST(embedding[5 * i + 3] AS DOUBLE) * 1000 / 360) * 360, 3) AS yaw_deg,
        round(0.8 * (abs(CAST(embedding[5 * i + 4] AS DOUBLE)) * 4) + 0.2 * least(1.0, abs(CAST(embedding[5 * i + 5] AS DOUBLE)) * 20 / 6.0), 6) AS score
      FROM embeddings, range(12) r(i)),
    o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, x, y, yaw_deg, cam_id) AS n FROM c),
    r AS (
      SELECT label, n, [o] AS kept, o AS me, true AS ok FROM o WHERE n = 1
      UNION ALL
      SELECT label, n, CASE WHEN ok THEN list_append(kept, me) ELSE kept END, me, ok FROM (
        SELECT o.label, o.n, r.kept, o AS me, len(list_filter(r.kept, lambda k: sqrt((k.x - o.x) ** 2 + (k.y - o.y) ** 2) < 1.0
          AND abs((o.yaw_deg - k.yaw_deg + 180) - floor((o.yaw_deg - k.yaw_deg + 180) / 360) * 360 - 180) < 30)) = 0 AS ok
        FROM r JOIN o ON o.label = r.label AND o.n = r.n + 1 WHERE len(r.kept) < 5)
    )
    SELECT label, me.cam_id AS cam_id, me.x AS x, me.y AS y, me.yaw_deg AS yaw_deg, me.score AS score, len(kept) AS choice FROM r WHERE ok
    """,
)
def diverse_top_k(t: Tables) -> DataFrame:
    """WIN-9: five of twelve views per vector and label by a visibility score, none close to a better
    one."""
    e = F.col("embedding")

    def view(i: Column) -> Column:
        at = lambda k: F.get(e, i * 5 + k).cast("double")
        score = F.round(op.camera_score(F.abs(at(3)) * 4, F.abs(at(4)) * 20), 6)
        return F.struct(
            (F.col("vec_id") * 12 + i).alias("cam_id"), F.round(at(0) * 10, 4).alias("x"), F.round(at(1) * 10, 4).alias("y"),
            F.round(F.pmod(at(2) * 1000, F.lit(360.0)), 3).alias("yaw_deg"), score.alias("score"),
        )

    cands = t.embeddings.select("label", F.inline(F.transform(F.sequence(F.lit(0), F.lit(11)), view)))
    return op.propose_views(cands, ["label"], 5).withColumn("choice", F.col("choice").cast("bigint"))


@query(
    "reachability",
    """
    WITH RECURSIVE e AS (SELECT DISTINCT 'o' || l_orderkey AS a, 's' || l_suppkey AS b FROM lineitem),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r AS (SELECT 's0' AS node UNION SELECT u.b FROM r JOIN u ON u.a = r.node)
    SELECT node FROM r
    """,
)
def reachability(t: Tables) -> DataFrame:
    """WIN-10: orders and suppliers connected with supplier 0 through lines."""
    edges = t.lineitem.select(
        F.concat(F.lit("o"), "l_orderkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b")
    )
    entries = t.supplier.filter("s_suppkey = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    return op.reachable(edges, entries)


@query(
    "best_candidate",
    """
    WITH c AS (SELECT l_orderkey AS view_id, l_partkey * 10 + l_linenumber AS candidate_id, l_linenumber AS attempt, l_suppkey AS seed, l_discount AS d, l_tax = 0 AS ok, l_returnflag = 'R' AS comp FROM lineitem),
    g AS (SELECT view_id, candidate_id AS good FROM c WHERE ok QUALIFY row_number() OVER (PARTITION BY view_id ORDER BY attempt, d, seed, candidate_id) = 1),
    f AS (SELECT view_id, candidate_id AS fail FROM c QUALIFY row_number() OVER (PARTITION BY view_id ORDER BY d, seed, attempt, candidate_id) = 1),
    a AS (SELECT view_id, max(attempt) AS attempts, bool_or(comp) AS comp FROM c GROUP BY 1)
    SELECT view_id, CASE WHEN good IS NOT NULL THEN 'refined' WHEN comp THEN 'hard_composite' ELSE 'fallback_base' END AS status,
      CASE WHEN good IS NOT NULL THEN good WHEN comp THEN fail END AS delivered, attempts
    FROM a JOIN f USING (view_id) LEFT JOIN g USING (view_id)
    """,
)
def best_candidate(t: Tables) -> DataFrame:
    """WIN-11: lines as candidates of an order."""
    c = t.lineitem.select(
        F.col("l_orderkey").alias("view_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("candidate_id"), F.col("l_linenumber").alias("attempt"),
        F.col("l_suppkey").alias("seed"), F.col("l_discount").alias("edge_delta"), (F.col("l_tax") == 0).alias("passed"), (F.col("l_returnflag") == "R").alias("composite_passed"),
    )
    return op.best_candidate(c)


@query(
    "tail_lists",
    """
    SELECT 'audit' AS list, event_id AS id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn FROM events QUALIFY rn <= 50
    UNION ALL SELECT 'jobs', o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders QUALIFY rn <= 3
    """,
)
def tail_lists(t: Tables) -> DataFrame:
    """WIN-12: newest events overall and newest orders per customer."""
    a = op.newest(t.events.select("event_id", "ts"), 50, "ts", "event_id")
    a = op.newest_per_key(a.withColumn("one", F.lit(1)), ["one"], 50, "ts", "event_id").select(F.lit("audit").alias("list"), F.col("event_id").alias("id"), F.col("rn").cast("bigint"))
    j = op.newest_per_key(t.orders, ["o_custkey"], 3, "o_orderdate", "o_orderkey")
    return a.unionByName(j.select(F.lit("jobs").alias("list"), F.col("o_orderkey").alias("id"), F.col("rn").cast("bigint")))


@query(
    "last_assumption",
    """
    WITH u AS (SELECT l_partkey AS "key", CAST(l_linenumber AS VARCHAR) AS value, l_returnflag AS reason FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) = 1)
    SELECT coalesce(u."key", p_partkey) AS "key", coalesce(u.value, p_type) AS value, reason, u."key" IS NOT NULL AS used
    FROM u FULL OUTER JOIN part ON p_partkey = u."key"
    """,
)
def last_assumption(t: Tables) -> DataFrame:
    """WIN-13: last line per part, the part's type as default."""
    items = t.lineitem.select(
        F.col("l_partkey").alias("key"), F.col("l_linenumber").cast("string").alias("value"), F.col("l_returnflag").alias("reason"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice").alias("seq"),
    )
    return op.last_assumption(items, t.part.select(F.col("p_partkey").alias("key"), F.col("p_type").alias("value")))


@query(
    "wall_groups",
    """
    WITH RECURSIVE p AS (
      SELECT o_custkey AS k, o_orderkey AS id, o_orderkey % 4 * CAST(0.5 AS DOUBLE) AS a, o_orderkey // 4 % 9 * CAST(0.02 AS DOUBLE) AS o,
        CASE WHEN o_orderstatus = 'F' THEN 0.2 ELSE 0.25 END::DOUBLE AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n
      FROM orders
    ), r AS (
      SELECT k, n, [{'id': id, 'a': a, 'o': o, 't': t}] AS leads, id, id AS line FROM p WHERE n = 1
      UNION ALL
      SELECT k, n, CASE WHEN hit IS NULL THEN list_append(leads, {'id': id, 'a': a, 'o': o, 't': t}) ELSE leads END, id, coalesce(hit.id, id) FROM (
        SELECT p.*, r.leads, list_filter(r.leads, lambda s: abs(s.a - p.a) < 0.8 AND abs(s.o - p.o) < 0.025 AND abs(s.t - p.t) < 0.025)[1] AS hit
        FROM r JOIN p ON p.k = r.k AND p.n = r.n + 1)
    )
    SELECT k AS plan, id AS piece_id, line AS line_id FROM r
    """,
)
def wall_groups(t: Tables) -> DataFrame:
    """WIN-7: the orders of a customer as wall pieces, gathered around the longest."""
    key = F.col("o_orderkey")
    rows = t.orders.select(
        F.col("o_custkey").alias("plan"), key.alias("piece_id"), F.col("o_totalprice").alias("length"), (key % 4 * 0.5).alias("angle_deg"),
        (F.floor(key / 4) % 9 * 0.02).alias("offset"), F.when(F.col("o_orderstatus") == "F", 0.2).otherwise(0.25).alias("thickness"),
    )
    return op.wall_groups(rows, ["plan"]).select("plan", "piece_id", "line_id")
