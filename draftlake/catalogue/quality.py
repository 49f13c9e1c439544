"""QA and LIC operators on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.functions.numeric import n_rows
from draftlake.catalogue.registry import Tables, query
from draftlake.operators import licences as lic
from draftlake.operators import quality as op



def measured(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Parts as views with a base, lines as candidates."""
    base = t.part.select(
        F.col("p_partkey").alias("view_id"), F.lit(0.9).alias("structural_edge_f"), F.lit(0.1).alias("depth_drift"),
        (F.col("p_size") / 1000).alias("clipping"), F.lit(2.0).alias("sharpness_ratio"), F.lit(0.01).alias("noise"),
    )
    cand = t.lineitem.select(
        F.col("l_partkey").alias("view_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("candidate_id"),
        (F.lit(0.9) - F.col("l_discount")).alias("structural_edge_f"), (F.lit(0.1) + F.col("l_tax") / 3).alias("depth_drift"),
        (F.col("l_discount") / 1.5).alias("openings"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("new_missing"), F.lit(0).alias("new_extra"),
        (F.col("l_linenumber") / 10).alias("verticals"), (F.col("l_quantity") / 1000).alias("clipping"), (F.col("l_quantity") / 10).alias("sharpness_ratio"),
        F.when(F.col("l_linestatus") == "F", 0.015).alias("noise"), (F.col("l_quantity") / 9).alias("material_color_shift"),
    )
    return base, cand


CHECKS_SQL = """b AS (SELECT l_partkey AS v, 0.9::DOUBLE AS be, 0.1::DOUBLE AS bd, p_size / 1000 AS bc, l_discount AS d, l_tax AS x, l_linenumber AS n, l_quantity AS q, l_returnflag AS f, l_linestatus AS s
      FROM lineitem LEFT JOIN part ON p_partkey = l_partkey),
    k AS (SELECT v, be - (be - d) <= 0.05 AS c1, (bd + x / 3) - bd <= 0.02 AS c2, d / 1.5 <= 0.05 AND f <> 'R' AS c3, n / 10 <= 0.5 AS c4,
      q / 1000 - bc <= 0.01 AS c5, q / 10 / 2.0 >= 0.7 AS c6, CASE WHEN s = 'F' THEN 0.015::DOUBLE - 0.01 <= 0.01 ELSE false END AS c7, q / 9 <= 5 AS c8 FROM b)"""


@query(
    "relative_checks",
    f"""WITH {CHECKS_SQL} SELECT name, count(*) AS n, count_if(ok) AS passed FROM (
      SELECT 'structural_edge_f' AS name, c1 AS ok FROM k UNION ALL SELECT 'depth_drift', c2 FROM k UNION ALL SELECT 'openings', c3 FROM k UNION ALL SELECT 'verticals', c4 FROM k
      UNION ALL SELECT 'clipping', c5 FROM k UNION ALL SELECT 'sharpness_ratio', c6 FROM k UNION ALL SELECT 'noise', c7 FROM k UNION ALL SELECT 'material_color_shift', c8 FROM k) GROUP BY name""",
)
def relative_checks(t: Tables) -> DataFrame:
    """QA-1: eight checks of every candidate against its base."""
    base, cand = measured(t)
    return op.relative_checks(base, cand, ["view_id"], "candidate_id").groupBy("name").agg(n_rows().alias("n"), F.count_if("passed").alias("passed"))


@query(
    "candidate_verdicts",
    f"""WITH {CHECKS_SQL} SELECT v AS view_id, count(*) AS candidates, count_if(c1 AND c2 AND c3 AND c4) AS geometry,
      count_if(c1 AND c2 AND c3 AND c4 AND c5 AND c6 AND c7 AND c8) AS passed FROM k GROUP BY v""",
)
def candidate_verdicts(t: Tables) -> DataFrame:
    """QA-3: verdicts per candidate, counted per view."""
    base, cand = measured(t)
    checks = op.relative_checks(base, cand, ["view_id"], "candidate_id").withColumn("mock", F.col("name") == "noise")
    v = op.candidate_verdict(checks, ["view_id", "candidate_id"])
    return v.groupBy("view_id").agg(n_rows().alias("candidates"), F.count_if("geometry_passed").alias("geometry"), F.count_if("passed").alias("passed"))


@query(
    "worst_items",
    """
    WITH c AS (SELECT l_orderkey AS o, l_linenumber AS v, l_suppkey AS i, max(l_discount) AS got FROM lineitem GROUP BY ALL),
    b AS (SELECT l_orderkey AS o, l_suppkey AS i, max(l_tax) AS base FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL),
    k AS (SELECT DISTINCT o, v FROM c), w AS (SELECT k.o, k.v, b.i, base FROM k JOIN b USING (o)),
    j AS (SELECT coalesce(w.o, c.o) AS o, coalesce(w.v, c.v) AS v, base, got FROM w FULL OUTER JOIN c ON c.o = w.o AND c.v = w.v AND c.i = w.i)
    SELECT o, v, greatest(coalesce(max(CASE WHEN base IS NOT NULL THEN base - coalesce(got, 0) END), 0), 0) AS worst,
      count_if(coalesce(base, 0) > 0 AND coalesce(got, 0) = 0) AS new_missing, count_if(base IS NULL AND coalesce(got, 0) > 0) AS new_extra FROM j GROUP BY o, v
    """,
)
def worst_items(t: Tables) -> DataFrame:
    """QA-2: suppliers of an order as items, line numbers as candidates; the greatest value of an item counts."""
    l = t.lineitem
    cand = l.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("v"), F.col("l_suppkey").alias("i"), F.col("l_discount").alias("x"))
    base = l.filter("l_returnflag <> 'A'").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("i"), F.col("l_tax").alias("x"))
    return op.worst_item_delta(base, cand, ["o", "v"], "i", "x")


@query(
    "deliverable_guard",
    """
    WITH v AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'fallback_base' ELSE 'refined' END AS st, substr(o_orderpriority, 1, 1) AS d, CAST(o_custkey % 5 + 1 AS VARCHAR) AS f, CAST(o_custkey % 3 + 1 AS VARCHAR) AS b FROM orders),
    q AS (SELECT l_orderkey AS id, CAST(l_linenumber AS VARCHAR) AS sha, bool_and(l_discount < 0.06) AS ok FROM lineitem GROUP BY ALL),
    r AS (SELECT v.id, CASE WHEN f <> d THEN 'hash_mismatch' WHEN st = 'fallback_base' AND d <> b THEN 'fallback_not_base' WHEN st = 'fallback_base' THEN NULL
      WHEN q.id IS NULL THEN 'no_record' WHEN NOT ok THEN 'failed_checks' END AS reason FROM v LEFT JOIN q ON q.id = v.id AND sha = d)
    SELECT id AS view_id, reason FROM r WHERE reason IS NOT NULL
    """,
)
def deliverable_guard(t: Tables) -> DataFrame:
    """QA-4: orders as delivered views, lines as their records."""
    views = t.orders.select(
        F.col("o_orderkey").alias("view_id"), F.when(F.col("o_orderstatus") == "F", "fallback_base").otherwise("refined").alias("status"),
        F.substring("o_orderpriority", 1, 1).alias("delivered_sha256"), (F.col("o_custkey") % 5 + 1).cast("string").alias("file_sha256"), (F.col("o_custkey") % 3 + 1).cast("string").alias("base_sha256"),
    )
    verdicts = t.lineitem.select(F.col("l_orderkey").alias("view_id"), F.col("l_linenumber").cast("string").alias("image_sha256"), (F.col("l_discount") < 0.06).alias("passed"))
    return op.deliverable_guard(views, verdicts)


@query(
    "gate_decisions",
    """
    WITH o AS (SELECT o_orderkey AS run_id, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'rejected' ELSE 'pending' END AS status,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'never' WHEN '2' THEN 'always' ELSE 'on_low_confidence' END AS policy FROM orders),
    c AS (SELECT l_orderkey, bool_and(l_discount < 0.09) AS ok, count(DISTINCT CASE WHEN l_tax > 0.02 THEN l_linenumber % 4 END) AS fam FROM lineitem GROUP BY 1),
    v AS (SELECT l_orderkey, bool_and(l_quantity > 3) AS refined FROM lineitem GROUP BY 1)
    SELECT run_id, CASE WHEN status = 'approved' THEN 'approved' WHEN status = 'rejected' THEN 'refused' WHEN o_custkey % 10 = 0 THEN 'pending'
      WHEN policy = 'never' OR (policy = 'on_low_confidence' AND ok AND refined AND fam = 4) THEN 'auto_passed' ELSE 'pending' END AS decision
    FROM o JOIN c ON c.l_orderkey = run_id JOIN v ON v.l_orderkey = run_id
    """,
)
def gate_decisions(t: Tables) -> DataFrame:
    """QA-5: the last gate of every order from its lines."""
    fam = F.element_at(F.array(*[F.lit(f) for f in op.REQUIRED_FAMILIES]), F.col("l_linenumber") % 4 + 1)
    outcomes = t.lineitem.select(F.col("l_orderkey").alias("run_id"), F.when(F.col("l_quantity") > 3, "refined").otherwise("fallback_base").alias("status"))
    checks = t.lineitem.select(F.col("l_orderkey").alias("run_id"), (F.col("l_discount") < 0.09).alias("passed"), fam.alias("family"), (F.col("l_tax") <= 0.02).alias("mock"))
    p = F.substring("o_orderpriority", 1, 1)
    gates = t.orders.select(
        F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "P", "rejected").otherwise("pending").alias("status"),
        F.when(p == "1", "never").when(p == "2", "always").otherwise("on_low_confidence").alias("policy"), (F.col("o_custkey") % 10 == 0).alias("mandatory"),
    )
    return op.gate_decision(gates.join(op.final_gate(outcomes, checks), "run_id")).select("run_id", "decision")


@query(
    "licence_lines",
    """
    WITH h AS (SELECT source, doc_id, unnest(list_filter(['Apache-2.0', 'MIT', 'GPL-3.0', 'CC-BY-NC-4.0'], lambda n: CASE n WHEN 'Apache-2.0' THEN contains(lower(text), 'apache license')
      WHEN 'MIT' THEN contains(lower(text), 'mit license') WHEN 'GPL-3.0' THEN contains(lower(text), 'gnu general public license') OR contains(lower(text), 'gpl-3')
      ELSE contains(lower(text), 'cc by-nc') OR contains(lower(text), 'attribution-noncommercial') END)) AS spdx FROM documents)
    SELECT spdx, spdx IN ('Apache-2.0', 'MIT') AS allowed, count(*) AS documents, count(DISTINCT source) AS sources FROM h GROUP BY ALL
    """,
)
def licence_lines(t: Tables) -> DataFrame:
    """LIC-1: licences stated in whole documents."""
    return lic.licence_lines(t.documents, ["source", "doc_id"]).groupBy("spdx", "allowed").agg(n_rows().alias("documents"), F.count_distinct("source").alias("sources"))


@query(
    "package_audit",
    """
    WITH p AS (SELECT CASE p_size % 8 WHEN 0 THEN 'MIT' WHEN 1 THEN 'GPL-3.0 OR MIT' WHEN 2 THEN '(Apache-2.0 AND AGPL-3.0)' WHEN 3 THEN 'Apache-2.0 WITH LLVM-exception'
        WHEN 4 THEN 'BSD-3-Clause' WHEN 5 THEN 'Custom 1' WHEN 6 THEN 'UNKNOWN' ELSE 'MIT' END AS spdx, p_size % 8 AS k, p_size, p_type FROM part)
    SELECT p_type AS env, CASE WHEN p_size = 15 THEN 'Apache-2.0' ELSE spdx END AS spdx,
      CASE WHEN k = 2 OR k = 5 THEN 'licence not allowed' WHEN k = 6 THEN 'no machine-readable licence' END AS problem, count(*) AS n FROM p GROUP BY ALL
    """,
)
def package_audit(t: Tables) -> DataFrame:
    """LIC-1: parts as packages with eight kinds of licence metadata."""
    k = F.col("p_size") % 8
    packages = t.part.select(
        F.concat(F.lit("Pkg-"), "p_size").alias("name"), F.col("p_type").alias("env"),
        F.when(k == 1, "GPL-3.0 OR MIT").when(k == 2, "(Apache-2.0 AND AGPL-3.0)").when(k == 3, "Apache-2.0 WITH LLVM-exception").alias("expression"),
        F.when(k == 0, "The MIT License").when(k == 4, "new BSD").when(k == 5, "Custom 1").otherwise("").alias("license"),
        F.when(k == 7, F.array(F.lit("License :: OSI Approved :: MIT License"))).otherwise(F.array().cast("array<string>")).alias("classifiers"),
    )
    verified = t.part.filter("p_size = 15").select(F.concat(F.lit("pkg-"), "p_size").alias("name"), F.lit("Apache-2.0").alias("license"))
    return lic.spdx_audit(packages, verified).groupBy("env", "spdx", "problem").agg(n_rows().alias("n"))


def part_models(t: Tables) -> DataFrame:
    """Parts as models with licence, terms, territories and caps."""
    s = F.col("p_size")
    at = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), s % 5 + 1)
    return t.part.select(
        F.col("p_partkey").alias("name"),
        at("apache-2.0", "cc-by-nc-4.0", "sam-license", "own-1", "mit").alias("license_id"), at("permissive", "blocked", "conditional", "proprietary", "permissive").alias("license_class"),
        (s % 7 != 0).alias("commercial_ok"), F.when(s % 2 == 0, "terms-a").alias("terms_id"),
        F.when(s % 3 == 0, F.array(F.lit("eu"))).otherwise(F.array(F.lit("KR"))).alias("territorial_exclusions"),
        F.when(s % 11 == 0, F.create_map(F.lit("mau"), F.lit("1"))).otherwise(F.create_map().cast("map<string,string>")).alias("caps"), (s == 50).alias("mock"),
    )


@query(
    "blocked_models",
    """
    WITH m AS (SELECT p_partkey, p_size AS s, p_brand AS b, ['apache-2.0', 'cc-by-nc-4.0', 'sam-license', 'own-1', 'mit'][p_size % 5 + 1] AS id,
        ['permissive', 'blocked', 'conditional', 'proprietary', 'permissive'][p_size % 5 + 1] AS k FROM part),
    r AS (SELECT *, concat_ws(',', CASE WHEN id = 'cc-by-nc-4.0' THEN 'blocked_list' END, CASE WHEN s % 7 = 0 THEN 'not_commercial' END, CASE WHEN k = 'blocked' THEN 'class_blocked' END,
      CASE WHEN k = 'conditional' AND s % 2 = 1 THEN 'terms_not_accepted' END, CASE WHEN id = 'cc-by-nc-4.0' THEN 'not_in_allowlist' END,
      CASE WHEN s % 3 = 0 THEN 'territorial_exclusion' END, CASE WHEN s % 11 = 0 THEN 'revenue_caps' END) AS x FROM m)
    SELECT id AS license_id, CASE WHEN s = 50 THEN '' ELSE x END AS reasons, count(*) AS n FROM r GROUP BY ALL
    """,
)
def blocked_models(t: Tables) -> DataFrame:
    """LIC-2: parts as models under a policy for Germany."""
    judged = lic.blocked_reasons(part_models(t), ["DE"], accepted_terms=["terms-a"])
    return judged.groupBy("license_id", F.array_join("reasons", ",").alias("reasons")).agg(n_rows().alias("n"))
