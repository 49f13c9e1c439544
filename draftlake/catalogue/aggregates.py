"""AGG operators on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.functions.numeric import n_rows
from draftlake.catalogue.registry import Tables, query
from draftlake.operators import aggregates as op



def graded(t: Tables) -> DataFrame:
    """Labelled documents with a guess from the length."""
    guess = F.when(F.col("n_chars") > 1500, 1).otherwise(0)
    d = t.documents.select("doc_id", "source", guess.alias("pred"), (F.col("n_chars") % 10 == 0).alias("review"))
    return t.labels.join(d, "doc_id").withColumnRenamed("quality", "truth")


GRADED_SQL = """g AS (SELECT source, quality AS truth, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS pred,
    n_chars % 10 = 0 AS review FROM labels JOIN documents USING (doc_id))"""


@query(
    "macro_f1",
    f"""WITH {GRADED_SQL}, s AS (SELECT * FROM g UNION ALL SELECT 'all', truth, pred, review FROM g),
    c AS (SELECT DISTINCT source, k FROM (SELECT source, truth AS k FROM s UNION ALL SELECT source, pred FROM s)),
    f AS (SELECT c.source, k, count_if(truth = k AND pred = k) AS tp, count_if(truth = k) AS t, count_if(pred = k) AS p
      FROM c JOIN s ON s.source = c.source GROUP BY ALL)
    SELECT source, round(avg(2 * tp / (t + p)), 9) AS macro_f1, round(sum(tp) / sum(t), 9) AS accuracy, CAST(sum(t) AS BIGINT) AS n
    FROM f GROUP BY source""",
)
def macro_f1(t: Tables) -> DataFrame:
    """AGG-1, ML-6: macro F1 and accuracy per source and overall."""
    r = op.score_report(graded(t), "truth", "pred", "source")
    return r.select("source", F.round("macro_f1", 9).alias("macro_f1"), F.round("accuracy", 9).alias("accuracy"), "n")


@query(
    "confusions",
    f"WITH {GRADED_SQL} SELECT truth, pred, count(*) AS n FROM g WHERE truth <> pred GROUP BY ALL ORDER BY n DESC, truth, pred LIMIT 5",
)
def confusions(t: Tables) -> DataFrame:
    """AGG-1: most frequent wrong pairs."""
    return op.confusions(graded(t), "truth", "pred")


@query(
    "class_scores",
    f"""WITH {GRADED_SQL} SELECT k AS "class", count_if(truth = k AND pred = k) AS tp, count_if(truth <> k AND pred = k) AS fp,
      count_if(truth = k AND pred <> k) AS fn FROM g, (VALUES (0), (1)) c(k) GROUP BY k""",
)
def class_scores(t: Tables) -> DataFrame:
    """AGG-1: counts per class."""
    return op.class_counts(graded(t), "truth", "pred").drop("f1")


@query(
    "review_rates",
    f"""WITH {GRADED_SQL} SELECT round(avg(CASE WHEN review THEN 1.0 ELSE 0 END), 9) AS review_rate,
      count_if(truth <> pred AND NOT review) AS errors_not_reviewed FROM g""",
)
def review_rates(t: Tables) -> DataFrame:
    """AGG-1: review rate and silent errors."""
    r = op.review_rates(graded(t), "truth", "pred", "review")
    return r.withColumn("review_rate", F.round("review_rate", 9))


@query(
    "ratios",
    """
    WITH s AS (SELECT l_linenumber, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS h, count(*) AS n,
        CAST(sum(CASE WHEN l_linenumber > 5 THEN 0 ELSE 1 END) AS BIGINT) AS m FROM lineitem GROUP BY 1)
    SELECT l_linenumber, printf('%d/%d (%.0f %%)', h, n, h * 100.0 / n) AS returned,
      CASE WHEN m = 0 THEN 'n/a' ELSE printf('%d/%d (%.0f %%)', h, m, h * 100.0 / m) END AS measured FROM s
    """,
)
def ratios(t: Tables) -> DataFrame:
    """AGG-2: ratios as text, n/a without a total."""
    d = t.lineitem.select(
        "l_linenumber", (F.col("l_returnflag") == "R").cast("bigint").alias("hit"), F.lit(1).cast("bigint").alias("one"),
        (F.col("l_linenumber") <= 5).cast("bigint").alias("some"),
    )
    return op.ratio_metrics(d, ["l_linenumber"], {"returned": ("hit", "one"), "measured": ("hit", "some")})


@query(
    "circular_error",
    """
    WITH e AS (SELECT l_returnflag, CASE WHEN l_linenumber < 7 THEN abs(((l_partkey - l_suppkey * 7) % 360 + 360 + 180) % 360 - 180) END AS e FROM lineitem)
    SELECT l_returnflag, count(e) AS measured, count_if(e IS NULL) AS missing, round(avg(e), 6) AS mean_err, CAST(max(e) AS DOUBLE) AS max_err FROM e GROUP BY 1
    """,
)
def circular_error(t: Tables) -> DataFrame:
    """AGG-2: angle errors with missing measurements."""
    d = t.lineitem.select(
        "l_returnflag", F.when(F.col("l_linenumber") < 7, F.col("l_partkey").cast("double")).alias("a"),
        (F.col("l_suppkey") * 7).cast("double").alias("b"),
    )
    return op.angle_errors(d, ["l_returnflag"], "a", "b").withColumn("mean_err", F.round("mean_err", 6))


# How a page is read: code and comments go, headings and paragraphs begin at the first mark and end at the
# second or at the next beginning, other tags go.
READING = [
    (r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", ""), (r"(?i)<(h[1-6]|p)(\s[^>]*)?>", "\x1d"),
    (r"(?i)</?(h[1-6]|p|div|ul|ol|li|nav|article|section|table|header|footer|aside|head|body)(\s[^>]*)?>", "\x1e"), (r"<[^>]*>", ""),
]


def _readings_sql() -> str:
    body = "html"
    for pattern, mark in READING:
        text = f"chr({ord(mark)})" if mark else "''"
        body = f"regexp_replace({body}, '{pattern}', {text}, 'g')"
    return body


@query(
    "char_accuracy",
    f"""
    WITH c AS (SELECT string_agg(c, '' ORDER BY c) AS wide, array_to_string(list_transform(list_slice(list_concat(range(1, 9), range(14, 32)), 1, count(*)::INT), lambda x: chr(x::INT)), '') AS narrow
      FROM (SELECT DISTINCT unnest(regexp_extract_all(html, '[^\\x00-\\x7F]')) AS c FROM pages)),
    p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS truth,
      regexp_extract_all({_readings_sql()}, '\\x1D([^\\x1D\\x1E]*)', 1) AS got FROM pages),
    r AS (SELECT page_id, truth, trim(unnest(got)) AS got FROM p),
    a AS (SELECT page_id, truth = got AS same, CASE WHEN length(truth) = 0 THEN CASE WHEN length(got) = 0 THEN 1.0 ELSE 0 END
      ELSE greatest(0, 1 - levenshtein(translate(truth, wide, narrow), translate(got, wide, narrow)) / length(truth)) END AS share FROM r, c)
    SELECT page_id, count(share) AS readings, round(coalesce(max(share), 0), 9) AS accuracy, coalesce(max(same::INT), 0) AS exact FROM p LEFT JOIN a USING (page_id) GROUP BY page_id
    """,
)
def char_accuracy(t: Tables) -> DataFrame:
    """AGG-3: page titles against all headings and paragraphs in every script, best reading per page.
    SQL compares bytes, so it gives every other letter a byte of its own."""
    body = F.col("html")
    for pattern, mark in READING:
        body = F.regexp_replace(body, pattern, mark)
    pairs = t.spread("pages").select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("truth"),
        F.explode_outer(F.regexp_extract_all(body, F.lit("\\x1D([^\\x1D\\x1E]*)"), F.lit(1))).alias("got"),
    ).withColumn("got", F.trim("got"))
    out = op.best_char_accuracy(pairs, ["page_id"], "truth", "got")
    found = pairs.groupBy("page_id").agg(F.count("got").alias("readings"))
    return out.join(found, "page_id").withColumn("accuracy", F.round("accuracy", 9))


@query(
    "class_iou",
    """
    SELECT k AS "class", round(count_if(quality = k AND toxic = k) / count_if(quality = k OR toxic = k), 9) AS iou
    FROM labels, (VALUES (0), (1)) c(k) GROUP BY k
    """,
)
def class_iou(t: Tables) -> DataFrame:
    """AGG-4: overlap of two label columns."""
    return op.class_iou(t.labels, "toxic", "quality").withColumn("iou", F.round("iou", 9))


@query(
    "class_freq",
    "SELECT event_type AS \"class\", count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM events GROUP BY 1",
)
def class_freq(t: Tables) -> DataFrame:
    """AGG-4: class frequencies."""
    return op.class_freq(t.events, "event_type").withColumn("share", F.round("share", 9))


@query(
    "consensus_ratio",
    """
    WITH r AS (SELECT l_suppkey AS k, l_extendedprice / l_quantity AS x FROM lineitem),
    h AS (SELECT a.k, a.x AS r, count(*) AS c, CASE WHEN count(*) > 1 THEN round(stddev_pop(b.x) / avg(b.x), 9) ELSE 1.0 END AS s
      FROM (SELECT DISTINCT k, x FROM r) a JOIN r b ON a.k = b.k AND abs(b.x - a.x) / a.x <= 0.01 GROUP BY ALL),
    w AS (SELECT k, r FROM h QUALIFY row_number() OVER (PARTITION BY k ORDER BY c DESC, s, r) = 1),
    i AS (SELECT r.k, x FROM r JOIN w USING (k) WHERE abs(x - w.r) / w.r <= 0.01),
    m AS (SELECT k, median(x) AS value, count(*) AS n FROM i GROUP BY k),
    d AS (SELECT i.k, median(abs(x - value)) AS mad FROM i JOIN m USING (k) GROUP BY ALL)
    SELECT k, round(value, 6) AS value, round(CASE WHEN n > 1 THEN greatest(0.002, 1.4826 * mad / value / sqrt(n)) ELSE 0.08 END, 9) AS rel_sigma, n AS inliers
    FROM m JOIN d USING (k)
    """,
)
def consensus_ratio(t: Tables) -> DataFrame:
    """AGG-5: the unit price most lines of a supplier agree on."""
    r = t.lineitem.select(F.col("l_suppkey").alias("k"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("ratio"))
    out = op.consensus_ratio(r, ["k"])
    return out.select("k", F.round("value", 6).alias("value"), F.round("rel_sigma", 9).alias("rel_sigma"), "inliers")


@query(
    "fused_estimates",
    """
    WITH e AS (SELECT l_orderkey AS k, l_returnflag || l_linestatus AS method, 1000 + l_suppkey / 10.0 AS value, l_discount / 5 + 0.004 AS s, l_linenumber AS n FROM lineitem),
    p AS (SELECT *, 1 / (s * s) AS w FROM e WHERE s <= 0.01),
    c AS (SELECT k, value, sum(sum(w)) OVER (PARTITION BY k ORDER BY value) AS cum, sum(sum(w)) OVER (PARTITION BY k) AS tot FROM p GROUP BY k, value),
    m AS (SELECT k, min(value) AS med FROM c WHERE cum >= tot / 2 GROUP BY k),
    g AS (SELECT k, (max(value) - min(value)) / min(value) > 0.015 AS conflict, 1 / sqrt(sum(w)) AS sig, sum(n) AS n,
        string_agg(DISTINCT method, '+' ORDER BY method) AS methods FROM p GROUP BY k),
    b AS (SELECT k, value, s, method, n FROM e QUALIFY row_number() OVER (PARTITION BY k ORDER BY s, method, value) = 1)
    SELECT b.k, round(CASE WHEN g.conflict = false THEN med ELSE b.value END, 6) AS value,
      round(CASE WHEN g.conflict = false THEN sig ELSE b.s END, 9) AS rel_sigma,
      CASE WHEN g.conflict = false THEN methods ELSE b.method END AS method, coalesce(g.conflict, false) AS conflict,
      coalesce(g.conflict, false) OR round(CASE WHEN g.conflict = false THEN sig ELSE b.s END, 9) > 0.02 AS review
    FROM b LEFT JOIN g USING (k) LEFT JOIN m USING (k)
    """,
)
def fused_estimates(t: Tables) -> DataFrame:
    """AGG-6: line values of an order as scale estimates with a sigma from the discount."""
    e = t.lineitem.select(
        F.col("l_orderkey").alias("k"), F.concat("l_returnflag", "l_linestatus").alias("method"),
        (1000 + F.col("l_suppkey") / 10.0).alias("value"), (F.col("l_discount") / 5 + 0.004).alias("rel_sigma"),
        F.col("l_linenumber").cast("bigint").alias("n"),
    )
    out = op.fuse_estimates(e, ["k"]).drop("n")
    sigma = F.round("rel_sigma", 9)
    return out.withColumns({"value": F.round("value", 6), "rel_sigma": sigma, "review": F.col("conflict") | (sigma > 0.02)})


@query(
    "door_prior",
    "SELECT l_suppkey AS k, round(0.85 / median(l_quantity), 9) AS value, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 2",
)
def door_prior(t: Tables) -> DataFrame:
    """AGG-6: scale from a median radius."""
    r = t.lineitem.select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("radius"))
    return op.door_prior(r, ["k"]).select("k", F.round("value", 9).alias("value"), "n")


@query(
    "weighted_median",
    """
    WITH c AS (SELECT l_returnflag AS k, l_discount * 100 AS tilt, sum(sum(l_quantity)) OVER (PARTITION BY l_returnflag ORDER BY l_discount * 100) AS cum,
      sum(sum(l_quantity)) OVER (PARTITION BY l_returnflag) AS tot FROM lineitem WHERE l_quantity >= 20 AND l_discount * 100 <= 10 GROUP BY 1, 2)
    SELECT k, min(tilt) AS tilt, max(tot) AS total_weight FROM c WHERE cum >= tot / 2 GROUP BY k
    """,
)
def weighted_median(t: Tables) -> DataFrame:
    """AGG-7: quantity-weighted median discount."""
    lines = t.lineitem.select(
        F.col("l_returnflag").alias("k"), (F.col("l_discount") * 100).alias("tilt"), F.col("l_quantity").alias("length")
    )
    return op.line_deviation(lines, ["k"])


@query(
    "fitted_line",
    """
    SELECT l_returnflag AS k, round(regr_slope(l_extendedprice, l_quantity * 1000), 6) AS scale,
      round(regr_intercept(l_extendedprice, l_quantity * 1000), 3) AS shift, round(avg(abs(l_quantity * 1000 - l_extendedprice) / l_extendedprice), 6) AS abs_rel
    FROM lineitem GROUP BY 1
    """,
)
def fitted_line(t: Tables) -> DataFrame:
    """AGG-8: price against quantity."""
    d = t.lineitem.select(F.col("l_returnflag").alias("k"), (F.col("l_quantity") * 1000).alias("pred"), F.col("l_extendedprice").alias("truth"))
    out = op.fit_scale_shift(d, ["k"], "pred", "truth")
    return out.select("k", F.round("scale", 6).alias("scale"), F.round("shift", 3).alias("shift"), F.round("abs_rel", 6).alias("abs_rel"))


@query(
    "mad_noise",
    """
    WITH m AS (SELECT l_suppkey AS k, median(l_extendedprice) AS m, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT k, round(max(m), 4) AS median, max(n) AS n, round(median(abs(l_extendedprice - m)), 4) AS mad FROM lineitem JOIN m ON k = l_suppkey GROUP BY k
    """,
)
def mad_noise(t: Tables) -> DataFrame:
    """AGG-8: exact median and MAD of the prices of a supplier."""
    d = t.lineitem.select(F.col("l_suppkey").alias("k"), F.col("l_extendedprice").alias("v"))
    out = op.mad_noise(d, ["k"], "v")
    return out.select("k", F.round("median", 4).alias("median"), "n", F.round("mad", 4).alias("mad"))


@query(
    "centroid_shift",
    """
    WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS d, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
    m AS (SELECT label, d, avg(v) AS m FROM e GROUP BY ALL)
    SELECT a.label, round(sqrt(sum((a.m - b.m) * (a.m - b.m))), 6) AS shift FROM m a JOIN m b ON a.d = b.d AND b.label = 0 GROUP BY a.label
    """,
)
def centroid_shift(t: Tables) -> DataFrame:
    """AGG-8: distance of each label's mean vector from that of label 0."""
    means = op.mean_vectors(t.embeddings.select("label", F.col("embedding").cast("array<double>").alias("v")), ["label"], "v")
    return op.vector_shift(means, "label", F.lit(0)).withColumn("shift", F.round("shift", 6))


@query(
    "timings_report",
    """
    SELECT event_type AS stage, count(*) AS calls, round(sum(value), 2) AS seconds, round(avg(CASE WHEN value < 5 THEN 1.0 ELSE 0 END), 9) AS cached_share,
      count_if(value > 40) AS failed, round(avg(CAST(json_extract(props, '$.k') AS BIGINT)), 6) AS mean_attempts FROM events GROUP BY 1
    """,
)
def timings_report(t: Tables) -> DataFrame:
    """AGG-9: events as stage runs."""
    runs = t.events.select(
        F.col("event_type").alias("stage"), F.col("value").alias("seconds"), (F.col("value") < 5).alias("cached"),
        F.when(F.col("value") > 40, "failed").otherwise("ok").alias("status"), F.get_json_object("props", "$.k").cast("bigint").alias("attempts"),
    )
    out = op.stage_timings(runs)
    return out.withColumns({"seconds": F.round("seconds", 2), "cached_share": F.round("cached_share", 9), "mean_attempts": F.round("mean_attempts", 6)})


@query(
    "target_verdict",
    """
    WITH g AS (SELECT source, avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0 END) AS english, max(n_chars) AS longest FROM documents GROUP BY 1)
    SELECT source, round(english, 9) AS english, longest, concat_ws(',', CASE WHEN english < 0.65 THEN 'english' END, CASE WHEN longest > 12000 THEN 'longest' END) AS misses,
      english >= 0.65 AND longest <= 12000 AS ok FROM g
    """,
)
def target_verdict(t: Tables) -> DataFrame:
    """AGG-10: sources against targets for language share and length."""
    rows = t.documents.select("source", (F.col("lang") == "en").cast("double").alias("english"), F.col("n_chars").alias("longest"))
    targets = t.documents.select("source").distinct().select("source", F.lit(0.65).alias("english"), F.lit(12000).alias("longest"))
    out = op.target_verdict(rows, targets, "source", ["english"], ["longest"])
    return out.withColumns({"english": F.round("english", 9), "misses": F.array_join("misses", ",")})


@query(
    "detection_rate",
    """
    WITH i AS (SELECT l_orderkey AS defect_id, l_returnflag AS code, l_suppkey AS element FROM lineitem),
    f AS (SELECT DISTINCT l_returnflag AS code, l_suppkey AS element FROM lineitem WHERE l_quantity > 49),
    d AS (SELECT defect_id, i.code, bool_and(f.element IS NOT NULL) AS hit FROM i LEFT JOIN f ON f.code = i.code AND f.element = i.element GROUP BY ALL)
    SELECT code, count(*) AS defects, count_if(hit) AS detected FROM d GROUP BY code
    """,
)
def detection_rate(t: Tables) -> DataFrame:
    """AGG-12: orders whose every supplier is reported under the flag."""
    injected = t.lineitem.select(F.col("l_orderkey").alias("defect_id"), F.col("l_returnflag").alias("code"), F.col("l_suppkey").alias("element"))
    issues = t.lineitem.filter("l_quantity > 49").select(F.col("l_returnflag").alias("code"), F.col("l_suppkey").alias("element"))
    return op.detection_rate(injected, issues)


@query(
    "nested_run_view",
    """
    WITH g AS (SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_returnflag DESC) = 1),
    a AS (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber) AS gates FROM g GROUP BY 1),
    b AS (SELECT l_orderkey, l_partkey AS bundle_id FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey DESC) = 1)
    SELECT o_orderkey AS run_id, coalesce(gates, '') AS gates, bundle_id FROM orders LEFT JOIN a ON a.l_orderkey = o_orderkey LEFT JOIN b ON b.l_orderkey = o_orderkey
    """,
)
def nested_run_view(t: Tables) -> DataFrame:
    """AGG-13: orders with their line numbers as gates and the newest line as bundle."""
    runs = t.orders.select(F.col("o_orderkey").alias("run_id"))
    gates = t.lineitem.select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("gate"), F.col("l_shipdate").alias("decided_at"), F.col("l_returnflag").alias("status")
    )
    bundles = t.lineitem.select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("bundle_id"), F.col("l_shipdate").alias("created_at"))
    text = F.transform(F.coalesce("gates", F.array().cast("array<struct<gate:int,status:string>>")), lambda g: F.concat(g["gate"].cast("string"), F.lit(":"), g["status"]))
    return op.run_view(runs, gates, bundles).select("run_id", F.array_join(text, ",").alias("gates"), "bundle_id")


@query(
    "pair_consensus",
    """
    WITH r AS (SELECT DISTINCT l_suppkey AS k, l_linenumber * 100 + l_partkey % 30 AS p, 1 + l_quantity * CAST(0.0037 AS DOUBLE) AS x FROM lineitem),
    h AS (SELECT a.k, a.x AS r, b.p, arg_min(b.x, round(abs(b.x - a.x), 9) + b.x * 1e-12) AS x FROM (SELECT DISTINCT k, x FROM r) a JOIN r b ON a.k = b.k AND abs(b.x - a.x) / a.x <= 0.01 GROUP BY ALL),
    c AS (SELECT k, r, count(*) AS c, CASE WHEN count(*) > 1 THEN round(stddev_pop(x) / avg(x), 6) ELSE 1.0 END AS s FROM h GROUP BY ALL),
    w AS (SELECT k, r FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY c DESC, s, r) = 1),
    i AS (SELECT h.k, h.x FROM h JOIN w ON h.k = w.k AND h.r = w.r),
    m AS (SELECT k, median(x) AS value, count(*) AS n FROM i GROUP BY k),
    d AS (SELECT i.k, median(abs(x - value)) AS mad FROM i JOIN m USING (k) GROUP BY ALL)
    SELECT k, round(value, 6) AS value, round(CASE WHEN n > 1 THEN greatest(0.002, 1.4826 * mad / value / sqrt(n)) ELSE 0.08 END, 6) AS rel_sigma, n AS inliers
    FROM m JOIN d USING (k)
    """,
)
def pair_consensus(t: Tables) -> DataFrame:
    """AGG-5: the ratio most pairs of a supplier agree on, a pair of line number and class of part counting once."""
    r = t.lineitem.select(
        F.col("l_suppkey").alias("k"), (F.col("l_linenumber") * 100 + F.col("l_partkey") % 30).alias("p"), (F.lit(1.0) + F.col("l_quantity") * 0.0037).alias("ratio")
    )
    out = op.consensus_of_pairs(r, ["k"], "p")
    return out.select("k", F.round("value", 6).alias("value"), F.round("rel_sigma", 6).alias("rel_sigma"), "inliers")


STAGES = [(1, 2), (2, 3), (3, 5), (4, 6), (5, 7), (2, 6)]


@query(
    "stages_to_run",
    """
    WITH RECURSIVE g(a, b) AS (VALUES (1, 2), (2, 3), (3, 5), (4, 6), (5, 7), (2, 6)),
    c(a, b) AS (SELECT x, x FROM range(1, 8) r(x) UNION SELECT c.a, g.b FROM c JOIN g ON g.a = c.b),
    hit AS (SELECT l_orderkey AS k, l_linenumber AS cause FROM lineitem GROUP BY ALL HAVING bool_or(l_returnflag = 'R') OR min(l_shipdate) >= '1997-01-01')
    SELECT k AS order_id, b AS stage, array_to_string(list_sort(list(DISTINCT cause)), ',') AS causes FROM hit JOIN c ON c.a = cause
    JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) l ON l_orderkey = k AND l_linenumber = b GROUP BY 1, 2
    """,
)
def stages_to_run(t: Tables) -> DataFrame:
    """AGG-9, STR-6: lines as stages of their order; a returned line has another key than before, a
    late one is new, and all stages behind them run again."""
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("stage")).agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("returned"), F.min("l_shipdate").alias("shipped")
    )
    before = rows.filter("shipped < '1997-01-01'").select("order_id", "stage", F.lit("a").alias("cache_key"))
    after = rows.select("order_id", "stage", F.when(F.col("returned"), "b").otherwise("a").alias("cache_key"))
    graph = t.spark.createDataFrame(STAGES, "stage int, next int")
    out = op.rerun_stages(before, after, graph, ["order_id"])
    return out.select("order_id", F.col("stage").cast("bigint").alias("stage"), F.array_join(F.col("causes").cast("array<string>"), ",").alias("causes"))
