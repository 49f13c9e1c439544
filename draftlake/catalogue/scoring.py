"""ML operators on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.catalogue.registry import Tables, query
from draftlake.operators import scoring as op
from draftlake.session import cut_lineage

NAMES = ["log_chars", "line_share", "digit_share"]
# A small hand-made model, so that scoring has an exact SQL form.
MODEL = op.PageModel(
    ["good", "long", "poor"], NAMES, [7.0, 0.01, 0.001], [1.0, 0.02, 0.01], [4.0, 0.0, 0.0], [9.5, 0.05, 0.01],
    [[0.2, 0.5, -1.0], [1.5, -0.2, 0.1], [-1.2, -0.3, 0.9]], [0.3, -0.4, 0.1], 1.5,
)


def doc_features(t: Tables) -> DataFrame:
    n = F.length("text")
    lines = n - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    digits = n - F.length(F.regexp_replace("text", "[0-9]", ""))
    x = F.array(F.log1p(n.cast("double")), lines / n, digits / n)
    return t.spread("documents").select("doc_id", "source", x.alias("x"))


FEATURES_SQL = """f AS (SELECT doc_id, source, ln(1 + length(text)) AS a, (length(text) - length(replace(text, chr(10), ''))) / length(text) AS b,
    (length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))) / length(text) AS c FROM documents),
    z AS (SELECT *, least(greatest(a, 4.0), 9.5) - 7 AS za, (least(greatest(b, 0), 0.05) - 0.01) / 0.02 AS zb, (least(greatest(c, 0), 0.01) - 0.001) / 0.01 AS zc,
      a < 4 - 0.275000001 OR a > 9.5 + 0.275000001 OR b > 0.0525 + 1e-9 OR c > 0.0105 + 1e-9 AS odd FROM f),
    e AS (SELECT *, exp((0.2 * za + 0.5 * zb - zc + 0.3) / 1.5) AS e1, exp((1.5 * za - 0.2 * zb + 0.1 * zc - 0.4) / 1.5) AS e2, exp((-1.2 * za - 0.3 * zb + 0.9 * zc + 0.1) / 1.5) AS e3 FROM z),
    p AS (SELECT *, e1 / (e1 + e2 + e3) AS p1, e2 / (e1 + e2 + e3) AS p2, e3 / (e1 + e2 + e3) AS p3, greatest(e1, e2, e3) / (e1 + e2 + e3) AS top FROM e)"""


@query(
    "scored_documents",
    f"""WITH {FEATURES_SQL} SELECT doc_id, CASE top WHEN p1 THEN 'good' WHEN p2 THEN 'long' ELSE 'poor' END AS label, round(top, 4) AS confidence, odd AS outside, top < 0.8 OR odd AS needs_review FROM p""",
)
def scored_documents(t: Tables) -> DataFrame:
    """ML-3: every document scored with fixed weights."""
    s = op.score(doc_features(t), "x", MODEL)
    return s.select("doc_id", "label", "confidence", (F.size("outside") > 0).alias("outside"), "needs_review")


@query(
    "fused_predictions",
    f"""WITH {FEATURES_SQL}, r AS (SELECT *, round(p1, 4) AS r1, round(p2, 4) AS r2, round(p3, 4) AS r3, CASE top WHEN p1 THEN 'good' WHEN p2 THEN 'long' ELSE 'poor' END AS label,
      CASE WHEN source < 'src15' THEN 'good' ELSE 'long' END AS v, CASE WHEN doc_id % 2 = 0 THEN 0.9 ELSE 0.5 END AS k FROM p),
    g AS (SELECT *, sqrt(greatest(r1, 1e-9) * CASE v WHEN 'good' THEN k ELSE (1 - k) / 2 END) AS g1, sqrt(greatest(r2, 1e-9) * CASE v WHEN 'long' THEN k ELSE (1 - k) / 2 END) AS g2,
      sqrt(greatest(r3, 1e-9) * (1 - k) / 2) AS g3 FROM r),
    h AS (SELECT *, greatest(g1, g2, g3) AS g, g1 + g2 + g3 AS s FROM g)
    SELECT doc_id, CASE g WHEN g1 THEN 'good' WHEN g2 THEN 'long' ELSE 'poor' END AS fused_label, round(g / s, 4) AS fused_confidence,
      (label <> v AND round(top, 4) >= 0.6 AND k >= 0.6) OR (odd AND (label <> v OR k < 0.8)) OR g / s < 0.8 AS fused_review FROM h""",
)
def fused_predictions(t: Tables) -> DataFrame:
    """ML-4: the scores fused with a second opinion made from source and key."""
    s = op.score(doc_features(t), "x", MODEL).withColumns(
        {"other_class": F.when(F.col("source") < "src15", "good").otherwise("long"), "other_confidence": F.when(F.col("doc_id") % 2 == 0, 0.9).otherwise(0.5)}
    )
    return op.fuse_predictions(s, MODEL.classes).select("doc_id", "fused_label", "fused_confidence", "fused_review")


@query("classifier")
def classifier(t: Tables) -> DataFrame:
    """ML-1, ML-2, ML-3, ML-6: quality labels learned, calibrated on every second document, and
    reported per source. A fitted model has no SQL form; the tests compare it with numpy."""
    f = doc_features(t)
    labelled = cut_lineage(f.join(t.labels, "doc_id").withColumn("quality", F.concat(F.lit("q"), "quality")))
    train, held = labelled.filter("doc_id % 2 = 0"), labelled.filter("doc_id % 2 = 1")
    model = op.fit_classifier(train, "x", "quality", NAMES, calibration=held)
    report = op.train_eval_report(train, held, "x", "quality", "source", model)
    return report.withColumns({"macro_f1": F.round("macro_f1", 4), "accuracy": F.round("accuracy", 4)})


@query(
    "seeded_sample",
    """
    WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || ':3'), doc_id) AS draw,
      ('0x' || substr(md5('split:3:' || doc_id), 1, 8))::BIGINT / 4294967296.0 < 0.4 AS scan FROM labels)
    SELECT doc_id, quality, draw, CASE WHEN scan THEN 'scan' ELSE 'vector' END AS part FROM r WHERE draw <= 40
    """,
)
def seeded_sample(t: Tables) -> DataFrame:
    """ML-5: forty labelled documents per class (the operator is a sampler), split by hash."""
    s = op.stratified_seeded_sample(t.labels, "quality", "doc_id", 40, seed=3)
    return s.select("doc_id", "quality", F.col("draw").cast("bigint"), "part")
