"""Page classifier: fit, calibrate, score, fuse, sample."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.functions.numeric import dot, softmax
from draftlake.operators.aggregates import score_report

# Review limits, temperature range.
REVIEW_THRESHOLD = 0.8
CONFIDENT = 0.6
MAX_TEMPERATURE = 20.0


@dataclass
class PageModel:
    """Weights of a fitted classifier; size is features × classes, whatever the training data."""

    classes: list[str]
    features: list[str]
    mean: list[float]
    std: list[float]
    lo: list[float]
    hi: list[float]
    weights: list[list[float]]
    bias: list[float]
    temperature: float = 1.0
    info: dict = field(default_factory=dict)


def _numbers(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def feature_stats(df: DataFrame, features: str) -> list[tuple[float, float, float, float]]:
    """(mean, population std, min, max) per position: one combined aggregate; the result has one
    row per feature."""
    rows = (
        df.select(F.posexplode(features).alias("i", "v")).groupBy("i")
        .agg(F.avg("v"), F.stddev_pop("v"), F.min("v"), F.max("v")).orderBy("i").collect()
    )
    return [(r[1], r[2] if r[2] >= 1e-9 else 1.0, r[3], r[4]) for r in rows]


def _standardised(x: Column, model: PageModel) -> Column:
    """Clipped to the range seen in training and standardised; without position lookups."""
    above = F.zip_with(x, _numbers(model.lo), lambda v, b: F.greatest(v, b))
    clipped = F.zip_with(above, _numbers(model.hi), lambda v, b: F.least(v, b))
    shifted = F.zip_with(clipped, _numbers(model.mean), lambda v, m: v - m)
    return F.zip_with(shifted, _numbers(model.std), lambda v, s: v / s)


def logits(x: Column, model: PageModel) -> Column:
    z = _standardised(x, model)
    rows = F.array(*[F.struct(_numbers(w).alias("w"), F.lit(float(b)).alias("b")) for w, b in zip(model.weights, model.bias)])
    return F.element_at(F.transform(F.array(z), lambda v: F.transform(rows, lambda r: dot(v, r["w"]) + r["b"])), 1)


def fit_classifier(
    train: DataFrame, features: str, label: str, names: Sequence[str], l2: float = 1e-2,
    calibration: DataFrame | None = None,
) -> PageModel:
    """L2-regularised multinomial logistic regression on standardised features; the ranges cover the
    calibration rows too. With calibration rows the temperature is fitted as well."""
    classes = [r[0] for r in train.select(label).distinct().orderBy(label).collect()]
    stats = feature_stats(train, features)
    seen = stats if calibration is None else feature_stats(train.select(features).unionAll(calibration.select(features)), features)
    model = PageModel(
        classes, list(names), [s[0] for s in stats], [s[1] for s in stats], [s[2] for s in seen], [s[3] for s in seen], [], []
    )
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)).cast("double") - 1
    prepared = train.select(array_to_vector(_standardised(F.col(features), model)).alias("x"), index.alias("y"))
    lr = LogisticRegression(
        featuresCol="x", labelCol="y", family="multinomial", regParam=l2, elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-9
    )
    fitted = lr.fit(prepared)
    model.weights = [list(map(float, row)) for row in fitted.coefficientMatrix.toArray()]
    model.bias = [float(b) for b in fitted.interceptVector]
    model.info = {"iterations": fitted.summary.totalIterations, "rows": fitted.summary.predictions.count()}
    if calibration is not None:
        held_out = calibration.select(logits(F.col(features), model).alias("logits"), F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)).alias("y"))
        model.temperature = calibrate_temperature(held_out)
    return model


def calibrate_temperature(held_out: DataFrame, steps: int = 40, rounds: int = 4) -> float:
    """T in [1, 20] with the lowest negative log likelihood of ``logits`` and one-based ``y``. Every
    round is one scan that averages the loss on a grid, then the grid narrows."""
    lo, hi = 1.0, MAX_TEMPERATURE
    best = lo
    for _ in range(rounds):
        grid = [lo + (hi - lo) * i / steps for i in range(steps + 1)]
        loss = [F.avg(-F.log(F.element_at(softmax(F.col("logits"), t), F.col("y").cast("int")) + 1e-12)) for t in grid]
        row = held_out.agg(*[e.alias(f"t{i}") for i, e in enumerate(loss)]).first()
        if row is None or row[0] is None:
            return 1.0
        k = min(range(len(grid)), key=lambda i: (row[i], i))
        best = grid[k]
        lo, hi = grid[max(0, k - 1)], grid[min(steps, k + 1)]
    return best


def score(df: DataFrame, features: str, model: PageModel) -> DataFrame:
    """Adds label, confidence, probabilities (4 decimals), outside (features out of range by 5 %) and
    needs_review. Row-wise; the weights are literals of bounded size."""
    p = F.col("__p")
    tol = [0.05 * (h - low) + 1e-9 for low, h in zip(model.lo, model.hi)]
    bounds = F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(float(low - t)).alias("lo"), F.lit(float(h + t)).alias("hi"))
        for n, low, h, t in zip(model.features, model.lo, model.hi, tol)
    ])
    odd = F.zip_with(F.col(features), bounds, lambda v, b: F.when((v < b["lo"]) | (v > b["hi"]), b["name"]))
    names = F.array(*[F.lit(c) for c in model.classes])
    scored = df.withColumn("__p", softmax(logits(F.col(features), model), model.temperature))
    top = F.array_max(p)
    return scored.withColumns(
        {
            "label": F.element_at(names, F.array_position(p, top).cast("int")),
            "confidence": F.round(top, 4),
            "probabilities": F.map_from_arrays(names, F.transform(p, lambda v: F.round(v, 4))),
            "outside": F.array_compact(odd),
        }
    ).withColumn("needs_review", (top < REVIEW_THRESHOLD) | (F.size("outside") > 0)).drop("__p")


def fuse_predictions(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Geometric mean of the model's ``probabilities`` and a second opinion (``other_class``,
    ``other_confidence``, the rest spread evenly). Review on confident disagreement, on pages outside
    the training range that the second opinion does not confirm, and below 0.8."""
    k = len(classes)
    names = F.array(*[F.lit(c) for c in classes])
    c = F.least(F.greatest(F.coalesce("other_confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    clip = lambda v: F.least(F.greatest(v, F.lit(1e-9)), F.lit(1.0))
    raw = F.transform(
        names,
        lambda n: F.sqrt(
            clip(F.coalesce(F.element_at("probabilities", n), F.lit(0.0)))
            * clip(F.when(n == F.col("other_class"), c).otherwise((1.0 - c) / (k - 1)))
        ),
    )
    out = df.withColumn("__raw", raw)
    total = F.aggregate("__raw", F.lit(0.0), lambda s, v: s + v)
    shared = F.transform(F.array(total), lambda t: F.transform("__raw", lambda v: v / t))
    out = out.withColumn("__comb", F.element_at(shared, 1))
    top = F.array_max("__comb")
    other_is_same = F.coalesce(F.col("label") == F.col("other_class"), F.lit(False))
    disagree = ~other_is_same & (F.col("confidence") >= CONFIDENT) & (c >= CONFIDENT)
    unconfirmed = (F.size("outside") > 0) & (~other_is_same | (c < REVIEW_THRESHOLD))
    return out.withColumns(
        {
            "fused_label": F.element_at(names, F.array_position("__comb", top).cast("int")),
            "fused_confidence": F.round(top, 4),
            "fused_review": disagree | unconfirmed | (top < REVIEW_THRESHOLD),
        }
    ).drop("__raw", "__comb")


def seeded_order(row_id: Column, seed: int) -> Column:
    return F.md5(F.concat(row_id.cast("string"), F.lit(f":{seed}")))


def train_eval_report(train: DataFrame, calibration: DataFrame, features: str, label: str, source: str, model: PageModel) -> DataFrame:
    """Per source and overall (``all``): training and calibration rows, macro F1 and accuracy of the
    model on the calibration rows."""
    scored = score(calibration, features, model).withColumnRenamed("label", "__pred")
    result = score_report(scored, label, "__pred", source).withColumnRenamed("n", "calibration_rows")
    per = train.groupBy(source).agg(F.count(F.lit(1)).alias("__n"))
    counts = per.select(F.explode(F.array(F.col(source), F.lit("all"))).alias(source), "__n")
    counts = counts.groupBy(source).agg(F.sum("__n").alias("train_rows"))
    return counts.join(result, source, "full_outer").fillna(0, ["train_rows", "calibration_rows"])


def stratified_seeded_sample(
    df: DataFrame, klass: str, row_id: str, per_class: int, seed: int, fraction: float = 0.4
) -> DataFrame:
    """The same ``per_class`` rows of each class for the same seed, with a reproducible split: about
    ``fraction`` of the rows go to 'scan', the others to 'vector'. Spark keeps per_class rows of a
    group before the shuffle, so a dominant class is no bottleneck."""
    from pyspark.sql import Window as W

    key = seeded_order(F.col(row_id), seed)
    w = W.partitionBy(klass).orderBy("__key", row_id)
    part = F.conv(F.substring(F.md5(F.concat(F.lit(f"split:{seed}:"), F.col(row_id).cast("string"))), 1, 8), 16, 10).cast("bigint")
    ranked = df.withColumn("__key", key).withColumn("draw", F.row_number().over(w)).filter(F.col("draw") <= per_class)
    return ranked.withColumn("part", F.when(part / float(2**32) < fraction, "scan").otherwise("vector")).drop("__key")
