"""Scores, ratios, robust estimates and reports."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from draftlake.functions.numeric import n_rows
from draftlake.functions.numeric import circular_error, percent_text
from draftlake.functions.ordered import attach, median, scan, weighted_median
from draftlake.session import cut_lineage

# Estimate limits of the scale fusion.
PRECISE_SIGMA = 0.01
CONFLICT_REL = 0.015
WEAK_SIGMA = 0.02
DOOR_RADIUS_M = 0.85
DOOR_SIGMA = 0.12


# ---------------------------------------------------------------- classification


def class_counts(df: DataFrame, truth: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """True positives, false positives, false negatives and F1 per class. The table is reduced to
    its confusion matrix first."""
    matrix = df.groupBy(*keys, truth, pred).agg(n_rows().alias("__n"))
    role = lambda cls, tp, fp, fn: F.struct(
        F.col(cls).alias("class"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn")
    )
    n, zero = F.col("__n"), F.lit(0).cast("bigint")
    same = F.col(truth) == F.col(pred)
    roles = F.when(same, F.array(role(truth, n, zero, zero))).otherwise(
        F.array(role(pred, zero, n, zero), role(truth, zero, zero, n))
    )
    out = matrix.select(*keys, F.inline(roles)).groupBy(*keys, "class").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")
    )
    return out.withColumn("f1", 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))


def macro_f1(df: DataFrame, truth: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean F1 over the classes that occur, accuracy and row count per key."""
    per_class = class_counts(df, truth, pred, keys)
    scores = per_class.groupBy(*keys).agg(
        F.avg("f1").alias("macro_f1"), F.sum("tp").alias("__tp"), (F.sum("tp") + F.sum("fn")).alias("n")
    )
    return scores.withColumn("accuracy", F.col("__tp") / F.col("n")).drop("__tp")


def score_report(df: DataFrame, truth: str, pred: str, source: str) -> DataFrame:
    """macro_f1 for every source and, as source ``all``, overall. One pass over the data: the
    overall row is added to the matrix of the sources."""
    small = df.groupBy(source, truth, pred).agg(n_rows().alias("__c"))
    both = small.select(F.explode(F.array(F.col(source), F.lit("all"))).alias(source), truth, pred, "__c")
    wide = both.groupBy(source, truth, pred).agg(F.sum("__c").alias("__n"))
    hit = F.col(truth) == F.col(pred)
    t = wide.groupBy(source, F.col(truth).alias("class")).agg(
        F.sum("__n").alias("t"), F.sum(F.when(hit, F.col("__n")).otherwise(0)).alias("tp")
    )
    p = wide.groupBy(source, F.col(pred).alias("class")).agg(F.sum("__n").alias("p"))
    j = t.join(p, [source, "class"], "full_outer").fillna(0, ["t", "tp", "p"])
    return j.groupBy(source).agg(
        F.avg(2 * F.col("tp") / (F.col("t") + F.col("p"))).alias("macro_f1"),
        (F.sum("tp") / F.sum("t")).alias("accuracy"), F.sum("t").alias("n"),
    )


def confusions(df: DataFrame, truth: str, pred: str, k: int = 5) -> DataFrame:
    """The k most frequent wrong pairs (a top-k report)."""
    wrong = df.filter(F.col(truth) != F.col(pred)).groupBy(truth, pred).agg(n_rows().alias("n"))
    return wrong.orderBy(F.desc("n"), truth, pred).limit(k)


def review_rates(df: DataFrame, truth: str, pred: str, review: str) -> DataFrame:
    return df.agg(
        F.avg(F.col(review).cast("double")).alias("review_rate"),
        F.count_if((F.col(truth) != F.col(pred)) & ~F.col(review)).alias("errors_not_reviewed"),
    )


def ratio_metrics(df: DataFrame, keys: Sequence[str], metrics: dict[str, tuple[str, str]]) -> DataFrame:
    """Σhits/Σtotal as text with percent per metric, 'n/a' when nothing was measured."""
    aggs = [F.sum(c).alias(f"__{n}{i}") for n, pair in metrics.items() for i, c in enumerate(pair)]
    out = df.groupBy(*keys).agg(*aggs)
    return out.select(*keys, *[percent_text(F.col(f"__{n}0"), F.col(f"__{n}1")).alias(n) for n in metrics])


def angle_errors(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    err = circular_error(F.col(a), F.col(b))
    return df.groupBy(*keys).agg(
        F.count(err).alias("measured"), F.count_if(err.isNull()).alias("missing"),
        F.avg(err).alias("mean_err"), F.max(err).alias("max_err"),
    )


def char_accuracy(truth: Column, got: Column) -> Column:
    """1 − Levenshtein/length of the truth, at least 0; an empty truth is right only if nothing
    was read."""
    share = 1 - F.levenshtein(truth, got) / F.length(truth)
    return F.when(F.length(truth) == 0, (F.length(got) == 0).cast("double")).otherwise(
        F.greatest(F.lit(0.0), share)
    )


def best_char_accuracy(pairs: DataFrame, item: Sequence[str], truth: str, got: str) -> DataFrame:
    """Best reading per truth item; items without reading count 0."""
    return pairs.groupBy(*item).agg(
        F.coalesce(F.max(char_accuracy(F.col(truth), F.col(got))), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.max((F.col(truth) == F.col(got)).cast("int")), F.lit(0)).alias("exact"),
    )


def class_iou(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Intersection over union of two label columns per class, from the confusion matrix."""
    c = class_counts(df, truth, pred)
    return c.select("class", F.try_divide("tp", F.col("tp") + F.col("fp") + F.col("fn")).alias("iou"))


def class_freq(df: DataFrame, label: str) -> DataFrame:
    """Share of every class; totals are taken over the class counts, not over the rows."""
    per = df.groupBy(F.col(label).alias("class")).agg(n_rows().alias("n"))
    return per.withColumn("share", F.col("n") / per.agg(F.sum("n")).scalar())


# ---------------------------------------------------------------- robust estimates


def consensus_ratio(
    readings: DataFrame, keys: Sequence[str], ratio: str = "ratio", tol: float = 0.01
) -> DataFrame:
    """Ratio supported by most readings per key: (value, sigma, inliers).

    Every reading is a hypothesis; its inliers lie within ``tol``. Most inliers win, then the
    smaller relative spread, then the smaller ratio; value is the inliers' median, sigma from
    their MAD. The readings of one dimension string must differ by more than 2·tol, as readings in
    other units do, so an inlier is one string. Hypotheses are not paired with readings: equal
    ratios are combined, and counts and moments come from a range window in overlapping log blocks.
    """
    keys = list(keys)
    ln = F.log(F.col(ratio))
    width = 2.5 * tol
    points = readings.filter(F.col(ratio) > 0).groupBy(*keys, ratio).agg(n_rows().alias("__n")).withColumn("__ln", ln)
    home = F.floor(F.col("__ln") / width).cast("bigint")
    spread_out = points.withColumn("__home", home).withColumn(
        "__blk", F.explode(F.sequence(F.col("__home") - 1, F.col("__home") + 1))
    )
    # range frames take whole numbers: logs in units of 1e-12
    lo, hi = math.floor(math.log(1 - tol) * 1e12), math.ceil(math.log(1 + tol) * 1e12)
    frame = W.partitionBy(*keys, "__blk").orderBy(F.round(F.col("__ln") * 1e12).cast("bigint")).rangeBetween(lo, hi)
    n, x = F.col("__n"), F.col(ratio)
    scored = spread_out.select(
        *keys, ratio, "__home", "__blk",
        F.sum(n).over(frame).alias("cnt"), F.sum(n * x).over(frame).alias("s1"), F.sum(n * x * x).over(frame).alias("s2"),
    ).filter("__home = __blk")
    mean = F.col("s1") / F.col("cnt")
    var = F.greatest(F.col("s2") / F.col("cnt") - mean * mean, F.lit(0.0))
    # hypotheses with equal inliers have equal spread; rounding keeps float noise from deciding
    spread = F.when(F.col("cnt") > 1, F.round(F.sqrt(var) / mean, 9)).otherwise(1.0)
    best = scored.groupBy(*keys).agg(
        F.max_by(F.col(ratio), F.struct("cnt", -spread, -F.col(ratio))).alias("__best")
    )
    inliers = attach(readings.filter(F.col(ratio) > 0), best, keys).filter(
        F.abs(F.col(ratio) - F.col("__best")) / F.col("__best") <= tol
    )
    return _agreed(inliers, keys, ratio)


def consensus_of_pairs(
    readings: DataFrame, keys: Sequence[str], pair: str, ratio: str = "ratio", tol: float = 0.01
) -> DataFrame:
    """Ratio supported by most pairs per key, where a pair (a dimension string and its line) has
    several readings and counts once, with the reading closest to the hypothesis: (value, rel_sigma,
    inliers). Choice and result as in ``consensus_ratio``; of two equally close readings the smaller.

    A reading is the closest of its pair for the hypotheses between the middles to its neighbours, so
    it supports one interval of hypotheses and intervals of a pair do not overlap. Intervals enter and
    leave in one ordered scan that carries count, sum and sum of squares; sums are decimals, so that
    what entered leaves without a rest."""
    keys = list(keys)
    x = F.col(ratio)
    log = lambda v: F.log(v) * 1e12
    points = readings.filter(x > 0).select(*keys, pair, ratio).distinct()
    own = W.partitionBy(*keys, pair).orderBy(ratio)
    middle = lambda other: log((x + other) / 2)
    spans = points.select(*keys, ratio, F.lag(ratio).over(own).alias("__prev"), F.lead(ratio).over(own).alias("__next"))
    low, high = F.floor(log(x / (1 + tol))), F.ceil(log(x / (1 - tol)))
    spans = spans.select(
        *keys, ratio, F.greatest(low, F.round(middle(F.col("__prev")))).cast("bigint").alias("lo"),
        F.least(high, F.round(middle(F.col("__next")))).cast("bigint").alias("hi"),
        (F.col("__prev").isNotNull() & (F.round(middle(F.col("__prev"))) >= low)).alias("after"),
    ).filter("lo <= hi")
    exact, square = x.cast("decimal(24,12)"), (x * x).cast("decimal(30,16)")
    # at one place: what enters, then hypotheses, then what leaves or enters behind the place
    enter = spans.select(*keys, F.col("lo").alias("at"), F.when(F.col("after"), 2).otherwise(0).alias("turn"), F.lit(None).cast("double").alias("h"),
                         F.lit(1).alias("n"), exact.alias("s1"), square.alias("s2"))
    leave = spans.select(*keys, F.col("hi").alias("at"), F.lit(2).alias("turn"), F.lit(None).cast("double").alias("h"),
                         F.lit(-1).alias("n"), (-exact).cast("decimal(24,12)").alias("s1"), (-square).cast("decimal(30,16)").alias("s2"))
    ask = points.select(*keys, ratio).distinct().select(
        *keys, F.round(log(x)).cast("bigint").alias("at"), F.lit(1).alias("turn"), x.cast("double").alias("h"), F.lit(0).alias("n"),
        F.lit(0).cast("decimal(24,12)").alias("s1"), F.lit(0).cast("decimal(30,16)").alias("s2"),
    )
    events = enter.unionByName(leave).unionByName(ask)
    swept = scan(
        events, keys, ["at", "turn", "h"], F.floor(F.col("at") / 1e10).cast("bigint"),
        running_sum={"cnt": F.col("n"), "t1": F.col("s1"), "t2": F.col("s2")},
    ).filter("h is not null")
    mean, meansq = F.col("t1").cast("double") / F.col("cnt"), F.col("t2").cast("double") / F.col("cnt")
    spread = F.when(F.col("cnt") > 1, F.round(F.sqrt(F.greatest(meansq - mean * mean, F.lit(0.0))) / mean, 6)).otherwise(1.0)
    best = swept.groupBy(*keys).agg(F.max_by("h", F.struct("cnt", -spread, -F.col("h"))).alias("__best"))
    away = F.abs(x - F.col("__best"))
    near = attach(points, best, keys).filter(away / F.col("__best") <= tol + 1e-12)
    inliers = near.groupBy(*keys, pair).agg(F.min_by(ratio, F.struct(F.round(away / F.col("__best"), 12).alias("away"), x.alias("x"))).alias(ratio))
    return _agreed(inliers, keys, ratio)


def _agreed(inliers: DataFrame, keys: list[str], ratio: str) -> DataFrame:
    """Median of the inliers and its relative uncertainty from their MAD; 0.08 for a single one."""
    value = median(inliers, keys, ratio, "value")
    dev = attach(inliers, value.select(*keys, "value"), keys).withColumn("__dev", F.abs(F.col(ratio) - F.col("value")))
    mad = median(dev, keys, "__dev", "__mad").drop("n")
    out = attach(value, mad, keys)
    rel = F.col("__mad") / F.col("value")
    sigma = F.when(F.col("n") > 1, F.greatest(F.lit(0.002), 1.4826 * rel / F.sqrt("n"))).otherwise(0.08)
    return out.select(*keys, "value", sigma.alias("rel_sigma"), F.col("n").alias("inliers"))


def door_prior(radii: DataFrame, keys: Sequence[str], radius: str = "radius") -> DataFrame:
    """Scale from the median door swing, where at least two were drawn."""
    m = median(radii.filter(F.col(radius) > 0), keys, radius, "__r").filter("n >= 2")
    return m.select(
        *keys, F.lit("door_prior").alias("method"), (DOOR_RADIUS_M / F.col("__r")).alias("value"),
        F.lit(DOOR_SIGMA).alias("rel_sigma"), "n",
    )


def fuse_estimates(estimates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One scale per key from (method, value, rel_sigma, n).

    Two precise estimates conflict exactly when the extreme ones do, so minimum and maximum decide.
    A conflict or no precise estimate proposes the lowest sigma; otherwise the median weighted with
    1/σ². ``review`` marks conflicts and estimates weaker than 2 %.
    """
    keys = list(keys)
    ests = estimates.filter(F.col("value") > 0)
    precise = F.col("rel_sigma") <= PRECISE_SIGMA
    pick = F.struct("value", "rel_sigma", "method", "n")
    order = F.struct("rel_sigma", "method", "value")
    summary = ests.groupBy(*keys).agg(
        F.count_if(precise).alias("__precise"),
        F.min(F.when(precise, F.col("value"))).alias("__lo"),
        F.max(F.when(precise, F.col("value"))).alias("__hi"),
        F.min_by(pick, order).alias("__best"),
        (1 / F.sqrt(F.sum(F.when(precise, 1 / (F.col("rel_sigma") * F.col("rel_sigma")))))).alias("__sigma"),
        F.array_join(F.array_sort(F.collect_set(F.when(precise, F.col("method")))), "+").alias("__methods"),
        F.sum(F.when(precise, F.col("n"))).alias("__n"),
    )
    weights = ests.filter(precise).withColumn("__wt", 1 / (F.col("rel_sigma") * F.col("rel_sigma")))
    med = weighted_median(weights, keys, "value", "__wt").select(*keys, F.col("value").alias("__med"))
    out = attach(summary, med, keys, "left")
    conflict = F.coalesce((F.col("__hi") - F.col("__lo")) / F.col("__lo") > CONFLICT_REL, F.lit(False))
    fused = (F.col("__precise") > 0) & ~conflict
    sigma = F.when(fused, F.col("__sigma")).otherwise(F.col("__best.rel_sigma"))
    return out.select(
        *keys,
        F.when(fused, F.col("__med")).otherwise(F.col("__best.value")).alias("value"),
        sigma.alias("rel_sigma"),
        F.when(fused, F.col("__methods")).otherwise(F.col("__best.method")).alias("method"),
        F.when(fused, F.col("__n")).otherwise(F.col("__best.n")).alias("n"),
        conflict.alias("conflict"),
        (conflict | (sigma > WEAK_SIGMA)).alias("review"),
    )


def line_deviation(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Length-weighted median tilt of long (≥ 20), nearly straight (≤ 10°) lines."""
    usable = lines.filter((F.col("length") >= 20) & (F.col("tilt") <= 10))
    return weighted_median(usable, keys, "tilt", "length")


def fit_scale_shift(df: DataFrame, keys: Sequence[str], pred: str, truth: str) -> DataFrame:
    """Least squares truth ≈ scale·pred + shift per key, with the mean relative error of the raw
    prediction where the truth is above 1e-3."""
    ok = F.col(truth) > 1e-3
    return df.groupBy(*keys).agg(
        F.regr_slope(truth, pred).alias("scale"), F.regr_intercept(truth, pred).alias("shift"),
        F.avg(F.when(ok, F.abs(F.col(pred) - F.col(truth)) / F.col(truth))).alias("abs_rel"),
    )


def mad_noise(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median and median absolute deviation per key, both exact."""
    m = median(df, keys, value, "median")
    dev = attach(df, m.select(*keys, "median"), keys).withColumn("__d", F.abs(F.col(value) - F.col("median")))
    return attach(m, median(dev, keys, "__d", "mad").drop("n"), keys)


def mean_vectors(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Element-wise mean of array columns, long form (keys, dim, mean)."""
    e = df.select(*keys, F.posexplode(vector).alias("dim", "v"))
    return e.groupBy(*keys, "dim").agg(F.avg("v").alias("mean"))


def vector_shift(means: DataFrame, key: str, reference: Column) -> DataFrame:
    """Euclidean distance of every key's mean vector from the reference key's."""
    ref = means.filter(F.col(key) == reference).select("dim", F.col("mean").alias("__ref"))
    d = F.col("mean") - F.col("__ref")
    return means.join(ref, "dim").groupBy(key).agg(F.sqrt(F.sum(d * d)).alias("shift"))


# ---------------------------------------------------------------- reports


def stage_timings(runs: DataFrame, keys: Sequence[str] = ("stage",)) -> DataFrame:
    """Seconds, calls, cached share and failures per stage."""
    return runs.groupBy(*keys).agg(
        n_rows().alias("calls"), F.sum("seconds").alias("seconds"),
        F.avg(F.col("cached").cast("double")).alias("cached_share"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.avg("attempts").alias("mean_attempts"),
    )


def changed_stages(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stages of a run whose key is new or differs from the run before."""
    b = before.select(*keys, F.col("cache_key").alias("__b"))
    return after.join(b, list(keys), "left").filter(~F.col("cache_key").eqNullSafe(F.col("__b"))).drop("__b")


def stages_behind(graph: DataFrame) -> DataFrame:
    """(stage, behind) All stages that use a stage's result, directly or over others, and the stage
    itself; ``graph`` has (stage, next). The reach doubles per round, so a chain of n takes log2(n)
    joins and circles end; the table is bounded by the square of the stages, whatever the projects."""
    edges = graph.select("stage", F.col("next").alias("behind")).where("stage is not null and next is not null").distinct()
    ends = edges.select("stage").union(edges.select("behind")).distinct()
    reach = cut_lineage(edges.union(ends.select("stage", F.col("stage").alias("behind"))).distinct())
    size = reach.count()
    while True:
        on = reach.select(F.col("stage").alias("__mid"), F.col("behind").alias("__far"))
        reach = cut_lineage(reach.join(on, F.col("behind") == F.col("__mid")).select("stage", F.col("__far").alias("behind")).distinct())
        grown = reach.count()
        if grown == size:
            return reach
        size = grown


def rerun_stages(before: DataFrame, after: DataFrame, graph: DataFrame, keys: Sequence[str], stage: str = "stage") -> DataFrame:
    """(keys…, stage, causes) of the stages to run again: those whose key changed and all behind them
    in ``graph`` (stage, next) that the run has; ``causes`` are the changed stages they depend on.
    ``keys`` name the project or run, without the stage."""
    keys = list(keys)
    changed = changed_stages(before, after, [*keys, stage]).select(*keys, F.col(stage).alias("__cause"))
    behind = stages_behind(graph).select(F.col("stage").alias("__from"), F.col("behind").alias("__to"))
    met = changed.join(behind, F.col("__cause") == F.col("__from"), "left").select(
        *keys, F.coalesce("__to", "__cause").alias(stage), "__cause"
    )
    causes = met.groupBy(*keys, stage).agg(F.sort_array(F.collect_set("__cause")).alias("causes"))
    return causes.join(after.select(*keys, stage).distinct(), [*keys, stage], "left_semi")


def target_verdict(
    rows: DataFrame, targets: DataFrame, source: str, at_least: Sequence[str], at_most: Sequence[str]
) -> DataFrame:
    """Means (``at_least``) and maxima (``at_most``) per source and the list of missed targets; a
    value that was not measured is a miss."""
    got = rows.groupBy(source).agg(
        *[F.avg(c).alias(c) for c in at_least], *[F.max(c).alias(c) for c in at_most]
    )
    want = targets.select(source, *[F.col(c).alias(f"__{c}") for c in (*at_least, *at_most)])
    misses = [
        F.when(F.col(f"__{c}").isNotNull() & F.coalesce(F.col(c) < F.col(f"__{c}"), F.lit(True)), c) for c in at_least
    ] + [
        F.when(F.col(f"__{c}").isNotNull() & F.coalesce(F.col(c) > F.col(f"__{c}"), F.lit(True)), c) for c in at_most
    ]
    j = got.join(want, source, "left").withColumn("misses", F.array_compact(F.array(*misses)))
    return j.select(source, *at_least, *at_most, "misses", (F.size("misses") == 0).alias("ok"))


def detection_rate(injected: DataFrame, issues: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per code: injected defects and those whose every element is reported under the code.
    ``injected`` has one row per (keys…, defect_id, code, element); ``issues`` per (keys…, code, element)."""
    on = [*keys, "code", "element"]
    found = issues.select(*on).distinct().withColumn("__hit", F.lit(1))
    per = injected.join(found, on, "left").groupBy(*keys, "defect_id", "code").agg(
        F.every(F.col("__hit").isNotNull()).alias("hit")
    )
    return per.groupBy("code").agg(n_rows().alias("defects"), F.count_if("hit").alias("detected"))


def run_view(runs: DataFrame, gates: DataFrame, bundles: DataFrame) -> DataFrame:
    """Runs with their gates as an ordered array (one per gate name, so bounded) and the newest
    bundle."""
    rest = [c for c in gates.columns if c not in ("run_id", "gate", "decided_at")]
    one = gates.groupBy("run_id", "gate").agg(F.max_by(F.struct(*rest), F.struct("decided_at", *rest)).alias("g"))
    g = one.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("gate", "g.*"))).alias("gates"))
    b = bundles.groupBy("run_id").agg(F.max_by("bundle_id", F.struct("created_at", "bundle_id")).alias("bundle_id"))
    return runs.join(g, "run_id", "left").join(b, "run_id", "left")
