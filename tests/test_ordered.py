"""Block-wise scans against pandas, one key holding a third of the rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from draftlake.functions import ordered as o
from draftlake.operators import aggregates as agg
from draftlake.streaming.events import failure_bursts


def frame(n=3000, seed=4):
    rng = np.random.default_rng(seed)
    k = np.where(np.arange(n) % 3 == 0, 0, rng.integers(1, 40, n))
    v = np.round(rng.normal(0, 50, n), 2)
    v[::17] = 0.0
    return pd.DataFrame({"k": k, "id": np.arange(n), "v": v, "w": rng.integers(1, 9, n).astype(float)})


def test_scan(spark):
    pdf = frame()
    df = spark.createDataFrame(pdf)
    got = o.scan(
        df, ["k"], ["v", "id"], o.magnitude_block(F.col("v")), previous={"p": F.col("id")}, running_sum={"s": F.col("w")},
        max_before={"m": F.col("w")}, last_seen={"l": F.when(F.col("id") % 5 == 0, F.col("id"))},
    ).toPandas().sort_values("id").reset_index(drop=True)
    s = pdf.sort_values(["k", "v", "id"])
    g = s.groupby("k")
    s["p"], s["s"] = g["id"].shift(), g["w"].cumsum()
    s["m"] = g["w"].transform(lambda x: x.cummax().shift())
    s["l"] = s["id"].where(s["id"] % 5 == 0)
    s["l"] = s.groupby("k")["l"].ffill()
    want = s.sort_values("id").reset_index(drop=True)
    for c in ("p", "s", "m", "l"):
        assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True), c


def test_islands_and_rank(spark):
    pdf = frame(seed=5)
    got = o.gap_islands(
        spark.createDataFrame(pdf), ["k"], ["v", "id"], o.magnitude_block(F.col("v")), F.col("v"), lambda b: F.col("v") - b < 0.4, rank="rn"
    ).toPandas().sort_values("id").reset_index(drop=True)
    s = pdf.sort_values(["k", "v", "id"])
    cut = ~(s["v"] - s.groupby("k")["v"].shift() < 0.4)
    s["island"], s["rn"] = cut.groupby(s["k"]).cumsum(), s.groupby("k").cumcount() + 1
    want = s.sort_values("id").reset_index(drop=True)
    assert (got["island"] == want["island"]).all() and (got["rn"] == want["rn"]).all()


def test_medians(spark):
    pdf = frame(seed=6)
    df = spark.createDataFrame(pdf)
    got = {r.k: r.median for r in o.median(df, ["k"], "v").collect()}
    want = pdf.groupby("k")["v"].median()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want.index)
    wm = {r.k: r.v for r in o.weighted_median(df, ["k"], "v", "w").collect()}
    for k, g in pdf.groupby("k"):
        g = g.sort_values("v")
        cum = g["w"].cumsum()
        assert wm[k] == g["v"][cum >= g["w"].sum() / 2].iloc[0]


def test_bursts(spark):
    rng = np.random.default_rng(7)
    t = np.sort(rng.integers(0, 40_000, 900))
    pdf = pd.DataFrame({"id": range(900), "client": np.where(np.arange(900) % 3 == 0, "hot", "c" + pd.Series(rng.integers(0, 9, 900)).astype(str)), "ts": pd.to_datetime(t, unit="s")})
    got = {r.id: r.failures for r in failure_bursts(spark.createDataFrame(pdf), "client", "ts", 3, 300).collect()}
    want = {}
    for c, g in pdf.groupby("client"):
        sec = g["ts"].astype("int64").to_numpy() // (10**9 if g["ts"].dtype == "datetime64[ns]" else 1)
        sec = t[g["id"].to_numpy()]
        for i, s in zip(g["id"], sec):
            n = int(((sec <= s) & (sec >= s - 300)).sum())
            if n >= 3:
                want[i] = n
    assert got == want


def test_consensus(spark):
    rows = [("p", r) for r in (0.0100, 0.01005, 0.00995, 0.1, 0.1005, 0.5)] + [("q", 2.0)]
    got = {r.page: r for r in agg.consensus_ratio(spark.createDataFrame(rows, "page string, ratio double"), ["page"]).collect()}
    assert got["p"].inliers == 3 and abs(got["p"].value - 0.01) < 1e-12 and 0.002 <= got["p"].rel_sigma < 0.01
    assert got["q"].inliers == 1 and got["q"].rel_sigma == 0.08


def test_fusion(spark):
    rows = [
        ("a", "stated", 0.01, 0.0005, 1), ("a", "dimensions", 0.01005, 0.003, 9), ("b", "stated", 0.01, 0.0005, 1), ("b", "dimensions", 0.0103, 0.002, 5),
        ("c", "door_prior", 0.011, 0.12, 4), ("c", "scale_bar", 0.0, 0.001, 1),
    ]
    df = spark.createDataFrame(rows, "page string, method string, value double, rel_sigma double, n int")
    got = {r.page: r for r in agg.fuse_estimates(df, ["page"]).collect()}
    assert got["a"].method == "dimensions+stated" and got["a"].value == 0.01 and not got["a"].review
    assert got["b"].conflict and got["b"].value == 0.01 and got["b"].review
    assert got["c"].method == "door_prior" and got["c"].review and not got["c"].conflict


def test_one_exchange_of_the_large_side(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
        got = o.scan(df, ["k"], ["v"], F.floor(F.col("v") / 50), running_sum={"r": F.lit(1)})
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 4  # the rows once; block sums, their window, the carry
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def brute_consensus(pairs, tol=0.01):
    """pairs: lists of readings; the hypothesis most pairs support with their closest reading."""
    best = None
    for r in sorted({v for p in pairs for v in p}):
        near = [min(h, key=lambda v: (abs(v - r), v)) for p in pairs if (h := [v for v in p if abs(v - r) / r <= tol])]
        spread = round(float(np.std(near) / np.mean(near)), 6) if len(near) > 1 else 1.0
        if best is None or (-len(near), spread, r) < best[0]:
            best = ((-len(near), spread, r), near)
    return len(best[1]), float(np.median(best[1]))


def test_consensus_of_pairs(spark):
    rng, rows, want = np.random.default_rng(5), [], {}
    for k in range(60):
        pairs = []
        for p in range(int(rng.integers(1, 12))):
            at = float(rng.choice([1.0, 1.2, 2.0]))
            near = [round(at * (1 + float(rng.normal(0, 0.006))), 6) for _ in range(int(rng.integers(1, 5)))]
            pairs.append(sorted(set(near)))
            rows += [(k, f"p{p}", v) for v in near]
        want[k] = brute_consensus(pairs)
    rows += [(99, "a", 0.0), (99, "a", None), (98, "a", 1.0), (98, "a", 1.005), (98, "a", 1.005), (98, "b", 1.004)]
    df = spark.createDataFrame(rows, "k int, p string, ratio double")
    got = {r.k: (r.inliers, r.value) for r in agg.consensus_of_pairs(df, ["k"], "p").collect()}
    assert set(got) == {*want, 98} and got[98] == (2, 1.0045)  # two readings of one string count once
    for k, (n, value) in want.items():
        assert got[k][0] == n and abs(got[k][1] - value) < 1e-9
    assert agg.consensus_of_pairs(df.filter("k < 0"), ["k"], "p").count() == 0


def test_rerun_stages(spark):
    graph = spark.createDataFrame([(f"s{i}", f"s{i + 1}") for i in range(40)] + [("s40", "x"), ("x", "s40"), (None, "s1")], "stage string, next string")
    before = spark.createDataFrame([("p", f"s{i}", "k") for i in range(41)] + [("q", "s1", "k"), ("q", "s2", None)], "run string, stage string, cache_key string")
    after = spark.createDataFrame(
        [("p", f"s{i}", "k" if i not in (3, 38) else "new") for i in range(41)] + [("p", "x", None), ("q", "s1", "k"), ("q", "s2", None), ("q", "alone", "k")],
        "run string, stage string, cache_key string",
    )
    got = {(r.run, r.stage): r.causes for r in agg.rerun_stages(before, after, graph, ["run"]).collect()}
    assert got[("p", "s37")] == ["s3"] and got[("p", "s40")] == ["s3", "s38"]
    assert set(got) == {("p", f"s{i}") for i in range(3, 41)} | {("p", "x"), ("q", "alone")}


def test_median_orders_the_middle_alone(spark):
    rng = np.random.default_rng(9)
    pdf = pd.concat([frame(2000), pd.DataFrame({"k": 50, "id": 0, "v": [7.5] * 500 + [-1.0] * 500, "w": 1.0}), pd.DataFrame({"k": 51, "id": 0, "v": rng.normal(0, 1e6, 999), "w": 1.0})])
    pdf["k"] = pdf["k"].astype("float").where(pdf["k"] != 3)  # a null key is a key
    df = spark.createDataFrame(pdf).withColumn("k", F.when(~F.isnan("k"), F.col("k").cast("int")))
    out = o.median(df.withColumn("v", F.when(F.col("v") != 0, F.col("v"))), ["k"], "v")
    want = pdf[pdf["v"] != 0].groupby("k", dropna=False)["v"].agg(["median", "count"])
    got = {r.k: (r.median, r.n) for r in out.collect()}
    assert {k: got[k] for k in got if k is not None} == {int(k): (m, n) for k, (m, n) in want.iterrows() if k == k}
    assert got[None] == tuple(want[want.index.isna()].iloc[0])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan and plan.count("Join ") == 1, "every value is joined with its total"
