"""Connected components and tables of the many short steps that lead to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.session import cut_lineage


def compact(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """The written table in tasks of about ``rows`` rows where it came in more and smaller ones, so that
    the many short steps on small tables do not each write a file per partition."""
    kept = cut_lineage(df)
    return kept.coalesce(max(1, -(-kept.count() // rows)))


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Smallest id reachable from every id that has an edge: (id, component).

    Alternating large-star and small-star rounds (Kiveris and others, 2014): every round links the
    neighbours of a vertex to the smallest of them, so stars form after about log(n) rounds. A
    vertex with many neighbours is met by a combined minimum and a join that adaptive execution may
    split; no neighbourhood is ever collected. Self-loops and repeated edges are allowed."""
    pairs = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    pairs = compact(pairs.where("u <> v").distinct())
    state = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        pairs = compact(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        low = pairs.groupBy("u").agg(F.min("v").alias("m"))
        stars = pairs.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v"))
        )).alias("e")).select("e.u", "e.v")
        pairs = compact(stars.where("u <> v").distinct())
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == now:
            break
        state = now
    ends = pairs.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return ends.union(roots)
