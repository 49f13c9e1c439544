"""Two versions of a plan compared: wall lines within tolerances, rooms by overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.functions.geometry import overlap_m2, polygon_area
from draftlake.functions.numeric import f1
from draftlake.functions.ordered import attach
from draftlake.functions.polygons import upright
from draftlake.operators.joins import coverage, within_tolerance
from draftlake.plans.tables import flat_lines, sample_lines


def wall_scores(predicted: DataFrame, truth: DataFrame, keys: Sequence[str], tol: float = 0.05) -> DataFrame:
    """(keys…, precision, recall, f1) of two sets of wall lines (as from ``wall_lines``): the shares of
    points every 2 cm along the lines of one set that lie on a line of the other, in place, direction
    and thickness. A side without lines has share 0; keys of either set are listed."""
    keys = list(keys)

    def share(mine: DataFrame, other: DataFrame, name: str) -> DataFrame:
        points = sample_lines(mine, keys)
        hits = within_tolerance(points, flat_lines(other, keys), keys, tol)
        return coverage(points, hits, keys).select(*keys, F.col("share").alias(name))

    both = predicted.select(*keys).unionByName(truth.select(*keys)).distinct()
    out = attach(attach(both, share(predicted, truth, "precision"), keys, "left"), share(truth, predicted, "recall"), keys, "left")
    p, r = F.coalesce("precision", F.lit(0.0)), F.coalesce("recall", F.lit(0.0))
    return out.select(*keys, p.alias("precision"), r.alias("recall"), F.coalesce(f1(p, r), F.lit(0.0)).alias("f1"))


def room_overlaps(new: DataFrame, old: DataFrame, keys: Sequence[str], cell: float = 4.0) -> DataFrame:
    """(keys…, new_id, new_area, old_id, old_area, overlap, iou) of rooms (id, polygon, holes) of two
    versions that share area. Pairs meet in grid cells of their boxes, each in one cell. Upright
    rectangles overlap like their boxes; pairs with another shape, with holes or concave, are met apart
    and go to the exact overlap, so rings and Python rows are theirs alone."""
    keys = list(keys)
    none = F.array().cast("array<array<struct<x:double,y:double>>>")

    plain = upright(F.col("polygon")) & (F.size(F.coalesce("holes", none)) == 0)

    def boxed(df: DataFrame, side: str, with_rings: bool) -> DataFrame:
        edge = lambda k, agg: agg(F.transform("polygon", lambda p: p[k]))
        rings = [F.concat(F.array("polygon"), F.coalesce("holes", none)).alias(f"{side}_rings")] if with_rings else []
        out = df.select(
            *[F.col(k).alias(f"{side}{k}") for k in keys], F.col("id").alias(f"{side}_id"), polygon_area(F.col("polygon"), F.col("holes")).alias(f"{side}_area"),
            *rings, *[edge(k, agg).alias(f"{side}_{k}{n}") for k in ("x", "y") for n, agg in ((0, F.array_min), (1, F.array_max))],
        )
        span = lambda k: F.sequence(*[F.floor(F.col(f"{side}_{k}{n}") / cell).cast("bigint") for n in (0, 1)])
        out = out.withColumn("gx", F.explode(span("x"))).withColumn("gy", F.explode(span("y")))
        return out.withColumn(f"__{side}", F.struct(*[F.col(f"{side}{k}") for k in keys], "gx", "gy"))

    width = F.least("new_x1", "old_x1") - F.greatest("new_x0", "old_x0")
    height = F.least("new_y1", "old_y1") - F.greatest("new_y0", "old_y0")
    home = (F.floor(F.greatest("new_x0", "old_x0") / cell) == F.col("gx")) & (F.floor(F.greatest("new_y0", "old_y0") / cell) == F.col("gy"))

    def met(mine: DataFrame, other: DataFrame, exact: bool) -> DataFrame:
        a, b = boxed(mine, "new", exact), boxed(other, "old", exact).drop("gx", "gy")
        overlap = overlap_m2(F.col("new_rings"), F.col("old_rings")) if exact else width * height
        return a.join(b, (F.col("__new") == F.col("__old")) & home & (width > 0) & (height > 0)).select(
            *[F.col(f"new{k}").alias(k) for k in keys], "new_id", "new_area", "old_id", "old_area", overlap.alias("overlap"),
        )

    pairs = met(new.filter(plain), old.filter(plain), False)
    pairs = pairs.unionByName(met(new.filter(~plain), old, True)).unionByName(met(new.filter(plain), old.filter(~plain), True))
    iou: Column = F.col("overlap") / (F.col("new_area") + F.col("old_area") - F.col("overlap"))
    return pairs.filter("overlap > 1e-9").withColumn("iou", iou)
