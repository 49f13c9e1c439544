"""Arithmetic used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def f1(precision: Column, recall: Column) -> Column:
    """Harmonic mean, 0 when both are 0 or missing."""
    return F.coalesce(
        F.try_divide(2.0 * precision * recall, precision + recall), F.lit(0.0)
    )


def circular_error(a: Column, b: Column, period: float = 360.0) -> Column:
    half = period / 2
    return F.abs(F.pmod(a - b + half, F.lit(period)) - half)


def box_area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0))


def box_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return box_area(
        F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]),
        F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]),
    )


def box_iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    inter = box_overlap(a, b)
    union = box_area(**a) + box_area(**b) - inter
    return F.coalesce(F.try_divide(inter, union), F.lit(0.0))


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """Logits, their maximum and the sum of the exponentials are each bound once per row: inside
    lambdas Spark shares no common parts."""
    t = F.lit(temperature) if isinstance(temperature, (int, float)) else temperature
    once = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    exps = lambda z: once(F.array_max(z), lambda m: F.transform(z, lambda v: F.exp((v - m) / t)))
    share = lambda e: once(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda s: F.transform(e, lambda x: x / s))
    return once(logits, lambda z: once(exps(z), share))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def significant(c: Column, digits: int = 12) -> Column:
    """Double rounded to significant digits; removes noise of float arithmetic before hashing."""
    return F.format_string(f"%.{digits - 1}e", c).cast("double")


def percent_text(hits: Column, total: Column) -> Column:
    """'3/4 (75 %)', 'n/a' for an empty total."""
    share = F.format_string("%d/%d (%.0f %%)", hits, total, hits * 100.0 / total)
    return F.when(F.coalesce(total, F.lit(0)) == 0, "n/a").otherwise(share)


def n_rows() -> Column:
    return F.count(F.lit(1))
