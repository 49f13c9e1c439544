"""Worksheet, document and slide tables as a long cell table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CELLS = 1_000_000


def explode_sheet_cells(
    df: DataFrame, keys: list[str], rows: str = "rows", max_cells: int = MAX_CELLS
) -> tuple[DataFrame, DataFrame]:
    """(cells, refused): one row per cell of ``array<array<string>>`` sheets.

    Trailing empty rows are dropped; documents (first key) whose sheets hold more than
    ``max_cells`` cells go whole to the refused output. Both counts are taken inside the row's own
    array, so no window over exploded cells is needed.
    """
    blank = lambda r: ~F.exists(r, lambda v: v.isNotNull() & (v != ""))
    grid = F.coalesce(F.col(rows), F.array().cast("array<array<string>>"))
    width = F.aggregate(grid, F.lit(0).cast("bigint"), lambda a, r: a + F.coalesce(F.size(r), F.lit(0)))
    last = F.array_max(
        F.transform(grid, lambda r, i: F.when(~blank(r), i + 1).otherwise(0))
    )
    sized = df.withColumns({"__cells": width, "__last": F.coalesce(last, F.lit(0))})
    doc = keys[0]
    over = (
        sized.groupBy(doc)
        .agg(F.sum("__cells").alias("cells"))
        .filter(F.col("cells") > max_cells)
        .withColumn("error_code", F.lit("limit_exceeded"))
    )
    kept = sized.join(over.select(doc), doc, "left_anti")
    cells = (
        kept.select(*keys, F.posexplode(F.slice(grid, F.lit(1), F.col("__last"))).alias("row_index", "__r"))
        .select(*keys, "row_index", F.posexplode("__r").alias("col_index", "value"))
    )
    return cells, over
