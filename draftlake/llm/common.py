"""Expressions and joins that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from draftlake.functions.text import let
from draftlake.session import cut_lineage

WS_CHARS = " \t\n\x0b\f\r"
WS = "[\\x20\\x09-\\x0D]+"
LONGS = "array<bigint>"
SPANS = "array<struct<start:bigint,end:bigint,value:string,left:string,right:string>>"


def whole(text: Column | str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than the six ASCII white-space characters."""
    return let(
        F.btrim(text, F.lit(WS_CHARS)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WS)),
    )


def running_totals(values: Column, chunk: int = 128) -> Column:
    """Sums of the elements before each element. Chunks keep the copying of the fold linear in the
    length of the array."""

    def block(b: Column) -> Column:
        part = F.slice(values, b * chunk + 1, F.lit(chunk))
        before = F.aggregate(F.slice(values, F.lit(1), b * chunk), F.lit(0).cast("bigint"), lambda a, x: a + x)
        start = F.struct(before.alias("t"), F.array().cast(LONGS).alias("out"))
        return F.aggregate(
            part, start,
            lambda a, x: F.struct((a["t"] + x).alias("t"), F.array_append(a["out"], a["t"]).alias("out")),
            lambda a: a["out"],
        )

    n = F.size(values)
    blocks = F.sequence(F.lit(0), ((n - 1) / chunk).cast("int"))
    return F.when(n > 0, F.flatten(F.transform(blocks, block))).otherwise(F.array().cast(LONGS))


def spans_of(text: Column, pattern: str, context: int = 40) -> Column:
    """Leftmost non-overlapping matches as array<struct<start,end,value,left,right>>, in code points
    with an exclusive end; ``left`` and ``right`` are up to ``context`` characters between a match
    and its neighbours. The pieces between the matches and the matches alternate, so their lengths
    give the places. Patterns must not match the empty string."""

    def located(hits: Column) -> Column:
        def placed(gaps: Column) -> Column:
            sizes = F.zip_with(
                F.slice(gaps, F.lit(1), F.size(hits)), hits,
                lambda g, h: (F.length(g) + F.length(h)).cast("bigint"),
            )
            return let(
                running_totals(sizes),
                lambda before: F.transform(
                    hits,
                    lambda h, i: F.struct(
                        (F.get(before, i) + F.length(F.get(gaps, i))).alias("start"),
                        (F.get(before, i) + F.length(F.get(gaps, i)) + F.length(h)).alias("end"),
                        h.alias("value"),
                        F.right(F.get(gaps, i), F.lit(context)).alias("left"),
                        F.left(F.get(gaps, i + 1), F.lit(context)).alias("right"),
                    ),
                ),
            )

        return let(F.split(text, pattern, -1), placed)

    none = F.array().cast(SPANS)
    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda hits: F.when(F.size(hits) == 0, none).otherwise(located(hits)),
    )


def row_keys(doc_id: str, text: str) -> list[Column]:
    """Key of a row by id and text: equal only for rows that repeat both."""
    return [F.coalesce(F.col(doc_id).cast("bigint"), F.lit(0)).alias("__i"), F.xxhash64(doc_id, text).alias("__h")]


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in the order given."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def small_side(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The written table, marked for broadcast if it has at most ``most`` (narrow) rows; beyond that
    the join shuffles both sides as usual."""
    kept = cut_lineage(df)
    n = kept.count()
    return F.broadcast(kept.coalesce(max(1, n // 50_000))) if n <= most else kept


def ranks_in_parts(rows: DataFrame, key: str, parts: Column, order: list[str], name: str = "rank") -> DataFrame:
    """Rows with their place from 0 among the rows of equal ``key``. A key is numbered in ``parts``
    pieces by a hash of ``order``, and the pieces are put one behind the other, so a hot key is many
    tasks; the table of pieces has one row per key and piece and is broadcast up to a checked size."""
    piece = F.pmod(F.xxhash64(*order), parts).cast("bigint")
    cut = rows.withColumn("__piece", piece)
    sizes = cut.groupBy(key, "__piece").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy(key).orderBy("__piece").rowsBetween(W.unboundedPreceding, -1))
    base = small_side(sizes.select(F.col(key).alias("__k"), F.col("__piece").alias("__p"), F.coalesce(before, F.lit(0)).alias("__before")))
    inside = F.row_number().over(W.partitionBy(key, "__piece").orderBy(*order)) - 1
    placed = cut.withColumn("__row", inside).join(base, (F.col(key) == F.col("__k")) & (F.col("__piece") == F.col("__p")))
    return placed.withColumn(name, F.col("__row") + F.col("__before")).drop("__piece", "__k", "__p", "__row", "__before")
