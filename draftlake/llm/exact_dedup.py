"""Deterministic block naming: texts are cut into fixed-size blocks, sorted distinct blocks get
integer names, and adjacent names are named again until every document has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from draftlake.llm.common import WS, small_side, whole
from draftlake.session import cut_lineage

BLOCK_CHARS = 1024


def digests(block: Column) -> list[Column]:
    """Two independent 64-bit hashes of a block, the short key of the join that follows."""
    return [F.xxhash64(block), F.xxhash64(F.lit(1), block)]


def normalised(text: Column) -> Column:
    return F.regexp_replace(whole(text), WS, " ")


def document_keys(doc_id: str, text: str) -> list[Column]:
    """Key of a row: equal for rows that repeat both the id and the normalised text."""
    return [
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(0)).alias("__i"),
        F.xxhash64(F.col(doc_id), normalised(F.col(text))).alias("__h"),
    ]


def numbered(distinct: DataFrame, order: list[str], keep: list[str]) -> DataFrame:
    """Integer names of distinct rows: sorted within every partition and counted on from it. The
    names are written once, so a lost executor cannot change them."""
    named = distinct.sortWithinPartitions(*order).select(*keep, F.monotonically_increasing_id().alias("name"))
    return cut_lineage(named)


def name_blocks(blocks: DataFrame, digest: Callable[[Column], list[Column]] = digests) -> DataFrame:
    """Rows of ``blocks`` with the name of their block in place of it.

    The text is shuffled once, in the distinct sort that gives the names; repeated blocks are
    combined before it. Rows then meet their names by the digests. Should two blocks have the same
    digests (checked on the names), the blocks themselves are joined, so no collision can survive."""
    h1, h2 = digest(F.col("block"))
    keyed = blocks.withColumns({"d1": h1, "d2": h2})
    distinct = keyed.select("d1", "d2", "block").distinct()
    names = numbered(distinct, ["block"], ["d1", "d2"])
    on = ["d1", "d2"]
    if not names.groupBy("d1", "d2").count().where("count > 1").isEmpty():
        on.append("block")
        names = numbered(distinct, ["block"], on)
    return keyed.join(names, on).drop("block", "d1", "d2")


def identities(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, block_chars: int = BLOCK_CHARS,
    digest: Callable[[Column], list[Column]] = digests,
) -> DataFrame:
    """One row per distinct document key: (__i, __h, id, rows, level, name). Two documents have the
    same (level, name) if and only if their normalised texts are identical.

    Level 0 names blocks; every further level names pairs of adjacent names (a last odd name pairs
    with -1), so the rows halve per level and a document leaves when one name is left. The number of
    levels is the logarithm of the blocks of the longest text. A frequent block or pair is combined
    before the shuffle of the distinct sort, and adaptive execution may split the join with names."""
    cut = F.regexp_extract_all(normalised(F.col(text)), F.lit("(?s).{1,%d}" % block_chars), F.lit(0))
    parts = docs.select(
        *document_keys(doc_id, text), F.col(doc_id).alias("id"),
        F.when(F.size(cut) > 0, cut).otherwise(F.array(F.lit(""))).alias("parts"),
    )
    blocks = parts.select("__i", "__h", "id", F.size("parts").alias("n"), F.posexplode("parts").alias("pos", "block"))
    rows = name_blocks(blocks, digest).withColumn("rows", F.when(F.col("pos") == 0, 1).otherwise(0).cast("bigint"))
    rows = cut_lineage(rows.groupBy("__i", "__h", "id", "n", "pos").agg(F.max("name").alias("name"), F.sum("rows").alias("rows")))
    longest = rows.agg(F.max("n")).first()[0] or 0
    done, level = [], 0
    while True:
        done.append(rows.where("n = 1").select("__i", "__h", "id", "rows", F.lit(level).alias("level"), "name"))
        if longest <= 1:
            break
        side = lambda k: F.max(F.when(F.col("pos") % 2 == k, F.col("name")))
        pairs = rows.where("n > 1").groupBy(
            "__i", "__h", "id", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.floor(F.col("pos") / 2).cast("int").alias("pos"),
        ).agg(side(0).alias("a"), F.coalesce(side(1), F.lit(-1)).cast("bigint").alias("b"), F.sum("rows").alias("rows"))
        names = numbered(pairs.select("a", "b").distinct(), ["a", "b"], ["a", "b"])
        rows = cut_lineage(pairs.join(names, ["a", "b"]).drop("a", "b"))
        longest, level = (longest + 1) // 2, level + 1
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def decisions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(__i, __h, id, rows, keep_id, group_size) per distinct document key. Only groups of several rows
    are joined back, so a large group meets one row and adaptive execution may split it."""
    named = identities(docs, doc_id, text, **options)
    groups = named.groupBy("level", "name").agg(F.min("id").alias("keep_id"), F.sum("rows").alias("group_size"))
    groups = cut_lineage(groups.where("group_size > 1"))
    return named.join(groups, ["level", "name"], "left").select(
        "__i", "__h", "id", "rows", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", "rows").alias("group_size"),
    )


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Every row of ``docs`` with a struct ``exact`` (keep_id, group_size, kept).

    Texts are equal when identical after each run of white space became one space; null is empty.
    Of a group the row with the smallest id stays; among rows that repeat that id one stays. Null ids
    are never smaller than an id, and stay only where the group has no other. An empty table gives an
    empty table; extra columns pass through."""
    found = decisions(docs, doc_id, text, **options).select("__i", "__h", "keep_id", "group_size")
    keyed = docs.select(F.struct("*").alias("__row"), *document_keys(doc_id, text))
    rows = keyed.join(found, ["__i", "__h"])
    first = F.row_number().over(W.partitionBy("__i", "__h").orderBy(F.lit(1))) == 1
    kept = F.col("__row")[doc_id].eqNullSafe(F.col("keep_id")) & first
    return rows.select(
        *[F.col("__row")[c].alias(c) for c in docs.columns if c != "exact"],
        F.struct("keep_id", "group_size", kept.alias("kept")).alias("exact"),
    )


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps. Copies leave by an anti-join with their keys,
    which is broadcast up to a checked size, so texts are not shuffled; only rows whose id and text
    repeat are numbered."""
    found = cut_lineage(decisions(docs, doc_id, text, **options))
    stays = F.col("id").eqNullSafe(F.col("keep_id"))
    keyed = docs.select("*", *document_keys(doc_id, text))
    gone = found.where(~stays | (F.col("rows") > 1)).select("__i", "__h")
    out = keyed.join(small_side(gone), ["__i", "__h"], "left_anti").select(*docs.columns)
    repeated = found.where(stays & (F.col("rows") > 1)).select("__i", "__h")
    if repeated.isEmpty():
        return out
    first = F.row_number().over(W.partitionBy("__i", "__h").orderBy(F.lit(1)))
    again = keyed.join(small_side(repeated), ["__i", "__h"]).withColumn("__first", first).where("__first = 1")
    return out.unionByName(again.select(*docs.columns))
