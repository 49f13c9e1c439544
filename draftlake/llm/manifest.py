"""Merkle manifest with nested-interval labels: every node carries the interval of leaf ranks it
covers, containment joins bucketed by level attach the nodes above, and the siblings of a node are what
its parent's interval holds beside its own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import small_side
from draftlake.session import cut_lineage

FANOUT = 3
#: Levels that one shuffle builds: a band holds at most FANOUT ** LEVELS nodes and all nodes above them.
LEVELS = 3
WIDTH = FANOUT ** LEVELS
NODE = "struct<lo:bigint,hi:bigint,hash:string>"
STEPS = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """Byte count and value, or ``-`` for null, so that no two rows have the same concatenation."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def height(leaves: Column) -> Column:
    """Levels above ``leaves`` leaves until one node is left."""
    powers = F.lit([FANOUT ** k for k in range(40)]).cast("array<bigint>")
    return F.size(F.filter(powers, lambda p: p < leaves))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """Written rows with ``__place`` from 0 in the order given. The sort cuts ranges by a sample, so
    equal keys do not gather; places inside a range are counted on from the rows of all before it."""
    kept = cut_lineage(cut_lineage(rows).orderBy(*order))
    low = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    split = kept.select("*", F.spark_partition_id().alias("__part"), low.alias("__inside"))
    sizes = {r[0]: r[1] for r in split.groupBy("__part").count().collect()}
    before, total = [], 0
    for k in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(k, 0)
    starts = F.lit(before or [0]).cast("array<bigint>")
    return split.withColumn("__place", F.get(starts, F.col("__part")) + F.col("__inside")).drop("__part", "__inside")


def _runs(nodes: Column) -> Column:
    """Parents of consecutive runs of nodes."""

    def parent(i: Column) -> Column:
        run = F.slice(nodes, i * FANOUT + 1, F.lit(FANOUT))
        return F.struct(
            F.get(run, F.lit(0))["lo"].alias("lo"), F.element_at(run, -1)["hi"].alias("hi"),
            F.sha2(F.array_join(F.transform(run, lambda c: c["hash"]), ""), 256).alias("hash"),
        )

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int")), parent)


def _steps(levels: Column, at: Column, valid: Column) -> Column:
    """Siblings left and right of the nodes that hold rank ``at``, on the first ``valid`` levels of a
    band: of the children inside the parent's interval, those whose own interval does not hold it."""

    def step(nodes: Column, above: Column) -> Column:
        holds = lambda c: (c["lo"] <= at) & (at < c["hi"])
        parent = F.get(F.filter(above, holds), F.lit(0))
        inside = F.filter(nodes, lambda c: (c["lo"] >= parent["lo"]) & (c["hi"] <= parent["hi"]) & ~holds(c))
        side = lambda keep: F.array_join(F.transform(F.filter(inside, keep), lambda c: c["hash"]), "")
        return F.struct(side(lambda c: c["lo"] < at).alias("left"), side(lambda c: c["lo"] > at).alias("right"))

    all_ = F.array(*[step(levels[j], levels[j + 1]) for j in range(LEVELS)])
    return F.slice(all_, F.lit(1), F.greatest(F.least(valid, F.lit(LEVELS)), F.lit(0)))


@dataclass
class Tree:
    """``bands``: per band level (level 0, LEVELS, 2 * LEVELS, ...) the written bands of all trees;
    ``roots``: (tree, root). A band has tree, n (leaves of its tree), lo, hi, levels (its nodes and
    those above them, as intervals) and rows (payload of its nodes, on the lowest level only)."""

    bands: list[DataFrame]
    roots: DataFrame


def built(leaves: DataFrame, most: int) -> Tree:
    """Trees over ``leaves`` (tree, n, rank, hash, payload); ``most`` is the number of leaves of the
    largest. Nodes of one band meet by tree and a bucket of their ranks, so a large tree is many keys."""
    bands, roots, level, nodes = [], None, 0, leaves
    while True:
        width = FANOUT ** level
        entry = F.struct(
            F.struct(
                (F.col("rank") * width).alias("lo"), F.least((F.col("rank") + 1) * width, F.col("n")).alias("hi"), F.col("hash").alias("hash")
            ).cast(NODE).alias("node"), F.col("payload").alias("payload"),
        )
        by_rank = lambda a, b: F.signum(a["node"]["lo"] - b["node"]["lo"]).cast("int")
        held = nodes.groupBy("tree", "n", F.floor(F.col("rank") / WIDTH).alias("bucket")).agg(F.array_sort(F.collect_list(entry), by_rank).alias("held"))
        band = held.select("tree", "n", F.transform("held", lambda x: x["node"]).alias("l0"), F.transform("held", lambda x: x["payload"]).alias("rows"))
        for k in range(LEVELS):
            band = band.withColumn(f"l{k + 1}", _runs(F.col(f"l{k}")))
        band = cut_lineage(band.select(
            "tree", "n", F.col("l0")[0]["lo"].alias("lo"), F.element_at("l0", -1)["hi"].alias("hi"),
            F.array(*[F.col(f"l{k}") for k in range(LEVELS + 1)]).alias("levels"), "rows",
        ))
        bands.append(band)
        up = height(F.col("n")) - level
        done = band.where(up <= LEVELS).select("tree", F.get(F.get("levels", up), F.lit(0))["hash"].alias("root"))
        roots = done if roots is None else roots.unionByName(done)
        if FANOUT ** (level + LEVELS) >= most:
            return Tree(bands, roots)
        top = F.get(F.get("levels", F.lit(LEVELS)), F.lit(0))
        nodes = band.where(up > LEVELS).select(
            "tree", "n", F.floor(F.col("lo") / (width * WIDTH)).alias("rank"), top["hash"].alias("hash"), F.lit(None).alias("payload"),
        )
        level += LEVELS


def proven(tree: Tree, above: DataFrame | None) -> DataFrame:
    """(tree, payload columns, hash, steps) per leaf: siblings from the leaf up to the root.

    From the top down, a band joins the one band above whose interval holds it; buckets of that
    level's width are the join key, so every band meets at most WIDTH bands below and no key is hot.
    ``above`` (tree, steps) goes on beyond the roots."""
    known = None
    for level in reversed(range(len(tree.bands))):
        base, band = level * LEVELS, tree.bands[level]
        left = height(F.col("n")) - base
        tops = band.where(left <= LEVELS)
        none = F.array().cast(STEPS)
        if above is None:
            tops = tops.withColumn("upper", none)
        else:
            tops = tops.join(above.select(F.col("tree").alias("__t"), F.col("steps").alias("upper")), F.col("tree") == F.col("__t")).drop("__t")
        here = tops
        if known is not None:
            bucket = F.floor(F.col("lo") / FANOUT ** (base + 2 * LEVELS))
            wide = known.select(
                F.col("tree").alias("__t"), bucket.alias("__b"), F.col("n").alias("__n"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"),
                F.col("levels").alias("__levels"), F.col("upper").alias("__upper"),
            )
            inner = band.where(left > LEVELS).withColumn("__bucket", bucket)
            met = inner.join(wide, (F.col("tree") == F.col("__t")) & (F.col("__bucket") == F.col("__b")) & (F.col("__lo") <= F.col("lo")) & (F.col("hi") <= F.col("__hi")))
            steps = _steps(F.col("__levels"), F.col("lo"), height(F.col("__n")) - base - LEVELS)
            here = here.unionByName(met.select(*band.columns, F.concat(steps, "__upper").alias("upper")))
        known = cut_lineage(here)
    own = known.select("tree", "n", "levels", "upper", F.posexplode("rows").alias("at", "payload"))
    node = F.get(F.col("levels")[0], F.col("at"))
    return own.select("tree", "payload.*", node["hash"].alias("leaf"), F.concat(_steps(F.col("levels"), node["lo"], height(F.col("n"))), "upper").alias("steps"))


def manifest(rows: DataFrame, group: str = "source", order: str = "doc_id", hash_: str = "leaf") -> DataFrame:
    """``rows`` with subroot, root and ``steps`` (siblings left and right, level by level up to the root).

    One tree per ``group`` over its rows by ascending ``order`` (nulls first, equal ones by hash), and
    one over the roots of the groups by ascending group (null first, byte by byte). Every run of three
    nodes gets a parent while several nodes remain. Null groups are one group; repeated rows are
    leaves of their own; an empty table gives an empty table; extra columns pass through."""
    carried = [c for c in rows.columns if c not in (hash_, "subroot", "root", "steps")]
    data = rows.select(F.struct(*carried).alias("payload"), F.col(hash_).alias("hash"))
    placed = ranked(data, F.col(f"payload.{group}").asc_nulls_first(), F.col(f"payload.{order}").asc_nulls_first(), F.col("hash"))
    sizes = placed.groupBy(F.col(f"payload.{group}").alias("__g")).agg(F.count("*").alias("n"), F.min("__place").alias("first"))
    groups = ranked(sizes, F.col("first")).select("__g", "n", "first", F.col("__place").alias("tree"))
    groups = cut_lineage(groups)
    most, number = groups.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    leaves = placed.join(small_side(groups), F.col(f"payload.{group}").eqNullSafe(F.col("__g"))).select(
        "tree", "n", (F.col("__place") - F.col("first")).alias("rank"), "hash", "payload"
    )
    trees = built(leaves, most)
    subroots = cut_lineage(trees.roots)
    one = subroots.select(
        F.lit(0).cast("bigint").alias("tree"), F.lit(number).alias("n"), F.col("tree").alias("rank"), F.col("root").alias("hash"),
        F.struct(F.col("tree").alias("group")).alias("payload"),
    )
    head = built(one, number)
    paths = proven(head, None).join(head.roots.withColumnRenamed("root", "whole"), "tree").select(
        F.col("group").alias("tree"), "steps", F.col("leaf").alias("subroot"), F.col("whole").alias("root")
    )
    paths = small_side(paths, 100_000)
    out = proven(trees, paths.select("tree", "steps")).join(paths.select("tree", "subroot", "root"), "tree")
    return out.select(*carried, F.col("leaf").alias(hash_), "subroot", "root", "steps")


def proof(steps: Column) -> Column:
    """Digest of all siblings of a leaf, from its level to the root, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(start: Column, steps: Column) -> Column:
    """Root that a leaf leads to with the siblings given."""
    return F.aggregate(steps, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))
