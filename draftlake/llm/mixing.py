"""Temperature mixing: token shares of the sources are raised to an exponent that meets a target, and
the weights become budgets that are dealt in permuted blocks."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from draftlake.llm.common import WS, WS_CHARS, small_side, whole


@dataclass(frozen=True)
class Settings:
    """``entropy``: wanted entropy of the weights as a share of the highest possible (log of the number
    of sources); ``repeats``: most passes over any source; ``budget``: tokens to deal, or None for as
    many as let every source pass at least once; ``block_tokens``: mean size of a block."""

    entropy: float = 0.95
    repeats: float = 2.0
    budget: int | None = None
    block_tokens: int = 1 << 16
    seed: int = 11


def token_count(text: Column) -> Column:
    """Number of words of a text."""
    inner = F.btrim(text, F.lit(WS_CHARS))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, WS))).cast("bigint")


def weights_at(shares: dict, exponent: float) -> dict:
    """Normalised weights share ** exponent."""
    top = max(shares.values(), default=1.0)
    raw = {k: (v / top) ** exponent for k, v in shares.items()}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()}


def entropy(weights: dict) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def passes(tokens: dict, weights: dict, budget: int | None) -> dict:
    """Passes over each source under the budget; None: the least passes are exactly one."""
    per = {k: w / tokens[k] for k, w in weights.items()}
    scale = 1 / min(per.values()) if budget is None else budget
    return {k: v * scale for k, v in per.items()}


def temperature(tokens: dict, s: Settings, rounds: int = 60) -> tuple[float, dict, dict]:
    """(exponent, weights, passes) from tokens per source. The exponent is the largest in [0, 1] whose
    entropy meets the target, found by bisection; if some source would pass more often than
    ``repeats`` allows, it is raised, again by bisection, to the smallest that keeps the limit. A
    budget over ``repeats`` times all tokens cannot keep it; then shares stay as they are (1)."""
    tokens = {k: v for k, v in tokens.items() if v > 0}
    if not tokens:
        return 1.0, {}, {}
    total = sum(tokens.values())
    shares = {k: v / total for k, v in tokens.items()}

    def bisect(good, low: float, high: float) -> float:
        """Boundary between ``high``, where ``good`` fails, and ``low``, where it holds."""
        for _ in range(rounds):
            mid = (low + high) / 2
            low, high = (mid, high) if good(mid) else (low, mid)
        return low

    wanted = s.entropy * math.log(len(shares))
    meets = lambda a: entropy(weights_at(shares, a)) >= wanted - 1e-12
    keeps = lambda a: max(passes(tokens, weights_at(shares, a), s.budget).values()) <= s.repeats + 1e-9
    exponent = 1.0 if meets(1.0) else bisect(meets, 0.0, 1.0)
    if not keeps(exponent):
        exponent = bisect(keeps, 1.0, exponent) if keeps(1.0) else 1.0
    weights = weights_at(shares, exponent)
    return exponent, weights, passes(tokens, weights, s.budget)


def mix(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", settings: Settings | None = None) -> DataFrame:
    """Rows of ``docs`` as often as they are dealt, with a struct ``mix`` (n_tokens, pass, block, slot,
    weight).

    A source's budget is weight times all tokens dealt. Its rows lie in blocks by a hash of id and
    text, ``block_tokens`` tokens on average. Whole passes deal every row; the last pass deals blocks
    in the order of a keyed permutation, and of the block in which the budget ends the rows of
    smallest hash, the last of which may pass it. ``slot`` is the place of a block in the permutation
    of its pass. Running sums go over the blocks of a source and over the rows of one block per
    source, never over the rows of a source. The joins broadcast the tables of sources, blocks and
    the rows of the last blocks up to a checked size, so texts are not shuffled.

    Weights come from one row per source at the driver. Null sources are one source; null or empty
    texts have no tokens and take part in every whole pass; repeated rows are dealt together; an
    empty table gives an empty table; extra columns pass through."""
    s = settings or Settings()
    spark = docs.sparkSession
    name = F.coalesce(F.col(source).cast("string"), F.lit("\u0000"))
    rows = docs.select(F.struct("*").alias("__row"), name.alias("__s"), token_count(whole(text)).alias("__n"),
                       F.xxhash64(F.lit(s.seed), doc_id, text).alias("__key"))
    tokens = {r[0]: int(r[1]) for r in rows.groupBy("__s").agg(F.sum("__n")).collect()}
    _, weights, turns = temperature(tokens, s)
    plan = [
        (k, float(weights.get(k, 0.0)), float(turns.get(k, 1.0)), int(turns.get(k, 1.0) + 1e-9), max(1, -(-n // s.block_tokens)), n)
        for k, n in tokens.items()
    ]
    plan = spark.createDataFrame(plan, "__p string, weight double, turns double, full int, blocks bigint, total bigint")
    placed = rows.join(small_side(plan), F.col("__s") == F.col("__p")).withColumn("__block", F.pmod(F.col("__key"), F.col("blocks"))).drop("__p")
    part = F.round((F.col("turns") - F.col("full")) * F.col("total")).cast("bigint")
    sums = placed.groupBy("__s", "__block", "full", part.alias("part")).agg(F.sum("__n").alias("size"))
    order = F.xxhash64(F.lit(s.seed), F.col("__s"), F.col("full"), F.col("__block"))
    run = W.partitionBy("__s").orderBy(order, "__block").rowsBetween(W.unboundedPreceding, -1)
    blocks = small_side(sums.withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0))).select(
        F.col("__s").alias("__bs"), F.col("__block").alias("__bb"), "before", "size", "part"
    ))
    dealt = placed.join(blocks, (F.col("__s") == F.col("__bs")) & (F.col("__block") == F.col("__bb"))).drop("__bs", "__bb")
    whole_block = F.col("before") + F.col("size") <= F.col("part")
    cut = (F.col("before") < F.col("part")) & ~whole_block
    inner = W.partitionBy("__s", "__block").orderBy("__key").rowsBetween(W.unboundedPreceding, -1)
    edge = dealt.where(cut).groupBy("__s", "__block", "__key", "before", "part").agg(F.sum("__n").alias("n")).withColumn(
        "begin", F.col("before") + F.coalesce(F.sum("n").over(inner), F.lit(0))
    ).where("begin < part").select(F.col("__s").alias("__es"), F.col("__key").alias("__ek"))
    last = dealt.join(small_side(edge), cut & (F.col("__s") == F.col("__es")) & (F.col("__key") == F.col("__ek")), "left")
    times = F.col("full") + F.when(whole_block & (F.col("part") > 0), 1).when(F.col("__ek").isNotNull(), 1).otherwise(0)
    turn = last.withColumn("times", times).where("times > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    slot = F.xxhash64(F.lit(s.seed), F.col("__s"), F.col("pass"), F.col("__block"))
    rest = [c for c in docs.columns if c != "mix"]
    return turn.select(*[F.col("__row")[c].alias(c) for c in rest], F.struct(
        F.col("__n").alias("n_tokens"), "pass", F.col("__block").alias("block"), slot.alias("slot"), "weight",
    ).alias("mix"))
