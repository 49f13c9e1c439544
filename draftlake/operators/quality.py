"""Quality checks, candidate verdicts, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.functions.numeric import n_rows
from draftlake.functions.ordered import attach, magnitude_block, numbered
from draftlake.functions.text import let

# Check name, family, how it is compared with the base, comparator, limit.
CHECKS = [
    ("structural_edge_f", "geometry", "drop", "<=", 0.05),
    ("depth_drift", "geometry", "rise", "<=", 0.02),
    ("openings", "geometry", "worst", "<=", 0.05),
    ("verticals", "geometry", "absolute", "<=", 0.5),
    ("clipping", "technical", "rise", "<=", 0.01),
    ("sharpness_ratio", "technical", "ratio", ">=", 0.7),
    ("noise", "technical", "rise", "<=", 0.01),
    ("material_color_shift", "technical", "absolute", "<=", 5.0),
]
REQUIRED_FAMILIES = ["geometry", "technical", "brief", "artifact"]


def worst_item_delta(base: DataFrame, cand: DataFrame, keys: Sequence[str], item: str, value: str, most: int = 2_000) -> DataFrame:
    """Per candidate: worst loss over the base's items, items newly lost, items newly extra.
    ``base`` is keyed by keys[:-1], ``cand`` by keys with the candidate last; of several values of an item
    the greatest counts.

    Views of up to ``most`` rows are put together and compared in one row, each side shuffled once. Larger
    ones go by ranks, so that no view has to fit a row."""
    view = F.struct(*keys[:-1]).alias("__view")
    base = base.filter(F.col(value).isNotNull()).select(*keys[:-1], item, value)
    cand = cand.select(*keys, item, value)
    rows = base.select(view).unionAll(cand.select(view)).groupBy("__view").agg(F.count(F.lit(1)).alias("__n"))
    large = rows.filter(F.col("__n") > most).select("__view")
    if large.isEmpty():
        return _worst_in_row(base, cand, keys, item, value)
    part = lambda df, how: df.withColumn("__view", view).join(large, "__view", how).drop("__view")
    greatest = lambda df: df.groupBy(*[c for c in df.columns if c != value]).agg(F.max(value).alias(value))
    whole = _worst_in_row(part(base, "left_anti"), part(cand, "left_anti"), keys, item, value)
    return whole.unionByName(_worst_by_rank(greatest(part(base, "left_semi")), greatest(part(cand, "left_semi")), keys, item, value))


def _worst_in_row(base: DataFrame, cand: DataFrame, keys: Sequence[str], item: str, value: str) -> DataFrame:
    """The comparison of a view from all its rows in one row."""
    view, last = F.struct(*keys[:-1]).alias("__view"), keys[-1]
    entry = lambda *names: F.sort_array(F.collect_list(F.struct(*[c.alias(n) for n, c in names])))
    own = [("i", F.col(item)), ("v", F.col(value).cast("double"))]
    b = base.groupBy(view).agg(entry(*own).alias("__b"))
    c = cand.groupBy(view).agg(entry(("c", F.col(last)), *own).alias("__c"))
    zero = F.lit(0.0)

    def last_of(rows: Column, *names: str) -> Column:
        """The greatest of the rows with equal names; rows are sorted."""
        def ends(r: Column, i: Column) -> Column:
            nxt, same = F.get(rows, i + 1), F.lit(True)
            for n in names:
                same = same & nxt[n].eqNullSafe(r[n])
            return nxt.isNull() | ~same

        return F.filter(rows, ends)

    def compared(items: Column, all_got: Column) -> Column:
        def one(who: Column) -> Column:
            def judged(got: Column) -> Column:
                have = lambda x: F.coalesce(F.get(F.filter(got, lambda g: g["i"].eqNullSafe(x["i"])), F.lit(0))["v"], zero)
                pairs = F.transform(items, lambda x: F.struct(x["v"].alias("base"), have(x).alias("got")))
                extra = F.filter(got, lambda g: (g["v"] > 0) & ~F.exists(items, lambda x: x["i"].eqNullSafe(g["i"])))
                return let(pairs, lambda ps: F.struct(
                    who.alias("c"), F.greatest(F.coalesce(F.array_max(F.transform(ps, lambda p: p["base"] - p["got"])), zero), zero).alias("worst"),
                    F.size(F.filter(ps, lambda p: (p["base"] > 0) & (p["got"] == 0))).cast("bigint").alias("new_missing"),
                    F.size(extra).cast("bigint").alias("new_extra"),
                ))

            return let(F.filter(all_got, lambda g: g["c"].eqNullSafe(who)), judged)

        return F.transform(F.array_distinct(F.transform(all_got, lambda g: g["c"])), one)

    found = let(
        last_of(F.coalesce("__b", F.array().cast(b.schema["__b"].dataType)), "i"),
        lambda items: let(last_of(F.col("__c"), "c", "i"), lambda got: compared(items, got)),
    )
    out = c.join(b, "__view", "left").select("__view", F.inline_outer(found))
    return out.select(*[F.col("__view")[k].alias(k) for k in keys[:-1]], F.col("c").alias(last), "worst", "new_missing", "new_extra")


def _worst_by_rank(base: DataFrame, cand: DataFrame, keys: Sequence[str], item: str, value: str) -> DataFrame:
    """Candidates only meet the items they have. Items they lack follow from counts, and the greatest
    lacking item from the base's items ranked by value: it is the first rank the candidate misses.
    """
    view = list(keys[:-1])
    b = base.select(*view, item, F.col(value).alias("__base"))
    ranked = numbered(
        b.withColumn("__neg", -F.col("__base")), view, ["__neg", item], magnitude_block(F.col("__neg")), "__rank"
    ).drop("__neg")
    totals = b.groupBy(*view).agg(n_rows().alias("__items"), F.count_if(F.col("__base") > 0).alias("__positive"))
    got = cand.select(*keys, item, F.coalesce(F.col(value), F.lit(0.0)).alias("__got"))
    met = attach(got, ranked, [*view, item], "left")
    # ranks a candidate has, without gaps from 1 on: rank equals its own position among them
    own = met.filter(F.col("__rank").isNotNull()).select(*keys, "__rank")
    placed = numbered(own, keys, ["__rank"], F.floor(F.col("__rank") / 4096), "__at")
    prefix = placed.filter("__rank = __at").groupBy(*keys).agg((F.max("__rank") + 1).alias("__rank"))
    per = met.groupBy(*keys).agg(
        F.max(F.col("__base") - F.col("__got")).alias("__loss"),
        F.count_if((F.col("__base") > 0) & (F.col("__got") != 0)).alias("__held"),
        F.count_if(F.col("__base").isNull() & (F.col("__got") > 0)).alias("new_extra"),
    )
    per = attach(attach(per, prefix, keys, "left"), totals, view, "left").fillna(1, ["__rank"])
    lacking = ranked.select(*view, "__rank", F.col("__base").alias("__lack"))
    out = attach(per, lacking, [*view, "__rank"], "left")
    zero = F.lit(0.0)
    return out.select(
        *keys,
        F.greatest(F.coalesce("__loss", zero), F.coalesce("__lack", zero), zero).alias("worst"),
        (F.coalesce("__positive", F.lit(0)) - F.col("__held")).alias("new_missing"), "new_extra",
    )


def relative_checks(
    base: DataFrame, cand: DataFrame, view: Sequence[str], candidate: str,
    checks: Sequence[tuple[str, str, str, str, float]] = CHECKS,
) -> DataFrame:
    """One row per candidate and check: value, base value, delta, threshold, comparator, passed.

    Metrics are columns named after the checks on both sides; ``openings`` takes new_missing and
    new_extra of the candidate too. A check whose metric was not measured fails."""
    names = [c[0] for c in checks]
    b = base.select(*view, *[F.col(n).alias(f"b_{n}") for n in names if n in base.columns])
    wide = cand.join(b, list(view), "left")

    def row(name: str, family: str, how: str, comparator: str, limit: float) -> Column:
        value = F.col(name).cast("double")
        ref = F.col(f"b_{name}").cast("double") if f"b_{name}" in wide.columns else F.lit(None).cast("double")
        if how == "drop":
            measured, delta, base_value = ref - value, ref - value, ref
        elif how == "rise":
            measured, delta, base_value = value - ref, value - ref, ref
        elif how == "ratio":
            value = value / F.greatest(ref, F.lit(1e-9))
            measured, delta, base_value = value, F.lit(None).cast("double"), F.lit(None).cast("double")
        else:
            measured, delta, base_value = value, F.lit(None).cast("double"), F.lit(None).cast("double")
        ok = measured >= limit if comparator == ">=" else measured <= limit
        if how == "worst":
            lost = F.col("new_missing") + F.col("new_extra")
            ok, delta, value = ok & (lost == 0), measured, lost.cast("double")
        return F.struct(
            F.lit(name).alias("name"), F.lit(family).alias("family"), value.alias("value"), base_value.alias("base_value"),
            delta.alias("delta"), F.lit(float(limit)).alias("threshold"), F.lit(comparator).alias("comparator"),
            F.coalesce(ok, F.lit(False)).alias("passed"),
        )

    return wide.select(*view, candidate, F.inline(F.array(*[row(*c) for c in checks])))


def candidate_verdict(checks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """passed, geometry_passed, uses_mocks, families covered by real estimators and failed checks."""
    real = ~F.coalesce("mock", F.lit(False))
    return checks.groupBy(*keys).agg(
        F.every("passed").alias("passed"),
        F.every(F.col("passed") | (F.col("family") != "geometry")).alias("geometry_passed"),
        F.some(~real).alias("uses_mocks"),
        F.array_sort(F.collect_set(F.when(real, F.col("family")))).alias("families"),
        F.array_sort(F.collect_set(F.when(~F.col("passed"), F.col("name")))).alias("failed"),
        F.max(F.when(F.col("name") == "structural_edge_f", F.col("delta"))).alias("edge_delta"),
    )


def deliverable_guard(views: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Views that must not be delivered, with the reason; an empty result is a clean run. ``verdicts``
    has view_id, image_sha256, passed and failed of every checked image."""
    v = verdicts.groupBy("view_id", F.col("image_sha256").alias("delivered_sha256")).agg(
        F.every("passed").alias("__passed"), n_rows().alias("__n")
    )
    j = views.join(v, ["view_id", "delivered_sha256"], "left")
    reason = (
        F.when(~F.col("file_sha256").eqNullSafe(F.col("delivered_sha256")), "hash_mismatch")
        .when((F.col("status") == "fallback_base") & (F.col("delivered_sha256") != F.col("base_sha256")), "fallback_not_base")
        .when(F.col("status") == "fallback_base", F.lit(None))
        .when(F.col("__n").isNull(), "no_record")
        .when(~F.col("__passed"), "failed_checks")
    )
    return j.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select("view_id", "reason")


def gate_decision(gates: DataFrame, policy: Column | str = "policy") -> DataFrame:
    """Adds ``decision`` from status, policy, auto_ok and mandatory: what was decided stays, a
    rejection refuses, 'never' passes, 'on_low_confidence' passes when the evidence is good."""
    rule = F.when(F.coalesce("mandatory", F.lit(False)), "always").otherwise(F.col(policy) if isinstance(policy, str) else policy)
    auto = (rule == "never") | ((rule == "on_low_confidence") & F.col("auto_ok"))
    decision = (
        F.when(F.col("status").isin("approved", "auto_passed"), F.col("status"))
        .when(F.col("status") == "rejected", "refused")
        .when(auto, "auto_passed").otherwise("pending")
    )
    return gates.withColumn("decision", decision)


def final_gate(outcomes: DataFrame, checks: DataFrame, run: str = "run_id") -> DataFrame:
    """auto_ok of the last gate per run: every view refined, every check passed, every required family
    covered by real estimators."""
    o = outcomes.groupBy(run).agg(F.every(F.col("status") == "refined").alias("refined"))
    c = checks.groupBy(run).agg(
        F.every("passed").alias("passed"), F.collect_set(F.when(~F.coalesce("mock", F.lit(False)), F.col("family"))).alias("covered")
    )
    missing = F.array_except(F.array(*[F.lit(f) for f in sorted(REQUIRED_FAMILIES)]), F.coalesce("covered", F.array().cast("array<string>")))
    j = o.join(c, run, "left").withColumn("missing", missing)
    ok = F.col("refined") & F.coalesce("passed", F.lit(True)) & (F.size("missing") == 0)
    return j.select(run, ok.alias("auto_ok"), "missing")
