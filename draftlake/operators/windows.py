"""Versions, intervals, selections and iterations."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from draftlake.functions.graph import components
from draftlake.functions.numeric import n_rows
from draftlake.functions.ordered import (
    BLOCK, attach, gap_islands, latest_by, magnitude_block, numbered, scan,
)
from draftlake.functions.text import let
from draftlake.session import cut_lineage

# Plan sources from best to worst.
SOURCE_ORDER = ["ifc", "dxf", "pdf_vector", "raster"]


# ---------------------------------------------------------------- versions


def latest_version(versions: DataFrame, approved: bool = False) -> DataFrame:
    """Per project the newest version that is not superseded, or the newest approved one."""
    keep = F.col("status") == "approved" if approved else F.col("status") != "superseded"
    return latest_by(versions.filter(keep), ["project_id"], F.col("number"))


def head_version(versions: DataFrame) -> DataFrame:
    """Newest version descending from each root."""
    return latest_by(versions, ["project_id", "root_id"], F.col("number"))


def working_version(versions: DataFrame) -> DataFrame:
    """The approved version of each root, else its newest."""
    return latest_by(
        versions, ["project_id", "root_id"], (F.col("status") == "approved").cast("int"), F.col("number")
    )


def next_numbers(
    existing: DataFrame, new: DataFrame, key: str, number: str, order: str, block: Column
) -> DataFrame:
    """Numbers for new rows, continuing after the highest one of their key."""
    top = existing.groupBy(key).agg(F.max(number).alias("__top"))
    ranked = numbered(new, [key], [order], block, "__rn")
    out = attach(ranked, top, [key], "left")
    return out.withColumn(number, F.coalesce("__top", F.lit(0)) + F.col("__rn")).drop("__top", "__rn")


def approve(versions: DataFrame, approvals: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(versions, refused approvals). ``approvals`` has id, approved_by, approved_at, one per
    project; versions with error or blocker issues are refused; the former approved version of the
    project becomes superseded."""
    bad = issues.filter(F.col("severity").isin("error", "blocker")).select(F.col("version_id").alias("id")).distinct()
    refused = approvals.join(bad, "id", "left_semi")
    ok = approvals.join(bad, "id", "left_anti")
    new = ok.select("id", F.col("approved_by").alias("__by"), F.col("approved_at").alias("__at"))
    projects = versions.select("id", "project_id").join(ok.select("id"), "id", "left_semi")
    touched = projects.select("project_id").distinct().withColumn("__touched", F.lit(True))
    j = versions.join(new, "id", "left").join(touched, "project_id", "left")
    chosen = F.col("__at").isNotNull()
    status = (
        F.when(chosen, "approved")
        .when(F.col("__touched") & (F.col("status") == "approved"), "superseded")
        .otherwise(F.col("status"))
    )
    fresh = chosen & (F.col("status") != "approved")
    out = j.withColumns(
        {
            "approved_by": F.when(fresh, F.col("__by")).otherwise(F.col("approved_by")),
            "approved_at": F.when(fresh, F.col("__at")).otherwise(F.col("approved_at")),
            "status": status,
        }
    )
    return out.select(*versions.columns), refused


def validity_history(df: DataFrame, keys: Sequence[str], since: str, row_id: str) -> DataFrame:
    """Slowly changing view: every row is valid until the next one of its key begins."""
    back = -F.unix_micros(F.col(since).cast("timestamp"))
    marked = df.withColumns({"__back": back, "__id": -F.col(row_id)})
    block = F.floor(F.col("__back") / 86_400_000_000 / 30).cast("bigint")
    out = scan(marked, keys, ["__back", "__id"], block, previous={"valid_to": F.col(since)})
    return out.drop("__back", "__id").withColumn("current", F.col("valid_to").isNull())


def edit_lineage(versions: DataFrame, edits: DataFrame, recorded: DataFrame | None = None) -> DataFrame:
    """Edits between a root and each approved version, (version_id, depth, edit…) with depth 1 the
    newest. Versions equal to their root or already recorded are skipped.

    Ancestors are found by doubling: after k rounds every version knows those up to 2^k edits away,
    so a chain takes the logarithm of its length. Each (version, ancestor) is kept once, so edits
    that run in a circle end too; their chain is listed once around."""
    start = versions.filter((F.col("status") == "approved") & (F.col("id") != F.col("root_id")))
    if recorded is not None:
        start = start.join(recorded.select(F.col("version_id").alias("id")), "id", "left_anti")
    known = start.select(F.col("id").alias("version_id"), "root_id", F.col("id").alias("at"), F.lit(0).alias("dist")).distinct()
    jump = edits.select(F.col("to_version").alias("at"), F.col("from_version").alias("up")).distinct()
    known, jump, step, count = cut_lineage(known), cut_lineage(jump), 1, -1
    while (now := known.count()) != count:
        count = now
        far = known.join(jump, "at").select("version_id", "root_id", F.col("up").alias("at"), (F.col("dist") + step).alias("dist"))
        known = cut_lineage(known.unionByName(far).groupBy("version_id", "root_id", "at").agg(F.min("dist").alias("dist")))
        more = jump.join(jump.select(F.col("at").alias("up"), F.col("up").alias("top")), "up").select("at", F.col("top").alias("up"))
        jump, step = cut_lineage(more.distinct()), step * 2
    roots = known.filter(F.col("at") == F.col("root_id")).select("version_id", "root_id", F.col("dist").alias("__end"))
    inside = known.join(roots, ["version_id", "root_id"], "left").filter(F.col("__end").isNull() | (F.col("dist") < F.col("__end")))
    e = edits.select("from_version", F.col("to_version").alias("at"), "edit_id")
    return inside.join(e, "at").select(
        "version_id", (F.col("dist") + 1).alias("depth"), "edit_id", "from_version", F.col("at").alias("to_version")
    )


def _steps(path: str) -> list[str]:
    """Keys of a JSON pointer; the empty pointer and one without a leading slash name no member."""
    if not path or path[0] != "/":
        raise ValueError(path)
    return [k.replace("~1", "/").replace("~0", "~") for k in path[1:].split("/")]


def _member(node, key: str, end: bool = False):
    """Index or key under which a container holds (or, with ``end``, may take) a member."""
    if isinstance(node, list):
        at = len(node) if end and key == "-" else int(key)
        if not 0 <= at < len(node) + end:
            raise IndexError(key)
        return at
    if not isinstance(node, dict) or (not end and key not in node):
        raise KeyError(key)
    return key


def _apply(doc, op: str, path: str, source: str | None, value) -> None:
    """One operation on a document, in place; raises where it does not apply."""

    def holder(pointer: str):
        *way, last = _steps(pointer)
        node = doc
        for k in way:
            node = node[_member(node, k)]
        return node, last

    def taken(pointer: str, away: bool):
        node, last = holder(pointer)
        at = _member(node, last)
        return node.pop(at) if away else node[at]

    def put(new) -> None:
        node, last = holder(path)
        at = _member(node, last, end=True)
        if isinstance(node, list):
            node.insert(at, new)
        else:
            node[at] = new

    if op == "add":
        put(value)
    elif op == "remove":
        taken(path, True)
    elif op == "replace":
        node, last = holder(path)
        node[_member(node, last)] = value
    elif op == "move":
        put(taken(source, True))
    elif op == "copy":
        put(json.loads(json.dumps(taken(source, False))))
    elif op != "test" or taken(path, False) != value:
        raise ValueError(op)


def replay_changes(base: DataFrame, ops: DataFrame, entity: str = "entity") -> tuple[DataFrame, DataFrame]:
    """(state, refused) after the ordered change log of each document: (entity, doc) and
    (entity, seq of the operation that did not apply).

    ``base`` has entity and doc (JSON text), ``ops`` entity, seq, op, path, from_path and value (JSON
    text); an entity without base starts as an empty object. Operations are add, remove, replace,
    move, copy and test with JSON pointers; list members shift, moves and copies take what lies below.
    A log with an operation that does not apply is refused whole and leaves its base as it was.

    Every operation depends on the document the ones before it left, so a log is one ordered pass:
    rows are dealt by entity and sorted, and a task holds one document at a time, never a log."""
    rows = base.select(
        F.col(entity).cast("string").alias("e"), F.lit(0).alias("late"), F.lit(None).cast("bigint").alias("seq"),
        F.lit("base").alias("op"), F.lit("").alias("path"), F.lit(None).cast("string").alias("from_path"), F.col("doc").alias("value"),
    ).unionByName(ops.select(
        F.col(entity).cast("string").alias("e"), F.lit(1).alias("late"), F.col("seq").cast("bigint").alias("seq"), "op", "path", "from_path", "value",
    ))
    dealt = rows.repartition("e").sortWithinPartitions("e", "late", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, before, doc, stopped, out = None, "{}", {}, None, []

        def close() -> None:
            if now is not None:
                text = before if stopped is not None else json.dumps(doc, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
                out.append((now[0], text, stopped))

        for part in batches:
            for e, seq, op, path, source, value in zip(
                part["e"], part["seq"], part["op"], part["path"], part["from_path"], part["value"], strict=True
            ):
                if now is None or now[0] != e:
                    close()
                    now, before, doc, stopped = (e,), "{}", {}, None
                if op == "base":
                    before, doc = value, json.loads(value)
                elif stopped is None:
                    try:
                        _apply(doc, op, path, source, None if value is None else json.loads(value))
                    except (KeyError, IndexError, ValueError, TypeError):
                        stopped = int(seq)
            yield pd.DataFrame(out, columns=["e", "doc", "seq"]).astype({"seq": "Int64"})
            out = []
        close()
        yield pd.DataFrame(out, columns=["e", "doc", "seq"]).astype({"seq": "Int64"})

    done = cut_lineage(dealt.mapInPandas(run, "e string, doc string, seq bigint"))
    return done.select(F.col("e").alias(entity), "doc"), done.filter("seq is not null").select(F.col("e").alias(entity), "seq")


def best_source_per_level(results: DataFrame) -> DataFrame:
    """Best source per (project, level), then most walls; scans are dropped from projects that have
    anything better."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SOURCE_ORDER]), F.col("source"))
    ranked = results.withColumn("__rank", rank)
    best = ranked.groupBy("project_id").agg(F.min("__rank").alias("__best"))
    raster = SOURCE_ORDER.index("raster") + 1
    useful = attach(ranked, best, ["project_id"]).filter((F.col("__rank") < raster) | (F.col("__best") == raster))
    order = F.struct("__rank", (-F.col("walls")).alias("w"), "page_id")
    rest = [c for c in results.columns if c not in ("project_id", "level_name")]
    return (
        useful.groupBy("project_id", "level_name").agg(F.min_by(F.struct(*rest), order).alias("r"))
        .select("project_id", "level_name", "r.*").select(*results.columns)
    )


# ---------------------------------------------------------------- intervals


def coalesce_intervals(
    spans: DataFrame, keys: Sequence[str], max_gap: float = 3.0, inner_gap: float = 0.02, block: Column | None = None
) -> DataFrame:
    """Intervals (s0, s1, offset, thickness, span_id) joined while they start at most ``max_gap``
    after everything before them: ends, support (sum of lengths), length-weighted offset and
    thickness, and the inner gaps above ``inner_gap``."""
    keys, order = list(keys), ["s0", "s1", "span_id"]
    block = magnitude_block(F.col("s0")) if block is None else block
    seen = scan(spans, keys, order, block, max_before={"__reach": F.col("s1")}, keep_block=True)
    gap = F.col("s0") - F.col("__reach")
    cut = F.when(gap <= max_gap, 0).otherwise(1).cast("bigint")
    run = scan(seen, keys, order, F.col(BLOCK), running_sum={"run": cut})
    length = F.col("s1") - F.col("s0")
    mean = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * length), F.sum(length)), F.avg(c))
    hole = (gap <= max_gap) & (gap > inner_gap)
    return run.groupBy(*keys, "run").agg(
        F.min("s0").alias("s0"), F.max("s1").alias("s1"), F.sum(length).alias("support"),
        mean("offset").alias("offset"), mean("thickness").alias("thickness"), n_rows().alias("pieces"),
        F.count_if(hole).alias("gaps"), F.coalesce(F.sum(F.when(hole, gap)), F.lit(0.0)).alias("gap_length"),
    )


def interval_gaps(spans: DataFrame, keys: Sequence[str], max_gap: float = 3.0, inner_gap: float = 0.02) -> DataFrame:
    """The inner gaps themselves, one row each."""
    seen = scan(spans, keys, ["s0", "s1", "span_id"], magnitude_block(F.col("s0")), max_before={"gap_start": F.col("s1")})
    gap = F.col("s0") - F.col("gap_start")
    return seen.filter((gap > inner_gap) & (gap <= max_gap)).select(*keys, "gap_start", F.col("s0").alias("gap_end"))


def wall_groups(pieces: DataFrame, keys: Sequence[str], angle: float = 0.8, step: float = 0.025, most: int = 500) -> DataFrame:
    """Adds ``line_id`` to pieces (piece_id, length, angle_deg, offset, thickness): the piece that leads
    their line. From the longest piece down (ties by piece_id), a piece joins the longest leader whose
    direction, offset and thickness differ by less than the tolerances, or leads a new line.

    Plans of up to ``most`` pieces are put together and gone through in one row; larger ones are settled
    in rounds, so that no plan has to fit a row. Leaders of a null direction, offset or thickness stand
    alone."""
    keys = list(keys)
    plan = F.struct(*keys).alias("__plan")
    large = pieces.groupBy(plan).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most).select("__plan")
    if large.isEmpty():
        return _groups_in_row(pieces, keys, angle, step)
    part = lambda how: pieces.withColumn("__plan", plan).join(large, "__plan", how).select(*pieces.columns)
    return _groups_in_row(part("left_anti"), keys, angle, step).unionByName(_groups_in_rounds(part("left_semi"), keys, angle, step))


def _groups_in_row(pieces: DataFrame, keys: Sequence[str], angle: float, step: float) -> DataFrame:
    """Leaders are found one by one, from the longest piece of a plan down: the leaders so far are the
    state of one pass over its pieces."""
    tol = {"angle_deg": angle, "offset": step, "thickness": step}
    rest = ["piece_id", *[c for c in pieces.columns if c not in keys and c != "piece_id"]]
    lead = lambda p: F.struct(p["piece_id"].alias("piece_id"), *[p[a].cast("double").alias(a) for a in tol])

    def close(s: Column, p: Column) -> Column:
        out = F.lit(True)
        for a, t in tol.items():
            out = out & (F.abs(s[a] - p[a]) < t)
        return F.coalesce(out, F.lit(False))

    def whole(p: Column) -> Column:
        out = F.lit(True)
        for a in tol:
            out = out & p[a].isNotNull()
        return out

    def go(leads: Column, p: Column) -> Column:
        alone = whole(p["row"]) & ~F.exists(leads, lambda s: close(s, p["row"]))
        return F.when(alone, F.array_append(leads, lead(p["row"]))).otherwise(leads)

    def named(leads: Column) -> Column:
        mine = lambda r: F.get(F.filter(leads, lambda s: close(s, r)), F.lit(0))["piece_id"]
        return F.transform("__all", lambda p: F.struct(p["row"].alias("row"), F.coalesce(mine(p["row"]), p["row"]["piece_id"]).alias("line_id")))

    plans = pieces.groupBy(F.struct(*keys).alias("__plan")).agg(F.collect_list(F.struct(*rest)).alias("__rows"))
    ranked = F.sort_array(F.transform("__rows", lambda r: F.struct((-r["length"]).alias("less"), r.alias("row"))))
    kind = f"struct<piece_id:{pieces.schema['piece_id'].dataType.simpleString()},{','.join(f'{a}:double' for a in tol)}>"
    out = plans.select("__plan", ranked.alias("__all"))
    out = out.withColumn("__leads", F.aggregate("__all", F.array().cast(f"array<{kind}>"), go))
    out = out.select("__plan", F.inline_outer(let(F.col("__leads"), named)))
    return out.select(*[F.col("__plan")[k].alias(k) for k in keys], "row.*", "line_id").select(*pieces.columns, "line_id")


def _groups_in_rounds(pieces: DataFrame, keys: Sequence[str], angle: float, step: float) -> DataFrame:
    """Rounds over whole tables: the longest open piece of a cell and all cells around it leads, since no
    leader still to come can take it in; open pieces that it takes in are done. Cells are as wide as the
    tolerances, a cell sends one row, and each neighbourhood has one new leader per round, so no pairs
    of pieces are made.

    Rows that were copied to 27 cells are met by merging: Spark estimates them from the rows before the
    copying, so it would send all of them through the driver as a broadcast."""
    keys, tol = list(keys), {"angle_deg": angle, "offset": step, "thickness": step}
    cell = {f"__c{i}": F.floor(F.col(a) / t).cast("bigint") for i, (a, t) in enumerate(tol.items())}
    rank = F.struct((-F.col("length")).alias("less"), F.col("piece_id").alias("piece_id")).alias("__rank")
    whole = F.lit(True)
    for a in tol:
        whole = whole & F.col(a).isNotNull()
    base = cut_lineage(pieces.filter(whole).select(*keys, *tol, rank, F.struct(*keys, *[c.alias(n) for n, c in cell.items()]).alias("__at")))

    def around(df: DataFrame) -> DataFrame:
        """Every row in its cell and the cells around it."""
        out = df
        for i, n in enumerate(cell):
            out = out.withColumn(f"__d{i}", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)])))
        moved = [(F.col("__at")[n] + F.col(f"__d{i}")).alias(n) for i, n in enumerate(cell)]
        return out.withColumn("__near", F.struct(*[F.col("__at")[k].alias(k) for k in keys], *moved)).drop(*[f"__d{i}" for i in range(len(cell))])

    def taken(rows: DataFrame, leaders: DataFrame) -> DataFrame:
        lead = around(leaders).select(F.col("__near").alias("__cell"), F.col("__rank").alias("__lead"), *[F.col(a).alias(f"__l_{a}") for a in tol])
        close = F.col("__lead") <= F.col("__rank")
        for a, t in tol.items():
            close = close & (F.abs(F.col(a) - F.col(f"__l_{a}")) < t)
        return rows.join(lead.hint("merge"), (F.col("__at") == F.col("__cell")) & close)

    open_, leaders = base, None
    while not open_.isEmpty():
        first = cut_lineage(open_.groupBy("__at").agg(F.min("__rank").alias("__rank")))
        least = around(first).groupBy("__near").agg(F.min("__rank").alias("__least"))
        new = first.join(least.hint("merge"), (F.col("__at") == F.col("__near")) & (F.col("__rank") == F.col("__least"))).select("__at", "__rank")
        named = new.select(F.col("__rank").alias("__r"))
        led = cut_lineage(open_.join(named, F.col("__rank") == F.col("__r"), "left_semi"))
        leaders = led if leaders is None else leaders.unionByName(led)
        gone = taken(open_, led).select(F.col("__rank").alias("__r"))
        open_ = cut_lineage(open_.join(gone, F.col("__rank") == F.col("__r"), "left_anti"))
    if leaders is None:
        return pieces.withColumn("line_id", F.col("piece_id"))
    led = taken(base, leaders).groupBy("__rank").agg(F.min("__lead")["piece_id"].alias("__line")).select(F.col("__rank")["piece_id"].alias("__p"), "__line")
    return pieces.join(led, F.col("piece_id") == F.col("__p"), "left").withColumn("line_id", F.coalesce("__line", "piece_id")).drop("__p", "__line")


def overlapping_neighbours(
    spans: DataFrame, keys: Sequence[str], start: str, end: str, row_id: str, min_gap: float = 0.05, block: Column | None = None
) -> DataFrame:
    """Consecutive spans of a key that are closer than ``min_gap``."""
    block = magnitude_block(F.col(start)) if block is None else block
    prev = scan(spans, keys, [start, end, row_id], block, previous={"__p": F.struct(F.col(end).alias("end"), F.col(row_id).alias("id"))})
    gap = F.col(start) - F.col("__p.end")
    return prev.filter(gap < min_gap).select(*keys, F.col("__p.id").alias("first_id"), F.col(row_id).alias("second_id"), gap.alias("gap"))


# ---------------------------------------------------------------- selections


def diverse_top_k(
    cands: DataFrame, keys: Sequence[str], k: int, order: Sequence[Column], suppressed: Column, row_id: str
) -> DataFrame:
    """Greedy choice of up to k candidates per key: the best open one, then the best that no chosen
    one suppresses, and so on. ``suppressed`` compares columns with those of the chosen row, named
    ``chosen.<column>``. k rounds of one combined maximum per key; no candidate is cut beforehand."""
    keys = list(keys)
    open_, picked = cut_lineage(cands), None
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    for n in range(1, k + 1):
        if open_.isEmpty():
            break
        best = open_.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in cands.columns if c not in keys]), rank).alias("chosen"))
        best = cut_lineage(best)
        part = best.select(*keys, "chosen.*", F.lit(n).alias("choice"))
        picked = part if picked is None else picked.unionByName(part)
        rest = attach(open_, best, keys).filter((F.col(row_id) != F.col(f"chosen.{row_id}")) & ~suppressed)
        open_ = cut_lineage(rest.select(*cands.columns))
    return cands.withColumn("choice", F.lit(0)).filter(F.lit(False)) if picked is None else picked


def camera_score(visible: Column, far: Column) -> Column:
    return 0.8 * visible + 0.2 * F.least(F.lit(1.0), far / 6.0)


def propose_views(cands: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Best k cameras, none within 1 m and 30° of a better chosen one; x, y, yaw_deg, score, cam_id."""
    turn = F.abs(F.pmod(F.col("yaw_deg") - F.col("chosen.yaw_deg") + 180, F.lit(360.0)) - 180)
    near = F.hypot(F.col("x") - F.col("chosen.x"), F.col("y") - F.col("chosen.y")) < 1.0
    order = [F.col("score"), -F.col("x"), -F.col("y"), -F.col("yaw_deg"), -F.col("cam_id")]
    return diverse_top_k(cands, keys, k, order, near & (turn < 30.0), "cam_id")


def best_candidate(candidates: DataFrame, key: str = "view_id") -> DataFrame:
    """Per view the passing candidate of the earliest attempt with the lowest edge delta, then seed;
    else the best failing one for a composite; else the base. ``composite_passed`` tells whether the
    view's composite passed."""
    order = F.struct("attempt", F.coalesce("edge_delta", F.lit(0.0)).alias("delta"), "seed", "candidate_id")
    fail_order = F.struct(F.coalesce("edge_delta", F.lit(0.0)).alias("delta"), "seed", "attempt", "candidate_id")
    agg = candidates.groupBy(key).agg(
        F.min_by(F.when(F.col("passed"), F.col("candidate_id")), F.when(F.col("passed"), order)).alias("__good"),
        F.min_by("candidate_id", fail_order).alias("__fail"),
        F.bool_or(F.coalesce("composite_passed", F.lit(False))).alias("__comp"),
        F.max("attempt").alias("attempts"),
    )
    status = F.when(F.col("__good").isNotNull(), "refined").when(F.col("__comp"), "hard_composite").otherwise("fallback_base")
    return agg.select(
        key, status.alias("status"),
        F.when(F.col("__good").isNotNull(), F.col("__good")).when(F.col("__comp"), F.col("__fail")).alias("delivered"), "attempts",
    )


def newest(df: DataFrame, n: int, *order: str) -> DataFrame:
    """Newest n rows of a table; a distributed top-n, no full sort."""
    return df.orderBy(*[F.desc(o) for o in order]).limit(n)


def newest_per_key(df: DataFrame, keys: Sequence[str], n: int, *order: str) -> DataFrame:
    """Newest n rows per key. Spark limits each group before the shuffle, so a hot key sends n rows
    per task."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def audit_tail(log: DataFrame, n: int) -> DataFrame:
    """Newest n audit rows."""
    return newest(log, n, "id")


def list_jobs(jobs: DataFrame, n: int = 100) -> DataFrame:
    """Newest n jobs of every project."""
    return newest_per_key(jobs, ["project_id"], n, "created_at", "id")


def latest_job(jobs: DataFrame, kind: str) -> DataFrame:
    """Newest job of a kind per project."""
    return latest_by(jobs.filter(F.col("kind") == kind), ["project_id"], F.col("created_at"), F.col("id"))


def list_review(items: DataFrame, status: str = "open") -> DataFrame:
    """Review items of a status, oldest first."""
    return items.filter(F.col("status") == status).orderBy("created_at", "id")


def last_assumption(items: DataFrame, defaults: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """One value per key: the last one used, else the default."""
    used = items.groupBy(*keys).agg(F.max_by(F.struct("value", "reason"), "seq").alias("u"))
    d = defaults.select(*keys, F.col("value").alias("__default"))
    j = used.join(d, list(keys), "full_outer")
    return j.select(*keys, F.coalesce("u.value", "__default").alias("value"), F.col("u.reason").alias("reason"), F.col("u").isNotNull().alias("used"))


# ---------------------------------------------------------------- graphs


#: Hops of ``reachable`` that are made one by one; nodes (narrow rows) that are sent to every task for one.
HOPS, FEW_NODES = 8, 200_000


def reachable(edges: DataFrame, entries: DataFrame, node: str = "node") -> DataFrame:
    """Nodes reachable from the entries over undirected edges (a, b). The first ``HOPS`` hops go out from
    the newest nodes alone, which costs a pass over the edges each and touches no other component; what
    is left of longer ways is found by components, in about log(n) rounds."""
    start = entries.select(F.col(node).alias("id")).distinct()
    seen = fresh = cut_lineage(start)
    for _ in range(HOPS):
        near = F.broadcast(fresh) if fresh.count() <= FEW_NODES else fresh
        hit = [edges.join(near.withColumnRenamed("id", x), x, "left_semi").select(F.col(y).alias("id")) for x, y in (("a", "b"), ("b", "a"))]
        fresh = cut_lineage(hit[0].union(hit[1]).filter("id is not null").distinct().join(seen, "id", "left_anti"))
        if fresh.isEmpty():
            return seen.select(F.col("id").alias(node))
        seen = seen.union(fresh)
    inner = seen.join(fresh, "id", "left_anti")  # all of their edges have been followed
    rest = edges
    for x in ("a", "b"):
        rest = rest.join(inner.select(F.col("id").alias(x)), x, "left_anti")
    found = components(rest)
    hit = found.join(fresh, "id").select("component").distinct()
    far = found.join(hit, "component", "left_semi").select("id")
    return seen.union(far).distinct().select(F.col("id").alias(node))
