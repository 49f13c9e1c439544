"""Joins: listings, links, votes, overlaps, nearest, one-to-one, tolerance, containment, lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from draftlake.functions import text as tx
from draftlake.functions.numeric import box_area, box_iou, box_overlap, n_rows
from draftlake.functions.ordered import attach, magnitude_block, numbered, scan
from draftlake.session import cut_lineage

# Roles from weakest to strongest.
ROLES = ["viewer", "reviewer", "editor", "admin"]
BOX = ["x0", "y0", "x1", "y1"]


def list_pages(pages: DataFrame, docs: DataFrame, analysis: DataFrame) -> DataFrame:
    """Pages with their document and, where it exists, their analysis; a user's label wins and
    clears the review flag. The reader of the result sorts it."""
    d = docs.select(F.col("id").alias("document_id"), "filename", "created_at")
    a = analysis.select(
        F.col("page_id").alias("id"), F.col("label").alias("model_label"), "confidence",
        F.col("needs_review").alias("__review"), F.nullif("override_label", F.lit("")).alias("__own"),
        F.lit(True).alias("__analysed"),
    )
    return (
        pages.join(d, "document_id")
        .join(a, "id", "left")
        .withColumns(
            {
                "label": F.coalesce("__own", "model_label"),
                "needs_review": F.coalesce(F.col("__review"), F.lit(False)) & F.col("__own").isNull(),
                "overridden": F.col("__own").isNotNull(),
                "analysed": F.coalesce("__analysed", F.lit(False)),
            }
        )
        .drop("__review", "__own", "__analysed")
    )


def role_rank(role: Column) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in ROLES]), role)


def visible_projects(
    projects: DataFrame, members: DataFrame, user: str | int, role: str = "editor", action: str = "viewer"
) -> DataFrame:
    """Projects a user may see or act on: all for an admin, else own ones and memberships with at
    least the action's role."""
    live = projects.filter(F.col("purged_at").isNull())
    if role == "admin":
        return live
    if ROLES.index(role) < ROLES.index(action):
        return live.filter(F.lit(False))
    mine = members.filter(
        (F.col("user_id") == user) & (role_rank(F.col("role")) >= ROLES.index(action) + 1)
    ).select(F.col("project_id").alias("id")).distinct().withColumn("__member", F.lit(True))
    seen = (F.col("created_by") == user) | F.col("__member").isNotNull()
    return live.join(mine, "id", "left").filter(seen).drop("__member")


def tag_links(rows: DataFrame, hits: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Long form: one row per (listed row, plan occurrence) with the same tag."""
    keys = [*scope, "tag"]
    h = hits.select(*keys, *[F.col(c).alias(f"hit_{c}") for c in hits.columns if c not in keys])
    return rows.join(h, keys)


def link_tags(
    rows: DataFrame, hits: DataFrame, scope: Sequence[str] = (), page: str = "page_id"
) -> DataFrame:
    """Rows with ``links`` (occurrences) and ``pages`` (distinct pages). Occurrences of listed tags are
    reduced per tag before the join, so the join is many-to-one however often a tag occurs."""
    keys = [*scope, "tag"]
    listed = hits.join(rows.select(*keys).distinct(), keys, "left_semi")
    per_page = listed.groupBy(*keys, page).agg(F.count(F.lit(1)).alias("__n"))
    found = per_page.groupBy(*keys).agg(F.sum("__n").alias("links"), F.count(F.lit(1)).alias("pages"))
    return rows.join(found, keys, "left").fillna(0, ["links", "pages"])


def unlinked_rows(rows: DataFrame, hits: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    keys = [*scope, "tag"]
    return rows.filter(F.col("tag").isNotNull()).join(hits.select(*keys).distinct(), keys, "left_anti")


def link_report(linked: DataFrame, scope: Sequence[str]) -> DataFrame:
    return linked.groupBy(*scope).agg(
        F.count_if(F.col("links") > 0).alias("linked"),
        F.count_if(F.col("tag").isNotNull() & (F.col("links") == 0)).alias("unlinked"),
    )


def unanimous_vote(
    readings: DataFrame, item: Sequence[str], tier: str, reading: str, min_n: int = 2, times: str | None = None
) -> DataFrame:
    """Per item the reading of the first tier in which at least ``min_n`` readings agree and none
    differs. Only minimum, maximum and count are kept per tier; ``times`` counts a row more than once."""
    seen = readings.filter(F.col(reading).isNotNull() & (F.col(reading) != ""))
    tiers = seen.groupBy(*item, tier).agg(
        F.min(reading).alias("__lo"), F.max(reading).alias("__hi"),
        (F.count(F.lit(1)) if times is None else F.sum(times)).alias("__n"),
    )
    good = tiers.filter((F.col("__n") >= min_n) & (F.col("__lo") == F.col("__hi")))
    return good.groupBy(*item).agg(F.min_by("__lo", tier).alias(reading), F.min(tier).alias(tier))


def read_bubble_tags(readings: DataFrame, text_tags: DataFrame, page: str = "page_id") -> DataFrame:
    """Bubble tags: vote over plain readings per tier, then over readings with look-alikes repaired;
    tags the text layer already has are left out."""
    # equal readings of a bubble are counted first, each is read once
    counted = readings.filter(F.col("reading").isNotNull()).groupBy(page, "bubble_id", "tier", "reading").agg(F.count(F.lit(1)).alias("n"))
    both = counted.select(
        page, "bubble_id", "n",
        F.inline(
            F.array(
                F.struct(F.col("tier").alias("tier"), tx.normalise_tag(F.col("reading")).alias("tag")),
                F.struct((F.col("tier") + 1000).alias("tier"), tx.repair_lookalikes(F.col("reading")).alias("tag")),
            )
        ),
    )
    tags = unanimous_vote(both, [page, "bubble_id"], "tier", "tag", times="n")
    tags = tags.join(text_tags.select(page, "tag").distinct(), [page, "tag"], "left_anti")
    return tags.withColumn("kind", tx.tag_kind(F.col("tag")))


# ---------------------------------------------------------------- overlapping boxes


def _cells_of(lo: str, hi: str, size: float) -> Column:
    return F.sequence(F.floor(F.col(lo) / size).cast("bigint"), F.floor(F.col(hi) / size).cast("bigint"))


def readable_boxes(boxes: DataFrame, edge: float = 3.0, min_confidence: float = 0.30) -> DataFrame:
    """Boxes worth merging: confident, not blank, not cut by an inner tile edge (tile_* columns give
    the tile, page_w/page_h the page), from the rotated pass only tall ones of several letters."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    text = F.trim("text")
    cut = (
        ((F.col("x0") <= edge) & (F.col("tile_x") > 0))
        | ((F.col("y0") <= edge) & (F.col("tile_y") > 0))
        | ((F.col("x1") >= F.col("tile_w") - edge) & (F.col("tile_x") + F.col("tile_w") < F.col("page_w")))
        | ((F.col("y1") >= F.col("tile_h") - edge) & (F.col("tile_y") + F.col("tile_h") < F.col("page_h")))
    )
    upright = (F.col("rotation") == 0) | ((h > 1.2 * w) & (F.length(text) > 1))
    kept = boxes.filter((F.col("confidence") >= min_confidence) & (text != "") & upright & ~cut)
    return kept.withColumns(
        {
            "x0": F.col("x0") + F.col("tile_x"), "x1": F.col("x1") + F.col("tile_x"),
            "y0": F.col("y0") + F.col("tile_y"), "y1": F.col("y1") + F.col("tile_y"),
        }
    )


def suppress_overlaps(boxes: DataFrame, keys: Sequence[str], cell: float = 64.0) -> DataFrame:
    """Boxes kept by greedy de-duplication, strongest first (ties by box_id).

    Exact copies (same box, same folded text) are reduced first, so stacked copies make no pairs.
    Candidate pairs meet in grid cells, each in exactly one. Then rounds: a box without an open
    stronger rival is kept, rivals of kept boxes fall; every round decides at least the strongest
    open box of each cluster.
    """
    keys = list(keys)
    marked = boxes.withColumn("__key", tx.fold(F.col("text")))
    strength = F.struct(F.col("confidence"), -F.col("box_id"))
    unique = marked.groupBy(*keys, *BOX, "__key").agg(
        F.max_by(F.struct("box_id", "confidence"), strength).alias("__b")
    ).select(*keys, *BOX, "__key", "__b.*")
    unique = cut_lineage(unique)
    gridded = unique.withColumn("gx", F.explode(_cells_of("x0", "x1", cell))).withColumn(
        "gy", F.explode(_cells_of("y0", "y1", cell))
    )
    a, b = gridded.alias("a"), gridded.alias("b")
    on = (F.col("a.gx") == F.col("b.gx")) & (F.col("a.gy") == F.col("b.gy"))
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    stronger = F.struct("a.confidence", -F.col("a.box_id")) > F.struct("b.confidence", -F.col("b.box_id"))
    home = (F.floor(F.greatest("a.x0", "b.x0") / cell) == F.col("a.gx")) & (
        F.floor(F.greatest("a.y0", "b.y0") / cell) == F.col("a.gy")
    )
    ba = {c: F.col(f"a.{c}") for c in BOX}
    bb = {c: F.col(f"b.{c}") for c in BOX}
    area = F.greatest(box_area(**bb), F.lit(1e-9))
    hides = ((F.col("a.__key") == F.col("b.__key")) & (box_iou(ba, bb) > 0.3)) | (
        box_overlap(ba, bb) / area > 0.5
    )
    pairs = cut_lineage(
        a.join(b, on & stronger & home & hides).select(
            F.col("a.box_id").alias("strong"), F.col("b.box_id").alias("weak")
        )
    )
    open_, kept = unique.select("box_id"), None
    while True:
        live = pairs.join(open_.select(F.col("box_id").alias("strong")), "strong", "left_semi")
        free = open_.join(live.select(F.col("weak").alias("box_id")), "box_id", "left_anti")
        free = cut_lineage(free)
        kept = free if kept is None else kept.unionByName(free)
        fallen = pairs.join(free.select(F.col("box_id").alias("strong")), "strong", "left_semi")
        rest = open_.join(free, "box_id", "left_anti").join(
            fallen.select(F.col("weak").alias("box_id")), "box_id", "left_anti"
        )
        open_ = cut_lineage(rest)
        pairs = cut_lineage(pairs.join(open_.select(F.col("box_id").alias("weak")), "weak", "left_semi"))
        if open_.isEmpty():
            return boxes.join(kept, "box_id", "left_semi")


# ---------------------------------------------------------------- nearest


def nearest_line(
    words: DataFrame, segments: DataFrame, keys: Sequence[str], max_gap: float, cell: float = 128.0
) -> DataFrame:
    """Dimension words with the nearest parallel segment (2°) whose middle half they face.

    Words and segments meet in grid cells: the segment fills the cells of its box grown by the gap,
    the word has one cell. ``words`` need word_no, cx, cy, angle_deg; ``segments`` segment_id and ends.
    """
    keys = list(keys)
    dx, dy = F.col("sx1") - F.col("sx0"), F.col("sy1") - F.col("sy0")
    length = F.hypot(dx, dy)
    s = segments.select(*keys, "segment_id", *[F.col(c).alias(f"s{c}") for c in BOX]).withColumns(
        {"length": length, "ux": dx / length, "uy": dy / length}
    ).filter(F.col("length") > 1e-6)
    span = lambda a, b: F.sequence(
        F.floor((F.least(a, b) - max_gap) / cell).cast("bigint"),
        F.floor((F.greatest(a, b) + max_gap) / cell).cast("bigint"),
    )
    s = s.withColumn("gx", F.explode(span("sx0", "sx1"))).withColumn("gy", F.explode(span("sy0", "sy1")))
    w = words.withColumns(
        {"gx": F.floor(F.col("cx") / cell).cast("bigint"), "gy": F.floor(F.col("cy") / cell).cast("bigint")}
    )
    rad = F.radians("angle_deg")
    parallel = F.abs(F.col("ux") * F.cos(rad) - F.col("uy") * F.sin(rad)) > F.cos(F.radians(F.lit(2.0)))
    rx, ry = F.col("cx") - F.col("sx0"), F.col("cy") - F.col("sy0")
    along = rx * F.col("ux") + ry * F.col("uy")
    met = w.join(s, [*keys, "gx", "gy"]).withColumns(
        {"perp": F.abs(rx * F.col("uy") - ry * F.col("ux")), "__along": along}
    )
    fits = (F.col("perp") <= max_gap) & F.col("__along").between(0.25 * F.col("length"), 0.75 * F.col("length"))
    return (
        met.filter(parallel & fits)
        .groupBy(*keys, "word_no")
        .agg(F.min_by(F.struct("segment_id", "length", "perp"), F.struct("perp", "segment_id")).alias("s"))
        .select(*keys, "word_no", "s.*")
    )


def open_segments(paths: DataFrame, keys: Sequence[str], max_width: float | None = None) -> DataFrame:
    """Straight segments of open, unclipped, thin sub-paths (``points array<struct<x,y>>``)."""
    ok = ~F.col("clip") & ~F.col("closed") & ~F.col("curve")
    if max_width is not None:
        ok = ok & (F.coalesce("width", F.lit(0.0)) <= max_width)
    n = F.size("points")
    seg = F.transform(
        F.slice("points", F.lit(1), F.greatest(n - 1, F.lit(0))),
        lambda p, i: F.struct(
            p["x"].alias("x0"), p["y"].alias("y0"),
            F.get("points", i + 1)["x"].alias("x1"), F.get("points", i + 1)["y"].alias("y1"),
        ),
    )
    return paths.filter(ok).select(*keys, F.inline(seg))


def nearest_value(
    left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, left_id: str, right_id: str
) -> DataFrame:
    """Per left row the right row of the same key with the nearest value (ties: lower value). Both
    neighbours come from two ordered scans of the union, so a hot key costs no pairs."""
    keys = list(keys)
    r = right.groupBy(*keys, value).agg(F.min(right_id).alias("__rid"))
    lonely = left.select(*keys, value, left_id).withColumn("__rid", F.lit(None).cast(right.schema[right_id].dataType))
    marks = lonely.unionByName(r.withColumn(left_id, F.lit(None).cast(left.schema[left_id].dataType)))
    marks = marks.withColumns({"__side": F.col(left_id).isNotNull().cast("int"), "__neg": -F.col(value)})
    hit = F.when(F.col("__rid").isNotNull(), F.struct(F.col("__rid").alias("id"), F.col(value).alias("v")))
    down = scan(marks, keys, [value, "__side"], magnitude_block(F.col(value)), last_seen={"__lo": hit})
    up = scan(down, keys, ["__neg", "__side"], magnitude_block(F.col("__neg")), last_seen={"__hi": hit})
    lo, hi = F.col(value) - F.col("__lo.v"), F.col("__hi.v") - F.col(value)
    best = F.when(hi.isNull() | (lo <= hi), F.col("__lo")).otherwise(F.col("__hi"))
    best = F.coalesce(best, F.col("__hi"))
    return up.filter(F.col(left_id).isNotNull()).select(
        *keys, left_id, value, best["id"].alias(right_id), best["v"].alias("nearest")
    )


def near_pairs_1d(
    left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, left_id: str, right_id: str, tol: float
) -> DataFrame:
    """Candidate pairs within ``tol`` of each other: the left row visits its own and both
    neighbouring buckets of width ``tol``."""
    cell = F.floor(F.col(value) / tol).cast("bigint")
    a = left.select(*keys, left_id, F.col(value).alias("__a"), F.explode(F.sequence(cell - 1, cell + 1)).alias("__g"))
    b = right.select(*keys, right_id, F.col(value).alias("__b"), cell.alias("__g"))
    gap = F.abs(F.col("__a") - F.col("__b"))
    return a.join(b, [*keys, "__g"]).filter(gap <= tol).select(*keys, left_id, right_id, gap.alias("score"))


def match_one_to_one(pairs: DataFrame, left: str, right: str, score: str = "score") -> DataFrame:
    """Greedy one-to-one matching by ascending (score, left, right).

    Rounds keep the pairs that are best on both sides and remove every pair of a matched side. With
    a total order this equals the sequential greedy result. Best pairs are aggregates, not windows.
    """
    rank = F.struct(score, left, right)
    rest, done = cut_lineage(pairs.select(left, right, score).distinct()), None
    while not rest.isEmpty():
        by_left = rest.groupBy(left).agg(F.min(rank).alias("p"))
        by_right = rest.groupBy(right).agg(F.min(rank).alias("p"))
        mutual = by_left.select("p").join(by_right.select("p"), "p").select("p.*")
        mutual = cut_lineage(mutual.select(left, right, score))
        done = mutual if done is None else done.unionByName(mutual)
        rest = cut_lineage(
            rest.join(mutual.select(left), left, "left_anti").join(mutual.select(right), right, "left_anti")
        )
    return pairs.select(left, right, score).filter(F.lit(False)) if done is None else done


def carry_over_rooms(pairs: DataFrame) -> DataFrame:
    """Old rooms kept for new ones: new rooms choose by falling area, each the old room it overlaps
    most among the free ones, and keeps it when the overlap is at least half of the smaller room.

    ``pairs`` has new_id, new_area, old_id, old_area, overlap. A new room is settled in a round when no
    larger undecided room reaches the old room it wants; so every round equals the sequential order.
    """
    rest, kept = cut_lineage(pairs.filter("overlap > 0")), None
    while not rest.isEmpty():
        want = rest.groupBy("new_id", "new_area").agg(
            F.max_by(F.struct("old_id", "old_area", "overlap"), F.struct("overlap", F.col("old_id"))).alias("w")
        ).select("new_id", "new_area", "w.*")
        first = rest.groupBy("old_id").agg(F.max_by("new_id", F.struct("new_area", "new_id")).alias("__first"))
        settled = cut_lineage(want.join(first, "old_id").filter(F.col("new_id") == F.col("__first")).drop("__first"))
        good = settled.filter(F.col("overlap") >= 0.5 * F.least("new_area", "old_area"))
        part = good.select("new_id", "old_id", "overlap")
        kept = part if kept is None else kept.unionByName(part)
        rest = cut_lineage(
            rest.join(settled.select("new_id"), "new_id", "left_anti").join(good.select("old_id"), "old_id", "left_anti")
        )
    return pairs.select("new_id", "old_id", "overlap").filter(F.lit(False)) if kept is None else kept


#: Parts of the reach up to which tags are dealt, one after the other.
NEARER = [1 / 64, 1 / 16, 1 / 4, 1]


def assign_tags(texts: DataFrame, openings: DataFrame, keys: Sequence[str], reach: float = 1.5) -> DataFrame:
    """Door and window tags to the nearest compatible opening within reach; each opening and each tag
    text is used once per plan, nearest pairs first. ``texts`` need text, x, y; ``openings``
    opening_id, type, x, y.

    Pairs are taken in the order of their distance, so those within a part of the reach are settled
    first, and only tags and openings that are left look further. Pairs that no order could take are
    not listed."""
    keys = list(keys)
    tag = tx.normalise_tag(F.col("text"))
    t = texts.filter(F.length("text") <= 6).withColumn("tag", tag).withColumn("kind", tx.tag_kind(F.col("tag")))
    t = t.filter(F.col("kind").isNotNull()).select(*keys, "tag", "kind", F.col("x").alias("tx"), F.col("y").alias("ty"))
    t = cut_lineage(t.distinct())  # tags are read once
    spots = openings.select(*keys, "type", "x", "y", "opening_id").distinct()
    out = None
    for part in NEARER:
        found = _tags_within(t, spots, keys, part * reach)
        out = found if out is None else out.unionByName(found)
        if part < 1:
            t = t.join(found.select(*keys, "tag"), [*keys, "tag"], "left_anti")
            spots = spots.join(found.select(*keys, "opening_id"), [*keys, "opening_id"], "left_anti")
    return out


def _tags_within(t: DataFrame, spots: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """Greedy pairs of tags and openings up to one distance."""
    cell = lambda c: F.floor(F.col(c) / reach).cast("bigint")
    spot = ["type", "x", "y"]
    # an id that is given in several places counts in each of them, so the bound grows as often
    repeats = spots.groupBy(*keys, "opening_id").agg(n_rows().alias("__r")).groupBy(*keys).agg(F.max("__r").alias("__r"))
    tags = t.groupBy(*keys).agg(F.count_distinct("tag").alias("__tags")).join(repeats, keys)
    tags = cut_lineage(tags.select(*keys, (F.col("__tags") * F.col("__r")).alias("__tags")))
    for c, g in (("tx", "gx"), ("ty", "gy")):
        t = t.withColumn(g, F.explode(F.sequence(cell(c) - 1, cell(c) + 1)))
    # openings of one type and place are met once, as a spot
    o = spots.groupBy(*keys, *spot).agg(n_rows().alias("__n")).withColumns({"gx": cell("x"), "gy": cell("y")})
    doors, windows = ["door", "double_door", "sliding_door", "french_door", "opening", "pass"], ["window", "french_door"]
    fits = F.when(F.col("kind") == "door", F.col("type").isin(doors)).otherwise(F.col("type").isin(windows))
    d = F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))
    near = t.join(o, [*keys, "gx", "gy"]).filter(fits & (d <= reach))
    near = cut_lineage(near.groupBy(*keys, "tag", *spot).agg(F.min(d).alias("score"), F.first("__n").alias("__n")))
    # a tag loses at most one opening to each other tag, so no tag goes beyond as many openings as there are
    # tags: of a tag, the steps of distance that reach this number are kept; of a spot, as many openings
    step = magnitude_block(F.col("score"))
    steps = near.groupBy(*keys, "tag", step.alias("__step")).agg(F.sum("__n").alias("__n"))
    steps = scan(steps, [*keys, "tag"], ["__step"], F.floor(F.col("__step") / 4096), running_sum={"__cum": F.col("__n")})
    steps = steps.join(tags, keys).filter(F.col("__cum") - F.col("__n") < F.col("__tags")).select(*keys, "tag", "__step")
    near = near.withColumn("__step", step).join(steps, [*keys, "tag", "__step"]).select(*keys, "tag", *spot, "score")
    first = W.partitionBy(*keys, *spot).orderBy("opening_id")
    part = F.pmod(F.xxhash64("opening_id"), F.lit(64))
    used = spots.select(*keys, *spot, "opening_id", F.row_number().over(W.partitionBy(*keys, *spot, part).orderBy("opening_id")).alias("__at"))
    used = used.join(tags, keys).filter(F.col("__at") <= F.col("__tags")).withColumn("__at", F.row_number().over(first))
    used = used.filter(F.col("__at") <= F.col("__tags")).select(*keys, *spot, "opening_id")
    name = lambda c: F.struct(*keys, F.col(c).alias("v"))
    pairs = near.join(used, [*keys, *spot]).groupBy(name("opening_id").alias("l"), name("tag").alias("r")).agg(F.min("score").alias("score"))
    out = match_one_to_one(pairs, "l", "r")
    return out.select(*[F.col(f"l.{k}").alias(k) for k in keys], F.col("l.v").alias("opening_id"), F.col("r.v").alias("tag"), F.col("score").alias("distance"))


def match_values(
    left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, left_id: str, right_id: str, tol: float
) -> DataFrame:
    """Greedy one-to-one matching by distance of a number within ``tol``; equal to
    :func:`match_one_to_one` over all pairs in reach, without listing them for repeated values.

    Equal values come first in the greedy order and pair up by rank. Of the rest, rows with one value
    are interchangeable and taken by ascending id, so a value needs no more rows than the other side
    has in reach. Ids must be whole numbers.
    """
    keys = list(keys)
    at = [*keys, value]
    slice_of = lambda c: F.floor(F.col(c) / 4096)
    a = numbered(left.select(*at, left_id), at, [left_id], slice_of(left_id), "__rank")
    b = numbered(right.select(*at, right_id), at, [right_id], slice_of(right_id), "__rank")
    same = cut_lineage(a.join(b, [*at, "__rank"]).select(*keys, left_id, right_id, F.lit(0.0).alias("score")))
    rest_a = left.select(*at, left_id).join(same.select(left_id), left_id, "left_anti")
    rest_b = right.select(*at, right_id).join(same.select(right_id), right_id, "left_anti")
    cell = F.floor(F.col(value) / tol).cast("bigint")

    def needed(mine: DataFrame, mine_id: str, other: DataFrame) -> DataFrame:
        reach = other.groupBy(*keys, cell.alias("__g0")).agg(F.count(F.lit(1)).alias("__c"))
        reach = reach.select(*keys, F.explode(F.sequence(F.col("__g0") - 1, F.col("__g0") + 1)).alias("__g"), "__c")
        reach = reach.groupBy(*keys, "__g").agg(F.sum("__c").alias("__reach"))
        ranked = numbered(mine, at, [mine_id], slice_of(mine_id), "__rank").withColumn("__g", cell)
        kept = ranked.join(reach, [*keys, "__g"]).filter(F.col("__rank") <= F.col("__reach"))
        return kept.select(*at, mine_id)

    small_a, small_b = cut_lineage(needed(rest_a, left_id, rest_b)), cut_lineage(needed(rest_b, right_id, rest_a))
    pairs = near_pairs_1d(small_a, small_b, keys, value, left_id, right_id, tol)
    near = match_one_to_one(pairs, left_id, right_id)
    scope = left.select(left_id, *keys)
    return same.unionByName(near.join(scope, left_id).select(*keys, left_id, right_id, "score"))


# ---------------------------------------------------------------- tolerance and containment


def within_box(
    samples: DataFrame, targets: DataFrame, keys: Sequence[str], tol: dict[str, float], sample_id: str
) -> DataFrame:
    """Samples with some target within every tolerance. Targets are reduced to distinct positions;
    each sample visits the 3^n neighbour cells and the semi join stops at the first hit."""
    dims = list(tol)
    grid = {f"__g{i}": F.floor(F.col(d) / tol[d]).cast("bigint") for i, d in enumerate(dims)}
    t = targets.select(*keys, *dims).distinct().withColumns(grid)
    t = t.select(*keys, *grid, *[F.col(d).alias(f"__t_{d}") for d in dims])
    s = samples.withColumns(grid)
    for g in grid:
        s = s.withColumn(g, F.explode(F.sequence(F.col(g) - 1, F.col(g) + 1)))
    sa, ta = s.alias("s"), t.alias("t")
    on = F.lit(True)
    for k in [*keys, *grid]:
        on = on & (F.col(f"s.{k}") == F.col(f"t.{k}"))
    for d in dims:
        on = on & (F.abs(F.col(f"s.{d}") - F.col(f"t.__t_{d}")) <= tol[d])
    hit = sa.join(ta, on, "left_semi").select(sample_id).distinct()
    return samples.join(hit, sample_id, "left_semi")


def within_tolerance(
    samples: DataFrame, lines: DataFrame, keys: Sequence[str], tol: float = 0.05, cell: float = 0.5
) -> DataFrame:
    """Samples (sample_id, x, y, angle, thickness) lying on some line of the same key: distance within
    ``tol``, direction within 5°, thickness within max(3 cm, 20 %). Lines are straight pieces
    (ends, thickness); each fills the grid cells of its box grown by the tolerance."""
    keys = list(keys)
    span = lambda a, b: F.sequence(
        F.floor((F.least(a, b) - tol) / cell).cast("bigint"), F.floor((F.greatest(a, b) + tol) / cell).cast("bigint")
    )
    piece = lines.select(
        *keys, F.col("x0").alias("ax"), F.col("y0").alias("ay"), F.col("x1").alias("bx"),
        F.col("y1").alias("by"), F.col("thickness").alias("t2"),
    ).distinct()
    piece = piece.withColumn("gx", F.explode(span("ax", "bx"))).withColumn("gy", F.explode(span("ay", "by")))
    s = samples.withColumns(
        {"gx": F.floor(F.col("x") / cell).cast("bigint"), "gy": F.floor(F.col("y") / cell).cast("bigint")}
    )
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    along = ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-12))
    u = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    dist = F.hypot(F.col("x") - F.col("ax") - u * dx, F.col("y") - F.col("ay") - u * dy)
    turn = F.abs(F.pmod(F.col("angle") - F.atan2(dy, dx), F.lit(3.141592653589793)))
    turn = F.least(turn, 3.141592653589793 - turn)
    thick = F.abs(F.col("thickness") - F.col("t2")) <= F.greatest(F.lit(0.03), 0.2 * F.col("t2"))
    on = F.lit(True)
    sa, pa = s.alias("s"), piece.alias("p")
    for k in [*keys, "gx", "gy"]:
        on = on & (F.col(f"s.{k}") == F.col(f"p.{k}"))
    on = on & (dist <= tol) & (turn <= F.radians(F.lit(5.0))) & thick
    return sa.join(pa, on, "left_semi").drop("gx", "gy")


def coverage(samples: DataFrame, hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of samples hit per key, 0 without samples."""
    n = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"))
    h = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"))
    return attach(n, h, keys, "left").fillna(0, ["hits"]).withColumn("share", F.col("hits") / F.col("samples"))


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule over an ``array<struct<x,y>>`` ring."""
    n = F.size(ring)
    crossings = F.transform(
        ring,
        lambda p, i: F.when(
            ((p["y"] > y) != (F.get(ring, (i + n - 1) % n)["y"] > y))
            & (
                x
                < (F.get(ring, (i + n - 1) % n)["x"] - p["x"]) * (y - p["y"])
                / (F.get(ring, (i + n - 1) % n)["y"] - p["y"])
                + p["x"]
            ),
            1,
        ).otherwise(0),
    )
    return F.aggregate(crossings, F.lit(0), lambda s, c: s + c) % 2 == 1


def points_in_polygons(
    points: DataFrame, polys: DataFrame, keys: Sequence[str] = (), cell: float = 1.0
) -> DataFrame:
    """(point, polygon) pairs by containment; a polygon fills the grid cells of its box."""
    keys = list(keys)
    bound = lambda agg, f: agg(F.transform("ring", lambda p: p[f]))
    span = lambda f: F.sequence(
        F.floor(bound(F.array_min, f) / cell).cast("bigint"), F.floor(bound(F.array_max, f) / cell).cast("bigint")
    )
    p = polys.withColumn("gx", F.explode(span("x"))).withColumn("gy", F.explode(span("y")))
    q = points.withColumns(
        {"gx": F.floor(F.col("x") / cell).cast("bigint"), "gy": F.floor(F.col("y") / cell).cast("bigint")}
    )
    met = q.join(p, [*keys, "gx", "gy"])
    return met.filter(inside_ring(F.col("x"), F.col("y"), F.col("ring"))).drop("gx", "gy")


def room_labels(inside: DataFrame, keys: Sequence[str], known: Sequence[str]) -> DataFrame:
    """Name (known room words first, then the largest lettering), number and area label per room."""
    # each reading of a text is a column of its own: the aggregates use it in several places
    text = F.trim("text")
    read = inside.select(
        *keys, "word_no", "height", text.alias("__text"), F.when(F.length("text") <= 6, tx.normalise_tag(F.col("text"))).alias("__tag"),
        F.regexp_extract(text, r"(?i)^(\d+(?:[.,]\d+)?)\s*(?:m²|m2|m\^2|sqm|sq\.?\s*m)$", 1).alias("__area"),
    )
    tag, area, text = F.col("__tag"), F.col("__area"), F.col("__text")
    metres = tx.parse_number(area, F.when(F.contains(area, F.lit(",")), "tr").otherwise("en"))
    is_name = tag.isNull() & (area == "") & text.rlike(r"\p{L}") & ~text.startswith("+") & ~text.rlike(r"(?i)^(m²|m2|m\^2|sqm)$")
    read = read.withColumns({"__metres": F.when(area != "", metres), "__named": is_name})
    vocab = F.regexp_replace(tx.fold(text), r"\s+\d+$", "").isin(list(known))
    read = read.withColumn("__known", F.when(F.col("__named"), vocab))
    named, number = F.col("__named"), tag.isNotNull() & tx.tag_kind(tag).isNull()
    fits = F.col("__metres").between(0.5, 2000)
    return read.groupBy(*keys).agg(
        F.max_by(F.when(named, text), F.when(named, F.struct("__known", "height", -F.col("word_no")))).alias("name"),
        F.min_by(F.when(number, tag), F.when(number, F.col("word_no"))).alias("number"),
        F.max_by(F.when(fits, F.col("__metres")), F.when(fits, F.col("word_no"))).alias("label_area_m2"),
    )


def ceiling_heights(inside: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Highest ceiling label (2–15 m) of each room; ``height_m`` is the parsed label."""
    return inside.filter(F.col("height_m").between(2.0, 15.0)).groupBy(*keys).agg(
        F.max("height_m").alias("ceiling_height_m"), F.count(F.lit(1)).alias("labels")
    )


# ---------------------------------------------------------------- lookups


def enrich_with_schedule(
    openings: DataFrame, rows: DataFrame, keys: Sequence[str] = (), tolerance: float = 0.03
) -> tuple[DataFrame, DataFrame]:
    """(openings, conflicts). The last schedule row per tag overrides height and sill (0–6 m); its
    width (0.3–6 m) corroborates the drawn one within 3 cm, otherwise it is used and a conflict
    is recorded."""
    join_on = [*keys, "tag"]
    last = rows.groupBy(*join_on).agg(
        F.max_by(F.struct("row_id", "width", "height", "sill"), "order_no").alias("s")
    )
    out = openings.join(last, join_on, "left")
    w, drawn = F.col("s.width"), F.col("width_m")
    usable = w.between(0.3, 6.0)
    close = F.abs(drawn - w) <= tolerance
    status = F.when(usable & close, "corroborated").when(usable, "conflicted").otherwise(F.col("width_status"))
    plausible = lambda c, old: F.when(F.col(f"s.{c}").between(0.0, 6.0), F.col(f"s.{c}")).otherwise(F.col(old))
    conflicts = out.filter(usable & ~close).select(
        *keys, F.concat(F.lit("opening/"), F.col("opening_id"), F.lit("/width")).alias("key"),
        F.array(F.round(drawn, 4), w).alias("candidates"), F.lit(1).alias("proposed"),
        F.col("s.row_id").alias("detail"), F.lit("warning").alias("severity"),
    )
    enriched = out.withColumns(
        {
            "height_m": plausible("height", "height_m"), "sill_m": plausible("sill", "sill_m"),
            "width_status": status,
            "provenance": F.when(usable & close, F.concat("provenance", F.array(F.lit("schedule"))))
            .when(usable, F.concat(F.array(F.lit("schedule")), "provenance"))
            .otherwise(F.col("provenance")),
            "width_m": F.when(usable & ~close, w).otherwise(drawn),
            "matched": F.col("s").isNotNull(),
        }
    ).drop("s")
    return enriched, conflicts


def diff_facts(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Null-safe difference by identity: unchanged, changed, added or removed; changed and added
    facts count as confirmed by the user."""
    keys = list(keys)
    o = old.select(*keys, F.col(value).alias("old_value"), F.lit(True).alias("__o"))
    n = new.select(*keys, F.col(value).alias("new_value"), F.lit(True).alias("__n"))
    change = (
        F.when(F.col("__o").isNull(), "added")
        .when(F.col("__n").isNull(), "removed")
        .when(F.col("old_value").eqNullSafe(F.col("new_value")), "unchanged")
        .otherwise("changed")
    )
    both = o.join(n, keys, "full_outer").withColumn("change", change)
    return both.withColumn("user_confirmed", F.col("change").isin("added", "changed")).drop("__o", "__n")


def suggestions_with_decisions(versions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Suggestions inside extraction records, one row each, with the decision taken for the same
    root. ``versions`` needs root_id, version_id and pages array<struct<page_id, hints>>."""
    hints = versions.select("root_id", "version_id", F.explode("pages").alias("p")).select(
        "root_id", "version_id", "p.page_id", F.posexplode("p.hints").alias("hint_no", "hint")
    )
    d = decisions.groupBy("root_id", "hint").agg(F.max_by("decision", "order_no").alias("decision"))
    return hints.join(d, ["root_id", "hint"], "left").withColumn("open", F.col("decision").isNull())


def validate_overrides(
    overrides: DataFrame, surfaces: DataFrame, materials: DataFrame, elements: DataFrame
) -> DataFrame:
    """One row per broken rule: unknown surface, material or element, or a category mismatch."""
    s = surfaces.select("surface", F.col("category").alias("__sc"))
    m = materials.select("material", F.col("category").alias("__mc"))
    e = elements.select("element").distinct().withColumn("__e", F.lit(True))
    j = overrides.join(s, "surface", "left").join(m, "material", "left").join(e, "element", "left")
    codes = F.array_compact(
        F.array(
            F.when(F.col("surface").isNotNull() & F.col("__sc").isNull(), "unknown_surface"),
            F.when(F.col("material").isNotNull() & F.col("__mc").isNull(), "unknown_material"),
            F.when(F.col("__sc") != F.col("__mc"), "category_mismatch"),
            F.when(F.col("element").isNotNull() & F.col("__e").isNull(), "unknown_element"),
        )
    )
    return j.select(*overrides.columns, F.explode(codes).alias("code"))


def apply_overrides(base: DataFrame, overrides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Base rows replaced by the override with the same key."""
    return base.join(overrides.select(*keys), list(keys), "left_anti").unionByName(
        overrides.select(*base.columns)
    )


def follow_links(
    nodes: DataFrame, node: str, link: str, stop: Column | None = None
) -> DataFrame:
    """Per node the end of its chain of links: (node, target, depth, ended).

    A chain ends where ``stop`` holds or no link leads on. Pointers double every round, so a chain
    of length n takes log2(n) joins; a cycle never ends and is reported with ``ended`` false.
    """
    stop = F.lit(False) if stop is None else F.coalesce(stop, F.lit(False))
    known = nodes.select(F.col(node).alias("__known")).distinct()
    halted = stop | F.col(link).isNull() | F.col("__known").isNull()
    state = nodes.join(known, F.col(link) == F.col("__known"), "left").select(
        node,
        F.when(halted, F.col(node)).otherwise(F.col(link)).alias("target"),
        F.when(halted, 0).otherwise(1).cast("bigint").alias("depth"),
        halted.alias("ended"),
    )
    state = cut_lineage(state)
    rounds, limit = 0, max(1, nodes.count()).bit_length() + 1
    while rounds < limit and not state.filter(~F.col("ended")).isEmpty():
        step = state.select(
            F.col(node).alias("target"), F.col("target").alias("__t"), F.col("depth").alias("__d"),
            F.col("ended").alias("__e"),
        )
        state = state.join(step, "target").select(
            node, F.when(F.col("ended"), F.col("target")).otherwise(F.col("__t")).alias("target"),
            F.when(F.col("ended"), F.col("depth")).otherwise(F.col("depth") + F.col("__d")).alias("depth"),
            (F.col("ended") | F.col("__e")).alias("ended"),
        )
        state = cut_lineage(state)
        rounds += 1
    return state


def fallback_chain(registry: DataFrame, mock: str | None = None) -> DataFrame:
    """First usable entry along the fallback links of each entry, then the mock: status ok when it
    is the entry itself, degraded for another one, missing when there is none."""
    end = follow_links(registry, "name", "fallback", F.col("usable"))
    ok = registry.select(F.col("name").alias("target"), "usable")
    j = end.join(ok, "target", "left")
    found = F.col("usable") & F.col("ended")
    serving = F.when(found, F.col("target")).otherwise(F.lit(mock).cast("string"))
    status = F.when(found & (F.col("depth") == 0), "ok").when(serving.isNotNull(), "degraded").otherwise("missing")
    return j.select("name", serving.alias("serving"), status.alias("status"), F.when(found, F.col("depth")).alias("depth"))
