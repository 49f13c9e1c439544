"""Words with positions → bands, lines, label values and tables, for all pages at once.

A words table has the page keys and ``word_no, text, x0, y0, x1, y1, angle_deg``; ``word_no`` is
unique within a page. It may also be packed: the page keys and an array ``words`` of such words. A packed
page is worked through in its row, and only pages dealt over several rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.functions import text as tx
from draftlake.functions.ordered import attach, gap_islands
from draftlake.session import cut_lineage

# Folded label texts of a title block per field.
TITLE_LABELS = {
    "project": ["proje", "proje adi", "project", "project name", "is", "isin adi"],
    "sheet_title": ["pafta adi", "pafta", "drawing title", "sheet title", "title", "cizim adi"],
    "sheet_no": ["pafta no", "sheet no", "drawing no", "sheet number", "dwg no", "pafta numarasi"],
    "scale": ["olcek", "scale"],
    "date": ["tarih", "date"],
    "drawn": ["cizen", "drawn by", "drawn", "cizim"],
    "level": ["kat", "level", "floor"],
}
# Folded header texts of a schedule per column.
SCHEDULE_HEADERS = {
    "tag": ["poz", "poz no", "no", "kod", "tag", "mark", "ref", "tip no", "kapi no", "pencere no"],
    "room_no": ["mahal no", "room no", "room number", "oda no"],
    "room_name": ["mahal adi", "mahal", "room name", "room", "oda"],
    "type": ["tip", "cins", "type", "tur"],
    "width": ["genislik", "en", "width", "w", "genislik cm", "genislik mm"],
    "height": ["yukseklik", "boy", "height", "h", "yukseklik cm", "yukseklik mm"],
    "sill": ["parapet", "denizlik", "sill", "parapet yuksekligi", "sill height"],
    "qty": ["adet", "miktar", "qty", "quantity", "sayi"],
    "material": ["malzeme", "material", "cinsi"],
    "floor": ["zemin", "floor", "doseme", "zemin kaplamasi"],
    "walls": ["duvar", "walls", "wall", "duvar kaplamasi"],
    "ceiling": ["tavan", "ceiling"],
    "skirting": ["supurgelik", "skirting", "baseboard"],
}
LENGTH_COLUMNS = ["width", "height", "sill"]
HEADER_ROWS = 30
#: Values of labels inside a page's row.
VALUES = "array<struct<id:struct<strip:bigint,band:int,line:int>,value:string,x0:double,y0:double,x1:double,y1:double>>"


def dictionary(entries: dict[str, list[str]]) -> Column:
    """Constant map from a folded text to its canonical name."""
    pairs = [x for name, texts in entries.items() for t in texts for x in (F.lit(t), F.lit(name))]
    return F.create_map(*pairs)


# ---------------------------------------------------------------- bands and lines


def _band_starts(words: Column) -> Column:
    """First word (cy, word_no) of every band in one strip's words, sorted by centre: a word joins
    the running band while its centre is near the band's mean centre."""
    start = F.struct(
        F.array().cast("array<struct<cy:double,word_no:bigint>>").alias("starts"),
        F.lit(0.0).alias("first_h"), F.lit(0.0).alias("total"), F.lit(0).alias("n"),
    )

    def step(s: Column, w: Column) -> Column:
        near = (s["n"] > 0) & (
            F.abs(w["cy"] - s["total"] / s["n"]) < 0.45 * F.greatest(w["h"], s["first_h"])
        )
        here = F.struct(w["cy"].alias("cy"), w["word_no"].alias("word_no"))
        return F.struct(
            F.when(near, s["starts"]).otherwise(F.array_append(s["starts"], here)).alias("starts"),
            F.when(near, s["first_h"]).otherwise(w["h"]).alias("first_h"),
            (F.when(near, s["total"]).otherwise(0.0) + w["cy"]).alias("total"),
            (F.when(near, s["n"]).otherwise(0) + 1).alias("n"),
        )

    return F.aggregate(words, start, step, lambda s: s["starts"])


def _flat(words: DataFrame) -> DataFrame:
    """Level words with their centre."""
    flat = words.filter(F.abs(F.pmod(F.col("angle_deg") + 45, F.lit(180.0)) - 45) < 10)
    return flat.withColumn("cy", (F.col("y0") + F.col("y1")) / 2)


def strips(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Strip of every distinct centre of a page's words: keys, cy, strip, n (centres in the strip).

    Where consecutive centres are further apart than 0.45 of the tallest word of the page, a band
    ends in any case. The scan is block-wise and sees one row per centre; the result is written, since
    every pass over the words reads it.
    """
    keys = list(keys)
    centres = _flat(words).groupBy(*keys, "cy").agg(F.max(F.col("y1") - F.col("y0")).alias("h"))
    centres = cut_lineage(centres)
    tall = centres.groupBy(*keys).agg(F.max("h").alias("__tall"))
    parts = gap_islands(
        attach(centres, tall, keys).drop("h"), keys, ["cy"], F.floor(F.col("cy") / 1000).cast("bigint"),
        F.col("cy"), lambda before: F.col("cy") - before < 0.45 * F.col("__tall"), name="strip",
    )
    whole = parts.groupBy(*keys, "strip").agg(F.collect_list(F.struct("cy")).alias("all"))
    spots = whole.select(*keys, "strip", F.size("all").alias("n"), F.explode("all").alias("c"))
    return cut_lineage(spots.select(*keys, "c.cy", "strip", "n"))


def bands(words: DataFrame, keys: Sequence[str], spots: DataFrame | None = None) -> DataFrame:
    """One row per text band: keys, strip, band, words sorted by x. (strip, band) orders bands down
    the page. ``spots`` are the ``strips`` to use, with further columns per strip that are kept.

    The running mean of a band is sequential, but only inside a strip, so the sequential fold sees one
    strip (text lines chained by overlap), never a page; bands come out of the strip's own array.
    Words are packed per centre before they are shuffled; a second shuffle gathers strips of several
    centres where there are any.
    """
    keys = list(keys)
    spots = strips(words, keys) if spots is None else spots
    more = [c for c in spots.columns if c not in (*keys, "cy", "strip", "n")]
    # a fraction as a key is normalised anew in each operator, so grouping and join would not share a shuffle
    at = F.struct(*keys, (F.col("cy") + 0.0).cast("string").alias("cy")).alias("__spot")
    entry = F.struct(F.col("word_no").cast("bigint").alias("word_no"), "x0", "text", "x1", "y0", "y1")
    packed = _flat(words).groupBy(at).agg(F.collect_list(entry).alias("w"))
    packed = packed.join(spots.select(at, "strip", *more), "__spot")
    packed = packed.select(*[F.col("__spot")[k].alias(k) for k in keys], "strip", "w", *more)
    if not spots.filter("n > 1").isEmpty():
        rest = [F.first(c).alias(c) for c in more]
        packed = packed.groupBy(*keys, "strip").agg(F.flatten(F.collect_list("w")).alias("w"), *rest)
    full = F.transform("w", lambda w: F.struct(
        ((w["y0"] + w["y1"]) / 2).alias("cy"), w["word_no"].alias("word_no"), (w["y1"] - w["y0"]).alias("h"),
        *[w[c].alias(c) for c in ("x0", "text", "x1", "y0", "y1")],
    ))
    packed = packed.withColumn("w", F.sort_array(full))
    starts = packed.withColumn("starts", _band_starts(F.col("w"))).select(
        *keys, "strip", "w", "starts", *more, F.posexplode("starts").alias("band", "first")
    )
    after = F.get("starts", F.col("band") + 1)
    spot = lambda w: F.struct(w["cy"], w["word_no"])
    mine = F.filter("w", lambda w: (spot(w) >= F.col("first")) & (after.isNull() | (spot(w) < after)))
    by_x = F.sort_array(
        F.transform(mine, lambda w: F.struct(
            w["x0"].alias("x0"), w["word_no"].alias("word_no"), w["text"].alias("text"),
            w["x1"].alias("x1"), w["y0"].alias("y0"), w["y1"].alias("y1"),
        ))
    )
    return starts.select(*keys, "strip", "band", by_x.alias("words"), *more)


def _split_band(words: Column, cut: Callable[[Column, Column], Column]) -> Column:
    """Groups of a band's words (sorted by x): a new group starts where ``cut(previous, word)``."""
    heads = F.filter(
        F.transform(
            words, lambda w, i: F.when((i == 0) | cut(F.get(words, i - 1), w), i + 1)
        ),
        lambda i: i.isNotNull(),
    )
    return tx.let(
        heads,
        lambda starts: F.transform(
            starts,
            lambda s, i: F.slice(words, s, F.coalesce(F.get(starts, i + 1), F.size(words) + 1) - s),
        ),
    )


def _text(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["text"]), " ")


def _height(words: Column) -> Column:
    return F.array_max(F.transform(words, lambda w: w["y1"] - w["y0"]))


def _boxed(words: Column) -> dict[str, Column]:
    low = lambda f: F.array_min(F.transform(words, lambda w: w[f]))
    high = lambda f: F.array_max(F.transform(words, lambda w: w[f]))
    return {"x0": low("x0"), "y0": low("y0"), "x1": high("x1"), "y1": high("y1")}


def _line_cut(prev: Column, w: Column) -> Column:
    h = F.greatest(w["y1"] - w["y0"], prev["y1"] - prev["y0"])
    gap = w["x0"] - prev["x1"]
    return ~((gap >= -0.2 * h) & (gap <= 0.9 * h))


def _line(w: Column) -> list[Column]:
    return [
        _text(w).alias("text"), w[0].alias("first_word"), F.size(w).cast("bigint").alias("n_words"),
        _height(w).alias("height"), *[c.alias(n) for n, c in _boxed(w).items()],
    ]


def lines_from_words(words: DataFrame, keys: Sequence[str], packed: bool = False) -> DataFrame:
    """Text lines: words of a band while the gap stays within −0.2…0.9 of the word height.
    Columns: keys, strip, band, line, text, first_word, n_words, box, height. From packed pages they also
    come ``packed``: the keys and an array ``lines`` of the other columns."""
    keys = list(keys)
    if "words" in words.columns:
        pages = whole_pages(words, keys).select(*keys, page_lines(F.col("words")).alias("lines"))
        # an outer generator has no inferred filter that would build the lines once more
        return pages if packed else pages.select(*keys, F.inline_outer("lines")).filter("strip IS NOT NULL")
    split = bands(words, keys).select(
        *keys, "strip", "band", F.posexplode(_split_band(F.col("words"), _line_cut)).alias("line", "w")
    )
    return split.select(*keys, "strip", "band", "line", *_line(F.col("w")))


# ---------------------------------------------------------------- pages in one row


def whole_pages(pages: DataFrame, keys: Sequence[str], packed: str = "words") -> DataFrame:
    """Packed pages with one row per page: rows of one page are put together, the others stay where they
    are. Only the keys are shuffled to find such pages."""
    keys = list(keys)
    page = F.struct(*keys)
    dealt = pages.groupBy(page.alias("__page")).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__page")
    if dealt.isEmpty():
        return pages.select(*keys, packed)
    own = pages.select(page.alias("__page"), packed)
    parts = own.join(dealt, "__page", "left_semi").groupBy("__page").agg(F.flatten(F.collect_list(packed)).alias(packed))
    return own.join(dealt, "__page", "left_anti").unionByName(parts).select(*[F.col("__page")[k].alias(k) for k in keys], packed)


def _page_strips(words: Column) -> Column:
    """Strips of a page, each an array of its level words by centre; as :func:`strips` parts them."""
    level = F.filter(words, lambda w: F.abs(F.pmod(w["angle_deg"] + 45, F.lit(180.0)) - 45) < 10)
    full = F.transform(level, lambda w: F.struct(
        ((w["y0"] + w["y1"]) / 2).alias("cy"), w["word_no"].cast("bigint").alias("word_no"), (w["y1"] - w["y0"]).alias("h"),
        *[w[c].alias(c) for c in ("x0", "text", "x1", "y0", "y1")],
    ))

    def parted(ws: Column) -> Column:
        def cut(tall: Column) -> Callable[[Column, Column], Column]:
            near = lambda p, w: F.coalesce(w["cy"] - p["cy"] < 0.45 * tall, F.lit(False))
            return lambda p, w: ~(p["cy"].eqNullSafe(w["cy"]) | near(p, w))

        return tx.let(F.array_max(F.transform(ws, lambda w: w["h"])), lambda tall: _split_band(ws, cut(tall)))

    return tx.let(F.sort_array(full), parted)


def _strip_bands(w: Column) -> Column:
    """Bands of a strip, each an array of its words by x; as :func:`bands` parts them."""
    spot = lambda x: F.struct(x["cy"].alias("cy"), x["word_no"].alias("word_no"))

    def parted(starts: Column) -> Column:
        def band(first: Column, i: Column) -> Column:
            after = F.get(starts, i + 1)
            mine = F.filter(w, lambda x: (spot(x) >= first) & (after.isNull() | (spot(x) < after)))
            mine = F.when(F.size(starts) == 1, w).otherwise(mine)
            return F.sort_array(F.transform(mine, lambda x: F.struct(*[x[c].alias(c) for c in ("x0", "word_no", "text", "x1", "y0", "y1")])))

        return F.transform(starts, band)

    return tx.let(_band_starts(w), parted)


def page_bands(words: Column) -> Column:
    """array<struct<strip,band,words>> of a packed page, down the page."""
    def placed(w: Column, k: Column) -> Column:
        return F.transform(_strip_bands(w), lambda b, j: F.struct((k + 1).cast("bigint").alias("strip"), j.alias("band"), b.alias("words")))

    return F.flatten(F.transform(_page_strips(words), placed))


def page_lines(words: Column) -> Column:
    """array<struct<strip,band,line,…>> of a packed page; the columns of :func:`lines_from_words`."""
    def split(b: Column) -> Column:
        return F.transform(_split_band(b["words"], _line_cut), lambda w, j: F.struct(b["strip"].alias("strip"), b["band"].alias("band"), j.alias("line"), *_line(w)))

    return F.flatten(F.transform(page_bands(words), split))


# ---------------------------------------------------------------- label → value


def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(F.floor(lo / size).cast("bigint"), F.floor(hi / size).cast("bigint"))


def label_values(
    lines: DataFrame,
    keys: Sequence[str],
    labels: dict[str, list[str]] | None = None,
    page_size: tuple[str, str] | None = None,
    cell: float = 64.0,
) -> DataFrame:
    """Fields of each page's title block: (keys…, fields map, bbox, scale).

    Labels are lines (or first words of lines) found in the dictionary; the value of a label is the
    closest other line below it or to its right. Label and value meet through the grid cells of the
    area a value may start in, so no two far lines of a page are ever paired. ``page_size`` names
    the width and height columns of ``lines`` for the preference of bottom-right labels.

    Lines may come packed, as an array ``lines`` per page; then they meet inside the page's row, through
    the same cells, and nothing is shuffled or written.
    """
    keys = list(keys)
    names = dictionary(labels or TITLE_LABELS)
    if "lines" in lines.columns:
        known = lines.dropna(subset=keys)  # as labels and values of a page without a key do not meet
        found = known.select(*keys, F.inline_outer(F.array(_page_fields(F.col("lines"), names, page_size, cell))))
        return _fields_out(found)
    order = F.struct("strip", "band", "line")
    lns = lines.withColumns({"__id": order, "__whole": names[tx.fold(F.col("text"))]})
    head = names[tx.fold(F.col("first_word.text"))]
    lns = lns.withColumn("__head", F.when(F.col("__whole").isNull() & (F.col("n_words") > 1), head))
    lns = cut_lineage(lns)  # read by labels and by both kinds of values
    lab = lns.filter(F.coalesce("__whole", "__head").isNotNull())
    by_head = F.col("__head").isNotNull()
    box = {
        "lx0": "x0", "ly0": "y0", "lx1": "x1", "ly1": "y1",
    }
    corner = F.lit(False)
    if page_size is not None:
        corner = (F.col("x0") > 0.45 * F.col(page_size[0])) & (F.col("y0") > 0.55 * F.col(page_size[1]))
    lab = lab.select(
        *keys,
        F.col("__id").alias("label_id"),
        F.coalesce("__whole", "__head").alias("field"),
        *[
            F.when(by_head, F.col(f"first_word.{c}")).otherwise(F.col(c)).alias(a)
            for a, c in box.items()
        ],
        F.when(by_head, F.col("first_word.y1") - F.col("first_word.y0")).otherwise(F.col("height")).alias("lh"),
        corner.alias("corner"),
    )
    seen = lab.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.count_if("corner").alias("__corner")
    )
    lab = attach(lab, seen, keys).filter((F.col("__n") >= 2) & ((F.col("__corner") < 2) | F.col("corner")))

    # a line that is a label as a whole is no value; one that only starts with a label still is
    vals = lns.filter(F.col("__whole").isNull()).select(
        *keys, F.col("__id").alias("value_id"), F.col("text").alias("value"), "x0", "y0", "x1", "y1"
    )
    vcy = (F.col("y0") + F.col("y1")) / 2
    lcy = (F.col("ly0") + F.col("ly1")) / 2
    reach = {
        "below": (F.col("y0"), F.col("lx0") - 4 * F.col("lh"), F.col("lx0") + 4 * F.col("lh"),
                  F.col("ly1") - 0.2 * F.col("lh"), F.col("ly1") + 3 * F.col("lh")),
        "right": (vcy, F.col("lx1"), F.col("lx1") + 12 * F.col("lh"),
                  lcy - 0.6 * F.col("lh"), lcy + 0.6 * F.col("lh")),
    }
    pairs = None
    for rule, (vy, xa, xb, ya, yb) in reach.items():
        left = lab.select(
            *lab.columns, F.explode(_cells(xa, xb, cell)).alias("gx"), F.lit(rule).alias("rule")
        ).withColumn("gy", F.explode(_cells(ya, yb, cell)))
        right = vals.withColumns(
            {"gx": F.floor(F.col("x0") / cell).cast("bigint"), "gy": F.floor(vy / cell).cast("bigint")}
        )
        met = left.join(right, [*keys, "gx", "gy"])
        pairs = met if pairs is None else pairs.unionByName(met)
    dy, side, dx = F.col("y0") - F.col("ly1"), F.abs(F.col("x0") - F.col("lx0")), F.col("x0") - F.col("lx1")
    below = (F.col("rule") == "below") & (dy >= -0.2 * F.col("lh")) & (dy <= 3 * F.col("lh")) & (side < 4 * F.col("lh"))
    right_of = (
        (F.col("rule") == "right") & (F.abs(vcy - lcy) < 0.6 * F.col("lh")) & (dx >= 0) & (dx <= 12 * F.col("lh"))
    )
    score = F.when(below, dy + side * 0.2).when(right_of, dx * 0.5)
    scored = pairs.withColumn("score", score).filter(
        F.col("score").isNotNull() & (F.col("value_id") != F.col("label_id"))
    )
    pick = F.struct("value", "x0", "y0", "x1", "y1", "lx0", "ly0", "lx1", "ly1")
    best = scored.groupBy(*keys, "field", "label_id").agg(
        F.min_by(pick, F.struct("score", "value_id")).alias("v")
    )
    fields = best.groupBy(*keys, "field").agg(F.min_by("v", "label_id").alias("v"))
    out = fields.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "v.value")))).alias("fields"),
        F.array(
            F.min(F.least("v.x0", "v.lx0")), F.min(F.least("v.y0", "v.ly0")),
            F.max(F.greatest("v.x1", "v.lx1")), F.max(F.greatest("v.y1", "v.ly1")),
        ).alias("bbox"),
    )
    return _fields_out(out)


def _fields_out(found: DataFrame) -> DataFrame:
    return found.filter(F.size("fields") >= 2).withColumn("scale", tx.parse_scale(F.col("fields")["scale"]))


def _page_fields(lines: Column, names: Column, page_size: tuple[str, str] | None, cell: float) -> Column:
    """struct<fields,bbox> of a page's lines: the rules of :func:`label_values` inside a row."""
    def named(l: Column) -> Column:
        return tx.let(names[tx.fold(l["text"])], lambda whole: F.struct(
            F.struct(l["strip"].alias("strip"), l["band"].alias("band"), l["line"].alias("line")).alias("id"), whole.alias("whole"),
            F.when(whole.isNull() & (l["n_words"] > 1), names[tx.fold(l["first_word"]["text"])]).alias("head"),
            *[l[c].alias(c) for c in ("text", "first_word", "height", "x0", "y0", "x1", "y1")],
        ))

    def label(l: Column) -> Column:
        by_head = l["head"].isNotNull()
        corner = F.lit(False)
        if page_size is not None:
            corner = (l["x0"] > 0.45 * F.col(page_size[0])) & (l["y0"] > 0.55 * F.col(page_size[1]))
        pick = lambda c: F.when(by_head, l["first_word"][c]).otherwise(l[c])
        lh = F.when(by_head, l["first_word"]["y1"] - l["first_word"]["y0"]).otherwise(l["height"])
        return F.struct(
            l["id"].alias("id"), F.coalesce(l["whole"], l["head"]).alias("field"), *[pick(c).alias(f"l{c}") for c in ("x0", "y0", "x1", "y1")],
            lh.alias("lh"), corner.alias("corner"),
        )

    def chosen(labs: Column) -> Column:
        """Labels that count: of two at least, and those in the corner where two are there."""
        corners = F.size(F.filter(labs, lambda l: l["corner"]))
        return tx.let(corners, lambda n: F.when(F.size(labs) >= 2, F.filter(labs, lambda l: (n < 2) | l["corner"])))

    def in_cells(vals: Column) -> Column:
        """Values in the cells of their upper edge and of their centre: array<struct<rule,gy,gx,all>>."""
        vy = {"below": lambda v: v["y0"], "right": lambda v: (v["y0"] + v["y1"]) / 2}
        spots = F.flatten(F.transform(vals, lambda v: F.array(*[
            F.struct(F.lit(rule).alias("rule"), F.floor(y(v) / cell).cast("bigint").alias("gy"), F.floor(v["x0"] / cell).cast("bigint").alias("gx"), v.alias("v"))
            for rule, y in vy.items()
        ])))
        at = lambda p: F.struct(*[p[k].alias(k) for k in ("rule", "gy", "gx")])
        parted = tx.let(F.sort_array(spots), lambda ps: _split_band(ps, lambda p, q: at(p) != at(q)))
        return F.map_from_entries(F.transform(parted, lambda g: F.struct(at(g[0]).alias("key"), F.transform(g, lambda p: p["v"]).alias("value"))))

    def met(l: Column, cells: Column) -> Column:
        """The best value of a label, or null."""
        lh, lcy = l["lh"], (l["ly0"] + l["ly1"]) / 2
        reach = {
            "below": (l["lx0"] - 4 * lh, l["lx0"] + 4 * lh, l["ly1"] - 0.2 * lh, l["ly1"] + 3 * lh),
            "right": (l["lx1"], l["lx1"] + 12 * lh, lcy - 0.6 * lh, lcy + 0.6 * lh),
        }

        def scored(rule: str, v: Column) -> Column:
            dy, side, dx = v["y0"] - l["ly1"], F.abs(v["x0"] - l["lx0"]), v["x0"] - l["lx1"]
            if rule == "below":
                fits, score = (dy >= -0.2 * lh) & (dy <= 3 * lh) & (side < 4 * lh), dy + side * 0.2
            else:
                fits, score = (F.abs((v["y0"] + v["y1"]) / 2 - lcy) < 0.6 * lh) & (dx >= 0) & (dx <= 12 * lh), dx * 0.5
            return F.when(fits & score.isNotNull() & (v["id"] != l["id"]), F.struct(score.alias("score"), v["id"].alias("id"), v.alias("v")))

        def around(rule: str) -> Column:
            xa, xb, ya, yb = reach[rule]
            here = F.flatten(F.transform(_cells(ya, yb, cell), lambda gy: F.flatten(F.transform(
                _cells(xa, xb, cell),
                lambda gx: F.coalesce(cells[F.struct(F.lit(rule).alias("rule"), gy.alias("gy"), gx.alias("gx"))], F.array().cast(VALUES)),
            ))))
            return F.array_compact(F.transform(here, lambda v: scored(rule, v)))

        return F.array_min(F.concat(around("below"), around("right")))["v"]

    def best(labs: Column, cells: Column) -> Column:
        """Per field the value of its first label that has one."""
        rows = F.transform(labs, lambda l: F.struct(l["field"].alias("field"), l["id"].alias("id"), l.alias("l"), met(l, cells).alias("v")))
        ordered = F.sort_array(F.filter(rows, lambda r: r["v"].isNotNull()))
        return tx.let(ordered, lambda rs: F.filter(rs, lambda r, i: (i == 0) | (F.get(rs, i - 1)["field"] != r["field"])))

    def out(rows: Column) -> Column:
        low = lambda c: F.array_min(F.transform(rows, lambda r: F.least(r["v"][c], r["l"][f"l{c}"])))
        high = lambda c: F.array_max(F.transform(rows, lambda r: F.greatest(r["v"][c], r["l"][f"l{c}"])))
        fields = F.map_from_entries(F.transform(rows, lambda r: F.struct(r["field"].alias("field"), r["v"]["value"].alias("value"))))
        return F.struct(fields.alias("fields"), F.array(low("x0"), low("y0"), high("x1"), high("y1")).alias("bbox"))

    def matched(ls: Column) -> Column:
        labs = F.transform(F.filter(ls, lambda l: F.coalesce(l["whole"], l["head"]).isNotNull()), label)
        vals = F.transform(F.filter(ls, lambda l: l["whole"].isNull()), lambda l: F.struct(
            l["id"].alias("id"), l["text"].alias("value"), *[l[c].alias(c) for c in ("x0", "y0", "x1", "y1")]))
        return tx.let(chosen(labs), lambda c: F.when(c.isNotNull(), tx.let(in_cells(vals), lambda m: tx.let(best(c, m), out))))

    return tx.let(F.transform(lines, named), matched)


# ---------------------------------------------------------------- tables


def table_from_words(
    words: DataFrame, keys: Sequence[str], headers: dict[str, list[str]] | None = None
) -> DataFrame:
    """Cells (keys…, row_index, col_index, value) of the table on each page.

    The header is the first band with two known headers; a later word belongs to the right-most
    header at or left of it (an as-of lookup in the page's header positions, at most one text line
    wide); the table ends at a vertical gap of more than four header heights.
    """
    keys = list(keys)
    names = dictionary(headers or SCHEDULE_HEADERS)

    def cut(prev: Column, w: Column) -> Column:
        return w["x0"] - prev["x1"] > 1.5 * (prev["y1"] - prev["y0"])

    if "words" in words.columns:
        return _cells_of_rows(_page_rows(words, keys, names, cut), keys, cut)
    # the first pass keeps place and box of each band and the header of those that may be one
    spots = strips(words, keys)
    split, box, spot = _split_band(F.col("words"), cut), _boxed(F.col("words")), F.struct("strip", "band")
    known = F.size(F.filter("cells", lambda c: header_name(_text(c), names).isNotNull()))
    head = F.struct(
        F.transform("cells", lambda c: c[0]["x0"]).alias("xs"), _height(F.col("words")).alias("h"), spot.alias("spot")
    )
    slim = cut_lineage(bands(words, keys, spots).withColumn("cells", split).select(
        *keys, "strip", "band", box["y0"].alias("y0"), box["y1"].alias("y1"), F.when(known >= 2, head).alias("head")
    ))
    first = slim.filter("head IS NOT NULL").groupBy(*keys).agg(F.min_by("head", spot).alias("hdr"))
    ends = first.select(*keys, F.col("hdr.h").alias("h"), F.col("hdr.spot").alias("spot"))
    under = attach(slim.drop("head"), ends, keys).filter(spot >= F.col("spot")).drop("spot")
    # the table ends at the first large gap below the header
    rows = gap_islands(
        under, keys, ["strip", "band"], F.floor(F.col("strip") / 1024), F.col("y1"),
        lambda end: F.col("y0") - end <= 4 * F.col("h"), name="__part", rank="__rank",
    ).filter("__part = 1")
    # the second pass meets the words of the strips that hold rows of a table
    rows = rows.groupBy(*keys, "strip").agg(F.collect_list(F.struct("band", (F.col("__rank") - 1).alias("row_index"))).alias("rows"))
    used = cut_lineage(attach(attach(spots, rows, [*keys, "strip"]), first, keys))
    row = F.get(F.filter("rows", lambda r: r["band"] == F.col("band")), F.lit(0))["row_index"]
    inside = bands(words, keys, used).withColumn("row_index", row)
    return _cells_of_rows(inside.filter("row_index IS NOT NULL"), keys, cut)


def _page_rows(pages: DataFrame, keys: Sequence[str], names: Column, cut: Callable[[Column, Column], Column]) -> DataFrame:
    """Rows (keys…, hdr, row_index, words) of the table of each packed page, found inside the page's row."""
    known = lambda b: F.size(F.filter(_split_band(b["words"], cut), lambda c: header_name(_text(c), names).isNotNull())) >= 2
    edge = lambda b, agg, k: agg(F.transform(b["words"], lambda w: w[k]))

    def table(all_bands: Column) -> Column:
        # bands after the header are not read for known names
        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"))
        seek = lambda s, b: F.struct((s["i"] + 1).alias("i"), F.when(s["at"] > 0, s["at"]).when(known(b), s["i"] + 1).otherwise(0).alias("at"))
        first = F.aggregate(all_bands, start, seek, lambda s: s["at"])
        return tx.let(first, lambda f: F.when(f > 0, tx.let(F.slice(all_bands, f, F.size(all_bands)), under)))

    def under(rest: Column) -> Column:
        top = F.get(rest, F.lit(0))["words"]
        hdr = F.struct(F.transform(_split_band(top, cut), lambda c: c[0]["x0"]).alias("xs"), _height(top).alias("h"))

        def ended(h: Column) -> Column:
            gap = lambda b, i: edge(b, F.array_min, "y0") - edge(F.get(rest, i - 1), F.array_max, "y1")
            far = F.transform(rest, lambda b, i: (i > 0) & ~F.coalesce(gap(b, i) <= 4 * h["h"], F.lit(False)))
            return tx.let(F.array_position(far, True).cast("int"), lambda end: F.struct(
                h.alias("hdr"), F.transform(F.when(end > 0, F.slice(rest, F.lit(1), end - 1)).otherwise(rest), lambda b: b["words"]).alias("rows")
            ))

        return tx.let(hdr, ended)

    found = whole_pages(pages, keys).select(*keys, tx.let(page_bands(F.col("words")), table).alias("t"))
    rows = found.select(*keys, F.col("t.hdr").alias("hdr"), F.posexplode_outer("t.rows").alias("row_index", "words"))
    return rows.filter("row_index IS NOT NULL").withColumn("row_index", F.col("row_index").cast("bigint"))


def _cells_of_rows(inside: DataFrame, keys: Sequence[str], cut: Callable[[Column, Column], Column]) -> DataFrame:
    """Cells of the rows (keys…, hdr, row_index, words) of tables."""
    inside = inside.withColumn("cells", _split_band(F.col("words"), cut))
    # as-of by one merge of header and word positions: the columns after the first begin at their header
    marks = F.transform(F.slice("hdr.xs", F.lit(2), F.size("hdr.xs")), lambda x, i: F.struct(
        (x - 0.5 * F.col("hdr.h")).alias("x"), (i + 1).alias("col"), F.lit(-1).cast("bigint").alias("no"), F.lit("").alias("text")))
    placed = F.transform("words", lambda w: F.struct(
        w["x0"].alias("x"), F.lit(2**30).alias("col"), w["word_no"].alias("no"), w["text"].alias("text")))
    parts = tx.let(F.sort_array(F.concat(marks, placed)), lambda spots: _split_band(spots, lambda prev, w: w["no"] < 0))
    filled = F.filter("parts", lambda g: F.element_at(g, -1)["no"] >= 0)
    per_col = F.transform(filled, lambda g: F.struct(
        F.when(g[0]["no"] < 0, g[0]["col"]).otherwise(0).cast("bigint").alias("col_index"), _text(F.filter(g, lambda w: w["no"] >= 0)).alias("value"),
    ))
    header = F.transform("cells", lambda c, i: F.struct(i.cast("bigint").alias("col_index"), _text(c).alias("value")))
    return (
        inside.withColumn("parts", parts)
        .select(*keys, "row_index", F.inline_outer(F.when(F.col("row_index") == 0, header).otherwise(per_col)))
        .filter("col_index IS NOT NULL")
    )


def header_name(text: Column, names: Column | None = None) -> Column:
    """Canonical column of a header cell; a unit in brackets is ignored."""
    names = dictionary(SCHEDULE_HEADERS) if names is None else names
    return names[tx.fold(F.regexp_replace(text, r"[\(\[].*?[\)\]]", " "))]


def header_unit(text: Column) -> Column:
    unit = F.regexp_extract(F.lower(text), r"[\(\[](mm|cm|m)[\)\]]", 1)
    return F.when(unit != "", unit)


def normalise_schedules(
    cells: DataFrame, keys: Sequence[str], row: str = "row_index", col: str = "col_index", value: str = "value"
) -> tuple[DataFrame, DataFrame]:
    """(schedules, rows) from cell tables; rows carry the ``kind`` of their schedule.

    The header is the first of the first 30 rows with two known columns. Lengths become metres (unit
    of the header, otherwise cm above 10 and m below), quantities become numbers; what is no number
    stays text. The tag is the tag column or the room number.

    The columns of a header are one array per table, met on the keys alone, and the rows are gathered
    under the same keys, so that the cells are shuffled once. Cells may come packed, an array ``cells`` of
    (col, value) per row of a table; then a row meets its header as it is, and its cells are read in it.
    """
    keys = list(keys)
    packed = "cells" in cells.columns
    top = cells.filter(F.col(row) < HEADER_ROWS)
    top = top.select(*keys, row, F.inline("cells")) if packed else top
    top = top.select(*keys, row, F.col(col), F.col(value).alias("title"))
    # titles recur from table to table: each text is read once, and only known ones meet the cells
    titles = top.select("title").distinct().select("title", header_name(F.col("title")).alias("key"), header_unit(F.col("title")).alias("unit"))
    known = top.join(titles.filter(F.col("key").isNotNull()), "title")
    header = (
        known.groupBy(*keys, row)
        .agg(F.collect_list(F.struct(F.col(col), "key", "title", "unit")).alias("columns"))
        .filter(F.size("columns") >= 2)
        .groupBy(*keys)
        .agg(F.min(row).alias("__hdr"), F.array_sort(F.min_by("columns", row)).alias("columns"))
        .withColumn("recognised", F.array_distinct(F.transform("columns", lambda c: c["key"])))
    )
    any_of = lambda names: F.arrays_overlap("recognised", F.array(*[F.lit(n) for n in names]))
    headed = header.withColumn(
        "kind",
        F.when(any_of(["width", "height"]), "door_window")
        .when(any_of(["floor", "walls", "ceiling"]), "finish")
        .otherwise("unknown"),
    )
    schedules = headed.select(*keys, "recognised", "columns", "kind")
    sheet = F.struct(*[F.col(k) for k in keys])  # compares null with null, one column to shuffle by
    right = headed.select(sheet.alias("__right"), "__hdr", "columns", "kind")
    met = (F.col("__sheet") == F.col("__right")) & (F.col(row) > F.col("__hdr"))
    if packed:
        whole = whole_pages(cells, [*keys, row], "cells")
        return schedules, _packed_rows(whole.withColumn("__sheet", sheet).join(right, met), keys, row, col, value)
    below = cells.withColumn("__sheet", sheet).join(right, met)
    own = F.filter("columns", lambda c: c[col].eqNullSafe(F.col(col)))
    body = below.select(
        "__sheet", row, F.col(col), "kind", F.trim(F.coalesce(F.col(value), F.lit(""))).alias("__v"),
        F.explode_outer(F.transform(own, lambda c: F.struct(c["key"].alias("key"), c["unit"].alias("unit")))).alias("__own"),
    ).select("__sheet", row, col, "kind", "__v", "__own.*")
    v, num = F.col("__v"), F.col("__num")
    is_length, is_qty = F.col("key").isin(LENGTH_COLUMNS), F.col("key") == "qty"
    # a column of its own, so that a number is parsed once and not in each place that uses it
    body = body.withColumn("__num", F.when(is_length | is_qty, tx.parse_number(v)))
    unit = F.coalesce(F.col("unit"), F.when(num > 10, "cm").otherwise("m"))
    factor = F.when(unit == "mm", 0.001).when(unit == "cm", 0.01).otherwise(1.0)
    number = F.when(is_length, num * factor).when(is_qty, num)
    text = F.when((is_length | is_qty) & (num.isNotNull() | v.isin("", "-")), None).when(v != "", v)
    cell = F.struct("key", F.col(col).alias("col"), text.alias("text"), number.alias("number"))
    gathered = body.groupBy("__sheet", row).agg(
        F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), cell))).alias("__cells"),
        F.max(v != "").alias("__filled"), F.first("kind").alias("kind"),
    ).filter("__filled")
    # a column name that occurs twice keeps its right-most cell
    last = lambda c, i: F.coalesce(F.get("__cells", i + 1)["key"] != c["key"], F.lit(True))
    kept = gathered.withColumn("__kept", F.filter("__cells", last))
    pick = lambda part: F.map_from_entries(F.transform(
        F.filter("__kept", lambda c: c[part].isNotNull()), lambda c: F.struct(c["key"].alias("key"), c[part].alias("v"))
    ))
    rows = kept.select(
        *[F.col("__sheet")[k].alias(k) for k in keys], row, "kind", pick("text").alias("fields"), pick("number").alias("numeric")
    )
    return schedules, _tagged(rows)


def _tagged(rows: DataFrame) -> DataFrame:
    source = F.coalesce(F.col("fields")["tag"], F.col("fields")["room_no"])
    return rows.withColumn("tag", F.coalesce(tx.normalise_tag(source), source))


def _packed_rows(below: DataFrame, keys: Sequence[str], row: str, col: str, value: str) -> DataFrame:
    """Rows of schedules from packed rows that carry the columns of their header.

    Each name of a header is one column here. Where it stands once in the header, and no place of the row
    is taken twice, its cell is read by its place, without lambdas; else all cells are gathered by name."""
    numbers, names = [*LENGTH_COLUMNS, "qty"], sorted(SCHEDULE_HEADERS)

    def own(x: Column) -> Column:
        mine = F.filter("columns", lambda c: c[col].eqNullSafe(x[col]))
        v = F.trim(F.coalesce(x[value], F.lit("")))
        return F.transform(mine, lambda c: F.struct(c["key"].alias("key"), x[col].alias("col"), v.alias("v"), c["unit"].alias("unit")))

    # a column name that occurs twice keeps its right-most cell
    def right_most(all_cells: Column) -> Column:
        return F.filter(all_cells, lambda c, i: F.coalesce(F.get(all_cells, i + 1)["key"] != c["key"], F.lit(True)))

    out = below.withColumns({"__at": F.col("cells")[col], "__v": F.col("cells")[value], "__name": F.col("columns")["key"], "__to": F.col("columns")[col]})
    alone = lambda c: F.size(F.array_distinct(c)) == F.size(c)
    clear = alone("__name") & alone("__at") & (F.size(F.array_compact("__to")) == F.size("__to")) & ~F.exists("cells", lambda x: x.isNull())
    out = out.filter(F.exists("__v", lambda v: F.coalesce(F.trim(v) != "", F.lit(False)))).withColumn("__clear", clear)
    kept = tx.let(F.sort_array(F.flatten(F.transform("cells", own))), right_most)
    out = out.withColumn("__kept", F.when(~F.col("__clear"), kept))
    place = lambda c, x: F.array_position(c, x).cast("int") - 1  # noqa: E731  -1 where there is none
    out = out.withColumns({f"__i_{n}": place("__name", F.lit(n)) for n in names})
    out = out.withColumns({f"__j_{n}": place("__at", F.get("__to", F.col(f"__i_{n}"))) for n in names})

    def cell(n: str) -> Column:
        found = F.get(F.filter("__kept", lambda c: c["key"] == n), F.lit(0))
        read = F.when(F.col(f"__j_{n}") >= 0, F.trim(F.coalesce(F.get("__v", F.col(f"__j_{n}")), F.lit(""))))
        return F.when(F.col("__clear"), read).otherwise(found["v"])

    def unit_of(n: str) -> Column:
        found = F.get(F.filter("__kept", lambda c: c["key"] == n), F.lit(0))
        return F.when(F.col("__clear"), F.get(F.col("columns")["unit"], F.col(f"__i_{n}"))).otherwise(found["unit"])

    out = out.select(*keys, row, "kind", *[cell(n).alias(f"__c_{n}") for n in names], *[unit_of(n).alias(f"__u_{n}") for n in LENGTH_COLUMNS])
    # a number is parsed once, in generated code
    out = out.withColumns({f"__n_{n}": tx.parse_number(F.col(f"__c_{n}")) for n in numbers})

    def number(n: str) -> Column:
        num = F.col(f"__n_{n}")
        if n == "qty":
            return num
        unit = F.coalesce(F.col(f"__u_{n}"), F.when(num > 10, "cm").otherwise("m"))
        return num * F.when(unit == "mm", 0.001).when(unit == "cm", 0.01).otherwise(1.0)

    def text(n: str) -> Column:
        v = F.col(f"__c_{n}")
        return F.when((F.col(f"__n_{n}").isNull() & ~v.isin("", "-")) if n in numbers else v != "", v)

    known = lambda pairs: F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))
    fields = known(F.array(*[F.struct(F.lit(n).alias("key"), text(n).alias("v")) for n in names]))
    numeric = known(F.array(*[F.struct(F.lit(n).alias("key"), number(n).alias("v")) for n in sorted(numbers)]))
    return _tagged(out.select(*keys, row, "kind", fields.alias("fields"), numeric.alias("numeric")))
