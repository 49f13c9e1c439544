"""Text mining: windows, matching keys, measurements, scales, tags, features, rule classes, storeys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.functions import text as tx
from draftlake.functions.ordered import attach, scan

# Page classes and the folded keywords that point to them.
PAGE_CLASSES = [
    "floor_plan", "ceiling_plan", "section", "elevation", "detail", "site_plan", "schedule",
    "text_document", "photo", "moodboard", "other",
]
KEYWORDS = {
    "floor_plan": ["kat plani", "zemin kat", "floor plan", "salon", "mutfak", "yatak", "banyo",
                   "antre", "living", "kitchen", "bedroom", "bathroom", "plan"],
    "ceiling_plan": ["tavan", "ceiling", "reflected", "armatur", "spot", "asma tavan"],
    "section": ["kesit", "kesiti", "section"],
    "elevation": ["gorunus", "gorunusu", "elevation", "cephe", "facade"],
    "detail": ["detay", "detail", "yalitim", "insulation", "siva", "plaster", "tugla", "betonarme"],
    "site_plan": ["vaziyet", "site plan", "ada", "parsel", "sokak", "cadde", "street", "avenue", "lot"],
    "schedule": ["listesi", "schedule", "poz", "adet", "qty", "mahal", "genislik", "width", "yukseklik"],
    "text_document": ["ozeti", "brief", "sartname", "specification", "notlari", "notes", "sayfa", "page"],
    "moodboard": ["konsept", "mood", "palet", "palette", "ral", "ncs", "board"],
    "other": ["pafta listesi", "drawing list", "uygulama projesi", "construction documents", "kapak", "cover"],
    "photo": [],
}
# Storey vocabulary (folded), roof rank and storey height.
ORDINAL_WORDS = {
    "birinci": 1, "first": 1, "ikinci": 2, "second": 2, "ucuncu": 3, "third": 3, "dorduncu": 4,
    "fourth": 4, "besinci": 5, "fifth": 5, "altinci": 6, "sixth": 6,
}
BASEMENT_WORDS = ["bodrum", "basement", "sub"]
MEZZANINE_WORDS = ["asma", "mezzanine"]
ROOF_WORDS = ["cati", "roof", "teras"]
GROUND_WORDS = ["zemin", "ground", "giris"]
STOREY_WORDS = ["kat", "kati", "floor", "level", "storey", "story"]
ROOF_RANK = 1000.0
STOREY_HEIGHT_M = 3.0

# A number with its unit as it stands in running text, or a feet-inches length.
MEASURE_PATTERN = (
    r"\d+\s*(?:'|′)\s*-?\s*\d*(?:\s+\d+/\d+)?\s*(?:\"|″)?"
    r"|\d+(?:[.,]\d+)*(?:\s?(?:mm|cm|m)\b)?"
)


def window_starts(n: Column, size: int, overlap: float) -> Column:
    """Starts of overlapping windows; the last one is flush with the end."""
    stride = max(1, int(size * (1.0 - overlap)))
    n = n.cast("bigint")
    many = F.concat(F.sequence(F.lit(0).cast("bigint"), n - size - 1, F.lit(stride).cast("bigint")), F.array(n - size))
    return F.when(n <= size, F.array(F.lit(0).cast("bigint"))).otherwise(many)


def overlap_chunks(
    df: DataFrame, text: str = "text", size: int = 1536, overlap: float = 0.2
) -> DataFrame:
    """One row per character window of each text; narrow, no shuffle."""
    starts = window_starts(F.length(text), size, overlap)
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, text, F.posexplode(starts).alias("window", "start")).select(
        *rest, "window", "start",
        F.substr(F.col(text), F.col("start").cast("int") + 1, F.lit(size)).alias("chunk"),
    )


def raster_tiles(df: DataFrame, width: str, height: str, tile: int = 1536, overlap: float = 0.2) -> DataFrame:
    """2-D form: tiles (x, y, w, h) covering a raster, rows first."""
    rows = df.withColumn("y", F.explode(window_starts(F.col(height), tile, overlap)))
    return rows.withColumn("x", F.explode(window_starts(F.col(width), tile, overlap))).withColumns(
        {"w": F.least(F.lit(tile), F.col(width)), "h": F.least(F.lit(tile), F.col(height))}
    )


def explode_words(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys…, pos, word) over the whole text, split at white space."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return df.select(*keys, F.posexplode(words).alias("pos", "word"))


def group_by_fold(df: DataFrame, col: str) -> DataFrame:
    """Spelling variants per matching key. Occurrences are counted first, so each distinct spelling
    is folded once; both steps combine map-side."""
    variants = df.groupBy(col).agg(F.count(F.lit(1)).alias("__n"))
    return (
        variants.withColumn("key", tx.fold(F.col(col)))
        .filter("key <> ''")
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("variants"), F.sum("__n").alias("occurrences"))
    )


def mine_measurements(
    docs: DataFrame, keys: Sequence[str], text: str = "text", unit_hint: str | None = None
) -> DataFrame:
    """(keys…, raw, metres, unit): every measurement reading in a text."""
    raw = F.explode(F.regexp_extract_all(text, F.lit(MEASURE_PATTERN), F.lit(0)))
    found = docs.select(*keys, raw.alias("raw"))
    return (
        found.withColumn("__d", tx.parse_dimension(F.col("raw"), unit_hint))
        .filter(F.col("__d").isNotNull())
        .select(*keys, "raw", "__d.metres", "__d.unit")
    )


def measurement_stats(mined: DataFrame, keys: Sequence[str] = ("unit",), times: str | None = None) -> DataFrame:
    """Count, range and readings per key. ``times`` names a column with the number of occurrences that a
    row stands for, where equal texts were counted before they were mined."""
    best, n = F.col("metres")[0], F.lit(1).cast("bigint") if times is None else F.col(times)
    return mined.groupBy(*keys).agg(
        F.sum(n).alias("n"),
        F.min(best).alias("min_m"),
        F.max(best).alias("max_m"),
        F.sum(F.size("metres") * n).alias("readings"),
    )


def mine_scales(lines: DataFrame, keys: Sequence[str], text: str = "text", line_no: str = "line_no") -> DataFrame:
    """Scale of each page: the first line that starts with a scale word and states a scale."""
    scale = tx.parse_scale(F.col(text))
    hits = lines.select(*keys, line_no, text, scale.alias("scale")).filter(
        F.col("scale").isNotNull() & tx.is_scale_label(F.col(text))
    )
    return hits.groupBy(*keys).agg(
        F.min_by("scale", line_no).alias("scale"), F.count(F.lit(1)).alias("candidates")
    )


def mine_tags(words: DataFrame, text: str = "text", door_window_only: bool = False) -> DataFrame:
    """Tag-like words with their normalised tag and kind (null kind: rooms and other codes)."""
    hits = words.withColumn("tag", tx.normalise_tag(F.col(text))).filter(F.col("tag").isNotNull())
    hits = hits.withColumn("kind", tx.tag_kind(F.col("tag")))
    return hits.filter(F.col("kind").isNotNull()) if door_window_only else hits


def repair_lookalikes(readings: DataFrame, text: str = "reading") -> DataFrame:
    return readings.withColumn("tag", tx.repair_lookalikes(F.col(text)))


# ---------------------------------------------------------------- features of one page

TEXT_FEATURES = [
    "log_words", "numeric_frac", "dimension_count", "tag_count", "avg_word_len",
    "long_line_words", "has_title_block", *[f"kw_{c}" for c in PAGE_CLASSES],
]


def word_features(
    pages: DataFrame, words: str = "words", has_title_block: Column | None = None
) -> DataFrame:
    """Text features of pages whose words are an ``array<struct<text,y0,y1>>`` column.

    Everything is computed inside the row: no explode, no shuffle, whatever the page holds.
    """
    ws = F.col(words)
    n = F.size(ws).cast("double")
    texts = F.transform(ws, lambda w: w["text"])
    share = lambda c: F.when(n > 0, c / n).otherwise(0.0)
    has_digit = lambda t: t.rlike(r"\d")
    digits = F.size(F.filter(texts, has_digit))
    dims = F.size(F.filter(texts, lambda t: has_digit(t) & tx.parse_dimension(t).isNotNull()))
    tags = F.size(
        F.filter(
            texts,
            lambda t: tx.normalise_tag(t).isNotNull()
            & F.upper(F.substring(F.trim(t), 1, 1)).isin("K", "P", "D", "W"),
        )
    )
    chars = F.aggregate(texts, F.lit(0).cast("bigint"), lambda a, t: a + F.length(t))
    row_of = lambda w: F.bround(
        (w["y0"] + w["y1"]) / 2 / F.greatest(F.lit(1.0), w["y1"] - w["y0"])
    )
    # words per row without a self-comparison: sorted row numbers, then runs of equal ones
    rows = F.array_sort(F.transform(ws, row_of))
    start = F.struct(
        F.lit(None).cast("double").alias("row"), F.lit(0).alias("run"), F.lit(0).alias("total")
    )
    closed = lambda s: s["total"] + F.when(s["run"] >= 8, s["run"]).otherwise(0)
    long_words = F.aggregate(
        rows,
        start,
        lambda s, r: F.struct(
            r.alias("row"),
            F.when(s["row"] == r, s["run"] + 1).otherwise(1).alias("run"),
            F.when(s["row"] == r, s["total"]).otherwise(closed(s)).alias("total"),
        ),
        closed,
    )
    base = pages.withColumns(
        {
            "log_words": F.log1p(n),
            "numeric_frac": share(digits),
            "dimension_count": F.log1p(dims.cast("double")),
            "tag_count": F.log1p(tags.cast("double")),
            "avg_word_len": share(chars) / 10.0,
            "long_line_words": share(long_words),
            "has_title_block": (has_title_block if has_title_block is not None else F.lit(False)).cast("double"),
            "__folded": F.transform(texts, tx.fold),
        }
    )
    joined = F.concat(F.lit(" "), F.array_join("__folded", " "), F.lit(" "))

    def starting(k: str) -> Column:
        return F.size(F.filter("__folded", lambda t: t.startswith(k)))

    kw = {}
    for c in PAGE_CLASSES:
        hits = F.lit(0)
        for k in KEYWORDS[c]:
            if " " in k:
                padded = F.length(joined) - F.length(F.replace(joined, F.lit(f" {k} "), F.lit("")))
                hits = hits + (padded / (len(k) + 2)).cast("int")
            else:
                hits = hits + starting(k)
        kw[f"kw_{c}"] = F.log1p(hits.cast("double"))
    return base.withColumns(kw).drop("__folded")


def nest_words(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Word table → one row per page, words in reading order (a page is a bounded unit)."""
    entry = F.struct("word_no", "text", "x0", "y0", "x1", "y1")
    return words.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("words"))


def meta_features(pages: DataFrame) -> DataFrame:
    """Camera, vector and image-area features from page metadata columns."""
    vector = F.col("path_objects").isNotNull()
    exif = F.coalesce(F.col("exif_make"), F.col("exif_model"), F.lit("")) != ""
    return pages.withColumns(
        {
            "exif_camera": exif.cast("double"),
            "is_vector": (F.coalesce("path_objects", F.lit(0)) > 0).cast("double"),
            "log_paths": F.when(vector, F.log1p(F.col("path_objects").cast("double"))).otherwise(0.0),
            "image_area_frac": F.when(vector, F.coalesce("image_area_fraction", F.lit(0.0))).otherwise(
                F.when(F.coalesce("has_exif", F.lit(False)), 0.0).otherwise(1.0)
            ),
        }
    )


def feature_vector(df: DataFrame, names: Sequence[str], out: str = "features") -> DataFrame:
    """Named feature columns as one ordered ``array<double>``; absent ones are 0."""
    cols = [
        F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in df.columns else F.lit(0.0) for n in names
    ]
    return df.withColumn(out, F.array(*cols))


# ---------------------------------------------------------------- rules


def classify_by_rule(pages: DataFrame) -> DataFrame:
    """Adds ``rule`` = struct(label, confidence, reason) for pages without a raster, else null.
    Needs kind, has_schedule_header, pictures."""

    def verdict(label: str, confidence: float, reason: Column) -> Column:
        return F.struct(
            F.lit(label).alias("label"), F.lit(confidence).alias("confidence"), reason.alias("reason")
        )

    kind = F.col("kind")
    rule = (
        F.when(kind.isin("docx", "text"), verdict("text_document", 1.0, F.concat(kind, F.lit(" page"))))
        .when(
            (kind == "sheet") & F.coalesce("has_schedule_header", F.lit(False)),
            verdict("schedule", 1.0, F.lit("worksheet with a schedule header")),
        )
        .when(kind == "sheet", verdict("other", 1.0, F.lit("worksheet")))
        .when(
            (kind == "slide") & (F.coalesce("pictures", F.lit(0)) > 0),
            verdict("moodboard", 0.85, F.lit("slide with pictures")),
        )
        .when(kind == "slide", verdict("text_document", 0.85, F.lit("slide with text")))
        .when(
            kind.isin("ifc", "model_3dm", "svg"),
            verdict("other", 1.0, F.concat(kind, F.lit(": model or vector file"))),
        )
    )
    return pages.withColumn("rule", rule)


def source_kind(kind: Column, paths: Column, image_fraction: Column, has_vectors: Column, has_raster: Column) -> Column:
    """Plan source of a page: ifc, dxf, pdf_vector, raster or null."""
    vector = has_vectors & (F.coalesce(paths, F.lit(0)) >= 30) & (F.coalesce(image_fraction, F.lit(0.0)) < 0.5)
    return (
        F.when(kind.isin("ifc", "dxf"), kind)
        .when((kind == "pdf_page") & vector, "pdf_vector")
        .when((kind == "pdf_page") & has_raster, "raster")
        .when(kind == "image", "raster")
    )


def level_rank(name: Column) -> Column:
    """Storey order from a level name; null when the name says nothing."""
    key = tx.fold(name)
    words = F.split(key, " ")
    has = lambda vocab: F.arrays_overlap(words, F.array(*[F.lit(w) for w in vocab]))
    number = F.regexp_extract(key, r"\b(\d{1,2})(st|nd|rd|th)?\b", 1)
    suffix = F.regexp_extract(key, r"\b(\d{1,2})(st|nd|rd|th)?\b", 2)
    ordinal = F.lit(None).cast("int")
    for w, v in reversed(ORDINAL_WORDS.items()):
        ordinal = F.when(F.array_contains(words, w), v).otherwise(ordinal)
    k = F.when(number != "", number.cast("int")).otherwise(ordinal)
    one = F.when(F.coalesce(k, F.lit(0)) == 0, 1).otherwise(k)
    return (
        F.when(has(BASEMENT_WORDS), -one.cast("double"))
        .when(has(MEZZANINE_WORDS), 0.5)
        .when(has(ROOF_WORDS), ROOF_RANK)
        .when(has(GROUND_WORDS), 0.0)
        .when(k.isNotNull() & (has(STOREY_WORDS) | (suffix != "")), k.cast("double"))
    )


def stack_levels(
    levels: DataFrame, project: str = "project_id", name: str = "level_name", idx: str = "idx"
) -> DataFrame:
    """Adds rank, position, elevation_m and ``assumed``. Known storeys by rank, then unknown ones in
    input order; roofs and unknown storeys stack one storey above the highest known one each."""
    ranked = levels.withColumn("rank", level_rank(F.col(name))).withColumns(
        {
            "__sort": F.coalesce(F.col("rank"), F.lit(2 * ROOF_RANK)),
            "__float": (F.coalesce(F.col("rank"), F.lit(ROOF_RANK)) == ROOF_RANK).cast("bigint"),
        }
    )
    block = F.struct("__sort", F.floor(F.col(idx) / 4096).alias("slice"))
    placed = scan(
        ranked, [project], ["__sort", idx], block,
        running_sum={"position": F.lit(1).cast("bigint"), "__above": F.col("__float")},
    )
    top = ranked.groupBy(project).agg(
        F.max(F.when(F.col("__float") == 0, F.col("rank"))).alias("__top"),
        F.max(F.col("rank").isNull()).alias("assumed"),
    )
    base = F.coalesce("__top", F.lit(-1.0))
    level = F.when(F.col("__float") == 1, base + F.col("__above")).otherwise(F.col("rank"))
    return attach(placed, top, [project]).select(
        *levels.columns, "rank", (F.col("position") - 1).alias("position"),
        F.round(level * STOREY_HEIGHT_M, 3).alias("elevation_m"), "assumed",
    )
