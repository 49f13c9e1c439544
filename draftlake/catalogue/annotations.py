"""Steps before and after the joins: box and path filters, bubble tags, room texts, tags at openings,
rooms carried over, plans in another frame, page metadata, and models under their licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.catalogue.joins import BOXES_SQL, embedded_boxes
from draftlake.catalogue.plan_tables import POINTS_SQL, line_plans, point, vector_points
from draftlake.catalogue.quality import part_models
from draftlake.catalogue.registry import Tables, query
from draftlake.functions import text as tx
from draftlake.functions.geometry import polygon_area
from draftlake.operators import joins as op
from draftlake.operators import licences as lic
from draftlake.operators.mining import meta_features
from draftlake.plans import compare, tables as tb


def supplier_texts(t: Tables) -> DataFrame:
    """One unit room per supplier, and the texts of the lines at the places where they stand: names,
    numbers, area labels, door tags and ceiling labels, by line number. Rows (room, word_no, text,
    height) of the texts inside a room."""
    k, n = F.col("s_suppkey").cast("double"), F.col("l_linenumber")
    ring = F.array(*[point(k + x, F.lit(y)) for x, y in ((0, 0.0), (1, 0.0), (1, 1.0), (0, 1.0))])
    rooms = t.supplier.select(F.col("s_suppkey").alias("room"), ring.alias("ring"))
    name = F.when(F.col("l_returnflag") == "R", "Salon").when(F.col("l_returnflag") == "A", "Salon 2").otherwise("Oda")
    code = (F.col("l_partkey") % 90).cast("string")
    text = (
        F.when(n == 1, name).when(n == 2, F.concat(F.lit("Z-0"), code))
        .when(n == 3, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(",5 m²")))
        .when(n == 4, F.concat(F.lit("K"), code)).when(n == 5, F.concat(F.lit("+"), (F.col("l_quantity") / 10).cast("string")))
        .otherwise(code)
    )
    words = t.lineitem.select(
        ((F.col("l_orderkey") * 8 + n) * 1_000_000 + F.col("l_partkey")).alias("word_no"), text.alias("text"), F.col("l_quantity").alias("height"),
        (F.col("l_suppkey") + F.col("l_discount") * 4 + 0.1).alias("x"), (F.col("l_tax") * 5 + 0.1).alias("y"),
    )
    return op.points_in_polygons(words, rooms).select("room", "word_no", "text", "height")


@query(
    "room_texts",
    """
    WITH w AS (SELECT l_suppkey AS room, l_linenumber AS n, (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS word_no, l_quantity AS h, l_partkey % 90 AS code,
        CASE l_returnflag WHEN 'R' THEN 'Salon' WHEN 'A' THEN 'Salon 2' ELSE 'Oda' END AS name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
    SELECT room, first(name ORDER BY name <> 'Oda' DESC, h DESC, word_no) FILTER (n = 1) AS name,
      first('Z' || code ORDER BY word_no) FILTER (n = 2) AS number, first(h + 0.5 ORDER BY word_no DESC) FILTER (n = 3) AS label_area_m2
    FROM w GROUP BY 1
    """,
)
def room_texts(t: Tables) -> DataFrame:
    """JOIN-9: name, number and area label of every room from the texts inside it."""
    return op.room_labels(supplier_texts(t), ["room"], ["salon"])


@query(
    "ceiling_heights",
    """
    SELECT l_suppkey AS room, max(l_quantity / 10) AS ceiling_height_m, count(*) AS labels FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
    WHERE l_linenumber = 5 AND l_quantity / 10 BETWEEN 2 AND 15 GROUP BY 1
    """,
)
def ceiling_heights(t: Tables) -> DataFrame:
    """JOIN-9: the highest plausible ceiling label of every room."""
    level = F.when(F.col("text").startswith("+"), tx.parse_number(F.substr("text", F.lit(2)), "en"))
    return op.ceiling_heights(supplier_texts(t).withColumn("height_m", level), ["room"])


@query(
    "bubble_tags",
    """
    WITH r AS (SELECT l_orderkey % 50 AS page_id, l_orderkey AS bubble_id, l_linenumber % 2 AS tier, CASE WHEN l_linestatus = 'O' THEN 'K' || (l_orderkey % 30) END AS plain,
        CASE WHEN l_linestatus = 'O' THEN 'K' || (l_orderkey % 30) ELSE 'K' || (l_orderkey % 9 + 1) || '00' END AS repaired FROM lineitem),
    u AS (SELECT page_id, bubble_id, tier, plain AS tag FROM r UNION ALL SELECT page_id, bubble_id, tier + 1000, repaired FROM r),
    g AS (SELECT page_id, bubble_id, tier, min(tag) AS tag FROM u WHERE tag IS NOT NULL GROUP BY page_id, bubble_id, tier HAVING count(*) >= 2 AND min(tag) = max(tag)),
    v AS (SELECT page_id, bubble_id, arg_min(tag, tier) AS tag, min(tier) AS tier FROM g GROUP BY 1, 2)
    SELECT *, 'door' AS kind FROM v WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey % 50 = page_id AND 'K' || (s_suppkey % 30) = tag)
    """,
)
def bubble_tags(t: Tables) -> DataFrame:
    """JOIN-4: lines as readings of their order's bubble, half of them with letters for digits;
    suppliers as tags of the text layer."""
    o = F.col("l_orderkey")
    lookalike = F.concat(F.lit("K"), (o % 9 + 1).cast("string"), F.lit("OO"))
    readings = t.lineitem.select(
        (o % 50).alias("page_id"), o.alias("bubble_id"), (F.col("l_linenumber") % 2).alias("tier"),
        F.when(F.col("l_linestatus") == "O", F.concat(F.lit("K-0"), (o % 30).cast("string"))).otherwise(lookalike).alias("reading"),
    )
    s = F.col("s_suppkey")
    return op.read_bubble_tags(readings, t.supplier.select((s % 50).alias("page_id"), F.concat(F.lit("K"), (s % 30).cast("string")).alias("tag")))


@query(
    "readable_boxes",
    f"""
    WITH {BOXES_SQL},
    p AS (SELECT *, box_id % 2 * 90 AS rot, box_id % 3 * 400 AS tx, box_id % 2 * 300 AS ty FROM o)
    SELECT page_id, box_id, round(x0 + tx, 3) AS x0, round(y0 + ty, 3) AS y0, round(x1 + tx, 3) AS x1, round(y1 + ty, 3) AS y1 FROM p
    WHERE c >= 0.05 AND box_id % 5 > 0 AND (rot = 0 OR y1 - y0 > 1.2 * (x1 - x0))
      AND NOT (x0 <= 3 AND tx > 0 OR y0 <= 3 AND ty > 0 OR x1 >= 397 AND tx + 400 < 1200 OR y1 >= 297 AND ty + 300 < 600)
    """,
)
def readable_boxes(t: Tables) -> DataFrame:
    """JOIN-5: boxes of tiles (three by two per page) that are worth merging, in page coordinates."""
    b = F.col("box_id")
    boxes = embedded_boxes(t).withColumns({
        "text": F.when(b % 5 == 0, "  ").otherwise(F.col("text")), "rotation": b % 2 * 90,
        "tile_x": b % 3 * 400, "tile_y": b % 2 * 300, "tile_w": F.lit(400), "tile_h": F.lit(300), "page_w": F.lit(1200), "page_h": F.lit(600),
    })
    kept = op.readable_boxes(boxes, min_confidence=0.05)
    return kept.select("page_id", "box_id", *[F.round(c, 3).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(
    "open_segments",
    f"""
    WITH {POINTS_SQL}
    SELECT a.vec_id, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM pts a JOIN pts b ON b.vec_id = a.vec_id AND b.i = a.i + 1
    WHERE a.vec_id % 5 > 0 AND a.vec_id % 7 > 0 AND a.vec_id % 11 > 0 AND (a.vec_id % 3 = 0 OR a.vec_id % 4 <= 2)
    """,
)
def open_segments(t: Tables) -> DataFrame:
    """JOIN-6: vectors as paths; clipped, closed, curved and wide ones give no segments."""
    v = F.col("vec_id")
    paths = t.embeddings.select(
        v, vector_points(t).alias("points"), (v % 5 == 0).alias("clip"), (v % 7 == 0).alias("closed"), (v % 11 == 0).alias("curve"),
        F.when(v % 3 > 0, (v % 4).cast("double")).alias("width"),
    )
    return op.open_segments(paths, ["vec_id"], max_width=2.0)


@query(
    "tagged_openings",
    """
    WITH RECURSIVE t AS (SELECT c_nationkey AS nation, c_custkey % 2 = 0 AS door, CASE WHEN c_custkey % 2 = 0 THEN 'K' ELSE 'P' END || (c_custkey % 300) AS tag,
        c_acctbal / 100 AS x, c_custkey % 7 / 2.0::DOUBLE AS y FROM customer),
    o AS (SELECT s_nationkey AS nation, s_suppkey AS opening_id, s_suppkey % 3 AS k, s_acctbal / 100 AS x, s_suppkey % 7 / 2.0::DOUBLE AS y FROM supplier),
    p AS (SELECT nation, opening_id, tag, min(sqrt((o.x - t.x) * (o.x - t.x) + (o.y - t.y) * (o.y - t.y))) AS d FROM t JOIN o USING (nation)
      WHERE (CASE WHEN door THEN k <> 1 ELSE k <> 0 END) AND sqrt((o.x - t.x) * (o.x - t.x) + (o.y - t.y) * (o.y - t.y)) <= 5 GROUP BY ALL),
    q AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY d, opening_id, tag) AS n FROM p),
    r AS (SELECT nation, n, [opening_id] AS lo, [tag] AS lt, opening_id, tag, d, true AS ok FROM q WHERE n = 1
      UNION ALL SELECT nation, n, CASE WHEN ok THEN list_append(lo, opening_id) ELSE lo END, CASE WHEN ok THEN list_append(lt, tag) ELSE lt END, opening_id, tag, d, ok FROM (
        SELECT q.*, r.lo, r.lt, NOT list_contains(r.lo, q.opening_id) AND NOT list_contains(r.lt, q.tag) AS ok FROM r JOIN q ON q.nation = r.nation AND q.n = r.n + 1))
    SELECT nation, opening_id, tag, round(d, 6) AS distance FROM r WHERE ok
    """,
)
def tagged_openings(t: Tables) -> DataFrame:
    """JOIN-7: customers as tag texts, suppliers as doors, windows and French doors of their nation."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    tag = F.concat(F.when(c % 2 == 0, "K").otherwise("P"), (c % 300).cast("string"))
    texts = t.customer.select(F.col("c_nationkey").alias("nation"), tag.alias("text"), (F.col("c_acctbal") / 100).alias("x"), (c % 7 / 2).alias("y"))
    kind = F.when(s % 3 == 0, "door").when(s % 3 == 1, "window").otherwise("french_door")
    openings = t.supplier.select(
        F.col("s_nationkey").alias("nation"), s.alias("opening_id"), kind.alias("type"), (F.col("s_acctbal") / 100).alias("x"), (s % 7 / 2).alias("y"))
    return op.assign_tags(texts, openings, ["nation"], reach=5.0).withColumn("distance", F.round("distance", 6))


@query(
    "carried_rooms",
    f"""
    WITH RECURSIVE {POINTS_SQL},
    a AS (SELECT vec_id, vec_id * 32 + i AS id, i, x * 20 AS x0, y * 20 AS y0, x * 20 + 2 + 0.05::DOUBLE * i AS x1, y * 20 + 2 AS y1 FROM pts),
    b AS (SELECT vec_id, id, x0 + 1.2 AS x0, y0 - 0.8 AS y0, x1 + 1.2 AS x1, y1 - 0.8 AS y1 FROM a WHERE i % 4 > 0),
    o AS (SELECT a.vec_id, a.id AS new_id, (a.x1 - a.x0) * (a.y1 - a.y0) AS sa, {{'old': b.id, 'sb': (b.x1 - b.x0) * (b.y1 - b.y0),
        'm': (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))}} AS p
      FROM a JOIN b ON b.vec_id = a.vec_id AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)),
    c AS (SELECT vec_id, new_id, any_value(sa) AS sa, list(p ORDER BY p.m DESC, p.old DESC) AS ps FROM o WHERE p.m > 1e-9 GROUP BY 1, 2),
    q AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sa DESC, new_id DESC) AS n FROM c),
    r AS (
      SELECT vec_id, n, new_id, ps[1] AS p, ps[1].m >= 0.5 * least(sa, ps[1].sb) AS ok, CASE WHEN ps[1].m >= 0.5 * least(sa, ps[1].sb) THEN [ps[1].old] ELSE [] END AS taken FROM q WHERE n = 1
      UNION ALL
      SELECT vec_id, n, new_id, p, coalesce(p.m >= 0.5 * least(sa, p.sb), false), CASE WHEN p.m >= 0.5 * least(sa, p.sb) THEN list_append(taken, p.old) ELSE taken END FROM (
        SELECT q.vec_id, q.n, q.new_id, q.sa, r.taken, list_filter(q.ps, lambda k: NOT list_contains(r.taken, k.old))[1] AS p FROM r JOIN q ON q.vec_id = r.vec_id AND q.n = r.n + 1))
    SELECT new_id, p.old AS old_id, round(p.m, 6) AS overlap FROM r WHERE ok
    """,
)
def carried_rooms(t: Tables) -> DataFrame:
    """JOIN-7: rooms at all points of a vector keep the room of an earlier version that they overlap most."""
    placed = F.transform(vector_points(t), lambda p, i: F.struct(i.alias("i"), (p["x"] * 20).alias("x"), (p["y"] * 20).alias("y")))
    rows = t.embeddings.select("vec_id", F.inline(placed)).withColumn("id", F.col("vec_id") * 32 + F.col("i"))
    none = F.lit(None).cast("array<array<struct<x:double,y:double>>>").alias("holes")
    x1, y1 = F.col("x") + 2 + 0.05 * F.col("i"), F.col("y") + 2

    def ring(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
        return F.array(point(ax, ay), point(bx, ay), point(bx, by), point(ax, by)).alias("polygon")

    new = rows.select("vec_id", "id", ring(F.col("x"), F.col("y"), x1, y1), none)
    old = rows.filter("i % 4 > 0").select("vec_id", "id", ring(F.col("x") + 1.2, F.col("y") - 0.8, x1 + 1.2, y1 - 0.8), none)
    return op.carry_over_rooms(compare.room_overlaps(new, old, ["vec_id"])).withColumn("overlap", F.round("overlap", 6))


FRAME = (1.2, -1.6, 3.0, 1.6, 1.2, -1.0)


@query(
    "moved_plans",
    """
    WITH l AS (SELECT l_quantity AS q, l_discount AS d, l_tax AS x, l_linenumber AS n, l_orderkey % 100 AS g FROM lineitem)
    SELECT g, round(sum(1.2 * q / 10 + 3 - 1.6 * x + 3), 4) AS end_x, round(sum(1.6 * q / 10 - 1 + 1.2 * x - 1), 4) AS end_y, round(sum(2 * d + 0.4), 4) AS thickness,
      round(sum(6::DOUBLE), 4) AS heights, round(sum(2 * (q / 20) + 2 * (q / 20 + 0.5)), 4) AS offsets, round(sum(0.8::DOUBLE * n + 1), 4) AS widths,
      round(sum(4 * (q / 20) * (q / 20) + 4), 3) AS area
    FROM l GROUP BY 1
    """,
)
def moved_plans(t: Tables) -> DataFrame:
    """GEO-4: whole plans under a rotation, shift and doubling: points move, lengths double, heights stay."""
    moved = tb.transform_coords(tb.explode_plan(line_plans(t)), FRAME)
    g = (F.split_part("plan_id", F.lit("-"), F.lit(1)).cast("bigint") % 100).alias("g")
    total = lambda c, name, digits=4: F.round(F.sum(c), digits).alias(name)
    walls = moved["walls"].groupBy(g).agg(
        total("centerline.b.x", "end_x"), total("centerline.b.y", "end_y"), total("thickness_m.value", "thickness"), total("height_m.value", "heights"))
    openings = moved["openings"].groupBy(g).agg(total("offset_m.value", "offsets"), total("width_m.value", "widths"))
    rooms = moved["rooms"].groupBy(g).agg(total(polygon_area(F.col("polygon"), F.col("holes")), "area", 3))
    return walls.join(openings, "g").join(rooms, "g")


@query(
    "page_meta",
    """
    SELECT p_partkey, CAST(p_size % 3 = 0 OR p_size % 4 = 1 AS INT)::DOUBLE AS exif_camera, CAST(p_size % 5 > 0 AND p_size % 7 > 0 AS INT)::DOUBLE AS is_vector,
      CASE WHEN p_size % 5 > 0 THEN round(ln(1 + p_size % 7), 9) ELSE 0 END::DOUBLE AS log_paths,
      CASE WHEN p_size % 5 > 0 THEN CASE WHEN p_size % 2 = 0 THEN p_size / 100 ELSE 0 END WHEN p_size % 6 = 0 THEN 0 ELSE 1 END::DOUBLE AS image_area_frac FROM part
    """,
)
def page_meta(t: Tables) -> DataFrame:
    """TXT-11: parts as pages with camera, path and image metadata, each of them absent at times."""
    s = F.col("p_size")
    pages = t.part.select(
        "p_partkey", F.when(s % 3 == 0, F.col("p_brand")).alias("exif_make"), F.when(s % 4 == 1, F.col("p_type")).when(s % 4 == 2, "").alias("exif_model"),
        F.when(s % 5 > 0, s % 7).alias("path_objects"), F.when(s % 2 == 0, s / 100).alias("image_area_fraction"), F.when(s % 6 < 3, s % 6 == 0).alias("has_exif"),
    )
    return meta_features(pages).select("p_partkey", "exif_camera", "is_vector", F.round("log_paths", 9).alias("log_paths"), "image_area_frac")


@query(
    "tag_mismatch",
    """
    WITH m AS (SELECT p_partkey AS name, ['apache-2.0', 'mit', 'cc-by-4.0'][p_size % 3 + 1] AS id, ['Apache_2.0 ', 'MIT', 'other', NULL, 'CC  BY 4.0', 'Unknown'][p_size % 6 + 1] AS tag FROM part)
    SELECT name, id AS license_id, tag AS published_tag FROM m WHERE tag IS NOT NULL
      AND regexp_replace(lower(trim(tag)), '[_ ]+', '-', 'g') NOT IN (id, 'other', 'unknown')
    """,
)
def tag_mismatch(t: Tables) -> DataFrame:
    """LIC-2: parts as models whose published tag differs from the registered licence."""
    s = F.col("p_size")
    at = lambda *v: F.element_at(F.array(*[F.lit(x).cast("string") for x in v]), s % len(v) + 1)
    models = t.part.select(
        F.col("p_partkey").alias("name"), at("apache-2.0", "mit", "cc-by-4.0").alias("license_id"),
        at("Apache_2.0 ", "MIT", "other", None, "CC  BY 4.0", "Unknown").alias("published_tag"),
    )
    return lic.tag_mismatch(models)


@query(
    "blocked_in_use",
    """
    WITH m AS (SELECT p_partkey AS name, p_size AS s, p_size % 5 AS k FROM part),
    r AS (SELECT name, concat_ws(',', CASE WHEN k = 1 THEN 'blocked_list' END, CASE WHEN s % 7 = 0 THEN 'not_commercial' END, CASE WHEN k = 1 THEN 'class_blocked' END,
      CASE WHEN k = 2 AND s % 2 = 1 THEN 'terms_not_accepted' END, CASE WHEN k = 1 THEN 'not_in_allowlist' END,
      CASE WHEN s % 3 = 0 THEN 'territorial_exclusion' END, CASE WHEN s % 11 = 0 THEN 'revenue_caps' END) AS reasons FROM m WHERE s <> 50)
    SELECT name, reasons, string_agg(DISTINCT l_returnflag || ':' || l_linestatus, ',' ORDER BY l_returnflag || ':' || l_linestatus) AS used_by
    FROM r JOIN lineitem ON l_partkey = name WHERE reasons <> '' GROUP BY ALL
    """,
)
def blocked_in_use(t: Tables) -> DataFrame:
    """LIC-2: blocked parts as models that the lines use, with their users."""
    judged = lic.blocked_reasons(part_models(t), ["DE"], accepted_terms=["terms-a"])
    uses = t.lineitem.select(F.col("l_partkey").alias("name"), F.col("l_returnflag").alias("profile"), F.col("l_linestatus").alias("role"))
    out = lic.used_but_blocked(judged, uses)
    return out.select("name", F.array_join("reasons", ",").alias("reasons"), F.array_join("used_by", ",").alias("used_by"))
