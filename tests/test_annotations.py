"""Filters and annotations by hand-made rows: nulls, ties, repeated rows and empty tables."""

import math

import pytest
from pyspark.sql import functions as F

from draftlake.functions.geometry import polygon_area
from draftlake.operators import joins, licences
from draftlake.operators.mining import meta_features
from draftlake.plans import tables as tb

BOX = "id int, x0 double, y0 double, x1 double, y1 double, text string, confidence double, rotation int, tile_x int, tile_y int, tile_w int, tile_h int, page_w int, page_h int"


def test_readable_boxes(spark):
    def box(i, x0=10.0, y0=10.0, x1=60.0, y1=20.0, text="ab", c=0.9, rot=0, tx=100, ty=100):
        return (i, x0, y0, x1, y1, text, c, rot, tx, ty, 100, 100, 300, 300)

    rows = [
        box(1), box(2, c=0.29), box(3, text="  "), box(4, x0=2.0), box(5, x0=2.0, tx=0), box(6, x1=98.0), box(7, x1=98.0, tx=200), box(8, y0=3.0),
        box(9, rot=90), box(10, x1=15.0, rot=90), box(11, x1=15.0, rot=90, text="a"), box(12, c=None), box(13, text=None), box(1),
    ]
    out = joins.readable_boxes(spark.createDataFrame(rows, BOX))
    got = sorted((r.id, r.x0, r.y1) for r in out.collect())
    assert got == [(1, 110.0, 120.0), (1, 110.0, 120.0), (5, 2.0, 120.0), (7, 210.0, 120.0), (10, 110.0, 120.0)]
    assert joins.readable_boxes(spark.createDataFrame([], BOX)).count() == 0


def test_open_segments(spark):
    schema = "id int, points array<struct<x:double,y:double>>, clip boolean, closed boolean, curve boolean, width double"
    path = [(0.0, 0.0), (1.0, 0.0), (1.0, 2.0)]
    rows = [
        (1, path, False, False, False, None), (2, path, True, False, False, 1.0), (3, path, False, True, False, 1.0), (4, path, False, False, True, 1.0),
        (5, path, False, False, False, 2.5), (6, path[:1], False, False, False, 1.0), (7, [], False, False, False, 1.0), (8, path, None, False, False, 1.0),
    ]
    df = spark.createDataFrame(rows, schema)
    seg = lambda i: [(i, 0.0, 0.0, 1.0, 0.0), (i, 1.0, 0.0, 1.0, 2.0)]
    assert sorted(map(tuple, joins.open_segments(df, ["id"], max_width=2.0).collect())) == seg(1)
    assert sorted(map(tuple, joins.open_segments(df, ["id"]).collect())) == seg(1) + seg(5)
    assert joins.open_segments(df.where("false"), ["id"]).count() == 0


def test_ceiling_heights(spark):
    rows = [("a", 2.4), ("a", 3.1), ("a", 20.0), ("a", None), ("b", 1.9), ("c", 2.0), ("c", 2.0), (None, 15.0)]
    df = spark.createDataFrame(rows, "room string, height_m double")
    got = {r.room: (r.ceiling_height_m, r.labels) for r in joins.ceiling_heights(df, ["room"]).collect()}
    assert got == {"a": (3.1, 2), "c": (2.0, 2), None: (15.0, 1)}
    assert joins.ceiling_heights(df.where("false"), ["room"]).count() == 0


def test_meta_features(spark):
    schema = "id int, exif_make string, exif_model string, path_objects int, image_area_fraction double, has_exif boolean"
    rows = [(1, "Make", None, None, None, True), (2, None, "", 0, 0.4, None), (3, "", "M", 7, None, False), (4, None, None, None, 0.3, None)]
    got = {r.id: (r.exif_camera, r.is_vector, r.log_paths, r.image_area_frac) for r in meta_features(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (1.0, 0.0, 0.0, 0.0), 2: (0.0, 0.0, 0.0, 0.4), 3: (0.0, 1.0, pytest.approx(math.log(8)), 0.0), 4: (0.0, 0.0, 0.0, 1.0)}


def test_licence_tags_and_blocked_models_in_use(spark):
    rows = [("a", "Apache_2.0", "apache-2.0"), ("b", "MIT", "apache-2.0"), ("c", None, "mit"), ("d", "other", "mit"), ("e", " Unknown ", "mit"), ("f", "cc by 4.0", "mit"), ("g", "mit", None)]
    models = spark.createDataFrame(rows, "name string, published_tag string, license_id string")
    assert sorted(r.name for r in licences.tag_mismatch(models).collect()) == ["b", "f"]
    judged = spark.createDataFrame([("a", ["x"]), ("b", []), ("c", ["y", "z"]), ("d", ["x"]), (None, ["x"])], "name string, reasons array<string>")
    uses = spark.createDataFrame([("a", "p2", "r"), ("a", "p1", "r"), ("a", "p1", "r"), ("b", "p", "r"), ("c", "p", None), (None, "p", "r")], "name string, profile string, role string")
    got = {r.name: (r.reasons, r.used_by) for r in licences.used_but_blocked(judged, uses).collect()}
    assert got == {"a": (["x"], ["p1:r", "p2:r"]), "c": (["y", "z"], ["p"])}
    assert licences.used_but_blocked(judged.where("false"), uses).count() == 0


def test_a_plan_moves_there_and_back(spark):
    point, fact = "struct<x:double,y:double>", "struct<value:double,status:string>"
    line = f"struct<kind:string,a:{point},b:{point},center:{point},radius:double,start_deg:double,end_deg:double>"
    walls = spark.createDataFrame([
        ("W1", ("segment", (1.0, 2.0), (4.0, 6.0), None, None, None, None), (0.2, "extracted"), (3.0, "extracted")),
        ("W2", ("arc", None, None, (1.0, 1.0), 2.0, 350.0, 20.0), None, (3.0, "extracted")),
    ], f"id string, centerline {line}, thickness_m {fact}, height_m {fact}")
    openings = spark.createDataFrame([("O1", (1.0, "extracted"), None, (2.0, "extracted"))], f"id string, offset_m {fact}, width_m {fact}, height_m {fact}")
    ring, hole = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]
    rooms = spark.createDataFrame([("R1", ring, [hole]), ("R2", ring, [])], f"id string, polygon array<{point}>, holes array<array<{point}>>")
    columns = spark.createDataFrame([("C1", hole)], f"id string, footprint array<{point}>")
    m = (1.2, -1.6, 3.0, 1.6, 1.2, -1.0)
    plan = {"walls": walls, "openings": openings, "rooms": rooms, "columns": columns}
    moved = tb.transform_coords(plan, m)
    w = {r.id: r for r in moved["walls"].collect()}
    assert w["W1"].centerline.b == pytest.approx((1.2 * 4 - 1.6 * 6 + 3, 1.6 * 4 + 1.2 * 6 - 1)) and w["W1"].thickness_m.value == pytest.approx(0.4)
    arc, turn = w["W2"].centerline, math.degrees(math.atan2(1.6, 1.2))
    assert (arc.radius, arc.start_deg, arc.end_deg) == pytest.approx((4.0, (350 + turn) % 360, 20 + turn)) and arc.a is None
    assert w["W2"].thickness_m is None and w["W1"].height_m.value == 3.0
    o = moved["openings"].first()
    assert o.offset_m.value == pytest.approx(2.0) and o.width_m is None and o.height_m.value == 2.0
    areas = {r.id: r.a for r in moved["rooms"].select("id", polygon_area(F.col("polygon"), F.col("holes")).alias("a")).collect()}
    assert areas == pytest.approx({"R1": 44.0, "R2": 48.0})
    back = tb.transform_coords(moved, tb.invert_affine(m))
    assert [tuple(p) for p in back["columns"].first().footprint] == [pytest.approx(p) for p in hole]
    assert back["walls"].where("id = 'W1'").first().centerline.a == pytest.approx((1.0, 2.0))
    with pytest.raises(ValueError):
        tb.transform_coords({"walls": walls}, (1.0, 0.0, 0.0, 0.0, -1.0, 0.0))
    assert tb.transform_coords({"walls": walls.where("false")}, m)["walls"].count() == 0


def test_only_listed_tags_are_counted(spark):
    rows = spark.createDataFrame([("r1", "k1"), ("r2", "k1"), ("r3", "p9"), ("r4", None)], "row string, tag string")
    hits = spark.createDataFrame([("a", "k1"), ("a", "k1"), ("b", "k1"), ("b", "zz"), ("b", None)], "page_id string, tag string")
    out = joins.link_tags(rows, hits)
    assert {(r.row, r.links, r.pages) for r in out.collect()} == {("r1", 3, 2), ("r2", 3, 2), ("r3", 0, 0), ("r4", 0, 0)}
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
