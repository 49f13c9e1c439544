import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftlake.catalogue.plan_tables import supplier_halls
from draftlake.catalogue.registry import Tables
from draftlake.functions.geometry import overlap_area
from draftlake.operators import joins, scoring
from draftlake.plans import rules, tables as tb


def ring(*pts):
    return [{"x": float(x), "y": float(y)} for x, y in pts]


def test_overlap_area():
    sq = ring((0, 0), (2, 0), (2, 2), (0, 2))
    assert overlap_area([sq], [ring((1, 1), (3, 1), (3, 3), (1, 3))]) == pytest.approx(1.0)
    assert overlap_area([sq], [ring((0, 0), (2, 0), (0, 2))]) == pytest.approx(2.0)
    assert overlap_area([sq], [ring((5, 5), (6, 5), (6, 6))]) == 0.0
    ell = ring((0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3))
    assert overlap_area([ell], [sq]) == pytest.approx(3.0)
    assert overlap_area([sq, ring((0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5))], [sq]) == pytest.approx(3.0)


def test_affine_round_trip():
    m = [0.6, -0.8, 3.0, 0.8, 0.6, -1.0]
    assert np.allclose(tb.compose_affine(m, tb.invert_affine(m)), [1, 0, 0, 0, 1, 0])
    with pytest.raises(ValueError):
        tb.transform_line(None, [1, 0, 0, 0, -1, 0])


def test_arc_samples(spark):
    line = "struct<kind:string,center:struct<x:double,y:double>,radius:double,start_deg:double,end_deg:double>"
    df = spark.createDataFrame([("p", "w", ("arc", (1.0, 1.0), 2.0, 350.0, 80.0), None, None, None, None, 0.2, math.pi)], f"plan_id string, id string, centerline {line}, x0 double, y0 double, x1 double, y1 double, thickness double, length double")
    pts = tb.sample_lines(df, ["plan_id"], step=0.1).collect()
    assert len(pts) == 31
    assert all(abs(math.hypot(p.x - 1, p.y - 1) - 2) < 1e-9 and 0 <= p.angle < math.pi for p in pts)


def test_coverage_is_symmetric_on_equal_plans(spark):
    line = "struct<kind:string,center:struct<x:double,y:double>,radius:double,start_deg:double,end_deg:double>"
    rows = [("p", "w1", ("segment", None, None, None, None), 0.0, 0.0, 4.0, 0.0, 0.2, 4.0), ("p", "w2", ("segment", None, None, None, None), 0.0, 0.0, 0.0, 3.0, 0.1, 3.0)]
    lines = spark.createDataFrame(rows, f"plan_id string, id string, centerline {line}, x0 double, y0 double, x1 double, y1 double, thickness double, length double")
    s = tb.sample_lines(lines, ["plan_id"])
    assert joins.coverage(s, joins.within_tolerance(s, lines, ["plan_id"]), ["plan_id"]).first().share == 1.0
    far = lines.withColumn("y0", F.col("y0") + 0.2).withColumn("y1", F.col("y1") + 0.2)
    share = joins.coverage(s, joins.within_tolerance(s, far, ["plan_id"]), ["plan_id"]).first().share
    assert 0.38 < share < 0.45  # only the upright wall still lies on itself
    thick = lines.withColumn("thickness", F.lit(0.5))
    assert joins.coverage(s, joins.within_tolerance(s, thick, ["plan_id"]), ["plan_id"]).first().share == 0.0


def test_open_halls(spark):
    rooms, walls = supplier_halls(Tables(spark, "/root/testdata/sf0.001"))
    got = rules.open_boundary(rooms, walls)
    assert got.count() == rooms.count()
    closed = walls.filter("id = 'W0'").withColumn("id", F.lit("W3")).withColumn(
        "centerline", F.col("centerline").withField("a", F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))).withField("b", F.struct(F.lit(0.0).alias("x"), F.lit(3.0).alias("y")))
    )
    assert rules.open_boundary(rooms, walls.unionByName(closed)).isEmpty()


LINE = "struct<kind:string,a:struct<x:double,y:double>,b:struct<x:double,y:double>,center:struct<x:double,y:double>,radius:double,start_deg:double,end_deg:double>"
FACT = "struct<value:double,unit:string,provenance:array<struct<method:string,confidence:double,source_doc:string,note:string>>,status:string>"
WALLS = f"plan_id string, id string, level string, centerline {LINE}, thickness_m {FACT}, height_m {FACT}"


def half_disc(spark, **kinds):
    thick = (0.2, "m", None, "extracted")
    arc = ("arc", None, None, (0.0, 0.0), 2.0, 0.0, 180.0)
    straight = ("segment", (-2.0, 0.0), (2.0, 0.0), None, None, None, None)
    rows = [("p", "w1", "L0", arc, thick, None), ("p", "w2", "L0", straight, thick, None)]
    return spark.createDataFrame(rows, WALLS)


def test_arc_walls_close_a_room(spark):
    walls = half_disc(spark)
    pts = [(2 * math.cos(math.radians(a)), 2 * math.sin(math.radians(a))) for a in range(0, 181, 3)]
    rooms = spark.createDataFrame([("p", "r", "L0", [{"x": x, "y": y} for x, y in pts])], "plan_id string, id string, level string, polygon array<struct<x:double,y:double>>")
    assert rules.open_boundary(rooms, walls).isEmpty()
    assert rules.open_boundary(rooms, walls.filter("id = 'w2'")).first().open_m > 5
    lines = tb.wall_lines(walls, ["plan_id"])
    s = tb.sample_lines(lines, ["plan_id"])
    hits = joins.within_tolerance(s, tb.flat_lines(lines, ["plan_id"]), ["plan_id"])
    assert joins.coverage(s, hits, ["plan_id"]).first().share == 1.0


def test_two_scale_choices_of_a_level_keep_the_rows(spark):
    walls = half_disc(spark)
    tables = {
        "walls": walls,
        "openings": spark.createDataFrame([("p", "o", "w2", (1.0, "m", None, "x"), (0.9, "m", None, "x"))], f"plan_id string, id string, host_wall string, offset_m {FACT}, width_m {FACT}"),
        "conflicts": spark.createDataFrame(
            [("p", k, [{"method": "a", "value": 1.0}, {"method": "b", "value": 2.0}], 0, None, None) for k in ("scale/p1", "scale/p2")],
            "plan_id string, key string, candidates array<struct<method:string,value:double>>, proposed int, resolution int, resolved_by string"),
    }
    choices = spark.createDataFrame([("p", "scale/p1", 1, "u"), ("p", "scale/p2", 1, "u"), ("p", "scale/p2", 1, "v")], "plan_id string, key string, choice int, user string")
    levels = spark.createDataFrame([("p", "p1", "L0"), ("p", "p2", "L0"), ("p", "p2", "L0")], "plan_id string, page string, level string")
    out, refused = tb.resolve_conflicts(tables, choices, levels)
    assert {r.id: r.thickness_m.value for r in out["walls"].collect()} == {"w1": pytest.approx(0.8), "w2": pytest.approx(0.8)}
    assert out["openings"].count() == 1 and out["conflicts"].filter("resolution = 1").count() == 2 and refused.isEmpty()


def test_unreachable_rooms(spark):
    rooms = spark.createDataFrame([("p", r) for r in "abcd"] + [("q", "x"), ("q", "y"), ("s", "z")], "plan_id string, id string")
    doors = spark.createDataFrame([("p", "D1", "a"), ("p", "D2", "a"), ("p", "D2", "b"), ("p", "D3", "c"), ("p", "D3", "d"), ("q", "D1", "x"), ("q", "D1", "y")], "plan_id string, door string, room string")
    got = {(r.plan_id, r.elements[0]) for r in rules.unreachable_rooms(doors, rooms).collect()}
    assert got == {("p", "c"), ("p", "d")}


def test_room_labels(spark):
    rows = [("r", 1, "SALON", 2.0), ("r", 2, "not", 5.0), ("r", 3, "Z01", 2.0), ("r", 4, "K1", 2.0), ("r", 5, "24,50 m²", 1.0)]
    df = spark.createDataFrame(rows, "room string, word_no int, text string, height double")
    r = joins.room_labels(df, ["room"], ["salon"]).first()
    assert (r.name, r.number, r.label_area_m2) == ("SALON", "Z1", 24.5)


def test_texts_of_rooms_are_read_once(spark):
    rows = [("r", 1, None, 2.0), ("r", 2, "Oda", 5.0), ("r", 3, "Salon 2", 1.0), ("r", 4, "Salon", 1.0), ("r", 5, "900 m2", None), ("r", 6, "3000 m2", 1.0), ("s", 1, "+2.80", 1.0)]
    df = spark.createDataFrame(rows, "room string, word_no int, text string, height double")
    out = joins.room_labels(df, ["room"], ["salon"])
    assert {r.room: tuple(r)[1:] for r in out.collect()} == {"r": ("Salon 2", None, 900.0), "s": (None, None, None)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("(?i)^(\\d+") == 1  # not once in each aggregate


def test_schedule_enrichment(spark):
    openings = spark.createDataFrame([("o1", "K1", 0.90, "extracted", None, None, ["drawing"]), ("o2", "K2", 0.90, "extracted", 2.0, None, ["drawing"]), ("o3", None, 1.0, "extracted", None, None, ["drawing"])],
                                     "opening_id string, tag string, width_m double, width_status string, height_m double, sill_m double, provenance array<string>")
    rows = spark.createDataFrame([("K1", "r1", 1, 0.7, 2.1, 0.0), ("K1", "r2", 2, 0.92, 2.2, 9.0), ("K2", "r3", 1, 1.2, None, None)], "tag string, row_id string, order_no int, width double, height double, sill double")
    enriched, conflicts = joins.enrich_with_schedule(openings, rows)
    got = {r.opening_id: r for r in enriched.collect()}
    assert (got["o1"].width_m, got["o1"].width_status, got["o1"].height_m, got["o1"].sill_m) == (0.9, "corroborated", 2.2, None)
    assert (got["o2"].width_m, got["o2"].width_status, got["o2"].provenance) == (1.2, "conflicted", ["schedule", "drawing"])
    assert got["o3"].width_status == "extracted"
    assert [(r.key, r.candidates, r.proposed) for r in conflicts.collect()] == [("opening/o2/width", [0.9, 1.2], 1)]


def test_classifier(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 300)
    x = rng.normal(0, 1, (300, 4)) + np.eye(4)[:3][y] * 3
    x[:, 3] = 5.0  # a constant feature
    df = spark.createDataFrame([(int(i), f"c{k}", [float(v) for v in row]) for i, (k, row) in enumerate(zip(y, x))], "id int, label_true string, x array<double>")
    model = scoring.fit_classifier(df, "x", "label_true", ["a", "b", "c", "d"], calibration=df)
    assert model.std[3] == 1.0 and 1.0 <= model.temperature <= 20.0
    z = np.hstack([(x - model.mean) / model.std])
    w, b = np.array(model.weights), np.array(model.bias)
    p = np.exp(z @ w.T + b)
    p /= p.sum(axis=1, keepdims=True)
    grad = z.T @ (p - np.eye(3)[y]) / len(y) + 1e-2 * w.T
    assert np.abs(grad).max() < 1e-4  # the regularised loss is at its minimum
    scored = scoring.score(df, "x", model)
    assert scored.filter("label = label_true").count() > 270
    odd = spark.createDataFrame([([9.0, 0.0, 0.0, 5.0],)], "x array<double>")
    r = scoring.score(odd, "x", model).first()
    assert r.outside == ["a"] and r.needs_review and abs(sum(r.probabilities.values()) - 1) < 1e-3


PLAN_KEYS = ["plan_id"]


def box(x, y, w, h):
    return ring((x, y), (x + w, y), (x + w, y + h), (x, y + h))


def plan(plan_id, rooms=(), walls=(), openings=()):
    """A plan document from short forms: rooms (id, ring, holes), walls (id, x0, y0, x1, y1), openings
    (id, wall, offset, type)."""
    number = lambda v: None if v is None else (float(v), "m", None, "extracted")
    line = lambda a, b, c, d: ("segment", (float(a), float(b)), (float(c), float(d)), None, None, None, None)
    return (
        plan_id, "p", "dxf", [("L0", "Ground", 0.0, None)],
        [(i, "L0", line(*at), number(0.2), number(3), 0.0, "interior") for i, *at in walls],
        [(i, w, number(off), number(0.9), number(2), number(0), kind, None) for i, w, off, kind in openings],
        [(i, "L0", r, list(h), None, None, None, None, None, False) for i, r, *h in rooms], [], [], [],
    )


def walled(x0, y0, x1, y1, prefix):
    return [(f"{prefix}{k}", *s) for k, s in enumerate(((x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0)))]


def both_ways(spark, plans, most=2_000):
    """Issues in the row and from exploded tables, which must agree."""
    from draftlake.plans import nested
    from draftlake.plans.schema import PLAN

    df = spark.createDataFrame(plans, PLAN)
    key = lambda r: (r.plan_id, r.code, r.severity, tuple(r.elements))
    inner = sorted(map(key, nested.plan_issues(df, most=most).collect()))
    outer = sorted(map(key, rules.all_issues(tb.explode_plan(df)).collect()))
    assert inner == outer
    return {(p, c, *e) for p, c, _, e in inner}


def test_polygon_validity(spark):
    sq, hole = box(0, 0, 4, 4), box(1, 1, 1, 1)
    cases = {
        "square": (sq, [], True), "closed": ([*sq, sq[0]], [], True), "repeat": ([sq[0], sq[0], *sq[1:]], [], True),
        "bow": (ring((0, 0), (4, 4), (4, 0), (0, 4)), [], False), "pinch": (ring((0, 0), (4, 0), (2, 2), (4, 4), (0, 4), (2, 2)), [], False),
        "spike": (ring((0, 0), (4, 0), (4, 4), (4, 6), (4, 4), (0, 4)), [], False), "flat": (ring((0, 0), (4, 0), (2, 0)), [], False),
        "two": (ring((0, 0), (1, 1)), [], False), "none": ([], [], False), "null": (None, [], False),
        "ell": (ring((0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3)), [], True),
        "touching side": (ring((0, 0), (4, 0), (4, 4), (2, 0), (0, 4)), [], False),
        "hole": (sq, [hole], True), "no holes": (sq, None, True), "outside": (sq, [box(9, 9, 1, 1)], False),
        "crossing": (sq, [box(3, 3, 2, 0.5)], False), "shared edge": (sq, [box(0, 1, 1, 1)], False), "hole bow": (sq, [ring((1, 1), (2, 2), (2, 1), (1, 2))], False),
        "touching hole": (sq, [ring((0, 2), (1, 1), (1, 3))], True), "two holes": (sq, [hole, box(2.5, 2.5, 1, 1)], True),
        "nested holes": (sq, [box(1, 1, 2, 2), box(1.5, 1.5, 0.5, 0.5)], False), "equal holes": (sq, [hole, hole], False),
    }
    from draftlake.functions.polygons import valid_polygon

    point = "array<struct<x:double,y:double>>"
    df = spark.createDataFrame([(k, p, h) for k, (p, h, _) in cases.items()], f"name string, polygon {point}, holes array<{point}>")
    got = {r.name: r.ok for r in df.select("name", valid_polygon(F.col("polygon"), F.col("holes")).alias("ok")).collect()}
    assert got == {k: ok for k, (_, _, ok) in cases.items()}


def test_clean_plan_and_every_room_defect(spark):
    outer = walled(0, 0, 8, 4, "w") + [("m", 4, 0, 4, 4)]
    rooms = [("A", box(0.1, 0.1, 3.8, 3.8)), ("B", box(4.1, 0.1, 3.8, 3.8))]
    doors = [("d1", "w0", 2, "door"), ("d2", "m", 2, "door"), ("v", "w1", 2, "window")]
    bow = ring((0.1, 0.1), (3.9, 3.9), (3.9, 0.1), (0.1, 3.9))
    plans = [
        plan("clean", rooms, outer, doors),
        plan("no way", rooms, outer, [doors[0], doors[2]]),
        plan("no door", rooms, outer),
        plan("no wall", rooms, outer[:4], doors[:1]),
        plan("bow", [("A", bow), rooms[1]], outer, doors),
        plan("overlap", [rooms[0], ("B", ring((3, 0.1), (7.9, 0.1), (7.9, 3.9), (3.5, 3.9)))], outer, doors),
        plan("one", rooms[:1], outer, []), plan("empty"),
    ]
    got = both_ways(spark, plans)
    assert {x for x in got if x[0] == "clean"} == set() and not [x for x in got if x[0] in ("one", "empty")]
    assert {x for x in got if x[0] == "no way"} == {("no way", "ROOM_UNREACHABLE", "B")}
    assert {x for x in got if x[0] == "no door"} == {("no door", "ROOM_UNREACHABLE", "B")}
    assert {x[1:] for x in got if x[0] == "no wall"} >= {("ROOM_OPEN", "A"), ("ROOM_OPEN", "B"), ("ROOM_UNREACHABLE", "B")}
    assert ("bow", "ROOM_INVALID_POLYGON", "A") in got and not [x for x in got if x[0] == "bow" and x[1] in ("ROOMS_OVERLAP", "ROOM_TOO_SMALL")]
    assert ("overlap", "ROOMS_OVERLAP", "A", "B") in got
    assert both_ways(spark, plans, most=3) == got  # larger plans go through the exploded tables


def brute_open(poly, walls, step=1e-3):
    """Length of the ring outside all bands, on a fine grid."""
    out = 0.0
    for (ax, ay), (bx, by) in zip(poly, poly[1:] + poly[:1]):
        n = max(1, int(math.hypot(bx - ax, by - ay) / step))
        for k in range(n):
            x, y = ax + (bx - ax) * (k + 0.5) / n, ay + (by - ay) * (k + 0.5) / n
            for x0, y0, x1, y1, t in walls:
                size = (x1 - x0) ** 2 + (y1 - y0) ** 2
                u = min(1.0, max(0.0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / size if size else 0.0))
                if math.hypot(x - x0 - u * (x1 - x0), y - y0 - u * (y1 - y0)) <= t / 2 + 0.03:
                    break
            else:
                out += math.hypot(bx - ax, by - ay) / n
    return out


def test_open_boundary_is_exact(spark):
    rng = np.random.default_rng(7)
    walls_, rooms_, want = [], [], {}
    for p in range(12):
        poly = [tuple(map(float, rng.uniform(0, 9, 2))) for _ in range(5)]
        walls = [(*map(float, rng.uniform(0, 9, 4)), float(rng.uniform(0.05, 2))) for _ in range(6)] + [(2.0, 2.0, 2.0, 2.0, 1.0)]
        rooms_.append((f"p{p}", "r", "L0", [{"x": x, "y": y} for x, y in poly]))
        for k, (x0, y0, x1, y1, t) in enumerate(walls):
            walls_.append((f"p{p}", f"w{k}", "L0", ("segment", (x0, y0), (x1, y1), None, None, None, None), (t, "m", None, "x"), None))
        want[f"p{p}"] = brute_open(poly, walls)
    rooms = spark.createDataFrame(rooms_, "plan_id string, id string, level string, polygon array<struct<x:double,y:double>>")
    got = {r.plan_id: r.open_m for r in rules.open_boundary(rooms, spark.createDataFrame(walls_, WALLS)).collect()}
    assert all(got[p] == pytest.approx(v, abs=0.02) for p, v in want.items())
    exact = spark.createDataFrame([("q", "w", "L0", ("segment", (0.0, 0.0), (1.0, 0.0), None, None, None, None), (0.2, "m", None, "x"), None)], WALLS)
    side = spark.createDataFrame([("q", "r", "L0", [{"x": -1.0, "y": 0.05}, {"x": 3.0, "y": 0.05}])], rooms.schema)
    reach = math.sqrt(0.13 ** 2 - 0.05 ** 2)
    assert rules.open_boundary(side, exact).first().open_m == pytest.approx(2 * (4 - 1 - 2 * reach), abs=1e-9)


def test_rules_of_a_plan_are_evaluated_once(spark):
    from draftlake.catalogue.plan_tables import line_plans
    from draftlake.catalogue.registry import Tables
    from draftlake.plans import nested

    plans = line_plans(Tables(spark, "/root/testdata/sf0.001")).limit(3)
    found = nested.plan_issues(plans)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("DUPLICATE_ID") == 1


def test_line_plans_have_no_interpreted_copies(spark):
    from draftlake.catalogue.plan_tables import line_plans
    from draftlake.plans.schema import PLAN

    plans = line_plans(Tables(spark, "/root/testdata/sf0.001"))
    wanted = spark.createDataFrame([], PLAN).schema
    assert [(f.name, f.dataType.simpleString()) for f in plans.schema] == [(f.name, f.dataType.simpleString()) for f in wanted]
    assert "lambda" not in plans._jdf.queryExecution().optimizedPlan().toString()


def test_part_counts_are_the_rows_of_the_exploded_tables(spark):
    schema = "plan_id string, walls array<struct<id:string>>, openings array<struct<id:string>>, rooms array<struct<id:string>>"
    rows = [("a", [("w1",), ("w2",)], [], None), ("b", [("w1",)], None, [(None,)]), (None, None, None, [("r",), ("s",)])]
    for given in (rows, []):
        plans = spark.createDataFrame(given, schema)
        want = {part: df.count() for part, df in tb.explode_plan(plans).items()}
        counted = tb.part_counts(plans)
        assert {r.part: r.n for r in counted.collect()} == want
        assert "Generate explode" not in counted._jdf.queryExecution().optimizedPlan().toString()


def test_fact_table_reads_the_named_tables_alone(spark):
    from draftlake.catalogue.plan_tables import line_plans

    tables = tb.explode_plan(line_plans(Tables(spark, "/root/testdata/sf0.001")).limit(20))
    some = tb.fact_table(tables, names={"walls": ["height_m"], "openings": ["sill_m"]})
    every = tb.fact_table(tables).filter("(part = 'walls' and path = 'height_m') or (part = 'openings' and path = 'sill_m')")
    assert sorted(map(str, some.collect())) == sorted(map(str, every.collect()))
    plain = {part: spark.createDataFrame([], df.schema) for part, df in tables.items() if part in ("walls", "openings")}
    assert tb.fact_table(plain, names={"walls": ["height_m"]}).columns == some.columns


def test_upright_rooms_send_no_rows_to_python(spark, monkeypatch):
    from draftlake.plans import compare

    def refuse(a, b):
        raise AssertionError("a pair of upright rectangles went to Python")

    box = lambda x: ring((x, 0), (x + 2, 0), (x + 2, 2), (x, 2))
    schema = "p int, id int, polygon array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>"
    new = spark.createDataFrame([(1, 1, box(0.0), None), (1, 2, box(5.0), [])], schema)
    old = spark.createDataFrame([(1, 7, box(1.0), []), (2, 8, box(0.0), None)], schema)
    tilted = spark.createDataFrame([(1, 9, ring((0, 0), (2, 0), (0, 2)), None), (1, 10, None, None)], schema)
    for a, b in ((new, old.union(tilted)), (new.union(tilted), old)):  # a triangle on either side is met as well
        got = {(r.new_id, r.old_id): round(r.overlap, 6) for r in compare.room_overlaps(a, b, ["p"]).collect()}
        assert got == ({(1, 7): 2.0, (1, 9): 2.0} if b is not old else {(1, 7): 2.0, (9, 7): 0.5})
    monkeypatch.setattr(compare, "overlap_m2", F.pandas_udf(refuse, "double"))
    assert [(r.new_id, r.old_id, r.overlap) for r in compare.room_overlaps(new, old, ["p"]).collect()] == [(1, 7, 2.0)]


def test_exploded_parts_are_built_once(spark):
    plans = spark.sql("SELECT 'p' AS plan_id, array(struct('w' AS id), NULL) AS walls UNION ALL SELECT 'q', array() UNION ALL SELECT 'r', NULL")
    walls = tb.explode_plan(plans)["walls"]
    assert sorted((r.plan_id, r.id) for r in walls.collect() if r.id) == [("p", "w")] and walls.count() == 2
    built = spark.range(3).select(F.col("id").alias("plan_id"), F.array(F.struct(F.hex("id").alias("id"))).alias("walls"))
    plan = tb.explode_plan(built)["walls"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("hex(") == 1, "an inferred filter builds the part a second time"


def test_unchanged_walls_are_not_sent_to_openings(spark):
    factors = spark.createDataFrame([("p", "L0", 1.0), ("p", "L1", 2.0), ("p", "L2", None)], "plan_id string, level string, factor double")
    line = "named_struct('kind', 'segment', 'a', named_struct('x', 1D, 'y', 0D), 'b', named_struct('x', 2D, 'y', 0D), 'center', CAST(NULL AS struct<x:double,y:double>), 'radius', 0D, 'start_deg', 0D, 'end_deg', 0D)"
    fact = "named_struct('value', 3D, 'unit', 'm', 'provenance', 'x')"
    walls = spark.range(3).selectExpr("'p' AS plan_id", "concat('w', id) AS id", "concat('L', id) AS level", f"{line} AS centerline", f"{fact} AS thickness_m")
    openings = spark.range(4).selectExpr("'p' AS plan_id", "concat('o', id) AS id", "concat('w', id) AS host_wall", f"{fact} AS offset_m", f"{fact} AS width_m")
    out = tb.rescale({"walls": walls, "openings": openings}, factors)
    assert {r.id: r.thickness_m.value for r in out["walls"].collect()} == {"w0": 3.0, "w1": 6.0, "w2": 3.0}
    assert {r.id: r.width_m.value for r in out["openings"].collect()} == {"o0": 3.0, "o1": 6.0, "o2": 3.0, "o3": 3.0}
    assert "LeftOuter" not in out["openings"]._jdf.queryExecution().optimizedPlan().toString().split("LeftOuter", 1)[1]


def test_plan_facts_has_every_fact_of_every_element(spark):
    from draftlake.catalogue.plan_tables import plan_facts

    got = {(r.part, r.path): (r.n, r.top) for r in plan_facts(Tables(spark, "/root/testdata/sf0.001")).collect()}
    lines = Tables(spark, "/root/testdata/sf0.001").lineitem.count()
    assert set(got) == {(part, path) for part, paths in tb.FACTS.items() for path in paths if part != "columns"}  # the given plans have no columns
    assert got["rooms", "name"] == (2 * lines, None) and got["rooms", "number"] == (2 * lines, 1.0)
    assert got["levels", "floor_to_floor_m"] == (lines, 3.0)


def test_open_lengths_of_many_plans_at_once(spark):
    from draftlake.plans import nested
    from draftlake.plans.schema import PLAN

    rng = np.random.default_rng(11)
    number = lambda v: None if v is None else (float(v), "m", None, "extracted")
    at = lambda: tuple(map(float, rng.uniform(0, 9, 2)))
    plans = []
    for p in range(25):
        walls_ = []
        for k in range(int(rng.integers(0, 7))):
            arc = ("arc", None, None, at(), float(rng.uniform(0.5, 4)), *map(float, rng.uniform(-400, 400, 2)))
            line = arc if k % 3 == 2 else ("segment", at(), at(), None, None, None, None)
            walls_.append((f"w{k}", ["L0", "L1"][k % 5 % 2], line, number(rng.uniform(0.05, 2)), number(3), 0.0, "interior"))
        rooms_ = [(f"r{k}", ["L0", "L1", None][k % 3], [dict(zip("xy", at())) for _ in range(int(rng.integers(3, 6)))], [], None, None, None, None, None, False) for k in range(int(rng.integers(0, 4)))]
        plans.append((f"p{p}", "p", "dxf", [("L0", "", 0.0, None), ("L1", "", 3.0, None)], walls_, [], rooms_, [], [], []))
    plans.append(("null", "p", "dxf", None, None, None, [("r", "L0", None, None, None, None, None, None, None, False), ("s", "L0", [None, {"x": 1.0, "y": None}], None, None, None, None, None, None, False)], None, None, None))
    df = spark.createDataFrame(plans, PLAN)
    tables = tb.explode_plan(df)
    want = {(r.plan_id, r.room): r.open_m for r in rules.open_boundary(tables["rooms"].filter("plan_id <> 'null'"), tables["walls"]).collect()}
    got = df.select("plan_id", "rooms.id", nested.open_rooms().alias("bare")).collect()
    bare = {(r.plan_id, i): v for r in got for i, v in zip(r.id, r.bare) if r.plan_id != "null" and v >= rules.MIN_OPEN_RUN}
    assert len(want) > 20 and bare.keys() == want.keys() and all(bare[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())
    assert [list(r.bare) for r in got if r.plan_id == "null"] == [[None, None]]


def test_plans_to_check_are_built_once_and_not_written(spark, monkeypatch):
    from draftlake import session
    from draftlake.catalogue.plan_tables import plan_issues

    monkeypatch.setattr(session, "cut_lineage", None)
    found = plan_issues(Tables(spark, "/root/testdata/sf0.001"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RDD" not in plan  # no checkpoint
    assert plan.count("Salon") == 4  # two rooms, once for all rules and once for rooms that are no rectangles
