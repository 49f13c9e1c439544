import json
"""Set-based greedy operators against plain sequential loops on random data with a hot group."""

import math
import random

import numpy as np
import pytest

from draftlake.operators import joins, windows


def iou(a, b):
    ix, iy = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    inter = ix * iy
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter, (inter / union if union > 0 else 0)


def test_overlap_suppression(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        x, y = (50, 50) if i % 3 == 0 else (rng.uniform(0, 900), rng.uniform(0, 900))
        w, h = rng.uniform(20, 120), rng.uniform(10, 60)
        if i % 6 == 0:
            w, h = 60.0, 30.0  # a third in one place, half of those exact copies
        rows.append(("p", i, rng.choice("ab"), round(rng.random(), 3), float(x), float(y), x + w, y + h))
    df = spark.createDataFrame(rows, "page_id string, box_id int, text string, confidence double, x0 double, y0 double, x1 double, y1 double")
    kept = []
    for r in sorted(rows, key=lambda r: (-r[3], r[1])):
        box, area = r[4:], (r[6] - r[4]) * (r[7] - r[5])
        if not any((k[2] == r[2] and iou(box, k[4:])[1] > 0.3) or iou(box, k[4:])[0] / area > 0.5 for k in kept):
            kept.append(r)
    got = {r.box_id for r in joins.suppress_overlaps(df, ["page_id"]).collect()}
    assert got == {k[1] for k in kept}


def test_one_to_one(spark):
    rng = random.Random(2)
    left = [(1 if i % 3 else 0, i, round(rng.uniform(0, 30), 3)) for i in range(120)]
    right = [(1 if i % 3 else 0, 1000 + i, round(rng.uniform(0, 30), 3)) for i in range(120)]
    a = spark.createDataFrame(left, "g int, l int, v double")
    b = spark.createDataFrame(right, "g int, r int, v double")
    pairs = joins.near_pairs_1d(a, b, ["g"], "v", "l", "r", 0.5)
    want, used_l, used_r = set(), set(), set()
    for s, i, j in sorted((abs(x[2] - y[2]), x[1], y[1]) for x in left for y in right if x[0] == y[0] and abs(x[2] - y[2]) <= 0.5):
        if i not in used_l and j not in used_r:
            want.add((i, j))
            used_l.add(i)
            used_r.add(j)
    assert {(r.l, r.r) for r in joins.match_one_to_one(pairs, "l", "r").collect()} == want
    assert {(r.l, r.r) for r in joins.match_values(a, b, ["g"], "v", "l", "r", 0.5).collect()} == want


def test_one_to_one_with_hot_values(spark):
    rng = random.Random(6)
    value = lambda i, hot: hot if i % 3 == 0 else round(rng.uniform(9, 11), 2)
    left = [(0, i, value(i, 10.0)) for i in range(90)]
    right = [(0, 1000 + i, value(i, 10.0 if i % 2 else 10.1)) for i in range(120)]
    a, b = spark.createDataFrame(left, "g int, l int, v double"), spark.createDataFrame(right, "g int, r int, v double")
    want, used_l, used_r = set(), set(), set()
    for s, i, j in sorted((abs(x[2] - y[2]), x[1], y[1]) for x in left for y in right if abs(x[2] - y[2]) <= 0.2):
        if i not in used_l and j not in used_r:
            want.add((i, j))
            used_l.add(i)
            used_r.add(j)
    assert {(r.l, r.r) for r in joins.match_values(a, b, ["g"], "v", "l", "r", 0.2).collect()} == want


def test_views(spark):
    rng = random.Random(3)
    rows = [("r1" if i % 3 else "r0", i, rng.uniform(0, 4), rng.uniform(0, 4), rng.uniform(0, 360), round(rng.random(), 6)) for i in range(90)]
    df = spark.createDataFrame(rows, "room string, cam_id int, x double, y double, yaw_deg double, score double")
    want = set()
    for room in ("r0", "r1"):
        chosen = []
        for r in sorted((r for r in rows if r[0] == room), key=lambda r: (-r[5], r[2], r[3], r[4])):
            close = any(math.hypot(r[2] - c[2], r[3] - c[3]) < 1 and abs((r[4] - c[4] + 180) % 360 - 180) < 30 for c in chosen)
            if len(chosen) < 4 and not close:
                chosen.append(r)
        want |= {(room, c[1], i + 1) for i, c in enumerate(chosen)}
    assert {(r.room, r.cam_id, r.choice) for r in windows.propose_views(df, ["room"], 4).collect()} == want


def test_chains_with_cycle(spark):
    data = [("a", "b", False), ("b", "c", False), ("c", None, True), ("x", "y", False), ("y", "x", False), ("z", None, False)]
    df = spark.createDataFrame(data, "name string, fallback string, usable boolean")
    got = {r.name: (r.serving, r.status) for r in joins.fallback_chain(df, mock="mock").collect()}
    assert got == {"a": ("c", "degraded"), "b": ("c", "degraded"), "c": ("c", "ok"), "x": ("mock", "degraded"), "y": ("mock", "degraded"), "z": ("mock", "degraded")}
    assert {r.status for r in joins.fallback_chain(df).filter("name = 'x'").collect()} == {"missing"}


DOC = {"a": 1, "b": {"c": [1, 2, 3]}, "d/e": "s", "f~g": "t"}
PATCHES = [  # operations (op, path, from, value) and the document after them; None: refused
    ([("add", "/x", None, 5)], {**DOC, "x": 5}),
    ([("add", "/b/c/1", None, 9)], {**DOC, "b": {"c": [1, 9, 2, 3]}}),
    ([("add", "/b/c/-", None, 4)], {**DOC, "b": {"c": [1, 2, 3, 4]}}),
    ([("remove", "/b/c/0", None, None)], {**DOC, "b": {"c": [2, 3]}}),
    ([("replace", "/d~1e", None, "x"), ("replace", "/f~0g", None, "y")], {**DOC, "d/e": "x", "f~g": "y"}),
    ([("move", "/x", "/a", None), ("move", "/b/a", "/x", None)], {"b": {"c": [1, 2, 3], "a": 1}, "d/e": "s", "f~g": "t"}),
    ([("copy", "/z", "/b", None), ("remove", "/z/c/2", None, None)], {**DOC, "z": {"c": [1, 2]}}),
    ([("test", "/b/c/2", None, 3), ("move", "/q", "/b", None)], {"a": 1, "q": {"c": [1, 2, 3]}, "d/e": "s", "f~g": "t"}),
    *[([("replace", "/a", None, 99), bad], None) for bad in [
        ("replace", "/missing", None, 1), ("remove", "/missing", None, None), ("remove", "/b/c/7", None, None), ("test", "/a", None, 2),
        ("add", "a", None, 1), ("add", "", None, 1), ("frobnicate", "/a", None, None), ("add", "/b/c/x", None, 1), ("copy", "/y", "/missing", None),
    ]],
]


def test_replay(spark):
    dump = lambda v: None if v is None else json.dumps(v)
    names = [f"e{i}" for i in range(len(PATCHES))]
    base = spark.createDataFrame([(n, json.dumps(DOC)) for n in names], "entity string, doc string")
    ops = [(n, k, o, p, f, dump(v)) for n, (log, _) in zip(names, PATCHES) for k, (o, p, f, v) in enumerate(log)] + [("new", 0, "add", "/k", None, "1")]
    state, refused = windows.replay_changes(base, spark.createDataFrame(ops, "entity string, seq bigint, op string, path string, from_path string, value string"))
    got = {r.entity: json.loads(r.doc) for r in state.collect()}
    assert got == {n: DOC if want is None else want for n, (_, want) in zip(names, PATCHES)} | {"new": {"k": 1}}
    assert {r.entity: r.seq for r in refused.collect()} == {n: 1 for n, (_, want) in zip(names, PATCHES) if want is None}


def test_edit_lineage_with_circle(spark):
    edits = [(f"v{i}", f"v{i + 1}", f"e{i}") for i in range(20)] + [("x", "y", "xy"), ("y", "x", "yx")]
    df = spark.createDataFrame(edits, "from_version string, to_version string, edit_id string")
    versions = spark.createDataFrame([("v20", "v3", "approved"), ("v1", "v1", "approved"), ("x", "r", "approved"), ("v9", "v0", "draft")], "id string, root_id string, status string")
    got = [(r.version_id, r.depth, r.edit_id) for r in windows.edit_lineage(versions, df).collect()]
    assert sorted(got) == sorted([("v20", 20 - i, f"e{i}") for i in range(3, 20)] + [("x", 1, "yx"), ("x", 2, "xy")])


def test_reachable(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")], "a string, b string")
    start = spark.createDataFrame([("c",)], "node string")
    assert {r.node for r in windows.reachable(edges, start).collect()} == {"a", "b", "c"}


def test_reachable_leaves_other_components_alone(spark, monkeypatch):
    rng = random.Random(8)
    pairs = [(rng.randrange(60), rng.randrange(60, 100)) for _ in range(70)] + [(i, i + 1) for i in range(200, 230)] + [(300, 300)]
    edges, ways = spark.createDataFrame(pairs, "a long, b long"), {}
    for a, b in pairs:
        ways.setdefault(a, set()).add(b)
        ways.setdefault(b, set()).add(a)
    for starts in ([200], [215, 5], [300, 999], []):
        want, todo = set(starts), list(starts)
        while todo:
            new = ways.get(todo.pop(), set()) - want
            want |= new
            todo += new
        for few in (0, 200_000):
            monkeypatch.setattr(windows, "FEW_NODES", few)
            got = [r.node for r in windows.reachable(edges, spark.createDataFrame([(s,) for s in starts], "node long")).collect()]
            assert sorted(got) == sorted(want)
    monkeypatch.setattr(windows, "components", None)  # short ways need none
    assert windows.reachable(edges, spark.createDataFrame([(300,)], "node long")).count() == 1


def test_room_carry_over(spark):
    rng = random.Random(5)
    areas_n, areas_o = {i: rng.uniform(2, 30) for i in range(40)}, {100 + i: rng.uniform(2, 30) for i in range(40)}
    rows = [(n, areas_n[n], o, areas_o[o], round(rng.uniform(0, 1) * min(areas_n[n], areas_o[o]), 4)) for n in areas_n for o in rng.sample(sorted(areas_o), 4)]
    df = spark.createDataFrame(rows, "new_id int, new_area double, old_id int, old_area double, overlap double")
    used, want = set(), set()
    for n in sorted(areas_n, key=lambda n: (-areas_n[n], -n)):
        free = [r for r in rows if r[0] == n and r[2] not in used]
        if free:
            best = max(free, key=lambda r: (r[4], r[2]))
            if best[4] >= 0.5 * min(best[1], best[3]):
                used.add(best[2])
                want.add((n, best[2]))
    assert {(r.new_id, r.old_id) for r in joins.carry_over_rooms(df).collect()} == want


def test_tags_to_openings(spark):
    texts = spark.createDataFrame([("p", "K-01", 0.0, 0.0), ("p", "K1", 5.0, 5.0), ("p", "P2", 0.1, 0.0), ("p", "K3", 9.0, 9.0), ("p", "Z9", 5.0, 5.0)], "plan string, text string, x double, y double")
    openings = spark.createDataFrame([("p", "a", "door", 0.5, 0.0), ("p", "b", "door", 5.2, 5.0), ("p", "c", "window", 1.0, 0.0), ("p", "d", "door", 5.0, 6.0)], "plan string, opening_id string, type string, x double, y double")
    got = {(r.opening_id, r.tag) for r in joins.assign_tags(texts, openings, ["plan"]).collect()}
    assert got == {("b", "K1"), ("c", "P2")}


def test_wall_groups_grow_from_the_longest(spark):
    rng, rows, want = np.random.default_rng(11), [], {}
    for k in range(8):
        drift = np.cumsum(rng.uniform(0, 0.02, 40)) if k % 2 else rng.uniform(0, 0.3, 40)  # pieces that drift slowly do not chain
        group = [(k, k * 100 + i, float(rng.integers(1, 6)), float(rng.uniform(88, 92)), float(d), float(rng.choice([0.1, 0.11, 0.2]))) for i, d in enumerate(drift)]
        rows += group
        leaders = []
        for _, i, _, a, o, t in sorted(group, key=lambda r: (-r[2], r[1])):
            hit = next((x for x in leaders if abs(x[1] - a) < 0.8 and abs(x[2] - o) < 0.025 and abs(x[3] - t) < 0.025), None)
            if hit is None:
                leaders.append(hit := (i, a, o, t))
            want[i] = hit[0]
    rows += [(9, 900, 1.0, None, 0.0, 0.1), (9, 901, 1.0, None, 0.0, 0.1)]
    df = spark.createDataFrame(rows, "plan int, piece_id int, length double, angle_deg double, offset double, thickness double")
    got = {r.piece_id: r.line_id for r in windows.wall_groups(df, ["plan"]).collect()}
    assert got == {**want, 900: 900, 901: 901}
    assert windows.wall_groups(df.filter("plan < 0"), ["plan"]).count() == 0


def test_wall_groups_send_no_copied_rows_through_the_driver(spark, tmp_path):
    folder = str(tmp_path / "pieces")
    spark.range(400).selectExpr(
        "id % 20 AS plan", "id AS piece_id", "cast(id % 7 AS double) AS length", "cast(id % 4 AS double) * 0.5 AS angle_deg",
        "cast(id % 9 AS double) * 0.02 AS offset", "0.2D AS thickness",
    ).write.parquet(folder)
    got = windows.wall_groups(spark.read.parquet(folder), ["plan"])
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.filter("line_id IS NOT NULL").count() == 400


def test_tags_to_many_openings_on_few_places(spark):
    rng = random.Random(3)
    texts = [(p, f"{rng.choice('KP')}{rng.randrange(1, 9)}", float(rng.randrange(6)), float(rng.randrange(2))) for p in "ab" for _ in range(25)]
    openings = [(p, i, rng.choice(["door", "window", "french_door"]), float(rng.randrange(6)), float(rng.randrange(2))) for p in "ab" for i in range(300)]
    openings += [("a", 5, "door", 0.0, 0.0), ("a", 5, "door", 0.0, 0.0), ("a", 6, "window", 5.0, 1.0)]  # ids in several places
    best = {}
    for p, tag, tx, ty in texts:
        for q, i, kind, x, y in openings:
            d = math.hypot(x - tx, y - ty)
            if p == q and d <= 1.5 and kind != ("window" if tag[0] == "K" else "door"):
                best[p, i, tag] = min(d, best.get((p, i, tag), 9.0))
    want, used = set(), set()
    for d, p, i, tag in sorted((d, *k) for k, d in best.items()):
        if not {(p, i), (p, tag)} & used:
            used |= {(p, i), (p, tag)}
            want.add((p, i, tag, d))
    listed, match = [], joins.match_one_to_one
    joins.match_one_to_one = lambda pairs, *a: (listed.append(pairs.count()), match(pairs, *a))[1]
    try:
        got = joins.assign_tags(spark.createDataFrame(texts, "plan string, text string, x double, y double"), spark.createDataFrame(openings, "plan string, opening_id int, type string, x double, y double"), ["plan"])
        assert {(r.plan, r.opening_id, r.tag, r.distance) for r in got.collect()} == want
    finally:
        joins.match_one_to_one = match
    assert listed[0] < len(best) / 2


def test_worst_items_of_small_and_of_large_views(spark):
    from draftlake.operators import quality

    rng = random.Random(3)
    items = ["a", "b", "c", "d", None]
    base, cand = [], []
    for view in (1, 2, 3, None):
        n = 300 if view == 3 else 6
        base += [(view, rng.choice(items), rng.choice([None, -0.1, 0.0, 0.2, 0.5])) for _ in range(n)]
        cand += [(view, rng.choice([1, 2, 3, None]), rng.choice([*items, "e"]), rng.choice([None, 0.0, 0.1, 0.5])) for _ in range(2 * n)]
    cand += [(9, 1, "a", 0.3), (9, 1, "b", 0.0)]  # a view without base

    def best(rows):
        out = {}
        for *k, v in rows:
            old = out.get(tuple(k))
            out[tuple(k)] = old if v is None else v if old is None else max(old, v)
        return out

    want, own = {}, {k: v for k, v in best(base).items() if v is not None}
    for view, who in {r[:2] for r in cand}:
        got = {i: v or 0.0 for (a, b, i), v in best(cand).items() if (a, b) == (view, who)}
        mine = {i: v for (a, i), v in own.items() if a == view}
        want[view, who] = (
            max([0.0] + [v - got.get(i, 0.0) for i, v in mine.items()]),
            sum(v > 0 and got.get(i, 0.0) == 0 for i, v in mine.items()), sum(v > 0 and i not in mine for i, v in got.items()),
        )
    b = spark.createDataFrame(base, "view int, item string, x double")
    c = spark.createDataFrame(cand, "view int, who int, item string, x double")
    for most in (2_000, 100, 0):  # all views in a row, the large one by ranks, all by ranks
        out = quality.worst_item_delta(b, c, ["view", "who"], "item", "x", most=most)
        assert {(r.view, r.who): (pytest.approx(r.worst), r.new_missing, r.new_extra) for r in out.collect()} == want
    assert "Window" not in quality.worst_item_delta(b, c, ["view", "who"], "item", "x")._jdf.queryExecution().executedPlan().toString()


def test_walls_of_small_and_of_large_plans(spark):
    rng, rows = np.random.default_rng(5), []
    for k in range(6):
        n = 120 if k == 3 else 15
        rows += [(None if k == 5 else k, "s", k * 1000 + i, float(rng.integers(1, 6)), float(rng.uniform(88, 92)), float(rng.uniform(0, 0.2)), float(rng.choice([0.1, 0.11, 0.2])), "x") for i in range(n)]
    rows += [(0, "s", 900, 1.0, None, 0.0, 0.1, None), (0, "s", 901, None, 90.0, 0.0, 0.1, None)]
    df = spark.createDataFrame(rows, "plan int, side string, piece_id int, length double, angle_deg double, offset double, thickness double, note string")
    got = [windows.wall_groups(df, ["plan", "side"], most=most) for most in (500, 50, 0)]  # in a row, the large one in rounds, all in rounds
    assert all(g.columns == [*df.columns, "line_id"] for g in got)
    found = [sorted(map(str, g.collect())) for g in got]
    assert len(found[0]) == len(rows) and found[0] == found[1] == found[2]
    assert "Join" not in got[0]._jdf.queryExecution().optimizedPlan().toString()


def test_tags_are_dealt_from_near_to_far(spark, monkeypatch):
    rng = random.Random(9)
    texts = [(p, f"{rng.choice('KP')}{rng.randrange(1, 60)}", rng.uniform(0, 6), rng.uniform(0, 2)) for p in "ab" for _ in range(250)]
    texts += [("a", "K77", 40.0, 0.0), ("a", "K78", 40.0, 0.0), (None, "K1", 0.0, 0.0)]
    openings = [(p, i, rng.choice(["door", "window", "french_door"]), rng.uniform(0, 6), rng.uniform(0, 2)) for p in "ab" for i in range(150)]
    openings += [("a", 900, "door", 41.4, 0.0), ("a", 901, "door", 40.02, 0.0), ("a", 3, "door", 40.3, 0.0), (None, 1, "door", 0.0, 0.0)]  # one id in two places
    best = {}
    for p, tag, tx, ty in texts:
        for q, i, kind, x, y in openings:
            d = math.hypot(x - tx, y - ty)
            if p == q and p is not None and d <= 1.5 and kind != ("window" if tag[0] == "K" else "door"):
                best[p, i, tag] = min(d, best.get((p, i, tag), 9.0))
    want, used = set(), set()
    for d, p, i, tag in sorted((d, *k) for k, d in best.items()):
        if not {(p, i), (p, tag)} & used:
            used |= {(p, i), (p, tag)}
            want.add((p, i, tag, round(d, 9)))
    listed, match = [], joins.match_one_to_one
    monkeypatch.setattr(joins, "match_one_to_one", lambda pairs, *a: (listed.append(pairs.count()), match(pairs, *a))[1])
    got = joins.assign_tags(spark.createDataFrame(texts, "plan string, text string, x double, y double"), spark.createDataFrame(openings, "plan string, opening_id int, type string, x double, y double"), ["plan"])
    assert {(r.plan, r.opening_id, r.tag, round(r.distance, 9)) for r in got.collect()} == want
    assert sum(listed) < len(best) / 4 and len({round(math.log(max(d, 1e-3), 4)) for *_, d in want}) > 2
