import random

import pytest
from pyspark.sql import functions as F

from draftlake.operators import layout as lay
from draftlake.operators import joins

SCHEMA = "page_id string, word_no bigint, text string, x0 double, y0 double, x1 double, y1 double, angle_deg double"


def words(spark, rows, page="p"):
    """rows: (text, x0, y0) with 10 px per letter and 12 px height."""
    data = [(page, i, t, float(x), float(y), float(x + 10 * len(t)), float(y + 12), 0.0) for i, (t, x, y) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def test_lines_and_bands(spark):
    w = words(spark, [("KAT", 0, 100), ("PLANI", 38, 103), ("uzak", 200, 101), ("alt", 0, 130)])
    got = sorted((r.text, r.n_words) for r in lay.lines_from_words(w, ["page_id"]).collect())
    assert got == [("KAT PLANI", 2), ("alt", 1), ("uzak", 1)]


def test_rotated_words_stay_out(spark):
    w = words(spark, [("a", 0, 0)]).unionAll(words(spark, [("b", 50, 0)]).selectExpr("page_id", "word_no + 10", "text", "x0", "y0", "x1", "y1", "90D"))
    assert [r.text for r in lay.lines_from_words(w, ["page_id"]).collect()] == ["a"]


def test_title_block(spark):
    w = words(spark, [("PROJE", 600, 800), ("Villa", 600, 816), ("ÖLÇEK:", 600, 840), ("1/50", 670, 840), ("TARİH", 600, 880), ("2024", 665, 880), ("salon", 10, 10)])
    lines = lay.lines_from_words(w, ["page_id"]).selectExpr("*", "1000D AS w", "1000D AS h")
    r = lay.label_values(lines, ["page_id"], page_size=("w", "h")).first()
    assert r.fields["project"] == "Villa"
    assert "date" not in r.fields or r.fields["date"] == "2024"
    # label and value on one line with a word gap: the value is the rest only if it is a line of its own
    w2 = words(spark, [("PROJE", 600, 800), ("Villa", 600, 816), ("ÖLÇEK:", 600, 840), ("1/50", 690, 840)])
    r2 = lay.label_values(lay.lines_from_words(w2, ["page_id"]), ["page_id"]).first()
    assert r2.fields == {"project": "Villa", "scale": "1/50"} and r2.scale == 50.0
    assert r2.bbox == [600.0, 800.0, 730.0, 852.0]


def test_table_and_schedule(spark):
    rows = [
        ("KAPI", 0, 0), ("POZ", 0, 40), ("GENİŞLİK", 100, 40), ("(cm)", 190, 40), ("ADET", 300, 40),
        ("K-01", 0, 60), ("90", 100, 60), ("2", 300, 60), ("K2", 0, 80), ("0,80", 97, 80), ("-", 300, 80), ("not", 0, 300),
    ]
    cells = lay.table_from_words(words(spark, rows), ["page_id"])
    schedules, out = lay.normalise_schedules(cells, ["page_id"])
    assert schedules.first().kind == "door_window"
    got = {r.row_index: (r.tag, r.numeric) for r in out.collect()}
    assert got[1][0] == "K1" and got[1][1] == pytest.approx({"width": 0.9, "qty": 2.0})
    assert got[2][0] == "K2" and got[2][1] == pytest.approx({"width": 0.008})
    assert set(got) == {1, 2}


def test_schedule_units_without_header_unit(spark):
    grid = [(0, ["Mahal No", "Zemin", "Yükseklik"]), (1, ["101", "Parke", "280"]), (2, ["", "", ""]), (3, ["102", "", "2,6"])]
    cells = spark.createDataFrame([("s", i, j, v) for i, r in grid for j, v in enumerate(r)], "sheet string, row_index int, col_index int, value string")
    _, rows = lay.normalise_schedules(cells, ["sheet"])
    got = {r.row_index: r for r in rows.collect()}
    assert set(got) == {1, 3}
    assert got[1].numeric["height"] == pytest.approx(2.8) and got[3].numeric["height"] == pytest.approx(2.6)
    assert got[1].fields["floor"] == "Parke" and got[1].tag == "101"


def test_bubble_votes(spark):
    data = [
        ("p", 1, 0, "K1"), ("p", 1, 0, "K-01"), ("p", 1, 0, ""), ("p", 2, 0, "P5"), ("p", 2, 0, "P6"), ("p", 2, 1, "P6"), ("p", 2, 1, "P6"),
        ("p", 3, 0, "PS"), ("p", 3, 0, "PS"), ("p", 4, 0, "K9"), ("p", 4, 0, "K9"),
    ]
    readings = spark.createDataFrame(data, "page_id string, bubble_id int, tier int, reading string")
    text = spark.createDataFrame([("p", "K9")], "page_id string, tag string")
    got = {r.bubble_id: (r.tag, r.kind) for r in joins.read_bubble_tags(readings, text).collect()}
    assert got == {1: ("K1", "door"), 2: ("P6", "window"), 3: ("P5", "window")}


def test_equal_bubble_readings_count_as_often_as_they_stand(spark):
    data = [("p", 1, 0, "K1"), ("p", 1, 0, "K1"), ("p", 2, 0, "K1"), ("p", 3, 0, "PS"), ("p", 3, 0, "P5"), ("p", 4, 0, None), ("p", 4, 0, None)]
    readings = spark.createDataFrame(data, "page_id string, bubble_id int, tier int, reading string")
    text = spark.createDataFrame([], "page_id string, tag string")
    got = {(r.bubble_id, r.tier, r.tag) for r in joins.read_bubble_tags(readings, text).collect()}
    assert got == {(1, 0, "K1"), (3, 1000, "P5")}
    counted = spark.createDataFrame([("a", 0, "x", 2), ("b", 0, "x", 1)], "id string, tier int, tag string, n long")
    assert [r.id for r in joins.unanimous_vote(counted, ["id"], "tier", "tag", times="n").collect()] == ["a"]


def test_strips_are_found_on_centres_and_words_packed_once(spark):
    # 300 words on one centre, a line that overlaps the next one, and a line that stands alone
    rows = [("w", 20 * i, 0) for i in range(300)] + [("c", 0, 100), ("a", 30, 104), ("b", 60, 108), ("z", 0, 200)]
    w = words(spark, rows)
    assert sorted((r.cy, r.n) for r in lay.strips(w, ["page_id"]).collect()) == [(6, 1), (106, 3), (110, 3), (114, 3), (206, 1)]
    got = lay.bands(w, ["page_id"])
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()  # words take part in no ordered scan
    texts = [[x.text for x in r.words] for r in got.orderBy("strip", "band").collect()]
    assert texts == [["w"] * 300, ["c", "a"], ["b"], ["z"]]


def test_words_are_placed_in_their_row(spark):
    from draftlake.catalogue.text import placed_words

    line = " ".join("x" * (i % 7) for i in range(1000))
    d = spark.createDataFrame([(1, "a  bc\n\n d"), (2, line), (3, ""), (4, None)], "doc_id long, text string")
    got = placed_words(d)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    rows = {(r.doc_id, r.word_no): (r.text, r.x0, r.x1, r.y0) for r in got.collect()}
    assert {k: v for k, v in rows.items() if k[0] == 1} == {
        (1, 0): ("a", 0.0, 10.0, 0.0), (1, 2): ("bc", 30.0, 50.0, 0.0), (1, 200001): ("d", 10.0, 20.0, 40.0)
    }
    want, x = {}, 0
    for i, t in enumerate(line.split(" ")):
        if t:
            want[(2, i)] = (t, 10.0 * (i + x), 10.0 * (i + x + len(t)), 0.0)
        x += len(t)
    assert {k: v for k, v in rows.items() if k[0] > 1} == want


def test_table_is_found_on_one_row_per_band(spark, monkeypatch):
    written = []
    monkeypatch.setattr(lay, "cut_lineage", lambda df: written.append(df.columns) or df)
    rows = [("the", 0, 0), ("of", 200, 0), ("x", 0, 40), ("y", 30, 43), ("z", 200, 40), ("w", 220, 80), ("far", 0, 400)]
    got = lay.table_from_words(words(spark, rows), ["page_id"], {"a": ["the"], "b": ["of"]}).collect()
    assert sorted((r.row_index, r.col_index, r.value) for r in got) == [
        (0, 0, "the"), (0, 1, "of"), (1, 0, "x y"), (1, 1, "z"), (2, 1, "w")
    ]
    assert written and not any({"words", "cells"} & set(c) for c in written)  # no words in checkpoints


def test_cells_of_schedules_meet_their_header_once(spark):
    # a column name twice keeps its right-most cell; a table without a key of its own; a second header row is a row
    grid = [(2, ["Poz", "En", "En", "Adet", "?"]), (3, ["K-01", "80", "0,9", "2", "x"]), (4, ["Poz", "En", "", "", ""]), (40, ["", "", "-", "±1,5", "y"])]
    rows = [(s, i, j, v) for s in ("a", None) for i, r in grid for j, v in enumerate(r)] + [("b", 0, 0, "Poz"), ("b", 1, 0, "K1")]
    cells = spark.createDataFrame(rows, "sheet string, row_index int, col_index int, value string")
    schedules, out = lay.normalise_schedules(cells, ["sheet"])
    assert [(r.sheet, r.kind) for r in schedules.orderBy("sheet").collect()] == [(None, "door_window"), ("a", "door_window")]
    got = {(r.sheet, r.row_index): (r.kind, r.tag, r.fields, r.numeric) for r in out.collect()}
    for s in ("a", None):
        assert got[s, 3] == ("door_window", "K1", {"tag": "K-01"}, {"qty": 2.0, "width": 0.9})
        assert got[s, 4] == ("door_window", "Poz", {"tag": "Poz"}, {})
        assert got[s, 40] == ("door_window", None, {}, {"qty": 1.5})
    assert len(got) == 6
    # titles meet their names, cells meet their header: no third join, in whatever form it is run
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 2


def both_forms(spark, flat):
    """A words table and the same packed: each page in one row, and each dealt over two rows."""
    word = F.struct("word_no", "text", "x0", "y0", "x1", "y1", "angle_deg")
    one = flat.groupBy("page_id").agg(F.collect_list(word).alias("words"))
    two = flat.groupBy("page_id", F.col("word_no") % 2).agg(F.collect_list(word).alias("words")).select("page_id", "words")
    empty = spark.createDataFrame([("void", [])], one.schema)
    return [flat, one.unionByName(empty), two.unionByName(empty)]


def odd_words(spark):
    rng = random.Random(5)
    names = ["the", "of", "and", "KAT", "PROJE", "x", "uzun bir", "Ölçek", "1/50"]
    rows = []
    for page in ("a", "b", None):
        for no in range(160):
            text, x, y, h = rng.choice(names), rng.randrange(0, 900, 7), rng.choice([0, 3, 20, 26, 31, 60, 64, 300, 420]) + rng.choice([0.0, 0.5]), rng.choice([12.0, 12.0, 9.0])
            rows.append((page, no, text, float(x), y, float(x + 10 * len(text)), y + h, rng.choice([0.0, 0.0, 0.0, 90.0])))
    rows += [("flat", i, "the" if i < 2 else "of", 40.0 * i, 5.0, 40.0 * i + 30, 5.0, 0.0) for i in range(4)]  # words without height
    return spark.createDataFrame(rows, SCHEMA)


def test_packed_pages_give_the_same_lines_values_and_cells(spark):
    labels = {"the": ["the"], "of": ["of"], "project": ["proje"], "scale": ["olcek"]}
    lines, values, cells = [], [], []
    for form in both_forms(spark, odd_words(spark)):
        rows = lay.lines_from_words(form, ["page_id"])
        lines.append(sorted(map(str, rows.collect())))
        packed = "words" in form.columns
        sized = lay.lines_from_words(form, ["page_id"], packed=packed).selectExpr("*", "900D AS w", "400D AS h")
        values.append([sorted(map(str, lay.label_values(sized, ["page_id"], labels, page_size=size).collect())) for size in (None, ("w", "h"))])
        cells.append(sorted(map(str, lay.table_from_words(form, ["page_id"], {"a": ["the"], "b": ["of"], "c": ["and"]}).collect())))
    assert len(lines[0]) > 50 and len(values[0][0]) >= 2 and len(cells[0]) > 20
    assert lines[0] == lines[1] == lines[2] and values[0] == values[1] == values[2] and cells[0] == cells[1] == cells[2]


def test_whole_pages_are_worked_through_in_their_row(spark, monkeypatch):
    monkeypatch.setattr(lay, "cut_lineage", None)  # nothing is written either
    page = both_forms(spark, words(spark, [("the", 0, 0), ("of", 200, 0), ("x", 0, 40), ("is", 0, 80)]))[1]
    lines = lay.lines_from_words(page, ["page_id"], packed=True)
    source = page.localCheckpoint()
    for make in (
        lambda p: lay.lines_from_words(p, ["page_id"]), lambda p: lay.table_from_words(p, ["page_id"], {"a": ["the"], "b": ["of"]}),
        lambda p: lay.label_values(lay.lines_from_words(p, ["page_id"], packed=True), ["page_id"], {"a": ["the"], "b": ["is"]}),
    ):
        plan = make(source)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan
    assert lines.columns == ["page_id", "lines"]


def test_words_meet_their_strips_without_a_second_shuffle(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(kept, ("-1", "false")):
        spark.conf.set(k, v)
    try:
        w = words(spark, [("a", 0, 0), ("b", 0, 40)])
        spots = spark.createDataFrame([("p", 6.0, 1, 1), ("p", 46.0, 2, 1)], "page_id string, cy double, strip long, n int")
        plan = lay.bands(w, ["page_id"], spots)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning") == 2  # the words and their strips


def test_packed_rows_of_schedules_give_the_same_rows(spark):
    rng = random.Random(8)
    heads = {"a": ["Poz", "En (mm)", "Boy", "Adet", "?"], "b": ["Poz", "En", "En", "Malzeme"], "c": ["Mahal No", "Zemin"], "d": ["x"], None: ["Poz", "Adet", "Parapet (cm)"]}
    values = ["", " ", None, "K-01", "p 7", "80", "0,9", "±1,5", "-", "1.234,5", "oda", "  90 "]
    rows = []
    for sheet, head in heads.items():
        rows += [(sheet, 1, j, v) for j, v in enumerate(head)]
        rows += [(sheet, i, j, rng.choice(values)) for i in range(2, 40) for j in range(len(head) + 1) if rng.random() < 0.85]
    rows += [("c", 50, None, "101"), ("c", 50, 1, "Parke")]  # a cell without a place
    flat = spark.createDataFrame(rows, "sheet string, row_index int, col_index int, value string")
    cell = F.collect_list(F.struct("col_index", "value")).alias("cells")
    one = flat.groupBy("sheet", "row_index").agg(cell)
    two = flat.groupBy("sheet", "row_index", F.col("col_index") % 2).agg(cell).select("sheet", "row_index", "cells")
    got = []
    for form in (flat, one, two):
        schedules, out = lay.normalise_schedules(form, ["sheet"])
        order = [c for c in sorted(out.columns)]
        got.append((
            sorted(map(str, schedules.select("sheet", "kind", "recognised").collect())),
            sorted(str([sorted(r[c].items()) if isinstance(r[c], dict) else r[c] for c in order]) for r in out.collect()),
        ))
    assert len(got[0][0]) == 4 and len(got[0][1]) > 100
    assert got[0] == got[1] == got[2]
