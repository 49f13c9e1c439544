import pytest
from pyspark.sql import functions as F

from draftlake.functions import text as tx
from draftlake.operators import mining


def evaluate(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


def test_fold(spark):
    given = ["ÖLÇEK: 1/50", "GENİŞLİK (cm)", "Çatı  Katı!", "I\u0307stanbul", "ISPARTA", "ﬁlm №5 m²", "Straße", "", "Ångström"]
    want = ["olcek 1 50", "genislik cm", "cati kati", "istanbul", "isparta", "film o5 m2", "stra e", "", "angstrom"]
    assert evaluate(spark, given, tx.fold) == want


def test_turkish_case(spark):
    assert evaluate(spark, ["IĞDIR İZMİR"], tx.tr_lower) == ["ığdır izmir"]
    assert evaluate(spark, ["ığdır izmir"], tx.tr_upper) == ["IĞDIR İZMİR"]


@pytest.mark.parametrize(
    "text,locale,want",
    [
        ("3,50", None, 3.5), ("1.234,5", None, 1234.5), ("1,234.5", None, 1234.5), ("350", None, 350.0), ("±0,00", None, 0.0),
        ("12.400", None, 12.4), ("12.400", "tr", 12400.0), ("1,250", None, 1.25), ("1.234.567", None, 1234567.0), ("1,234,567", None, 1234567.0),
        ("−2,5", None, -2.5), ("12\u202f345", None, 12345.0), (" 7 ", None, 7.0), ("abc", None, None), ("", None, None), ("1..2", None, None),
    ],
)
def test_numbers(spark, text, locale, want):
    assert evaluate(spark, [text], lambda c: tx.parse_number(c, locale)) == [want]


@pytest.mark.parametrize(
    "text,hint,metres,unit",
    [
        ("3,50", None, [3.5], "m"), ("350", None, [3.5, 0.35], "ambiguous"), ("3500", None, [3.5, 35.0], "ambiguous"), ("1.234", None, [1.234, 12.34], "ambiguous"),
        ("1.234,5", None, [1.2345, 12.345], "ambiguous"), ("120 cm", None, [1.2], "cm"), ("2400mm", None, [2.4], "mm"), ("2,4 M", None, [2.4], "m"),
        ("350", "cm", [3.5], "cm"), ("12'-6\"", None, [3.81], "ft-in"), ("6 1/2\"", None, [0.1651], "ft-in"), ("150,75", None, [150.75], "m"),
    ],
)
def test_dimensions(spark, text, hint, metres, unit):
    got = evaluate(spark, [text], lambda c: tx.parse_dimension(c, hint))[0]
    assert got["unit"] == unit
    assert got["metres"] == pytest.approx(metres)


def test_no_dimensions(spark):
    assert evaluate(spark, ["-3", "K1", "", "'", "m", "wall"], tx.parse_dimension) == [None] * 6


def test_scales(spark):
    given = ["ÖLÇEK 1/50", "1:100", "1/4\" = 1'-0\"", "11:50", "1:0", "1:99999", "1 / 20", "2024/1/50", "A1"]
    assert evaluate(spark, given, tx.parse_scale) == [50.0, 100.0, 48.0, None, None, None, 20.0, None, None]
    assert evaluate(spark, ["ÖLÇEK: 1/50", "Scale 1:5", "Not 1:5"], tx.is_scale_label) == [True, True, False]


def test_tags(spark):
    given = ["K-01", "k1", "P 12", "kp_003a", "Z01", "ABCD1", "K", "00", "ş5", "K-0"]
    assert evaluate(spark, given, tx.normalise_tag) == ["K1", "K1", "P12", "KP3A", "Z1", None, None, None, "Ş5", "K0"]
    assert evaluate(spark, ["K1", "PN3", "Z1", "KP1"], tx.tag_kind) == ["door", "window", None, "door"]
    assert evaluate(spark, ["PS", "KPIO", "K1", "XS", "K"], tx.repair_lookalikes) == ["P5", "KP10", "K1", None, None]


def test_redaction(spark):
    given = ["key ark_ab1_cd-9 end", "Bearer abc.def", "hf_0123456789abc", "ghp_0123456789ab", "hf_short"]
    want = ["key [REDACTED] end", "[REDACTED]", "[REDACTED]", "[REDACTED]", "hf_short"]
    assert evaluate(spark, given, tx.redact) == want


def test_file_names(spark):
    given = ["C:\\x\\plan?.pdf", "../.hidden", "", "şema (1).dwg", "a" * 200 + ".pdf"]
    got = evaluate(spark, given, tx.sanitize_filename)
    assert got[:4] == ["plan_.pdf", "hidden", "file", "şema (1).dwg"]
    assert len(got[4]) == 180 and got[4].endswith(".pdf")


def test_windows_cover(spark):
    for n in (0, 1, 1536, 1537, 5000):
        starts = spark.range(1).select(mining.window_starts(F.lit(n), 1536, 0.2)).first()[0]
        assert starts[0] == 0 and starts == sorted(set(starts))
        assert starts[-1] == max(0, n - 1536)
        assert all(b - a <= 1536 for a, b in zip(starts, starts[1:]))


def test_level_ranks(spark):
    given = ["Zemin Kat", "1. Kat Planı", "2nd Floor", "BODRUM", "2. Bodrum", "Asma Kat", "Çatı", "Birinci Kat", "Level 3", "Blok A", "5"]
    assert evaluate(spark, given, mining.level_rank) == [0.0, 1.0, 2.0, -1.0, -2.0, 0.5, 1000.0, 1.0, 3.0, None, None]


def test_stacking(spark):
    rows = [("p", "Çatı", 0), ("p", "Zemin", 1), ("p", "1. Kat", 2), ("p", "Ek", 3), ("q", "Roof", 0)]
    df = spark.createDataFrame(rows, "project_id string, level_name string, idx int")
    got = {(r.project_id, r.level_name): (r.position, r.elevation_m, r.assumed) for r in mining.stack_levels(df).collect()}
    assert got == {
        ("p", "Zemin"): (0, 0.0, True), ("p", "1. Kat"): (1, 3.0, True), ("p", "Çatı"): (2, 6.0, True), ("p", "Ek"): (3, 9.0, True),
        ("q", "Roof"): (0, 0.0, False),
    }


def test_keyword_phrases(spark):
    words = [("Kat", 0), ("Planı", 0), ("Salon", 0), ("KESİT", 40)]
    row = [("p", [{"text": t, "y0": float(y), "y1": float(y + 10)} for t, y in words])]
    df = spark.createDataFrame(row, "page string, words array<struct<text:string,y0:double,y1:double>>")
    r = mining.word_features(df).first()
    import math

    assert r.kw_floor_plan == pytest.approx(math.log1p(3))  # phrase, salon, and plan as a prefix
    assert r.kw_section == pytest.approx(math.log1p(1))
    assert r.log_words == pytest.approx(math.log1p(4))


def test_measurements_of_counted_texts_equal_those_of_all_rows(spark):
    from pyspark.sql import functions as F

    from draftlake.operators import mining

    texts = ["3 m", "3 m", "wall 12cm long, 40 mm", "1.250", "1.250", "1.250", "no number", None, None, "5'-6\""]
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    plain = mining.measurement_stats(mining.mine_measurements(rows, []))
    counted = rows.groupBy("text").agg(F.count(F.lit(1)).alias("times"))
    once = mining.measurement_stats(mining.mine_measurements(counted, ["times"]), times="times")
    assert once.dtypes == plain.dtypes
    assert sorted(once.collect()) == sorted(plain.collect())
    assert sum(r.n for r in once.collect()) == 8
    assert mining.measurement_stats(mining.mine_measurements(counted.limit(0), ["times"]), times="times").count() == 0


def test_plain_numbers_and_long_ones_agree(spark):
    # the direct path and the full one: a space inside sends the same digits through the full one
    plain = ["12", "+3", "-0", "007", "1,5", "1.5", "1.234", "-1.234", "+12,50", "123456789012345678901"]
    for locale in (None, "tr", "en"):
        direct = evaluate(spark, plain, lambda c: tx.parse_number(c, locale))
        full = evaluate(spark, [f" {t} " for t in plain], lambda c: tx.parse_number(c, locale))
        assert direct == full and None not in direct
    assert evaluate(spark, ["", "-", "abc", "1,", ",1", "1\n", "٣", None], tx.parse_number) == [None, None, None, None, None, 1.0, None, None]
