import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import calc as C
from tallyspark.functions import text as T


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()) or [F.lit(1).alias("_")])
    return row.select(column.alias("out")).first().out


def points(*pairs):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pairs))


def test_unit_weight(spark):
    assert one(spark, C.unit_weight(F.lit(15.0))) == pytest.approx(1.389, abs=5e-4)
    assert one(spark, C.bar_weight(F.lit(8.0), F.lit(2000.0), 3)) == pytest.approx(64 / 162 * 6)


@pytest.mark.parametrize("dia, want", [(7, 6), (9, 8), (14, 12), (15, 16), (18, 16), (22, 20), (34, 32), (35, None), (1, None)])
def test_snap(spark, dia, want):
    assert one(spark, C.snap_diameter(F.lit(dia))) == want


def test_bends(spark):
    tie = F.array(*map(F.lit, (0.08, 0.1, 0.2, 0.1, 0.2, 0.08)))
    assert one(spark, C.bend_deduction(tie, F.lit(0.008), closed=True)) == pytest.approx(0.632)
    assert one(spark, C.bend_deduction(F.array(*map(F.lit, (0.4, 0.1, 0.4))), F.lit(0.008))) == pytest.approx(0.868)
    assert one(spark, C.count_by_pitch(F.lit(2870.0), F.lit(100.0))) == 29


def test_lengths(spark):
    bent = points((0, 0), (3, 0), (3, 4))
    assert one(spark, C.polyline_length(bent)) == 7 and one(spark, C.chord_length(bent)) == 5
    assert one(spark, C.polyline_length(points((1, 1)))) == 0
    assert one(spark, C.shoelace_area(bent)) == 6
    assert one(spark, C.net_volume(F.lit(1000.0), F.lit(2000.0), F.lit(100.0), F.array(F.lit(-5e5)))) == pytest.approx(0.15)


def test_angles(spark):
    assert one(spark, C.canonical_angle(F.lit(0.0), F.lit(0.0), F.lit(-1.0), F.lit(0.0))) == pytest.approx(0)
    assert one(spark, C.canonical_angle(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(-2.0))) == pytest.approx(math.pi / 2)
    assert [one(spark, C.orientation(F.lit(0.0), F.lit(0.0), F.lit(x), F.lit(y), n)) for x, y, n in ((9.0, 0.1, 2), (0.1, 9.0, 2), (5.0, 5.0, 2), (9.0, 0.0, 3))] == ["h", "v", "diag", "shape"]
    assert one(spark, C.arc_sweep(F.lit(350.0), F.lit(20.0))) == 30 and one(spark, C.arc_sweep(F.lit(10.0), F.lit(10.0))) == 360
    arc = one(spark, C.arc_points(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(0.0), F.lit(90.0), 4))
    assert len(arc) == 5 and arc[-1].y == pytest.approx(2)


def test_collinear(spark):
    path = points((0, 0), (1, 0), (2, 0.001), (3, 0), (3, 2), (3, 3), (3, 1))
    kept = [(p.x, p.y) for p in one(spark, C.drop_collinear(path))]
    assert kept == [(0, 0), (3, 0), (3, 3), (3, 1)]  # turning back is a bend


def test_tolerance(spark):
    assert one(spark, C.near(F.lit(100.0), F.lit(104.0), 4.0)) is True
    assert one(spark, C.near(F.lit(100.0), F.lit(None).cast("double"), 4.0)) is False
    assert one(spark, C.percent_delta(F.lit(5.0), F.lit(0.0))) is None
    assert one(spark, C.ladder_at_least(F.lit(11.0), (5.0, 10.0, 20.0))) == 20 and one(spark, C.ladder_at_least(F.lit(99.0), (5.0, 20.0))) == 20


def test_dates(spark):
    at = F.lit(datetime(2024, 1, 24, 19, 0)).cast("timestamp_ntz")
    assert one(spark, C.business_day(at)) == date(2024, 1, 25)
    assert one(spark, C.to_instant(F.lit(date(2024, 1, 25)), F.lit("00:30:00"))) == datetime(2024, 1, 24, 19, 0)
    today = F.lit(date(2024, 1, 24))
    spans = {n: tuple(one(spark, d) for d in C.date_preset(n, today)) for n in ("this-week", "last-week", "this-month", "other")}
    assert spans == {
        "this-week": (date(2024, 1, 22), date(2024, 1, 24)), "last-week": (date(2024, 1, 15), date(2024, 1, 21)),
        "this-month": (date(2024, 1, 1), date(2024, 1, 24)), "other": (date(2023, 12, 26), date(2024, 1, 24)),
    }


@pytest.mark.parametrize("text, number, integer", [("1,234.5 mm", 1234.5, 1234), ("a -7", -7.0, -7), ("none", None, None), ("", None, None)])
def test_numbers(spark, text, number, integer):
    assert one(spark, T.parse_number(F.lit(text))) == number and one(spark, T.parse_integer(F.lit(text))) == integer


CALLS = [
    ("-(26) -(T8)", ("count", 8, 26, None, None, "")),
    ("2 -t12 Crack Bar", ("count", 12, 2, None, None, "Crack Bar")),
    ("-(61) -(T8 U Bar)", ("count", 8, 61, None, None, "U Bar")),
    ("T12 @ 150mm", ("pitch", 12, None, 150, None, "")),
    ("T10 TIES @ 150mm", ("pitch", 10, None, 150, None, "TIES")),
    ("T10 UBAR @ 200 mm B1", ("pitch", 10, None, 200, None, "UBAR B1")),
    ("T12 @ 150", ("unparsed", None, None, None, None, None)),
    (" T16 ", ("dia", 16, 1, None, None, "")),
    ("t12", ("dia", 12, 1, None, None, "")),
    ("A1", ("mark", None, None, None, "A1", None)),
    ("AB1", ("mark", None, None, None, "AB1", None)),
    ("see 2-T8", ("unparsed", None, None, None, None, None)),
]


@pytest.mark.parametrize("text, want", CALLS)
def test_callouts(spark, text, want):
    assert tuple(one(spark, T.callout(F.lit(text)))) == want


def test_bar_pitches(spark):
    texts = ("x T8 Ties @ 75 mm", "T10UBAR@200mm", "T10 hook @ 5 mm", "T6@100mm", "T6 Hoop @ 100 mm", None)
    assert [one(spark, T.bar_pitch(F.lit(t))) for t in texts] == [("tie", 8, 75), ("u-bar", 10, 200), ("hook", 10, 5), ("plain", 6, 100), None, None]
    assert one(spark, T.crack_bars(F.lit("2 - T16 long Crack Bar"))) == (2, 16) and one(spark, T.crack_bars(F.lit("2 - T16 8 crack bar"))) is None


def test_categories(spark):
    texts = ("T10 UBAR @ 200", "U-Bar T8", "PARTIES", "1.2", "a n12", "2 - T8", "x")
    assert [one(spark, T.category(F.lit(t))) for t in texts] == ["pitch", "u-bar", "tie", "number", "Nn", "count", "other"]


def test_labels(spark):
    assert [one(spark, T.format_duration(F.lit(ms))) for ms in (-5000, 59_999, 3_600_000, 5_430_000)] == ["0m", "0m", "1h 0m", "1h 30m"]
    assert [one(spark, T.format_clock(F.lit(c))) for c in ("00:05:00", "12:00:00", "23:59:59", "")] == ["12:05 AM", "12:00 PM", "11:59 PM", "—"]
    assert [one(spark, T.length_literal_mm(F.lit(t))) for t in ("8 ft", "2.5m", "30cm", "12", "6'", "x")] == [pytest.approx(2438.4), 2500, 300, 12, pytest.approx(1828.8), None]
    assert one(spark, T.sanitize_id(F.lit(" E-0/1é "))) == "E-01"
    assert one(spark, T.diameters(F.lit("T8 and T12, T8; XT9"))) == [8, 12]
    assert one(spark, T.data_url_bytes(F.lit("data:image/png;base64,aGk="))) == bytearray(b"hi")
    assert one(spark, T.data_url_bytes(F.lit("aGk="))) is None
    assert one(spark, T.ragged_row(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(2))) == ["a", "b"]
    assert one(spark, T.locations(F.array(F.lit("wall"), F.lit("WALL A"), F.lit("MOULD"), F.lit("x"), F.lit("- 30 mm")))) == "wall MOULD - 30 mm"
    assert one(spark, T.revision(F.lit("PW-01(R2)"))) == 2 and one(spark, T.base_name(F.lit("PW-01 (S)"))) == "PW-01"
    assert one(spark, T.block_kind(F.lit("Spread Anchor M16"))) == "anchor" and one(spark, T.block_kind(F.lit("Lifting Anchor"))) is None
    assert one(spark, T.block_kind(F.lit("Lifting Anchor"), T.CAST_IN_KINDS)) == "anchor" and one(spark, T.block_kind(F.lit("x"), T.CAST_IN_KINDS)) == "other"
    assert one(spark, T.sheet_name(F.lit("a/b:[c]" * 9))) == ("abc" * 9)[:27]
