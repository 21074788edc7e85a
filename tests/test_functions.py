from __future__ import annotations

import calendar

import datetime as dt
import math

from pyspark.sql import functions as F

from hangarlog.functions import arrays, dates, labels, text
from hangarlog.reference_data import GAZETTEER


def values(spark, rows, schema, expression):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


def test_title_case_agrees_with_python(spark):
    words = ["SCOTT", "Scott", "SCOTT AFB IL (ANG)", "O'HARE", "a1b2", ""]
    assert values(spark, [(w,) for w in words], "x string", text.title_case("x")) == [w.title() for w in words]


def test_strip_drops_all_whitespace(spark):
    words = [" a ", "\ta\n", " a b ", "\r\n", "x"]
    assert values(spark, [(w,) for w in words], "x string", text.strip("x")) == [w.strip() for w in words]


def test_phrase_and_writeup(spark):
    rows = [("Leak (/) at  #3 pump.",), (None,), ("ok.. ",)]
    assert values(spark, rows, "x string", text.normalize_phrase("x")) == ["LEAK AT 3 PUMP", None, "OK"]
    assert values(spark, rows, "x string", text.normalize_writeup("x")) == ["LEAK (/) AT #3 PUMP", "", "OK"]


def test_keywords_skip_short_stop_and_numeric(spark):
    rows = [("THE PUMP OPS 12 1234 A1 LEAK PUMP",)]
    assert values(spark, rows, "x string", text.keyword_tokens("x")) == [["pump", "leak", "pump"]]


def test_build_text(spark):
    rows = [("a", None, "  ", 12, "nan")]
    schema = "a string, b string, c string, d int, e string"
    columns = ["a", "b", "c", "d", "e"]
    assert values(spark, rows, schema, text.build_text(columns)) == ["a [SEP] 12 [SEP] nan"]
    assert values(spark, rows, schema, text.build_text(columns, upper=True, drop_nan=True)) == ["A [SEP] 12"]


def test_each_date_encoding(spark):
    day = dt.date(2024, 1, 15)
    for cell in ("20240115", "45306", "2024-01-15"):
        df = spark.createDataFrame([(cell,)] * 19 + [("garbage",)], "d string")
        got = [r.d for r in dates.parse_mixed_dates(df, ["d"]).collect()]
        assert got == [day] * 19 + [None], cell


def test_number_parse_never_raises(spark):
    assert values(spark, [("1.5",), ("abc",), (None,)], "x string", dates.to_number("x")) == [1.5, None, None]


def test_half_even_rounding_and_percent(spark):
    assert values(spark, [(0.125,), (2.5,), (3.5,)], "x double", F.bround("x", 0)) == [0.0, 2.0, 4.0]
    assert values(spark, [(0.125,)], "x double", labels.fixed("x", 2)) == ["0.12"]
    assert values(spark, [(1, 8), (1, 0)], "a int, b int", labels.percent_text("a", "b")) == ["12%", "0%"]


def test_verdicts(spark):
    assert values(spark, [(1.25,), (0.8,), (1.0,), (None,)], "x double", labels.burden_verdict("x")) == [
        "expensive", "cheap", "typical", None]
    assert values(spark, [(15.0,), (15.1,), (-15.1,)], "x double", labels.trend_direction("x")) == ["steady", "rising", "falling"]
    bands = [("Low", 40.0), ("Mid-Low", 40.0), ("Mid-High", 40.0), ("High", 40.0), ("High", 31.9)]
    assert values(spark, bands, "b string, s double", labels.lifecycle_verdict("b", "s")) == [
        "low-time", "low-time", "high-time", "high-time", "none"]
    assert values(spark, [(70.0,), (69.9,), (30.0,), (29.9,)], "c double", labels.confidence_band("c")) == [
        "high (>=70%)", "mid (30-70%)", "mid (30-70%)", "low (<30%)"]


def test_top_positions_with_and_without_ties(spark):
    rows = [([0.1, 0.7, 0.2],), ([0.4, 0.2, 0.4],), ([0.3],)]
    got = values(spark, rows, "p array<double>", arrays.top_positions("p", 2))
    assert [[tuple(e) for e in r] for r in got] == [[(1, 0.7), (2, 0.2)], [(0, 0.4), (2, 0.4)], [(0, 0.3)]]
    assert [r[0][0] for r in values(spark, rows, "p array<double>", arrays.top_positions("p", 1))] == [1, 0, 0]


def test_softmax(spark):
    got = values(spark, [([1.0, 2.0, 800.0],), ([0.0, math.log(3.0)],)], "p array<double>", arrays.softmax("p"))
    assert got[0][2] == 1.0 and abs(got[1][1] - 0.75) < 1e-12


def test_labels_and_months(spark):
    rows = [("11AAA", "Pump (left)"), ("11AAB", None)]
    label = labels.code_label("c", "d")
    assert values(spark, rows, "c string, d string", label) == ["11AAA (Pump (left))", "11AAB"]
    assert values(spark, rows, "c string, d string", labels.code_of_label(label)) == ["11AAA", "11AAB"]
    names = values(spark, [(i,) for i in range(1, 13)], "m int", dates.month_name("m"))
    assert [n.lower() for n in names] == [m[:3] for m in [m.lower() for m in calendar.month_name[1:]]]
    assert len({k for k, *_ in GAZETTEER}) == len(GAZETTEER) == 57
