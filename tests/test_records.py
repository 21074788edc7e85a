from __future__ import annotations

import datetime as dt

import pytest
from record_helpers import row, table
from pyspark.sql import functions as F

from hangarlog.operators import clean, counts, filters, quality
from hangarlog.plans.analysis import analyze
from hangarlog.plans import sizing
from hangarlog.sources import readers, sinks


def test_filters_drop_null_dates_only_when_dated(frame):
    df = frame([row(1), row(2, day=None), row(3, day="2020-02-01", code="12BBB")])
    assert filters.query_records(df).count() == 3
    assert table(filters.query_records(df, start="2020-01-15", end="2020-02-01"), "record_id") == [("r1",), ("r3",)]
    assert table(filters.query_records(df, code=" 12bbb "), "record_id") == [("r3",)]


def test_null_and_nan_labels(frame):
    df = frame([row(1, code=None), row(2, code="AB"), row(3, code="11AAA"), row(4, code="11-AA")])
    assert table(filters.valid_label(df), "record_id") == [("r3",)]
    assert tuple(filters.label_validity(df).first()) == (1, 3)


def test_blank_bases_do_not_count(frame):
    df = frame([row(1, base=None), row(2, base=""), row(3, base="  "), row(4, base=" SCOTT ")])
    assert table(counts.topn_counts(df, "base")) == [("SCOTT", 1)]


def test_prior_period(frame):
    df = frame([row(1, day="2024-06-01"), row(2, day="2023-12-31"), row(3, day="2022-12-31"), row(4, day="2022-12-30")])
    got = counts.prior_period(df, "2024-01-01", "2024-12-31").first()
    assert (got.total, got.prior_total, got.delta, got.delta_pct) == (1, 2, -1, -50.0)
    assert counts.prior_period(df, "2024-01-01", None).first().prior_total is None
    assert counts.prior_period(df, "2001-01-01", "2001-12-31").first().delta_pct == 0.0


def test_rolling_mean_needs_rows(spark):
    months = [(f"2020-{i:02d}", i) for i in range(1, 7)]
    df = spark.createDataFrame(months, "month string, n bigint")
    got = [r.rolling_mean for r in counts.rolling_mean(df).orderBy("month").collect()]
    assert got == [None, None, 2.0, 2.5, 3.0, 3.5]
    assert all(r.rolling_mean is None for r in counts.rolling_mean(df.limit(5)).collect())
    gap = spark.createDataFrame([("2020-01", 4), ("2020-04", 8)], "month string, n bigint")
    filled = counts.rolling_mean(gap, 3, 1, 1, fill_gaps=True).orderBy("month").collect()
    assert [(r.month, r.n) for r in filled] == [("2020-01", 4), ("2020-02", 0), ("2020-03", 0), ("2020-04", 8)]


def test_seasonality_lists_twelve_months(frame):
    got = counts.seasonality(frame([row(1), row(2, day=None)])).orderBy("month").collect()
    assert [r.n for r in got] == [1] + [0] * 11 and got[0].month_name == "Jan"


def test_preferred_column_falls_back(frame):
    df = frame([row(1, text="A B"), row(2, text="A B")]).withColumn("norm", F.lit(""))
    assert table(counts.topn_preferred(df, "norm", "discrepancy")) == [("A B", 2)]
    assert table(counts.topn_preferred(df.withColumn("norm", F.lit("X")), "norm", "discrepancy")) == [("X", 2)]


def test_merge_counts_nulls_as_equal(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, "b", "y")], "id int, v string, only_a string")
    b = spark.createDataFrame([(None, 1), ("c", 3)], "v string, id int")
    assert clean.dropped_columns(a, b) == ["only_a"]
    assert table(clean.merge_extracts(a, b), "id", "v") == [(1, None), (2, "b"), (3, "c")]
    assert tuple(clean.merge_report(a, b).first()) == (4, 3, 1)


def test_dedupe_keeps_the_first(spark):
    df = spark.createDataFrame([(3, "t", "x"), (1, "t", "x"), (2, "t", "y")], "id int, text string, label string")
    assert table(clean.dedupe(df, ["text", "label"], "id")) == [(1, "t", "x"), (2, "t", "y")]


def test_completeness_and_dates(frame):
    df = frame([row(1), row(2, base=None)])
    got = {r.column_name: (r.status, r.non_null, r.non_null_pct) for r in quality.completeness(df, ["base", "gone"]).collect()}
    assert got == {"base": ("OK", 1, 50.0), "gone": ("MISSING", None, None)}
    with pytest.raises(ValueError, match="job_id"):
        quality.require_columns(df.drop("job_id"))
    assert quality.date_quality(frame([row(1, day="1970-01-01")]), ["start_date"]).first().status == "ERROR"
    assert quality.date_quality(frame([row(1), row(2, day=None)]), ["start_date"]).first().status == "WARN"


def test_csv_to_clean_records(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(
        'Corrected WUC,Tail Number,Base,Start Date,Discrepancy,Labor,Extra\n'
        ' 11aaa ,57-0001,SCOTT,20240115,"leak,\nat ""pump"".",2.5,z\n12BBB,57-0002,,20240116,ok,bad,z\n')
    got = clean.clean_records(readers.load_records(spark, str(path), multiline=True)).orderBy("code").collect()
    assert [(r.code, r.start_date, r.labor_hours) for r in got] == [
        ("11AAA", dt.date(2024, 1, 15), 2.5), ("12BBB", dt.date(2024, 1, 16), None)]
    assert got[0].discrepancy_normalized == 'LEAK, AT "PUMP"'


def test_dictionary_and_json_scans(spark, tmp_path):
    (tmp_path / "named.csv").write_text("level,description,wuc_code\n1,Pump,11aaa\n")
    (tmp_path / "plain.csv").write_text("c,d\n11AAB,Valve\n")
    (tmp_path / "map.json").write_text('{\n "11": "AIRFRAME",\n "12": "FUSELAGE"\n}')
    assert table(readers.read_code_dictionary(spark, str(tmp_path / "named.csv"))) == [("11AAA", "Pump")]
    assert table(readers.read_code_dictionary(spark, str(tmp_path / "plain.csv"))) == [("11AAB", "Valve")]
    assert table(readers.read_json_map(spark, str(tmp_path / "map.json"))) == [("11", "AIRFRAME"), ("12", "FUSELAGE")]


def test_sinks_round_trip(spark, frame, tmp_path):
    df = frame([row(1), row(2, day="2021-03-01")])
    sinks.write_records(df, str(tmp_path / "records.parquet"))
    back = readers.read_table(spark, str(tmp_path / "records.parquet"))
    assert table(back, "record_id", "record_year") == [("r1", 2020), ("r2", 2021)]
    sinks.write_splits(df.withColumn("split", F.lit("train")), str(tmp_path / "splits"))
    assert (tmp_path / "splits" / "split=train").is_dir()
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert readers.read_csv(spark, str(tmp_path / "csv")).count() == 2
    sinks.write_json(df.select("code"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_analysis_bundle(frame):
    df = frame([row(1), row(2, asset="57-0002"), row(3, code="12BBB")])
    out = analyze(df, code="11AAA", start="2020-01-01", end="2020-12-31")
    assert out["headline"].first().total == 2 and "code_breakdown" not in out
    assert table(out["asset_leaderboard"]) == [("57-0001", 1), ("57-0002", 1)]
    assert out["totals"].first().all_records == 3
    sizing.release()


def test_join_small_without_broadcast(spark, monkeypatch):
    big = spark.range(100).withColumn("k", F.col("id") % 5)
    small = spark.createDataFrame([(i, f"v{i}") for i in range(4)], "k bigint, v string")
    with_hint = table(sizing.join_small(big, small, ["k"]))
    monkeypatch.setattr(sizing, "fits_broadcast", lambda df: False)
    assert table(sizing.join_small(big, small, ["k"])) == with_hint and len(with_hint) == 80


def test_nan_text_is_no_number_and_blank_keys_are_none(spark):
    raw = spark.createDataFrame([("11aaa", " ", "nan", "j1", ""), ("", "57-1", "2.5", " ", "A")],
                                "code string, asset_id string, labor_hours string, job_id string, discovered_code string")
    got = {tuple(r) for r in clean.clean_records(raw).select("code", "asset_id", "labor_hours", "job_id", "discovered_code").collect()}
    assert got == {("11AAA", None, None, "j1", None), (None, "57-1", 2.5, None, "A")}


def test_confident_disagreements_compare_normalised_labels(spark):
    df = spark.createDataFrame([(" 11aaa", "11AAA", 95.0), ("11AAA", None, 95.0), ("11AAA", "11AAB", 95.0), (None, "11AAB", 95.0), ("a", "b", 10.0)],
                               "truth string, pred_1 string, confidence_1 double")
    got = sorted((str(r.truth), str(r.pred_1)) for r in filters.confident_disagreements(df).collect())
    assert got == [("11AAA", "11AAB"), ("11AAA", "None")]


def test_dictionary_chain(spark, tmp_path):
    (tmp_path / "map.json").write_text('{"11aaa": "From JSON", "12BBB": "Only JSON"}')
    (tmp_path / "codes.csv").write_text("wuc_code,description\n11AAA,From CSV\n13CCC,Only CSV\n")
    both = readers.load_code_dictionary(spark, str(tmp_path / "map.json"), str(tmp_path / "codes.csv"))
    assert dict(table(both)) == {"11AAA": "From JSON", "12BBB": "Only JSON", "13CCC": "Only CSV"}
    assert dict(table(readers.load_code_dictionary(spark, str(tmp_path / "none.json"), str(tmp_path / "codes.csv")))) == {"11AAA": "From CSV", "13CCC": "Only CSV"}
    assert readers.load_code_dictionary(spark, str(tmp_path / "none.json")).count() == 0
