"""Physical plans: what must, and must not, be in them."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from hangarlog.operators import counts, filters, geo
from hangarlog.sources import readers, star

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["a16_labor_burden", "a20_trend", "a31_confusion_pairs", "j4_geolocate", "j8_cooccurring",
                                  "a11_top_keywords", "q1_extract_filters", "a13_hour_bands"])
def test_no_python_and_no_cross_join(spark, name):
    text = plan(contract.queries()[name](spark, FOLDER))
    for word in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text, word


def test_top_n_is_pruned_early(spark):
    recs = star.records(spark, FOLDER)
    assert "WindowGroupLimit" in plan(counts.topn_counts(recs, "asset_id", 3, by="code"))
    assert "TakeOrderedAndProject" in plan(counts.topn_counts(recs, "asset_id", 3))


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    star.records(spark, FOLDER).write.parquet(str(tmp_path / "r.parquet"))
    recs = readers.read_parquet(spark, str(tmp_path / "r.parquet"))
    text = plan(counts.issues_by_month(filters.query_records(recs, code="04S15", start="1997-01-01")))
    assert "EqualTo(code,04S15)" in text and "GreaterThanOrEqual(start_date,1997-01-01)" in text
    assert "ReadSchema: struct<code:string,start_date:date>" in text


def test_site_lookup_stays_above_the_counts(spark):
    text = plan(geo.geo_rollup(star.records(spark, FOLDER), star.gazetteer(spark, FOLDER)))
    assert "contains" not in text.split("partial_count(1)")[1].lower()
