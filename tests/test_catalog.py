from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
TABLES = ("nation supplier part lineitem events documents embeddings labels conversations").split()
CHECKED = [
    "a2_issues_by_month", "a16_labor_burden", "a19_base_concentration", "a20_trend", "a31_confusion_pairs", "a36_macro_f1",
    "j4_geolocate", "u8_stratified_split", "w1_rolling_mean_per_code", "p11_record_query",
]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_its_sql(spark, con, name):
    df = contract.queries()[name](spark, FOLDER)
    cursor = con.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    mine = sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    theirs = sorted(cursor.fetchall(), key=str)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        assert all(x == y or x == pytest.approx(y, rel=1e-9) for x, y in zip(a, b))


def test_entry_and_registry(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
