"""Merged sketches against exact counts and ranks."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hangarlog.operators import sketches

SCHEMA = "code string, month int, asset string, hours double"


def cells_of(df):
    return sketches.sketch_cells(df, {"code": F.col("code"), "month": F.col("month")}, {"asset": F.col("asset")}, {"hours": F.col("hours")})


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    return [(rng.choice("AAAB"), rng.randint(1, 6), f"s{int(rng.expovariate(0.0003))}", rng.lognormvariate(3, 2)) for _ in range(40_000)]


def test_merged_cells_keep_their_bounds(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "cells")
    for batch in ("one", "two", "two"):  # the second is repeated
        sketches.store_cells(cells_of(df.where((F.col("month") <= 3) == (batch == "one"))), path, batch)
    kept = sketches.load_cells(spark, path)
    for by in ((), ("code",), ("code", "month")):
        got = sketches.read_off(sketches.merge_cells(kept, by)).collect()
        groups = {tuple({"code": r[0], "month": r[1]}[c] for c in by) for r in rows}
        assert len(got) == len(groups)
        for r in got:
            own = [x for x in rows if all({"code": x[0], "month": x[1]}[c] == r[c] for c in by)]
            assert r["rows"] == r.hours_n == len(own)
            distinct = len({x[2] for x in own})
            assert abs(r.asset_distinct - distinct) <= max(1, sketches.DISTINCT_ERROR * distinct)
            values = np.sort([x[3] for x in own])
            for share, edge in zip((0.25, 0.5, 0.75), r.hours_q):
                assert abs(np.searchsorted(values, edge, "right") / len(own) - share) <= 2 * sketches.RANK_ERROR


def test_rank_errors_are_those_of_the_edges(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 101)] + [("a", None), ("a", float("nan")), ("b", 5.0)], "code string, hours double")
    edges = spark.createDataFrame([("a", [25.0, 60.0]), ("b", [5.0, 5.0])], "code string, q array<double>")
    got = {r.code: r.rank_error for r in sketches.rank_errors(df, F.col("hours"), edges, ["code"], (0.25, 0.5), "q").collect()}
    assert got["a"] == pytest.approx(0.09) and got["b"] == 0.0


def test_nulls_empty_strings_and_no_rows(spark):
    rows = [("A", 1, None, None), ("A", 1, "", float("nan")), (None, 2, "x", 1.0), (None, 2, "x", 3.0), (None, None, "y", 2.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.code: r for r in sketches.read_off(sketches.merge_cells(cells_of(df), ["code"]), (0.5,)).collect()}
    assert (got["A"]["rows"], got["A"].asset_distinct, got["A"].hours_n, got["A"].hours_q) == (2, 1, 0, None)
    assert (got[None]["rows"], got[None].asset_distinct, got[None].hours_n, got[None].hours_q) == (3, 2, 3, [2.0])
    assert sketches.merge_cells(cells_of(df.limit(0))).count() == 0
    with pytest.raises(ValueError, match="clash"):
        sketches.sketch_cells(df, {"rows": F.col("code")}, {}, {})
    with pytest.raises(ValueError, match="named"):
        sketches.store_cells(cells_of(df), "/nowhere", "../x")
