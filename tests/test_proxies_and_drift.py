"""Judged lists, bootstrap intervals, monthly distances and change detection."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hangarlog.operators import drift, proxies
from record_helpers import row


def test_lists_are_judged_against_the_querys_record(spark, frame):
    recs = frame([row(0, code="11AAA", fix="REPLACED SEAL", labor=2.0), row(1, code="11AAA", fix="replaced pump", labor=4.0),
                  row(2, code="11AAB", fix=None, labor=None), row(3, code="11BAA", fix="", labor=1.0), row(4, code=None, fix="SEAL", labor=8.0)])
    lists = spark.createDataFrame([("r0", 1, "r2", 3.0), ("r0", 2, "r1", 2.0), ("r0", 3, "r3", 1.0), ("r0", 4, "r4", 0.5), ("r3", 1, "r2", 1.0),
                                   ("r2", 1, "r3", 1.0), ("r1", 1, "gone", 1.0), ("gone", 1, "r1", 1.0), ("r4", 1, "r0", 1.0)],
                                  "record_id string, rank int, similar_id string, score double")
    got = {r.record_id: r for r in proxies.judge_lists(lists, recs).collect()}
    assert set(got) == {"r0", "r2", "r3", "r4"}
    r = got["r0"]
    assert (r.listed, r.code_agreement, r.subsystem_agreement, r.system_agreement, r.code_found, r.reciprocal_rank) == (4, 0.25, 0.5, 0.75, 1.0, 0.5)
    assert (r.fix_overlap, r.best_fix_overlap) == (pytest.approx((0 + 1 / 3 + 0 + 1 / 2) / 4), 0.5) and r.labor_guess == pytest.approx(13 / 3) and r.labor == 2.0
    assert got["r3"].labor_guess is None and got["r3"].fix_overlap == 0.0 and got["r4"].code_agreement == 0.0 and got["r2"].labor is None


def judged_rows(rng, n):
    out = []
    for i in range(n):
        hit, labor = float(rng.random() < 0.3), rng.gauss(10, 3)
        out.append((f"q{rng.random()}", hit, hit, 1.0, hit, hit, rng.random(), rng.random(), labor + rng.gauss(0, 1), labor))
    return out


JUDGED = ("record_id string, code_agreement double, subsystem_agreement double, system_agreement double, code_found double, reciprocal_rank double, "
          "fix_overlap double, best_fix_overlap double, labor_guess double, labor double")


def test_intervals_cover_the_truth_and_values_are_plain_means(spark):
    rng, covered = random.Random(1), 0
    for trial in range(12):
        rows = judged_rows(rng, 300)
        got = {r.metric: r for r in proxies.summarize(spark.createDataFrame(rows, JUDGED), draws=100, seed=trial).collect()}
        assert got["code_agreement"].value == pytest.approx(np.mean([r[1] for r in rows])) and got["code_agreement"].queries == 300
        x, y = np.array([r[8] for r in rows]), np.array([r[9] for r in rows])
        assert got["labor_correlation"].value == pytest.approx(np.corrcoef(x, y)[0, 1])
        assert got["labor_error"].value == pytest.approx(np.abs(x - y).mean()) and got["plain_labor_error"].value == pytest.approx(np.abs(y - y.mean()).mean())
        assert got["system_agreement"].low == got["system_agreement"].high == 1.0
        covered += got["code_agreement"].low <= 0.3 <= got["code_agreement"].high
        width = got["code_agreement"].high - got["code_agreement"].low
        assert 0.6 * 3.92 < width / math.sqrt(0.21 / 300) < 1.4 * 3.92
    assert covered >= 9
    again = [proxies.summarize(spark.createDataFrame(rows, JUDGED).repartition(p), draws=20).orderBy("metric").collect() for p in (1, 3)]
    assert [[pytest.approx(v) if isinstance(v, float) else v for v in r] for r in again[0]] == [list(r) for r in again[1]]


def test_metrics_without_values_are_null(spark):
    nothing = {r.metric: r for r in proxies.summarize(spark.createDataFrame([], JUDGED), draws=5).collect()}
    assert len(nothing) == 10 and all((r.queries, r.value, r.low, r.high) == (0, None, None, None) for r in nothing.values())
    one = spark.createDataFrame([("a", 1.0, 1.0, 1.0, 1.0, 1.0, 0.5, 0.5, None, 3.0)], JUDGED)
    got = {r.metric: r for r in proxies.summarize(one, draws=30).collect()}
    assert got["code_agreement"].value == got["code_agreement"].low == 1.0
    assert got["labor_error"].queries == 0 and got["labor_error"].value is None and got["labor_correlation"].value is None


# ---- drift -----------------------------------------------------------------

def brute_distance(p, q):
    keys = set(p) | set(q)
    p, q = [{k: v / sum(d.values()) for k, v in d.items()} for d in (p, q)]
    total = 0.0
    for k in keys:
        a, b = p.get(k, 0), q.get(k, 0)
        m = (a + b) / 2
        total += (a * math.log2(a / m) if a else 0) / 2 + (b * math.log2(b / m) if b else 0) / 2
    return math.sqrt(total)


def test_distances_of_months_from_a_reference(spark, frame):
    rng, rows = random.Random(3), []
    for i in range(400):
        month = rng.randint(1, 6)
        code = rng.choice(["11AAA", "22BBB", "33CCC"] if month < 5 else ["33CCC", "44DDD"])
        rows.append(row(i, code=code, day=f"2020-{month:02d}-11", base=rng.choice(["X", None]), text=f"{code} leak word{month}"))
    rows.append(row(900, day=None))
    facets = {"code": "code", "base": F.col("base"), "words": drift.text_facet("discrepancy")}
    counts = drift.monthly_counts(frame(rows), facets)
    got = {(r.facet, r.month.month): r for r in drift.monthly_distance(counts, "2020-03-01").collect()}
    dated = [r for r in rows if r[4]]
    tally = lambda keep, of: {k: sum(v for x in dated if keep(x[4].month) for kk, v in of(x) if kk == k) for k in {k for x in dated if keep(x[4].month) for k, _ in of(x)}}
    for facet, of in (("code", lambda x: [(x[1], 1)]), ("base", lambda x: [(x[3], 1)] if x[3] else []), ("words", lambda x: [(w, 1) for w in x[10].lower().split()])):
        base = tally(lambda m: m < 3, of)
        for month in range(1, 7):
            own, r = tally(lambda m: m == month, of), got[facet, month]
            assert r.n == sum(own.values()) and r.distance == pytest.approx(brute_distance(own, base), abs=1e-9)
            assert r.new_items == pytest.approx(sum(v for k, v in own.items() if k not in base) / sum(own.values()))
    assert len(got) == 18
    early = drift.monthly_distance(counts, "2019-01-01").collect()
    assert {r.distance for r in early} == {None} and {r.new_items for r in early} == {1.0}
    assert drift.monthly_distance(counts.limit(0), "2020-01-01").collect() == []


def series(spark, values, facet="f"):
    days = [dt.date(2000 + i // 12, i % 12 + 1, 1) for i in range(len(values))]
    return [(facet, d, v) for d, v in zip(days, values)]


def test_cusum_equals_its_recursion_and_finds_planted_changes(spark):
    rng = random.Random(7)
    steady = [rng.gauss(5, 1) for _ in range(60)]
    up = [rng.gauss(5, 1) + (3 if i >= 40 else 0) for i in range(60)]
    down = [rng.gauss(5, 1) - (2 if i >= 30 else 0) if i != 35 else None for i in range(60)]
    rows = series(spark, steady, "steady") + series(spark, up, "up") + series(spark, down, "down") + series(spark, [1.0] * 30, "flat")
    df = spark.createDataFrame(rows, "facet string, month date, v double")
    watched = drift.cusum(df, "v", "2002-01-01", slack=1.0, limit=6.0)
    got = {}
    for r in watched.orderBy("facet", "month").collect():
        got.setdefault(r.facet, []).append(r)
    for name, values in (("steady", steady), ("up", up), ("down", down)):
        early = [v for v in values[:24] if v is not None]
        mean, spread = np.mean(early), np.std(early, ddof=1)
        high = low = 0.0
        for v, r in zip(values, got[name]):
            z = None if v is None else (v - mean) / spread
            high, low = (high, low) if z is None else (max(0.0, high + z - 1.0), max(0.0, low - z - 1.0))
            assert r.upper == pytest.approx(high, abs=1e-9) and r.lower == pytest.approx(low, abs=1e-9) and r.alarm == (high > 6 or low > 6)
    assert all((r.z, r.upper, r.lower, r.alarm) == (None, 0.0, 0.0, False) for r in got["flat"])
    alarms = {r.facet: r for r in drift.first_alarms(watched).collect()}
    assert set(alarms) == {"up", "down"}
    assert alarms["up"].direction == "up" and dt.date(2003, 5, 1) <= alarms["up"].alarm_at <= dt.date(2003, 10, 1)
    assert alarms["down"].direction == "down" and dt.date(2002, 7, 1) <= alarms["down"].alarm_at <= dt.date(2003, 4, 1)
    assert alarms["up"].quiet_until < alarms["up"].alarm_at


def test_draws_are_those_of_the_cumulated_shares(spark):
    """Hex digits are compared as text; the weights are those of the numbers they stand for."""
    import hashlib

    df = spark.range(400).selectExpr("concat('r', id) AS record_id", "cast(id % 5 AS int) AS draw")
    got = {(r.record_id, r.draw): r.w for r in df.withColumn("w", proxies._drawn("record_id", 42)).collect()}
    for (key, draw), w in got.items():
        share = int(hashlib.md5(f"42:{draw}:{key}".encode()).hexdigest()[:13], 16) / float(1 << 52)
        assert w == (1 if draw == 0 else sum(share >= bound for bound in proxies._CUMULATED))
    assert len(set(got.values())) > 3 and "conv(" not in str(proxies._drawn("record_id", 42))


def test_resamples_are_sums_of_drawn_queries_and_no_rows_of_their_own(spark):
    rng = random.Random(8)
    nan, inf = float("nan"), float("inf")
    rows = [(f"r{i}", *[rng.choice([None, rng.random(), rng.random()]) for _ in proxies.MEANS[:7]], rng.choice([None, 1.5, 4.0]), rng.choice([None, 2.0, 5.0 * i])) for i in range(60)]
    rows += [("odd1", *[nan] * 7, None, None), ("odd2", *[inf] * 7, None, None)]
    df = spark.createDataFrame(rows, "record_id string, " + ", ".join(f"{m} double" for m in proxies.MEANS[:7]) + ", labor_guess double, labor double")
    got = {r.metric: r for r in proxies.summarize(df.repartition(3), draws=7).collect()}
    each = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("w", proxies._drawn("record_id", 42)).where("w > 0")
    for m in proxies.MEANS[:7]:
        known = each.where(f"{m} IS NOT NULL").groupBy("draw").agg(F.sum("w").alias("n"), (F.sum(F.col("w") * F.col(m)) / F.sum("w")).alias("v")).collect()
        first = next(r for r in known if r.draw == 0)
        assert got[m].queries == first.n and str(got[m].value) == str(first.v)  # nan: one row of all is
        drawn = sorted((r.v for r in known if r.draw), key=lambda v: (v != v, v))
        finite = [v for v in drawn if abs(v) < inf]
        if len(finite) == len(drawn):
            assert drawn[0] - 1e-12 <= got[m].low <= got[m].high <= drawn[-1] + 1e-12
    w, v = np.array([[1.0, 0.0], [1.0, 2.0]]), [inf, 0.25]
    cells = {"drawn": pa.array(w.astype(np.int32).tolist(), pa.list_(pa.int32())), **{c: pa.array(v) for c in proxies.MEANS}, "x": pa.array([None, 1.0]), "y": pa.array([None, 3.0])}
    out = next(proxies._resampled(1)(iter([pa.RecordBatch.from_pydict(cells)]))).to_pylist()
    assert [(r["draw"], r["n_code_found"], r["s_code_found"], r["n_xy"], r["wxy"]) for r in out] == [(0, 2.0, inf, 1.0, 3.0), (1, 2.0, 0.5, 2.0, 6.0)]
    plan = proxies.summarize(df, draws=7)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and plan.count("Generate") == 1  # metrics alone, no query for each resample
