from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from record_helpers import row, table
from pyspark.sql import functions as F

from hangarlog.functions.text import title_case
from hangarlog.operators import geo, narrative, ranks, related, sections
from hangarlog.plans.profile import profile
from hangarlog.reference_data import gazetteer, maintenance_phases


def test_exact_quantiles_against_pandas(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([rng.uniform(-50, 5000), 2.0, float(rng.randint(0, 9))])) for k in "aab" * 300] + [("c", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.q0, r.q1, r.q2) for r in ranks.exact_quantiles(df, "v", (0.25, 0.5, 0.75), ["g"]).collect()}
    for g, part in pd.DataFrame(rows, columns=["g", "v"]).groupby("g"):
        assert np.allclose(got[g], part.v.quantile([0.25, 0.5, 0.75]), rtol=1e-12)
    whole = ranks.exact_quantiles(df, "v", [0.5]).first().q0
    assert np.isclose(whole, np.median([v for _, v in rows]))


def test_bands_are_closed_right_and_zero_filled(frame):
    df = frame([row(i, hours=h) for i, h in enumerate([-5.0, -1.0, 0.0, 10.0, 20.0, 30.0, 40.0, 50.0])])
    edges = tuple(sections.quartile_edges(df).first())
    assert edges == (-0.25, 15.0, 32.5)
    got = [r.n for r in sections.hour_bands(df).orderBy("band_no").collect()]
    # -5 and -1 fall out; nothing lies in (-1, -0.25]
    assert got == [0, 2, 2, 2]


def test_tied_fleet_edges_fall_back_to_the_code(frame):
    rows = [row(i, code="11AAA", hours=5.0) for i in range(40)] + [row(i, code="12BBB", hours=float(i)) for i in range(4)]
    got = sections.hour_bands(frame(rows)).collect()
    assert {r.code for r in got} == {"12BBB"} and sum(r.n for r in got) == 4


def test_spellings_of_a_base_meet(frame):
    df = frame([row(1, base="SCOTT"), row(2, base=" Scott "), row(3, base=None)])
    assert table(sections.base_distribution(df), "item", "n") == [("SCOTT", 2)]
    assert geo.base_counts(df).select(title_case("base_key")).first()[0] == "Scott"


def test_first_keyword_in_rank_order(spark, frame):
    df = frame([row(1, base="greater pittsburg"), row(2, base="MARCH SCOTT"), row(3, base="NOWHERE"), row(4, base=None)])
    got = {r.base_key: r.site for r in geo.geolocate(df, gazetteer(spark)).collect()}
    assert got == {"GREATER PITTSBURG": "Pittsburgh ANGB, PA", "MARCH SCOTT": "March ARB, CA", "NOWHERE": None}
    cover = geo.geo_coverage(df, gazetteer(spark)).first()
    assert (cover.mapped, cover.total) == (2, 3)
    assert geo.geo_rollup(df, gazetteer(spark)).count() == 2


def test_expected_records_sum_to_the_code(frame):
    rng = random.Random(2)
    rows = [row(i, code=rng.choice("1122233"), base=rng.choice(("XA", "XB", "XC"))) for i in range(200)]
    got = geo.concentration(geo.base_counts(frame(rows)), "base_key").groupBy("code").agg(F.sum("n"), F.sum("expected"))
    # every base occurs with each code here, so nothing is lost
    assert all(abs(n - e) < 1e-9 for _, n, e in got.collect())


def _trend(spark, counts, end):
    years = spark.createDataFrame([("c", y, n) for y, n in counts.items()], "code string, year int, n bigint")
    return sections.trend_of(years, F.lit(end).cast("date")).collect()


def test_trend_halves_and_partial_year(spark):
    full = {2019: 10, 2020: 10, 2021: 5, 2022: 7, 2023: 20, 2024: 20, 2025: 30, 2026: 1}
    got = _trend(spark, full, "2026-03-31")[0]
    assert (got.earlier_records, got.recent_records, got.excluded_year, got.last_full_year) == (25, 70, 2026, 2025)
    assert got.direction == "rising" and got.change_pct == 180.0
    whole = _trend(spark, full, "2026-12-31")[0]
    assert whole.excluded_year is None and whole.last_full_year == 2026
    assert _trend(spark, {2020: 1, 2021: 2}, "2026-03-31") == []
    assert _trend(spark, {2020: 1, 2021: 2, 2026: 2}, "2026-03-31") == []
    assert _trend(spark, {2020: 0, 2021: 2, 2022: 2}, "2026-03-31")[0].change_pct is None


def test_phases(spark, frame):
    df = frame([row(1, kind="b"), row(2, kind=" "), row(3, kind=None), row(4, kind="Z")])
    got = dict(table(sections.phase_histogram(df, "maint_type", maintenance_phases(spark)), "phase", "n"))
    assert got == {"On-equipment scheduled": 1, "Unknown": 2, "Unknown (Z)": 1}


def _brute_related(rows, n):
    jobs, per = {}, Counter()
    for job, code in rows:
        jobs.setdefault(job, Counter())[code] += 1
    for seen in jobs.values():
        for c in seen:
            for o, k in seen.items():
                if o != c:
                    per[c, o] += k
    out = []
    for c in {c for c, _ in per}:
        best = sorted(((-k, o) for (d, o), k in per.items() if d == c))[:n]
        out += [(c, o, -k, i) for i, (k, o) in enumerate(best, 1)]
    return sorted(out, key=str)


def test_related_codes_for_any_job_width(frame):
    rng = random.Random(5)
    pairs = [(f"j{rng.randint(0, 40)}", f"c{rng.randint(0, 15):02d}") for _ in range(400)]
    pairs += [("hot", f"c{rng.randint(0, 30):02d}") for _ in range(300)] + [("hot2", f"c{i:02d}") for i in range(0, 30, 2)]
    df = frame([row(i, code=c, job=j) for i, (j, c) in enumerate(pairs)] + [row(9999, job=None)])
    want = _brute_related(pairs, 5)
    for width in (1, 3, 8, 1000):
        assert table(related.cooccurring(df, spread=width), "code", "other", "n", "rank") == want, width


def test_pairs_of_many_jobs_are_dealt_to_tasks(frame, monkeypatch):
    monkeypatch.setattr(related, "TASK_PAIRS", 20, raising=False)
    rng = random.Random(6)
    pairs = [(f"j{rng.randint(0, 60)}", f"c{rng.randint(0, 15):02d}") for _ in range(400)]
    found = related.cooccurring(frame([row(i, code=c, job=j) for i, (j, c) in enumerate(pairs)]))
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert table(found, "code", "other", "n", "rank") == _brute_related(pairs, 5)


def test_profile_reads_the_records_behind_it_once(spark, frame, tmp_path):
    frame([row(i, day=f"{2019 + i % 5}-0{1 + i % 9}-10", hours=float(i), job=f"j{i // 2}", code=("11AAA", "12BBB")[i % 2]) for i in range(20)]).write.parquet(str(tmp_path / "r"))
    found = profile(spark.read.parquet(str(tmp_path / "r")))
    assert not [f for f in found.inputFiles() if str(tmp_path) in f]
    assert sorted((r.code, r.total_records) for r in found.collect()) == [("11AAA", 10), ("12BBB", 10)]


def test_profile_and_its_text(spark, frame):
    rows = [row(i, day=f"{2019 + i % 5}-0{1 + i % 9}-10", base=("SCOTT", "ALTUS")[i % 4 == 0], hours=float(i), labor=2.0,
                job=f"j{i // 2}", code=("11AAA", "12BBB")[i % 2], text="PUMP LEAKING.") for i in range(40)]
    dictionary = spark.createDataFrame([("11AAA", "Pump")], "code string, description string")
    p = profile(frame(rows), dictionary, codes=["11aaa", "99ZZZ"])
    got = {r.code: r for r in narrative.prompt(narrative.narrative(p)).collect()}
    one = got["11AAA"]
    assert one.description == "Pump" and one.total_records == 20 and one.labor.burden_index == 1.0
    assert [m.item for m in one.months][:2] == ["Jan", "Feb"] and sum(m.n for m in one.months) == 20
    assert one.cooccurring[0].item == "12BBB" and one.site_coverage.mapped == 20
    assert sum(b.n for b in one.hour_bands) == 20
    text = one.narrative
    assert text.startswith("**WUC 11AAA — Pump**\nBased on 20 maintenance records across 1 airframes (2019-")
    assert "**Burden.** 40 man-hours total, averaging 2.0 h per event against a fleet average of 2.0 h. At 1.00x" in text
    assert '"PUMP LEAKING" (20 occurrences, 100% of all reports)' in text and "12BBB (20)" in text
    assert '"total_records" : 20' in one.prompt
    assert got["99ZZZ"].narrative == "No records found for WUC 99ZZZ." and got["99ZZZ"].description == "Unknown"


def test_facets_in_one_scan_match_single_ones(frame):
    df = frame([row(i, code=f"11AA{i % 3}", text=f"PUMP {i % 4} LEAK", day=f"2020-0{1 + i % 7}-01") for i in range(30)])
    names = ["phrase", "keyword", "fix_keyword", "base", "month", "asset"]
    apart = []
    for name in names:
        apart += table(sections.facet_counts(df, [name]))
    assert table(sections.facet_counts(df, names)) == sorted(apart, key=str)


def test_quantile_buckets_stay_small(spark):
    rng = random.Random(3)
    columns = {
        "tiny": [rng.random() / 1000 for _ in range(20_000)],
        "month": [1.7e9 + rng.random() * 2.6e6 for _ in range(20_000)],
        "outlier": [1.7e9 + rng.random() * 2.6e6 for _ in range(20_000)] + [0.0],
    }
    for name, values in columns.items():
        df = spark.createDataFrame([(v,) for v in values], "v double")
        low, high = F.lit(min(values)), F.lit(max(values))
        fullest = df.groupBy(ranks.value_bucket(F.col("v"), low, high).alias("b")).count().agg(F.max("count")).first()[0]
        assert fullest <= len(values) / 30, name
        ordered = sorted(values)
        got = ranks.exact_quantiles(df, "v", [0.0, 0.5, 1.0]).first()
        middle = (ordered[(len(ordered) - 1) // 2] + ordered[len(ordered) // 2]) / 2
        assert (got.q0, got.q2) == (ordered[0], ordered[-1]) and got.q1 == pytest.approx(middle)


def test_nan_and_infinity_in_quantiles(spark):
    df = spark.createDataFrame([(float(v),) for v in ("nan", "inf", "-inf", "1", "2", "3")] + [(None,)], "v double")
    got = ranks.exact_quantiles(df, "v", [0.0, 0.5, 1.0]).first()
    assert (got.q0, got.q1, got.q2) == (float("-inf"), 2.0, float("inf"))
    same = spark.createDataFrame([(5.0,)] * 4, "v double")
    assert ranks.exact_quantiles(same, "v", [0.5]).first().q0 == 5.0


def test_a_wide_job_spreads_over_tasks(frame):
    df = frame([row(i, code=f"c{i:04d}", job="wide") for i in range(600)])
    counts = df.groupBy("job_id", "code").count().withColumnRenamed("count", "n")
    largest = {}
    for spread in (1000, 100):
        left, _ = related.spread_jobs(counts, spread)
        largest[spread] = left.groupBy("job_id", "part").count().agg(F.max("count")).first()[0]
    assert largest[1000] == 600 and largest[100] < 200


def test_a_long_gazetteer(spark, frame):
    sites = spark.createDataFrame([(i, f"KEY{i:05d}", f"Site {i}", float(i), 0.0) for i in range(20_000)], "rk int, keyword string, name string, lat double, lon double")
    df = frame([row(1, base="at key00042 field"), row(2, base="KEY19999 KEY00007"), row(3, base="none"), row(4, base=None)])
    got = {r.base_key: r.site for r in geo.geolocate(df, sites).collect()}
    assert got == {"AT KEY00042 FIELD": "Site 42", "KEY19999 KEY00007": "Site 7", "NONE": None}


def test_a_profile_of_some_codes_is_the_same_as_of_all(spark, frame):
    rng = random.Random(12)
    rows = [row(i, day=f"{2019 + i % 5}-0{1 + i % 9}-10", base=rng.choice(("SCOTT", "ALTUS", "X")), hours=float(rng.randint(0, 90)), labor=float(rng.randint(1, 9)),
                job=f"j{rng.randint(0, 15)}", code=rng.choice(("11AAA", "12BBB", "13CCC"))) for i in range(120)]
    whole = {r.code: r for r in profile(frame(rows)).collect()}
    some = {r.code: r for r in profile(frame(rows), codes=["11AAA", "13CCC"]).collect()}
    assert set(some) == {"11AAA", "13CCC"} and all(some[c] == whole[c] for c in some)
