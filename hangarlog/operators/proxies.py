"""How good lists of similar records are, by what the records themselves say, with bootstrap intervals."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hangarlog.functions.text import subsystem_of, system_of
from hangarlog.operators.classify import text_tokens
from hangarlog.operators.retrieval import SharedLists
from hangarlog.plans.sizing import fits_broadcast, stored

#: Shares of one row in a resample: how often a row is drawn is Poisson distributed with mean one.
_CUMULATED = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(12)]
MEANS = ("code_agreement", "subsystem_agreement", "system_agreement", "code_found", "reciprocal_rank", "fix_overlap", "best_fix_overlap",
         "labor_error", "plain_labor_error")


def _fix_words(fix: str) -> Column:
    return F.array_distinct(F.coalesce(text_tokens(fix), F.array().cast("array<string>")))


def judge_lists(lists: DataFrame | SharedLists, records: DataFrame, key: str = "record_id", label: str = "code", fix: str = "corrective_action",
                labor: str = "labor_hours") -> DataFrame:
    """One row for each query of lists (key, rank, similar_id, score), with how its list compares with the query's own record.

    Agreement is the share of the list with the query's code, subsystem or
    system; code_found says whether any has its code, reciprocal_rank is one
    over the rank of the first that has. Fix overlap is the Jaccard share of
    the words of the two fixes, as mean and best over the list; two fixes
    without a word overlap by 0. labor_guess is the mean labour over the list.
    Nulls agree with nothing; a list without labour has no guess. Lists of
    keys without a record are left out, as are similar records without one.
    Keys of records are unique. Shared lists meet the records once a list, not
    once an entry of each query.
    """
    if isinstance(lists, SharedLists):
        return _judge_shared(lists, records, key, label, fix, labor)
    words = _fix_words(fix)
    facts = records.select(F.col(key).alias("_key"), F.col(label).alias("_code"), words.alias("_fix"), F.col(labor).cast("double").alias("_labor"))
    own = facts.select(F.col("_key").alias(key), F.col("_code").alias("code"), F.col("_fix").alias("fix"), F.col("_labor").alias("labor"))
    both = lists.join(facts, lists["similar_id"] == F.col("_key")).drop("_key").join(own, key)
    same = lambda of: F.coalesce((of("code") == of("_code")).cast("double"), F.lit(0.0))
    union = F.size(F.array_union("fix", "_fix"))
    overlap = F.when(union > 0, F.size(F.array_intersect("fix", "_fix")) / union).otherwise(0.0)
    return both.groupBy(key).agg(
        F.count(F.lit(1)).alias("listed"), F.avg(same(F.col)).alias("code_agreement"), F.avg(same(subsystem_of)).alias("subsystem_agreement"),
        F.avg(same(system_of)).alias("system_agreement"), F.max(same(F.col)).alias("code_found"),
        F.coalesce(F.max(F.when(same(F.col) == 1.0, 1.0 / F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank"),
        F.avg(overlap).alias("fix_overlap"), F.max(overlap).alias("best_fix_overlap"), F.avg("_labor").alias("labor_guess"), F.first("labor").alias("labor"))


def _summed(entries: Column) -> Column:
    """Sums and maxima over compared entries."""
    first = F.struct(*[F.lit(0).cast(t).alias(n) for n, t in (("n", "long"), ("code", "double"), ("subsystem", "double"), ("system", "double"), ("reciprocal", "double"),
                                                              ("overlap", "double"), ("most", "double"), ("labor", "double"), ("labors", "long"))])
    return F.aggregate(entries, first, lambda t, e: F.struct(
        (t["n"] + 1).alias("n"), *[(t[c] + e[c]).alias(c) for c in ("code", "subsystem", "system")],
        F.greatest(t["reciprocal"], e["code"] / e["rank"]).alias("reciprocal"), (t["overlap"] + e["overlap"]).alias("overlap"), F.greatest(t["most"], e["overlap"]).alias("most"),
        (t["labor"] + F.coalesce(e["labor"], F.lit(0.0))).alias("labor"), (t["labors"] + e["labor"].isNotNull().cast("long")).alias("labors")))


def _judge_shared(lists: SharedLists, records: DataFrame, key: str, label: str, fix: str, labor: str) -> DataFrame:
    """Queries of one list, code and fix compare alike with its entries: they are compared once, then each key leaves itself out."""
    facts = records.select(F.col(key).alias("similar_id"), F.col(label).alias("_code"), _fix_words(fix).alias("_fix"), F.col(labor).cast("double").alias("_labor"))
    own = records.select(key, F.col(label).alias("code"), F.col(fix).alias("fix"), F.col(labor).cast("double").alias("own_labor"))
    asked, shared = lists.asked_with(own, key), lists.lists_with(facts)
    same = lambda a, b: F.coalesce((a == b).cast("double"), F.lit(0.0))

    def compared(df: DataFrame) -> DataFrame:
        def entry(e: Column) -> Column:
            shared_words = F.size(F.array_intersect("words", e["_fix"]))
            union = F.size("words") + F.size(e["_fix"]) - shared_words
            return F.struct(e["place"].alias("place"), e["similar_id"].alias("similar_id"), same(F.col("code"), e["_code"]).alias("code"),
                            same(subsystem_of("code"), subsystem_of(e["_code"])).alias("subsystem"), same(system_of("code"), system_of(e["_code"])).alias("system"),
                            F.when(union > 0, shared_words / union).otherwise(0.0).alias("overlap"), e["_labor"].alias("labor"))
        met = df.withColumn("words", _fix_words("fix")).join(shared, "q")
        return met.withColumn("entries", F.transform("entries", entry)).drop("words").withColumn("plain", _summed(lists.first()))

    cases = stored(compared(asked.select("q", "code", "fix").distinct()))
    if fits_broadcast(cases.select("q", "code", "fix")):
        c = F.broadcast(cases.withColumnsRenamed({"q": "_q", "code": "_code", "fix": "_fix"}))
        met = asked.join(c, (F.col("q") == F.col("_q")) & F.col("code").eqNullSafe(F.col("_code")) & F.col("fix").eqNullSafe(F.col("_fix")))
    else:
        met = compared(asked)
    sums = F.when(F.array_contains("ids", F.col(key)), _summed(lists.of(key))).otherwise(F.col("plain"))
    rows = met.select(key, "alone", "own_labor", sums.alias("s")).where("s.n > 0").select(key, "alone", "own_labor", "s.*")
    added = rows.where("NOT alone").groupBy(key).agg(
        *[F.sum(c).alias(c) for c in ("n", "code", "subsystem", "system", "overlap", "labor", "labors")], F.max("reciprocal").alias("reciprocal"), F.max("most").alias("most"),
        F.first("own_labor").alias("own_labor"))
    every = rows.where("alone").drop("alone").unionByName(added)
    n = F.col("n")
    return every.select(
        key, n.alias("listed"), (F.col("code") / n).alias("code_agreement"), (F.col("subsystem") / n).alias("subsystem_agreement"),
        (F.col("system") / n).alias("system_agreement"), (F.col("code") > 0).cast("double").alias("code_found"), F.col("reciprocal").alias("reciprocal_rank"),
        (F.col("overlap") / n).alias("fix_overlap"), F.col("most").alias("best_fix_overlap"),
        F.when(F.col("labors") > 0, F.col("labor") / F.col("labors")).alias("labor_guess"), F.col("own_labor").alias("labor"))


def _drawn(key: str, seed: int, draw: Column | None = None) -> Column:
    """How often a query is drawn in resample `draw`; always once in the first, which is the sample itself."""
    draw = F.col("draw") if draw is None else draw
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), draw.cast("string"), F.col(key).cast("string")))
    # A share is 13 hex digits over 2 ** 52, so it reaches a bound where its digits reach those of the bound; most are below the first.
    bounds = [math.ceil(bound * (1 << 52)) for bound in _CUMULATED]
    within = [b for b in bounds if b < 1 << 52]

    def times(share: Column) -> Column:
        out = F
        for n, bound in enumerate(within):
            out = out.when(share < f"{bound:013x}", n)
        return out.otherwise(len(within))
    once = F.transform(F.array(F.substring(digest, 1, 13)), times)  # the digest is worked out once, not for each bound
    return F.when(draw == 0, 1).otherwise(F.get(once, F.lit(0)))


SUMS = [f"{kind}_{m}" for m in MEANS for kind in "ns"] + ["wx", "wy", "wxy", "wxx", "wyy", "n_xy"]


def _resampled(draws: int):
    """A task's weighted sums, a row for each resample: sums over queries are products of matrices."""
    schema = pa.schema([("draw", pa.int32()), *[(c, pa.float64()) for c in SUMS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((draws + 1, len(SUMS))), 0
        for batch in batches:
            weights, cells = batch.column("drawn").flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, draws + 1), []
            known, value = lambda c: batch.column(c).is_valid().to_numpy(zero_copy_only=False), lambda c: batch.column(c).fill_null(0.0).to_numpy(zero_copy_only=False)
            for m in MEANS:
                cells += [known(m), value(m)]
            x, y = value("x"), value("y")
            cells = np.column_stack([*cells, x, y, x * y, x * x, y * y, known("x")]).astype(np.float64).reshape(batch.num_rows, len(SUMS))
            plain = np.isfinite(cells).all(axis=1)
            total += weights[plain].T @ cells[plain]
            for w, c in zip(weights[~plain], cells[~plain]):  # what is not drawn adds nothing, not 0 times infinity
                total[w > 0] += w[w > 0, None] * c
            rows += batch.num_rows
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws + 1, dtype=np.int32)), *[pa.array(c) for c in total.T]], schema=schema)
    return run


def summarize(judged: DataFrame, key: str = "record_id", draws: int = 200, level: float = 0.95, seed: int = 42) -> DataFrame:
    """metric, queries, value and the bounds of a Poisson bootstrap interval, one row for each metric.

    Every query enters each resample by a weight drawn from its key, so all
    resamples are summed in one pass, in each task, and repeat on any
    partitioning; no query is a row for each resample.
    labor_error is the mean absolute error of labor_guess, plain_labor_error
    that of guessing the mean labour of all queries, labor_correlation the
    Pearson correlation of guess and labour. Queries without a value of their
    own don't count in a metric; a metric that none counts in is null, and its
    bounds too. Resamples in which a metric has no value are left out of its
    interval. An empty table gives null values and 0 queries.
    """
    mean = judged.agg(F.avg("labor")).scalar()
    known = F.col("labor").isNotNull() & F.col("labor_guess").isNotNull()
    rows = judged.withColumns({"labor_error": F.abs(F.col("labor") - F.col("labor_guess")),
                               "plain_labor_error": F.when(known, F.abs(F.col("labor") - mean)),
                               # Sums of squares of what is centred keep their digits.
                               "x": F.when(known, F.col("labor_guess") - mean), "y": F.when(known, F.col("labor") - mean)})
    asked = rows.select(F.transform(F.sequence(F.lit(0), F.lit(draws)), lambda d: _drawn(key, seed, d)).alias("drawn"), *[F.col(c).cast("double").alias(c) for c in (*MEANS, "x", "y")])
    parts = asked.mapInArrow(_resampled(draws), ", ".join(["draw int", *[f"{c} double" for c in SUMS]]))
    totals = parts.groupBy("draw").agg(*[F.sum(c).alias(c) for c in SUMS]).withColumn("n_xy", F.nullif("n_xy", F.lit(0.0)))
    n = F.col("n_xy")
    spread = (F.col("wxx") - F.col("wx") ** 2 / n) * (F.col("wyy") - F.col("wy") ** 2 / n)
    tied = F.when(spread > 1e-12 * F.col("wxx") * F.col("wyy"), (F.col("wxy") - F.col("wx") * F.col("wy") / n) / F.sqrt(spread))
    metrics = [F.struct(F.lit(m).alias("metric"), F.col(f"n_{m}").alias("n"), F.when(F.col(f"n_{m}") > 0, F.col(f"s_{m}") / F.col(f"n_{m}")).alias("value")) for m in MEANS]
    metrics.append(F.struct(F.lit("labor_correlation").alias("metric"), n.alias("n"), tied.alias("value")))
    flat = totals.select("draw", F.explode(F.array(*metrics)).alias("e")).select("draw", "e.*")
    resampled = F.when(F.col("draw") > 0, F.col("value"))
    found = flat.groupBy("metric").agg(
        F.coalesce(F.max(F.when(F.col("draw") == 0, F.col("n"))), F.lit(0)).cast("long").alias("queries"), F.max(F.when(F.col("draw") == 0, F.col("value"))).alias("value"),
        F.percentile(resampled, F.lit((1 - level) / 2)).alias("low"), F.percentile(resampled, F.lit((1 + level) / 2)).alias("high"))
    every = judged.sparkSession.createDataFrame([(m,) for m in (*MEANS, "labor_correlation")], "metric string")
    return every.join(found, "metric", "left").withColumn("queries", F.coalesce("queries", F.lit(0).cast("long")))
