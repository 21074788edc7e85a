"""Codes worked on the same job as a code."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from hangarlog.plans.sizing import stored

#: Codes of one job that are paired with the others by one task.
SPREAD = 256
#: Pairs of codes that one task makes and adds up, as near as whole jobs allow.
TASK_PAIRS = 2_000_000


def spread_jobs(counts: DataFrame, spread: int = SPREAD) -> tuple[DataFrame, DataFrame]:
    """Both sides of the pairing of codes within jobs: counts per (job, code) by job and part.

    A job's codes are dealt into parts of about ``spread`` codes on one side,
    and its other side goes to each part, so a job with very many codes is
    paired by as many tasks as it has parts. Ordinary jobs have one part.
    """
    widths = counts.groupBy("job_id").agg(F.ceil(F.count(F.lit(1)) / spread).cast("int").alias("parts"))
    sized = counts.join(widths, "job_id")
    left = sized.select("job_id", F.pmod(F.xxhash64("code"), F.col("parts")).cast("int").alias("part"), "code")
    right = sized.select("job_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                         F.col("code").alias("other"), F.col("n").alias("other_n"))
    return left, right


def cooccurring(df: DataFrame, n: int = 5, spread: int = SPREAD, codes: Sequence[str] | None = None) -> DataFrame:
    """For each code, the n other codes with most records on its jobs.

    Records are first counted per job and code, which is stored; pair counts
    are combined map-side before they are shuffled by pair. Jobs are dealt to
    as many tasks as there are pairs for, so that the table of pairs a task
    adds up does not grow with the input. With ``codes``, only these are
    answered, and only their jobs are looked at.
    """
    if codes is not None:
        jobs = df.where(F.col("code").isin(*codes)).select("job_id").distinct()
        df = df.join(jobs, "job_id", "left_semi")
    counts = stored(
        df.where("job_id IS NOT NULL AND code IS NOT NULL")
        .groupBy("job_id", "code").agg(F.count(F.lit(1)).alias("n"))
    )
    pairs = counts.groupBy("job_id").agg(F.count(F.lit(1)).alias("codes")).agg(F.sum(F.col("codes").cast("double") ** 2)).first()[0] or 0
    tasks = math.ceil(pairs / TASK_PAIRS)
    left, right = spread_jobs(counts, spread)
    if tasks > 2 * df.sparkSession.sparkContext.defaultParallelism:  # else the shuffle's own tasks are small enough
        left, right = left.repartition(tasks, "job_id", "part"), right.repartition(tasks, "job_id", "part")
    if codes is not None:
        left = left.where(F.col("code").isin(*codes))
    scored = (
        left.join(right, ["job_id", "part"]).where("code <> other")
        .groupBy("code", "other").agg(F.sum("other_n").alias("n"))
    )
    best = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("n"), F.asc("other")))
    return scored.withColumn("rank", best).where(F.col("rank") <= n)
