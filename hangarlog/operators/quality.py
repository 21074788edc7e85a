"""Checks on a record table: completeness, dates, class sizes, text lengths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from hangarlog.functions.text import blank_to_null, system_of
from hangarlog.operators.counts import top_rows
from hangarlog.operators.ranks import exact_quantiles
from hangarlog.schema import PROFILE_COLUMNS


def missing_columns(df: DataFrame, required: Sequence[str] = PROFILE_COLUMNS) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: Sequence[str] = PROFILE_COLUMNS) -> DataFrame:
    """The same frame, or an error naming every column it lacks."""
    lacking = missing_columns(df, required)
    if lacking:
        raise ValueError(f"missing columns {lacking}; found {df.columns}")
    return df


def completeness(df: DataFrame, required: Sequence[str] = PROFILE_COLUMNS) -> DataFrame:
    """Per required column: status, non-null rows and their share, in one scan."""
    present = [c for c in required if c in df.columns]
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in present])
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit("OK" if c in present else "MISSING").alias("status"),
            (F.col(c) if c in present else F.lit(None).cast("bigint")).alias("non_null"),
        )
        for c in required
    ])
    return wide.select("_rows", F.explode(rows).alias("e")).select(
        "e.*", (100.0 * F.col("e.non_null") / F.nullif("_rows", F.lit(0))).alias("non_null_pct")
    )


def date_quality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per date column: share parsed, range, and OK, WARN or ERROR."""
    wide = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[f(c).alias(f"{name}_{c}") for c in columns for name, f in (("n", F.count), ("lo", F.min), ("hi", F.max))],
    )
    rows = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"n_{c}").alias("parsed"),
                 F.col(f"lo_{c}").alias("first_date"), F.col(f"hi_{c}").alias("last_date"))
        for c in columns
    ])
    pct = F.coalesce(100.0 * F.col("parsed") / F.nullif("_rows", F.lit(0)), F.lit(0.0))
    return (
        wide.select("_rows", F.explode(rows).alias("e")).select("_rows", "e.*")
        .withColumn("parsed_pct", pct)
        .withColumn("status", F.when(F.year("last_date") < 1980, "ERROR").when(F.col("parsed_pct") <= 95, "WARN").otherwise("OK"))
        .drop("_rows")
    )


def class_frequency(df: DataFrame, label: str) -> DataFrame:
    """Median, mean and largest class size; classes are counted first."""
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("classes"), F.median("n").alias("median_n"),
        F.avg("n").alias("mean_n"), F.max("n").alias("max_n"),
    )


def text_length_summary(df: DataFrame, text: str, short: int = 50) -> DataFrame:
    """Count, mean, deviation, range and quartiles of the text length."""
    lengths = df.select(F.length(text).alias("len"), blank_to_null(text).isNull().alias("blank"))
    quartiles = exact_quantiles(lengths, "len", (0.25, 0.5, 0.75)).select(F.struct("q0", "q1", "q2")).scalar()
    return (
        lengths.agg(
            F.count("len").alias("n"), F.avg("len").alias("mean_len"), F.stddev_samp("len").alias("std_len"),
            F.min("len").alias("min_len"), F.max("len").alias("max_len"),
            F.count_if(F.col("len") < short).alias("short_rows"), F.count_if("blank").alias("blank_rows"),
        )
        .withColumn("q", quartiles)
        .select("*", F.col("q.q0").alias("p25"), F.col("q.q1").alias("p50"), F.col("q.q2").alias("p75"))
        .drop("q")
    )


def label_distribution(df: DataFrame, label: str, n: int = 10, system: bool = False) -> DataFrame:
    """The n most frequent labels, or systems when ``system`` is set."""
    item = system_of(label) if system else F.col(label)
    counts = df.select(item.alias("item")).where("item IS NOT NULL").groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return top_rows(counts, n)
