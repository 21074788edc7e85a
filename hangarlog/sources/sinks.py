"""Sinks: split parquet, CSV, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_splits(df: DataFrame, path: str, column: str = "split") -> None:
    """Parquet with one folder per split."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def write_records(df: DataFrame, path: str, date_column: str = "start_date") -> None:
    """Parquet by year, sorted by code inside, so date and code filters prune files."""
    year = f"year({date_column})"
    (
        df.selectExpr("*", f"{year} AS record_year")
        .hint("rebalance", "record_year", "code")  # a frequent code is split over tasks and files
        .sortWithinPartitions("record_year", "code")
        .write.mode("overwrite")
        .partitionBy("record_year")
        .parquet(path)
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row: a label, or a metric."""
    df.write.mode("overwrite").json(path)
