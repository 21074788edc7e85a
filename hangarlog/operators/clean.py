"""Merging, typing and deduplicating raw extracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from hangarlog.functions.dates import parse_mixed_dates, to_number
from hangarlog.functions.text import blank_to_null, normalize_writeup
from hangarlog.schema import RECORD_SCHEMA

WRITEUPS = {
    "discrepancy": "discrepancy_normalized",
    "corrective_action": "corrective_action_normalized",
}


IDENTIFIERS = ("asset_id", "job_id", "base", "discovered_code", "maint_type_code")


def shared_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns of b that a has too, in b's order."""
    return [c for c in b.columns if c in a.columns]


def dropped_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns of a that the merge leaves out."""
    return sorted(set(a.columns) - set(shared_columns(a, b)))


def union_shared(a: DataFrame, b: DataFrame) -> DataFrame:
    common = shared_columns(a, b)
    return a.select(*common).unionByName(b.select(*common))


def merge_extracts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both on the shared columns, each distinct row once.

    Nulls count as equal. Copies collapse within each partition before the
    shuffle, so a row repeated very often does not land on one task.
    """
    return union_shared(a, b).dropDuplicates()


def merge_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows before and after the merge, and how many copies went."""
    common = shared_columns(a, b)
    per_row = union_shared(a, b).groupBy(*common).agg(F.count(F.lit(1)).alias("copies"))
    before, after = F.sum("copies"), F.count(F.lit(1))
    return per_row.agg(
        F.coalesce(before, F.lit(0)).alias("rows_before"), after.alias("rows_after"),
        F.coalesce(before - after, F.lit(0)).alias("rows_removed"),
    )


def normalize_writeups(df: DataFrame) -> DataFrame:
    return df.withColumns({new: normalize_writeup(old) for old, new in WRITEUPS.items() if old in df.columns})


def clean_records(df: DataFrame) -> DataFrame:
    """Typed, trimmed records from text columns; dates in any known encoding.

    A blank identifier is none: it would be one giant job, asset or site.
    """
    dates = [f.name for f in RECORD_SCHEMA if isinstance(f.dataType, T.DateType)]
    out = parse_mixed_dates(df, [c for c in dates if c in df.columns and dict(df.dtypes)[c] != "date"])
    typed = {}
    for field in RECORD_SCHEMA:
        if field.name not in df.columns:
            continue
        if field.name == "code":
            typed["code"] = F.upper(blank_to_null("code"))
        elif field.name in IDENTIFIERS:
            typed[field.name] = blank_to_null(field.name)
        elif isinstance(field.dataType, T.DoubleType):
            typed[field.name] = to_number(field.name)
    return normalize_writeups(out.withColumns(typed))


def dedupe(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key combination, the one that comes first by ``order``.

    ``order`` is unique and never null. Keys are told apart by 128 bits of
    digest, so long texts are neither sorted nor shipped to find the first row
    of each; the copies of a key are combined map-side.
    """
    digests = {"_d1": F.xxhash64(*[F.struct(F.col(k).isNull(), k) for k in keys]),
               "_d2": F.xxhash64(F.lit(41), *[F.struct(F.col(k).isNull(), k) for k in keys])}
    keyed = df.withColumns(digests)
    first = keyed.groupBy(*digests).agg(F.min(order).alias(order))
    return keyed.join(first, [*digests, order], "left_semi").select(*df.columns)
