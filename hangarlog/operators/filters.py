"""Record filters and projections. Each is one predicate Catalyst can push."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hangarlog.functions.text import as_column, blank_to_null, normalize_code
from hangarlog.functions.dates import to_number

VALID_CODE = "^[A-Z0-9]{3,6}$"

Day = str | dt.date | None


def _day(value: str | dt.date) -> Column:
    return F.lit(str(value)).cast("date")


def record_predicate(asset_id: str | None = None, code: str | None = None, start: Day = None,
                     end: Day = None) -> Column:
    """All given conditions at once; both date bounds are inclusive.

    Records without a start date drop out as soon as one bound is given.
    """
    terms = []
    if asset_id:
        terms.append(F.col("asset_id") == str(asset_id).strip())
    if code:
        terms.append(F.col("code") == str(code).strip().upper())
    if start is not None:
        terms.append(F.col("start_date") >= _day(start))
    if end is not None:
        terms.append(F.col("start_date") <= _day(end))
    out = F.lit(True)
    for term in terms:
        out = out & term
    return out


def query_records(df: DataFrame, asset_id: str | None = None, code: str | None = None, start: Day = None,
                  end: Day = None) -> DataFrame:
    return df.where(record_predicate(asset_id, code, start, end))


def valid_label(df: DataFrame, label: str = "code") -> DataFrame:
    """Rows whose label is three to six capitals or digits; null is invalid."""
    return df.where(F.col(label).isNotNull() & F.col(label).rlike(VALID_CODE))


def label_validity(df: DataFrame, label: str = "code") -> DataFrame:
    """Kept and rejected row counts of ``valid_label``."""
    good = F.coalesce(F.col(label).rlike(VALID_CODE), F.lit(False))
    return df.agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("rejected"))


def long_enough(df: DataFrame, text: str = "text", n: int = 10) -> DataFrame:
    return df.where(F.length(text) >= n)


def not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def confident_disagreements(df: DataFrame, truth: str = "truth", pred: str = "pred_1",
                            confidence: str = "confidence_1", floor: float = 90.0) -> DataFrame:
    """Rows whose label and first prediction differ once trimmed and in upper case; no prediction counts as wrong."""
    differs = F.col(truth).isNotNull() & ~normalize_code(truth).eqNullSafe(normalize_code(pred))
    return df.where(differs & (to_number(confidence) >= floor))


def worksheet_columns(df: DataFrame, columns: Sequence[str], fill_in: Sequence[str]) -> DataFrame:
    """The columns that exist out of those asked for, then empty ones to fill in."""
    present = [c for c in columns if c in df.columns]
    return df.select(*present, *[F.lit("").alias(c) for c in fill_in])


def clean_choice(normalized: str | None, raw: str) -> Column:
    """The normalised text, or the raw one; blanks become null."""
    return blank_to_null(as_column(normalized or raw))
