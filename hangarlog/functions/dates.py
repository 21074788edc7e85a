"""Column expressions over dates and numbers that may not parse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hangarlog.functions.text import as_column

EXCEL_EPOCH = "1899-12-30"
GENERIC_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "M/d/yyyy",
    "M/d/yyyy HH:mm",
    "d-MMM-yyyy",
    "yyyy/M/d",
)


def to_number(c: Column | str) -> Column:
    """Double, or null where the text is no number; "nan" is none."""
    return F.nanvl(as_column(c).try_cast("double"), F.lit(None).cast("double"))


def to_date(c: Column | str, formats: Sequence[str] = GENERIC_FORMATS) -> Column:
    """Date by the first format that fits, or null."""
    text = as_column(c).cast("string")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("date")


def date_encoding(df: DataFrame, column: str) -> Column:
    """'ymd', 'serial' or 'text': how a column writes its dates.

    A scalar subquery, so the data decide in the same job that parses them.
    """
    n = to_number(column)
    share = lambda low, high: F.coalesce(F.avg(n.between(low, high).cast("double")), F.lit(0.0))
    return df.agg(
        F.when(share(19000101, 21001231) > 0.9, "ymd")
        .when(share(1, 80000) > 0.9, "serial")
        .otherwise("text")
        .alias("encoding")
    ).scalar()


def parse_encoded(c: Column | str, encoding: Column) -> Column:
    n = to_number(c)
    whole = n.cast("bigint")
    return (
        F.when(encoding == "ymd", F.try_to_timestamp(whole.cast("string"), F.lit("yyyyMMdd")).cast("date"))
        .when(encoding == "serial",
              F.when(n.between(-700000, 3000000), F.date_add(F.lit(EXCEL_EPOCH).cast("date"), F.floor(n).cast("int"))))
        .otherwise(to_date(c))
    )


def parse_mixed_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace each column by a DATE, after finding out how it is encoded."""
    return df.withColumns({c: parse_encoded(c, date_encoding(df, c)) for c in columns if c in df.columns})


def month_key(c: Column | str) -> Column:
    return F.date_format(as_column(c), "yyyy-MM")


def month_label(c: Column | str) -> Column:
    return F.date_format(as_column(c), "MMM yyyy")


def month_start(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))


def month_end(year: Column, month: Column) -> Column:
    return F.last_day(month_start(year, month))


def month_name(month: Column | str) -> Column:
    """'Jan' for 1 and so on."""
    return F.date_format(F.make_date(F.lit(2000), as_column(month), F.lit(1)), "MMM")
