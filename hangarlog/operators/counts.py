"""Counts over a filtered set of records, for the whole set or per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from hangarlog.functions.dates import month_key, month_name
from hangarlog.functions.labels import code_label
from hangarlog.functions.text import blank_to_null
from hangarlog.operators.filters import Day, _day, record_predicate


def _keys(by: str | Sequence[str] | None) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def match_share(df: DataFrame, predicate: Column) -> DataFrame:
    """How many records match, and their share of all, in one scan."""
    hit, everything = F.count_if(predicate), F.count(F.lit(1))
    return df.agg(
        hit.alias("total"), everything.alias("all_records"),
        F.when(everything > 0, 100.0 * hit / everything).alias("share_pct"),
    )


def issues_by_month(df: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    keys = _keys(by)
    return (
        df.where("start_date IS NOT NULL")
        .groupBy(*keys, month_key("start_date").alias("month"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def seasonality(df: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """Twelve rows per group, Jan to Dec over all years, zeros included.

    Counting the twelve months as twelve conditional counts makes this one
    grouping without a calendar join.
    """
    keys = _keys(by)
    month = F.month("start_date")
    wide = df.groupBy(*keys).agg(*[F.count_if(month == m).alias(f"m{m}") for m in range(1, 13)])
    months = F.array(*[
        F.struct(F.lit(m).alias("month"), F.col(f"m{m}").alias("n")) for m in range(1, 13)
    ])
    return (
        wide.select(*keys, F.explode(months).alias("e"))
        .select(*keys, F.col("e.month"), month_name("e.month").alias("month_name"), F.col("e.n"))
    )


def value_counts(df: DataFrame, column: str, by: str | Sequence[str] | None = None, item: str = "item") -> DataFrame:
    """Counts of the non-blank trimmed values."""
    keys = _keys(by)
    return (
        df.select(*keys, blank_to_null(column).alias(item))
        .where(F.col(item).isNotNull())
        .groupBy(*keys, item)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_rows(counts: DataFrame, n: int, by: str | Sequence[str] | None = None, item: str = "item",
             rank: str | None = None) -> DataFrame:
    """The n fullest rows, per group or overall, ties by item.

    Overall this is a top-k limit; per group Spark prunes every partition to
    the n best rows of a group before it shuffles (WindowGroupLimit).
    """
    keys = _keys(by)
    order = [F.desc("n"), F.asc(item)]
    if not keys:
        best = counts.orderBy(*order).limit(n)
        if rank is None:
            return best
        return best.withColumn(rank, F.row_number().over(Window.orderBy(*order)))
    name = rank or "_rank"
    ranked = counts.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def topn_counts(df: DataFrame, column: str, n: int = 10, by: str | Sequence[str] | None = None,
                rank: str | None = None) -> DataFrame:
    return top_rows(value_counts(df, column, by), n, by, rank=rank)


def topn_preferred(df: DataFrame, normalized: str, raw: str, n: int = 10) -> DataFrame:
    """Top n of the normalised column, or of the raw one if that has no values.

    Both columns are counted in one pass over two tagged values per record;
    which of them counts is settled on the small result.
    """
    if normalized not in df.columns:
        return topn_counts(df, raw, n)
    tagged = F.array(
        F.struct(F.lit(0).alias("pick"), blank_to_null(normalized).alias("item")),
        F.struct(F.lit(1).alias("pick"), blank_to_null(raw).alias("item")),
    )
    counts = (
        df.select(F.explode(tagged).alias("e")).select("e.*")
        .where("item IS NOT NULL").groupBy("pick", "item").agg(F.count(F.lit(1)).alias("n"))
    )
    best = top_rows(counts, n, by="pick")
    chosen = F.min("pick").over(Window.partitionBy())
    return best.withColumn("_chosen", chosen).where("pick = _chosen").select("item", "n")


def code_breakdown(df: DataFrame, dictionary: DataFrame | None = None, n: int = 10) -> DataFrame:
    """Top codes, labelled with their description where one is known."""
    top = topn_counts(df, "code", n).withColumnRenamed("item", "code")
    if dictionary is None:
        return top.select("code", F.col("code").alias("label"), "n")
    return top.join(dictionary, "code", "left").select("code", code_label("code", "description").alias("label"), "n")


def distinct_counts(df: DataFrame, columns: Sequence[str], by: str | Sequence[str] | None = None,
                    approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.groupBy(*_keys(by)).agg(*[count(F.col(c)).alias(f"distinct_{c}") for c in columns])


def date_span(df: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    return df.groupBy(*_keys(by)).agg(
        F.min("start_date").alias("first_date"), F.max("start_date").alias("last_date")
    )


def prior_period(df: DataFrame, start: Day, end: Day, asset_id: str | None = None,
                 code: str | None = None) -> DataFrame:
    """Records in [start, end], in the equal window just before, and the change.

    Both windows are counted in one scan. Without both bounds there is no
    prior period and its columns are null.
    """
    here = record_predicate(asset_id, code, start, end)
    if start is None or end is None:
        none = F.lit(None)
        return df.agg(
            F.count_if(here).alias("total"), none.cast("bigint").alias("prior_total"),
            none.cast("bigint").alias("delta"), none.cast("double").alias("delta_pct"),
        )
    s, e = _day(start), _day(end)
    first = F.date_sub(s, F.datediff(e, s) + 1)
    before = record_predicate(asset_id, code) & F.col("start_date").between(first, F.date_sub(s, 1))
    counted = df.where(record_predicate(asset_id, code) & F.col("start_date").between(first, e)).agg(
        F.count_if(here).alias("total"), F.count_if(before).alias("prior_total")
    )
    return with_delta(counted)


def with_delta(df: DataFrame) -> DataFrame:
    """Change of ``total`` against ``prior_total``; 0 % when there was nothing."""
    change = F.col("total") - F.col("prior_total")
    return df.withColumns({
        "delta": change,
        "delta_pct": F.when(F.col("prior_total") == 0, 0.0).otherwise(
            100.0 * change / F.nullif("prior_total", F.lit(0))
        ),
    })


def rolling_mean(monthly: DataFrame, n: int = 12, min_periods: int = 3, min_rows: int = 6,
                 by: str | Sequence[str] | None = None, fill_gaps: bool = False) -> DataFrame:
    """Trailing mean over the n latest months that have records.

    Null for the first ``min_periods - 1`` rows, and for a group with fewer
    than ``min_rows`` months. ``fill_gaps`` first adds the missing months as 0.
    The window runs over months, so a group is as long as the calendar.
    """
    keys = _keys(by)
    if fill_gaps:
        first = F.to_date(F.concat("month", F.lit("-01")))
        span = monthly.groupBy(*keys).agg(F.min(first).alias("lo"), F.max(first).alias("hi"))
        months = span.select(*keys, F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("d"))
        grid = months.select(*keys, F.date_format("d", "yyyy-MM").alias("month"), F.lit(0).cast("bigint").alias("n"))
        monthly = (
            monthly.select(*keys, "month", "n").unionByName(grid).groupBy(*keys, "month").agg(F.sum("n").alias("n"))
        )
    group = Window.partitionBy(*keys)
    trailing = group.orderBy("month").rowsBetween(1 - n, 0)
    enough = (F.count(F.lit(1)).over(trailing) >= min_periods) & (F.count(F.lit(1)).over(group) >= min_rows)
    return monthly.withColumn("rolling_mean", F.when(enough, F.avg("n").over(trailing)))
