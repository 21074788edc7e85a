"""Drift of what is reported: monthly distributions against a reference period, and sequential change detection."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from hangarlog.operators.classify import text_tokens


def _named(facet: str) -> Callable[[Column], Column]:
    return lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("item"))


def monthly_counts(records: DataFrame, facets: Mapping[str, Column | str], date: str = "start_date") -> DataFrame:
    """facet, month (first day), item, n over all facets in one scan; null items and dates don't count.

    A facet that is an array counts each of its entries.
    """
    parts = []
    for name, value in facets.items():
        value = F.col(value) if isinstance(value, str) else value
        kind = records.select(value.alias("v")).schema["v"].dataType.typeName()
        items = value.cast("array<string>") if kind == "array" else F.array(value.cast("string"))
        parts.append(F.transform(F.coalesce(items, F.array().cast("array<string>")), _named(name)))
    rows = records.where(F.col(date).isNotNull()).select(F.trunc(date, "MM").alias("month"), F.explode(F.concat(*parts)).alias("e"))
    return rows.select("e.facet", "month", "e.item").where("item IS NOT NULL").groupBy("facet", "month", "item").agg(F.count(F.lit(1)).alias("n"))


def text_facet(text: str) -> Column:
    """The words of a text, as a facet of its style."""
    return text_tokens(text)


def monthly_distance(counts: DataFrame, until: str) -> DataFrame:
    """facet, month, n, new_items and distance of each month from the distribution over all months before `until`.

    distance is the Jensen-Shannon distance (base 2, so 0 to 1) between the
    month's and the reference's shares; a month in the reference period is
    compared with the whole period, itself included. new_items is the share of
    a month's count whose item the reference doesn't have. Months without any
    count have no row. Without reference counts the distance is null and all
    items are new.

    The sums need only items that the month has: what the month lacks adds
    half of the reference share that is missing.
    """
    base = counts.where(F.col("month") < F.lit(until).cast("date")).groupBy("facet", "item").agg(F.sum("n").alias("base_n"))
    base_total = base.groupBy("facet").agg(F.sum("base_n").alias("base_total"))
    month_total = counts.groupBy("facet", "month").agg(F.sum("n").alias("total"))
    rows = counts.join(month_total, ["facet", "month"]).join(base, ["facet", "item"], "left").join(base_total, "facet", "left")
    p, q = F.col("n") / F.col("total"), F.coalesce(F.col("base_n") / F.col("base_total"), F.lit(0.0))
    middle = (p + q) / 2
    terms = 0.5 * p * F.log2(p / middle) + F.when(q > 0, 0.5 * q * F.log2(q / middle)).otherwise(0.0)
    found = rows.groupBy("facet", "month").agg(F.max("total").alias("n"), F.sum(F.when(F.col("base_n").isNull(), F.col("n")).otherwise(0)).alias("fresh"),
                                               F.sum(terms).alias("shared"), F.sum(q).alias("met"), F.max("base_total").alias("base_total"))
    divergence = F.col("shared") + 0.5 * F.greatest(1.0 - F.col("met"), F.lit(0.0))
    distance = F.when(F.col("base_total").isNotNull(), F.sqrt(F.greatest(divergence, F.lit(0.0))))
    return found.select("facet", "month", "n", (F.col("fresh") / F.col("n")).alias("new_items"), distance.alias("distance"))


def cusum(series: DataFrame, value: str, until: str, by: str = "facet", order: str = "month", slack: float = 0.5, limit: float = 5.0) -> DataFrame:
    """Two-sided CUSUM of a series per `by`: adds z, upper, lower and alarm.

    z is the value in standard deviations from its mean over the rows before
    `until`; upper and lower are the running sums of z beyond the slack, which
    never fall below 0, and alarm says that one of them has passed the limit.
    Each sum is its plain running total less the least total so far, so both
    are window functions. A series is as long as the calendar. Null values
    count as no deviation. Without two different values before `until` z is
    null and sums stay 0.
    """
    early = F.col(order) < F.lit(until).cast("date")
    whole = Window.partitionBy(by)
    mean, spread = F.avg(F.when(early, F.col(value))).over(whole), F.stddev_samp(F.when(early, F.col(value))).over(whole)
    so_far = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    z = F.when(spread > 0, (F.col(value) - mean) / spread)
    out = series.withColumn("z", z)
    for name, sign in (("upper", 1), ("lower", -1)):
        total = F.sum(F.coalesce(sign * F.col("z") - slack, F.lit(0.0))).over(so_far)
        out = out.withColumn("_total", total).withColumn(name, F.col("_total") - F.least(F.min("_total").over(so_far), F.lit(0.0))).drop("_total")
    return out.withColumn("alarm", (F.col("upper") > limit) | (F.col("lower") > limit))


def first_alarms(watched: DataFrame, by: str = "facet", order: str = "month") -> DataFrame:
    """The first alarm of each series, with its direction, and since when the sum that raised it has been above 0."""
    so_far = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rising = F.col("upper") >= F.col("lower")
    level = F.when(rising, F.col("upper")).otherwise(F.col("lower"))
    quiet_up, quiet_down = (F.max(F.when(F.col(side) <= 0, F.col(order))).over(so_far) for side in ("upper", "lower"))
    marked = watched.withColumns({"direction": F.when(rising, "up").otherwise("down"), "level": level, "quiet": F.when(rising, quiet_up).otherwise(quiet_down)})
    return marked.where("alarm").groupBy(by).agg(F.min_by(F.struct(order, "direction", "level", "quiet"), order).alias("e")).select(
        by, F.col(f"e.{order}").alias("alarm_at"), "e.direction", "e.level", F.col("e.quiet").alias("quiet_until"))
