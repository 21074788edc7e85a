"""Profile sections: each is computed for all codes in one grouped job."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from hangarlog.functions.dates import month_key
from hangarlog.functions.labels import burden_verdict, trend_direction
from hangarlog.functions.text import keyword_tokens, normalize_phrase, strip
from hangarlog.operators.counts import top_rows
from hangarlog.operators.geo import base_key
from hangarlog.operators.ranks import exact_quantiles
from hangarlog.plans.sizing import join_small
from hangarlog.reference_data import HOUR_BANDS, UNKNOWN_PHASE, UNKNOWN_PHASE_OF

QUARTILES = (0.25, 0.5, 0.75)


def _phrase(cleaned: str) -> Column:
    return F.when(F.length(cleaned) > 3, F.col(cleaned))


def _facets() -> dict[str, Column]:
    """What a record is counted under. Arrays count once per element."""
    return {
        "phrase": _phrase("_wrong"),
        "keyword": keyword_tokens("_wrong"),
        "fix": _phrase("_fixed"),
        "fix_keyword": keyword_tokens("_fixed"),
        "base": base_key(),
        "month": F.lpad(F.month("start_date").cast("string"), 2, "0"),
        "year": F.year("start_date").cast("string"),
        "year_month": month_key("start_date"),
        "discovered": F.coalesce(F.upper(strip("discovered_code")), F.lit("")),
        "maint_type": F.coalesce(F.upper(strip("maint_type_code")), F.lit("")),
        "asset": F.col("asset_id"),
    }


# Normalised text two facets share, so that it is worked out once per record.
_CLEANED = {"_wrong": "discrepancy", "_fixed": "corrective_action"}
_REPEATED = ("keyword", "fix_keyword")


def facet_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Counts per code, facet and item: several sections from one scan.

    Every record is turned into its few (facet, item) pairs, and these are
    counted with map-side combining, so one pass and one shuffle feed all the
    count-based sections instead of one each.
    """
    facets = _facets()
    df = df.withColumns({new: normalize_phrase(old) for new, old in _CLEANED.items() if old in df.columns})
    if len(names) == 1:
        name = names[0]
        item = F.explode(facets[name]) if name in _REPEATED else facets[name]
        tagged = df.select("code", F.lit(name).alias("facet"), item.alias("item"))
    else:
        def tag(name: str, item: Column) -> Column:
            return F.struct(F.lit(name).alias("facet"), item.alias("item"))

        def tag_all(name: str) -> Column:
            words = F.coalesce(facets[name], F.array().cast("array<string>"))
            return F.transform(words, lambda w: tag(name, w))

        single = F.array(*[tag(name, facets[name]) for name in names if name not in _REPEATED])
        repeated = [tag_all(name) for name in names if name in _REPEATED]
        tagged = df.select("code", F.explode(F.concat(single, *repeated)).alias("e")).select("code", "e.*")
    return (
        tagged.where("code IS NOT NULL AND item IS NOT NULL")
        .groupBy("code", "facet", "item").agg(F.count(F.lit(1)).alias("n"))
    )


def _one(df: DataFrame, name: str) -> DataFrame:
    return facet_counts(df, [name]).select("code", "item", "n")


def top_phrases(df: DataFrame, facet: str = "phrase", n: int = 5) -> DataFrame:
    return top_rows(_one(df, facet), n, by="code", rank="rank")


def top_keywords(df: DataFrame, facet: str = "keyword", n: int = 10) -> DataFrame:
    return top_rows(_one(df, facet), n, by="code", rank="rank")


def base_distribution(df: DataFrame, n: int = 10) -> DataFrame:
    return top_rows(_one(df, "base"), n, by="code", rank="rank")


def year_counts(df: DataFrame) -> DataFrame:
    return (
        df.where("start_date IS NOT NULL AND code IS NOT NULL")
        .groupBy("code", F.year("start_date").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    )


def year_month(df: DataFrame) -> DataFrame:
    return (
        df.where("start_date IS NOT NULL AND code IS NOT NULL")
        .groupBy("code", F.year("start_date").alias("year"), F.month("start_date").alias("month"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def year_month_wide(df: DataFrame) -> DataFrame:
    """One row per code and year with twelve month columns."""
    m = F.month("start_date")
    return (
        df.where("start_date IS NOT NULL AND code IS NOT NULL")
        .groupBy("code", F.year("start_date").alias("year"))
        .agg(*[F.count_if(m == i).alias(f"m{i:02d}") for i in range(1, 13)])
    )


def phase_text(code: Column, phase: Column) -> Column:
    return F.coalesce(
        phase,
        F.when((code == "") | code.isNull(), UNKNOWN_PHASE).otherwise(F.format_string(UNKNOWN_PHASE_OF, code)),
    )


def with_phase(counts: DataFrame, column: str, phases: DataFrame) -> DataFrame:
    """Phase name of a code column. Spark knows the size of an inline phase
    table and broadcasts it by itself."""
    return (
        counts.join(phases.withColumnRenamed("phase_code", column), column, "left")
        .withColumn("phase", phase_text(F.col(column), F.col("phase")))
    )


def phase_histogram(df: DataFrame, facet: str, phases: DataFrame) -> DataFrame:
    """Records per code and phase. Codes are counted before they are named."""
    counts = _one(df, facet)
    return with_phase(counts, "item", phases).groupBy("code", "phase").agg(F.sum("n").alias("n"))


def affected_assets(df: DataFrame) -> DataFrame:
    return df.where("code IS NOT NULL").groupBy("code").agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_distinct("asset_id").alias("affected_assets"),
        F.min("start_date").alias("first_date"),
        F.max("start_date").alias("last_date"),
    )


def labor_burden(df: DataFrame, fleet_of: DataFrame | None = None) -> DataFrame:
    """Hours per code and how they compare to the fleet.

    burden_index is the code's share of fleet hours over its share of fleet
    records, both over rows with hours. The fleet is df, or ``fleet_of`` where
    df holds some codes only.
    """
    known = df.where("labor_hours IS NOT NULL AND code IS NOT NULL")
    per_code = known.groupBy("code").agg(
        F.sum("labor_hours").alias("total_hours"),
        F.avg("labor_hours").alias("mean_hours"),
        F.max("labor_hours").alias("max_hours"),
        F.count("labor_hours").alias("n"),
    )
    if fleet_of is None:
        fleet = per_code.agg(F.struct(F.sum("total_hours").alias("hours"), F.sum("n").alias("n"))).scalar()
    else:
        every = fleet_of.where("labor_hours IS NOT NULL AND code IS NOT NULL")
        fleet = every.agg(F.struct(F.sum("labor_hours").alias("hours"), F.count("labor_hours").alias("n"))).scalar()
    medians = exact_quantiles(known, "labor_hours", [0.5], by=["code"]).withColumnRenamed("q0", "median_hours")
    labor_share = F.col("total_hours") / F.nullif(F.col("fleet.hours"), F.lit(0.0))
    record_share = F.col("n") / F.col("fleet.n")
    return (
        per_code.join(medians, "code").withColumn("fleet", fleet)
        .select(
            "code", "n", "total_hours", "mean_hours", "median_hours", "max_hours",
            (F.col("fleet.hours") / F.col("fleet.n")).alias("fleet_mean_hours"),
            (100.0 * labor_share).alias("labor_share_pct"),
            (100.0 * record_share).alias("record_share_pct"),
            (labor_share / record_share).alias("burden_index"),
        )
        .withColumn("verdict", burden_verdict("burden_index"))
    )


def quartile_edges(df: DataFrame, column: str = "flight_hours") -> DataFrame:
    """One row with the fleet quartiles q0, q1, q2."""
    return exact_quantiles(df, column, QUARTILES)


def _spread(edges: Sequence[float | None]) -> bool:
    return None not in edges and len(set(edges)) == len(edges)


def hour_bands(df: DataFrame, column: str = "flight_hours",
               edges: Sequence[float] | None = None, fleet_of: DataFrame | None = None) -> DataFrame:
    """Records per code in four bands between the fleet's quartiles.

    Bands are closed on the right, the first starts above -1, empty ones are
    listed. The three edges are looked up first unless given. Only when they
    tie are edges taken per code, and a code whose own edges tie has no bands.
    """
    known = df.where((F.col(column).isNotNull()) & F.col("code").isNotNull())
    if edges is None:
        row = quartile_edges(df if fleet_of is None else fleet_of, column).first()
        edges = list(row) if row else [None]
    if _spread(edges):
        known = known.withColumns({f"q{i}": F.lit(float(e)) for i, e in enumerate(edges)})
    else:
        own = exact_quantiles(known, column, QUARTILES, by=["code"]).where("q0 < q1 AND q1 < q2")
        known = join_small(known, own, ["code"])
    v = F.col(column)
    band = (
        F.when(v <= -1, None).when(v <= F.col("q0"), 0).when(v <= F.col("q1"), 1)
        .when(v <= F.col("q2"), 2).otherwise(3)
    )
    wide = known.groupBy("code", "q0", "q1", "q2").agg(*[F.count_if(band == i).alias(f"b{i}") for i in range(4)])
    rows = F.array(*[
        F.struct(F.lit(i).alias("band_no"), F.lit(HOUR_BANDS[i]).alias("band"), F.col(f"b{i}").alias("n"))
        for i in range(4)
    ])
    whole = lambda q: F.format_string("%.0f", F.bround(F.col(q), 0))
    text = (
        F.when(F.col("band_no") == 0, F.format_string("Low (<%s hrs)", whole("q0")))
        .when(F.col("band_no") == 1, F.format_string("Mid-Low (%s-%s)", whole("q0"), whole("q1")))
        .when(F.col("band_no") == 2, F.format_string("Mid-High (%s-%s)", whole("q1"), whole("q2")))
        .otherwise(F.format_string("High (>%s hrs)", whole("q2")))
    )
    return (
        wide.select("code", "q0", "q1", "q2", F.explode(rows).alias("e"))
        .select("code", "q0", "q1", "q2", "e.*").withColumn("label", text).drop("q0", "q1", "q2")
    )


def data_end(df: DataFrame) -> Column:
    """The last start date of the whole table, as a scalar subquery."""
    return df.agg(F.max("start_date")).scalar()


def trend_of(years: DataFrame, end: Column) -> DataFrame:
    """First half against last half of a code's full years.

    The code's last year is left out when the data stop in it before 31
    December. With an odd number of years the middle one is in neither half.
    """
    partial = (F.year(end) == F.col("year")) & ~((F.month(end) == 12) & (F.dayofmonth(end) == 31))
    group = Window.partitionBy("code")
    full = (
        years.withColumns({"year_count": F.count(F.lit(1)).over(group), "partial": partial})
        .where("year_count >= 3")
        .withColumn("excluded_year", F.max(F.when(F.col("partial"), F.col("year"))).over(group))
        .where("NOT partial")
        .withColumns({"k": F.row_number().over(group.orderBy("year")), "years": F.count(F.lit(1)).over(group)})
        .where("years >= 3")
    )
    half = F.floor(F.col("years") / 2)
    change = 100.0 * (F.col("recent_records") - F.col("earlier_records")) / F.nullif("earlier_records", F.lit(0))
    return (
        full.groupBy("code").agg(
            F.min("year").alias("first_full_year"),
            F.max("year").alias("last_full_year"),
            F.sum(F.when(F.col("k") <= half, F.col("n")).otherwise(0)).alias("earlier_records"),
            F.sum(F.when(F.col("k") > F.col("years") - half, F.col("n")).otherwise(0)).alias("recent_records"),
            F.max("excluded_year").alias("excluded_year"),
        )
        .withColumn("change_pct", change)
        .withColumn("direction", trend_direction("change_pct"))
    )


def trend(df: DataFrame, end: str | dt.date | None = None) -> DataFrame:
    """Trend of every code; ``end`` is the day the data stop, by default their last."""
    stop = data_end(df) if end is None else F.lit(str(end)).cast("date")
    return trend_of(year_counts(df), stop)
