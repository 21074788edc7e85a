"""Sites: substring lookup of messy base names, roll-up, concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hangarlog.functions.text import blank_to_null


def base_key(c: Column | str = "base") -> Column:
    """The spelling bases are grouped on; null where blank."""
    return F.upper(blank_to_null(c))


def base_counts(df: DataFrame) -> DataFrame:
    """Records per code and base."""
    return (
        df.select("code", base_key().alias("base_key")).where("base_key IS NOT NULL")
        .groupBy("code", "base_key").agg(F.count(F.lit(1)).alias("n"))
    )


def site_of(bases: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """The first site whose keyword occurs in each base_key; bases without one are left out.

    Every distinct base is cut into its substrings of the lengths that keywords
    have, and these are joined to the keywords; the smallest rank wins. The
    gazetteer may have any length.
    """
    lengths = gazetteer.agg(F.collect_set(F.length("keyword")).alias("lengths")).scalar()  # as many as a keyword has characters
    each = bases.select("base_key").distinct().withColumn("n", F.explode(lengths)).where("n <= length(base_key)")
    cut = each.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("base_key") - F.col("n") + 1))).select(
        "base_key", F.substring("base_key", F.col("at"), F.col("n")).alias("keyword"))
    first = F.min(F.struct("rk", "name", "lat", "lon")).alias("hit")
    return (
        cut.join(gazetteer.select("rk", "keyword", "name", "lat", "lon"), "keyword").groupBy("base_key").agg(first)
        .select("base_key", F.col("hit.name").alias("site"), "hit.lat", "hit.lon")
    )


def with_site(counts: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Add the first site whose keyword occurs in the base, null if none does."""
    return counts.join(site_of(counts, gazetteer), "base_key", "left").select(*counts.columns, "site", "lat", "lon")


def geolocate_counts(df: DataFrame) -> DataFrame:
    """Records of all codes per base."""
    return (
        df.where("code IS NOT NULL").select(base_key().alias("base_key")).where("base_key IS NOT NULL")
        .groupBy("base_key").agg(F.count(F.lit(1)).alias("n"))
    )


def geolocate(df: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Every distinct base with its number of records and its site."""
    counts = (
        df.select(base_key().alias("base_key")).where("base_key IS NOT NULL")
        .groupBy("base_key").agg(F.count(F.lit(1)).alias("n"))
    )
    return with_site(counts, gazetteer)


def geo_rollup(df: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Records per code and mapped site."""
    return (
        with_site(base_counts(df), gazetteer).where("site IS NOT NULL")
        .groupBy("code", "site", "lat", "lon").agg(F.sum("n").alias("n"))
    )


def geo_coverage(df: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Per code: records at a mapped site, and records with any base."""
    return (
        with_site(base_counts(df), gazetteer).groupBy("code")
        .agg(F.sum(F.when(F.col("site").isNotNull(), F.col("n")).otherwise(0)).alias("mapped"),
             F.sum("n").alias("total"))
    )


def concentration(counts: DataFrame, place: str, places: DataFrame | None = None) -> DataFrame:
    """Records of a code at a place against what the place's share predicts.

    Works on counts per code and place. The totals of a code and of a place
    are window sums over those counts, so nothing is joined. Where counts
    holds some codes only, ``places`` has the place totals (n) of all codes.
    """
    fleet = (counts if places is None else places).agg(F.sum("n")).scalar()
    of_code = F.sum("n").over(Window.partitionBy("code"))
    if places is None:
        totalled = counts.withColumn("place_total", F.sum("n").over(Window.partitionBy(place)))
    else:
        totalled = counts.join(places.select(place, F.col("n").alias("place_total")), place)
    return (
        totalled.withColumn("code_total", of_code)
        .withColumn("expected", F.col("code_total") * (F.col("place_total") / fleet))
        .where("expected > 0")
        .withColumn("index", F.col("n") / F.col("expected"))
        .drop("code_total", "place_total")
    )


def base_concentration(df: DataFrame, n: int = 8) -> DataFrame:
    """The n busiest bases of each code with their concentration index."""
    ranked = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("n"), F.asc("base_key")))
    return (
        concentration(base_counts(df), "base_key").withColumn("rank", ranked).where(F.col("rank") <= n)
        .withColumnRenamed("n", "records")
    )


def geo_concentration(df: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Mapped sites of each code with their concentration index.

    Counts are keyed by site from the start, so index and map position belong
    to the same place. Unmapped bases count towards the totals.
    """
    placed = (
        with_site(base_counts(df), gazetteer)
        .groupBy("code", F.coalesce("site", F.lit("")).alias("site"))
        .agg(F.first("lat", ignorenulls=True).alias("lat"), F.first("lon", ignorenulls=True).alias("lon"),
             F.sum("n").alias("n"))
    )
    return concentration(placed, "site").where("site <> ''").withColumnRenamed("n", "records")


def hotspots(concentrated: DataFrame, floor: float = 1.5, least: int = 3) -> DataFrame:
    """Places that are genuinely concentrated."""
    return concentrated.where((F.col("index") >= floor) & (F.col("records") >= least))
