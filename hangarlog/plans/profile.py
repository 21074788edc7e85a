"""The whole profile of every code, one row per code."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from hangarlog.functions.dates import month_name
from hangarlog.operators.geo import concentration, geolocate_counts, with_site
from hangarlog.operators.quality import require_columns
from hangarlog.operators.related import cooccurring
from hangarlog.operators.sections import (
    affected_assets, data_end, facet_counts, hour_bands, labor_burden, trend_of, with_phase,
)
from hangarlog.plans.sizing import stored
from hangarlog.reference_data import UNKNOWN_DESCRIPTION, discovery_phases, gazetteer as known_sites, maintenance_phases
from hangarlog.session import ensure_checkpoint_dir

RANKED = {"phrase": 5, "keyword": 10, "fix": 5, "fix_keyword": 10, "base": 10}
FACETS = [*RANKED, "month", "year", "year_month", "discovered", "maint_type"]


def _collected(df: DataFrame, name: str, order: Column, **fields: Column) -> DataFrame:
    """One array of structs per code, in the given order."""
    entry = F.struct(order.alias("_o"), F.struct(*[c.alias(n) for n, c in fields.items()]).alias("_e"))
    gathered = df.groupBy("code").agg(F.sort_array(F.collect_list(entry)).alias("_l"))
    return gathered.select("code", F.transform("_l", lambda e: e["_e"]).alias(name))


def _ranked(counts: DataFrame, item: str) -> DataFrame:
    order = Window.partitionBy("code").orderBy(F.desc("n"), F.asc(item))
    return counts.withColumn("rank", F.row_number().over(order))


def profile(records: DataFrame, dictionary: DataFrame | None = None, gazetteer: DataFrame | None = None,
            discovery: DataFrame | None = None, maintenance: DataFrame | None = None,
            codes: Sequence[str] | None = None, end: str | dt.date | None = None) -> DataFrame:
    """Why, when, where, at what cost and with what each code occurs.

    The count-based sections come from one table of counts per code, facet
    and item, which is checkpointed, so a lost executor does not bring the
    scan behind it back; the others read a few columns that are stored once. The sections meet in one grouping by code instead of
    a join each. ``codes`` restricts the scans of all sections to these codes'
    records and jobs; only fleet totals, which are a few sums, then cover all
    records. A code without records has a row with total 0.
    """
    spark = records.sparkSession
    require_columns(records)
    sites = known_sites(spark) if gazetteer is None else gazetteer
    discovery = discovery_phases(spark) if discovery is None else discovery
    maintenance = maintenance_phases(spark) if maintenance is None else maintenance
    ensure_checkpoint_dir(spark)
    wanted = None if codes is None else [c.strip().upper() for c in codes]
    mine = records if wanted is None else records.where(F.col("code").isin(*wanted))
    facets = facet_counts(mine, FACETS).checkpoint()
    if wanted is None:
        # What the other sections read, a dozen times in all; the texts behind it are read once, above.
        mine = records = stored(records.select("code", "asset_id", "start_date", "labor_hours", "flight_hours", "job_id"))
    of = lambda name: facets.where(F.col("facet") == name).select("code", "item", "n")
    item, n, rank = F.col("item"), F.col("n"), F.col("rank")

    order = Window.partitionBy("code", "facet").orderBy(F.desc("n"), F.asc("item"))
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in RANKED.items() for x in kv]), F.col("facet"))
    best = (
        facets.where(F.col("facet").isin(*RANKED)).withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= max(RANKED.values())).where(F.col("rank") <= limit)
    )
    tops = best.groupBy("code").agg(*[
        F.transform(
            F.sort_array(F.collect_list(F.when(F.col("facet") == name, F.struct("rank", "item", "n")))),
            lambda e: F.struct(e["item"].alias("item"), e["n"].alias("n")),
        ).alias(f"top_{name}")
        for name in RANKED
    ])

    in_month = lambda i: F.coalesce(F.sum(F.when(item == f"{i:02d}", n)), F.lit(0).cast("bigint"))
    months = of("month").groupBy("code").agg(F.array(*[
        F.struct(month_name(F.lit(i)).alias("item"), in_month(i).alias("n")) for i in range(1, 13)
    ]).alias("months"))
    years = of("year").select("code", item.cast("int").alias("year"), "n")
    year_list = _collected(years, "years", F.col("year"), item=F.col("year"), n=n)
    matrix = _collected(of("year_month"), "year_months", item, year=F.left(item, F.lit(4)).cast("int"),
                        month=F.right(item, F.lit(2)).cast("int"), n=n)

    bases = of("base").withColumnRenamed("item", "base_key")
    placed = with_site(bases, sites)
    per_site = placed.where("site IS NOT NULL").groupBy("code", "site", "lat", "lon").agg(F.sum("n").alias("n"))
    site_list = _collected(_ranked(per_site, "site"), "sites", rank, site=F.col("site"), lat=F.col("lat"), lon=F.col("lon"), n=n)
    cover = placed.groupBy("code").agg(F.struct(
        F.coalesce(F.sum(F.when(F.col("site").isNotNull(), n)), F.lit(0).cast("bigint")).alias("mapped"),
        F.sum("n").alias("total"),
    ).alias("site_coverage"))
    everywhere = None if wanted is None else geolocate_counts(records)
    dense = _ranked(concentration(bases, "base_key", everywhere), "base_key").where("rank <= 8")
    dense_list = _collected(dense, "concentration", rank, base=F.col("base_key"), records=n,
                            expected=F.col("expected"), index=F.col("index"))

    def phase_list(name: str, phases: DataFrame) -> DataFrame:
        per_phase = with_phase(of(name), "item", phases).groupBy("code", "phase").agg(F.sum("n").alias("n"))
        return _collected(_ranked(per_phase, "phase"), name, rank, item=F.col("phase"), n=n)

    stop = data_end(records) if end is None else F.lit(str(end)).cast("date")
    burden = labor_burden(mine, None if wanted is None else records)
    way = trend_of(years, stop)
    bands = _collected(hour_bands(mine, fleet_of=records), "hour_bands", F.col("band_no"), band=F.col("band"), label=F.col("label"), n=n)
    together = _collected(cooccurring(records, codes=wanted), "cooccurring", rank, item=F.col("other"), n=n)
    packed = lambda df, name: df.select("code", F.struct(*[c for c in df.columns if c != "code"]).alias(name))

    sections = [
        packed(affected_assets(mine), "totals"), tops, months, year_list, matrix, site_list, cover, dense_list,
        phase_list("discovered", discovery), phase_list("maint_type", maintenance), packed(burden, "labor"),
        packed(way, "trend"), bands, together,
    ]
    stacked = sections[0]
    for section in sections[1:]:
        stacked = stacked.unionByName(section, allowMissingColumns=True)
    if wanted is not None:
        asked = spark.createDataFrame([(c,) for c in wanted], "code string")
        stacked = stacked.unionByName(asked, allowMissingColumns=True)
    columns = [c for c in stacked.columns if c != "code"]
    rows = stacked.groupBy("code").agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns])
    if dictionary is None:
        described = rows.withColumn("description", F.lit(None).cast("string"))
    else:
        described = rows.join(dictionary.select("code", "description"), "code", "left")
    none = F.lit(0).cast("bigint")
    return described.select(
        "code", F.coalesce("description", F.lit(UNKNOWN_DESCRIPTION)).alias("description"),
        F.coalesce("totals.total_records", none).alias("total_records"),
        F.coalesce("totals.affected_assets", none).alias("affected_assets"),
        F.col("totals.first_date").alias("first_date"), F.col("totals.last_date").alias("last_date"),
        *[c for c in columns if c != "totals"],
    )
