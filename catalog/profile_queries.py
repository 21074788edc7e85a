"""Profile sections, sites, related codes, and the assembled profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog.base import PHRASE, VIEWS, query, sql
from hangarlog.functions import arrays
from hangarlog.functions.text import system_of
from hangarlog.operators import geo, narrative, related, sections, sketches
from hangarlog.plans.profile import profile
from hangarlog.plans.sizing import keep
from hangarlog.reference_data import discovery_phases, maintenance_phases
from hangarlog.sources import star


def ranked(source: str, limit: int, keys: str = "code", item: str = "item") -> str:
    return f"""
    SELECT code, item, n, cast(rank as int) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, {item}) AS rank FROM ({source}) c) r
    WHERE rank <= {limit}"""


def phrases(column: str) -> str:
    return f"""SELECT * FROM (SELECT code, {PHRASE.format(column)} AS item, count(*) AS n FROM records GROUP BY 1, 2) p
               WHERE length(item) > 3"""


@query("a6_affected_assets", sql("records", """
    SELECT code, count(*) AS total_records, count(DISTINCT asset_id) AS affected_assets,
           cast(min(start_date) as string) AS first_date, cast(max(start_date) as string) AS last_date
    FROM records GROUP BY 1"""))
def _(spark, d):
    return sections.affected_assets(star.records(spark, d)).withColumns(
        {c: F.col(c).cast("string") for c in ("first_date", "last_date")})


@query("a10_top_phrases", sql("records", ranked(phrases("discrepancy"), 5)))
def _(spark, d):
    return sections.top_phrases(star.records(spark, d))


@query("a10_top_corrective_actions", sql("records", ranked(phrases("corrective_action"), 5)))
def _(spark, d):
    return sections.top_phrases(star.records(spark, d), "fix")


@query("a11_top_keywords", sql("tokens", ranked("SELECT code, token AS item, count(*) AS n FROM tokens GROUP BY 1, 2", 10)))
def _(spark, d):
    return sections.top_keywords(star.records(spark, d))


EDGES = "SELECT unnest(quantile_cont(flight_hours, [0.25, 0.5, 0.75])) AS q FROM records"


@query("a12_quartile_edges", sql("records", """
    SELECT quantile_cont(flight_hours, 0.25) AS q0, quantile_cont(flight_hours, 0.5) AS q1,
           quantile_cont(flight_hours, 0.75) AS q2 FROM records"""))
def _(spark, d):
    return sections.quartile_edges(star.records(spark, d))


@query("a12_quartile_edges_per_code", sql("records", """
    SELECT code, quantile_cont(labor_hours, 0.25) AS q0, quantile_cont(labor_hours, 0.5) AS q1,
           quantile_cont(labor_hours, 0.75) AS q2 FROM records GROUP BY 1"""))
def _(spark, d):
    from hangarlog.operators.ranks import exact_quantiles
    return exact_quantiles(star.records(spark, d), "labor_hours", sections.QUARTILES, ["code"])


# Sketch answers vary within their bounds, so what is compared is the exact side and that the bounds hold.
@query("a12_sketched_edges", sql("records", """
    SELECT substr(code, 1, 2) AS system, count(*) AS n, count(flight_hours) AS with_hours, count(DISTINCT asset_id) AS assets,
           true AS assets_within, true AS edges_within FROM records GROUP BY 1"""))
def _(spark, d):
    recs = star.records(spark, d)
    cells = sketches.sketch_cells(recs, {"code": F.col("code"), "month": F.date_trunc("month", "start_date")}, {"assets": F.col("asset_id")}, {"hours": F.col("flight_hours")})
    system = recs.withColumn("system", system_of("code"))
    found = keep(sketches.read_off(sketches.merge_cells(cells, {"system": system_of("code")}), sections.QUARTILES))
    errors = sketches.rank_errors(system, F.col("flight_hours"), found, ["system"], sections.QUARTILES, "hours_q")
    exact = system.groupBy("system").agg(F.count_distinct("asset_id").alias("assets"))
    close = F.abs(F.col("assets_distinct") - F.col("assets")) <= F.greatest(F.lit(1.0), sketches.DISTINCT_ERROR * F.col("assets"))
    return found.join(exact, "system").join(errors, "system", "left").select(
        "system", F.col("rows").alias("n"), F.col("hours_n").alias("with_hours"), "assets", close.alias("assets_within"),
        (F.coalesce("rank_error", F.lit(0.0)) <= 2 * sketches.RANK_ERROR).alias("edges_within"))


BANDS = """
    SELECT c.code, b.band_no, b.band, count(r.code) AS n
    FROM (SELECT DISTINCT code FROM banded) c
    CROSS JOIN (SELECT * FROM (VALUES (0,'Low'), (1,'Mid-Low'), (2,'Mid-High'), (3,'High')) v(band_no, band)) b
    LEFT JOIN banded r ON r.code = c.code AND r.band_no = b.band_no GROUP BY 1, 2, 3"""


@query("a13_hour_bands", sql("records", BANDS,
    edges="""SELECT quantile_cont(flight_hours, 0.25) AS q0, quantile_cont(flight_hours, 0.5) AS q1,
                    quantile_cont(flight_hours, 0.75) AS q2 FROM records""",
    banded="""SELECT code, CASE WHEN flight_hours <= -1 THEN NULL WHEN flight_hours <= q0 THEN 0
                     WHEN flight_hours <= q1 THEN 1 WHEN flight_hours <= q2 THEN 2 ELSE 3 END AS band_no
              FROM records, edges"""))
def _(spark, d):
    return sections.hour_bands(star.records(spark, d)).drop("label")


@query("a14_month_histogram", sql("records", """
    SELECT c.code, cast(m as int) AS month, count(r.code) AS n
    FROM (SELECT DISTINCT code FROM records) c CROSS JOIN range(1, 13) t(m)
    LEFT JOIN records r ON r.code = c.code AND month(r.start_date) = m GROUP BY 1, 2"""))
def _(spark, d):
    from hangarlog.operators.counts import seasonality
    return seasonality(star.records(spark, d), "code").drop("month_name")


@query("a15_year_histogram", sql("records", """
    SELECT code, cast(year(start_date) as int) AS year, count(*) AS n FROM records GROUP BY 1, 2"""))
def _(spark, d):
    return sections.year_counts(star.records(spark, d))


@query("a16_labor_burden", sql("records", """
    SELECT code, n, total_hours, mean_hours, median_hours, max_hours, fleet_hours / fleet_n AS fleet_mean_hours,
           100.0::double * (total_hours / fleet_hours) AS labor_share_pct,
           100.0::double * (n / fleet_n) AS record_share_pct,
           (total_hours / fleet_hours) / (n / fleet_n) AS burden_index,
           CASE WHEN (total_hours / fleet_hours) / (n / fleet_n) >= 1.25 THEN 'expensive'
                WHEN (total_hours / fleet_hours) / (n / fleet_n) <= 0.8 THEN 'cheap' ELSE 'typical' END AS verdict
    FROM (SELECT code, count(labor_hours) AS n, sum(labor_hours) AS total_hours, avg(labor_hours) AS mean_hours,
                 median(labor_hours) AS median_hours, max(labor_hours) AS max_hours FROM records GROUP BY 1) c,
         (SELECT sum(labor_hours) AS fleet_hours, count(labor_hours) AS fleet_n FROM records) f"""))
def _(spark, d):
    return sections.labor_burden(star.records(spark, d))


@query("a17_base_distribution", sql("base_n", ranked("SELECT code, base_key AS item, n FROM base_n", 10)))
def _(spark, d):
    return sections.base_distribution(star.records(spark, d))


@query("j4_geolocate", sql("base_n located", """
    SELECT base_key, sum(n)::bigint AS n, site, lat, lon FROM base_n JOIN located USING (base_key) GROUP BY ALL"""))
def _(spark, d):
    return geo.geolocate(star.records(spark, d), star.gazetteer(spark, d))


@query("a18_geo_rollup", sql("base_n located", """
    SELECT code, site, lat, lon, sum(n)::bigint AS n FROM base_n JOIN located USING (base_key)
    WHERE site IS NOT NULL GROUP BY ALL"""))
def _(spark, d):
    return geo.geo_rollup(star.records(spark, d), star.gazetteer(spark, d))


@query("a18_geo_coverage", sql("base_n located", """
    SELECT code, coalesce(sum(n) FILTER (site IS NOT NULL), 0)::bigint AS mapped, sum(n)::bigint AS total
    FROM base_n JOIN located USING (base_key) GROUP BY 1"""))
def _(spark, d):
    return geo.geo_coverage(star.records(spark, d), star.gazetteer(spark, d))


CONC = """
    SELECT c.code, c.place, c.n AS records, code_n * (place_n / fleet_n) AS expected,
           c.n / (code_n * (place_n / fleet_n)) AS "index"
    FROM counted c JOIN (SELECT code, sum(n) AS code_n FROM counted GROUP BY 1) a USING (code)
         JOIN (SELECT place, sum(n) AS place_n FROM counted GROUP BY 1) b USING (place),
         (SELECT sum(n) AS fleet_n FROM counted) f"""
TOP8 = "SELECT *, cast(row_number() OVER (PARTITION BY code ORDER BY records DESC, place) as int) AS rank FROM conc"
BY_BASE = {"counted": "SELECT code, base_key AS place, n FROM base_n", "conc": CONC}


@query("a19_base_concentration", sql("base_n", f"""
    SELECT code, place AS base_key, records, expected, "index", rank FROM ({TOP8}) x WHERE rank <= 8""", **BY_BASE))
def _(spark, d):
    return geo.base_concentration(star.records(spark, d))


@query("j9_subset_against_fleet", sql("base_n", "SELECT code, place AS base_key, records AS n, expected, \"index\" FROM conc", **BY_BASE))
def _(spark, d):
    return geo.concentration(geo.base_counts(star.records(spark, d)), "base_key")


@query("o6_hotspots_by_index", sql("base_n", f"""
    SELECT code, place AS base_key, records, "index" FROM ({TOP8}) x
    WHERE rank <= 8 AND "index" >= 1.5 AND records >= 3 ORDER BY "index" DESC, code, place""", **BY_BASE))
def _(spark, d):
    hot = geo.hotspots(geo.base_concentration(star.records(spark, d)))
    return hot.select("code", "base_key", "records", "index").orderBy(F.desc("index"), "code", "base_key")


@query("j10_geo_concentration", sql("base_n located", """
    SELECT conc.code, place AS site, lat, lon, records, expected, "index"
    FROM conc JOIN (SELECT DISTINCT site, lat, lon FROM located) l ON place = site WHERE place <> ''""",
    counted="""SELECT code, coalesce(site, '') AS place, sum(n)::bigint AS n FROM base_n JOIN located USING (base_key)
               GROUP BY 1, 2""", conc=CONC))
def _(spark, d):
    return geo.geo_concentration(star.records(spark, d), star.gazetteer(spark, d))


YEARS = {
    "ends": "SELECT max(start_date) AS stop FROM records",
    "years": "SELECT code, cast(year(start_date) as int) AS year, count(*) AS n FROM records GROUP BY 1, 2",
    "marked": """
        SELECT *, year = year(stop) AND NOT (month(stop) = 12 AND day(stop) = 31) AS partial,
               count(*) OVER (PARTITION BY code) AS year_count FROM years, ends""",
    "full_years": """
        SELECT *, row_number() OVER (PARTITION BY code ORDER BY year) AS k, count(*) OVER (PARTITION BY code) AS m
        FROM marked WHERE NOT partial AND year_count >= 3""",
    "halves": """
        SELECT f.code, min(f.year) AS first_full_year, max(f.year) AS last_full_year,
               coalesce(sum(f.n) FILTER (k <= floor(m / 2)), 0)::bigint AS earlier_records,
               coalesce(sum(f.n) FILTER (k > m - floor(m / 2)), 0)::bigint AS recent_records,
               any_value(p.year) AS excluded_year
        FROM full_years f LEFT JOIN (SELECT code, year FROM marked WHERE partial) p ON f.code = p.code
        WHERE m >= 3 GROUP BY 1""",
}


@query("a20_trend", sql("records", """
    SELECT *, CASE WHEN change_pct > 15 THEN 'rising' WHEN change_pct < -15 THEN 'falling'
                   WHEN change_pct IS NOT NULL THEN 'steady' END AS direction
    FROM (SELECT *, CASE WHEN earlier_records > 0
                    THEN 100.0::double * (recent_records - earlier_records) / earlier_records END AS change_pct FROM halves) x""",
    **YEARS))
def _(spark, d):
    return sections.trend(star.records(spark, d))


@query("w3_half_periods", sql("records", "SELECT code, earlier_records, recent_records FROM halves", **YEARS))
def _(spark, d):
    recs = star.records(spark, d)
    years = sections.year_counts(recs)
    return sections.trend_of(years, sections.data_end(recs)).select("code", "earlier_records", "recent_records")


@query("a21_year_month", sql("records", """
    SELECT code, cast(year(start_date) as int) AS year, cast(month(start_date) as int) AS month, count(*) AS n
    FROM records GROUP BY 1, 2, 3"""))
def _(spark, d):
    return sections.year_month(star.records(spark, d))


@query("a21_year_month_matrix", sql("records", "SELECT code, cast(year(start_date) as int) AS year, " + ", ".join(
    f"count(*) FILTER (month(start_date) = {i}) AS m{i:02d}" for i in range(1, 13)) + " FROM records GROUP BY 1, 2"))
def _(spark, d):
    return sections.year_month_wide(star.records(spark, d))


def phase_sql(column: str, view: str) -> str:
    return f"""
    SELECT code, coalesce(phase, CASE WHEN coalesce({column}, '') = '' THEN 'Unknown'
           ELSE concat('Unknown (', upper(trim({column})), ')') END) AS phase, count(*) AS n
    FROM records LEFT JOIN {view} ON upper(trim({column})) = phase_code GROUP BY 1, 2"""


@query("a22_discovery_phases", sql("records discovery", phase_sql("discovered_code", "discovery")))
def _(spark, d):
    return sections.phase_histogram(star.records(spark, d), "discovered", discovery_phases(spark))


@query("a22_maintenance_phases", sql("records maintenance", phase_sql("maint_type_code", "maintenance")))
def _(spark, d):
    return sections.phase_histogram(star.records(spark, d), "maint_type", maintenance_phases(spark))


TOGETHER = sql("records", """
    SELECT code, other, n, cast(rank as int) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY code ORDER BY n DESC, other) AS rank FROM (
        SELECT a.code, b.code AS other, sum(b.n)::bigint AS n FROM jc a JOIN jc b ON a.job_id = b.job_id AND a.code <> b.code
        GROUP BY 1, 2) x) y WHERE rank <= 5""", jc="SELECT job_id, code, count(*) AS n FROM records GROUP BY 1, 2")


@query("j8_cooccurring", TOGETHER)
def _(spark, d):
    return related.cooccurring(star.records(spark, d))


# The same with every job of more than three codes taken as a wide one.
@query("a23_cooccurring_wide_jobs", TOGETHER)
def _(spark, d):
    return related.cooccurring(star.records(spark, d), spread=3)


@query("o7_top_items_of_histogram", sql("records", """
    SELECT code, max(item) FILTER (rank = 1) AS first, max(item) FILTER (rank = 2) AS second FROM (
      SELECT code, item, row_number() OVER (PARTITION BY code ORDER BY n DESC, item) AS rank FROM (
        SELECT code, maint_type_code AS item, count(*) AS n FROM records GROUP BY 1, 2) x) y GROUP BY 1"""))
def _(spark, d):
    counts = sections.facet_counts(star.records(spark, d), ["maint_type"])
    bars = counts.groupBy("code").agg(F.collect_list(F.struct("item", "n")).alias("bars"))
    return bars.withColumn("top", arrays.top_items("bars", 2)).select(
        "code", arrays.entry("top", 0, "item").alias("first"), arrays.entry("top", 1, "item").alias("second"))


@query("facet_counts_one_scan", sql("records tokens base_n", f"""
    SELECT code, 'year' AS facet, cast(year(start_date) as string) AS item, count(*) AS n FROM records GROUP BY 1, 3
    UNION ALL SELECT code, 'month', lpad(cast(month(start_date) as string), 2, '0'), count(*) FROM records GROUP BY 1, 3
    UNION ALL SELECT code, 'base', base_key, n FROM base_n
    UNION ALL SELECT code, 'asset', asset_id, count(*) FROM records GROUP BY 1, 3
    UNION ALL SELECT code, 'discovered', discovered_code, count(*) FROM records GROUP BY 1, 3
    UNION ALL SELECT code, 'phrase', item, n FROM ({phrases('discrepancy')}) p
    UNION ALL SELECT code, 'keyword', token, count(*) FROM tokens GROUP BY 1, 3"""))
def _(spark, d):
    return sections.facet_counts(
        star.records(spark, d), ["year", "month", "base", "asset", "discovered", "phrase", "keyword"])


def _profile(spark, d) -> DataFrame:
    recs = star.records(spark, d)
    return profile(recs, star.code_dictionary(recs), star.gazetteer(spark, d))


# The assembled profile, flattened to one value per section.
@query("a24_profile", sql("records dictionary base_n located tokens", f"""
    SELECT t.code, coalesce(dictionary.description, 'Unknown') AS description, total_records, affected_assets, first_date,
           last_date, phrase, keyword, months, years, mapped, base_total, busiest, total_hours, direction, bands
    FROM (SELECT code, count(*) AS total_records, count(DISTINCT asset_id) AS affected_assets, sum(labor_hours) AS total_hours,
                 cast(min(start_date) as string) AS first_date, cast(max(start_date) as string) AS last_date
          FROM records GROUP BY 1) t
    LEFT JOIN dictionary USING (code)
    LEFT JOIN (SELECT code, item AS phrase FROM ({ranked(phrases("discrepancy"), 1)}) a) USING (code)
    LEFT JOIN (SELECT code, string_agg(item, ',' ORDER BY rank) AS keyword FROM (
        {ranked("SELECT code, token AS item, count(*) AS n FROM tokens GROUP BY 1, 2", 10)}) b GROUP BY 1) USING (code)
    LEFT JOIN (SELECT code, string_agg(cast(n as string), ',' ORDER BY m) AS months FROM (
        SELECT c.code, m, count(r.code) AS n FROM (SELECT DISTINCT code FROM records) c CROSS JOIN range(1, 13) t(m)
        LEFT JOIN records r ON r.code = c.code AND month(r.start_date) = m GROUP BY 1, 2) x GROUP BY 1) USING (code)
    LEFT JOIN (SELECT code, string_agg(concat(year, ':', n), ',' ORDER BY year) AS years FROM years GROUP BY 1) USING (code)
    LEFT JOIN (SELECT code, coalesce(sum(n) FILTER (site IS NOT NULL), 0)::bigint AS mapped, sum(n)::bigint AS base_total
               FROM base_n JOIN located USING (base_key) GROUP BY 1) USING (code)
    LEFT JOIN (SELECT code, item AS busiest FROM ({ranked("SELECT code, base_key AS item, n FROM base_n", 1)}) z) USING (code)
    LEFT JOIN (SELECT code, CASE WHEN earlier_records = 0 THEN NULL
                 WHEN 100.0::double * (recent_records - earlier_records) / earlier_records > 15 THEN 'rising'
                 WHEN 100.0::double * (recent_records - earlier_records) / earlier_records < -15 THEN 'falling'
                 ELSE 'steady' END AS direction FROM halves) USING (code)
    LEFT JOIN (SELECT code, string_agg(cast(n as string), ',' ORDER BY band_no) AS bands FROM ({BANDS}) b GROUP BY 1) USING (code)""",
    edges="""SELECT quantile_cont(flight_hours, 0.25) AS q0, quantile_cont(flight_hours, 0.5) AS q1,
                    quantile_cont(flight_hours, 0.75) AS q2 FROM records""",
    banded="""SELECT code, CASE WHEN flight_hours <= -1 THEN NULL WHEN flight_hours <= q0 THEN 0
                     WHEN flight_hours <= q1 THEN 1 WHEN flight_hours <= q2 THEN 2 ELSE 3 END AS band_no
              FROM records, edges""", **YEARS))
def _(spark, d):
    p = _profile(spark, d)
    listed = lambda column, show: F.array_join(F.transform(column, show), ",")
    return p.select(
        "code", "description", "total_records", "affected_assets", F.col("first_date").cast("string").alias("first_date"),
        F.col("last_date").cast("string").alias("last_date"), arrays.entry("top_phrase", 0, "item").alias("phrase"),
        listed("top_keyword", lambda e: e["item"]).alias("keyword"),
        listed("months", lambda e: e["n"].cast("string")).alias("months"),
        listed("years", lambda e: F.concat(e["item"].cast("string"), F.lit(":"), e["n"].cast("string"))).alias("years"),
        F.col("site_coverage.mapped").alias("mapped"), F.col("site_coverage.total").alias("base_total"),
        arrays.entry("top_base", 0, "item").alias("busiest"), F.col("labor.total_hours").alias("total_hours"),
        F.col("trend.direction").alias("direction"), listed("hour_bands", lambda e: e["n"].cast("string")).alias("bands"),
    )


LABOR = "total_hours mean_hours median_hours max_hours fleet_mean_hours labor_share_pct record_share_pct burden_index".split()
TREND = "earlier_records recent_records change_pct first_full_year last_full_year excluded_year".split()
MONTH_NAMES = "['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec']"


def section_sql() -> str:
    """Every section of the profile from the tables that the single-section queries use: code, section, place, item, n, value."""
    part = lambda name, source, place, item, n="NULL", value="NULL": (
        f"SELECT code, '{name}' AS section, cast({place} AS int) AS place, cast({item} AS string) AS item, cast({n} AS bigint) AS n, cast({value} AS double) AS value FROM ({source}) s")
    lists = [part(f"top_{name}", ranked(source, limit), "rank", "item", "n") for name, source, limit in (
        ("phrase", phrases("discrepancy"), 5), ("fix", phrases("corrective_action"), 5), ("base", "SELECT code, base_key AS item, n FROM base_n", 10),
        ("keyword", "SELECT code, token AS item, count(*) AS n FROM tokens GROUP BY 1, 2", 10),
        ("fix_keyword", "SELECT code, token AS item, count(*) AS n FROM fix_tokens GROUP BY 1, 2", 10))]
    site = "SELECT code, site AS item, lat, lon, sum(n) AS n FROM base_n JOIN located USING (base_key) WHERE site IS NOT NULL GROUP BY ALL"
    placed = f"SELECT *, row_number() OVER (PARTITION BY code ORDER BY n DESC, item) AS rank FROM ({site}) q"
    conc = f"SELECT * FROM ({TOP8}) x WHERE rank <= 8"
    phase = lambda column, view: ranked(f"SELECT code, phase AS item, n FROM ({phase_sql(column, view)}) h", 1000)
    trend = "SELECT *, CASE WHEN earlier_records > 0 THEN 100.0::double * (recent_records - earlier_records) / earlier_records END AS change_pct FROM halves"
    direction = f"""SELECT code, CASE WHEN change_pct > 15 THEN 'rising' WHEN change_pct < -15 THEN 'falling' ELSE 'steady' END AS item
        FROM ({trend}) t WHERE change_pct IS NOT NULL"""
    together = """SELECT *, row_number() OVER (PARTITION BY code ORDER BY n DESC, item) AS rank FROM (
        SELECT a.code, b.code AS item, sum(b.n) AS n FROM jc a JOIN jc b ON a.job_id = b.job_id AND a.code <> b.code GROUP BY 1, 2) p"""
    parts = lists + [
        part("months", "SELECT c.code, m, count(r.code) AS n FROM (SELECT DISTINCT code FROM records) c CROSS JOIN range(1, 13) t(m) "
             "LEFT JOIN records r ON r.code = c.code AND month(r.start_date) = m GROUP BY 1, 2", "m", f"({MONTH_NAMES})[m]", "n"),
        part("years", "SELECT code, year, n, row_number() OVER (PARTITION BY code ORDER BY year) AS rank FROM years", "rank", "year", "n"),
        part("year_months", "SELECT code, item, n, row_number() OVER (PARTITION BY code ORDER BY item) AS rank FROM "
             "(SELECT code, strftime(start_date, '%Y-%m') AS item, count(*) AS n FROM records GROUP BY 1, 2) y", "rank", "item", "n"),
        part("sites", placed, "rank", "item", "n", "lat"), part("sites_east", placed, "rank", "item", "n", "lon"),
        part("coverage", "SELECT code, coalesce(sum(n) FILTER (site IS NOT NULL), 0) AS n, sum(n) AS value FROM base_n JOIN located USING (base_key) GROUP BY 1", "1", "'mapped of all'", "n", "value"),
        part("concentration", conc, "rank", "place", "records", '"index"'), part("expected", conc, "rank", "place", "records", "expected"),
        part("discovered", phase("discovered_code", "discovery"), "rank", "item", "n"), part("maint_type", phase("maint_type_code", "maintenance"), "rank", "item", "n"),
        part("hour_bands", f"SELECT * FROM ({BANDS}) b", "band_no + 1", "band", "n"),
        part("cooccurring", f"SELECT * FROM ({together}) z WHERE rank <= 5", "rank", "item", "n"),
        part("trend_direction", direction, "1", "item"),
        *[part("trend", f"SELECT * FROM ({trend}) t WHERE {c} IS NOT NULL", i + 1, f"'{c}'", "NULL", c) for i, c in enumerate(TREND)],
        part("labor_verdict", "SELECT code, verdict AS item FROM labor", "1", "item"),
        *[part("labor", f"SELECT * FROM labor WHERE {c} IS NOT NULL", i + 1, f"'{c}'", "NULL", c) for i, c in enumerate(LABOR)]]
    return " UNION ALL ".join(parts)


LABOR_SQL = """
    SELECT *, 100.0::double * (total_hours / fleet_hours) AS labor_share_pct, 100.0::double * (n / fleet_n) AS record_share_pct,
           fleet_hours / fleet_n AS fleet_mean_hours, (total_hours / fleet_hours) / (n / fleet_n) AS burden_index,
           CASE WHEN (total_hours / fleet_hours) / (n / fleet_n) >= 1.25 THEN 'expensive'
                WHEN (total_hours / fleet_hours) / (n / fleet_n) <= 0.8 THEN 'cheap' ELSE 'typical' END AS verdict
    FROM (SELECT code, count(labor_hours) AS n, sum(labor_hours) AS total_hours, avg(labor_hours) AS mean_hours,
                 median(labor_hours) AS median_hours, max(labor_hours) AS max_hours FROM records GROUP BY 1) c,
         (SELECT sum(labor_hours) AS fleet_hours, count(labor_hours) AS fleet_n FROM records) f"""


# Every section of the assembled profile, one row for each entry.
@query("a24_profile_sections", sql(
    "records base_n located tokens discovery maintenance", section_sql(), labor=LABOR_SQL, jc="SELECT job_id, code, count(*) AS n FROM records GROUP BY 1, 2",
    fix_tokens=VIEWS["tokens"][0].replace("discrepancy", "corrective_action"),
    edges="""SELECT quantile_cont(flight_hours, 0.25) AS q0, quantile_cont(flight_hours, 0.5) AS q1,
                    quantile_cont(flight_hours, 0.75) AS q2 FROM records""",
    banded="""SELECT code, CASE WHEN flight_hours <= -1 THEN NULL WHEN flight_hours <= q0 THEN 0
                     WHEN flight_hours <= q1 THEN 1 WHEN flight_hours <= q2 THEN 2 ELSE 3 END AS band_no
              FROM records, edges""", **YEARS, **BY_BASE))
def _(spark, d):
    p = _profile(spark, d)
    none = F.lit(None)

    def entries(section, column, item, n=lambda e: none, value=lambda e: none):
        return F.transform(F.coalesce(F.col(column), F.array().cast(p.schema[column].dataType)), lambda e, i: F.struct(
            F.lit(section).alias("section"), (i + 1).alias("place"), item(e).cast("string").alias("item"), n(e).cast("bigint").alias("n"), value(e).cast("double").alias("value")))

    def single(section, place, item, n=none, value=none):
        return F.array(F.struct(F.lit(section).alias("section"), F.lit(place).alias("place"), item.cast("string").alias("item"),
                                n.cast("bigint").alias("n"), value.cast("double").alias("value")))

    item, n = (lambda e: e["item"]), (lambda e: e["n"])
    parts = [entries(c, c, item, n) for c in ("top_phrase", "top_fix", "top_base", "top_keyword", "top_fix_keyword", "months", "years", "discovered", "maint_type", "cooccurring")]
    parts += [
        entries("year_months", "year_months", lambda e: F.concat(e["year"].cast("string"), F.lit("-"), F.lpad(e["month"].cast("string"), 2, "0")), n),
        entries("sites", "sites", lambda e: e["site"], n, lambda e: e["lat"]), entries("sites_east", "sites", lambda e: e["site"], n, lambda e: e["lon"]),
        entries("concentration", "concentration", lambda e: e["base"], lambda e: e["records"], lambda e: e["index"]),
        entries("expected", "concentration", lambda e: e["base"], lambda e: e["records"], lambda e: e["expected"]),
        entries("hour_bands", "hour_bands", lambda e: e["band"], n),
        single("coverage", 1, F.when(F.col("site_coverage").isNotNull(), "mapped of all"), F.col("site_coverage.mapped"), F.col("site_coverage.total")),
        single("trend_direction", 1, F.col("trend.direction")), single("labor_verdict", 1, F.col("labor.verdict")),
        *[single("trend", i + 1, F.when(F.col(f"trend.{c}").isNotNull(), c), none, F.col(f"trend.{c}")) for i, c in enumerate(TREND)],
        *[single("labor", i + 1, F.when(F.col(f"labor.{c}").isNotNull(), c), none, F.col(f"labor.{c}")) for i, c in enumerate(LABOR)]]
    return p.select("code", F.explode(F.concat(*parts)).alias("e")).select("code", "e.*").where("item IS NOT NULL")


def _narrative_sql() -> str:
    """The report from the long table of sections, sentence by sentence."""
    title = lambda x: (f"array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+'), "  # noqa: E731
                       "lambda w: concat(upper(substr(w, 1, 1)), lower(substr(w, 2)))), '')")
    whole = lambda x: f"format('{{:,}}', cast(round_even({x}, 0) AS bigint))"
    fixed = lambda x, k: f"format('{{:.{k}f}}', round_even({x}, {k}))"
    share = lambda n: f"concat({fixed(f'100.0::double * {n} / total', 0)}, '%')"
    one = lambda section, item, c="value": f"max({c}) FILTER (section = '{section}' AND item = '{item}')"
    joined = lambda section, k, show, sep=", ": f"string_agg({show}, '{sep}' ORDER BY place) FILTER (section = '{section}' AND place <= {k})"
    counted = "concat(item, ' (', n, ')')"
    return sql("records dictionary base_n located tokens discovery maintenance", f"""
        SELECT code, concat_ws(chr(10),
          concat('**WUC ', code, ' — ', coalesce(description, 'Unknown'), '**'),
          concat('Based on ', {whole('total')}, ' maintenance records across ', assets, ' airframes (', first_date, ' to ', last_date, ').'), '',
          concat_ws(' ', concat('**Burden.** ', {whole('round_even(total_hours, 1)')}, ' man-hours total, averaging ', {fixed('round_even(mean_hours, 2)', 1)},
              ' h per event against a fleet average of ', {fixed('round_even(fleet_mean, 2)', 1)}, ' h.'),
            concat('At ', {fixed('burden', 2)}, CASE WHEN round_even(burden, 2) >= 1.25 THEN 'x the fleet rate, each occurrence is more expensive than a typical maintenance action.'
              WHEN round_even(burden, 2) <= 0.8 THEN 'x the fleet rate, this is cheap per event — frequent rather than costly.' ELSE 'x the fleet rate, cost per event is about typical.' END)), '',
          CASE WHEN direction IS NOT NULL THEN concat('**Direction.** ', {title('direction')}, ' — ', {whole('earlier')}, ' records in the earliest full years vs ', {whole('recent')},
            ' in the most recent (', format('{{:+.0f}}', round_even(round_even(change, 1), 0)), '%), across ', cast(first_year AS int), '–', cast(last_year AS int), '.',
            CASE WHEN excluded IS NULL THEN '' ELSE concat(' ', cast(excluded AS int), ' is a partial year and was excluded.') END) END,
          CASE WHEN direction IS NOT NULL THEN '' END,
          concat('**Why it occurs.** The most frequent discrepancy keywords are: ', nullif(keywords, ''), CASE WHEN keywords IS NULL THEN NULL ELSE '.' END),
          CASE WHEN keywords IS NOT NULL AND phrase IS NOT NULL THEN concat('The single most common write-up is "', substr(phrase, 1, 120), '" (', phrase_n, ' occurrences, ', {share('phrase_n')}, ' of all reports).') END,
          CASE WHEN fix_words IS NOT NULL THEN concat('Typical corrective actions involve: ', fix_words, '.') END, '',
          CASE WHEN hot IS NOT NULL THEN concat('**Where.** Genuinely concentrated at: ', hot, '. These exceed what their overall maintenance volume predicts.')
               WHEN busy IS NOT NULL THEN concat('**Where.** No base stands out — this is fleet-wide. Highest raw counts are ', busy, ', but each is close to what its overall maintenance volume predicts.') END,
          CASE WHEN busy IS NOT NULL THEN '' END,
          concat('**When (seasonality).** Peak months: ', peaks, '.'), concat('Year-over-year: ', lately, '.'), '',
          concat('**Airframe lifecycle.** Occurrences are ', CASE WHEN band_share < 32 THEN 'spread evenly across airframe age — no lifecycle signal'
              WHEN band LIKE '%High' THEN concat('skewed toward high-time airframes (', {fixed('band_share', 0)}, '% vs 25% expected) — consistent with wear-out')
              ELSE concat('skewed toward low-time airframes (', {fixed('band_share', 0)}, '% vs 25% expected) — not wear-out; look at install quality or inspection scheduling') END,
            '. Largest band: ', band_label, ' (', band_n, ').'),
          concat('**Discovery phase.** ', found, '.'), concat('Maintenance type: ', kinds, '.'), '',
          CASE WHEN others IS NOT NULL THEN concat('**Often opened alongside.** Other WUCs frequently worked on the same job control number: ', others, '.') END) AS narrative
        FROM told LEFT JOIN hotspots USING (code) LEFT JOIN peaked USING (code) LEFT JOIN recently USING (code) LEFT JOIN aged USING (code) LEFT JOIN dictionary USING (code)""",
        labor=LABOR_SQL, jc="SELECT job_id, code, count(*) AS n FROM records GROUP BY 1, 2", fix_tokens=VIEWS["tokens"][0].replace("discrepancy", "corrective_action"),
        edges="""SELECT quantile_cont(flight_hours, 0.25) AS q0, quantile_cont(flight_hours, 0.5) AS q1,
                        quantile_cont(flight_hours, 0.75) AS q2 FROM records""",
        banded="""SELECT code, CASE WHEN flight_hours <= -1 THEN NULL WHEN flight_hours <= q0 THEN 0
                         WHEN flight_hours <= q1 THEN 1 WHEN flight_hours <= q2 THEN 2 ELSE 3 END AS band_no
                  FROM records, edges""", **YEARS, **BY_BASE, sections=section_sql(),
        sized="""SELECT code, count(*) AS total, count(DISTINCT asset_id) AS assets, min(start_date) AS first_date, max(start_date) AS last_date FROM records GROUP BY 1""",
        told=f"""SELECT code, any_value(total) AS total, any_value(assets) AS assets, any_value(first_date) AS first_date, any_value(last_date) AS last_date,
            {one('labor', 'total_hours')} AS total_hours, {one('labor', 'mean_hours')} AS mean_hours, {one('labor', 'fleet_mean_hours')} AS fleet_mean, {one('labor', 'burden_index')} AS burden,
            max(item) FILTER (section = 'trend_direction') AS direction, {one('trend', 'earlier_records')} AS earlier, {one('trend', 'recent_records')} AS recent,
            {one('trend', 'change_pct')} AS change, {one('trend', 'first_full_year')} AS first_year, {one('trend', 'last_full_year')} AS last_year, {one('trend', 'excluded_year')} AS excluded,
            {joined('top_keyword', 6, 'item')} AS keywords, {joined('top_fix_keyword', 5, 'item')} AS fix_words, max(item) FILTER (section = 'top_phrase' AND place = 1) AS phrase,
            max(n) FILTER (section = 'top_phrase' AND place = 1) AS phrase_n, {joined('cooccurring', 5, counted)} AS others, {joined('maint_type', 2, counted, '; ')} AS kinds,
            {joined('discovered', 2, f"concat(item, ' (', n, ', ', {share('n')}, ')')", '; ')} AS found FROM sections JOIN sized USING (code) GROUP BY code""",
        dense=f"""SELECT c.code, c.place, c.n, {title('c.item')} AS base, round_even(c.value, 2) AS ratio, round_even(e.value, 1) AS wanted
            FROM sections c JOIN sections e ON c.code = e.code AND c.place = e.place AND c.section = 'concentration' AND e.section = 'expected'""",
        ordered="SELECT *, row_number() OVER (PARTITION BY code ORDER BY (ratio >= 1.5 AND n >= 3) DESC, -ratio, n, base) AS turn, ratio >= 1.5 AND n >= 3 AS is_hot FROM dense",
        hotspots=f"""SELECT code, string_agg(concat(base, ' (', n, ' vs ', {fixed('wanted', 0)}, ' expected, ', {fixed('ratio', 1)}, 'x)'), '; ' ORDER BY turn) FILTER (is_hot AND turn <= 3) AS hot,
            string_agg(concat(base, ' (', n, ', ', {fixed('ratio', 1)}, 'x expected)'), '; ' ORDER BY place) FILTER (place <= 3) AS busy FROM ordered GROUP BY code""",
        peaked=f"""SELECT code, string_agg({counted}, ', ' ORDER BY n DESC, place) AS peaks FROM (
            SELECT * FROM sections WHERE section = 'months' QUALIFY row_number() OVER (PARTITION BY code ORDER BY n DESC, place) <= 3) m GROUP BY code""",
        recently="""SELECT code, string_agg(concat(item, ': ', n), ' -> ' ORDER BY place) AS lately FROM (
            SELECT * FROM sections WHERE section = 'years' QUALIFY row_number() OVER (PARTITION BY code ORDER BY place DESC) <= 5) y GROUP BY code""",
        aged=f"""SELECT code, item AS band, n AS band_n, 100.0::double * n / greatest(all_n, 1) AS band_share, CASE place
              WHEN 1 THEN concat('Low (<', {fixed('q0', 0)}, ' hrs)') WHEN 2 THEN concat('Mid-Low (', {fixed('q0', 0)}, '-', {fixed('q1', 0)}, ')')
              WHEN 3 THEN concat('Mid-High (', {fixed('q1', 0)}, '-', {fixed('q2', 0)}, ')') ELSE concat('High (>', {fixed('q2', 0)}, ' hrs)') END AS band_label
            FROM (SELECT *, sum(n) OVER (PARTITION BY code) AS all_n FROM sections WHERE section = 'hour_bands'
                  QUALIFY row_number() OVER (PARTITION BY code ORDER BY n DESC, place) = 1) b, edges""")


@query("n1_narrative", _narrative_sql())
def _(spark, d):
    return narrative.narrative(_profile(spark, d)).select("code", "narrative")


@query("n2_prompt")
def _(spark, d):
    return narrative.prompt(_profile(spark, d)).select("code", "prompt")
