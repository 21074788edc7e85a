"""Scans, filters, lookups, counts, windows and limits over records."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import ASSET, CODE, END, START, query, sql
from hangarlog.operators import clean, counts, filters, lookup, quality
from hangarlog.plans.analysis import analyze
from hangarlog.reference_data import discovery_phases, systems
from hangarlog.sources import readers, star

TOP = "SELECT item, n FROM c ORDER BY n DESC, item LIMIT 10"


def day(c: str) -> F.Column:
    return F.col(c).cast("string").alias(c)


# ---- scans and checks ------------------------------------------------------

@query("s5_projected_parquet_scan", "SELECT event_id, user_id, value FROM events")
def _(spark, d):
    return readers.read_parquet(spark, f"{d}/events.parquet", ["event_id", "user_id", "value"])


@query("s11_completeness", sql("records", """
    SELECT column_name, 'OK' AS status, non_null, 100.0::double * non_null / total AS non_null_pct FROM (
      SELECT unnest(['code','base','start_date','flight_hours']) AS column_name,
             unnest([count(code), count(base), count(start_date), count(flight_hours)]) AS non_null,
             count(*) AS total FROM records) x
    UNION ALL SELECT 'stop_date', 'MISSING', NULL, NULL"""))
def _(spark, d):
    return quality.completeness(star.records(spark, d), ["code", "base", "start_date", "flight_hours", "stop_date"])


@query("a28_date_quality", sql("records", """
    SELECT 'start_date' AS column_name, count(start_date) AS parsed, cast(min(start_date) as string) AS first_date,
           cast(max(start_date) as string) AS last_date, 100.0::double * count(start_date) / count(*) AS parsed_pct,
           CASE WHEN year(max(start_date)) < 1980 THEN 'ERROR'
                WHEN 100.0::double * count(start_date) / count(*) <= 95 THEN 'WARN' ELSE 'OK' END AS status
    FROM records"""))
def _(spark, d):
    return quality.date_quality(star.records(spark, d), ["start_date"]).withColumns(
        {c: F.col(c).cast("string") for c in ("first_date", "last_date")})


# ---- projections and filters -----------------------------------------------

@query("p1_shared_schema", sql("extract_a extract_b", """
    SELECT event_id, user_id, event_type, value FROM extract_a
    UNION ALL SELECT event_id, user_id, event_type, value FROM extract_b"""))
def _(spark, d):
    a, b = star.overlapping_extracts(spark, d)
    return clean.union_shared(a, b).drop("ts")


@query("p2_asset_filter", sql("records", f"SELECT record_id, asset_id FROM records WHERE asset_id = '{ASSET}'"))
def _(spark, d):
    return filters.query_records(star.records(spark, d), asset_id=f" {ASSET} ").select("record_id", "asset_id")


@query("p3_code_filter", sql("records", f"SELECT record_id, code FROM records WHERE code = '{CODE}'"))
def _(spark, d):
    return filters.query_records(star.records(spark, d), code=f" {CODE.lower()}").select("record_id", "code")


@query("p4_date_range", sql("records", f"""
    SELECT record_id, cast(start_date as string) AS start_date FROM records
    WHERE start_date BETWEEN date '{START}' AND date '{END}'"""))
def _(spark, d):
    return filters.query_records(star.records(spark, d), start=START, end=END).select("record_id", day("start_date"))


@query("p5_valid_label", """
    SELECT event_id, upper(trim(event_type)) AS label FROM events
    WHERE regexp_full_match(upper(trim(event_type)), '[A-Z0-9]{3,6}')""")
def _(spark, d):
    events = star.table(spark, d, "events").select("event_id", F.upper(F.trim("event_type")).alias("label"))
    return filters.valid_label(events, "label")


@query("p5_label_validity", """
    SELECT count(*) FILTER (regexp_full_match(upper(trim(event_type)), '[A-Z0-9]{3,6}')) AS kept,
           count(*) FILTER (NOT regexp_full_match(upper(trim(event_type)), '[A-Z0-9]{3,6}')) AS rejected FROM events""")
def _(spark, d):
    return filters.label_validity(star.table(spark, d, "events").select(F.upper(F.trim("event_type")).alias("label")), "label")


@query("p6_minimum_text", "SELECT doc_id, length(text) AS len FROM documents WHERE length(text) >= 10")
def _(spark, d):
    return filters.long_enough(star.table(spark, d, "documents")).select("doc_id", F.length("text").alias("len"))


@query("p8_not_null", sql("records", "SELECT record_id, base FROM records WHERE base IS NOT NULL"))
def _(spark, d):
    return filters.not_null(star.records(spark, d), ["base", "start_date"]).select("record_id", "base")


@query("p11_record_query", sql("records", f"""
    SELECT record_id, asset_id, code, cast(start_date as string) AS start_date FROM records
    WHERE asset_id = '{ASSET}' AND start_date >= date '{START}' AND start_date <= date '{END}'"""))
def _(spark, d):
    return filters.query_records(star.records(spark, d), asset_id=ASSET, start=START, end=END).select(
        "record_id", "asset_id", "code", day("start_date"))


# ---- lookups ---------------------------------------------------------------

@query("j1_code_description", sql("records dictionary systems", """
    SELECT record_id, records.code, coalesce(description, 'Unknown') AS description,
           coalesce(system, 'Unknown Main System') AS system
    FROM records LEFT JOIN dictionary ON records.code = dictionary.code
                 LEFT JOIN systems ON substr(records.code, 1, 2) = prefix"""))
def _(spark, d):
    recs = star.records(spark, d)
    named = lookup.with_description(recs.select("record_id", "code"), star.code_dictionary(recs))
    return lookup.with_system(named, systems(spark))


@query("j2_dictionary_merge", sql("records dictionary", """
    SELECT code, coalesce(p.description, f.description) AS description
    FROM dictionary p FULL JOIN (SELECT DISTINCT code, concat('ITEM ', code) AS description FROM records) f USING (code)"""))
def _(spark, d):
    recs = star.records(spark, d)
    spare = recs.select("code").distinct().select("code", F.concat(F.lit("ITEM "), "code").alias("description"))
    return lookup.merge_dictionaries(star.code_dictionary(recs), spare)


@query("j3_phase_lookup", sql("records discovery", """
    SELECT record_id, discovered_code, coalesce(phase, CASE WHEN coalesce(discovered_code, '') = '' THEN 'Unknown'
           ELSE concat('Unknown (', discovered_code, ')') END) AS phase
    FROM records LEFT JOIN discovery ON upper(trim(discovered_code)) = phase_code"""))
def _(spark, d):
    from hangarlog.operators.sections import with_phase
    recs = star.records(spark, d).select("record_id", "discovered_code")
    return with_phase(recs, "discovered_code", discovery_phases(spark)).select("record_id", "discovered_code", "phase")


# ---- counts ----------------------------------------------------------------

@query("a1_match_share", sql("records", f"""
    SELECT count(*) FILTER (code = '{CODE}') AS total, count(*) AS all_records,
           100.0::double * count(*) FILTER (code = '{CODE}') / count(*) AS share_pct FROM records"""))
def _(spark, d):
    return counts.match_share(star.records(spark, d), filters.record_predicate(code=CODE))


@query("a2_issues_by_month", sql("records", """
    SELECT strftime(start_date, '%Y-%m') AS month, count(*) AS n FROM records GROUP BY 1"""))
def _(spark, d):
    return counts.issues_by_month(star.records(spark, d))


@query("a2_issues_by_month_per_code", sql("records", """
    SELECT code, strftime(start_date, '%Y-%m') AS month, count(*) AS n FROM records GROUP BY 1, 2"""))
def _(spark, d):
    return counts.issues_by_month(star.records(spark, d), by="code")


@query("a3_seasonality", sql("records", f"""
    SELECT cast(m AS int) AS month, strftime(make_date(2000, cast(m AS int), 1), '%b') AS month_name, count(code) AS n
    FROM range(1, 13) t(m) LEFT JOIN (SELECT * FROM records WHERE asset_id = '{ASSET}') r ON month(start_date) = m
    GROUP BY 1, 2"""))
def _(spark, d):
    return counts.seasonality(filters.query_records(star.records(spark, d), asset_id=ASSET))


@query("a4_top_discrepancies", sql("records", TOP, c="""
    SELECT trim(discrepancy) AS item, count(*) AS n FROM records GROUP BY 1"""))
def _(spark, d):
    return counts.topn_counts(star.records(spark, d), "discrepancy")


@query("a4_preferred_column", sql("records", TOP, c="""
    SELECT rtrim(trim(regexp_replace(upper(discrepancy), '\\s+', ' ', 'g')), '. ') AS item, count(*) AS n
    FROM records GROUP BY 1"""))
def _(spark, d):
    recs = clean.normalize_writeups(star.records(spark, d))
    return counts.topn_preferred(recs, "discrepancy_normalized", "discrepancy")


@query("a5_code_breakdown", sql("records dictionary", """
    SELECT c.code, CASE WHEN description IS NULL THEN c.code ELSE concat(c.code, ' (', description, ')') END AS label, n
    FROM (SELECT code, count(*) AS n FROM records GROUP BY 1 ORDER BY n DESC, code LIMIT 10) c
    LEFT JOIN dictionary ON c.code = dictionary.code"""))
def _(spark, d):
    recs = star.records(spark, d)
    return counts.code_breakdown(recs, star.code_dictionary(recs))


@query("a6_distinct_counts", sql("records", """
    SELECT count(DISTINCT asset_id) AS distinct_asset_id, count(DISTINCT code) AS distinct_code,
           count(DISTINCT base) AS distinct_base FROM records"""))
def _(spark, d):
    return counts.distinct_counts(star.records(spark, d), ["asset_id", "code", "base"])


@query("a7_date_span", sql("records", """
    SELECT code, cast(min(start_date) as string) AS first_date, cast(max(start_date) as string) AS last_date
    FROM records GROUP BY 1"""))
def _(spark, d):
    return counts.date_span(star.records(spark, d), "code").select("code", day("first_date"), day("last_date"))


PRIOR = f"""
    SELECT total, prior_total, total - prior_total AS delta,
           CASE WHEN prior_total = 0 THEN 0 ELSE 100.0::double * (total - prior_total) / prior_total END AS delta_pct
    FROM (SELECT count(*) FILTER (start_date BETWEEN date '{START}' AND date '{END}') AS total,
                 count(*) FILTER (start_date BETWEEN date '{START}' - cast(date '{END}' - date '{START}' + 1 as int)
                                  AND date '{START}' - 1) AS prior_total
          FROM records WHERE asset_id = '{ASSET}') x"""


@query("a8_prior_period", sql("records", PRIOR))
def _(spark, d):
    return counts.prior_period(star.records(spark, d), START, END, asset_id=ASSET)


@query("a9_analysis_bundle", sql("records dictionary", f"""
    SELECT 'top_fixes' AS part, item, n FROM (SELECT trim(corrective_action) AS item, count(*) AS n FROM hits GROUP BY 1 ORDER BY n DESC, item LIMIT 10) a
    UNION ALL SELECT 'base_breakdown', item, n FROM (SELECT trim(base) AS item, count(*) AS n FROM hits WHERE base IS NOT NULL GROUP BY 1 ORDER BY n DESC, item LIMIT 10) b
    UNION ALL SELECT 'asset_leaderboard', item, n FROM (SELECT asset_id AS item, count(*) AS n FROM hits GROUP BY 1 ORDER BY n DESC, item LIMIT 10) c
    UNION ALL SELECT 'months', strftime(start_date, '%Y-%m'), count(*) FROM hits GROUP BY 2
    UNION ALL SELECT 'total', 'records', count(*) FROM hits
    UNION ALL SELECT 'total', 'codes', count(DISTINCT code) FROM hits""",
    hits=f"SELECT * FROM records WHERE start_date BETWEEN date '{START}' AND date '{END}'"))
def _(spark, d):
    out = analyze(star.records(spark, d), start=START, end=END)
    part = lambda name, df: df.select(F.lit(name).alias("part"), "item", "n")
    head = out["headline"]
    return (
        part("top_fixes", out["top_fixes"]).unionByName(part("base_breakdown", out["base_breakdown"]))
        .unionByName(part("asset_leaderboard", out["asset_leaderboard"]))
        .unionByName(part("months", out["issues_by_month"].withColumnRenamed("month", "item")))
        .unionByName(head.select(F.lit("total").alias("part"), F.lit("records").alias("item"), F.col("total").alias("n")))
        .unionByName(head.select(F.lit("total").alias("part"), F.lit("codes").alias("item"), F.col("distinct_codes").alias("n")))
    )


BUNDLE_PARTS = {
    "totals": "SELECT 'share' AS item, count(*) FILTER (start_date BETWEEN date '{s}' AND date '{e}') AS n, 100.0::double * count(*) FILTER (start_date BETWEEN date '{s}' AND date '{e}') / count(*) AS value FROM records",
    "headline": "SELECT unnest(['records', 'assets', 'codes']) AS item, unnest([count(*), count(DISTINCT asset_id), count(DISTINCT code)]) AS n, NULL AS value FROM hits",
    "dates": "SELECT concat(min(start_date), ' ', max(start_date)) AS item, NULL AS n, NULL AS value FROM hits",
    "top_discrepancies": "SELECT trim(discrepancy) AS item, count(*) AS n, NULL AS value FROM hits GROUP BY 1 ORDER BY n DESC, item LIMIT 10",
    "top_fixes": "SELECT trim(corrective_action) AS item, count(*) AS n, NULL AS value FROM hits GROUP BY 1 ORDER BY n DESC, item LIMIT 10",
    "issues_by_month": "SELECT month AS item, n, CASE WHEN count(*) OVER w >= 3 AND count(*) OVER () >= 6 THEN avg(n) OVER w END AS value FROM "
                       "(SELECT strftime(start_date, '%Y-%m') AS month, count(*) AS n FROM hits GROUP BY 1) m WINDOW w AS (ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)",
    "seasonality": "SELECT lpad(cast(m AS string), 2, '0') AS item, count(start_date) AS n, NULL AS value FROM range(1, 13) t(m) LEFT JOIN hits ON month(start_date) = m GROUP BY 1",
    "base_breakdown": "SELECT trim(base) AS item, count(*) AS n, NULL AS value FROM hits WHERE base IS NOT NULL GROUP BY 1 ORDER BY n DESC, item LIMIT 10",
    "asset_leaderboard": "SELECT asset_id AS item, count(*) AS n, NULL AS value FROM hits GROUP BY 1 ORDER BY n DESC, item LIMIT 10",
    "code_breakdown": "SELECT CASE WHEN description IS NULL THEN code ELSE concat(code, ' (', description, ')') END AS item, n, NULL AS value FROM "
                      "(SELECT code, count(*) AS n FROM hits GROUP BY 1 ORDER BY n DESC, code LIMIT 10) c LEFT JOIN dictionary USING (code)",
    "prior_period": "SELECT 'prior' AS item, prior AS n, CASE WHEN prior = 0 THEN 0 ELSE 100.0::double * (total - prior) / prior END AS value FROM (SELECT count(*) FILTER (start_date BETWEEN date '{s}' AND date '{e}') AS total, "
                    "count(*) FILTER (start_date BETWEEN date '{s}' - cast(date '{e}' - date '{s}' + 1 AS int) AND date '{s}' - 1) AS prior FROM records) x",
}


# Every part of the bundle, one row for each entry.
@query("a9_analysis_parts", sql("records dictionary", " UNION ALL ".join(
    f"SELECT '{name}' AS part, cast(item AS string) AS item, cast(n AS bigint) AS n, cast(value AS double) AS value FROM ({body.format(s=START, e=END)}) p_{name}" for name, body in BUNDLE_PARTS.items()),
    hits=f"SELECT * FROM records WHERE start_date BETWEEN date '{START}' AND date '{END}'"))
def _(spark, d):
    recs = star.records(spark, d)
    out = analyze(recs, star.code_dictionary(recs), start=START, end=END)
    none = F.lit(None)
    col = F.col

    def part(name, df, item=col("item"), n=col("n"), value=none):
        return df.select(F.lit(name).alias("part"), item.cast("string").alias("item"), n.cast("bigint").alias("n"), value.cast("double").alias("value"))

    head = out["headline"]
    parts = [part("totals", out["totals"], F.lit("share"), col("total"), col("share_pct")),
             *[part("headline", head, F.lit(item), col(c)) for item, c in (("records", "total"), ("assets", "distinct_assets"), ("codes", "distinct_codes"))],
             part("dates", head, F.concat_ws(" ", "first_date", "last_date"), none), part("issues_by_month", out["issues_by_month"], col("month"), value=col("rolling_mean")),
             part("seasonality", out["seasonality"], F.lpad(col("month").cast("string"), 2, "0")), part("code_breakdown", out["code_breakdown"], col("label")),
             part("prior_period", out["prior_period"], F.lit("prior"), col("prior_total"), col("delta_pct")),
             *[part(name, out[name]) for name in ("top_discrepancies", "top_fixes", "base_breakdown", "asset_leaderboard")]]
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    return whole


# ---- windows ---------------------------------------------------------------

ROLL = """CASE WHEN count(*) OVER w >= 3 AND count(*) OVER ({0}) >= 6 THEN avg(n) OVER w END AS rolling_mean
    FROM m WINDOW w AS ({0} ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"""


@query("w1_rolling_mean", sql("records", "SELECT month, n, " + ROLL.format(""), m="""
    SELECT strftime(start_date, '%Y-%m') AS month, count(*) AS n FROM records GROUP BY 1"""))
def _(spark, d):
    return counts.rolling_mean(counts.issues_by_month(star.records(spark, d)))


@query("w1_rolling_mean_per_code", sql("records", "SELECT code, month, n, " + ROLL.format("PARTITION BY code"), m="""
    SELECT code, strftime(start_date, '%Y-%m') AS month, count(*) AS n FROM records GROUP BY 1, 2"""))
def _(spark, d):
    return counts.rolling_mean(counts.issues_by_month(star.records(spark, d), "code"), by="code")


@query("w1_rolling_mean_no_gaps", sql("records", """
    SELECT code, month, n, """ + ROLL.format("PARTITION BY code"),
    c="SELECT code, date_trunc('month', start_date)::date AS d, count(*) AS n FROM records GROUP BY 1, 2",
    g="""SELECT code, unnest(generate_series(min(d)::timestamp, max(d)::timestamp, interval 1 month))::date AS d
         FROM c GROUP BY code""",
    m="SELECT g.code, strftime(g.d, '%Y-%m') AS month, coalesce(n, 0) AS n FROM g LEFT JOIN c ON g.code = c.code AND g.d = c.d"))
def _(spark, d):
    return counts.rolling_mean(counts.issues_by_month(star.records(spark, d), "code"), by="code", fill_gaps=True)


@query("w2_period_delta", sql("records", PRIOR.replace(f"WHERE asset_id = '{ASSET}'", "")))
def _(spark, d):
    return counts.prior_period(star.records(spark, d), START, END)


@query("w6_top_assets_per_code", sql("records", """
    SELECT code, item, n, cast(rank as int) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY code ORDER BY n DESC, item) AS rank FROM (
        SELECT code, asset_id AS item, count(*) AS n FROM records GROUP BY 1, 2) x) y WHERE rank <= 3"""))
def _(spark, d):
    return counts.topn_counts(star.records(spark, d), "asset_id", 3, by="code", rank="rank")


@query("w7_ranked_codes", sql("records", """
    SELECT item, n, cast(row_number() OVER (ORDER BY n DESC, item) as int) AS rank FROM (
      SELECT code AS item, count(*) AS n FROM records GROUP BY 1 ORDER BY n DESC, item LIMIT 20) x"""))
def _(spark, d):
    return counts.topn_counts(star.records(spark, d), "code", 20, rank="rank")


# ---- sorts and limits ------------------------------------------------------

@query("o1_top_assets", sql("records", "SELECT asset_id AS item, count(*) AS n FROM records GROUP BY 1 ORDER BY n DESC, item LIMIT 10"))
def _(spark, d):
    return counts.topn_counts(star.records(spark, d), "asset_id")


@query("o2_sorted_year_month", sql("records", """
    SELECT cast(year(start_date) as int) AS year, cast(month(start_date) as int) AS month, count(*) AS n
    FROM records GROUP BY 1, 2 ORDER BY 1, 2"""))
def _(spark, d):
    recs = star.records(spark, d)
    return (recs.groupBy(F.year("start_date").alias("year"), F.month("start_date").alias("month"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy("year", "month"))


@query("o3_first_rows", sql("records", "SELECT record_id, code FROM records ORDER BY record_id LIMIT 2000"))
def _(spark, d):
    return star.records(spark, d).select("record_id", "code").orderBy("record_id").limit(2000)


# ---- unions ----------------------------------------------------------------

@query("u1_union_shared", sql("extract_a extract_b", """
    SELECT count(*) AS n, sum(event_id)::bigint AS ids FROM (
      SELECT event_id FROM extract_a UNION ALL SELECT event_id FROM extract_b) x"""))
def _(spark, d):
    a, b = star.overlapping_extracts(spark, d)
    return clean.union_shared(a, b).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("u2_distinct_rows", sql("extract_a extract_b", """
    SELECT event_id, cast(ts as string) AS ts, user_id, event_type, value FROM (
      SELECT event_id, ts, user_id, event_type, value FROM extract_a UNION SELECT * FROM extract_b) x"""))
def _(spark, d):
    a, b = star.overlapping_extracts(spark, d)
    return clean.merge_extracts(a, b).withColumn("ts", F.col("ts").cast("string"))


@query("u2_merge_report", sql("extract_a extract_b", """
    SELECT (SELECT count(*) FROM extract_a) + (SELECT count(*) FROM extract_b) AS rows_before, count(*) AS rows_after,
           (SELECT count(*) FROM extract_a) + (SELECT count(*) FROM extract_b) - count(*) AS rows_removed
    FROM (SELECT event_id, ts, user_id, event_type, value FROM extract_a UNION SELECT * FROM extract_b) x"""))
def _(spark, d):
    return clean.merge_report(*star.overlapping_extracts(spark, d))
