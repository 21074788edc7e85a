"""Scalar functions, questions, plain-text answers and text classification."""

from __future__ import annotations

import calendar
import uuid

from pyspark.sql import functions as F

from catalog.base import AS_OF, PHRASE, query, sql
from hangarlog.functions import arrays, dates, labels, text
from hangarlog.operators import classify, count_store, counts, evaluate, joint, narrative, questions, sections, split
from hangarlog.plans import scoring
from hangarlog.plans.sizing import keep, stored
from hangarlog.reference_data import CONFIDENCE_BANDS, CONFIDENCE_EDGES, TEXT_SEPARATOR
from hangarlog.session import ensure_checkpoint_dir
from hangarlog.sources import star


# ---- scalar functions ------------------------------------------------------

@query("f1_code_normalize", sql("records", "SELECT record_id, upper(trim(base)) AS base_code FROM records"))
def _(spark, d):
    return star.records(spark, d).select("record_id", text.normalize_code("base").alias("base_code"))


@query("f2_phrase_normalize", sql("records", f"SELECT record_id, {PHRASE.format('discrepancy')} AS phrase FROM records"))
def _(spark, d):
    return star.records(spark, d).select("record_id", text.normalize_phrase("discrepancy").alias("phrase"))


@query("f3_writeup_normalize", """
    SELECT doc_id, md5(rtrim(trim(regexp_replace(upper(replace(text, 'ß', 'ss')), '\\s+', ' ', 'g')), '. ')) AS digest FROM documents""")
def _(spark, d):
    return star.table(spark, d, "documents").select("doc_id", F.md5(text.normalize_writeup("text")).alias("digest"))


@query("f4_title_case", sql("records", """
    SELECT DISTINCT base, array_to_string(list_transform(regexp_extract_all(base, '[A-Za-z]+|[^A-Za-z]+'),
           lambda w: concat(upper(substr(w, 1, 1)), lower(substr(w, 2)))), '') AS title FROM records WHERE base IS NOT NULL"""))
def _(spark, d):
    bases = star.records(spark, d).where("base IS NOT NULL").select("base").distinct()
    return bases.select("base", text.title_case("base").alias("title"))


@query("p7_prefixes", sql("records", "SELECT record_id, substr(code,1,2) AS system, substr(code,1,3) AS subsystem FROM records"))
def _(spark, d):
    return star.records(spark, d).select(
        "record_id", text.system_of("code").alias("system"), text.subsystem_of("code").alias("subsystem"))


@query("f5_f6_snippet", "SELECT doc_id, replace(substr(text, 1, 60), chr(10), ' ') AS snippet FROM documents")
def _(spark, d):
    return star.table(spark, d, "documents").select("doc_id", text.snippet("text", 60).alias("snippet"))


ENCODED = {
    "encoded": """SELECT record_id, strftime(start_date, '%Y%m%d') AS ymd,
                         cast(start_date - date '1899-12-30' as string) AS serial, cast(start_date as string) AS iso FROM records""",
}


# Dates written in three ways have to come back as the same day.
@query("f7_date_encodings", sql("records", """
    SELECT record_id, cast(start_date as string) AS ymd, cast(start_date as string) AS serial,
           cast(start_date as string) AS iso FROM records"""))
def _(spark, d):
    day = F.col("start_date")
    written = star.records(spark, d).select(
        "record_id", F.date_format(day, "yyyyMMdd").alias("ymd"),
        F.datediff(day, F.lit(dates.EXCEL_EPOCH).cast("date")).cast("string").alias("serial"), day.cast("string").alias("iso"))
    parsed = dates.parse_mixed_dates(written, ["ymd", "serial", "iso"])
    return parsed.withColumns({c: F.col(c).cast("string") for c in ("ymd", "serial", "iso")})


@query("f8_coerced_parse", sql("records", """
    SELECT record_id, try_cast(code as double) AS code_number, try_cast(job_id as double) AS job_number,
           cast(try_cast(discrepancy as date) as string) AS no_date FROM records"""))
def _(spark, d):
    # A code such as 04E15 reads as a number in exponent form, in both engines.
    return star.records(spark, d).select(
        "record_id", dates.to_number("code").alias("code_number"), dates.to_number("job_id").alias("job_number"),
        dates.to_date("discrepancy").cast("string").alias("no_date"))


@query("f9_date_parts", sql("records", """
    SELECT record_id, cast(year(start_date) as int) AS year, cast(month(start_date) as int) AS month,
           strftime(start_date, '%b %Y') AS label, strftime(start_date, '%Y-%m') AS month_key FROM records"""))
def _(spark, d):
    day = F.col("start_date")
    return star.records(spark, d).select(
        "record_id", F.year(day).alias("year"), F.month(day).alias("month"), dates.month_label(day).alias("label"),
        dates.month_key(day).alias("month_key"))


@query("f10_month_bounds", sql("records", """
    SELECT DISTINCT cast(date_trunc('month', start_date) as date)::string AS first_day, cast(last_day(start_date) as string) AS last_day
    FROM records"""))
def _(spark, d):
    y, m = F.year("start_date"), F.month("start_date")
    return star.records(spark, d).select(
        dates.month_start(y, m).cast("string").alias("first_day"), dates.month_end(y, m).cast("string").alias("last_day")).distinct()


@query("f11_build_text", sql("records", """
    SELECT record_id, concat_ws(' [SEP] ', nullif(trim(discrepancy), ''), nullif(trim(corrective_action), ''),
           upper(nullif(trim(base), ''))) AS text FROM records"""))
def _(spark, d):
    fields = ["discrepancy", "corrective_action", F.upper("base")]
    return star.records(spark, d).select("record_id", text.build_text(fields).alias("text"))


@query("f12_concat_pair", sql("records", "SELECT record_id, discrepancy || ' ' || base AS text FROM records"))
def _(spark, d):
    return star.records(spark, d).select("record_id", text.concat_pair("discrepancy", "base").alias("text"))


@query("f13_tokens", sql("tokens", "SELECT token, count(*) AS n FROM tokens GROUP BY 1"))
def _(spark, d):
    words = F.explode(text.keyword_tokens(text.normalize_phrase("discrepancy"))).alias("token")
    return star.records(spark, d).select(words).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("f14_confidence_band", sql("predicted", """
    SELECT CASE WHEN confidence_1 >= 70 THEN 'high (>=70%)' WHEN confidence_1 >= 30 THEN 'mid (30-70%)'
                ELSE 'low (<30%)' END AS band, count(*) AS n FROM predicted GROUP BY 1"""))
def _(spark, d):
    band = labels.confidence_band("confidence_1").alias("band")
    return star.predictions(star.records(spark, d)).groupBy(band).agg(F.count(F.lit(1)).alias("n"))


@query("f16_lifecycle_verdict", sql("records", """
    SELECT code, band, share, CASE WHEN share < 32 THEN 'none' WHEN band LIKE '%High' THEN 'high-time' ELSE 'low-time' END AS verdict
    FROM (SELECT code, arg_max(band, (n, -no)) AS band, 100.0::double * max(n) / sum(n) AS share FROM (
      SELECT code, no, band, count(*) AS n FROM (
        SELECT code, CASE WHEN flight_hours <= q0 THEN 0 WHEN flight_hours <= q1 THEN 1 WHEN flight_hours <= q2 THEN 2 ELSE 3 END AS no,
               CASE WHEN flight_hours <= q0 THEN 'Low' WHEN flight_hours <= q1 THEN 'Mid-Low'
                    WHEN flight_hours <= q2 THEN 'Mid-High' ELSE 'High' END AS band
        FROM records, (SELECT quantile_cont(flight_hours, 0.25) AS q0, quantile_cont(flight_hours, 0.5) AS q1,
                              quantile_cont(flight_hours, 0.75) AS q2 FROM records) e) x GROUP BY 1, 2, 3) y GROUP BY 1) z"""))
def _(spark, d):
    bands = sections.hour_bands(star.records(spark, d))
    order = F.struct("n", (-F.col("band_no")).alias("neg"))
    top = bands.groupBy("code").agg(F.max_by("band", order).alias("band"), (100.0 * F.max("n") / F.sum("n")).alias("share"))
    return top.withColumn("verdict", labels.lifecycle_verdict("band", "share"))


@query("f18_percent_text", sql("records", """
    SELECT code, printf('%.0f%%', round_even(100.0::double * a / n, 0)) AS share FROM (
      SELECT code, count(*) FILTER (discovered_code = 'A') AS a, count(*) AS n FROM records GROUP BY 1) x"""))
def _(spark, d):
    per = star.records(spark, d).groupBy("code").agg(
        F.count_if(F.col("discovered_code") == "A").alias("a"), F.count(F.lit(1)).alias("n"))
    return per.select("code", labels.percent_text("a", "n").alias("share"))


@query("f19_label_and_inverse", sql("records dictionary", """
    SELECT code, concat(code, ' (', description, ')') AS label, code AS code_again FROM dictionary"""))
def _(spark, d):
    known = star.code_dictionary(star.records(spark, d))
    label = labels.code_label("code", "description")
    return known.select("code", label.alias("label"), labels.code_of_label(label).alias("code_again"))


@query("f20_struct_to_json", sql("records", """
    SELECT record_id, concat('{', chr(10), '  "code" : "', code, '",', chr(10), '  "base" : ', CASE WHEN base IS NULL THEN 'null' ELSE concat('"', base, '"') END, ',', chr(10),
           '  "labor_hours" : ', cast(cast(labor_hours as double) as string), chr(10), '}') AS document FROM records"""))
def _(spark, d):
    recs = star.records(spark, d)
    return recs.select("record_id", labels.as_json(F.struct("code", "base", "labor_hours")).alias("document"))


@query("o5_topk_of_vector", """
    SELECT vec_id, cast(list_position(embedding, list_reverse_sort(embedding)[1]) - 1 as int) AS first,
           cast(list_position(embedding, list_reverse_sort(embedding)[2]) - 1 as int) AS second,
           cast(list_reverse_sort(embedding)[3] as double) AS third_score FROM embeddings""")
def _(spark, d):
    scores = F.col("embedding").cast("array<double>")
    best = star.table(spark, d, "embeddings").select("vec_id", arrays.top_positions(scores, 3).alias("best"))
    return best.select("vec_id", arrays.entry("best", 0, "position").alias("first"),
                       arrays.entry("best", 1, "position").alias("second"), arrays.entry("best", 2, "score").alias("third_score"))


@query("f21_softmax", """
    SELECT vec_id, round(list_max(e) / list_sum(e), 9) AS top_share, round(e[1] / list_sum(e), 9) AS first_share
    FROM (SELECT vec_id, list_transform(embedding, lambda x: exp(x::double)) AS e FROM embeddings) t""")
def _(spark, d):
    shares = star.table(spark, d, "embeddings").select(
        "vec_id", arrays.softmax(F.col("embedding").cast("array<double>")).alias("p"))
    return shares.select("vec_id", F.round(F.array_max("p"), 9).alias("top_share"),
                         F.round(F.get("p", F.lit(0)), 9).alias("first_share"))


@query("f22_half_even_rounding", sql("records", """
    SELECT record_id, round_even(labor_hours / 8, 2) AS eighths, round_even(labor_hours / 4, 1) AS quarters FROM records"""))
def _(spark, d):
    return star.records(spark, d).select(
        "record_id", F.bround(F.col("labor_hours") / 8, 2).alias("eighths"), F.bround(F.col("labor_hours") / 4, 1).alias("quarters"))


@query("f24_month_names", sql("records", """
    SELECT strftime(start_date, '%b') AS month_name, count(*) AS n FROM records GROUP BY 1"""))
def _(spark, d):
    name = dates.month_name(F.month("start_date")).alias("month_name")
    return star.records(spark, d).groupBy(name).agg(F.count(F.lit(1)).alias("n"))


# ---- questions -------------------------------------------------------------
# One question per record; see star.questions for the twelve phrasings.

QUESTIONS = {
    "q0": """
        SELECT record_id AS question_id, code, asset_id, cast(job_id as bigint) AS num,
               (cast(job_id as bigint) + length(discrepancy)) % 12 AS kind, strftime(start_date, '%b') AS mon,
               cast(month(start_date) as int) AS m,
               ['spring','summer','fall','winter','autumn'][num % 5 + 1] AS season, 2000 + num % 2 AS y, 2001 + num % 3 AS y2
        FROM records""",
    # What each phrasing asks for, written down from its meaning.
    "asked": f"""
        SELECT question_id,
          CASE WHEN kind IN (1,3,7,9,11) THEN asset_id END AS asset_id,
          CASE WHEN kind IN (0,3,4,6,7,8,10) THEN code END AS code,
          CASE kind
            WHEN 0 THEN make_date(y, CASE season WHEN 'spring' THEN 3 WHEN 'summer' THEN 6 WHEN 'winter' THEN 12 ELSE 9 END, 1)
            WHEN 1 THEN make_date(y, m, 1) WHEN 2 THEN make_date(y, 1, 1)
            WHEN 4 THEN make_date(y, CASE season WHEN 'spring' THEN 3 WHEN 'summer' THEN 6 WHEN 'winter' THEN 12 ELSE 9 END, 1)
            WHEN 5 THEN date '{AS_OF}' - cast(30 * (num % 30 + 1) as int)
            WHEN 6 THEN make_date(least(y, y2), 1, 1) WHEN 7 THEN make_date(y, m, 1)
            WHEN 8 THEN date '2001-01-01' WHEN 9 THEN make_date(y, 1, 1) WHEN 10 THEN make_date(y, 1, 1)
            WHEN 11 THEN date '{AS_OF}' - cast(365 * (num % 6 + 1) as int) END AS start_date,
          CASE kind
            WHEN 1 THEN last_day(make_date(y2, m, 1))
            WHEN 4 THEN last_day(make_date(CASE WHEN season = 'winter' THEN y + 1 ELSE y END,
                 CASE season WHEN 'spring' THEN 5 WHEN 'summer' THEN 8 WHEN 'winter' THEN 2 ELSE 11 END, 1))
            WHEN 5 THEN date '{AS_OF}' WHEN 6 THEN make_date(greatest(y, y2), 12, 31)
            WHEN 7 THEN last_day(make_date(y, m, 1)) WHEN 8 THEN date '2001-12-31' WHEN 9 THEN make_date(y2, 12, 31)
            WHEN 10 THEN make_date(y, 12, 31) WHEN 11 THEN date '{AS_OF}' END AS end_date
        FROM q0""",
}


@query("q1_extract_filters", sql("records", """
    SELECT question_id, asset_id, code, cast(start_date as string) AS start_date, cast(end_date as string) AS end_date,
           concat_ws(' · ', CASE WHEN asset_id IS NOT NULL THEN concat('Tail = **', asset_id, '**') END,
                     CASE WHEN code IS NOT NULL THEN concat('WUC = **', code, '**') END,
                     CASE WHEN start_date IS NOT NULL OR end_date IS NOT NULL THEN concat('dates **',
                       coalesce(strftime(start_date, '%b %Y'), 'earliest'), ' → ', coalesce(strftime(end_date, '%b %Y'), 'latest'), '**') END) AS applied
    FROM asked""", **QUESTIONS))
def _(spark, d):
    found = questions.extract_filters(star.questions(star.records(spark, d)), AS_OF)
    return questions.describe_filters(found).drop("question").withColumns(
        {c: F.col(c).cast("string") for c in ("start_date", "end_date")})


def parsed_sql(texts: str) -> dict[str, str]:
    """CTEs up to parsed(conv_id, turn, asset_id, code, start_date, end_date) from texts(conv_id, turn, q)."""
    full = ", ".join(f"'{calendar.month_name[m].lower()}'" for m in range(1, 13))
    short = ", ".join(f"'{calendar.month_abbr[m].lower()}'" for m in range(1, 13))
    month = lambda w: f"CASE WHEN {w} IN ({full}, {short}) THEN list_position([{short}], left({w}, 3)) END"
    group = lambda pattern, n: f"nullif(regexp_extract(r, '{pattern}', {n}), '')"
    y = r"(20\d{2})"
    month_range = rf"from\s+([a-z]+)\.?\s+{y}\s+to\s+([a-z]+)\.?\s+{y}"
    season = rf"(since|after|from|in|during)?\s*(spring|summer|fall|autumn|winter)\s+(of\s+)?{y}"
    since, single = rf"(since|after|from)\s+(?:([a-z]+)\.?\s+)?{y}", rf"\b([a-z]+)\.?\s+{y}\b"
    fields = {
        "m1": month(group(month_range, 1)), "y1": group(month_range, 2), "m2": month(group(month_range, 3)), "y2": group(month_range, 4),
        "ra": group(rf"from\s*{y}\s*to\s*{y}", 1), "rb": group(rf"from\s*{y}\s*to\s*{y}", 2),
        "pa": group(rf"between\s*{y}\s*and\s*{y}", 1), "pb": group(rf"between\s*{y}\s*and\s*{y}", 2),
        "lead": group(season, 1), "sea": group(season, 2), "sy": group(season, 4), "wm": month(group(since, 2)), "wy": group(since, 3),
        "om": month(group(single, 1)), "oy": group(single, 2), "yy": group(rf"\b(?:in\s+)?{y}\b", 1),
        "lm": group(r"last\s*(\d+)\s*month", 1), "ly": group(r"last\s*(\d+)\s*year", 1),
        "named": group(r"\bwuc[:#\s]*([0-9a-z]{4,6})\b", 1),
        "bare": r"list_filter(regexp_extract_all(r, '\b[0-9a-z]{5}\b'), lambda t: regexp_matches(t, '[0-9]') AND NOT regexp_matches(t, '^20\d{2}\w?$'))[1]",
    }
    first = "CASE sea WHEN 'spring' THEN 3 WHEN 'summer' THEN 6 WHEN 'winter' THEN 12 ELSE 9 END"
    last = "CASE sea WHEN 'spring' THEN 5 WHEN 'summer' THEN 8 WHEN 'winter' THEN 2 ELSE 11 END"
    day = lambda yr, m, d=1: f"make_date({yr}::int, ({m})::int, {d})"
    asof, winter_year = f"date '{AS_OF}'", "(sy::int + (sea = 'winter')::int)"
    back = lambda n, days: f"{asof} - least({n}::double * {days}, date_diff('day', date '0001-01-01', {asof}))::int"
    rows = [
        ("m1 IS NOT NULL AND m2 IS NOT NULL", day("y1", "m1"), f"last_day({day('y2', 'm2')})"), ("ra IS NOT NULL", day("ra", 1), day("rb", 12, 31)),
        ("pa IS NOT NULL", day("least(pa, pb)", 1), day("greatest(pa, pb)", 12, 31)),
        ("sy IS NOT NULL", day("sy", first), f"CASE WHEN lead IS NULL OR lead IN ('in', 'during') THEN last_day({day(winter_year, last)}) END"),
        ("wy IS NOT NULL", day("wy", "coalesce(wm, 1)"), "NULL"), ("om IS NOT NULL", day("oy", "om"), f"last_day({day('oy', 'om')})"),
        ("ly IS NOT NULL", back("ly", 365), asof), ("lm IS NOT NULL", back("lm", 30), asof),
        (r"regexp_matches(r, '\bthis year\b')", day(f"year({asof})", 1), day(f"year({asof})", 12, 31)),
        (r"regexp_matches(r, '\blast year\b')", day(f"(year({asof}) - 1)", 1), day(f"(year({asof}) - 1)", 12, 31)),
        ("yy IS NOT NULL", day("yy", 1), day("yy", 12, 31)),
    ]
    case = lambda i: "CASE " + " ".join(f"WHEN {r[0]} THEN {r[i]}" for r in rows) + " END"
    return {
        "blanked": rf"SELECT *, nullif(regexp_extract(q, '\b\d{{2}}-\d{{4}}\b'), '') AS asset_id, regexp_replace(q, '\b\d{{2}}-\d{{4}}\b', ' ', 'g') AS r FROM {texts}",
        "read_out": "SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in fields.items()) + " FROM blanked",
        "parsed": f"SELECT conv_id, turn, asset_id, upper(CASE WHEN regexp_matches(named, '[0-9]') THEN named ELSE bare END) AS code, "
                  f"({case(1)})::date AS start_date, ({case(2)})::date AS end_date FROM read_out",
    }


# Questions written by people, most of which ask for nothing.
@query("q12_filters_in_conversations", sql("", """
    SELECT conv_id, turn, asset_id, code, cast(start_date as string) AS start_date, cast(end_date as string) AS end_date,
           concat_ws(' · ', CASE WHEN asset_id IS NOT NULL THEN concat('Tail = **', asset_id, '**') END,
                     CASE WHEN code IS NOT NULL THEN concat('WUC = **', code, '**') END,
                     CASE WHEN start_date IS NOT NULL OR end_date IS NOT NULL THEN concat('dates **',
                       coalesce(strftime(start_date, '%b %Y'), 'earliest'), ' → ', coalesce(strftime(end_date, '%b %Y'), 'latest'), '**') END) AS applied
    FROM parsed""", texts="SELECT conv_id, turn, lower(text) AS q FROM conversations", **parsed_sql("texts")))
def _(spark, d):
    turns = star.table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("question"))
    found = questions.describe_filters(questions.extract_filters(turns, AS_OF))
    return found.drop("question").withColumns({c: F.col(c).cast("string") for c in ("start_date", "end_date")})


@query("j14_answer_questions", sql("records", """
    SELECT question_id, total, prior_total, total - prior_total AS delta,
           CASE WHEN prior_total IS NULL THEN NULL WHEN prior_total = 0 THEN 0
                ELSE 100.0::double * (total - prior_total) / prior_total END AS delta_pct
    FROM asked JOIN counted c ON asked.asset_id IS NOT DISTINCT FROM c.asset_id AND asked.code IS NOT DISTINCT FROM c.code
      AND asked.start_date IS NOT DISTINCT FROM c.start_date AND asked.end_date IS NOT DISTINCT FROM c.end_date""",
    **QUESTIONS,
    forms="""SELECT DISTINCT asset_id, code, start_date, end_date,
                    CASE WHEN start_date IS NOT NULL AND end_date IS NOT NULL
                         THEN start_date - cast(end_date - start_date + 1 as int) END AS prior_start FROM asked""",
    days="""SELECT NULL AS asset_id, NULL AS code, start_date AS day, count(*) AS n FROM records GROUP BY 3
            UNION ALL SELECT asset_id, NULL, start_date, count(*) FROM records GROUP BY 1, 3
            UNION ALL SELECT NULL, code, start_date, count(*) FROM records GROUP BY 2, 3
            UNION ALL SELECT asset_id, code, start_date, count(*) FROM records GROUP BY 1, 2, 3""",
    counted="""
        SELECT f.asset_id, f.code, f.start_date, f.end_date,
               coalesce(sum(n) FILTER (day >= coalesce(f.start_date, day) AND day <= coalesce(f.end_date, day)), 0)::bigint AS total,
               CASE WHEN prior_start IS NOT NULL
                    THEN coalesce(sum(n) FILTER (day >= prior_start AND day < f.start_date), 0)::bigint END AS prior_total
        FROM forms f LEFT JOIN days ON coalesce(f.asset_id, '') = coalesce(days.asset_id, '')
                                   AND coalesce(f.code, '') = coalesce(days.code, '')
        GROUP BY 1, 2, 3, 4, prior_start"""))
def _(spark, d):
    # Asked once, filtered once more and counted: three readers of the joined records.
    recs = stored(star.records(spark, d).select("record_id", "job_id", "code", "asset_id", "start_date", "discrepancy"))
    found = questions.extract_filters(stored(star.questions(recs)), AS_OF)
    return questions.answer_questions(found, recs).select("question_id", "total", "prior_total", "delta", "delta_pct")


# ---- plain text ------------------------------------------------------------

def listing(column: str) -> str:
    return f"""(SELECT string_agg(concat(chr(10), '- ', item, ' (', n, ')'), '' ORDER BY n DESC, item) FROM (
        SELECT trim({column}) AS item, count(*) AS n FROM records GROUP BY 1 ORDER BY n DESC, item LIMIT 5) x)"""


@query("n3_answer_text", sql("records", f"""
    SELECT concat('Total issues: ', format('{{:,}}', count(*)), chr(10), chr(10), 'Top discrepancies:', {listing('discrepancy')},
                  chr(10), chr(10), 'Top fixes:', {listing('corrective_action')}, chr(10)) AS answer FROM records"""))
def _(spark, d):
    recs = star.records(spark, d)
    total = recs.agg(F.count(F.lit(1)).alias("total"))
    return narrative.answer_text(total, counts.topn_counts(recs, "discrepancy"), counts.topn_counts(recs, "corrective_action"))


@query("n3_code_listing", sql("records", """
    SELECT concat('Top Problem Areas (WUC):', string_agg(concat(chr(10), r, '. ', rpad(item, 60, ' '), ' ', n), '' ORDER BY r), chr(10)) AS listing
    FROM (SELECT item, n, row_number() OVER (ORDER BY n DESC, item) AS r FROM (
      SELECT code AS item, count(*) AS n FROM records GROUP BY 1 ORDER BY n DESC, item LIMIT 10) x) y"""))
def _(spark, d):
    return narrative.code_list_text(counts.code_breakdown(star.records(spark, d)))


# ---- classification --------------------------------------------------------

@query("m5_token_counts", sql("records", """
    SELECT code, token, count(*) AS n FROM (
      SELECT code, unnest(list_filter(regexp_split_to_array(lower(discrepancy), '[^a-z0-9]+'), lambda w: length(w) > 0)) AS token
      FROM records) x GROUP BY 1, 2"""))
def _(spark, d):
    recs = star.records(spark, d)
    first = recs.where("start_date < date '1999-01-01'")
    later = recs.where("start_date >= date '1999-01-01'")
    old = classify.token_counts(first, "code", "discrepancy")
    return classify.add_counts(old, classify.token_counts(later, "code", "discrepancy"), "code")


def _documents(spark, d):
    return star.table(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("label"))


DOC_SPLITS = """
    SELECT *, CASE WHEN in_train THEN 'train'
                   WHEN row_number() OVER (PARTITION BY in_train ORDER BY md5(concat('43:', doc_id)))
                        <= floor(count(*) OVER (PARTITION BY in_train) / 2) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT doc_id AS key, doc_id, text, lang AS label,
                 row_number() OVER (PARTITION BY lang ORDER BY md5(concat('42:', doc_id)))
                   <= ceil(cast(0.8 as double) * count(*) OVER (PARTITION BY lang)) AS in_train FROM documents) x"""


def naive_bayes(name: str, train: str, asked: str, smoothing: float = 1.0) -> dict[str, str]:
    """CTEs up to {name}(key, label, confidence, rank), all labels ranked: train has label and text, asked has key and text."""
    words = "unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: length(w) > 0)) AS token"
    n = name
    return {
        f"{n}_tok": f"SELECT label, token, count(*) AS n FROM (SELECT label, {words} FROM {train} WHERE label IS NOT NULL) x GROUP BY 1, 2",
        f"{n}_lab": f"""SELECT label, ln(1.0::double / count(*) OVER ()) AS prior,
            ln({smoothing}::double / (coalesce(tokens, 0) + {smoothing}::double * (SELECT count(DISTINCT token) FROM {n}_tok))) AS absent
            FROM (SELECT DISTINCT label FROM {train} WHERE label IS NOT NULL) l LEFT JOIN (SELECT label, sum(n) AS tokens FROM {n}_tok GROUP BY 1) t USING (label)""",
        f"{n}_ask": f"SELECT text, token, count(*) AS tf FROM (SELECT text, {words} FROM (SELECT DISTINCT text FROM {asked}) d) x GROUP BY 1, 2",
        f"{n}_known": f"""SELECT d.text, coalesce(sum(tf), 0) AS known FROM (SELECT DISTINCT text FROM {asked} WHERE text IS NOT NULL) d
            LEFT JOIN (SELECT * FROM {n}_ask WHERE token IN (SELECT token FROM {n}_tok)) a USING (text) GROUP BY 1""",
        f"{n}_gain": f"SELECT text, label, sum(tf * ln((n + {smoothing}::double) / {smoothing}::double)) AS gained FROM {n}_ask JOIN {n}_tok USING (token) GROUP BY 1, 2",
        f"{n}_score": f"""SELECT text, label, round(prior + known * absent + coalesce(gained, 0), 8) AS score
            FROM {n}_known CROSS JOIN {n}_lab LEFT JOIN {n}_gain USING (text, label)""",
        f"{n}_rank": f"""SELECT text, label, 100.0 * exp(score - top) / sum(exp(score - top)) OVER (PARTITION BY text) AS confidence, rank
            FROM (SELECT *, max(score) OVER (PARTITION BY text) AS top, row_number() OVER (PARTITION BY text ORDER BY score DESC, label) AS rank FROM {n}_score) s""",
        n: f"SELECT key, r.label, confidence, rank FROM {asked} a JOIN {n}_rank r USING (text)",
    }


def f1_sql(pairs: str) -> str:
    """macro_f1 over pairs(truth, predicted)."""
    return f"""SELECT sum(support)::bigint AS n, count(*) AS labels, sum(tp) / sum(support) AS accuracy, avg(f1) AS macro_f1,
        sum(f1 * support) / sum(support) AS weighted_f1 FROM (
        SELECT label, sum(tp)::double AS tp, sum(support)::double AS support, 2.0 * sum(tp) / (sum(support) + sum(given)) AS f1 FROM (
          SELECT truth AS label, (truth IS NOT DISTINCT FROM predicted)::int AS tp, 1 AS support, 0 AS given FROM {pairs}
          UNION ALL SELECT predicted, 0, 0, 1 FROM {pairs}) x WHERE label IS NOT NULL GROUP BY 1) y"""


def pairs_sql(model: str, asked: str) -> str:
    return f"SELECT a.label AS truth, p.label AS predicted FROM {asked} a LEFT JOIN (SELECT * FROM {model} WHERE rank = 1) p USING (key)"


@query("m1_train_and_score", sql("", f1_sql("pairs"), docs=DOC_SPLITS, train="SELECT * FROM docs WHERE split = 'train'",
       asked="SELECT * FROM docs WHERE split <> 'train'", **naive_bayes("nb", "train", "asked"), pairs=pairs_sql("nb", "asked")))
def _(spark, d):
    docs = split.split(_documents(spark, d), "label", "doc_id")
    model = classify.train_classifier(docs.where("split = 'train'"), "label")
    scored = classify.predict_topk(model, docs.where("split <> 'train'"), 1)
    rows = scored.select(F.col("label").alias("truth"), arrays.entry("preds", 0, "code").alias("pred_1"))
    return evaluate.macro_f1(rows)


LEVEL_SQL = {"system": "substr(code, 1, 2)", "subsystem": "substr(code, 1, 3)", "code": "code"}


def _levels_sql() -> str:
    ctes, parts = {"rows": "SELECT r.record_id AS key, r.code, discrepancy AS text, split FROM records r JOIN splits USING (record_id)"}, []
    for level, label in LEVEL_SQL.items():
        ctes[f"t_{level}"] = f"SELECT {label} AS label, text FROM rows WHERE split = 'train'"
        ctes[f"q_{level}"] = f"SELECT key, {label} AS label, text FROM rows WHERE split = 'test'"
        ctes |= naive_bayes(f"nb_{level}", f"t_{level}", f"q_{level}")
        ctes[f"p_{level}"] = pairs_sql(f"nb_{level}", f"q_{level}")
        parts.append(f"SELECT '{level}' AS level, n, labels, accuracy, macro_f1 FROM ({f1_sql(f'p_{level}')}) z")
    return sql("records splits", " UNION ALL ".join(parts), **ctes)


@query("m2_train_by_level", _levels_sql())
def _(spark, d):
    recs = split.split(star.records(spark, d).select("record_id", "code", F.col("discrepancy").alias("text")), "code", "record_id")
    out = None
    for level in LEVEL_SQL:
        model = classify.train_classifier(recs.where("split = 'train'"), "code", level=level)
        scored = classify.predict_topk(model, recs.where("split = 'test'"), 1)
        rows = scored.select(classify.LEVELS[level]("code").alias("truth"), arrays.entry("preds", 0, "code").alias("pred_1"))
        part = evaluate.macro_f1(rows).select(F.lit(level).alias("level"), "n", "labels", "accuracy", "macro_f1")
        out = part if out is None else out.unionByName(part)
    return out


# Learned by steps, so SQL has no say; tests check slopes by differences and held-out rows against naive Bayes.
@query("m2_joint_levels")
def _(spark, d):
    recs = split.split(star.records(spark, d).select("record_id", "code", F.col("discrepancy").alias("text")), "code", "record_id")
    model = joint.fit_joint(recs.where("split = 'train'"), "code", "record_id")
    scored = keep(joint.predict_joint(model, recs.where("split = 'test'"), 1))
    out = None
    for level, pred in (("system", F.col("pred_system")), ("subsystem", F.col("pred_subsystem")), ("code", arrays.entry("preds", 0, "code"))):
        rows = scored.select(classify.LEVELS[level]("code").alias("truth"), pred.alias("pred_1"))
        part = evaluate.macro_f1(rows).select(F.lit(level).alias("level"), "n", "labels", "accuracy", "macro_f1")
        out = part if out is None else out.unionByName(part)
    return out


# A model of the earlier records goes on with the later ones; new codes join its labels.
@query("m5_continued_joint")
def _(spark, d):
    recs = split.split(star.records(spark, d).select("record_id", "code", "start_date", F.col("discrepancy").alias("text")), "code", "record_id")
    train = recs.where("split = 'train'")
    earlier = joint.fit_joint(train.where("start_date < date '1996-01-01'"), "code", "record_id", rounds=4)
    later = joint.fit_joint(train.where("start_date >= date '1996-01-01'"), "code", "record_id", rounds=4, start=earlier)
    scored = joint.predict_joint(later, recs.where("split = 'test'"))
    return evaluate.wide_predictions(scored, 3).select("record_id", F.col("code").alias("truth"), "pred_system", "pred_subsystem", "pred_1", "pred_2", "pred_3", "confidence_1")


@query("m3_predict_topk", sql("", """
    SELECT doc_id, a.label AS truth, max(p.label) FILTER (rank = 1) AS pred_1, max(p.label) FILTER (rank = 2) AS pred_2,
           max(p.label) FILTER (rank = 3) AS pred_3, round_even(max(confidence) FILTER (rank = 1), 2) AS confidence_1,
           round_even(max(confidence) FILTER (rank = 2), 2) AS confidence_2, round_even(max(confidence) FILTER (rank = 3), 2) AS confidence_3
    FROM asked a LEFT JOIN nb p USING (key) GROUP BY doc_id, a.label""", docs=DOC_SPLITS, train="SELECT * FROM docs WHERE split = 'train'",
    asked="SELECT * FROM docs WHERE split <> 'train'", **naive_bayes("nb", "train", "asked")))
def _(spark, d):
    docs = split.split(_documents(spark, d), "label", "doc_id")
    model = classify.train_classifier(docs.where("split = 'train'"), "label")
    wide = evaluate.wide_predictions(classify.predict_topk(model, docs.where("split <> 'train'"), 3), 3)
    return wide.select("doc_id", F.col("label").alias("truth"), "pred_1", "pred_2", "pred_3", "confidence_1", "confidence_2", "confidence_3")


# The same rows in three batches, one of them replayed, compacted on the way: predictions equal those of one fit.
@query("m5_stored_counts", sql("", "SELECT doc_id, p.label AS pred_1, round_even(confidence, 2) AS confidence_1 FROM asked a LEFT JOIN nb p ON a.key = p.key AND rank = 1",
       docs=DOC_SPLITS, train="SELECT * FROM docs WHERE split = 'train'", asked="SELECT * FROM docs WHERE split <> 'train'", **naive_bayes("nb", "train", "asked")))
def _(spark, d):
    docs = split.split(_documents(spark, d), "label", "doc_id")
    train = docs.where("split = 'train'")
    path = f"{ensure_checkpoint_dir(spark)}/counts-{uuid.uuid4().hex}"
    third = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    for part in (0, 1, 1):
        count_store.append_batch(train.where(third == part), path, f"part-{part}", "label")
    count_store.compact(spark, path)
    count_store.append_batch(train.where(third == 2), path, "part-2", "label")
    scored = classify.predict_topk(count_store.stored_model(spark, path), docs.where("split <> 'train'"), 1)
    return evaluate.wide_predictions(scored, 1).select("doc_id", "pred_1", "confidence_1")


def _selected_sql() -> str:
    ctes = {"docs": DOC_SPLITS, "train": "SELECT * FROM docs WHERE split = 'train'", "val": "SELECT * FROM docs WHERE split = 'val'",
            "test": "SELECT * FROM docs WHERE split = 'test'"}
    for name, smoothing in (("low", 0.1), ("high", 1.0)):
        ctes |= naive_bayes(f"{name}_val", "train", "val", smoothing) | naive_bayes(f"{name}_test", "train", "test", smoothing)
        ctes[f"{name}_vp"], ctes[f"{name}_tp"] = pairs_sql(f"{name}_val", "val"), pairs_sql(f"{name}_test", "test")
    score = lambda pairs: f"(SELECT macro_f1 FROM ({f1_sql(pairs)}) s)"
    ctes["pairs"] = (f"SELECT * FROM low_tp WHERE {score('low_vp')} >= {score('high_vp')} "
                     f"UNION ALL SELECT * FROM high_tp WHERE {score('low_vp')} < {score('high_vp')}")
    return sql("", f1_sql("pairs"), **ctes)


@query("m4_select_by_macro_f1", _selected_sql())
def _(spark, d):
    docs = split.split(_documents(spark, d), "label", "doc_id")
    part = lambda name: docs.where(F.col("split") == name)
    settings = [{"smoothing": 0.1}, {"smoothing": 1.0}]
    model, _tried = classify.best_by_macro_f1(part("train"), part("val"), "label", settings)
    scored = classify.predict_topk(model, part("test"), 1)
    rows = scored.select(F.col("label").alias("truth"), arrays.entry("preds", 0, "code").alias("pred_1"))
    return evaluate.macro_f1(rows)


def _prediction_sql() -> str:
    high, mid, low = CONFIDENCE_BANDS
    first, second = CONFIDENCE_EDGES
    ctes = {
        "texts": f"SELECT record_id AS key, code AS label, concat(trim(discrepancy), '{TEXT_SEPARATOR}', trim(corrective_action)) AS text, discrepancy, corrective_action FROM records",
        "once": "SELECT min(key) AS key, label, text FROM texts WHERE length(text) >= 10 AND regexp_full_match(label, '[A-Z0-9]{3,6}') GROUP BY label, text",
        "train": """SELECT label, text FROM (
            SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', key))) AS place, count(*) OVER (PARTITION BY label) AS n FROM once) o
            WHERE n >= 5 AND place <= ceil(cast(0.8 AS double) * n)""",
        "asked": "SELECT key, label, upper(text) AS text, discrepancy, corrective_action FROM texts WHERE upper(text) NOT IN (SELECT upper(text) FROM train)",
        **naive_bayes("nb", "train", "asked"),
        "wide": """SELECT key, max(label) FILTER (rank = 1) AS pred_1, max(label) FILTER (rank = 2) AS pred_2, max(label) FILTER (rank = 3) AS pred_3,
            round_even(max(confidence) FILTER (rank = 1), 2) AS confidence_1 FROM nb WHERE rank <= 3 GROUP BY key""",
        "banded": f"""SELECT *, CASE WHEN confidence_1 >= {first} THEN '{high}' WHEN confidence_1 >= {second} THEN '{mid}' ELSE '{low}' END AS confidence_band FROM wide""",
    }
    return sql("records dictionary", """
        SELECT key AS record_id, discrepancy, corrective_action, pred_1, pred_2, pred_3, confidence_1,
               coalesce(description, concat('(no dictionary entry for ', pred_1, ')')) AS pred_definition_1, confidence_band, text AS model_input, label AS truth,
               '' AS true_code, '' AS top1_correct, '' AS top3_correct, '' AS notes
        FROM (SELECT *, row_number() OVER (PARTITION BY confidence_band ORDER BY md5(concat('42:', key))) AS place FROM banded) b
        JOIN asked USING (key) LEFT JOIN dictionary ON pred_1 = dictionary.code WHERE place <= 34""", **ctes)


# Whole file: codes in full, texts the model has seen left out, every other record scored, a sheet drawn from it.
@query("m7_prediction_file", _prediction_sql())
def _(spark, d):
    recs = star.records(spark, d)
    ready = scoring.prepare_training(recs)
    seen = ready.where("split = 'train'")
    model = classify.train_classifier(seen, "code")
    predicted = scoring.batch_predict(recs, model, star.code_dictionary(recs), seen)
    return scoring.labeling_worksheet(predicted)
