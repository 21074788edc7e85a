"""Registry of the checked queries, and the SQL side of the test views.

Every query is a function (spark, folder) -> DataFrame over whole tables. Its
SQL twin, where there is one, states the same result independently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hangarlog.reference_data import DISCOVERY_PHASES, MAINTENANCE_PHASES, STOPWORDS, SYSTEMS
from hangarlog.plans import sizing
from hangarlog.session import SETTINGS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2001-06-30"
CODE, ASSET = "04S15", "15-0000"
START, END = "1997-01-01", "1998-06-30"
RARE = 20


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        def prepared(spark: SparkSession, folder: str) -> DataFrame:
            sizing.release()  # what the query before has kept
            chosen = spark.conf.getAll  # what the caller has set stands
            for key, value in SETTINGS.items():
                if key.startswith("spark.sql.") and key not in chosen:
                    spark.conf.set(key, value)
            return run(spark, folder)

        QUERIES[name] = prepared
        if sql is not None:
            ORACLES[name] = sql
        return run
    return register


def _values(rows: list[tuple], names: str) -> str:
    lines = ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {lines}) AS v({names})"


PHRASE = "trim(regexp_replace(upper({0}), '[^A-Z0-9]+', ' ', 'g'))"

VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "records": ("""
        SELECT concat(cast(l_orderkey as string),'-',cast(l_linenumber as string),'-',
                      cast(l_partkey as string),'-',cast(l_suppkey as string)) AS record_id,
               concat(lpad(cast(p_size as string),2,'0'), substr(p_type,1,1),
                      lpad(regexp_extract(p_brand,'([0-9]+)',1),2,'0')) AS code,
               concat(lpad(cast(s_nationkey as string),2,'0'),'-',lpad(cast(l_suppkey as string),4,'0')) AS asset_id,
               CASE WHEN l_linenumber=7 AND l_tax=0 THEN NULL
                    WHEN l_linenumber%3=0 THEN concat(n_name,' AFB (ANG)')
                    WHEN l_linenumber%3=1 THEN lower(n_name)
                    ELSE concat(' ',n_name,' ') END AS base,
               cast(l_shipdate as date) AS start_date,
               l_quantity AS labor_hours, l_extendedprice AS flight_hours,
               cast(l_orderkey as string) AS job_id,
               l_returnflag AS discovered_code, upper(substr(p_name,1,1)) AS maint_type_code,
               concat(upper(p_name), CASE l_linenumber%3 WHEN 0 THEN '.' WHEN 1 THEN ' (/) ' ELSE '' END) AS discrepancy,
               concat('REPLACED ',p_type,' ',p_brand) AS corrective_action
        FROM lineitem JOIN part ON l_partkey=p_partkey
                      JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey""", ()),
    "dictionary": ("""
        SELECT DISTINCT code, concat('PART ', code) AS description FROM records
        WHERE substr(code, 5, 1) IN ('0','2','4','6','8')""", ("records",)),
    "gaz": ("""
        SELECT n_name AS keyword, concat('Site ', n_name) AS name, cast(n_nationkey as double) AS lat,
               cast(-n_nationkey as double) AS lon,
               cast(row_number() over (order by length(n_name) desc, n_name) as int) AS rk
        FROM nation WHERE n_nationkey<>7""", ()),
    "located": ("""
        SELECT base_key, min_by(name, rk) AS site, min_by(lat, rk) AS lat, min_by(lon, rk) AS lon
        FROM (SELECT DISTINCT upper(trim(base)) AS base_key FROM records WHERE trim(base) <> '')
        LEFT JOIN gaz ON contains(base_key, keyword) GROUP BY base_key""", ("records", "gaz")),
    "base_n": ("""
        SELECT code, upper(trim(base)) AS base_key, count(*) AS n FROM records
        WHERE base IS NOT NULL GROUP BY 1, 2""", ("records",)),
    "predicted": ("""
        SELECT record_id, code AS truth,
               CASE WHEN h<16 THEN code
                    WHEN h<18 THEN concat(substr(code,1,3),substr(code,5,1),substr(code,4,1))
                    WHEN h=18 THEN concat(substr(code,1,2),'X',substr(code,4,2))
                    ELSE concat(substr(code,2,1),substr(code,1,1),substr(code,3,3)) END AS pred_1,
               CASE WHEN h<14 THEN code
                    WHEN h<18 THEN concat(substr(code,1,3),substr(code,5,1),substr(code,4,1))
                    WHEN h=18 THEN concat(substr(code,1,2),'X',substr(code,4,2))
                    ELSE concat(substr(code,2,1),substr(code,1,1),substr(code,3,3)) END AS old_1,
               conf AS confidence_1
        FROM (SELECT record_id, code, cast(job_id as bigint)%20 AS h,
                     (cast(job_id as bigint)*37+cast(labor_hours as bigint)*11)%1000/cast(10 as double) AS conf
              FROM records) x""", ("records",)),
    "label_space": (f"SELECT code FROM records GROUP BY code HAVING count(*) >= {RARE}", ("records",)),
    "extract_a": ("SELECT * FROM events WHERE event_id % 3 <> 0", ()),
    "extract_b": ("SELECT event_id, ts, user_id, event_type, value FROM events WHERE event_id % 3 <> 1", ()),
    "deduped": ("""
        SELECT min(doc_id) AS doc_id, text, lang FROM documents GROUP BY text, lang""", ()),
    "discovery": (_values(DISCOVERY_PHASES, "phase_code, phase"), ()),
    "maintenance": (_values(MAINTENANCE_PHASES, "phase_code, phase"), ()),
    "systems": (_values(SYSTEMS, "prefix, system"), ()),
    "tokens": (f"""
        SELECT code, lower(token) AS token FROM (
            SELECT code, unnest(string_split({PHRASE.format('discrepancy')}, ' ')) AS token FROM records) x
        WHERE length(token) >= 3 AND NOT regexp_matches(token, '^[0-9]+$')
          AND lower(token) NOT IN ({", ".join(f"'{w}'" for w in STOPWORDS)})""", ("records",)),
    "splits": ("""
        SELECT *, CASE WHEN in_train THEN 'train'
                       WHEN row_number() OVER (PARTITION BY in_train ORDER BY md5(concat('43:', record_id)))
                            <= floor(count(*) OVER (PARTITION BY in_train) / 2) THEN 'val' ELSE 'test' END AS split
        FROM (SELECT record_id, code,
                     row_number() OVER (PARTITION BY code ORDER BY md5(concat('42:', record_id)))
                       <= ceil(cast(0.8 as double) * count(*) OVER (PARTITION BY code)) AS in_train
              FROM records) x""", ("records",)),
}


def sql(views: str, select: str, **ctes: str) -> str:
    """A query over the named views and further common table expressions."""
    parts: dict[str, str] = {}

    def need(name: str) -> None:
        if name in parts:
            return
        body, deeper = VIEWS[name]
        for other in deeper:
            need(other)
        parts[name] = body

    for view in views.split():
        need(view)
    parts.update(ctes)
    if not parts:
        return select
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in parts.items()) + "\n" + select
