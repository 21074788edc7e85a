"""Maintenance records, predictions and dimensions seen over a star schema.

The test tables are a sales star schema. These views read one maintenance
record out of every line item, so that every operator can run on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hangarlog.functions.text import as_column


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _text(c: Column | str) -> Column:
    return as_column(c).cast("string")


def records(spark: SparkSession, folder: str) -> DataFrame:
    line = table(spark, folder, "lineitem")
    part = table(spark, folder, "part")
    supplier = table(spark, folder, "supplier")
    nation = table(spark, folder, "nation")
    site = (
        F.when((F.col("l_linenumber") == 7) & (F.col("l_tax") == 0), F.lit(None).cast("string"))
        .when(F.col("l_linenumber") % 3 == 0, F.concat("n_name", F.lit(" AFB (ANG)")))
        .when(F.col("l_linenumber") % 3 == 1, F.lower("n_name"))
        .otherwise(F.concat(F.lit(" "), "n_name", F.lit(" ")))
    )
    ending = (
        F.when(F.col("l_linenumber") % 3 == 0, ".").when(F.col("l_linenumber") % 3 == 1, " (/) ").otherwise("")
    )
    return (
        line.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat_ws("-", _text("l_orderkey"), _text("l_linenumber"), _text("l_partkey"), _text("l_suppkey"))
            .alias("record_id"),
            F.concat(
                F.lpad(_text("p_size"), 2, "0"),
                F.substring("p_type", 1, 1),
                F.lpad(F.regexp_extract("p_brand", "([0-9]+)", 1), 2, "0"),
            ).alias("code"),
            F.concat(F.lpad(_text("s_nationkey"), 2, "0"), F.lit("-"), F.lpad(_text("l_suppkey"), 4, "0"))
            .alias("asset_id"),
            site.alias("base"),
            F.col("l_shipdate").cast("date").alias("start_date"),
            F.col("l_quantity").alias("labor_hours"),
            F.col("l_extendedprice").alias("flight_hours"),
            _text("l_orderkey").alias("job_id"),
            F.col("l_returnflag").alias("discovered_code"),
            F.upper(F.substring("p_name", 1, 1)).alias("maint_type_code"),
            F.concat(F.upper("p_name"), ending).alias("discrepancy"),
            F.concat(F.lit("REPLACED "), "p_type", F.lit(" "), "p_brand").alias("corrective_action"),
        )
    )


def code_dictionary(recs: DataFrame) -> DataFrame:
    """Descriptions for the codes that end in an even digit, so lookups miss."""
    return (
        recs.select("code").distinct()
        .where(F.right("code", F.lit(1)).isin("0", "2", "4", "6", "8"))
        .select("code", F.concat(F.lit("PART "), "code").alias("description"))
    )


def gazetteer(spark: SparkSession, folder: str) -> DataFrame:
    """One keyword per nation but one, longest first."""
    nation = table(spark, folder, "nation").where("n_nationkey <> 7")
    return nation.selectExpr(
        "cast(row_number() over (order by length(n_name) desc, n_name) as int) AS rk",
        "n_name AS keyword",
        "concat('Site ', n_name) AS name",
        "cast(n_nationkey as double) AS lat",
        "cast(-n_nationkey as double) AS lon",
    )


def predictions(recs: DataFrame, right: int = 16) -> DataFrame:
    """A model that is right on ``right`` of every 20 jobs and errs in three ways."""
    h = F.col("job_id").cast("bigint") % 20
    conf = (F.col("job_id").cast("bigint") * 37 + F.col("labor_hours").cast("bigint") * 11) % 1000 / F.lit(10.0)
    code = lambda start, n: F.substring("code", start, n)
    return recs.select(
        "record_id",
        F.col("code").alias("truth"),
        F.when(h < right, F.col("code"))
        .when(h < 18, F.concat(code(1, 3), code(5, 1), code(4, 1)))
        .when(h == 18, F.concat(code(1, 2), F.lit("X"), code(4, 2)))
        .otherwise(F.concat(code(2, 1), code(1, 1), code(3, 3)))
        .alias("pred_1"),
        conf.alias("confidence_1"),
    )


def questions(recs: DataFrame) -> DataFrame:
    """One question per record, asking about its code, its asset or its time."""
    number = F.col("job_id").cast("bigint")
    kind = (number + F.length("discrepancy")) % 12
    year = (2000 + number % 2).cast("string")
    later = (2001 + number % 3).cast("string")
    month = F.date_format("start_date", "MMM")
    season = F.element_at(
        F.array(*[F.lit(s) for s in ("spring", "summer", "fall", "winter", "autumn")]), (number % 5 + 1).cast("int")
    )
    word = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    code, asset = F.col("code"), F.col("asset_id")
    forms = [
        word("WUC ", code, " since ", season, " ", year),
        word(asset, " from ", month, " ", year, " to ", month, " ", later),
        word("which wuc since ", year),
        word(asset, " issues with ", code),
        word("How many ", F.lower(code), " in ", season, " of ", year, "?"),
        word("last ", (number % 30 + 1).cast("string"), " months"),
        word(code, " between ", later, " and ", year),
        word("wuc: ", code, " on ", asset, " ", month, " ", year),
        word(code, " this year"),
        word(asset, " from ", year, " to ", later),
        word("sept ", year, " for wuc#", code),
        word("  anything on ", asset, " in the last ", (number % 6 + 1).cast("string"), " years? "),
    ]
    text = F.when(F.lit(False), "")
    for k, form in enumerate(forms):
        text = text.when(kind == k, form)
    return recs.select(F.col("record_id").alias("question_id"), text.alias("question"))


def overlapping_extracts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Two extracts of the event log; a third of the rows is in both."""
    events = table(spark, folder, "events")
    a = events.where("event_id % 3 <> 0")
    b = events.where("event_id % 3 <> 1").select("event_id", "ts", "user_id", "event_type", "value")
    return a, b
