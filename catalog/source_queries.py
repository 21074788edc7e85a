"""Scans and sinks: given tables are written, read again, and compared with the tables themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession, functions as F

from catalog.base import query, sql
from catalog.text_queries import DOC_SPLITS
from hangarlog.functions import text
from hangarlog.operators import split
from hangarlog.session import ensure_checkpoint_dir
from hangarlog.sources import readers, sinks, star


def _folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/source-{uuid.uuid4().hex}"


@query("s7_csv_round_trip", "SELECT cast(doc_id as string) AS doc_id, cast(quality as string) AS quality, cast(toxic as string) AS toxic FROM labels")
def _(spark, d):
    path = _folder(spark)
    sinks.write_csv(star.table(spark, d, "labels"), path)
    return readers.read_csv(spark, path)


@query("s1_csv_with_line_breaks", "SELECT cast(doc_id as string) AS doc_id, md5(text) AS digest, lang FROM documents")
def _(spark, d):
    path = _folder(spark)
    sinks.write_csv(star.table(spark, d, "documents").select("doc_id", "text", "lang"), path)
    return readers.read_csv(spark, path, multiline=True).select("doc_id", F.md5("text").alias("digest"), "lang")


@query("s8_json_round_trip", "SELECT doc_id, md5(text) AS digest, lang, n_chars FROM documents")
def _(spark, d):
    path, docs = _folder(spark), star.table(spark, d, "documents")
    sinks.write_json(docs, path)
    return spark.read.schema(docs.schema).json(path).select("doc_id", F.md5("text").alias("digest"), "lang", "n_chars")


@query("s6_split_folders", sql("", "SELECT doc_id, split FROM docs", docs=DOC_SPLITS))
def _(spark, d):
    path = _folder(spark)
    docs = star.table(spark, d, "documents").select("doc_id", F.col("lang").alias("label"))
    sinks.write_splits(split.split(docs, "label", "doc_id"), path)
    return readers.read_parquet(spark, path, ["doc_id", "split"])


@query("s6_records_by_year", sql("records", """
    SELECT cast(year(start_date) as int) AS record_year, code, count(*) AS n, count(DISTINCT record_id) AS records FROM records GROUP BY 1, 2"""))
def _(spark, d):
    path = _folder(spark)
    sinks.write_records(star.records(spark, d), path)
    return readers.read_parquet(spark, path).groupBy("record_year", "code").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("record_id").alias("records"))


# The JSON map covers the codes of systems below 25, in lower case; the CSV all that end in an even digit.
@query("s3_code_dictionary", sql("records dictionary", """
    SELECT code, min_by(description, o) AS description FROM (
      SELECT DISTINCT code, concat('MAP ', code) AS description, 0 AS o FROM records WHERE substr(code, 1, 2) < '25'
      UNION ALL SELECT code, description, 1 FROM dictionary) x GROUP BY code"""))
def _(spark, d):
    recs, json_path, csv_path = star.records(spark, d), _folder(spark), _folder(spark)
    codes = recs.select("code").distinct().where(text.system_of("code") < "25")
    entries = F.collect_list(F.struct(F.lower("code").alias("k"), F.concat(F.lit("MAP "), "code").alias("v")))
    codes.agg(F.to_json(F.map_from_entries(entries)).alias("value")).coalesce(1).write.text(json_path)  # one object is the format
    sinks.write_csv(star.code_dictionary(recs).withColumnRenamed("code", "wuc_code"), csv_path)
    return readers.load_code_dictionary(spark, json_path, csv_path)


@query("s4_json_map", "SELECT lang AS key, cast(count(*) as string) AS value FROM documents GROUP BY 1")
def _(spark, d):
    path = _folder(spark)
    counts = star.table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).cast("string").alias("n"))
    counts.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("lang", "n")))).alias("value")).coalesce(1).write.text(path)
    return readers.read_json_map(spark, path)
