"""Scans: record extracts, dictionaries, JSON maps, parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from hangarlog.functions.text import blank_to_null
from hangarlog.schema import RAW_SCHEMA, RECORD_COLUMNS


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None,
             multiline: bool = False) -> DataFrame:
    """CSV with a header. Without a schema every column is text; nothing is inferred.

    Spark splits large files. Extracts whose quoted fields may hold line breaks
    need ``multiline=True``, which makes one file one task.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    reader = reader.option("multiLine", multiline).option("escape", '"')
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def read_parquet(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.parquet(*paths)
    return df.select(*columns) if columns else df


def read_table(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Parquet or CSV, told apart by the suffix."""
    if path.lower().rstrip("/").endswith(".parquet"):
        return read_parquet(spark, path)
    return read_csv(spark, path, multiline=multiline)


def rename_columns(df: DataFrame) -> DataFrame:
    """Source column names to ours; columns without one keep their name."""
    names = {source: name for source, (name, _) in RECORD_COLUMNS.items()}
    if "code" not in df.columns and "Corrected WUC" not in df.columns:
        names["WUC"] = "code"
    return df.withColumnsRenamed({c: names[c] for c in df.columns if c in names})


def load_records(spark: SparkSession, path: str | Sequence[str], fmt: str | None = None, multiline: bool = False) -> DataFrame:
    """A record table under our column names, still untyped text when from CSV."""
    paths = [path] if isinstance(path, str) else list(path)
    fmt = fmt or ("parquet" if all(p.lower().rstrip("/").endswith(".parquet") for p in paths) else "csv")
    if fmt == "parquet":
        return rename_columns(read_parquet(spark, paths))
    return rename_columns(read_csv(spark, paths, multiline=multiline))


def read_raw_extract(spark: SparkSession, path: str | Sequence[str], multiline: bool = False) -> DataFrame:
    """An extract with exactly the known source columns, by the declared schema."""
    return rename_columns(read_csv(spark, path, schema=RAW_SCHEMA, multiline=multiline))


def read_code_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Code and description, from columns of those names or the first two."""
    df = read_csv(spark, path)
    code = "wuc_code" if "wuc_code" in df.columns else df.columns[0]
    description = "description" if "description" in df.columns else df.columns[1]
    return df.select(
        blank_to_null(F.upper(F.col(code))).alias("code"), F.col(description).alias("description")
    ).where("code IS NOT NULL AND description IS NOT NULL")


DICTIONARY_SCHEMA = "code string, description string"


def load_code_dictionary(spark: SparkSession, json_path: str | None = None, csv_path: str | None = None) -> DataFrame:
    """Code and description: the JSON map first, the CSV for codes it lacks; empty where neither is given or there.

    A file that exists but cannot be read is an error, not an empty dictionary.
    """
    def there(path: str | None) -> bool:
        if not path:
            return False
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)

    parts = []
    if there(json_path):
        mapped = read_json_map(spark, json_path, "code", "description")
        parts.append(mapped.select(blank_to_null(F.upper("code")).alias("code"), "description", F.lit(0).alias("order")))
    if there(csv_path):
        parts.append(read_code_dictionary(spark, csv_path).withColumn("order", F.lit(1)))
    if not parts:
        return spark.createDataFrame([], DICTIONARY_SCHEMA)
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    best = F.min(F.struct("order", "description")).alias("best")
    return both.where("code IS NOT NULL AND description IS NOT NULL").groupBy("code").agg(best).select("code", "best.description")


def read_json_map(spark: SparkSession, path: str, key: str = "key", value: str = "value") -> DataFrame:
    """A file holding one JSON object, as one row per member."""
    document = spark.read.text(path, wholetext=True)
    members = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    return document.select(F.explode(members).alias(key, value))
