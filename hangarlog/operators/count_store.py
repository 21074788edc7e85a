"""A folder of training counts that grows by batches: appended once however often replayed, and compacted.

    <path>/batches/<batch>/tokens, labels       counts of one batch
    <path>/bases/<number>/tokens, labels, taken sums of the batches named in taken

A batch counts once its label counts are written, a base once the names it has
taken are; both are written last. What a job that broke off has left is never
read and is overwritten when the job is repeated. One writer at a time; readers
may read all the while.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from hangarlog.operators.classify import LEVELS, CountModel, fit_counts, label_counts, token_counts

_TOKENS, _LABELS, _TAKEN = "target string, token string, n long", "target string, rows long", "batch string"


def _children(spark: SparkSession, path: str, done_by: str) -> list[str]:
    """Names of the folders in a path whose last part is whole."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return sorted(n for n in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/{done_by}/_SUCCESS")))


def _base(spark: SparkSession, path: str) -> tuple[int, set[str]]:
    """Number of the newest base (0: none) and the batches it has taken; one name a batch."""
    numbers = [int(n) for n in _children(spark, f"{path}/bases", "taken")]
    if not numbers:
        return 0, set()
    return max(numbers), {r["batch"] for r in spark.read.schema(_TAKEN).parquet(f"{path}/bases/{max(numbers)}/taken").collect()}


def batches(spark: SparkSession, path: str) -> list[str]:
    """Names of all batches that count, taken by a base or not."""
    return sorted(_base(spark, path)[1] | set(_children(spark, f"{path}/batches", "labels")))


def append_batch(df: DataFrame, path: str, batch: str, label: str, text: str = "text", level: str = "code") -> bool:
    """Add the counts of labelled texts as a batch of that name; false if the store has it already.

    The name says what the batch holds: a name that is known changes nothing,
    whatever the rows. Rows with a null label don't count; a null text counts
    as a row of its label. A batch without rows counts as empty.
    """
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]*", batch):
        raise ValueError(f"a batch is named by letters, digits, _ and -, not {batch!r}")
    spark = df.sparkSession
    if batch in batches(spark, path):
        return False
    rows = df.where(F.col(label).isNotNull()).select(LEVELS[level](label).alias("target"), F.col(text).alias("text"))
    token_counts(rows, "target").select(F.col("target").cast("string"), "token", "n").write.mode("overwrite").parquet(f"{path}/batches/{batch}/tokens")
    label_counts(rows, "target").select(F.col("target").cast("string"), "rows").write.mode("overwrite").parquet(f"{path}/batches/{batch}/labels")
    return True


def read_counts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Token counts (target, token, n) and label counts (target, rows) over all batches."""
    number, taken = _base(spark, path)
    folders = [f"{path}/bases/{number}"] if number else []
    folders += [f"{path}/batches/{b}" for b in _children(spark, f"{path}/batches", "labels") if b not in taken]

    def summed(part: str, schema: str, keys: list[str], count: str) -> DataFrame:
        read = spark.read.schema(schema).parquet(*[f"{f}/{part}" for f in folders]) if folders else spark.createDataFrame([], schema)
        return read.groupBy(*keys).agg(F.sum(count).alias(count))

    return summed("tokens", _TOKENS, ["target", "token"], "n"), summed("labels", _LABELS, ["target"], "rows")


def compact(spark: SparkSession, path: str) -> int:
    """Sum base and batches into a new base; its number. Nothing new to take leaves the store as it is."""
    number, taken = _base(spark, path)
    every = batches(spark, path)
    if set(every) == taken:
        return number
    tokens, labels = read_counts(spark, path)
    target = f"{path}/bases/{number + 1}"
    tokens.write.mode("overwrite").parquet(f"{target}/tokens")
    labels.write.mode("overwrite").parquet(f"{target}/labels")
    spark.createDataFrame([(b,) for b in every], _TAKEN).coalesce(1).write.mode("overwrite").parquet(f"{target}/taken")
    return number + 1


def vacuum(spark: SparkSession, path: str) -> None:
    """Delete batches that the newest base has taken, and older bases; readers of those must have ended."""
    number, taken = _base(spark, path)
    gone = [f"{path}/batches/{b}" for b in _children(spark, f"{path}/batches", "labels") if b in taken]
    gone += [f"{path}/bases/{n}" for n in _children(spark, f"{path}/bases", "taken") if int(n) < number]
    for name in gone:
        folder = spark._jvm.org.apache.hadoop.fs.Path(name)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored_model(spark: SparkSession, path: str, weighted: bool = True, smoothing: float = 1.0) -> CountModel:
    """The classifier that training on all rows of all batches gives."""
    tokens, labels = read_counts(spark, path)
    return fit_counts(tokens, labels, "target", weighted, smoothing)
