"""Joins against small tables, with the size looked at before broadcasting."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from hangarlog.session import ensure_checkpoint_dir

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20

_kept: list[DataFrame] = []
_stored: list[tuple[SparkSession, str]] = []


def keep(df: DataFrame) -> DataFrame:
    """Persist a derived table that a plan reads more than once."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    _kept.append(kept)
    return kept


def release() -> None:
    """Unpersist every table kept so far."""
    while _kept:
        _kept.pop().unpersist()


def stored(df: DataFrame) -> DataFrame:
    """Write a derived table of rows into the shared checkpoint folder and read it again.

    For what is read several times and is too large to be kept: compressed
    columns take a fraction of a checkpoint's or a cache's rows, and only the
    columns asked for are read. drop_stored() deletes the files.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_stored() -> None:
    """Delete every table that stored() has written; call it when results are stored."""
    while _stored:
        spark, path = _stored.pop()
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether the table is within both bounds; counts it, so it runs a job."""
    width = F.lit(0)
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0))
        else:
            width = width + F.lit(16)
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(width.cast("bigint")), F.lit(0))).first()
    return n <= rows and total <= size


def join_small(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a table of rows with a table that is expected to be small.

    The small side is counted first. Within the bounds it is broadcast, so the
    big side never moves and a hot key costs nothing. Beyond them it is an
    ordinary shuffle join, which AQE splits where a key is hot.
    """
    small = keep(small)
    if fits_broadcast(small):
        small = F.broadcast(small)
    return big.join(small, list(on), how)
