"""What the operators share around DataFrames: kept tables, row keys, sorted groups."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from hangarlog.session import ensure_checkpoint_dir

_stashed: list[tuple[SparkSession, str]] = []


def stash(df: DataFrame) -> DataFrame:
    """Write a derived table into the shared checkpoint folder and read it again.

    It cuts the lineage: a lost executor costs the tasks that ran on it, not
    the stages before. drop_stashes() deletes the files.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stashed.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_stashes() -> None:
    """Delete every table that stash() has written; call it when results are stored."""
    while _stashed:
        spark, path = _stashed.pop()
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def row_key(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes over all columns: rows with equal keys are repeated rows."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        plain = isinstance(field.dataType, T.AtomicType) and not isinstance(field.dataType, T.VariantType)
        columns.append(F.struct(column.isNull(), column if plain else F.to_json(F.struct(column))))
    return [F.xxhash64(*columns), F.xxhash64(F.lit(20261), *columns)]


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, share: float = 1 / 1000) -> DataFrame:
    """Inner join of rows with one row for each group, where `size` says how many rows a group has.

    Groups of more than `share` of all rows are fewer than 1 / share; they are
    broadcast, so their rows stay where they are. The others are shuffled.
    """
    hot = F.col(size) > F.lit(total * share)
    few = groups.filter(hot)
    cold = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(few), keys).unionByName(cold.join(groups.filter(~hot), keys))


def free_name(df: DataFrame, wanted: str) -> str:
    """The wanted column name, with underscores until no column has it."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that agree in their first columns, from batches sorted by these; a group may span batches."""
    current, rows = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            key = row[:keys]
            if key != current:
                if rows:
                    yield current, rows
                current, rows = key, []
            rows.append(row[keys:])
    if rows:
        yield current, rows


def record(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    made = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(made, schema=schema)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
