"""Contiguous shards of nearly equal byte size.

Documents are ordered by identifier in range partitions. Each partition adds
up its own sizes; the totals of the partitions, one row each, give every
partition its place in the whole, and so every document its global byte
offset. The shards are cut at equal targets of that offset. No task ever sees
more than its own partition, and a partition is read as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from hangarlog.llm.frames import free_name, stash

#: Bytes a document counts for besides its text.
OVERHEAD = 16


def text_size(text) -> F.Column:
    """UTF-8 bytes of a text (none if null) plus the overhead of a document."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(OVERHEAD)


def _running(size: str):
    """Per partition: bytes and rows before each row, as a stream."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = 0, 0
        for batch in batches:
            sizes = batch.column(size).to_numpy()
            ends = total + np.cumsum(sizes)
            index = rows + np.arange(len(sizes))
            if len(sizes):
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(ends - sizes, pa.int64()), pa.array(index, pa.int64())],
                    names=[*batch.schema.names, "_start", "_index"])
                total, rows = int(ends[-1]), rows + len(sizes)
    return run


def shard_documents(docs: DataFrame, shards: int, order: Sequence[str] = ("doc_id",), text: str = "text",
                    carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Give every row a shard from 0 to shards - 1 and a gapless slot in it.

    Returns the carried columns with size, text_crc32, shard and slot. Rows
    are ordered by `order` (nulls first), then by text checksum and size; rows
    that agree in all of these are interchangeable. A shard's size is within
    the largest document of total / shards. A null text counts as an empty
    one; an empty table gives no rows; a table smaller than the shards leaves
    some of them empty. Carried columns named like the results are refused.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    made = {"size", "text_crc32", "shard", "slot", "_start", "_index", "_part", "_first"}
    if clash := made & {c.lower() for c in carry}:
        raise ValueError(f"carried columns clash with results: {sorted(clash)}")
    keys = {c: free_name(docs, f"_key{i}") for i, c in enumerate(order)}
    sized = docs.select(*carry, *(F.col(c).alias(k) for c, k in keys.items()), text_size(F.col(text)).alias("size"),
                        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"))
    by = [*(F.asc_nulls_first(k) for k in keys.values()), F.col("text_crc32"), F.col("size")]
    ordered = sized.repartitionByRange(*by).sortWithinPartitions(*by).drop(*keys.values())
    ordered = ordered.withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*ordered.schema.fields, T.StructField("_start", T.LongType()), T.StructField("_index", T.LongType())])
    local = stash(ordered.mapInArrow(_running("size"), schema))

    # One row for each partition: its place in the whole.
    totals = local.groupBy("_part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    places = totals.select(
        "_part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("_total"))
    middle = F.lit(2) * (F.col("_start") + F.col("_bytes_before")) + F.col("size")
    cut = F.floor(middle.cast("double") * F.lit(float(shards)) / (F.lit(2.0) * F.col("_total")))
    placed = local.join(F.broadcast(places), "_part").select(
        *carry, "size", "text_crc32", F.least(cut, F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("_index") + F.col("_rows_before")).alias("_index"))
    firsts = placed.groupBy("shard").agg(F.min("_index").alias("_first"))
    if shards <= 100_000:
        firsts = F.broadcast(firsts)  # one row a shard
    return placed.join(firsts, "shard").select(
        *carry, "size", "text_crc32", "shard", (F.col("_index") - F.col("_first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int, order: Sequence[str] = ("doc_id",), text: str = "text") -> None:
    """Write whole documents as one folder for each shard, in slot order within a file."""
    placed = shard_documents(docs, shards, order, text, carry=docs.columns)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
