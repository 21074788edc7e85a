"""Exact duplicates by a tree-merge of sorted digest runs.

Every partition holds a sorted run of digests, each with the identifier that
would stay and a count. In round r the nodes whose numbers differ only in
digit r exchange parts of their runs: a row goes to the partner whose digit
equals digit r of its digest, so a node gets up to FAN runs, merges them, and
keeps one row of each text. After the last round a node's number is the tail
of its digests, and all copies of a text have met. A text that fills a third
of the table is one row a partition after the first merge.

Digests order the runs; rows count as equal only where the SHA-256 and the
length agree too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from hangarlog.llm.frames import free_name, join_groups, stash

#: Runs merged by a node in one round; a power of two.
FAN_BITS = 4

RUN = T.StructType([
    T.StructField("node", T.LongType()), T.StructField("digest", T.LongType()), T.StructField("sha", T.BinaryType()),
    T.StructField("bytes", T.LongType()), T.StructField("id", T.LongType()), T.StructField("n", T.LongType())])
KEY = ["digest", "sha", "bytes"]


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each identifier and text with the number of rows that repeat it."""
    value = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(value).alias("digest"),
        F.unhex(F.sha2(value, 256)).alias("sha"), F.octet_length(value).cast("long").alias("bytes"),
    ).groupBy("id", *KEY).agg(F.count("*").alias("n"))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the first of neighbours with one key, and add up their counts."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if held is None else [held, batch.cast(held.schema)]).combine_chunks()
        n = rows.num_rows
        new = np.ones(n, dtype=bool)
        new[1:] = False
        for name in ("node", "digest", "bytes"):
            values = rows.column(name).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        sha = np.array(rows.column("sha").to_pylist(), dtype="S32")
        new[1:] |= sha[1:] != sha[:-1]
        at = np.flatnonzero(new)
        kept = rows.take(pa.array(at)).set_column(
            rows.schema.get_field_index("n"), "n", pa.array(np.add.reduceat(rows.column("n").to_numpy(), at), pa.int64()))
        kept = kept.combine_chunks().to_batches()[0]
        held = kept.slice(len(at) - 1)
        if len(at) > 1:
            yield kept.slice(0, len(at) - 1)
    if held is not None:
        yield held


def tree_merge(runs: DataFrame, nodes: int) -> DataFrame:
    """One row for each text: its largest identifier and its number of rows."""
    rounds = 1
    while 1 << (FAN_BITS * rounds) < nodes:
        rounds += 1
    size = 1 << (FAN_BITS * rounds)
    runs = runs.withColumn("node", F.pmod(F.spark_partition_id(), F.lit(size)).cast("long")).select(*RUN.names)
    order = ["node", *KEY]
    runs = runs.sortWithinPartitions(*order, F.desc_nulls_last("id")).mapInArrow(_merged, RUN)
    for r in range(rounds):
        shift = FAN_BITS * r
        digit = F.shiftrightunsigned("digest", shift).bitwiseAND(F.lit((1 << FAN_BITS) - 1))
        rest = F.col("node").bitwiseAND(F.lit(~(((1 << FAN_BITS) - 1) << shift)))
        runs = runs.withColumn("node", rest.bitwiseOR(F.shiftleft(digit, shift)))
        runs = runs.repartition(size, "node").sortWithinPartitions(*order, F.desc_nulls_last("id"))
        runs = runs.mapInArrow(_merged, RUN)
    return runs.select(*KEY, F.col("id").alias("keep_id"), F.col("n").alias("group_size"))


def find_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id", nodes: int | None = None) -> DataFrame:
    """One row for each row of docs, with the group of equal texts it is in.

    Columns: id, digest, sha, bytes, keep_id (largest identifier of the group;
    null identifiers count as smallest), group_size, copy (from 1 over repeated
    rows of one identifier and text) and kept, true for one row of each group.
    Null and empty texts are equal. An empty table gives no rows.
    """
    nodes = nodes or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prints = stash(fingerprints(docs, text, id_col))
    groups = stash(tree_merge(prints, nodes))
    rows = prints.agg(F.sum("n")).first()[0] or 0
    joined = join_groups(prints, groups, KEY, "group_size", rows)
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).select(
        "id", *KEY, "keep_id", "group_size", F.col("copy").cast("long").alias("copy"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"))


def drop_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id", nodes: int | None = None) -> DataFrame:
    """The rows of docs that stay: of equal texts, one row with the largest identifier."""
    names = [free_name(docs, n) for n in ("_copy_id", "_copy_digest", "_copy_sha")]
    found = stash(find_copies(docs, text, id_col, nodes))
    keys = [F.col(c).alias(n) for c, n in zip(("id", "digest", "sha"), names)]
    value = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.withColumns(dict(zip(names[1:], (F.xxhash64(value), F.unhex(F.sha2(value, 256))))))

    def joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        same = left[id_col].cast("long").eqNullSafe(right[names[0]])
        return left.join(right, same & (left[names[1]] == right[names[1]]) & (left[names[2]] == right[names[2]]), how)

    gone = found.filter(~F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).select(*keys)
    stays = joined(keyed, gone, "left_anti")
    repeated = found.filter(F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 2)).select(*keys)
    if not repeated.isEmpty():  # the same identifier and text in several rows
        single = joined(stays, repeated, "left_semi").dropDuplicates([id_col, *names[1:]])
        stays = joined(stays, repeated, "left_anti").unionByName(single)
    return stays.drop(*names[1:])
