"""Mixing sources to target weights by pivotal dependent rounding.

A source whose target is r times its size wants r copies of each document:
floor(r) for sure, and a fraction to be rounded. Two documents with fractional
copies are paired, and words are moved from one to the other, in a random
direction that keeps both expectations, until one of them has a whole number.
The words a source takes stay the same in every such step. Each bucket of a
source ends with one fractional document; those meet in a reduction tree, and
only the last one of a source is rounded by itself, to the nearest number.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from hangarlog.llm.frames import free_name, row_key, stash

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a bucket, over all sources; a bucket's part of a source is rounded by one task.
BUCKET_ROWS = 2_000
FAN = 16

UNIT = T.StructType([
    T.StructField("node", T.LongType()), T.StructField("source", T.StringType()), T.StructField("size", T.LongType()),
    T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("doc_id", T.LongType()),
    T.StructField("copies", T.LongType()), T.StructField("frac", T.DoubleType())])


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def share_targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """total shared by weight; no share is above most times its size, the excess goes to the others by weight."""
    left, open_ = float(total), set(range(len(sizes)))
    targets = [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] >= most * sizes[i]}
        if not full:
            for i in open_:
                targets[i] = unit * weights[i]
            break
        for i in full:
            targets[i] = float(most * sizes[i])
            left -= targets[i]
        open_ -= full
        left = max(left, 0.0)
    return targets


def _pivot(seed: int):
    """Round the fractions of each (node, source) group; at most one row of a group keeps one."""
    schema = pa.schema([("node", pa.int64()), ("source", pa.string()), ("size", pa.int64()), ("k1", pa.int64()),
                        ("k2", pa.int64()), ("doc_id", pa.int64()), ("copies", pa.int64()), ("frac", pa.float64())])

    def rows_of(batches):
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, carry, draw, out = None, None, None, []

        def done(unit, up: int) -> None:
            out.append((*unit[:6], unit[6] + up, None))

        for row in rows_of(batches):
            if row[:2] != group:
                if carry:
                    out.append(carry)
                group, carry, draw = row[:2], None, random.Random(f"{seed}:{row[0]}:{row[1]}")
            size, x = row[2], row[7]
            if x is None or x <= 0.0 or x >= 1.0 or size <= 0:
                done(row, 1 if x is not None and x >= 1.0 else 0)
            elif carry is None:
                carry = row
            else:
                first, second, carry = carry, row, None
                a, b = first[7] * first[2], x * size  # words
                room_a, room_b = first[2] - a, size - b
                to_a, to_b = min(room_a, b), min(a, room_b)
                if draw.random() * (to_a + to_b) < to_b:  # to the first
                    full, gives, keeps, rest = room_a <= b, second, first, (b - room_a if room_a <= b else a + b)
                else:
                    full, gives, keeps, rest = room_b <= a, first, second, (a - room_b if room_b <= a else a + b)
                if full:
                    done(keeps, 1)
                    left = gives
                else:
                    done(gives, 0)
                    left = keeps
                if rest > 0.0:
                    carry = (*left[:7], rest / left[2])
                else:
                    done(left, 0)
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out.clear()
        if carry:
            out.append(carry)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    return run


def copy_counts(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, most: float = 3.0, seed: int = 7,
                text: str = "text", source: str = "source", id_col: str = "doc_id") -> DataFrame:
    """How often the mix takes each row of docs.

    Sources by code point, null last, have the weights in turn and share
    `share` of all words; a target stops at `most` times its source's words.
    Returns k1, k2 (the row's key), doc_id, source, size (words), source_size,
    target and copies. Rows without words take no part in the rounding. Per
    source, the words taken differ from the target by half a document at most.
    The result depends on the rows and the seed alone. Null sources form a
    source of their own; an empty table gives no rows.
    """
    k1, k2 = row_key(docs)
    units = stash(docs.select(F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"),
                              k1.alias("k1"), k2.alias("k2"), F.col(id_col).cast("long").alias("doc_id")))
    # One row for each source, never for each document.
    totals = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")).collect()
    totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["source_size"] for r in totals]
    targets = share_targets(sizes, [weights[i % len(weights)] for i in range(len(totals))], share * sum(sizes), most)
    rates = [min(t / s, most) if s else 0.0 for t, s in zip(targets, sizes)]
    plan = docs.sparkSession.createDataFrame(
        [(r["source"], r["source_size"], t, x) for r, t, x in zip(totals, targets, rates)],
        "plan_source string, source_size long, target double, rate double")
    buckets = max(1, sum(r["rows"] for r in totals) // BUCKET_ROWS)

    planned = units.join(plan, units["source"].eqNullSafe(plan["plan_source"]))
    fraction = F.col("rate") - F.floor("rate")
    start = planned.select(
        F.pmod("k1", F.lit(buckets)).cast("long").alias("node"), "source", "size", "k1", "k2", "doc_id",
        F.floor("rate").cast("long").alias("copies"),
        F.when((fraction > 0) & (F.col("size") > 0), fraction).alias("frac"))

    def paired(rows: DataFrame) -> DataFrame:
        # Large documents first: the one left over in the end is then a small one.
        spread = rows.repartition("node", "source")
        return stash(spread.sortWithinPartitions("node", "source", F.desc("size"), "k1", "k2").mapInArrow(_pivot(seed), UNIT))

    level = paired(start)
    settled = [level.filter(F.col("frac").isNull())]
    width = buckets
    while width > 1:
        width = -(-width // FAN)
        level = paired(level.filter(F.col("frac").isNotNull()).withColumn("node", F.floor(F.col("node") / FAN).cast("long")))
        settled.append(level.filter(F.col("frac").isNull()))
    nearest = (F.col("frac") >= 0.5).cast("long")
    settled.append(level.filter(F.col("frac").isNotNull()).withColumn("copies", F.col("copies") + nearest))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.join(plan, out["source"].eqNullSafe(plan["plan_source"])).select(
        "k1", "k2", "doc_id", "source", "size", "source_size", "target", "copies")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of docs as often as copy_counts() says, with its own columns."""
    names = [free_name(docs, n) for n in ("_mix_k1", "_mix_k2", "_mix_copies")]
    k1, k2 = row_key(docs)
    counts = stash(copy_counts(docs, **options)).groupBy(F.col("k1").alias(names[0]), F.col("k2").alias(names[1])).agg(
        F.sum("copies").alias(names[2]), F.count("*").alias("rows"))
    keyed = docs.withColumns({names[0]: k1, names[1]: k2})
    repeated = counts.filter("rows > 1").select(*names[:2])
    if not repeated.isEmpty():  # equal rows: one of them stands for all
        keyed = keyed.join(repeated, names[:2], "left_anti").unionByName(
            keyed.join(repeated, names[:2], "left_semi").dropDuplicates(names[:2]))
    taken = keyed.join(counts.filter(F.col(names[2]) > 0).drop("rows"), names[:2])
    each = free_name(docs, "_mix_each")
    return taken.withColumn(each, F.explode(F.sequence(F.lit(1), F.col(names[2])))).select(*docs.columns)
