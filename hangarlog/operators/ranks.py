"""Exact order statistics per group without gathering a group in one task.

A group may hold a third of all rows, so it is never sorted whole. Its items
fall into ordered buckets; bucket totals, which are few, tell in which bucket
a rank lies, and only the items of that bucket are ordered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from hangarlog.plans.sizing import join_small, stored


CELLS, STEPS, DOUBLINGS = 1024, 16, 20


def value_bucket(value: Column, low: Column, high: Column) -> Column:
    """A coarse number that never falls as the value rises, from the column's own range.

    The range is cut into equal cells, and each cell again at distances from
    its lower edge that grow by a constant factor. So values spread over many
    buckets whether they lie evenly, close together far from zero, or crowded
    near the low end. Infinite values lie outside all cells.
    """
    place = F.when(high > low, (value - low) / (high - low) * CELLS).otherwise(F.lit(0.0))
    cell = F.least(F.floor(place), F.lit(CELLS - 1))
    step = F.floor(F.log2(1.0 + F.greatest(place - cell, F.lit(0.0)) * float(1 << DOUBLINGS)) * STEPS)
    inside = cell * ((DOUBLINGS + 1) * STEPS) + step
    infinite = F.lit(float("inf"))
    return F.when(value == infinite, F.lit(1 << 40)).when(value == -infinite, F.lit(-1)).otherwise(inside).cast("bigint")


def keys_at_ranks(items: DataFrame, by: Sequence[str], ranks: Mapping[str, Column],
                  raw_rows: bool = False) -> DataFrame:
    """The key at each rank of each group.

    ``items`` has the group columns, ``bucket``, ``key`` (rising with bucket)
    and a weight ``n``. ``ranks`` gives, by name, a rank counted from 0 in
    terms of the column ``total``. Result: group columns, total, name, key;
    a rank outside the group gives no row. ``raw_rows`` says that the items
    are table rows rather than counts, from a stored table: they are read for
    the bucket totals and again for the ranks, stay where they are, and the few
    buckets to look into are sent to them.
    """
    keys = list(by)
    totals = items.groupBy(*keys, "bucket").agg(F.sum("n").alias("held"))
    group = Window.partitionBy(*keys)
    running = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank")) for name, rank in ranks.items()
    ])
    picks = (
        totals.withColumns({"total": F.sum("held").over(group), "upto": F.sum("held").over(running)})
        .withColumn("pick", F.explode(wanted))
        .where("pick.rank >= upto - held AND pick.rank < upto")
        .select(*keys, "bucket", "total", "pick.name", (F.col("pick.rank") - (F.col("upto") - F.col("held"))).alias("nth"))
    )
    inside = Window.partitionBy(*keys, "bucket", "name").orderBy("key")
    seen = F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    looked_into = join_small(items, picks, [*keys, "bucket"]) if raw_rows else items.join(picks, [*keys, "bucket"])
    return (
        looked_into.withColumn("seen", seen)
        .where("nth >= seen - n AND nth < seen")
        .select(*keys, "total", "name", "key")
    )


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles q0, q1, … per group, nulls and NaN left out.

    Equal values are counted before anything is ordered, so a group costs its
    distinct values, and those only in the buckets where a quantile lies.
    """
    keys = list(by)
    v = F.col(value).cast("double")
    values = df.select(*keys, v.alias("key")).where("key IS NOT NULL AND NOT isnan(key)")
    finite = values.where(F.abs("key") != float("inf"))
    bound = lambda f: finite.agg(f("key")).scalar()
    items = (
        values.groupBy(*keys, "key").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bucket", value_bucket(F.col("key"), bound(F.min), bound(F.max)))
    )
    position = [F.lit(float(p)) * (F.col("total") - 1) for p in probs]
    ranks = {}
    for i, pos in enumerate(position):
        ranks[f"lo{i}"], ranks[f"hi{i}"] = F.floor(pos), F.ceil(pos)
    found = keys_at_ranks(items, keys, ranks)
    at = lambda name: F.max(F.when(F.col("name") == name, F.col("key")))
    wide = found.groupBy(*keys).agg(
        F.max("total").alias("total"), *[at(name).alias(name) for name in ranks]
    )
    between = [
        F.when(F.col(f"lo{i}") == F.col(f"hi{i}"), F.col(f"lo{i}"))  # also where both are infinite
        .otherwise(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (pos - F.floor(pos))).alias(f"q{i}")
        for i, pos in enumerate(position)
    ]
    return wide.select(*keys, *between)


def hash_order(key: str, seed: int) -> Column:
    """A repeatable shuffle of rows: the digest of seed and key, as text."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(key).cast("string")))


def mark_first(df: DataFrame, by: Sequence[str], key: str, seed: int, quota: Column, flag: str) -> DataFrame:
    """Flag the first ``quota`` rows of each group in hash order.

    ``key`` is unique and ``quota`` is in terms of ``total``, the group size.
    Only the digest of the last row inside the quota is looked for; then every
    row is compared with the one of its group, so the rows are never shuffled.
    The rows are stored first: what is behind them is worked out once, however
    often the marked rows are read.
    """
    keys, df = list(by), stored(df)
    digest = hash_order(key, seed)
    items = df.select(*keys, digest.alias("key"), F.lit(1).cast("bigint").alias("n")).withColumn(
        "bucket", F.substring("key", 1, 4)
    )
    last = keys_at_ranks(items, keys, {"last": quota - 1}, raw_rows=True).select(*keys, F.col("key").alias("_last"))
    if not keys:
        bound = last.select("_last").scalar()
        return df.withColumn(flag, F.coalesce(digest <= bound, F.lit(False)))
    marked = join_small(df, last, keys, "left")
    return marked.withColumn(flag, F.coalesce(digest <= F.col("_last"), F.lit(False))).drop("_last")
