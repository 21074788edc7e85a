"""Rare classes, splits, label ids, class weights and seeded samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from hangarlog.functions.text import subsystem_of, system_of
from hangarlog.operators.ranks import hash_order, keys_at_ranks, mark_first
from hangarlog.plans.sizing import join_small


def frequent_labels(df: DataFrame, label: str, n: int) -> DataFrame:
    return (
        df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= n).select(label)
    )


def rare_filter(df: DataFrame, label: str, n: int = 5) -> DataFrame:
    """Rows whose label has at least n rows."""
    return join_small(df, frequent_labels(df, label, n), [label], "left_semi")


def split(df: DataFrame, label: str, key: str, seed: int = 42, train: float = 0.8) -> DataFrame:
    """Add ``split``: train, val or test.

    Of each label the first ceil(train * n) rows in hash order train. The rest,
    not stratified because a label may have one row left, is halved in another
    hash order; an odd row goes to test. ``key`` is unique.
    """
    marked = mark_first(df, [label], key, seed, F.ceil(F.lit(train) * F.col("total")), "_train")
    rest = marked.where(~F.col("_train"))
    order = hash_order(key, seed + 1)
    items = rest.select(
        order.alias("key"), F.substring(order, 1, 4).alias("bucket"), F.lit(1).cast("bigint").alias("n")
    )
    half = {"last": F.floor(F.col("total") / 2) - 1}
    bound = keys_at_ranks(items, [], half, raw_rows=True).select("key").scalar()
    part = F.when(F.col("_train"), "train").when(order <= bound, "val").otherwise("test")
    return marked.withColumn("split", part).drop("_train")


def label_map(df: DataFrame, label: str) -> DataFrame:
    """Dense ids in label order, from labels outside the test split."""
    labels = df.where("split <> 'test'").select(label).where(F.col(label).isNotNull()).distinct()
    return dense_ids(labels, label)


def dense_ids(labels: DataFrame, label: str, name: str = "label_id") -> DataFrame:
    """0, 1, 2 … over distinct labels; one window over the label list only."""
    return labels.withColumn(name, F.row_number().over(Window.orderBy(label)) - 1)


def hierarchy_ids(df: DataFrame, label: str = "code") -> DataFrame:
    """Every label with its own id and those of its subsystem and system."""
    labels = df.select(label).where(F.col(label).isNotNull()).distinct()
    rank = lambda c: (F.dense_rank().over(Window.orderBy(c)) - 1)
    return (
        labels.withColumns({"system": system_of(label), "subsystem": subsystem_of(label)})
        .withColumns({"label_id": rank(label), "subsystem_id": rank("subsystem"), "system_id": rank("system")})
    )


def with_label_ids(df: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Rows with the id of their label; rows without one drop out."""
    return join_small(df, labels, [label])


def invert_label_map(labels: DataFrame, label: str) -> DataFrame:
    """Id to label."""
    return labels.select("label_id", label)


def class_weights(df: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """1 / max(count, 1) of every label, scaled to a mean of 1."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    raw = labels.join(counts, label, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    weight = F.lit(1.0) / F.greatest(F.col("n"), F.lit(1))
    return raw.withColumn("weight", weight / F.avg(weight).over(Window.partitionBy()))


def split_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows and distinct labels per split."""
    return (
        df.groupBy("split", label).agg(F.count(F.lit(1)).alias("n"))
        .groupBy("split").agg(F.sum("n").alias("rows"), F.count(label).alias("classes"))
    )


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """Exactly n rows (or all, if fewer), overall or per group, in hash order.

    The last digest inside the sample is looked for and every row compared
    with it, so no task gathers a large sample. ``key`` is unique.
    """
    quota = F.least(F.lit(n).cast("bigint"), F.col("total"))
    return mark_first(df, by, key, seed, quota, "_sampled").where("_sampled").drop("_sampled")


def exclude_seen(df: DataFrame, seen: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text is not among those seen.

    Texts are matched on 128 bits of digest, so that neither side ships whole
    texts of the seen records, and rows of one common text are spread by AQE.
    """
    digest = lambda c: [F.xxhash64(c).alias("_d1"), F.xxhash64(F.lit(29), c).alias("_d2")]
    known = seen.select(*digest(F.col(text))).distinct()
    keyed = df.select("*", *digest(F.col(text)))
    return keyed.join(known, ["_d1", "_d2"], "left_anti").drop("_d1", "_d2")
