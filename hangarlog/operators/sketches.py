"""Distinct counts and quantiles in mergeable form.

A table of cells, say one a code and month, keeps a sketch of each measure.
Cells of any group, or of several batches, are merged without the records.
The exact operators stay as they are; these are for questions asked again and
again, whose cost then grows with the cells.

Distinct counts are HyperLogLog sketches of 2^14 registers: a standard error
of 0.8 %. Quantiles are KLL sketches: with k = 800, an answer's rank is off by
at most 0.6 % of the rows with 99 % confidence; up to k values are exact.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LG_REGISTERS, K = 14, 800
#: Three standard errors of a distinct count, and the rank error of a quantile.
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / (1 << (LG_REGISTERS // 2)), 0.006


def sketch_cells(df: DataFrame, by: Mapping[str, Column], distinct: Mapping[str, Column], measures: Mapping[str, Column]) -> DataFrame:
    """The keys of `by`, rows, distinct_<name> and quantiles_<name> (binary): one row a cell.

    Nulls are in no sketch, NaN in no quantile sketch; a null key is a cell of
    its own. A cell without any value has an empty sketch.
    """
    named = [c for c in (*[f"distinct_{n}" for n in distinct], *[f"quantiles_{n}" for n in measures], "rows") if c in by]
    if named:
        raise ValueError(f"keys clash with results: {named}")
    counted = [F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c)), LG_REGISTERS).alias(f"distinct_{n}") for n, c in distinct.items()]
    ranked = [F.kll_sketch_agg_double(F.nanvl(c.cast("double"), F.lit(None).cast("double")), K).alias(f"quantiles_{n}") for n, c in measures.items()]
    return df.groupBy(*[c.alias(n) for n, c in by.items()]).agg(F.count(F.lit(1)).alias("rows"), *counted, *ranked)


def merge_cells(cells: DataFrame, by: Sequence[str] | Mapping[str, Column] = ()) -> DataFrame:
    """Cells of coarser groups; with no keys, one row for all (none for no cells)."""
    keys = [c.alias(n) for n, c in by.items()] if isinstance(by, Mapping) else [F.col(c) for c in by]
    merged = [F.hll_union_agg(c).alias(c) if c.startswith("distinct_") else F.kll_merge_agg_double(c, K).alias(c)
              for c in cells.columns if c.startswith(("distinct_", "quantiles_"))]
    return cells.groupBy(*keys).agg(F.sum("rows").alias("rows"), *merged).where(F.col("rows").isNotNull())


def read_off(cells: DataFrame, shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Numbers for sketches: <name>_distinct, <name>_n and <name>_q (an array, one entry a share; null without values)."""
    out = []
    for c in cells.columns:
        if c.startswith("distinct_"):
            out.append(F.hll_sketch_estimate(c).alias(f"{c.removeprefix('distinct_')}_distinct"))
        elif c.startswith("quantiles_"):
            name, n = c.removeprefix("quantiles_"), F.coalesce(F.kll_sketch_get_n_double(c), F.lit(0).cast("bigint"))
            asked = F.kll_sketch_get_quantile_double(c, F.array(*[F.lit(float(s)) for s in shares]))
            out += [n.alias(f"{name}_n"), F.when(n > 0, asked).alias(f"{name}_q")]
        else:
            out.append(F.col(c))
    return cells.select(*out)


def store_cells(cells: DataFrame, path: str, batch: str) -> None:
    """Write a batch's cells; a batch of the same name is replaced, so a repeated job counts once."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]*", batch):
        raise ValueError(f"a batch is named by letters, digits, _ and -, not {batch!r}")
    cells.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def load_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of all batches."""
    return spark.read.parquet(path).drop("batch")


def rank_errors(df: DataFrame, value: Column, edges: DataFrame, by: Sequence[str], shares: Sequence[float], column: str) -> DataFrame:
    """For each group how far the ranks of its edges are from the shares, as a share of its rows: by and rank_error.

    An edge stands for all ranks from the rows below it to the rows up to it.
    Groups are few, so their edges are joined to the rows.
    """
    rows = df.select(*by, value.cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")).join(edges.select(*by, column), list(by))
    n = F.count(F.lit(1))
    off = [F.greatest(F.count_if(F.col("_v") < F.col(column)[i]) / n - s, s - F.count_if(F.col("_v") <= F.col(column)[i]) / n, F.lit(0.0)) for i, s in enumerate(shares)]
    return rows.groupBy(*by).agg(F.greatest(*off, F.lit(0.0)).alias("rank_error"))
