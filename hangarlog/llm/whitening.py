"""Whitening of embeddings with weighted multiplicity covariance.

Rows with equal integer vectors are grouped, so each distinct vector is
multiplied once, with its weight (its number of copies, or one). Sums are
exact, vectors are centred before they are multiplied, each task multiplies
whole batches and only sums leave it. Each distinct vector is whitened once
and joined back to its rows; a vector that very many rows share is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hangarlog.llm.frames import join_groups, record, stash
from hangarlog.llm.vectors import common_length, integers, listed, matrix, takes_part

#: Entries are below this in magnitude, so that a batch's sums are exact longs.
LIMIT = float(1 << 40)
#: Components whose share of the variance is below this have none but for rounding.
FLAT = 1e-12
LONGEST = (1 << 63) - 1


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Sum of the weights, and weighted sums for each dimension, of rows (x, weight)."""
    schema = pa.schema([("at", pa.int32()), ("total", pa.decimal128(38))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            x, w = matrix(batch.column("x"), np.int64), batch.column("weight").to_numpy()
            if len(w):
                wide = np.concatenate([np.ones((len(w), 1), dtype=np.int64), x], axis=1)
                own = (wide * w[:, None]).sum(axis=0) if w.max() == 1 else (wide.astype(object) * w.astype(object)[:, None]).sum(axis=0)
                sums = own.astype(object) if sums is None else sums + own
        if sums is not None:
            yield record(schema, [np.arange(len(sums)), [Decimal(int(s)) for s in sums]])

    found = fit.mapInArrow(run, "at int, total decimal(38,0)").groupBy("at").agg(F.sum("total").alias("total")).orderBy("at").collect()  # one row a dimension
    totals = [int(r["total"]) for r in found]
    return (totals[0], totals[1:]) if totals else (0, [])


def covariance(fit: DataFrame, column: str, total: int, mean: np.ndarray) -> np.ndarray:
    """Weighted covariance of a vector column, centred before multiplying; one matrix a task is added up, row by row."""
    schema = pa.schema([("at", pa.int32()), ("row", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(column)) - mean
                own = x.T @ (x * batch.column("weight").to_numpy()[:, None])
                out = own if out is None else out + own
        if out is not None:
            yield record(schema, [np.arange(len(out)), listed(out, pa.float64())])

    parts = fit.select(column, "weight").mapInArrow(run, "at int, row array<double>")
    cells = parts.select("at", F.posexplode("row").alias("to", "value")).groupBy("at", "to").agg(F.sum("value").alias("value"))
    out = np.zeros((len(mean), len(mean)))
    for r in cells.collect():  # dimension x dimension values
        out[r["at"], r["to"]] = r["value"]
    return (out + out.T) / (2 * total)


def exact_deviation(x: np.ndarray, total: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (total * x - sums)^2 of each row, null where it is no long."""
    if not len(x):
        return []
    reach = max(abs(total * int(e) - s) for e, s in zip([*x.min(axis=0), *x.max(axis=0)], [*sums, *sums]))
    if len(sums) * reach ** 2 <= LONGEST and total * int(np.abs(x).max()) <= LONGEST:
        return ((x * total - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    wide = ((x.astype(object) * total - np.array(sums, dtype=object)) ** 2).sum(axis=1)
    return [int(v) if v <= LONGEST else None for v in wide]


def whiten(vectors: DataFrame, components: int = 4, weight: str = "one", vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """One row for each row that takes part: vec_id, n, deviation, whitened, explained, identity_error.

    whitened and explained are arrays over the components, by falling
    eigenvalue; identity_error is the largest entry by which the covariance of
    the whitened vectors misses the identity. weight is "one" (each distinct
    integer vector counts once) or "count" (as often as it occurs).

    Vectors that are null, hold null or non-finite entries, or entries of 2^32
    and more in magnitude, or are of another length than most, take no part.
    Repeated rows and null identifiers stay, each as a row of its own. A
    component without variance (equal vectors, fewer distinct vectors than
    dimensions) is left out, so arrays may be shorter, or empty. An empty table
    gives no rows. Other columns are not looked at. A deviation beyond a long
    is null. The driver holds one matrix of dimension x dimension.
    """
    if weight not in ("one", "count"):
        raise ValueError(f"weight is one or count, not {weight}")
    spark, dim = vectors.sparkSession, common_length(vectors, vector)
    rows = stash(vectors.filter(takes_part(F.col(vector), dim, LIMIT)).select(F.col(id_col).alias("vec_id"), integers(F.col(vector)).alias("x")))
    distinct = stash(rows.groupBy("x").agg(F.count("*").alias("copies")))
    fit = distinct.withColumn("weight", F.col("copies") if weight == "count" else F.lit(1).cast("long"))
    total, sums = exact_sums(fit.select("x", "weight"))
    kind = dict(vectors.dtypes)[id_col]
    if not total:
        return spark.createDataFrame([], f"vec_id {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    mean = np.array([s / total for s in sums])
    values, basis = np.linalg.eigh(covariance(fit, "x", total, mean))
    values, basis, trace = values[::-1], basis[:, ::-1], max(float(values.sum()), 0.0)
    used = int((values[:components] > FLAT * trace).sum()) if trace else 0
    turn, explained = basis[:, :used] / np.sqrt(values[:used]), [float(v / trace) for v in values[:used]]
    schema = pa.schema([("x", pa.list_(pa.int64())), ("copies", pa.int64()), ("weight", pa.int64()), ("deviation", pa.int64()),
                        ("whitened", pa.list_(pa.float64()))])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), np.int64)
            made = listed((x - mean) @ turn, pa.float64()) if used and len(x) else pa.array([[]] * len(x), type=pa.list_(pa.float64()))
            yield record(schema, [batch.column("x"), batch.column("copies"), batch.column("weight"), exact_deviation(x, total, sums), made])

    done = stash(fit.select("x", "copies", "weight").mapInArrow(
        project, "x array<long>, copies long, weight long, deviation long, whitened array<double>"))
    error = None
    if used:
        centre = done.agg(*[(F.sum(F.col("whitened")[k] * F.col("weight")) / total).alias(f"m{k}") for k in range(used)]).first()
        error = float(np.abs(covariance(done, "whitened", total, np.array(centre)) - np.eye(used)).max())
    joined = join_groups(rows, done.drop("weight"), ["x"], "copies", rows.count())
    return joined.select("vec_id", F.lit(total).cast("long").alias("n"), "deviation", "whitened",
                         F.array(*[F.lit(e) for e in explained]).cast("array<double>").alias("explained"), F.lit(error).cast("double").alias("identity_error"))
