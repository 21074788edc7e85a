"""Hard negatives by integer inner product, filtered by rotated one-bit codes.

Every vector is rotated into a space of more dimensions and kept as the signs
it has there. Beside the code stand the vector's alignment, its inner product
with the unit vector the code stands for, and the length of the residual. An
anchor's inner product with a code is estimated by popcounts over the bits of
its own rotated, quantised vector. By Cauchy-Schwarz the residual adds at most
the product of the two parts that are orthogonal to the code's vector, so each
pair has an interval that holds its true score. Pairs whose interval can't
reach a wanted place are dropped, the others are scored in integers; nothing
rests on a probability, so results are exact.

Anchors are a stated set that meets all rows in blocks: candidates lie in
blocks of bounded size, and each block is read once, followed by the anchors,
which stream. A task returns a few rows for each anchor and block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from hangarlog.llm.frames import record, stash
from hangarlog.llm.vectors import common_length, integers, listed, matrix, takes_part

BLOCK_ROWS = 8192
#: Bits of a code for each dimension, and bits that an anchor's rotated entries are kept in.
CODE_FACTOR, PLANES = 4, 6
#: Candidates with the best estimates that are scored first, to have a bound for the others.
SEEDS = 32
_ROWS = "key long, anchor_id long, rank_of int, vec_id long, score long"
_SCHEMA = pa.schema([("key", pa.int64()), ("anchor_id", pa.int64()), ("rank_of", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Rotation:
    """Orthonormal map of vectors into a space of `bits` dimensions, and the one-bit codes there."""

    def __init__(self, dim: int, factor: int = CODE_FACTOR, seed: int = 17):
        self.bits = -(-factor * dim // 64) * 64
        self.turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(self.bits, dim)))[0]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes as bytes, alignment and residual length of each vector, and the length of the code's vector."""
        signs = x @ self.turn.T >= 0
        decoded = np.where(signs, 1.0, -1.0) @ self.turn / np.sqrt(self.bits)
        length = np.sqrt((decoded ** 2).sum(axis=1))
        safe = np.maximum(length, 1e-9)
        unit = decoded / safe[:, None]
        alignment = (x * unit).sum(axis=1)
        residual = np.sqrt(((x - alignment[:, None] * unit) ** 2).sum(axis=1))
        return np.packbits(signs, axis=1), alignment, residual, safe


class Block:
    """Candidates of one block, as codes and as integers."""

    def __init__(self, rotation: Rotation, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x, self.rotation = ids, labels, x, rotation
        code, self.alignment, self.residual, self.length = rotation.encode(x.astype(np.float64))
        self.words = np.ascontiguousarray(code).view(np.uint64)
        self.slack = 1e-9 * (1.0 + np.abs(x).max(initial=0) * np.sqrt(x.shape[1]))
        self.exact = x.astype(np.float64) if x.shape[1] * float(np.abs(x).max(initial=0)) ** 2 < 2 ** 52 else None

    def intervals(self, q: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated scores of the candidates `at`, and how far the true ones can be from them."""
        turned = self.rotation.turn @ q
        low, bits = turned.min(), len(turned)
        step = max((turned.max() - low) / ((1 << PLANES) - 1), 1e-300)
        level = np.rint((turned - low) / step).astype(np.int64)
        lost = np.sqrt(((turned - low - step * level) ** 2).sum())
        words = self.words[at]
        weighted = np.zeros(len(at), dtype=np.int64)
        for plane in range(PLANES):
            mask = np.packbits((level >> plane) & 1 == 1).view(np.uint64)
            weighted += np.bitwise_count(words & mask).sum(axis=1, dtype=np.int64) << plane
        ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        along = (low * (2 * ones - bits) + step * (2 * weighted - level.sum())) / np.sqrt(bits) / self.length[at]
        miss = lost / self.length[at]
        across = np.sqrt(np.maximum((q ** 2).sum() - np.maximum(np.abs(along) - miss, 0.0) ** 2, 0.0))
        return self.alignment[at] * along, np.abs(self.alignment[at]) * miss + self.residual[at] * across + self.slack * (1.0 + np.sqrt((q ** 2).sum()))

    def scores(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Integer inner products."""
        if self.exact is not None and self.x.shape[1] * float(np.abs(q).max(initial=0)) ** 2 < 2 ** 52:
            return np.rint(self.exact[at] @ q.astype(np.float64)).astype(np.int64)
        return self.x[at] @ q

    def best(self, q: np.ndarray, at: np.ndarray, most: int, low: float = -np.inf, high: float = np.inf,
             bounds: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The `most` first of candidates `at` whose score lies in [low, high], by falling score and rising identifier."""
        if not len(at):
            return at, np.zeros(0, dtype=np.int64)
        estimate, reach = self.intervals(q.astype(np.float64), at) if bounds is None else bounds
        open_ = np.flatnonzero((estimate + reach >= low) & (estimate - reach <= high))
        if len(open_) > SEEDS + most:
            # The true scores of a few likely ones say how high the others have to reach.
            likely = -estimate[open_] if high == np.inf else np.abs(estimate[open_] - high)
            seeds = open_[np.argpartition(likely, SEEDS)[:SEEDS]]
            seen = self.scores(q, at[seeds])
            seen = np.sort(seen[(seen >= low) & (seen <= high)])[::-1]
            if len(seen) >= most:
                open_ = open_[estimate[open_] + reach[open_] >= seen[most - 1]]
        rows = at[open_]
        score = self.scores(q, rows)
        fits = (score >= low) & (score <= high)
        rows, score = rows[fits], score[fits]
        order = np.lexsort((self.ids[rows], -score))[:most]
        return rows[order], score[order]


def _searched(rows: DataFrame, anchors: DataFrame, blocks: int, rotation: Rotation, find: Callable) -> DataFrame:
    """find(block, anchor's label, id, vector, windows) for each anchor and each block of candidates."""
    stored = rows.select(F.pmod(F.xxhash64("vec_id", "label"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"),
                         F.lit(0).cast("long").alias("key"), "vec_id", "label", "x", F.lit(None).cast("array<long>").alias("windows"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "key", "vec_id", "label", "x", "windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, held = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("block", "kind")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            out = []
            for low, high in zip([0, *cuts], [*cuts, len(keys)]):
                if low == high:
                    continue
                part = batch.slice(low, high - low)
                block, kind = keys[low]
                if block != current:
                    current, parts, held = block, [], None
                ids, labels, x = part.column("vec_id").to_numpy(), part.column("label").to_numpy(), matrix(part.column("x"), np.int64)
                if kind == 0:
                    parts.append((ids, labels, x))
                    continue
                if held is None and parts:
                    held, parts = Block(rotation, *[np.concatenate(c) for c in zip(*parts)]), []
                if held is None:
                    continue
                for i, (key, windows) in enumerate(zip(part.column("key").to_pylist(), part.column("windows").to_pylist())):
                    for rank_of, found, score in find(held, labels[i], ids[i], x[i], windows):
                        out.append((np.full(len(found), key), np.full(len(found), ids[i]), np.full(len(found), rank_of), held.ids[found], score))
            if out:
                yield record(_SCHEMA, [np.concatenate(c) for c in zip(*out)])

    return stored.unionByName(asked).repartition(2 * blocks, "block").sortWithinPartitions("block", "kind").mapInArrow(run, _ROWS)


def _positives(most: int) -> Callable:
    def find(block, label, own, q, windows):
        rows, score = block.best(q, np.flatnonzero((block.labels == label) & (block.ids != own)), most)
        yield 0, rows, score
    return find


def _negatives(most: int) -> Callable:
    def find(block, label, own, q, windows):
        at = np.flatnonzero((block.labels != label) & (block.ids != own))
        bounds = block.intervals(q.astype(np.float64), at) if len(at) else None
        for place in range(len(windows) // 2):
            low, high = windows[2 * place:2 * place + 2]
            if low <= high:
                yield place + 1, *block.best(q, at, most, low, high, bounds)
    return find


def mine_negatives(vectors: DataFrame, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (50, 100),
                   high: tuple[int, int] = (95, 100), vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the inner product of floor(256 * entry) vectors. An anchor's
    positives are the rows of its label with the highest scores. For each of
    them the first `negatives` rows of other labels are returned whose score
    is at least low and at most high, as shares (of 100, say) of the positive's.
    Higher scores come first, ties go to the smaller identifier.

    Rows with a null identifier, label or vector, with a null or non-finite
    entry, of another length than most, or with entries so large that a score
    is no long, take no part. Rows that repeat in identifier, label and vector
    count once; a row is never its own positive, nor is another row of its
    identifier. Rows of one identifier but other vectors are rows of their
    own. Where label or is_anchor is null for a row, it has none, or is none.
    Anchors without positives or without a fitting negative give no rows, nor
    does an empty table. Other columns are not looked at.
    """
    dim = common_length(vectors, vector)
    limit = float(int(np.sqrt(2.0 ** 62 / max(dim, 1))))
    rows = stash(vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks"),
                                F.col(vector).alias("v")).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & takes_part(F.col("v"), dim, limit))
                 .select("vec_id", "label", "asks", integers(F.col("v")).alias("x")).dropDuplicates())
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    rotation = Rotation(max(dim, 1))
    asking = rows.filter("asks").select(F.xxhash64("vec_id", "label", "x").alias("key"), "vec_id", "label", "x")
    of_anchor = Window.partitionBy("anchor_id", "key")

    found = _searched(rows, asking.withColumn("windows", F.lit(None).cast("array<long>")), blocks, rotation, _positives(positives))
    place = F.row_number().over(of_anchor.orderBy(F.desc("score"), "vec_id"))
    nearest = stash(found.withColumn("place", place).filter(F.col("place") <= positives).select(
        "anchor_id", "key", F.col("place").alias("rank_of"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    # ceil(p * low) and floor(p * high) in integers; where p is not positive this window is empty or holds 0 alone.
    p = F.col("e.positive_score").cast("decimal(38,0)")
    least = F.ceil(p * F.lit(low[0]) / F.lit(low[1])).cast("long")
    greatest = F.floor(p * F.lit(high[0]) / F.lit(high[1])).cast("long")
    bounds = nearest.groupBy("anchor_id", "key").agg(F.sort_array(F.collect_list(F.struct("rank_of", "positive_score"))).alias("list")).select(
        F.col("anchor_id").alias("vec_id"), "key", "list")  # as many entries as positives are asked for
    windows = bounds.select("vec_id", "key", F.posexplode("list").alias("i", "e")).groupBy("vec_id", "key").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("i", least.alias("a"), greatest.alias("b")))), lambda w: F.array(w["a"], w["b"]))).alias("windows"))
    again = _searched(rows, asking.join(windows, ["vec_id", "key"]), blocks, rotation, _negatives(negatives))
    turn = F.row_number().over(Window.partitionBy("anchor_id", "key", "rank_of").orderBy(F.desc("score"), "vec_id"))
    return again.withColumn("rank", turn).filter(F.col("rank") <= negatives).join(nearest, ["anchor_id", "key", "rank_of"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
