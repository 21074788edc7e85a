"""Approximate nearest neighbours by inner product over a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector is then put into a leaf.
A query walks the tree best bin first: a priority queue holds nodes by the
inner product their vectors can be expected to reach, and leaves are visited
as they come up. How many is calibrated: a bounded set of queries is answered
by brute force over all rows, and visits are widened until the wanted share of
those answers lies in visited leaves. A walk goes on beyond that until its
leaves hold enough vectors for a full answer.

Copies of one vector are ranked by identifier, so only the first k + 1 of them
can be among anyone's k nearest; the others are answered as queries but need
not be compared. Leaves are searched in blocks of bounded size.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from hangarlog.llm.frames import record, stash

SAMPLE_VECTORS, SAMPLE_BYTES = 20_000, 64 << 20
BRANCHES, LEAF_SAMPLE = 8, 64
CALIBRATION_QUERIES = 256
TARGET_RECALL = 0.97
#: Share of the leaves that is visited before the others are searched for better ones only.
FIRST_SHARE = 1 / 8
BLOCK_ROWS, QUERY_ROWS = 4096, 256
#: Weight of a node's radius in what its vectors can be expected to reach.
SPREAD = 0.5


def _kmeans(x: np.ndarray, k: int, draw: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[draw.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((centres ** 2).sum(axis=1) - 2 * x @ centres.T, axis=1)
        for j in range(k):
            mine = x[near == j]
            centres[j] = mine.mean(axis=0) if len(mine) else x[draw.integers(len(x))]
    return centres


class KMeansTree:
    """Nodes with centre, radius and children; a node without children is a leaf."""

    def __init__(self, x: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF_SAMPLE, seed: int = 1):
        draw = np.random.default_rng(seed)
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.children: list[list[int]] = []
        self.leaves: list[int] = []
        pending = [(self._node(x), x)]
        while pending:
            node, own = pending.pop()
            parts = []
            if len(own) > leaf:
                centres = _kmeans(own, min(branches, max(2, len(own) // leaf)), draw)
                near = np.argmin((centres ** 2).sum(axis=1) - 2 * own @ centres.T, axis=1)
                parts = [own[near == j] for j in range(len(centres)) if (near == j).any()]
            if len(parts) < 2:  # small, or all vectors alike
                self.leaves.append(node)
                continue
            for part in parts:
                child = self._node(part)
                self.children[node].append(child)
                pending.append((child, part))
        self.table = np.array(self.centres)
        self.reach = np.array(self.radii)
        self.number = {node: k for k, node in enumerate(self.leaves)}

    def _node(self, own: np.ndarray) -> int:
        centre = own.mean(axis=0)
        self.centres.append(centre)
        self.radii.append(float(np.sqrt(((own - centre) ** 2).sum(axis=1).mean())))
        self.children.append([])
        return len(self.centres) - 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf number of each vector: the nearest child at each node."""
        out = np.zeros(len(x), dtype=np.int64)
        pending = [(0, np.arange(len(x)))]
        while pending:
            node, rows = pending.pop()
            if not self.children[node]:
                out[rows] = self.number[node]
                continue
            centres = self.table[self.children[node]]
            near = np.argmin((centres ** 2).sum(axis=1) - 2 * x[rows] @ centres.T, axis=1)
            for j, child in enumerate(self.children[node]):
                if (near == j).any():
                    pending.append((child, rows[near == j]))
        return out

    def visits(self, q: np.ndarray, most: int, held: np.ndarray | None = None, least: int = 0) -> Iterator[list[int]]:
        """For each query, leaf numbers in best-bin-first order: `most`, and on until they hold `least` vectors by the counts in held."""
        hope = q @ self.table.T + SPREAD * np.sqrt((q ** 2).sum(axis=1))[:, None] * self.reach[None, :]
        for row in hope:
            queue, found, seen = [(-row[0], 0)], [], 0
            while queue and (len(found) < most or held is not None and seen < least):
                _, node = heapq.heappop(queue)
                if self.children[node]:
                    for child in self.children[node]:
                        heapq.heappush(queue, (-row[child], child))
                else:
                    found.append(self.number[node])
                    seen += 0 if held is None else held[found[-1]]
            yield found


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def best_rows(x: np.ndarray, ids: np.ndarray, q: np.ndarray, most: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the `most` largest inner products from floor up, ties to the smaller identifier, and the products.

    The products are summed the same way for equal vectors wherever they stand.
    """
    rough = x @ q
    slack = 1e-9 * (1.0 + np.abs(rough).max(initial=0.0))
    bound = floor
    if len(rough) > most:
        bound = max(bound, np.partition(rough, len(rough) - most)[len(rough) - most])
    at = np.flatnonzero(rough >= bound - slack)
    exact = (x[at] * q).sum(axis=1)
    order = np.lexsort((ids[at], -exact))[:most]
    keep = order[exact[order] >= floor - slack] if floor > -np.inf else order
    return at[keep], exact[keep]


def block_rows(x: np.ndarray, q: np.ndarray, most: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, row) that can be among a query's `most` best, with their products.

    Where a query has no floor yet, its `most` best of the block and their ties
    are returned, else all rows from the floor up.
    """
    rough = q @ x.T
    slack = 1e-9 * (1.0 + np.abs(rough).max(initial=0.0))
    bound = floors.copy()
    fresh = np.isneginf(bound)
    if len(x) > most and fresh.any():
        bound[fresh] = np.partition(rough[fresh], len(x) - most, axis=1)[:, len(x) - most]
    query, at = np.nonzero(rough >= bound[:, None] - slack)
    return query, at, np.concatenate([(x[at[i:i + 65536]] * q[query[i:i + 65536]]).sum(axis=1) for i in range(0, max(len(at), 1), 65536)])


def usable(vector: Column, dim: int) -> Column:
    """Neither null nor zero, of the common length, all components finite."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & (F.size(vector) == dim) & ~bad & F.exists(vector, lambda v: v != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = TARGET_RECALL, vector: str = "embedding",
            id_col: str = "vec_id") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k nearest found, nearest first.

    Queries are the rows where is_query holds; candidates are all rows of
    another identifier. Rows with a null identifier, and vectors that are
    null, zero, of another length than most, or hold null or non-finite
    components, take no part. Rows that repeat an identifier and vector count
    once. Ties go to the smaller identifier. Fewer candidates than k give all
    of them; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    shape = vectors.filter(F.col(id_col).isNotNull()).select(F.size(vector).alias("d")).filter("d > 0").groupBy("d").count().orderBy(F.desc("count"), "d").first()
    dim = shape["d"] if shape else 0
    rows = stash(vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vector), dim)).select(
        F.col(id_col).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"),
        F.col(vector).alias("v"), F.xxhash64(vector).alias("v1"), F.xxhash64(F.lit(5), vector).alias("v2")
    ).dropDuplicates(["vec_id", "v1", "v2"]))
    # One row more than k for a vector, since a query leaves itself out.
    first = Window.partitionBy("v1", "v2").orderBy("vec_id")
    candidates = rows.withColumn("copy", F.row_number().over(first)).filter(F.col("copy") <= k + 1).drop("copy")
    one = F.row_number().over(first)
    asking = stash(rows.filter("asks").withColumn("copy", one).filter("copy = 1").select("v1", "v2", "v", "vec_id"))

    size = max(1, min(SAMPLE_VECTORS, SAMPLE_BYTES // (8 * max(dim, 1))))
    draw = lambda df, n: df.orderBy(F.xxhash64(F.lit(9), "v1", "v2"), "v1", "v2", "vec_id").limit(n)
    sample = np.array([r["v"] for r in draw(rows, size).select("v").toLocalIterator()])
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = KMeansTree(sample)
    kind = dict(rows.dtypes)["v"]  # as stored: single precision stays half the size until it is multiplied
    number = pa.float32() if kind == "array<float>" else pa.float64()

    def leaves(batches):
        schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(number)), ("leaf", pa.int64())])
        for batch in batches:
            yield record(schema, [batch.column("vec_id"), batch.column("v"), tree.assign(_matrix(batch.column("v")))])

    placed = stash(candidates.select("vec_id", "v").mapInArrow(leaves, f"vec_id long, v {kind}, leaf long"))
    visits = _calibrated(placed, draw(asking, CALIBRATION_QUERIES).collect(), tree, k, recall)

    # One row a leaf; the tree's sample bounds their number.
    blocks = F.broadcast(placed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")))
    shelved = stash(placed.join(blocks, "leaf").select(
        "leaf", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), "vec_id", "v"))

    held = np.zeros(len(tree.leaves), dtype=np.int64)
    for r in placed.groupBy("leaf").count().collect():  # one row a leaf
        held[r["leaf"]] = r["count"]

    def walk(batches):
        schema = pa.schema([("v1", pa.int64()), ("v2", pa.int64()), ("v", pa.list_(number)), ("leaf", pa.int64()), ("turn", pa.int32())])
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                paths = list(tree.visits(_matrix(batch.column("v")), visits, held, k + 1))
                at = pa.array(np.repeat(np.arange(len(paths)), [len(p) for p in paths]))
                yield record(schema, [*(batch.column(c).take(at) for c in ("v1", "v2", "v")),
                                      np.concatenate(paths), np.concatenate([np.arange(len(p)) for p in paths])])

    paths = stash(asking.select("v1", "v2", "v").mapInArrow(walk, f"v1 long, v2 long, v {kind}, leaf long, turn int"))
    early_leaves = max(1, math.ceil(visits * FIRST_SHARE))
    top = Window.partitionBy("v1", "v2").orderBy(F.desc("score"), "vec_id")

    def searched(wanted: DataFrame) -> DataFrame:
        asked = wanted.join(blocks, "leaf").select(
            "leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("vec_id"),
            "v", "v1", "v2", "floor")
        stored = shelved.select("leaf", "block", F.lit(0).alias("kind"), "vec_id", "v", F.lit(0).cast("long").alias("v1"),
                                F.lit(0).cast("long").alias("v2"), F.lit(None).cast("double").alias("floor"))
        return (stored.unionByName(asked).repartition("leaf", "block").sortWithinPartitions("leaf", "block", "kind", "v1", "v2")
                .mapInArrow(_search(k + 1), "v1 long, v2 long, vec_id long, score double"))

    early = stash(searched(paths.filter(F.col("turn") < early_leaves).withColumn("floor", F.lit(None).cast("double")))
                  .withColumn("place", F.row_number().over(top)).filter(F.col("place") <= k + 1))
    floors = early.filter(F.col("place") == k + 1).select("v1", "v2", F.col("score").alias("floor"))
    later = searched(paths.filter(F.col("turn") >= early_leaves).join(floors, ["v1", "v2"], "left"))
    found = (early.drop("place").unionByName(later).withColumn("place", F.row_number().over(top)).filter(F.col("place") <= k + 1).drop("place"))
    answers = rows.filter("asks").select(F.col("vec_id").alias("query_id"), "v1", "v2").join(found, ["v1", "v2"]).filter("vec_id <> query_id")
    mine = Window.partitionBy("query_id", "v1", "v2").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(mine)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search(most: int):
    """Blocks of stored vectors, each followed by the queries that visit it; queries stream."""
    schema = pa.schema([("v1", pa.int64()), ("v2", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, held = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("leaf", "block", "kind")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            out = []
            for low, high in zip([0, *cuts], [*cuts, len(keys)]):
                if low == high:
                    continue
                rows = batch.slice(low, high - low)
                leaf, block, kind = keys[low]
                if (leaf, block) != current:
                    current, parts, held = (leaf, block), [], None
                if kind == 0:
                    parts.append((_matrix(rows.column("v")), rows.column("vec_id").to_numpy()))
                    continue
                if held is None and parts:
                    held, parts = (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])), []
                if held is None:
                    continue
                x, ids = held
                q, v1, v2 = _matrix(rows.column("v")), rows.column("v1").to_numpy(), rows.column("v2").to_numpy()
                floors = pc.fill_null(rows.column("floor"), -np.inf).to_numpy()
                for a in range(0, len(q), QUERY_ROWS):
                    part = slice(a, a + QUERY_ROWS)
                    query, at, score = block_rows(x, q[part], most, floors[part])
                    out.append((v1[part][query], v2[part][query], ids[at], score))
            if out:
                yield record(schema, [np.concatenate(c) for c in zip(*out)])
    return run


def _calibrated(placed: DataFrame, queries: list, tree: KMeansTree, k: int, recall: float) -> int:
    """The number of leaves to visit so that the queries' true neighbours are found to the wanted share."""
    if not queries:
        return 1
    q, own = np.array([r["v"] for r in queries]), [r["vec_id"] for r in queries]

    def brute(batches):
        schema = pa.schema([("query", pa.int32()), ("leaf", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            x, ids, leaf = _matrix(batch.column("v")), batch.column("vec_id").to_numpy(), batch.column("leaf").to_numpy()
            out = []
            for i in range(len(q)):
                at, score = best_rows(x, ids, q[i], k + 1)
                out.append((np.full(len(at), i), leaf[at], ids[at], score))
            if len(ids):
                yield record(schema, [np.concatenate(c) for c in zip(*out)])

    top = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    truth = (placed.mapInArrow(brute, "query int, leaf long, vec_id long, score double").withColumn("place", F.row_number().over(top))
             .filter(F.col("place") <= k + 1).orderBy("query", "place").collect())  # k + 1 rows for each calibration query
    turns = [{leaf: t for t, leaf in enumerate(path)} for path in tree.visits(q, len(tree.leaves))]
    lists: dict[int, list[int]] = {}
    for r in truth:
        if r["vec_id"] != own[r["query"]] and len(lists.setdefault(r["query"], [])) < k:
            lists[r["query"]].append(turns[r["query"]][r["leaf"]])
    needed = np.sort(np.concatenate([np.array(x) for x in lists.values() if x] or [np.zeros(1, dtype=np.int64)]))
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1
