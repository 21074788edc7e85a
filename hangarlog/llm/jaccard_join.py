"""Texts whose sets of word n-grams have a Jaccard similarity of 0.8 or more.

Texts with equal n-gram sets form a class; one signature of MinHash values
stands for it. Classes that agree in a whole band of values are candidates.
A pair's values are then compared step by step; it is dropped as soon as the
posterior probability that its similarity reaches the threshold is below the
tolerance. The pairs that are left are verified on their sets.

Large bands are cut into blocks of classes, and a task compares two blocks
with arrays. The first job writes, for each left class, the identifiers of the
partners that survive, so n near copies that all differ emit about n * n / 2
identifiers in n rows; the verifying job returns a count of links for each
class and a tree of the linked ones. There is no cap on band sizes or partners.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from hangarlog.llm.components import connected_components
from hangarlog.llm.frames import free_name, join_groups, record, row_key, sorted_groups, stash
from hangarlog.llm.textbytes import shingle_sets, slices

BANDS, ROWS = 24, 4  # a pair at 0.8 shares no band with probability 3e-6
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-7
#: Classes and shingles of a block.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
_MULTIPLIERS = np.random.default_rng(20261).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

PRINT = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("doc_id", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()),
                   ("n", pa.int64()), ("sig", pa.binary())])


def minhash(sets: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """HASHES values of each set, 32 bits each; empty sets have zeros."""
    out = np.zeros((len(begins) - 1, HASHES), dtype=np.uint32)
    full = np.flatnonzero(np.diff(begins))
    if len(full):
        at = begins[full]
        for k, m in enumerate(_MULTIPLIERS):
            out[full, k] = (np.minimum.reduceat(sets * m, at) >> np.uint64(32)).astype(np.uint32)
    return out


def least_matches(threshold: float, tolerance: float, step: int = STEP, total: int = HASHES) -> list[tuple[int, int]]:
    """For each number of values compared, the matches a pair needs to stay.

    With a uniform prior, m of n matches give the posterior Beta(m + 1, n - m + 1).
    P(similarity >= t) is then the probability of at most m successes in n + 1 trials at t.
    """
    out = []
    for n in [*range(step, total, step), total]:
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def _prints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets, begins = shingle_sets(batch.column("text"), words)
                sig = minhash(sets, begins)
                # Two sums over well mixed numbers tell sets apart.
                low, high = sets * _MULTIPLIERS[0], (sets ^ (sets >> np.uint64(29))) * _MULTIPLIERS[1]
                sums = [np.concatenate(([np.uint64(0)], np.cumsum(x, dtype=np.uint64))) for x in (low ^ (low >> np.uint64(31)), high ^ (high >> np.uint64(33)))]
                c1, c2 = ((s[begins[1:]] - s[begins[:-1]]).view(np.int64) for s in sums)
                yield record(PRINT, [batch.column("k1"), batch.column("k2"), batch.column("doc_id"), c1, c2, np.diff(begins), [x.tobytes() for x in sig]])
    return run


def _sets(words: int):
    schema = pa.schema([("class", pa.int64()), ("set", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets, begins = shingle_sets(batch.column("text"), words)
                yield record(schema, [batch.column("class"), [sets[a:b].tobytes() for a, b in zip(begins, begins[1:])]])
    return run


def _candidates(threshold: float, tolerance: float):
    """Pairs of a cell whose first common band is the cell's, pruned step by step."""
    needs = least_matches(threshold, tolerance)
    schema = pa.schema([("band", pa.int32()), ("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("left", pa.int64()), ("right", pa.list_(pa.int64()))])

    def survivors(band: int, sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        matches, done = np.zeros(len(a), dtype=np.int64), 0
        at = np.arange(len(a))
        for n, least in needs:
            same = sig[a[at], done:n] == sig[b[at], done:n]
            matches[at] += same.sum(axis=1)
            stay = matches[at] >= least
            # A pair belongs to the first band it shares.
            whole = same.reshape(len(at), -1, ROWS).all(axis=2)
            for x in range(whole.shape[1]):
                t = done // ROWS + x
                if t < band:
                    stay &= ~whole[:, x]
                elif t == band:
                    stay &= whole[:, x]
            at, done = at[stay], n
            if not len(at):
                break
        return at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (band, key, i, j), rows in sorted_groups(batches, 4):
            if len(rows) < 2:
                continue
            ids = np.array([r[0] for r in rows])
            side = np.array([r[1] for r in rows])
            sig = np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint32).reshape(len(rows), HASHES)
            if i == j:
                a, b = np.triu_indices(len(rows), 1)
            else:
                first, second = np.flatnonzero(side == i), np.flatnonzero(side == j)
                a, b = np.repeat(first, len(second)), np.tile(second, len(first))
            if not len(a):
                continue
            kept = survivors(band, sig, a, b)
            if not len(kept):
                continue
            a, b = a[kept], b[kept]
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            cuts = np.flatnonzero(np.diff(a)) + 1
            for left, right in zip(a[np.concatenate(([0], cuts))], np.split(b, cuts)):
                out.append((band, key, i, j, ids[left], ids[right]))
            out.append((band, key, i, j, None, ids[np.unique(np.concatenate((a, b)))]))  # whose sets the cell needs
            if len(out) >= 2000:
                yield record(schema, list(zip(*out)))
                out.clear()
        if out:
            yield record(schema, list(zip(*out)))
    return run


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (a, b) of sets."""
    if len(a) <= 4:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[inverse] > 1
    column = (np.cumsum(counts > 1) - 1)[inverse[shared]]
    owner = owner[shared]
    out = np.zeros(len(a), dtype=np.int64)
    width = 4096
    for low in range(0, int((counts > 1).sum()), width):
        here = (column >= low) & (column < low + width)
        grid = np.zeros((len(sets), width), dtype=np.float32)
        grid[owner[here], column[here] - low] = 1
        out += (grid @ grid.T)[a, b].astype(np.int64)
    return out


def _links(threshold: float):
    """Verify a cell's pairs; give each class its links there and the root of its tree."""
    schema = pa.schema([("class", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, rows in sorted_groups(batches, 4):
            sets = {c: np.frombuffer(s, dtype=np.uint64) for c, size, s, _ in rows if s is not None}
            sizes = {c: size for c, size, s, _ in rows if s is not None}
            ids = sorted(sets)
            place = {c: x for x, c in enumerate(ids)}
            lists = [(c, p) for c, _, s, p in rows if s is None]
            a = np.repeat([place[c] for c, _ in lists], [len(p) for _, p in lists])
            b = np.array([place[x] for _, p in lists for x in p], dtype=np.int64)
            members = [sets[c] for c in ids]
            n = np.array([len(s) for s in members], dtype=np.int64)
            shared = overlaps(members, a, b)
            # shared / union >= threshold, in whole numbers for thresholds of up to six digits
            good = shared * 1_000_000 >= round(threshold * 1_000_000) * (n[a] + n[b] - shared)
            a, b = a[good], b[good]
            weight = np.array([sizes[c] for c in ids], dtype=np.int64)
            links = np.zeros(len(ids), dtype=np.int64)
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            root = np.arange(len(ids))
            while True:
                low = np.minimum(root[a], root[b])
                fresh = root.copy()
                np.minimum.at(fresh, a, low)
                np.minimum.at(fresh, b, low)
                fresh = np.minimum(fresh, fresh[fresh])
                if (fresh == root).all():
                    break
                root = fresh
            for x in np.flatnonzero(links):
                out.append((ids[x], int(links[x]), ids[root[x]]))
            if len(out) >= 5000:
                yield record(schema, list(zip(*out)))
                out.clear()
        if out:
            yield record(schema, list(zip(*out)))
    return run


def near_classes(docs: DataFrame, threshold: float = 0.8, words: int = 5, tolerance: float = TOLERANCE,
                 text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each row of docs: k1, k2 (its key), doc_id, group_key, class_id, copies_id, n_links.

    copies_id is the smallest identifier of the rows with the same n-gram set,
    class_id the smallest one that can be reached over links of similarity
    threshold or more, n_links the number of other rows so similar. Words are
    split at ASCII white space, case and marks count. A text of fewer words
    than an n-gram has is one n-gram; texts without words (null ones too) are
    copies of each other and like nothing else. A class's name is null only if
    all its identifiers are; where identifiers repeat or are null, group_key
    still tells classes apart.
    """
    k1, k2 = row_key(docs)
    source = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    prints = stash(source.mapInArrow(_prints(words), T.StructType([
        T.StructField(n, T.BinaryType() if n == "sig" else T.LongType()) for n in PRINT.names])))
    # A class: equal sets. It is named by a hash in the work below and by an identifier in the result.
    named = prints.withColumn("class", F.xxhash64("c1", "c2", "n"))
    classes = stash(named.groupBy("class").agg(
        F.count("*").alias("size"), F.min("doc_id").alias("copies_id"), F.first("sig").alias("sig"), F.max("n").alias("n"),
        F.min(F.struct("k1", "k2")).alias("one")))  # a row to read the set from

    value = lambda t: F.substring("sig", F.lit(4 * ROWS * t + 1), F.lit(4 * ROWS))
    bands = classes.filter("n > 0").select("class", "n", F.posexplode(F.array(*(F.xxhash64(value(t)) for t in range(BANDS)))).alias("band", "key"))
    full = bands.groupBy("band", "key").agg(F.count("*").alias("members"), F.sum("n").alias("shingles")).filter("members > 1")
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    mine = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    cells = (bands.drop("n").join(full.select("band", "key", blocks.alias("blocks")), ["band", "key"])
             .withColumn("mine", mine)
             .select("class", "band", "key", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
             .select("class", "band", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine"))
    cell = ["band", "key", "i", "j"]
    members = cells.join(classes.select("class", "sig"), "class").select(*cell, "class", F.col("mine").alias("side"), "sig")
    pairs = stash(members.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(
        _candidates(threshold, tolerance), "band int, key long, i int, j int, left long, right array<long>"))

    # The sets of the classes that are left, once for each cell they are in.
    used = pairs.filter("left is null").select(*cell, F.explode("right").alias("class"))
    one = classes.join(used.select("class").distinct(), "class").select("class", "one.*")
    sets = source.join(one, ["k1", "k2"]).select("class", "text").mapInArrow(_sets(words), "class long, set binary")
    loaded = used.join(sets, "class").join(classes.select("class", "size"), "class").select(*cell, "class", "size", "set", F.lit(None).cast("array<long>").alias("right"))
    lists = pairs.filter("left is not null").select(*cell, F.col("left").alias("class"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("binary").alias("set"), "right")
    linked = stash(loaded.unionByName(lists).repartition(*cell).sortWithinPartitions(*cell).mapInArrow(
        _links(threshold), "class long, links long, root long"))

    roots = connected_components(linked.select(F.col("class").alias("a"), F.col("root").alias("b")))
    near = linked.groupBy("class").agg(F.sum("links").alias("links")).join(roots.withColumnRenamed("node", "class"), "class", "left")
    named_roots = stash(classes.select("class", "size", "copies_id").join(near, "class", "left")
                        .withColumn("root", F.coalesce("root", "class")))
    smallest = named_roots.groupBy("root").agg(F.min("copies_id").alias("class_id"))
    full_classes = stash(named_roots.join(smallest, "root").select(
        "class", "size", "copies_id", "class_id", F.col("root").alias("group_key"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    rows = full_classes.agg(F.sum("size")).first()[0] or 0
    return join_groups(named.select("class", "k1", "k2", "doc_id"), full_classes, ["class"], "size", rows).select(
        "k1", "k2", "doc_id", "group_key", "class_id", "copies_id", "n_links")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay: of each group of near copies, the one with the smallest identifier."""
    names = [free_name(docs, n) for n in ("_near_k1", "_near_k2")]
    k1, k2 = row_key(docs)
    found = stash(near_classes(docs, **options))
    keep = found.groupBy("group_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("k"))
    keyed = docs.withColumns(dict(zip(names, (k1, k2))))
    stays = keyed.join(keep.select(F.col("k.k1").alias(names[0]), F.col("k.k2").alias(names[1])), names, "left_semi")
    repeated = found.groupBy("k1", "k2").count().filter("count > 1").select(F.col("k1").alias(names[0]), F.col("k2").alias(names[1]))
    if not repeated.isEmpty():
        stays = stays.join(repeated, names, "left_anti").unionByName(stays.join(repeated, names, "left_semi").dropDuplicates(names))
    return stays.drop(*names)
