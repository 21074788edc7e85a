"""URL rules tested against a cascade of Bloom filters, exact on the corpus.

The corpus's candidate keys (host suffixes with the path prefixes that rules
can have) form the universe. Level 0 encodes the listed keys; level 1 the keys
of the universe that level 0 takes for listed; level 2 the listed keys that
level 1 takes for such; and so on until no key is left. A key is listed if the
number of levels it passes is odd. Within the universe there is no error, and
a page is judged in its row: nothing is joined. A level is made as large as it
takes to let no more keys through than it holds itself, so levels grow with
the list, and with the universe by its logarithm only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hangarlog.llm.frames import free_name, stash
from hangarlog.llm.textbytes import mix

#: Share of the keys outside that a level may let through at most; less where the universe is more than so many times the list.
FALSE_SHARE = 0.01
#: Bits of a level that a task holds; a longer list is cut by key hash and tested slice by slice.
SLICE_BITS = 1 << 28

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit(811), key)


class Level:
    """One Bloom filter: some positions of a key in an array of bits."""

    def __init__(self, number: int, bits: int, hashes: int):
        self.number, self.bits, self.hashes = number, bits, hashes
        self.words = np.zeros(-(-bits // 64), dtype=np.uint64)

    def positions(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        a = mix(h1.astype(np.uint64) + np.uint64(2 * self.number + 1))
        b = mix(h2.astype(np.uint64) + np.uint64(2 * self.number + 1)) | np.uint64(1)
        return (a[None, :] + np.arange(self.hashes, dtype=np.uint64)[:, None] * b[None, :]) % np.uint64(self.bits)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = self.positions(h1, h2)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)


class Cascade:
    def __init__(self, levels: list[Level]):
        self.levels = levels

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether each key of the universe is listed."""
        passed = np.zeros(len(h1), dtype=np.int64)
        alive = np.arange(len(h1))
        for level in self.levels:
            alive = alive[level.contains(h1[alive], h2[alive])]
            passed[alive] += 1
        return passed % 2 == 1


def _shape(inside: int, outside: int) -> tuple[float, int]:
    """Bits a key and hashes with which, of `outside` keys, about as many pass as are inside, or fewer."""
    need = -math.log2(min(FALSE_SHARE, max(inside, 1) / max(outside, 1)))
    return 1.45 * need, max(2, math.ceil(need))


def _encode(keys: DataFrame, number: int, count: int, others: int) -> Level:
    bits_a_key, hashes = _shape(count, others)
    level = Level(number, max(64, math.ceil(bits_a_key * count)), hashes)

    def bits(batches):
        for batch in batches:
            at = np.unique(level.positions(batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            masks = np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays(
                [pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(masks.view(np.int64))], names=["word", "mask"])

    words = keys.select("h1", "h2").mapInArrow(bits, "word long, mask long").groupBy("word").agg(F.expr("bit_or(mask)").alias("mask"))
    found = words.toPandas()  # a level's own words: about SLICE_BITS / 64 rows at most
    level.words[found["word"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return level


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    @F.pandas_udf("boolean")
    def passes(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(level.contains(h1.to_numpy(), h2.to_numpy()))

    return keys.filter(passes("h1", "h2"))


def build_cascade(listed: DataFrame, universe: DataFrame, most_levels: int = 64) -> Cascade:
    """listed and universe hold distinct key hashes h1, h2; the cascade is exact for keys of both."""
    inside = listed.select("h1", "h2")
    outside = universe.select("h1", "h2").join(inside, ["h1", "h2"], "left_anti")
    levels: list[Level] = []
    count, others = inside.count(), outside.count()
    while len(levels) < most_levels:
        if not count:
            return Cascade(levels)
        levels.append(_encode(inside, len(levels), count, others))
        inside, outside = stash(_passing(outside, levels[-1])), inside
        count, others = inside.count(), count
    raise ValueError("two different keys share both 64-bit hashes")


def build_slices(listed: DataFrame, universe: DataFrame) -> list[Cascade]:
    """Cascades of the keys whose h1 falls into slice 0, 1, ...; one slice unless the list is very long.

    No level of a slice holds more than about twice SLICE_BITS: the first is
    cut to that, and the others hold no more keys than the one before.
    """
    listed, universe = stash(listed.distinct()), stash(universe.distinct())
    count = listed.count()
    slices = max(1, math.ceil(count * _shape(count, universe.count())[0] / SLICE_BITS))
    part = F.pmod("h1", F.lit(slices))
    return [build_cascade(listed.filter(part == i), universe.filter(part == i)) for i in range(slices)]


def candidate_keys(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """A page's keys, longest first, longer host first: its host and parent domains, each with prefixes of its path."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths)), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(
        (-F.length(s) - F.length(p)).alias("o"), (-F.length(s)).alias("h"), F.concat(s, p).alias("key")))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.array_sort(keys), lambda k: k["key"]))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], listed: DataFrame, url: str = "url") -> DataFrame:
    """Add host, path, rule and verdict to each row of pages.

    rules are (host/path, allow or block); the longest that fits decides and
    is returned. Elsewhere a page is blocked if its host or a parent domain is
    in `listed` (column host), else allowed, and rule is null. A null url or
    one without :// has an empty host and path and is allowed. Repeated rows
    are judged alike; an empty table gives no rows. Columns of pages that
    already have one of the four names are refused.
    """
    if clash := {"host", "path", "rule", "verdict"} & {c.lower() for c in pages.columns}:
        raise ValueError(f"columns clash with results: {sorted(clash)}")
    spark = pages.sparkSession
    lengths = sorted({len(r) - r.index("/") for r, _ in rules})
    parsed = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    k, ks, h, r = (free_name(pages, n) for n in ("_keys", "_hosts", "_hit", "_rule"))
    keys, hosts = candidate_keys(F.col("host"), F.col("path"), lengths), candidate_keys(F.col("host"), F.lit(""), [0])
    both = parsed.select(F.explode(F.concat(keys, hosts)).alias("key")).distinct()
    universe = stash(both.select(*(c.alias(n) for c, n in zip(key_hashes(F.col("key")), ("h1", "h2")))))

    def cascades(frame: DataFrame) -> list[Cascade]:
        return build_slices(frame.select(*(c.alias(n) for c, n in zip(key_hashes(F.col("key")), ("h1", "h2")))), universe)

    # Every rule is in one of two lists: those that allow, those that block.
    sets = {"block": [x for x, v in rules if v == "block"], "allow": [x for x, v in rules if v == "allow"]}
    marks: list[tuple[str, str, list[Cascade]]] = [
        (verdict, k, cascades(spark.createDataFrame([(x,) for x in sets[verdict]], "key string"))) for verdict in sets]
    marks.append(("listed", ks, cascades(listed.select(F.col("host").alias("key")).filter("key is not null"))))
    judged = parsed.withColumns({k: keys, ks: hosts})
    for name, column, slices in marks:
        found = free_name(pages, f"_{name}")
        for i, cascade in enumerate(slices):
            hit = _first_hit(cascade, i, len(slices))(
                F.transform(column, lambda x: key_hashes(x)[0]), F.transform(column, lambda x: key_hashes(x)[1]))
            judged = judged.withColumn(found, hit if i == 0 else F.least(found, hit))
            if len(slices) > 1:
                judged = stash(judged)
    block, allow, host = (F.col(free_name(pages, f"_{n}")) for n in ("block", "allow", "listed"))
    rule = F.when(F.least(block, allow) < F.size(k), F.get(F.col(k), F.least(block, allow)))
    verdict = (F.when(rule.isNotNull(), F.when(block < allow, F.lit("block")).otherwise(F.lit("allow")))
               .when(host < F.size(ks), F.lit("block")).otherwise(F.lit("allow")))
    return judged.withColumns({"rule": rule, "verdict": verdict}).select(*pages.columns, "host", "path", "rule", "verdict")


def _first_hit(cascade: Cascade, part: int, parts: int):
    """Index of a row's first listed key, or the number of its keys."""
    @F.pandas_udf("int")
    def first_hit(h1: pd.Series, h2: pd.Series) -> pd.Series:
        sizes = h1.map(len).to_numpy().astype(np.int64) if len(h1) else np.zeros(0, np.int64)
        if not sizes.sum():
            return pd.Series(sizes.astype(np.int32))
        a, b = np.concatenate(list(h1)).astype(np.int64), np.concatenate(list(h2)).astype(np.int64)
        hit = cascade.contains(a, b)
        if parts > 1:
            hit &= np.mod(a, parts) == part
        index = np.concatenate([np.arange(n) for n in sizes])
        row = np.repeat(np.arange(len(sizes)), sizes)
        first = sizes.copy()
        np.minimum.at(first, row[hit], index[hit])
        return pd.Series(first.astype(np.int32))
    return first_hit
