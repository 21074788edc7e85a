"""Language identification by rank-order profiles of character n-grams.

A profile is the ranked list of a language's most frequent n-grams. A text is
ranked the same way; its distance to a profile is the sum over its n-grams of
how far each is out of place. N-grams are of letters, one to three long, with
a blank at word ends.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from hangarlog.llm.frames import free_name

PROFILE, TEXT_GRAMS = 400, 300
#: Labelled texts that a profile is learned from, and their bytes: texts are taken by their hash until one of both is reached.
SAMPLE_TEXTS, SAMPLE_BYTES = 2000, 32 << 20
DRAW_BITS = 62
UNKNOWN = "und"
_LETTER = np.zeros(0, dtype=bool)


def _letters() -> np.ndarray:
    """For every code point below 0x20000, whether it is a letter; made once in a worker."""
    global _LETTER
    if not len(_LETTER):
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x20000)), dtype=bool, count=0x20000)
    return _LETTER


def _points(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a text in lower case, and which are letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    known = _letters()
    return points, known[np.minimum(points, len(known) - 1)] | (points >= len(known))


def has_letter(text: str | None) -> bool:
    return bool(_points(text)[1].any())


def gram_counts(text: str | None, longest: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a text's n-grams, ascending, and their counts."""
    points, letter = _points(text)
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.ones(len(points) + 2, dtype=np.int64)  # 1 is the blank
    padded[1:-1] = np.where(letter, points + 2, 1)
    blank = padded == 1
    keep = ~(blank[1:] & blank[:-1])  # one blank between words
    padded = padded[np.concatenate(([True], keep))]
    parts, code = [padded[padded > 1]], padded
    for n in range(2, longest + 1):
        code = (code[:-1] << 21) | padded[n - 1:]
        # A blank stands only first or last.
        good = np.ones(len(code), dtype=bool)
        for k in range(1, n - 1):
            good &= padded[k:len(padded) - n + 1 + k] > 1
        parts.append(code[good])
    codes = np.sort(np.concatenate(parts))
    new = np.concatenate(([True], codes[1:] != codes[:-1]))
    at = np.flatnonzero(new)
    return codes[at], np.diff(np.concatenate((at, [len(codes)])))


def top_ranked(codes: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent codes and their ranks; equal counts share the rank in their middle, ties go to the smaller code."""
    order = np.argsort(-counts, kind="stable")[:most]
    sorted_counts = counts[order]
    low = np.searchsorted(-sorted_counts, -sorted_counts, "left")
    high = np.searchsorted(-sorted_counts, -sorted_counts, "right")
    return codes[order], (low + high - 1) / 2


class Profiles:
    """Ranks of n-grams by language: codes ascending, one row of ranks for each."""

    def __init__(self, ranked: Mapping[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(ranked)
        self.codes = np.unique(np.concatenate([ranked[x][0] for x in self.languages] or [np.zeros(0, np.int64)]))
        self.ranks = np.full((len(self.codes), len(self.languages)), np.inf)
        for k, name in enumerate(self.languages):
            codes, ranks = ranked[name]
            self.ranks[np.searchsorted(self.codes, codes), k] = ranks

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language with the least out-of-place distance (ties to the first name) and 1 - distance / greatest possible."""
        codes, counts = gram_counts(text)
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        codes, ranks = top_ranked(codes, counts, TEXT_GRAMS)
        at = np.minimum(np.searchsorted(self.codes, codes), max(len(self.codes) - 1, 0))
        there = self.codes[at] == codes
        away = np.full((len(codes), len(self.languages)), float(PROFILE))
        away[there] = np.minimum(np.abs(self.ranks[at[there]] - ranks[there, None]), PROFILE)
        distance = away.sum(axis=0)
        best = int(np.argmin(distance))
        return self.languages[best], float(1.0 - distance[best] / (PROFILE * len(codes)))


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the identifier as text leaves remainder 2 modulo 4; null identifiers do not."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def _by_language(values: Mapping[str, int]) -> Column:
    """The language's value as a bigint column, null for a language without one."""
    return F.create_map(*(x for name, v in values.items() for x in (F.lit(name), F.lit(v).cast("bigint"))))[F.col("lang")]


def _last_draws(rows: DataFrame, totals: Mapping[str, Row], texts: int, size: int) -> dict[str, int]:
    """By language the draw of the text that reaches the first bound, or the largest draw.

    Only a range of draws that holds about twice the wanted texts, and the
    first text at least, is put in order; it is widened for a language where it
    reaches neither bound.
    """
    last: dict[str, int] = {}
    share = {name: 2 * texts / r["n"] for name, r in totals.items()}
    while share:
        upper = {name: max(totals[name]["first"], int(min(x, 1.0) * (1 << DRAW_BITS))) for name, x in share.items()}
        before = Window.partitionBy("lang").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
        near = rows.filter(F.col("draw") <= _by_language(upper)).groupBy("lang", "draw").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
        near = near.withColumns({"n_before": F.coalesce(F.sum("n").over(before), F.lit(0)), "size_before": F.coalesce(F.sum("size").over(before), F.lit(0))})
        taken = near.filter((F.col("n_before") < texts) & (F.col("size_before") < size))
        for r in taken.groupBy("lang").agg(F.max("draw").alias("draw"), F.sum("n").alias("n"), F.sum("size").alias("size")).collect():
            if r["n"] >= texts or r["size"] >= size or r["n"] == totals[r["lang"]]["n"] or share[r["lang"]] >= 1:
                last[r["lang"]] = r["draw"]
        share = {name: 16 * x for name, x in share.items() if name not in last}
    return last


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id",
                   sample_texts: int = SAMPLE_TEXTS, sample_bytes: int = SAMPLE_BYTES) -> Profiles:
    """Profiles from labelled texts that are not held out.

    A language's sample is the texts with the smallest hash, taken until there
    are sample_texts texts or sample_bytes bytes; the text that reaches a bound
    is the last one, so a language has one text at least. Rows that repeat
    identifier and text have one hash and are taken together; everything else
    covers all rows. Spark counts the n-grams of the sample per task; a
    language's counts meet in one group of at most as many rows as there are
    tasks.
    """
    value, size = F.col(text), F.octet_length(F.col(text))
    labelled = docs.filter(F.col(lang).isNotNull() & value.isNotNull() & (size > 0) & ~held_out(F.col(id_col)))
    draw = F.shiftrightunsigned(F.xxhash64(id_col, text), 64 - DRAW_BITS)
    rows = labelled.select(F.col(lang).alias("lang"), draw.alias("draw"), size.cast("bigint").alias("size"), value.alias("text"))
    totals = {r["lang"]: r for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("first")).collect()}
    if not totals:
        return Profiles({})
    last = _last_draws(rows, totals, sample_texts, sample_bytes)
    sample = rows.filter(F.col("draw") <= _by_language(last)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes, counts = gram_counts(body)
                old = seen.get(name, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                merged, where = np.unique(np.concatenate((old[0], codes)), return_inverse=True)
                seen[name] = merged, np.bincount(where, np.concatenate((old[1], counts)), len(merged)).astype(np.int64)
        for name, (codes, counts) in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes)), pa.array(codes), pa.array(counts)], names=["lang", "code", "n"])

    grams = sample.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    best = grams.withColumn("place", place).filter(F.col("place") <= PROFILE).orderBy("lang", "place").collect()  # PROFILE rows a language
    ranked = {}
    for name in totals:
        rows = [r for r in best if r["lang"] == name]
        if rows:
            ranked[name] = top_ranked(np.array([r["code"] for r in rows]), np.array([r["n"] for r in rows]), PROFILE)
    return Profiles(ranked)


def _judged(docs: DataFrame, profiles: Profiles, text: str, made: str) -> DataFrame:
    """Add a struct: the predicted language, its score, and whether the text has a letter."""
    @F.pandas_udf("lang string, score double, lettered boolean")
    def predict(values):
        import pandas as pd

        found = [profiles.predict(v) for v in values]
        return pd.DataFrame([(*x, x[0] != UNKNOWN or has_letter(v)) for x, v in zip(found, values)], columns=["lang", "score", "lettered"])

    return docs.withColumn(made, predict(F.col(text)))


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", prediction: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language and its score (0 to 1) to each row, from the whole text.

    A text that is null or has no letter gets `und` and 0; so does every text
    where no language was learned. Ties go to the language whose name comes
    first. Column names already taken get an underscore at the end.
    """
    made = free_name(docs, "_language")
    out = _judged(docs, profiles, text, made)
    return out.withColumns({free_name(docs, prediction): F.col(made)["lang"], free_name(docs, score): F.col(made)["score"]}).drop(made)


def keep_identified(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """The rows whose text can have a language; null texts and texts without letters go, and no others.

    Where no language was learned, or one is itself named `und`, texts with
    letters stay.
    """
    made = free_name(docs, "_language")
    return _judged(docs, profiles, text, made).filter(F.col(made)["lettered"]).select(*docs.columns)
