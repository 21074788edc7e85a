"""License phrases found by diagonal voting, with DataFrame functions alone.

All pairs of neighbouring words of a text are hashed and joined to the places
of the same pair in the license templates. A hit votes for the diagonal, the
word of the text where the template would begin. A phrase stands where its
diagonal has all its places. For templates that may be worded a little
differently, each diagonal is merged with those near it, as far as a template
of its length may be shifted by words put in or left out, and is verified by
the share of the template that they cover together. No merge goes beyond that
reach, so repeated words near a license can't hide it. Templates may be of any
length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from hangarlog.llm.frames import stash
from hangarlog.llm.url_filter import LOWER, UPPER

#: Everything that is no word, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that must stand word for word, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Templates that may vary, and their labels.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
     "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or "
     "sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright "
     "notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without "
     "warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
     "noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of "
     "contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "mit-text"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
     "copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with "
     "regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special "
     "direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
     "negligence or other tortious action arising out of or in connection with the use or performance of this software", "isc-text"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
)
#: Words so common that a pair of them says nothing about a template.
COMMON = ("a", "and", "are", "any", "as", "at", "by", "for", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "under", "was", "with", "without")
#: Words that may be put in or left out within a template: GAP, and one more for each DRIFT words.
GAP, DRIFT = 3, 20
COVERAGE = 0.75


def word_array(text: Column) -> Column:
    """Words of the text, A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def _places(templates: Sequence[tuple[str, str]], base: bool, first: int) -> list[tuple]:
    rows = []
    for number, (phrase, label) in enumerate(templates, first):
        tokens = phrase.split()
        pairs = [(i, a, b) for i, (a, b) in enumerate(zip(tokens, tokens[1:])) if base or not (a in COMMON and b in COMMON)]
        if not pairs:
            raise ValueError(f"a template needs a pair of words that says something: {phrase!r}")
        rows += [(number, label, base, len(tokens), len(pairs), i, a, b) for i, a, b in pairs]
    return rows


def scan_licenses(docs: DataFrame, base: Sequence[tuple[str, str]] = BASE, templates: Sequence[tuple[str, str]] = TEMPLATES,
                  text: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Verified spans, and a summary with one row for each row of docs.

    Spans: k1, k2 (hashes of identifier and text), label, base, first_word,
    last_word and coverage; of diagonals that verify near each other the one
    with the best coverage is given, the first of equals. Summary: doc_id,
    n_words, n_base, first_word and last_word (smallest and largest start of a
    base phrase, else null), base_labels and labels (empty if none) and score,
    the best coverage (1 with a base phrase, 0 without any).

    Null texts count as empty, whole texts are read however long, repeated
    rows get the same result, rows without an identifier too; an empty table
    gives no rows. Other columns are not looked at. The templates are
    broadcast: one row for each of their words.
    """
    spark = docs.sparkSession
    value = F.coalesce(F.col(text), F.lit(""))
    keys = {"k1": F.xxhash64(F.col(id_col), value), "k2": F.xxhash64(F.lit(31), F.col(id_col), value)}
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(v.alias(k) for k, v in keys.items()), word_array(F.col(text)).alias("words"))

    places = spark.createDataFrame(_places(base, True, 0) + _places(templates, False, len(base)),
                                   "template int, label string, base boolean, n int, whole int, place int, p string, q string")
    places = places.withColumn("gram", F.xxhash64("p", "q"))
    # Neighbouring words: the array beside itself, moved by one. The last word stands alone; an entry ahead of all carries the number of words.
    pairs = F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))).alias("b"))
    lead = F.array(F.struct(F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b")))
    grams = keyed.select("doc_id", "k1", "k2", F.size("words").cast("long").alias("n_words"), F.posexplode(F.concat(lead, pairs))).select(
        "doc_id", "k1", "k2", "n_words", (F.col("pos") - 1).alias("pos"), F.col("col.a").alias("a"), F.col("col.b").alias("b"))
    met = grams.withColumn("gram", F.xxhash64("a", "b")).join(F.broadcast(places), "gram", "left")
    # One pass over the words: what is kept are the hits, and a row for each document.
    read = stash(met.filter((F.col("pos") < 0) | (F.col("a") == F.col("p")) & (F.col("b") == F.col("q"))).select(
        "doc_id", "k1", "k2", "n_words", "pos", "template", "label", "base", "n", "whole", "place"))
    votes = read.filter("pos >= 0").groupBy("k1", "k2", "template", "label", "base", "n", "whole", (F.col("pos") - F.col("place")).alias("diagonal")).agg(
        F.collect_set("place").alias("places"))  # as many as the template has at most

    exact = votes.filter(F.col("base") & (F.size("places") == F.col("whole"))).select(
        "k1", "k2", "label", "base", F.col("diagonal").alias("first_word"), (F.col("diagonal") + F.col("n") - 1).alias("last_word"), F.lit(1.0).alias("coverage"))
    # Diagonals in units of the template's reach, so that near ones are at most one apart.
    scaled = votes.filter("not base").withColumns({
        "at": F.col("diagonal") / (GAP + F.floor(F.col("n") / DRIFT)), "low": F.col("diagonal") + F.array_min("places"), "high": F.col("diagonal") + F.array_max("places") + 1})
    order = Window.partitionBy("k1", "k2", "template").orderBy("at")
    near, earlier, later = order.rangeBetween(-1, 1), order.rangeBetween(-1, 0), order.rangeBetween(0, 1)
    covered = scaled.withColumns({
        "coverage": F.size(F.array_distinct(F.flatten(F.collect_list("places").over(near)))) / F.col("whole"),
        "first_word": F.min("low").over(near), "last_word": F.max("high").over(near)}).filter(F.col("coverage") >= COVERAGE)
    best = covered.withColumns({
        "later": F.max("coverage").over(later), "earlier": F.max(F.struct("coverage", (-F.col("at")).alias("at"))).over(earlier)}).filter(
        (F.col("coverage") >= F.col("later")) & (F.col("earlier.coverage") <= F.col("coverage")) & (F.col("earlier.at") == -F.col("at")))
    spans = exact.unionByName(best.select(*exact.columns))

    base_only = lambda c: F.when(F.col("base"), c)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans.groupBy("k1", "k2").agg(
        F.count(base_only(F.lit(1))).alias("n_base"), F.min(base_only(F.col("first_word"))).cast("long").alias("first_word"),
        F.max(base_only(F.col("first_word"))).cast("long").alias("last_word"),
        joined(base_only(F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"), F.max("coverage").alias("score"))
    summary = read.filter("pos < 0").select("doc_id", "k1", "k2", "n_words").join(found, ["k1", "k2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
    return spans, summary
