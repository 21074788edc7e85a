"""URL rules, quality, licenses, language, nearest neighbours and the pipeline against brute force or held-out rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from hangarlog.llm import ann, language_id, license_scan, quality, queries, url_filter
from llm_helpers import WORDS, doc, prose

FOLDER = "/root/testdata/sf0.001"


# ---- URL rules -------------------------------------------------------------

URLS = ["http://a.org/x", "https://EXAMPLE.org/es/", "http://example.org/en/12?q", "http://www.Example.ORG/en/2", "https://x.com/fr/1#a", "ftp://com/de/",
        "http://com", "http://casino-win.example.com/", "http://m.casino-win.example.com?x", "http://notcasino-win.example.com/", None, "", "no scheme/org/",
        "http://", "://org/", "http://a://b.org/", "http://org/\nline", "http://sub.spam-farm.example.net/en/1", "http://x.net:80/p", "http://.org/", "http://é.org/ü"]


def _judge(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(len(r), r, v) for r, v in queries.URL_RULES for h, p in [(r[:r.index("/")], r[r.index("/"):])]
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    bad = [f"{s}.{d}" for s in queries.LISTED_SITES for d in queries.LISTED_DOMAINS]
    return host, path, None, "block" if any(host == b or host.endswith("." + b) for b in bad) else "allow"


@pytest.mark.parametrize("slice_bits", [1 << 28, 64])
def test_urls_against_brute_force(spark, monkeypatch, slice_bits):
    monkeypatch.setattr(url_filter, "SLICE_BITS", slice_bits)
    rng = random.Random(1)
    urls = URLS + URLS[:3] + [f"http{rng.choice(['', 's'])}://{rng.choice(['www.', '', 'm.a.'])}{rng.choice(['example', 'other', 'casino-win.example', 'b'])}."
                              f"{rng.choice(['org', 'com', 'net'])}{rng.choice(['/en/1', '/es/x', '/fr/', '/de/', '/', ''])}{rng.choice(['', '?a', '#b', '5'])}" for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([(f"{s}.{d}",) for s in queries.LISTED_SITES for d in queries.LISTED_DOMAINS] + [(None,)], "host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, queries.URL_RULES, listed).collect()}
    assert got == {i: _judge(u) for i, u in enumerate(urls)}
    assert url_filter.judge_urls(pages.limit(0), queries.URL_RULES, listed).collect() == []
    with pytest.raises(ValueError, match="clash"):
        url_filter.judge_urls(pages.withColumn("HOST", F.lit(1)), queries.URL_RULES, listed)


def test_a_cascade_is_exact_on_its_universe(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "FALSE_SHARE", 0.3)  # many false positives, so many levels
    universe = spark.range(4000).select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(1), "id").alias("h2"), "id")
    cascade = url_filter.build_cascade(universe.filter("id % 7 = 0"), universe)
    rows = universe.toPandas()
    assert len(cascade.levels) > 2
    assert (cascade.contains(rows.h1.to_numpy(), rows.h2.to_numpy()) == (rows.id.to_numpy() % 7 == 0)).all()
    assert not url_filter.build_cascade(universe.limit(0), universe).contains(rows.h1.to_numpy(), rows.h2.to_numpy()).any()


def test_levels_grow_with_the_list_and_not_with_the_universe(spark):
    for size in (20_000, 200_000):
        universe = spark.range(size).select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(1), "id").alias("h2"), "id")
        cascade = url_filter.build_cascade(universe.filter("id < 200"), universe)
        assert cascade.levels[0].bits < 200 * 1.45 * (np.log2(size / 200) + 1) + 64
        assert all(level.bits < 200 * 1.45 * 7 * 2 for level in cascade.levels[1:])  # up to twice as many as expected
        rows = universe.toPandas()
        assert (cascade.contains(rows.h1.to_numpy(), rows.h2.to_numpy()) == (rows.id.to_numpy() < 200)).all()


def test_walks_go_on_until_an_answer_is_full(spark, monkeypatch):
    """Tight clusters of fewer vectors than are asked for, and one leaf a query by calibration."""
    monkeypatch.setattr(ann, "LEAF_SAMPLE", 4)
    monkeypatch.setattr(ann, "_calibrated", lambda *a: 1)
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(60, 8)) * 10
    rows = [(i, (centres[i % 60] + draw.normal(size=8) / 100).tolist()) for i in range(300)]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=20)
    assert {r["count"] for r in out.groupBy("query_id").count().collect()} == {20}
    few = ann.nearest(spark.createDataFrame(rows[:12], "vec_id long, embedding array<double>"), F.col("vec_id") % 5 == 0, k=20)
    assert {r["count"] for r in few.groupBy("query_id").count().collect()} == {11}


# ---- language --------------------------------------------------------------

def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = queries.op9_language_id(spark, FOLDER).join(docs, "doc_id").filter("held_out").collect()
    assert rows and sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 and (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_language_of_odd_rows(docs, odd_rows):
    frame = docs(odd_rows)
    profiles = language_id.learn_profiles(docs([doc(i, prose(random.Random(i), 30), lang="xx") for i in range(40)]))
    out = language_id.identify(frame, profiles)
    assert out.columns == [*frame.columns, "lang_pred", "score_"]  # score is taken
    for r in out.collect():
        has_letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "xx") == has_letter and (has_letter or r.score_ == 0.0) and 0 <= r.score_ <= 1
    kept = language_id.keep_identified(frame, profiles)
    assert kept.columns == frame.columns and kept.count() == sum(any(c.isalpha() for c in r[1] or "") for r in odd_rows)
    assert language_id.identify(docs([]), profiles).collect() == []
    nothing = language_id.learn_profiles(docs([]))
    assert {r.lang_pred for r in language_id.identify(frame, nothing).collect()} == {"und"}


@pytest.mark.parametrize("label", [None, "held out only", "und"])
def test_texts_with_letters_stay_where_no_language_is_learned(docs, odd_rows, label):
    held = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 4 == 2)
    rows = [(*r[:2], label if label == "und" else None, *r[3:]) for r in odd_rows]
    if label == "held out only":
        rows.append(doc(held, "labelled, but in the held-out quarter", lang="xx"))
    frame = docs(rows)
    assert language_id.learn_profiles(frame).languages == (["und"] if label == "und" else [])
    lettered = Counter(r[:2] for r in rows if any(c.isalpha() for c in r[1] or ""))
    out = dict(corpus_pipeline.STAGES)["language_id"](frame.sparkSession, frame, FOLDER)
    assert out.columns == frame.columns and Counter((r.doc_id, r.text) for r in out.collect()) == lettered


def test_every_labelled_language_is_learned_from_its_first_texts(docs):
    rng = random.Random(8)
    free = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [doc(free.pop(), prose(rng, 60), lang=f"few{k}") for k in range(12) for _ in range(2)]  # each far beyond the bytes
    rows += [doc(free.pop(), f"{x} word", lang="many") for x in WORDS for _ in range(20)] + [doc(free.pop(), "copy", lang="copies")] * 300
    frame = docs(rows)
    profiles = language_id.learn_profiles(frame, sample_texts=30, sample_bytes=200)
    assert profiles.languages == sorted({r[2] for r in rows})

    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - language_id.DRAW_BITS)
    by_draw = defaultdict(list)
    for r in sorted(frame.select("lang", draw.alias("draw"), "text").collect()):
        by_draw[r.lang].append(r)
    for texts, size in ((30, 200), (30, 10 ** 6), (7, 10 ** 6), (10 ** 4, 10 ** 6)):
        profiles = language_id.learn_profiles(frame, sample_texts=texts, sample_bytes=size)
        for lang, rs in by_draw.items():
            taken, n, held = Counter(), 0, 0
            for r in rs:
                if n >= texts or held >= size:
                    break
                same = [x for x in rs if x.draw == r.draw]
                if r is same[0]:
                    for x in same:
                        codes, counts = language_id.gram_counts(x.text)
                        taken.update(dict(zip(codes.tolist(), counts.tolist())))
                    n, held = n + len(same), held + sum(len(x.text) for x in same)
            known = profiles.codes[np.isfinite(profiles.ranks[:, profiles.languages.index(lang)])]
            best = sorted(taken, key=lambda c: (-taken[c], c))[:language_id.PROFILE]
            assert known.tolist() == sorted(best), (lang, texts, size)


def test_gram_counts_and_distance_against_python():
    def brute(text):
        grams, words = Counter(), "".join(c if c.isalpha() else " " for c in text.lower()).split()
        for w in words:
            grams.update(w)
        padded = " ".join(["", *words, ""])
        for n in (2, 3):
            for i in range(len(padded) - n + 1):
                g = padded[i:i + n]
                if " " not in g[1:-1] and g.strip():
                    grams[g] += 1
        return grams

    for text in ("a", "ab, ab!", "Größe été  Ωμ 1x", "one two\nthree"):
        codes, counts = language_id.gram_counts(text)
        assert sorted(counts.tolist()) == sorted(brute(text).values()), text
    codes, ranks = language_id.top_ranked(np.array([3, 5, 8, 9]), np.array([2, 7, 2, 1]), 3)
    assert codes.tolist() == [5, 3, 8] and ranks.tolist() == [0, 1.5, 1.5]
    profiles = language_id.Profiles({"a": (np.array([1, 2]), np.array([0.0, 1.0])), "b": (np.array([2, 3]), np.array([0.0, 1.0]))})
    assert profiles.predict("1 2") == ("und", 0.0)


# ---- quality ---------------------------------------------------------------

def test_quality_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = queries.op7_quality(spark, folder).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    assert right > max(0.9, sum(r.quality for r in rows) / len(rows))


def test_quality_of_odd_rows_and_gradients(spark, docs, odd_rows):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 1), (6, 0), (None, 1), (7, None), (9, 0)], "doc_id long, quality int")
    model = quality.train_quality(docs(odd_rows), labels)
    out = quality.score_quality(docs(odd_rows), model).collect()
    assert len(out) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert quality.score_quality(docs([]), quality.train_quality(docs([]), labels)).collect() == []
    bag = quality.passages(pa.array([prose(random.Random(1), 150), "", None, "!!! ??"]))
    assert np.diff(bag.begins).tolist() == [3, 1, 1, 1] and not bag.x[3].any() and np.isfinite(bag.x).all()
    assert bag.sizes.tolist() == [64, 64, 22, 0, 0, 2] and len(bag.buckets) == 152
    vectors = np.random.default_rng(2).normal(size=(quality.BUCKETS, 3))
    ends = np.cumsum(bag.sizes)
    for got, n, end in zip(quality.word_means(vectors, bag.buckets, bag.sizes, 2), bag.sizes, ends):
        assert got == pytest.approx(vectors[bag.buckets[end - n:end]].mean(axis=0) if n else np.zeros(3))
    label, small = np.array([1.0, 0.0, 1.0, 0.0]), 1e-6
    m = quality.AttentionModel(4, 3)
    loss = lambda: -np.mean([np.log(p if t else 1 - p) for p, t in zip(m._forward(bag)["y"], label)])
    made = m._gradients(bag, label, 0.0)
    for name, g in made.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        m.p[name][at] += small
        up = loss()
        m.p[name][at] -= 2 * small
        down = loss()
        m.p[name][at] += small
        assert g[at] == pytest.approx((up - down) / (2 * small), rel=1e-3), name


def test_quality_told_by_words_alone(spark, docs):
    """Both kinds of text have the same letters, lengths and marks; only the words differ."""
    rng = random.Random(8)
    words = ["stone", "river", "table", "light", "cloud", "paper"]
    rows, truth = [], {}
    for i in range(900):
        truth[i] = rng.randint(0, 1)
        rows.append(doc(i, " ".join(w if truth[i] else w[::-1] for w in (rng.choice(words) for _ in range(rng.randint(5, 200))))))
    labels = spark.createDataFrame(list(truth.items()), "doc_id long, quality int")
    out = [r for r in quality.score_quality(docs(rows), quality.train_quality(docs(rows), labels)).collect() if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in out) > 0.9 * len(out)
    few = quality.train_quality(docs(rows), labels, most_bytes=0)
    assert not few.p["E"].any()  # no document within the bound: untrained


# ---- licenses --------------------------------------------------------------

def test_licenses_against_brute_force(docs, odd_rows):
    cases = ["Licensed under CC BY-NC 4.0.", "cc  by cc by", "All Rights\nReserved. all rights, reserved", "general PUBLIC license general public licenses", "CCBY", "éall rights reserved",
             "Licensed under the Apache License, Version 2.0.", "Licensed under the well known Apache License, Version 2.0", "apache version 2", "Released under the MIT License.",
             "rights reserved all", "of the of the in the", "cc by " * 500]
    rows = odd_rows + [doc(100 + i, t) for i, t in enumerate(cases)] + [doc(100, cases[0])]
    spans, summary = license_scan.scan_licenses(docs(rows))
    got = defaultdict(list)
    for r in summary.collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    seen = Counter()
    for r in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        places = [(i, label) for phrase, label in license_scan.BASE for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in places]
        want = (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))
        own = [(x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) for x in got[r[0]]]
        assert want in own, r
        for x in got[r[0]]:
            assert set(filter(None, x.base_labels.split(","))) <= set(filter(None, x.labels.split(","))) and 0 <= x.score <= 1
        seen[r[0]] += 1
    labels = {i: got[100 + i][0].labels for i in range(len(cases))}
    assert labels[0] == "cc-by,cc-by-nc-4.0" and labels[6] == "apache-2.0" and labels[7] == "apache-2.0" and labels[9] == "mit"
    assert labels[8] == labels[10] == labels[11] == ""
    assert license_scan.scan_licenses(docs([]))[1].collect() == []


def _own_labels(text):
    """Labels and the best coverage by the definition: every diagonal with those in its template's reach."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    labels, best = set(), 0.0
    for phrase, label in license_scan.TEMPLATES:
        t = phrase.split()
        places = {i: (a, b) for i, (a, b) in enumerate(zip(t, t[1:])) if not (a in license_scan.COMMON and b in license_scan.COMMON)}
        votes = defaultdict(set)
        for pos, pair in enumerate(zip(w, w[1:])):
            for i, own in places.items():
                if own == pair:
                    votes[pos - i].add(i)
        reach = license_scan.GAP + len(t) // license_scan.DRIFT
        for d in votes:
            share = len(set().union(*(v for e, v in votes.items() if abs(e - d) <= reach))) / len(places)
            if share >= license_scan.COVERAGE:
                labels, best = labels | {label}, max(best, share)
    return labels, best


def test_own_labels_on_repeated_words_and_long_templates(docs, monkeypatch):
    rng = random.Random(6)
    mit = dict((label, phrase) for phrase, label in license_scan.TEMPLATES)["mit-text"].split()
    long = [rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(1600)]
    monkeypatch.setattr(license_scan, "TEMPLATES", (*license_scan.TEMPLATES, (" ".join(long), "long")))

    def worn(words, every):
        out = []
        for i, x in enumerate(words):
            out += [] if i % every == 3 else [x, "added"] if i % every == 7 else [x]
        return " ".join(out)

    texts = ["released under the mit license" + " mit license" * k for k in (0, 1, 4, 400)]
    texts += ["mit license " * 40 + "released under the mit license", "the mit license " * 300, "License: " + " ".join(mit).upper(), worn(mit, 15), worn(mit, 4), " ".join(mit[:100]),
              " ".join(mit) * 3, " ".join(long), worn(long, 30), " ".join(long[:1100]), " ".join(long[:1300]) + " " + " ".join(long)]
    for _ in range(40):  # words of templates at random, many repeats
        source = rng.choice(license_scan.TEMPLATES[:8])[0].split()
        texts.append(" ".join(x for _ in range(rng.randint(1, 5)) for x in source[rng.randint(0, 2):len(source) - rng.randint(0, 3)] * rng.randint(1, 2) if rng.random() > 0.1))
    spans, summary = license_scan.scan_licenses(docs([doc(i, t) for i, t in enumerate(texts)]), templates=license_scan.TEMPLATES)
    got = {r.doc_id: r for r in summary.collect()}
    base = {label for _, label in license_scan.BASE}
    for i, text in enumerate(texts):
        labels, best = _own_labels(text)
        assert set(filter(None, got[i].labels.split(","))) - base == labels - base, text[:80]
        assert got[i].n_base or got[i].score == pytest.approx(best), text[:80]
    assert "mit" in got[0].labels and all(got[i].labels == got[0].labels for i in (1, 2, 3, 4)) and got[6].labels == "mit,mit-text" == got[7].labels
    assert "long" in got[11].labels and "long" in got[12].labels and got[13].labels == "" and "long" in got[14].labels
    for r in spans.filter("not base").collect():
        assert 0 < r.last_word - r.first_word < 1.5 * 1600 + 200


# ---- nearest neighbours ----------------------------------------------------

def _truth(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault((i, tuple(v)), np.array(v, dtype=np.float32).astype(np.float64))
    out = {}
    for (i, t), q in good.items():
        if i % 20 == 0:
            out[(i, t)] = sorted((-(x * q).sum(), j) for (j, _), x in good.items() if j != i)[:k]
    return out


def test_neighbours_against_brute_force(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(20, 8))
    rows = [(i, [float(x) for x in (centres[i % 20] + 0.3 * draw.normal(size=8)).astype(np.float32)]) for i in range(1200)]
    rows += [(2000 + i, [1.0] * 8) for i in range(100)] + [(3000, None), (3020, []), (3040, [0.0] * 8), (3060, [float("nan")] * 8), (3080, [1.0, None] * 4),
                                                           (3100, [float("inf")] + [1.0] * 7), (3120, [1.0] * 3), (None, [2.0] * 8), (20, rows[20][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit("x"), "rank": F.lit("y"), "leaf": F.lit(1)})
    got = defaultdict(list)
    for r in ann.nearest(frame, F.col("vec_id") % 20 == 0, k=10).collect():
        got[r.query_id].append(r)
    truth, found, total = _truth(rows, 10), 0, 0
    assert set(got) == {i for i, _ in truth}
    for (i, _), want in truth.items():
        own = sorted(got[i], key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11)) and i not in {r.vec_id for r in own}
        assert all((-a.score, a.vec_id) < (-b.score, b.vec_id) for a, b in zip(own, own[1:]))
        found += len({j for _, j in want} & {r.vec_id for r in own})
        total += 10
    assert found / total >= 0.9


def test_neighbours_of_few_and_of_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(few, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert ann.nearest(few.limit(0), F.lit(True)).collect() == []
    assert ann.nearest(few, F.lit(False)).collect() == []


def test_best_rows_breaks_ties_by_identifier():
    x = np.array([[1.0, 0], [0, 1], [1, 0], [2, 0]])
    at, score = ann.best_rows(x, np.array([9, 1, 3, 7]), np.array([1.0, 0]), 2)
    assert at.tolist() == [3, 2] and score.tolist() == [2.0, 1.0]
    assert ann.best_rows(x, np.array([9, 1, 3, 7]), np.array([1.0, 0]), 3, floor=1.5)[0].tolist() == [3]


# ---- queries and pipeline --------------------------------------------------

@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    cursor = con.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    df = contract.queries()[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(columns)
    assert Counter(tuple(r) for r in df.select(*columns).collect()) == Counter(cursor.fetchall())


def test_every_stage_does_its_part(spark, tmp_path):
    """The stages one by one over the small table, each held against what it promises."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    extra = spark.createDataFrame([(10 ** 6, None, "en", "src0", 0), (10 ** 6 + 1, "123 456", "en", "src0", 7)], docs.schema)
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard", "mixing", "packing"]

    def step(name, df):
        out = stage[name](spark, df, FOLDER)
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    one = step("language_id", docs.unionByName(extra))
    assert one.columns == columns and sorted(r.doc_id for r in one.collect()) == sorted(r.doc_id for r in docs.collect())
    two = step("exact_dedup", one)
    last = {}
    for r in one.collect():
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert two.columns == columns and sorted(r.doc_id for r in two.collect()) == sorted(last.values())
    three = step("ngram_jaccard", two)
    left = {r.doc_id: r.text for r in three.collect()}
    from test_documents import _brute_links

    rows = [(r.doc_id, r.text) for r in two.collect()]
    _, roots = _brute_links(rows)
    first = {}
    for (i, _), root in zip(rows, roots):
        first[root] = min(first.get(root, i), i)
    assert three.columns == columns and sorted(left) == sorted(first.values())
    four = step("mixing", three)
    assert four.columns == columns and max(Counter(r.doc_id for r in four.collect()).values()) <= 3
    five = step("packing", four)
    repeats = Counter(r.doc_id for r in four.collect())
    tokens = {r.doc_id: r.doc_tokens for r in five.collect()}
    assert five.agg(F.sum("length")).first()[0] == sum(tokens[i] * n for i, n in repeats.items())
    whole = corpus_pipeline.run(spark, FOLDER)
    assert whole.columns == five.columns and whole.count() > 0
