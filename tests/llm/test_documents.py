"""Sharding, exact dedup, near dedup, mixing and packing against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from hangarlog.llm import components, exact_dedup, jaccard_join, mixing, packing, sharding, textbytes
from hangarlog.llm.queries import tokenizer_path
from llm_helpers import DOCS, doc, prose


# ---- sharding --------------------------------------------------------------

def test_shards_are_contiguous_balanced_and_gapless(docs, odd_rows):
    rng = random.Random(1)
    rows = odd_rows + [doc(i, prose(rng, rng.randint(0, 200))) for i in range(100, 700)]
    got = sharding.shard_documents(docs(rows), 12).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
    total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    for shard, own in by.items():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 12) <= most
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    ids = [-1 if r.doc_id is None else r.doc_id for r in order]
    assert ids == sorted(ids)


def test_sharding_of_nothing_and_of_little(docs):
    assert sharding.shard_documents(docs([]), 3).collect() == []
    got = sharding.shard_documents(docs([doc(1, "a"), doc(2, "b")]), 40).collect()
    assert len({r.shard for r in got}) == 2 and all(r.slot == 0 for r in got)
    with pytest.raises(ValueError, match="clash"):
        sharding.shard_documents(docs([]), 3, carry=["doc_id", "size"])


def test_written_shards_hold_whole_documents(spark, docs, tmp_path):
    rows = docs([doc(i, f"text {i}") for i in range(50)]).select("doc_id", "text", "source")
    sharding.write_shards(rows, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == [(i, f"text {i}") for i in range(50)]
    assert back.select("shard").distinct().count() == 5


# ---- exact dedup -----------------------------------------------------------

@pytest.mark.parametrize("nodes", [1, 16, 40])
def test_copies_against_brute_force(docs, odd_rows, nodes):
    rng = random.Random(4)
    texts = [prose(rng, 5) for _ in range(30)]
    rows = odd_rows + [doc(i, rng.choice(texts)) for i in range(100, 400)] + [doc(i, "the hot one") for i in range(1000, 1300)]
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    got = exact_dedup.find_copies(docs(rows).repartition(5), nodes=nodes).collect()
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).digest(): t for t in groups}
    kept = Counter()
    for r in got:
        own = groups[by_sha[bytes(r.sha)]]
        assert r.group_size == len(own)
        assert r.keep_id == max((i for i in own if i is not None), default=None)
        assert not r.kept or r.id == r.keep_id
        kept[by_sha[bytes(r.sha)]] += r.kept
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_dropping_copies_keeps_one_whole_row_each(docs, odd_rows):
    left = exact_dedup.drop_copies(docs(odd_rows))
    assert left.columns == docs([]).columns
    got = sorted((str(r.doc_id), r.text or "") for r in left.collect())
    want = {}
    for r in odd_rows:
        t = r[1] or ""
        want[t] = max(want.get(t, (False, 0)), (r[0] is not None, r[0] or 0))
    assert got == sorted((str(i) if there else "None", t) for t, (there, i) in want.items())
    assert exact_dedup.drop_copies(docs([])).collect() == []


# ---- n-gram Jaccard join ---------------------------------------------------

def _shingles(text, n=5):
    w = [x for x in (text or "").split() if x]
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def _brute_links(rows, threshold=0.8):
    sets = [_shingles(r[1]) for r in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            same = sets[a] == sets[b]
            if same or sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 10 * threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    return links, [find(a) for a in range(len(rows))]


def _near(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
    return " ".join(w)


@pytest.mark.parametrize("block", [256, 8])
def test_near_links_against_brute_force(docs, odd_rows, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(6)
    rows = [r for r in odd_rows if r[0] not in (5, 6)]
    for k in range(12):
        base = prose(rng, rng.choice([6, 40, 120, 400]))
        rows += [doc(1000 * (k + 1) + i, _near(rng, base, rng.randint(0, 3))) for i in range(rng.randint(1, 40))]
    links, roots = _brute_links(rows)
    got = jaccard_join.near_classes(docs(rows).repartition(4)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    members = defaultdict(list)
    for x, r in enumerate(rows):
        members[roots[x]].append(r[0])
    want = Counter((r[0], links[x], min((i for i in members[roots[x]] if i is not None), default=None)) for x, r in enumerate(rows))
    assert Counter((r.doc_id, r.n_links, r.class_id) for r in got) == want


def test_one_of_each_near_group_stays(docs, odd_rows):
    left = jaccard_join.keep_one(docs(odd_rows))
    assert left.columns == docs([]).columns
    rows = odd_rows
    _, roots = _brute_links(rows)
    assert left.count() == len(set(roots))
    assert jaccard_join.keep_one(docs([])).collect() == []


def test_pruning_table_and_overlaps():
    table = jaccard_join.least_matches(0.8, 1e-7)
    assert [n for n, _ in table] == [16, 32, 48, 64, 80, 96]
    for n, m in table:  # a pair at the threshold falls below it about as rarely as the tolerance says
        draws = np.random.default_rng(1).binomial(n, 0.8, 200_000)
        assert (draws < m).mean() < 1e-4 and m >= 0
    assert table[-1][1] > 48
    rng = random.Random(8)
    sets = [np.array(sorted(rng.sample(range(300), rng.randint(1, 150))), dtype=np.uint64) for _ in range(20)]
    a, b = np.triu_indices(20, 1)
    want = [len(set(sets[x].tolist()) & set(sets[y].tolist())) for x, y in zip(a, b)]
    assert jaccard_join.overlaps(sets, a, b).tolist() == want
    assert jaccard_join.overlaps(sets, a[:3], b[:3]).tolist() == want[:3]


def test_shingle_sets_against_python():
    rng = random.Random(9)
    texts = [prose(rng, n) for n in (0, 1, 4, 5, 6, 50)] + [None, "  a  b\tc\nd e f ", "é ü ñ ß ö ä"]
    sets, begins = textbytes.shingle_sets(pa.array(texts, pa.string()), 5)
    sizes = np.diff(begins).tolist()
    assert sizes == [len(_shingles(t)) for t in texts]
    again, _ = textbytes.shingle_sets(pa.array(["x y"] + texts, pa.string()), 5)
    assert set(sets.tolist()) <= set(again.tolist())


def test_components(spark):
    rng = random.Random(10)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7)]
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_of_very_many_links(spark):
    edges = spark.range(200_000).selectExpr("3 * id AS a", "3 * id + 1 + id % 2 AS b")
    found = components.connected_components(edges).selectExpr("count(*) AS n", "count(DISTINCT node) AS nodes", "count_if(root = node - node % 3) AS right").first()
    assert (found.n, found.nodes, found.right) == (400_000, 400_000, 400_000)


# ---- mixing ----------------------------------------------------------------

def test_targets_share_the_excess_by_weight():
    assert mixing.share_targets([10, 10], [1, 1], 20, 3) == [10.0, 10.0]
    assert mixing.share_targets([1, 100, 100], [1, 2, 3], 201, 3) == [3.0, pytest.approx(79.2), pytest.approx(118.8)]
    assert mixing.share_targets([], [], 0, 3) == []
    assert sum(mixing.share_targets([5, 7, 0, 90], [3, 3, 3, 1], 102, 3)) == pytest.approx(102)


def test_mix_comes_near_its_targets_and_repeats(docs, odd_rows, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 100)  # many buckets, so that residuals meet in a tree
    rng = random.Random(11)
    rows = odd_rows + [doc(i, prose(rng, rng.randint(1, 60)), source=rng.choice("abbbbbbbbbbbccde")) for i in range(100, 3000)]
    frame = docs(rows)
    got = mixing.copy_counts(frame).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], len((r[1] or "").split())) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, mixing.share_targets([sizes[s] for s in order], [(1, 2, 3)[i % 3] for i in range(len(order))], sum(sizes.values()), 3)))
    taken, largest = Counter(), Counter()
    for r in got:
        assert 0 <= r.copies <= 3 and r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        taken[r.source] += r.copies * r["size"]
        largest[r.source] = max(largest[r.source], r["size"])
    for s in order:
        assert abs(taken[s] - targets[s]) <= largest[s] / 2 + 1e-6
    again = mixing.copy_counts(frame.repartition(7)).collect()
    assert Counter((r.k1, r.k2, r.copies) for r in again) == Counter((r.k1, r.k2, r.copies) for r in got)


def test_mixed_rows_are_whole_and_repeated(docs, odd_rows):
    frame = docs(odd_rows)
    counts = Counter()
    for r in mixing.copy_counts(frame).collect():
        counts[(r.doc_id, r["size"])] += r.copies
    mixed = mixing.mix_sources(frame)
    assert mixed.columns == frame.columns
    assert Counter((r.doc_id, len((r.text or "").split())) for r in mixed.collect()) == +counts
    assert mixing.mix_sources(docs([])).collect() == [] and mixing.copy_counts(docs([])).collect() == []


def test_pivoting_keeps_the_expectation(spark):
    rows = [doc(i, "w " * (1 + i % 7), source="a" if i % 2 else "b") for i in range(40)]
    frame = spark.createDataFrame(rows, DOCS)
    chosen = np.zeros(40)
    for seed in range(30):
        for r in mixing.copy_counts(frame, seed=seed).filter("source = 'a'").collect():
            chosen[r.doc_id] += r.copies
    mean = chosen[1::2].mean() / 30
    size, other = sum(1 + i % 7 for i in range(1, 40, 2)), sum(1 + i % 7 for i in range(0, 40, 2))
    assert mean == pytest.approx((size + other) / 3 / size, abs=0.12)


# ---- packing ---------------------------------------------------------------

def test_piece_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    plain, fast = Tokenizer.from_file(tokenizer_path()), packing.PieceEncoder(tokenizer_path())
    rng = random.Random(12)
    parts = ["a", "B", " ", "  ", "\n", "\n\n", "\t", "é", " ", "　", "'s", "’", "1", "2.", "...", "€", "<|endoftext|>", "word", "ß", "日本", "!", "\r\n", "😀", "\x00", "n't", "-", "|"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + ["", None, "x" * 5000]
    ids, bounds = fast.encode(pa.array(texts, pa.string()))
    for text, low, high in zip(texts, bounds, bounds[1:]):
        assert ids[low:high].tolist() == plain.encode(text or "", add_special_tokens=False).ids, text


def test_packed_ids_round_trip(docs, odd_rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(13)
    rows = [r for r in odd_rows if r[0] not in (None, 7, 9)] + [doc(i, prose(rng, rng.randint(0, 900))) for i in range(100, 220)]
    window = 256
    got = packing.pack_documents(docs(rows).repartition(3), tokenizer_path(), window).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
    for r in rows:
        whole = [x for p in sorted(pieces[r[0]], key=lambda p: p.start) for x in p.ids]
        assert whole == plain.encode(r[1] or "", add_special_tokens=False).ids + [1]
        assert all(p.doc_tokens == len(whole) for p in pieces[r[0]])
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist()
        assert sum(p.length for p in own) <= window
    short = sum(sum(p.length for p in own) < window for own in sequences.values())
    assert short <= 3  # one for each task
    assert packing.pack_documents(docs([]), tokenizer_path(), window).collect() == []


def test_level_choice_minimises_the_sum_of_squares():
    rng = random.Random(14)
    packer = packing.Packer(32, most_open=10_000)
    out = 0
    for i in range(2000):
        size = rng.randint(1, 31)
        counts = packer.counts.copy()

        def squares(level):
            after = counts.copy()
            if level:
                after[level] -= 1
            if level + size < 32:
                after[level + size] += 1
            return int((after[1:32] ** 2).sum())

        allowed = [0] + [h for h in range(1, 33 - size) if counts[h] > 0]
        assert squares(packer.best_level(size)) == min(squares(h) for h in allowed)
        out += sum(1 for _ in packer.add(i, np.zeros(size, dtype=np.uint32)))
        assert packer.opened == packer.counts.sum() == sum(len(x) for x in packer.open)
    assert out > 0


def _squares(counts, window):
    return int((counts[1:window] ** 2).sum())


def test_open_windows_stay_bounded():
    """At the bound nothing is opened: a piece that fits in no window fills the most frequent level."""
    packer = packing.Packer(100, most_open=20)
    windows = []
    for i in range(300):
        before = packer.counts.copy()
        full = packer.opened == 20 and not before[1:41 - i % 2].any()
        made = list(packer.add(i, np.full(60 + i % 2, i, dtype=np.uint32)))
        if full:
            assert len(made[0][-1][2]) == 100 - int(np.flatnonzero(before == before.max())[-1])
        windows += made
        assert packer.opened <= 20
    windows += list(packer.close())
    assert sum(len(p[2]) for w in windows for p in w) == 150 * (60 + 61)
    assert sum(sum(len(p[2]) for p in w) < 100 for w in windows) <= 1


@pytest.mark.parametrize("sizes", [(1,), (60,), (99, 100, 101), tuple(range(1, 140)), (3, 97, 250)])
def test_closing_places_by_the_rule_and_keeps_every_id(sizes):
    packer = packing.Packer(100)
    rng = random.Random(str(sizes))
    docs = [np.arange(rng.choice(sizes), dtype=np.uint32) for _ in range(150)]
    windows = [w for i, ids in enumerate(docs) for w in packer.add(i, ids)]
    assert all(len(p[2]) == min(100, len(docs[p[0]]) - p[1]) for w in windows for p in w)  # nothing is cut before the end
    place = packer.place

    def watched(piece):
        before, opened = packer.counts.copy(), packer.opened
        level = packer.best_level(len(piece[2]))
        fitting = [h for h in range(1, 101 - len(piece[2])) if before[h]]
        if fitting:
            def after(h):
                counts = before.copy()
                counts[h] -= 1
                counts[h + len(piece[2])] += 1
                return _squares(counts, 100)
            assert after(level) == min(map(after, fitting))
        assert level or not opened
        return place(piece)

    packer.place = watched
    windows += list(packer.close())
    got = defaultdict(list)
    for w in windows:
        for doc_id, start, ids, total in w:
            assert total == len(docs[doc_id])
            got[doc_id].append((start, ids))
    for i, ids in enumerate(docs):
        assert np.concatenate([x for _, x in sorted(got[i], key=lambda p: p[0])]).tolist() == ids.tolist()
    assert sum(sum(len(p[2]) for p in w) < 100 for w in windows) <= 1
