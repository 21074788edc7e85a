from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from record_helpers import row, table
from pyspark.sql import functions as F

from hangarlog.operators import classify, evaluate, split
from hangarlog.plans import scoring


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    rows = [(f"r{i}", rng.choice("aaaaaaabbcd"), f"text {i}") for i in range(500)] + [("x1", "solo", "t")]
    return spark.createDataFrame(rows, "id string, label string, text string")


def test_split_is_exact_disjoint_and_repeatable(labelled):
    done = split.split(labelled, "label", "id")
    rows = done.collect()
    assert sorted(r.id for r in rows) == sorted(r.id for r in labelled.collect())
    for label, n in Counter(r.label for r in rows).items():
        assert sum(r.label == label and r.split == "train" for r in rows) == math.ceil(0.8 * n)
    parts = Counter(r.split for r in rows)
    assert 0 <= parts["test"] - parts["val"] <= 1
    assert {r.id: r.split for r in split.split(labelled.repartition(7), "label", "id").collect()} == {r.id: r.split for r in rows}


def test_label_map_leaves_out_test_only_labels(spark):
    df = spark.createDataFrame([("b", "train"), ("a", "val"), ("z", "test")], "label string, split string")
    assert table(split.label_map(df, "label")) == [("a", 0), ("b", 1)]


def test_rare_filter_and_weights(spark, labelled):
    frequent = split.rare_filter(labelled, "label", 5)
    assert "solo" not in {r.label for r in frequent.select("label").distinct().collect()}
    ids = split.dense_ids(spark.createDataFrame([("a",), ("b",), ("unseen",)], "label string"), "label")
    rows = spark.createDataFrame([("a",)] * 4 + [("b",)], "label string")
    got = {r.label: r.weight for r in split.class_weights(rows, ids, "label").collect()}
    mean = (0.25 + 1 + 1) / 3
    assert got == {"a": pytest.approx(0.25 / mean), "b": pytest.approx(1 / mean), "unseen": pytest.approx(1 / mean)}


def test_seeded_sample_sizes(labelled):
    assert split.seeded_sample(labelled, 40, "id").count() == 40
    assert split.seeded_sample(labelled, 10_000, "id").count() == 501
    per = Counter(r.label for r in split.seeded_sample(labelled, 7, "id", by=["label"]).collect())
    assert per["a"] == 7 and per["solo"] == 1


def test_exclude_seen(spark, labelled):
    seen = labelled.where("label = 'a'").select("text")
    assert split.exclude_seen(labelled, seen).where("label = 'a'").count() == 0


PREDICTED = [
    ("1", "11AAA", "11AAA", 95.0), ("2", "11AAA", "11AAB", 92.0), ("3", "11AAB", "11AAA", 91.0),
    ("4", "11AAA", "11ZAA", 40.0), ("5", "12BBB", "99BBB", 10.0), ("6", "12BBB", "12BBB", 75.0), ("7", None, "12BBB", 75.0),
]


@pytest.fixture
def predicted(spark):
    return spark.createDataFrame(PREDICTED, "record_id string, truth string, pred_1 string, confidence_1 double")


def test_agreement_and_character(predicted):
    got = evaluate.agreement(predicted).first()
    assert (got.n, got.exact, got.same_subsystem, got.same_system) == (6, 2 / 6, 4 / 6, 5 / 6)
    kinds = {r.kind: r.n for r in evaluate.error_character(predicted).collect()}
    assert kinds == {"near_miss": 2, "same_system": 1, "different_system": 1}


def test_reverse_pairs_are_symmetric(predicted):
    got = {(r.truth, r.predicted): (r.n, r.reverse_n, r.bidirectional) for r in evaluate.confusion_pairs(predicted).collect()}
    assert got[("11AAA", "11AAB")] == (1, 1, True) == got[("11AAB", "11AAA")]
    assert got[("12BBB", "99BBB")] == (1, 0, False) and len(got) == 4


def test_macro_f1_over_the_union_of_labels(predicted):
    rows = [(t, p) for _, t, p, _ in PREDICTED if t]
    labels = {x for r in rows for x in r}
    f1 = []
    for label in labels:
        tp = sum(t == p == label for t, p in rows)
        f1.append(2 * tp / (sum(t == label for t, _ in rows) + sum(p == label for _, p in rows)))
    got = evaluate.macro_f1(predicted).first()
    assert got.macro_f1 == pytest.approx(sum(f1) / len(f1)) and got.accuracy == pytest.approx(2 / 6)


def test_coverage_calibration_and_sheet(spark, predicted):
    space = spark.createDataFrame([("11AAA",), ("12BBB",)], "code string")
    got = evaluate.coverage(predicted, space).first()
    assert (got.n, got.answerable, got.top1_answerable) == (6, 5, 2 / 5)
    bands = {r.band: (r.n, r.top1) for r in evaluate.calibration(predicted, space).collect()}
    assert bands == {"high (>=70%)": (3, 2 / 3), "mid (30-70%)": (1, 0.0), "low (<30%)": (1, 0.0)}
    sheet = evaluate.adjudication(predicted).collect()
    assert [r.record_id for r in sheet] == ["2", "3"] and sheet[0].which_is_correct == ""


def test_compare_models(predicted):
    new = predicted.withColumn("pred_1", F.coalesce("truth", "pred_1"))
    got = evaluate.compare_predictions(predicted, new).first()
    assert (got.n, got.disagreements, got.old_right, got.new_right, got.both_wrong) == (7, 4, 0, 4, 0)


def test_train_predict_and_worksheet(spark, frame):
    words = {"11AAA": "HYDRAULIC PUMP LEAKING", "12BBB": "RADIO STATIC NOISE", "13CCC": "TIRE WORN CORD"}
    codes = list(words)
    recs = frame([row(i, code=codes[i % 3], text=f"{words[codes[i % 3]]} NUMBER {i}", fix=f"FIXED {i}") for i in range(90)])
    ready = scoring.prepare_training(recs)
    model = classify.train_classifier(ready.where("split = 'train'"), "code")
    dictionary = spark.createDataFrame([("11AAA", "Pump")], "code string, description string")
    seen = ready.where("split = 'train'").select("text")
    out = scoring.batch_predict(recs, model, dictionary, seen)
    assert out.count() == 90 - 72
    got = evaluate.accuracy(out).first()
    assert got.top1 == 1.0 and got.topk == 1.0
    one = out.where("pred_1 = '13CCC'").first()
    assert one.pred_definition_1 == "(no dictionary entry for 13CCC)" and one.pred_system_1 == "LANDING GEAR - Continued"
    assert 0 <= one.confidence_2 <= one.confidence_1 <= 100
    sheet = scoring.labeling_worksheet(out, 2)
    assert {"true_code", "notes"} <= set(sheet.columns) and sheet.count() >= 2
    ready_made = recs.withColumn("body", F.col("discrepancy"))
    same = scoring.batch_predict(ready_made, model, dictionary, text_column="body", sample=10)
    assert same.count() == 10 and same.where("pred_1 <> truth").count() == 0


def test_naive_bayes_matches_its_definition(spark):
    long_text = " ".join(["pump"] * 300 + ["seal"] * 5)
    rows = [("a", long_text), ("a", "valve"), ("b", "seal seal valve"), ("b", "radio"), (None, "ignored")]
    df = spark.createDataFrame(rows, "label string, text string")
    model = classify.train_classifier(df, "label", smoothing=0.5)
    asked = ["seal valve", "pump radio", "unheard of", None, ""]
    got = {r.text: r.preds for r in classify.predict_topk(model, spark.createDataFrame([(t,) for t in asked], "text string"), 2).collect()}
    counts = {c: Counter(w for l, t in rows if l == c for w in t.split()) for c in "ab"}
    size = len(set(counts["a"]) | set(counts["b"]))
    for text in asked[:2]:
        words = text.split()
        score = {c: sum(math.log((counts[c][w] + 0.5) / (sum(counts[c].values()) + 0.5 * size)) for w in words) for c in "ab"}
        total = sum(math.exp(s) for s in score.values())
        best = sorted(score, key=lambda c: -score[c])
        assert [p.code for p in got[text]] == best
        assert [p.confidence for p in got[text]] == [pytest.approx(100 * math.exp(score[c]) / total) for c in best]
    for text in ("unheard of", ""):  # the priors decide, ties go to the smaller label
        assert [(p.code, p.confidence) for p in got[text]] == [("a", pytest.approx(50.0)), ("b", pytest.approx(50.0))]
    assert got[None] is None


@pytest.mark.parametrize("weighted", [True, False])
def test_topk_ranks_all_labels(spark, weighted):
    """A label that holds a token once among very many loses to labels that never hold it."""
    rows = [("hot", " ".join(["pump"] * 3000 + ["seal"])), ("b", "radio"), ("c", "valve valve"), ("d", "wing"), ("e", "tyre tyre radio")]
    rows += [("hot", "pump pump")] * 2 + [(None, "ignored")]
    df = spark.createDataFrame(rows, "label string, text string")
    model = classify.train_classifier(df, "label", weighted=weighted)
    asked = ["seal", "seal seal radio", "pump", "never heard of", "", "  ", " ".join(["radio"] * 900), None]
    counts = {c: Counter(w for l, t in rows if l == c for w in t.split()) for c in ("hot", "b", "c", "d", "e")}
    size = len(set().union(*counts.values()))
    prior = {c: 1 / len(counts) if weighted else sum(l == c for l, _ in rows) / 7 for c in counts}
    for k in (1, 3, 9):
        out = classify.predict_topk(model, spark.createDataFrame([(t,) for t in asked], "text string"), k)
        got = {r.text: r.preds for r in out.collect()}
        assert got[None] is None
        for text in asked[:-1]:
            words = [w for w in text.split() if any(w in n for n in counts.values())]
            score = {c: round(math.log(prior[c]) + sum(math.log((n[w] + 1) / (sum(n.values()) + size)) for w in words), 8) for c, n in counts.items()}
            shares = {c: math.exp(s - max(score.values())) for c, s in score.items()}
            best = sorted(score, key=lambda c: (-score[c], c))[:k]
            assert [p.code for p in got[text]] == best, text
            assert [p.confidence for p in got[text]] == [pytest.approx(100 * shares[c] / sum(shares.values()), rel=1e-6) for c in best]
    assert [p.code for p in got["seal"]][-1] == "hot"


def test_settings_are_scored_together_as_one_by_one(spark):
    rng = random.Random(3)
    words = ["pump", "leak", "seal", "radio", "static", "tyre", "worn", "wing", "crack"]
    rows = [(rng.choice(["11AAA", "11AAB", "12CCC", "22DDD"]), i) for i in range(160)]
    rows = [(c, " ".join(rng.choice(words[hash_of(c):hash_of(c) + 5]) for _ in range(rng.randint(0, 5)))) for c, i in rows] + [(None, "pump"), ("11AAA", None), ("11AAA", "unheard")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "label string, text string, id long")
    train, val = df.where("id % 3 <> 0"), df.where("id % 3 = 0 OR text IS NULL")
    settings = [{"smoothing": 0.1}, {"smoothing": 2.0, "weighted": False}, {"level": "system"}, {"smoothing": 1.0}, {"level": "system", "smoothing": 0.3, "weighted": False}]
    together = classify.setting_predictions(train, val, "label", settings).collect()
    for i, setting in enumerate(settings):
        model = classify.train_classifier(train, "label", **setting)
        truth = classify.LEVELS[setting.get("level", "code")]("label")
        alone = classify.predict_topk(model, val, 1).select(truth.alias("truth"), F.get("preds", F.lit(0))["code"].alias("pred_1"))
        assert sorted(map(str, ((r.truth, r.pred_1) for r in together if r.setting == i))) == sorted(map(str, ((r.truth, r.pred_1) for r in alone.collect())))
        settings[i] = (setting, evaluate.macro_f1(alone).first().macro_f1)
    model, tried = classify.best_by_macro_f1(train, val, "label", [s for s, _ in settings])
    assert [t[0] for t in tried] == [s for s, _ in settings] and [t[1] for t in tried] == [pytest.approx(f) for _, f in settings]
    assert model.labels.count() in (4, 3)


def hash_of(code):
    return ["11AAA", "11AAB", "12CCC", "22DDD"].index(code)


def test_continued_training_equals_training_on_all(spark):
    a = spark.createDataFrame([("x", "one two"), ("y", "two three")], "label string, text string")
    b = spark.createDataFrame([("x", "three three"), ("z", "four")], "label string, text string")
    counts = classify.add_counts(classify.token_counts(a, "label"), classify.token_counts(b, "label"), "label")
    rows = a.unionByName(b)
    continued = classify.fit_counts(counts, classify.label_counts(rows, "label"), "label")
    whole = classify.train_classifier(rows, "label")
    asked = spark.createDataFrame([("three",), ("two four",)], "text string")
    assert table(classify.predict_topk(continued, asked)) == table(classify.predict_topk(whole, asked))


def test_token_counts_add_up(frame):
    df = frame([row(i, code=f"11AA{i % 2}", text=f"PUMP LEAK {i % 3}") for i in range(20)])
    whole = table(classify.token_counts(df, "code", "discrepancy"))
    a, b = df.where("record_id < 'r15'"), df.where("record_id >= 'r15'")
    parts = classify.add_counts(*[classify.token_counts(x, "code", "discrepancy") for x in (a, b)], "code")
    assert table(parts) == whole


def test_split_reads_what_is_behind_it_once(spark, tmp_path):
    spark.createDataFrame([(i, f"c{i % 3}") for i in range(60)], "id long, label string").write.parquet(str(tmp_path / "r"))
    found = split.split(spark.read.parquet(str(tmp_path / "r")), "label", "id")
    assert not [f for f in found.inputFiles() if str(tmp_path) in f]
    assert {r.split: r["count"] for r in found.groupBy("split").count().collect()} == {"train": 48, "val": 6, "test": 6}
