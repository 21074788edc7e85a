"""The store of counts: replay, broken jobs, compaction, and the model it gives."""

from __future__ import annotations

import shutil

import pytest

from hangarlog.operators import classify, count_store
from record_helpers import table

SCHEMA = "label string, text string, n long"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)


PARTS = {"first": [("a", "pump leak"), ("b", "radio static static"), (None, "ignored")], "second": [("a", "pump seal"), ("c", "tyre worn"), ("c", None)],
         "third": [("b", "radio dead")], "none": []}


def counts(spark, path):
    return [table(part) for part in count_store.read_counts(spark, path)]


def whole(spark, names):
    df = rows_of(spark, [r for n in names for r in PARTS[n]])
    return [table(classify.token_counts(df, "label"), "label", "token", "n"), table(classify.label_counts(df, "label"), "label", "rows")]


def test_replay_and_compaction_change_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    assert count_store.batches(spark, path) == [] and counts(spark, path) == [[], []] and count_store.compact(spark, path) == 0
    for name in ("first", "second", "none"):
        assert count_store.append_batch(rows_of(spark, PARTS[name]), path, name, "label")
    assert counts(spark, path) == whole(spark, ["first", "second"])
    assert not count_store.append_batch(rows_of(spark, PARTS["third"]), path, "second", "label")  # a known name
    assert counts(spark, path) == whole(spark, ["first", "second"])
    assert count_store.compact(spark, path) == 1 == count_store.compact(spark, path)
    assert counts(spark, path) == whole(spark, ["first", "second"])
    assert not count_store.append_batch(rows_of(spark, PARTS["first"]), path, "first", "label")  # taken by the base
    count_store.vacuum(spark, path)
    assert not count_store.append_batch(rows_of(spark, PARTS["first"]), path, "first", "label")
    assert count_store.append_batch(rows_of(spark, PARTS["third"]), path, "third", "label")
    assert counts(spark, path) == whole(spark, ["first", "second", "third"]) and count_store.batches(spark, path) == ["first", "none", "second", "third"]
    assert count_store.compact(spark, path) == 2
    count_store.vacuum(spark, path)
    assert counts(spark, path) == whole(spark, ["first", "second", "third"])
    with pytest.raises(ValueError, match="named"):
        count_store.append_batch(rows_of(spark, []), path, "../x", "label")


def test_jobs_that_broke_off_leave_nothing_to_read(spark, tmp_path):
    path = str(tmp_path / "store")
    count_store.append_batch(rows_of(spark, PARTS["first"]), path, "first", "label")
    count_store.append_batch(rows_of(spark, PARTS["second"]), path, "second", "label")
    shutil.rmtree(tmp_path / "store/batches/second/labels")  # tokens written, labels not
    assert count_store.batches(spark, path) == ["first"] and counts(spark, path) == whole(spark, ["first"])
    assert count_store.append_batch(rows_of(spark, PARTS["second"]), path, "second", "label")
    count_store.compact(spark, path)
    shutil.rmtree(tmp_path / "store/bases/1/taken")  # sums written, names not
    assert counts(spark, path) == whole(spark, ["first", "second"]) and count_store.compact(spark, path) == 1
    assert counts(spark, path) == whole(spark, ["first", "second"])


def test_the_stored_model_predicts_as_one_fitted_on_all_rows(spark, tmp_path):
    path = str(tmp_path / "store")
    for name in ("first", "second", "third"):
        count_store.append_batch(rows_of(spark, PARTS[name]), path, name, "label")
    every = rows_of(spark, [r for n in ("first", "second", "third") for r in PARTS[n]])
    asked = spark.createDataFrame([("radio pump",), ("worn",), ("new",)], "text string")
    for weighted in (True, False):
        stored = classify.predict_topk(count_store.stored_model(spark, path, weighted), asked)
        assert table(stored) == table(classify.predict_topk(classify.train_classifier(every, "label", weighted=weighted), asked))
