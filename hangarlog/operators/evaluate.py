"""Scoring of predictions. Rows are counted by label pair before anything else."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from hangarlog.functions.arrays import entry
from hangarlog.functions.dates import to_number
from hangarlog.functions.labels import confidence_band, reliability_bin
from hangarlog.functions.text import normalize_code, snippet, subsystem_of, system_of
from hangarlog.operators.filters import confident_disagreements, worksheet_columns
from hangarlog.operators.ranks import exact_quantiles
from hangarlog.schema import TEXT_FIELDS


def _share(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def pair_counts(df: DataFrame, truth: str = "truth", pred: str = "pred_1") -> DataFrame:
    """Records per (truth, predicted); everything below starts from these."""
    return (
        df.where(F.col(truth).isNotNull())
        .groupBy(normalize_code(truth).alias("truth"), normalize_code(pred).alias("predicted"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _same(f: Column | None = None) -> dict[str, Column]:
    t, p = F.col("truth"), F.coalesce(F.col("predicted"), F.lit(""))
    return {
        "exact": t == p,
        "same_subsystem": subsystem_of(t) == subsystem_of(p),
        "same_system": system_of(t) == system_of(p),
    }


def _answerable(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The pairs whose truth is in the label space; all of them where none is given."""
    if labels is None:
        return pairs
    known = labels.select(normalize_code(labels.columns[0]).alias("truth")).distinct()
    return pairs.join(known, "truth", "left_semi")


def agreement(df: DataFrame, truth: str = "truth", pred: str = "pred_1", labels: DataFrame | None = None) -> DataFrame:
    """Share of records right in full, by subsystem and by system; of answerable records where labels are given."""
    total = F.sum("n")
    hit = lambda flag: F.sum(F.when(flag, F.col("n")).otherwise(0)) / total
    return _answerable(pair_counts(df, truth, pred), labels).agg(total.alias("n"), *[hit(flag).alias(k) for k, flag in _same().items()])


def error_character(df: DataFrame, truth: str = "truth", pred: str = "pred_1", labels: DataFrame | None = None) -> DataFrame:
    """Disagreements by how far off they are; labels the model cannot give are left out where a label space is given."""
    same = _same()
    wrong = _answerable(pair_counts(df, truth, pred), labels).where(~same["exact"])
    kind = (
        F.when(same["same_subsystem"], "near_miss").when(same["same_system"], "same_system").otherwise("different_system")
    )
    count = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0))
    kinds = ("near_miss", "same_system", "different_system")
    wide = wrong.withColumn("kind", kind).agg(F.sum("n").alias("wrong"), *[count(k).alias(k) for k in kinds])
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in kinds])
    return wide.select("wrong", F.explode(rows).alias("e")).select(
        "e.kind", "e.n", (100.0 * F.col("e.n") / F.col("wrong")).alias("pct")
    )


def confusion_pairs(df: DataFrame, truth: str = "truth", pred: str = "pred_1") -> DataFrame:
    """Wrong (truth, predicted) pairs with how often the reverse occurs.

    Both directions of a pair are counted under the same unordered key, so the
    reverse count needs no join of the pairs with themselves.
    """
    a, b = F.least("truth", "predicted"), F.greatest("truth", "predicted")
    both = (
        df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull())
        .select(normalize_code(truth).alias("truth"), normalize_code(pred).alias("predicted"))
        .where("truth <> predicted")
        .groupBy(a.alias("a"), b.alias("b"))
        .agg(F.count_if(F.col("truth") < F.col("predicted")).alias("forward"),
             F.count_if(F.col("truth") > F.col("predicted")).alias("backward"))
    )
    way = lambda t, p, n, r: F.struct(
        F.col(t).alias("truth"), F.col(p).alias("predicted"), F.col(n).alias("n"), F.col(r).alias("reverse_n")
    )
    return (
        both.select(F.explode(F.array(way("a", "b", "forward", "backward"), way("b", "a", "backward", "forward"))).alias("e"))
        .select("e.*").where("n > 0")
        .withColumns({
            "same_system": system_of("truth") == system_of("predicted"),
            "same_subsystem": subsystem_of("truth") == subsystem_of("predicted"),
            "bidirectional": F.col("reverse_n") > 0,
        })
    )


def _any_of(df: DataFrame, k: int) -> Column:
    found = F.lit(False)
    for i in range(1, k + 1):
        if f"pred_{i}" in df.columns:
            found = found | F.coalesce(normalize_code(f"pred_{i}") == normalize_code("truth"), F.lit(False))
    return found


def accuracy(df: DataFrame, k: int = 3) -> DataFrame:
    """Top-1 and top-k accuracy over the labelled rows."""
    top1 = F.coalesce(normalize_code("pred_1") == normalize_code("truth"), F.lit(False))
    return df.where("truth IS NOT NULL").agg(
        F.count(F.lit(1)).alias("n"), _share(top1).alias("top1"), _share(_any_of(df, k)).alias("topk")
    )


def _by_truth(df: DataFrame, labels: DataFrame, extra: Sequence[Column] = (), k: int = 3) -> DataFrame:
    """Hits per truth and group, with a flag for labels the model can give."""
    top1 = F.coalesce(normalize_code("pred_1") == normalize_code("truth"), F.lit(False))
    counts = (
        df.where("truth IS NOT NULL").groupBy(normalize_code("truth").alias("truth"), *extra)
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(top1).alias("top1_hits"), F.count_if(_any_of(df, k)).alias("topk_hits"))
    )
    known = labels.select(normalize_code(labels.columns[0]).alias("truth")).distinct().withColumn("known", F.lit(True))
    return counts.join(known, "truth", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def coverage(df: DataFrame, labels: DataFrame, k: int = 3) -> DataFrame:
    """Share of rows the label space can answer, and accuracy with and without the rest."""
    c = _by_truth(df, labels, k=k)
    n, known = F.sum("n"), F.sum(F.when(F.col("known"), F.col("n")).otherwise(0))
    hit = lambda h, keep=F.lit(True): F.sum(F.when(keep, F.col(h)).otherwise(0))
    safe = F.nullif(known, F.lit(0))
    return c.agg(
        n.alias("n"), known.alias("answerable"), (100.0 * known / n).alias("coverage_pct"),
        (hit("top1_hits") / n).alias("top1_all"), (hit("topk_hits") / n).alias("topk_all"),
        (hit("top1_hits", F.col("known")) / safe).alias("top1_answerable"),
        (hit("topk_hits", F.col("known")) / safe).alias("topk_answerable"),
    )


def calibration(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows and top-1 accuracy per confidence band, on answerable rows; on all labelled ones where none is answerable."""
    c = _by_truth(df, labels, [confidence_band(F.col("confidence_1")).alias("band")])
    return (
        c.withColumn("any_known", F.max("known").over(Window.partitionBy())).where("known OR NOT any_known").groupBy("band")
        .agg(F.sum("n").alias("n"), (F.sum("top1_hits") / F.sum("n")).alias("top1"))
    )


def reliability(models: dict[str, DataFrame]) -> DataFrame:
    """Rows and accuracy per model and numeric confidence bin, all bins listed per model with rows."""
    parts = []
    for name, df in models.items():
        right = F.coalesce(normalize_code("pred_1") == normalize_code("truth"), F.lit(False))
        parts.append(
            df.where("truth IS NOT NULL").select(
                F.lit(name).alias("model"), reliability_bin(F.col("confidence_1") / 100.0).alias("bin"), right.alias("right")
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("model", "bin").agg(F.count(F.lit(1)).alias("n"), _share(F.col("right")).alias("accuracy"))


def label_scores(pairs: DataFrame) -> DataFrame:
    """Support and F1 per label over true and predicted labels.

    Every pair count is booked once under its truth and once under its
    prediction; one grouping then has all three counts of a label.
    """
    n, zero = F.col("n"), F.lit(0).cast("bigint")
    booked = F.array(
        F.struct(F.col("truth").alias("label"), F.when(F.col("truth") == F.col("predicted"), n).otherwise(zero).alias("tp"),
                 n.alias("support"), zero.alias("given")),
        F.struct(F.col("predicted").alias("label"), zero.alias("tp"), zero.alias("support"), n.alias("given")),
    )
    sums = (
        pairs.select(F.explode(booked).alias("e")).select("e.*").where("label IS NOT NULL")
        .groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("given").alias("given"))
    )
    return sums.withColumn("f1", 2.0 * F.col("tp") / (F.col("support") + F.col("given")))


def macro_f1(df: DataFrame, truth: str = "truth", pred: str = "pred_1") -> DataFrame:
    """Accuracy, macro F1 over all labels met, and F1 weighted by support."""
    scores = label_scores(pair_counts(df, truth, pred))
    support = F.sum("support")
    return scores.agg(
        support.alias("n"), F.count(F.lit(1)).alias("labels"), (F.sum("tp") / support).alias("accuracy"),
        F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / support).alias("weighted_f1"),
    )


def macro_f1_by(df: DataFrame, by: str, truth: str = "truth", pred: str = "pred_1") -> DataFrame:
    """Macro F1 of each value of `by`, in one pass: by and macro_f1."""
    n, zero = F.col("n"), F.lit(0).cast("bigint")
    pairs = df.where(F.col(truth).isNotNull()).groupBy(by, normalize_code(truth).alias("truth"), normalize_code(pred).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    booked = F.array(F.struct(F.col("truth").alias("label"), F.when(F.col("truth") == F.col("predicted"), n).otherwise(zero).alias("tp"), n.alias("given")),
                     F.struct(F.col("predicted").alias("label"), zero.alias("tp"), n.alias("given")))
    sums = pairs.select(by, F.explode(booked).alias("e")).select(by, "e.*").where("label IS NOT NULL").groupBy(by, "label").agg(
        F.sum("tp").alias("tp"), F.sum("given").alias("given"))
    return sums.groupBy(by).agg(F.avg(2.0 * F.col("tp") / F.col("given")).alias("macro_f1"))


def confidence_distribution(df: DataFrame, column: str = "confidence_1") -> DataFrame:
    """Mean, median and population deviation."""
    middle = exact_quantiles(df, column, [0.5]).select("q0").scalar()
    return (
        df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))
        .withColumn("median", middle)
    )


def compare_rows(old: DataFrame, new: DataFrame, key: str = "record_id") -> DataFrame:
    """Truth and both predictions per record."""
    left = old.select(key, "truth", F.col("pred_1").alias("old_pred"), F.col("confidence_1").alias("old_confidence"))
    right = new.select(key, F.col("pred_1").alias("new_pred"), F.col("confidence_1").alias("new_confidence"))
    return left.join(right, key)


def disagreements(old: DataFrame, new: DataFrame, key: str = "record_id") -> DataFrame:
    return compare_rows(old, new, key).where("NOT (old_pred <=> new_pred)")


def first_disagreements(old: DataFrame, new: DataFrame, texts: DataFrame, n: int = 15, width: int = 50,
                        key: str = "record_id") -> DataFrame:
    """The first n disagreements by key, with the start of their text."""
    first = disagreements(old, new, key).orderBy(key).limit(n)
    return texts.join(first, key).select(first["*"], snippet(texts["text"], width).alias("snippet"))


def compare_predictions(old: DataFrame, new: DataFrame, key: str = "record_id") -> DataFrame:
    """How often two models differ and which of them is right then."""
    differ = ~F.col("old_pred").eqNullSafe(F.col("new_pred"))
    old_right = F.coalesce(F.col("old_pred") == F.col("truth"), F.lit(False))
    new_right = F.coalesce(F.col("new_pred") == F.col("truth"), F.lit(False))
    return compare_rows(old, new, key).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(differ).alias("disagreements"),
        (100.0 * F.count_if(differ) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("disagreement_pct"),
        F.count_if(differ & old_right).alias("old_right"),
        F.count_if(differ & new_right).alias("new_right"),
        F.count_if(differ & ~old_right & ~new_right).alias("both_wrong"),
    )


def adjudication(df: DataFrame, n: int = 25, floor: float = 90.0, key: str = "record_id",
                 columns: Sequence[str] = (*TEXT_FIELDS, "model_input")) -> DataFrame:
    """The most confident disagreements as a sheet to be filled in, with the texts to judge them by."""
    best = (
        confident_disagreements(df, floor=floor)
        .withColumn("_confidence", to_number("confidence_1"))
        .orderBy(F.desc("_confidence"), F.asc(key)).limit(n)
    )
    sheet = best.select(
        key, *[c for c in columns if c in df.columns],
        F.col("pred_1").alias("model_says"),
        *([F.col("pred_definition_1").alias("model_says_means")] if "pred_definition_1" in df.columns else []),
        F.bround("_confidence", 1).alias("model_confidence"), F.col("truth").alias("existing_label"),
    )
    return worksheet_columns(sheet, sheet.columns, ["which_is_correct", "correct_code_if_neither", "expert_notes"])


def wide_predictions(df: DataFrame, k: int, preds: str = "preds") -> DataFrame:
    """pred_1 … pred_k and confidence_1 … from array<struct<code, confidence>>."""
    codes = {f"pred_{i + 1}": entry(preds, i, "code") for i in range(k)}
    shares = {f"confidence_{i + 1}": F.bround(entry(preds, i, "confidence"), 2) for i in range(k)}
    return df.withColumns({**codes, **shares}).drop(preds)
