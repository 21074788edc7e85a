"""Code classification from token counts: multinomial naive Bayes kept as tables.

A model is two tables, one row a label and one row a label and token. Nothing
of it is held by the driver, so labels, tokens and texts may be as many as
they like, and whole texts are counted. Training is one aggregation;
continuing is adding counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from hangarlog.functions.arrays import entry
from hangarlog.functions.labels import confidence_band
from hangarlog.functions.text import subsystem_of, system_of
from hangarlog.operators.evaluate import macro_f1_by, wide_predictions
from hangarlog.plans.sizing import fits_broadcast, join_small, keep
from hangarlog.reference_data import UNKNOWN_DEFINITION, UNKNOWN_SYSTEM

LEVELS = {"system": system_of, "subsystem": subsystem_of, "code": F.col}
#: Scores are compared at this many decimals, so that the order of a sum decides no rank.
SCORE_DECIMALS = 8


@dataclass(frozen=True)
class CountModel:
    """labels: target, prior, absent (log share of an unseen token); weights: target, token, gain over unseen."""

    labels: DataFrame
    weights: DataFrame


def text_tokens(text: str = "text") -> Column:
    """Lower-case words of letters and digits, all of them."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)


def token_counts(df: DataFrame, label: str, text: str = "text") -> DataFrame:
    """How often each token occurs under each label: what naive Bayes learns."""
    return (
        df.where(F.col(label).isNotNull()).select(F.col(label), F.explode(text_tokens(text)).alias("token"))
        .groupBy(label, "token").agg(F.count(F.lit(1)).alias("n"))
    )


def add_counts(old: DataFrame, new: DataFrame, label: str) -> DataFrame:
    """Counts over both; new data continue a table without the old records."""
    return old.unionByName(new).groupBy(label, "token").agg(F.sum("n").alias("n"))


def label_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows of each label; add these up too when training is continued."""
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


def fit_counts(counts: DataFrame, rows: DataFrame, label: str, weighted: bool = True, smoothing: float = 1.0) -> CountModel:
    """A model from token_counts() and label_counts(), of one batch or of several added up.

    ``weighted`` gives every label the same prior, as training weighted by
    rarity does; otherwise the prior is a label's share of the rows.
    """
    size = counts.select("token").distinct().agg(F.count(F.lit(1))).scalar()
    totals = counts.groupBy(label).agg(F.sum("n").alias("tokens"))
    share = F.lit(1.0) if weighted else F.col("rows").cast("double")
    prior = F.log(share / F.sum(share).over(Window.partitionBy()))
    labels = rows.join(totals, label, "left").select(
        F.col(label).alias("target"), prior.alias("prior"),
        F.log(F.lit(smoothing) / (F.coalesce("tokens", F.lit(0)) + smoothing * size)).alias("absent"),
    )
    gain = F.log((F.col("n") + smoothing) / F.lit(smoothing))
    return CountModel(labels, counts.select(F.col(label).alias("target"), "token", gain.alias("gain")))


def train_classifier(df: DataFrame, label: str, text: str = "text", level: str = "code", weighted: bool = True,
                     smoothing: float = 1.0) -> CountModel:
    """Fit on whole texts, at code, subsystem or system level."""
    rows = df.where(F.col(label).isNotNull()).select(LEVELS[level](label).alias("target"), F.col(text).alias("text"))
    return fit_counts(token_counts(rows, "target"), label_counts(rows, "target"), "target", weighted, smoothing)


def _bare_score() -> Column:
    """What a label scores for a text that shares no token with it."""
    return F.round(F.col("prior") + F.col("known") * F.col("absent"), SCORE_DECIMALS)


def _leaders(labels: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """For each number of known tokens the k labels with the best bare scores, that of the best, and the whole of all as shares of it."""
    number = Window.partitionBy("known")
    # One row a label and length: lengths are few, and are counted before they are sent to every task.
    lengths = F.broadcast(known) if fits_broadcast(known) else known
    scored = labels.crossJoin(lengths).select("known", "target", _bare_score().alias("bare"))
    return scored.withColumns({
        "lead": F.max("bare").over(number), "place": F.row_number().over(number.orderBy(F.desc("bare"), "target")),
    }).withColumn("whole", F.sum(F.exp(F.col("bare") - F.col("lead"))).over(number)).where(F.col("place") <= k)


def predict_topk(model: CountModel, df: DataFrame, k: int = 3, text: str = "text") -> DataFrame:
    """Add preds: array<struct<code, confidence>> of the k likeliest labels, in percent.

    Each distinct text is scored once, against all labels. Tokens are joined to
    the weights; a label that shares none scores prior + known * absent, which
    depends only on the number of known tokens, so it is worked out once for
    each such number. As gains are never negative, of the labels that share no
    token only the k leaders by that score can be among the k likeliest; the
    others count in the total. A text without a known token is judged by the
    priors, a null text gets no prediction. Ties go to the smaller label.
    """
    keys = {"_k1": F.xxhash64(text), "_k2": F.xxhash64(F.lit(17), text)}
    keyed = df.withColumns(keys)
    once = df.where(F.col(text).isNotNull()).select(*[c.alias(n) for n, c in keys.items()], F.col(text).alias("_text")).dropDuplicates(list(keys))
    tokens = once.select(*keys, F.explode(text_tokens("_text")).alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("tf"))
    found = tokens.join(model.weights.select("token").distinct(), "token", "left_semi").select(*keys, F.col("tf").alias("known"))
    known = keep(found.unionByName(once.select(*keys, F.lit(0).cast("bigint").alias("known"))).groupBy(*keys).agg(F.sum("known").alias("known")))
    leaders = keep(_leaders(model.labels, keep(known.select("known").distinct()), k))
    hits = tokens.join(model.weights, "token").select(*keys, "target", (F.col("tf") * F.col("gain")).alias("gained"))
    ahead = join_small(known, leaders.select("known", "target"), ["known"]).select(*keys, "target", F.lit(0.0).alias("gained"))
    gains = hits.unionByName(ahead).groupBy(*keys, "target").agg(F.sum("gained").alias("gained"))
    totals = leaders.where(F.col("place") == 1).select("known", "lead", "whole")
    scored = join_small(join_small(gains, model.labels, ["target"]).join(known, list(keys)), totals, ["known"]).withColumns({
        "bare": _bare_score(), "score": F.round(F.col("prior") + F.col("known") * F.col("absent") + F.col("gained"), SCORE_DECIMALS)})
    text_of = Window.partitionBy(*keys)
    top = F.max("score").over(text_of)
    # What the labels without a row here hold: the whole less the bare shares of those with one.
    rest = F.greatest(F.col("whole") - F.sum(F.exp(F.col("bare") - F.col("lead"))).over(text_of), F.lit(0.0)) * F.exp(F.col("lead") - top)
    best = (
        scored.withColumns({"share": F.exp(F.col("score") - top), "rest": rest}).withColumns({
            "confidence": 100.0 * F.col("share") / (F.sum("share").over(text_of) + F.col("rest")),
            "rank": F.row_number().over(text_of.orderBy(F.desc("score"), "target")),
        })
        .where(F.col("rank") <= k)
    )
    lists = best.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", "target", "confidence"))).alias("_best")).select(
        *keys, F.transform("_best", lambda e: F.struct(e["target"].alias("code"), e["confidence"].alias("confidence"))).alias("preds"))
    return keyed.join(lists, list(keys), "left").select(*df.columns, "preds")


def describe_predictions(df: DataFrame, dictionary: DataFrame, systems: DataFrame, k: int = 3) -> DataFrame:
    """Wide predictions with definition, system and confidence band of the first."""
    code = entry("preds", 0, "code")
    top = df.withColumns({"_code": code, "_prefix": system_of(code)})
    words = dictionary.select(F.col("code").alias("_code"), F.col("description").alias("_definition"))
    named = join_small(top, words, ["_code"], "left")
    named = join_small(named, systems.select(F.col("prefix").alias("_prefix"), F.col("system").alias("_system")), ["_prefix"], "left")
    return (
        wide_predictions(named, k)
        .withColumns({
            "pred_definition_1": F.coalesce("_definition", F.format_string(UNKNOWN_DEFINITION, "_code")),
            "pred_system_1": F.coalesce("_system", F.lit(UNKNOWN_SYSTEM)),
            "confidence_band": confidence_band(F.coalesce("confidence_1", F.lit(0.0))),
        })
        .drop("_code", "_prefix", "_definition", "_system")
    )


def setting_predictions(train: DataFrame, val: DataFrame, label: str, settings: Sequence[Mapping], text: str = "text") -> DataFrame:
    """setting (its index), truth and pred_1 for every row of val and every setting: level, weighted and smoothing.

    Counts are joined with the texts once for each level, and a gain is summed
    for each smoothing in the same grouping; labels that share no token with
    a text are led by one label for each setting and number of known tokens,
    as in predict_topk(). Null texts have no prediction.
    """
    keys = {"_k1": F.xxhash64(text), "_k2": F.xxhash64(F.lit(17), text)}
    once = val.where(F.col(text).isNotNull()).select(*[c.alias(n) for n, c in keys.items()], F.col(text).alias("_text")).dropDuplicates(list(keys))
    tokens = keep(once.select(*keys, F.explode(text_tokens("_text")).alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("tf")))
    out = None
    for level in dict.fromkeys(s.get("level", "code") for s in settings):
        own = {i: s for i, s in enumerate(settings) if s.get("level", "code") == level}
        rows = train.where(F.col(label).isNotNull()).select(LEVELS[level](label).alias("target"), F.col(text).alias("text"))
        counts, sizes = keep(token_counts(rows, "target")), label_counts(rows, "target")
        vocabulary = counts.select("token").distinct()
        size = vocabulary.agg(F.count(F.lit(1))).scalar()
        totals = sizes.join(counts.groupBy("target").agg(F.sum("n").alias("tokens")), "target", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
        every = Window.partitionBy()
        shares = []
        for i, s in own.items():
            smoothing, share = float(s.get("smoothing", 1.0)), F.lit(1.0) if s.get("weighted", True) else F.col("rows").cast("double")
            shares.append(F.struct(F.lit(i).alias("setting"), F.log(share / F.sum(share).over(every)).alias("prior"),
                                   F.log(F.lit(smoothing) / (F.col("tokens") + smoothing * size)).alias("absent")))
        labels = keep(totals.select("target", F.array(*shares).alias("all")).select("target", F.explode("all").alias("e")).select("target", "e.*"))
        found = tokens.join(vocabulary, "token", "left_semi").select(*keys, F.col("tf").alias("known"))
        known = keep(found.unionByName(once.select(*keys, F.lit(0).cast("bigint").alias("known"))).groupBy(*keys).agg(F.sum("known").alias("known")))
        lengths = keep(known.select("known").distinct())
        bare = labels.crossJoin(F.broadcast(lengths) if fits_broadcast(lengths) else lengths).select("setting", "known", "target", _bare_score().alias("bare"))
        place = F.row_number().over(Window.partitionBy("setting", "known").orderBy(F.desc("bare"), "target"))
        leaders = bare.withColumn("_place", place).where("_place = 1").select("setting", "known", "target", F.col("bare").alias("score"))
        gained = tokens.join(counts, "token").groupBy(*keys, "target").agg(*[
            F.sum(F.col("tf") * F.log((F.col("n") + float(s.get("smoothing", 1.0))) / F.lit(float(s.get("smoothing", 1.0))))).alias(f"g{i}") for i, s in own.items()])
        gains = gained.select(*keys, "target", F.explode(F.array(*[F.struct(F.lit(i).alias("setting"), F.col(f"g{i}").alias("gained")) for i in own])).alias("e")).select(*keys, "target", "e.*")
        hits = join_small(gains, labels, ["target", "setting"]).join(known, list(keys)).select(
            *keys, "setting", "target", F.round(F.col("prior") + F.col("known") * F.col("absent") + F.col("gained"), SCORE_DECIMALS).alias("score"))
        led = join_small(known, keep(leaders), ["known"]).select(*keys, "setting", "target", "score")
        # The smaller label of equal scores: of the best score, the least target.
        best = hits.unionByName(led).groupBy(*keys, "setting", "score").agg(F.min("target").alias("target")).groupBy(*keys, "setting").agg(
            F.max_by("target", "score").alias("pred_1"))
        out = best if out is None else out.unionByName(best)
    truth = val.select(*[c.alias(n) for n, c in keys.items()], F.explode(F.array(*[
        F.struct(F.lit(i).alias("setting"), LEVELS[s.get("level", "code")](label).alias("truth")) for i, s in enumerate(settings)])).alias("e")).select(*keys, "e.*")
    return truth.join(out, [*keys, "setting"], "left").select("setting", "truth", "pred_1")


def best_by_macro_f1(train: DataFrame, val: DataFrame, label: str, settings: Sequence[Mapping],
                     text: str = "text") -> tuple[CountModel, list[tuple[Mapping, float]]]:
    """The model of the setting with the best macro F1 on val, and every setting's score; ties to the earlier setting.

    All settings are scored together; only the best one's model is fitted.
    """
    pairs = setting_predictions(train, val, label, settings, text)
    scores = {r["setting"]: r["macro_f1"] for r in macro_f1_by(pairs, "setting").collect()}  # one row a setting
    tried = [(setting, scores.get(i)) for i, setting in enumerate(settings)]
    best = max((i for i, (_, score) in enumerate(tried) if score is not None), key=lambda i: (tried[i][1], -i), default=None)
    return None if best is None else train_classifier(train, label, text, **settings[best]), tried
