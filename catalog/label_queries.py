"""Dedupe, split, weights, samples, and everything about predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import RARE, query, sql
from hangarlog.functions.labels import confidence_band
from hangarlog.operators import clean, evaluate, filters, quality, split
from hangarlog.sources import star


def predicted(spark, d):
    return star.predictions(star.records(spark, d))


def label_space(spark, d):
    return split.frequent_labels(star.records(spark, d), "code", RARE)


# ---- dedupe and classes ----------------------------------------------------

@query("u3_dedupe_text_label", "SELECT min(doc_id) AS doc_id, md5(text) AS digest, lang FROM documents GROUP BY text, lang")
def _(spark, d):
    docs = star.table(spark, d, "documents").select("doc_id", "text", "lang")
    return clean.dedupe(docs, ["text", "lang"], "doc_id").select("doc_id", F.md5("text").alias("digest"), "lang")


@query("u5_rare_class_filter", sql("records label_space", "SELECT record_id, code FROM records WHERE code IN (SELECT code FROM label_space)"))
def _(spark, d):
    return split.rare_filter(star.records(spark, d).select("record_id", "code"), "code", RARE)


@query("j5_semi_join_jobs", sql("records label_space", """
    SELECT record_id FROM records WHERE job_id IN (SELECT job_id FROM records WHERE discovered_code = 'A')"""))
def _(spark, d):
    recs = star.records(spark, d).select("record_id", "job_id", "discovered_code")
    return recs.join(recs.where("discovered_code = 'A'").select("job_id").distinct(), "job_id", "left_semi").select("record_id")


@query("j6_exclude_seen", """
    SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id))""")
def _(spark, d):
    docs = star.table(spark, d, "documents").select("doc_id", "text")
    seen = docs.join(star.table(spark, d, "labels").select("doc_id"), "doc_id")
    return split.exclude_seen(docs, seen).select("doc_id")


@query("a25_class_frequency", """
    SELECT count(*) AS classes, median(n) AS median_n, avg(n) AS mean_n, max(n) AS max_n
    FROM (SELECT source, count(*) AS n FROM deduped GROUP BY 1) x""".replace("deduped", "(SELECT min(doc_id), text, source FROM documents GROUP BY text, source)"))
def _(spark, d):
    docs = star.table(spark, d, "documents").select("doc_id", "text", "source")
    return quality.class_frequency(clean.dedupe(docs, ["text", "source"], "doc_id"), "source")


@query("a26_text_length", """
    SELECT count(*) AS n, avg(length(text)) AS mean_len, round(stddev_samp(length(text)), 6) AS std_len,
           cast(min(length(text)) as int) AS min_len, cast(max(length(text)) as int) AS max_len,
           count(*) FILTER (length(text) < 50) AS short_rows, count(*) FILTER (trim(text) = '') AS blank_rows,
           quantile_cont(length(text), 0.25) AS p25, quantile_cont(length(text), 0.5) AS p50,
           quantile_cont(length(text), 0.75) AS p75 FROM documents""")
def _(spark, d):
    return quality.text_length_summary(star.table(spark, d, "documents"), "text").withColumn("std_len", F.round("std_len", 6))


@query("a27_system_distribution", sql("records", """
    SELECT substr(code, 1, 2) AS item, count(*) AS n FROM records GROUP BY 1 ORDER BY n DESC, item LIMIT 10"""))
def _(spark, d):
    return quality.label_distribution(star.records(spark, d), "code", system=True)


@query("a27_label_distribution", "SELECT source AS item, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, item LIMIT 10")
def _(spark, d):
    return quality.label_distribution(star.table(spark, d, "documents"), "source")


# ---- splits ----------------------------------------------------------------

def splits(spark, d):
    return split.split(star.records(spark, d).select("record_id", "code"), "code", "record_id")


@query("u8_stratified_split", sql("splits", "SELECT record_id, code, CASE WHEN in_train THEN 'train' ELSE 'rest' END AS part FROM splits"))
def _(spark, d):
    part = F.when(F.col("split") == "train", "train").otherwise("rest")
    return splits(spark, d).select("record_id", "code", part.alias("part"))


@query("u9_halved_remainder", sql("splits", "SELECT record_id, split FROM splits WHERE NOT in_train"))
def _(spark, d):
    return splits(spark, d).where("split <> 'train'").select("record_id", "split")


@query("u10_label_map", sql("splits", """
    SELECT code, cast(row_number() OVER (ORDER BY code) - 1 as int) AS label_id
    FROM (SELECT DISTINCT code FROM splits WHERE split <> 'test') x"""))
def _(spark, d):
    return split.label_map(splits(spark, d), "code")


@query("w5_dense_ids", sql("records", """
    SELECT code, substr(code, 1, 2) AS system, substr(code, 1, 3) AS subsystem,
           cast(dense_rank() OVER (ORDER BY code) - 1 as int) AS label_id,
           cast(dense_rank() OVER (ORDER BY substr(code, 1, 3)) - 1 as int) AS subsystem_id,
           cast(dense_rank() OVER (ORDER BY substr(code, 1, 2)) - 1 as int) AS system_id
    FROM (SELECT DISTINCT code FROM records) x"""))
def _(spark, d):
    return split.hierarchy_ids(star.records(spark, d))


@query("j7_label_id_join", sql("records label_space", """
    SELECT record_id, records.code, label_id FROM records
    JOIN (SELECT code, cast(row_number() OVER (ORDER BY code) - 1 as int) AS label_id FROM label_space) l ON records.code = l.code"""))
def _(spark, d):
    recs = star.records(spark, d).select("record_id", "code")
    ids = split.dense_ids(split.frequent_labels(recs, "code", RARE), "code")
    return split.with_label_ids(recs, ids, "code").select("record_id", "code", "label_id")


@query("f23_inverted_label_map", sql("label_space", """
    SELECT cast(row_number() OVER (ORDER BY code) - 1 as int) AS label_id, code FROM label_space"""))
def _(spark, d):
    return split.invert_label_map(split.dense_ids(label_space(spark, d), "code"), "code")


@query("a39_class_weights", sql("records", """
    SELECT code, n, (1 / greatest(n, 1)) / avg(1 / greatest(n, 1)) OVER () AS weight FROM (
      SELECT l.code, count(r.code) AS n FROM (SELECT DISTINCT code FROM records) l
      LEFT JOIN (SELECT code FROM records WHERE discovered_code = 'A') r ON l.code = r.code GROUP BY 1) x""").replace(
    "/ avg(1 / greatest(n, 1)) OVER () AS weight", "/ avg(1 / greatest(n, 1)) OVER () AS raw").replace(
    "SELECT code, n, (1", "SELECT code, n, round(raw, 9) AS weight FROM (SELECT code, n, (1") + ") y")
def _(spark, d):
    recs = star.records(spark, d)
    ids = split.dense_ids(recs.select("code").distinct(), "code")
    weights = split.class_weights(recs.where("discovered_code = 'A'").select("code"), ids, "code")
    return weights.select("code", "n", F.round("weight", 9).alias("weight"))


@query("a40_split_counts", sql("splits", "SELECT split, count(*) AS rows, count(DISTINCT code) AS classes FROM splits GROUP BY 1"))
def _(spark, d):
    return split.split_counts(splits(spark, d), "code")


@query("u7_seeded_sample", sql("records", "SELECT record_id, code FROM records ORDER BY md5(concat('42:', record_id)) LIMIT 5000"))
def _(spark, d):
    return split.seeded_sample(star.records(spark, d).select("record_id", "code"), 5000, "record_id")


BAND = "CASE WHEN {0} >= 70 THEN 'high (>=70%)' WHEN {0} >= 30 THEN 'mid (30-70%)' ELSE 'low (<30%)' END"


@query("w4_sample_per_band", sql("predicted", f"""
    SELECT record_id, band FROM (
      SELECT record_id, band, row_number() OVER (PARTITION BY band ORDER BY md5(concat('42:', record_id))) AS r
      FROM (SELECT record_id, {BAND.format('confidence_1')} AS band FROM predicted) x) y WHERE r <= 34"""))
def _(spark, d):
    rows = predicted(spark, d).select("record_id", confidence_band("confidence_1").alias("band"))
    return split.seeded_sample(rows, 34, "record_id", by=["band"])


# ---- predictions -----------------------------------------------------------

@query("p9_confident_disagreements", sql("predicted", """
    SELECT record_id, truth, pred_1, confidence_1 FROM predicted WHERE truth <> pred_1 AND confidence_1 >= 90"""))
def _(spark, d):
    return filters.confident_disagreements(predicted(spark, d))


@query("o4_highest_confidence", sql("predicted", """
    SELECT record_id, truth, pred_1, confidence_1 FROM predicted WHERE truth <> pred_1 AND confidence_1 >= 90
    ORDER BY confidence_1 DESC, record_id LIMIT 25"""))
def _(spark, d):
    return filters.confident_disagreements(predicted(spark, d)).orderBy(F.desc("confidence_1"), "record_id").limit(25)


@query("a29_agreement", sql("predicted", """
    SELECT count(*) AS n, avg(cast(truth = pred_1 as int)) AS exact,
           avg(cast(substr(truth,1,3) = substr(pred_1,1,3) as int)) AS same_subsystem,
           avg(cast(substr(truth,1,2) = substr(pred_1,1,2) as int)) AS same_system FROM predicted"""))
def _(spark, d):
    return evaluate.agreement(predicted(spark, d))


@query("a30_error_character", sql("predicted", """
    SELECT kind, count(e.k) AS n, 100.0::double * count(e.k) / (SELECT count(*) FROM predicted WHERE truth <> pred_1) AS pct
    FROM (VALUES ('near_miss'), ('same_system'), ('different_system')) v(kind) LEFT JOIN (
      SELECT CASE WHEN substr(truth,1,3) = substr(pred_1,1,3) THEN 'near_miss'
                  WHEN substr(truth,1,2) = substr(pred_1,1,2) THEN 'same_system' ELSE 'different_system' END AS k
      FROM predicted WHERE truth <> pred_1) e ON k = kind GROUP BY 1"""))
def _(spark, d):
    return evaluate.error_character(predicted(spark, d))


PAIRS = "SELECT truth, pred_1 AS predicted, count(*) AS n FROM predicted WHERE truth <> pred_1 GROUP BY 1, 2"


@query("a31_confusion_pairs", sql("predicted", """
    SELECT a.truth, a.predicted, a.n, coalesce(b.n, 0) AS reverse_n, b.n IS NOT NULL AS bidirectional,
           substr(a.truth,1,2) = substr(a.predicted,1,2) AS same_system,
           substr(a.truth,1,3) = substr(a.predicted,1,3) AS same_subsystem
    FROM pairs a LEFT JOIN pairs b ON a.truth = b.predicted AND a.predicted = b.truth""", pairs=PAIRS))
def _(spark, d):
    return evaluate.confusion_pairs(predicted(spark, d))


@query("j12_reverse_pairs", sql("predicted", """
    SELECT a.truth, a.predicted, a.n, b.n AS reverse_n
    FROM pairs a JOIN pairs b ON a.truth = b.predicted AND a.predicted = b.truth""", pairs=PAIRS))
def _(spark, d):
    return evaluate.confusion_pairs(predicted(spark, d)).where("bidirectional").select("truth", "predicted", "n", "reverse_n")


TOP3 = """SELECT record_id, truth, pred_1, concat(substr(pred_1,1,3), substr(pred_1,5,1), substr(pred_1,4,1)) AS pred_2,
                 concat(substr(pred_1,2,1), substr(pred_1,1,1), substr(pred_1,3,3)) AS pred_3, confidence_1 FROM predicted"""


def top3(spark, d):
    """Guesses two and three: the first with its last or first two characters swapped."""
    p = F.col("pred_1")
    return predicted(spark, d).withColumns({
        "pred_2": F.concat(F.substring(p, 1, 3), F.substring(p, 5, 1), F.substring(p, 4, 1)),
        "pred_3": F.concat(F.substring(p, 2, 1), F.substring(p, 1, 1), F.substring(p, 3, 3)),
    })


@query("a32_topk_accuracy", sql("predicted", """
    SELECT count(*) AS n, avg(cast(truth = pred_1 as int)) AS top1,
           avg(cast(truth IN (pred_1, pred_2, pred_3) as int)) AS topk FROM t""", t=TOP3))
def _(spark, d):
    return evaluate.accuracy(top3(spark, d))


@query("a33_label_coverage", sql("predicted label_space", """
    SELECT count(*) AS n, count(*) FILTER (known) AS answerable, 100.0::double * count(*) FILTER (known) / count(*) AS coverage_pct,
           avg(cast(truth = pred_1 as int)) AS top1_all, avg(cast(truth IN (pred_1, pred_2, pred_3) as int)) AS topk_all,
           avg(cast(truth = pred_1 as int)) FILTER (known) AS top1_answerable,
           avg(cast(truth IN (pred_1, pred_2, pred_3) as int)) FILTER (known) AS topk_answerable
    FROM (SELECT *, truth IN (SELECT code FROM label_space) AS known FROM t) x""", t=TOP3))
def _(spark, d):
    return evaluate.coverage(top3(spark, d), label_space(spark, d))


@query("a34_calibration_by_band", sql("predicted label_space", f"""
    SELECT {BAND.format('confidence_1')} AS band, count(*) AS n, avg(cast(truth = pred_1 as int)) AS top1
    FROM predicted WHERE truth IN (SELECT code FROM label_space) GROUP BY 1"""))
def _(spark, d):
    return evaluate.calibration(predicted(spark, d), label_space(spark, d))


BINS = """CASE WHEN c < 0.5 THEN '0.00-0.50' WHEN c < 0.7 THEN '0.50-0.70' WHEN c < 0.85 THEN '0.70-0.85'
               WHEN c < 0.95 THEN '0.85-0.95' ELSE '0.95-1.00' END"""


@query("a35_calibration_by_bin", sql("predicted", f"""
    SELECT model, {BINS} AS bin, count(*) AS n, avg(cast(truth = pred as int)) AS accuracy FROM (
      SELECT 'new' AS model, truth, pred_1 AS pred, confidence_1 / 100 AS c FROM predicted
      UNION ALL SELECT 'old', truth, old_1, confidence_1 / 100 FROM predicted) x GROUP BY 1, 2"""))
def _(spark, d):
    recs = star.records(spark, d)
    return evaluate.reliability({"new": star.predictions(recs), "old": star.predictions(recs, right=14)})


@query("a36_macro_f1", sql("predicted", """
    SELECT sum(support)::bigint AS n, count(*) AS labels, sum(tp) / sum(support) AS accuracy,
           round(avg(f1), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1
    FROM (SELECT *, 2.0::double * tp / (support + given) AS f1 FROM (
      SELECT coalesce(t.label, p.label) AS label, coalesce(tp, 0) AS tp, coalesce(support, 0) AS support, coalesce(given, 0) AS given
      FROM (SELECT truth AS label, count(*) AS support, count(*) FILTER (truth = pred_1) AS tp FROM predicted GROUP BY 1) t
      FULL JOIN (SELECT pred_1 AS label, count(*) AS given FROM predicted GROUP BY 1) p ON t.label = p.label) x) y"""))
def _(spark, d):
    return evaluate.macro_f1(predicted(spark, d)).withColumns(
        {c: F.round(c, 9) for c in ("macro_f1", "weighted_f1")})


@query("a37_confidence_distribution", sql("predicted", """
    SELECT count(*) AS n, round(avg(confidence_1), 6) AS mean, round(stddev_pop(confidence_1), 6) AS std,
           median(confidence_1) AS median FROM predicted"""))
def _(spark, d):
    return evaluate.confidence_distribution(predicted(spark, d)).withColumns({c: F.round(c, 6) for c in ("mean", "std")})


def both_models(spark, d):
    recs = star.records(spark, d)
    return star.predictions(recs, right=14), star.predictions(recs)


MODELS = {
    "both_models": """SELECT o.truth, o.record_id, o.old_1, n.pred_1 FROM predicted o JOIN predicted n ON o.record_id = n.record_id""",
}


@query("j13_compared_rows", sql("predicted", """
    SELECT record_id, truth, old_1 AS old_pred, pred_1 AS new_pred FROM both_models WHERE old_1 <> pred_1""", **MODELS))
def _(spark, d):
    return evaluate.disagreements(*both_models(spark, d)).select("record_id", "truth", "old_pred", "new_pred")


@query("a38_disagreement_summary", sql("predicted", """
    SELECT count(*) AS n, count(*) FILTER (old_1 <> pred_1) AS disagreements,
           100.0::double * count(*) FILTER (old_1 <> pred_1) / count(*) AS disagreement_pct,
           count(*) FILTER (old_1 <> pred_1 AND old_1 = truth) AS old_right,
           count(*) FILTER (old_1 <> pred_1 AND pred_1 = truth) AS new_right,
           count(*) FILTER (old_1 <> pred_1 AND old_1 <> truth AND pred_1 <> truth) AS both_wrong FROM both_models""", **MODELS))
def _(spark, d):
    return evaluate.compare_predictions(*both_models(spark, d))


@query("m6_first_disagreements", sql("predicted records", """
    SELECT p.record_id, truth, old_1 AS old_pred, pred_1 AS new_pred, substr(discrepancy, 1, 50) AS snippet
    FROM predicted p JOIN records r ON p.record_id = r.record_id WHERE old_1 <> pred_1 ORDER BY p.record_id LIMIT 15"""))
def _(spark, d):
    old, new = both_models(spark, d)
    texts = star.records(spark, d).select("record_id", F.col("discrepancy").alias("text"))
    return evaluate.first_disagreements(old, new, texts).drop("old_confidence", "new_confidence")


@query("m8_adjudication_sheet", sql("predicted", """
    SELECT record_id, pred_1 AS model_says, round_even(confidence_1, 1) AS model_confidence, truth AS existing_label,
           '' AS which_is_correct, '' AS correct_code_if_neither, '' AS expert_notes
    FROM predicted WHERE truth <> pred_1 AND confidence_1 >= 90 ORDER BY confidence_1 DESC, record_id LIMIT 25"""))
def _(spark, d):
    return evaluate.adjudication(predicted(spark, d))


@query("p12_worksheet", sql("predicted", f"""
    SELECT record_id, truth, pred_1, confidence_1, '' AS true_code, '' AS top1_correct, '' AS notes FROM predicted"""))
def _(spark, d):
    return filters.worksheet_columns(
        predicted(spark, d), ["record_id", "truth", "pred_1", "confidence_1", "pred_9"], ["true_code", "top1_correct", "notes"])


@query("p13_wide_topk", sql("predicted", """
    SELECT record_id, pred_1, confidence_1, CASE WHEN confidence_1 >= 50 THEN truth END AS pred_2,
           CASE WHEN confidence_1 >= 50 THEN round_even(floor(confidence_1) / 8, 2) END AS confidence_2, NULL::string AS pred_3,
           NULL::double AS confidence_3 FROM predicted"""))
def _(spark, d):
    guess = lambda code, share: F.struct(code.alias("code"), share.alias("confidence"))
    c = F.col("confidence_1")
    preds = F.when(c >= 50, F.array(guess(F.col("pred_1"), c), guess(F.col("truth"), F.floor(c) / 8))).otherwise(
        F.array(guess(F.col("pred_1"), c)))
    return evaluate.wide_predictions(predicted(spark, d).select("record_id", preds.alias("preds")), 3)


@query("m8_adjudication_with_texts", sql("predicted records", """
    SELECT p.record_id, discrepancy, corrective_action, pred_1 AS model_says, round_even(confidence_1, 1) AS model_confidence,
           truth AS existing_label, '' AS which_is_correct, '' AS correct_code_if_neither, '' AS expert_notes
    FROM predicted p JOIN records r USING (record_id) WHERE truth <> pred_1 AND confidence_1 >= 90 ORDER BY confidence_1 DESC, p.record_id LIMIT 25"""))
def _(spark, d):
    texts = star.records(spark, d).select("record_id", "discrepancy", "corrective_action")
    return evaluate.adjudication(predicted(spark, d).join(texts, "record_id"))


# Half of the labels cannot be given; what is left is judged.
KNOWN = "SELECT DISTINCT code FROM records WHERE substr(code, 2, 1) IN ('0', '2', '4', '6', '8')"


@query("a29_agreement_answerable", sql("predicted records", """
    SELECT count(*) AS n, avg(cast(truth = pred_1 as int)) AS exact,
           avg(cast(substr(truth,1,3) = substr(pred_1,1,3) as int)) AS same_subsystem,
           avg(cast(substr(truth,1,2) = substr(pred_1,1,2) as int)) AS same_system FROM predicted WHERE truth IN (SELECT code FROM known)""", known=KNOWN))
def _(spark, d):
    codes = star.records(spark, d).select("code").distinct().where(F.substring("code", 2, 1).isin("0", "2", "4", "6", "8"))
    return evaluate.agreement(predicted(spark, d), labels=codes)


@query("a30_error_character_answerable", sql("predicted records", """
    SELECT kind, count(*) AS n, 100.0::double * count(*) / sum(count(*)) OVER () AS pct FROM (
      SELECT CASE WHEN substr(truth,1,3) = substr(pred_1,1,3) THEN 'near_miss' WHEN substr(truth,1,2) = substr(pred_1,1,2) THEN 'same_system'
                  ELSE 'different_system' END AS kind FROM predicted WHERE truth <> pred_1 AND truth IN (SELECT code FROM known)) x GROUP BY 1""", known=KNOWN))
def _(spark, d):
    codes = star.records(spark, d).select("code").distinct().where(F.substring("code", 2, 1).isin("0", "2", "4", "6", "8"))
    return evaluate.error_character(predicted(spark, d), labels=codes)
