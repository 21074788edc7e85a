"""From labelled records to splits, and from records to a scored prediction table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from hangarlog.functions.text import build_text, normalize_code
from hangarlog.operators.classify import CountModel, describe_predictions, predict_topk
from hangarlog.operators.clean import dedupe
from hangarlog.operators.filters import long_enough, valid_label, worksheet_columns
from hangarlog.operators.split import exclude_seen, rare_filter, seeded_sample, split
from hangarlog.reference_data import systems as known_systems
from hangarlog.schema import TEXT_FIELDS

FILL_IN = ("true_code", "top1_correct", "top3_correct", "notes")


def prepare_training(records: DataFrame, key: str = "record_id", label: str = "code",
                     fields: Sequence[str] = TEXT_FIELDS, min_per_class: int = 5, seed: int = 42) -> DataFrame:
    """Valid labels, built text, (text, label) once each, frequent classes, split."""
    present = [c for c in fields if c in records.columns]
    labelled = valid_label(records.withColumn(label, normalize_code(label)), label)
    texts = long_enough(labelled.select(key, label, build_text(present).alias("text")))
    frequent = rare_filter(dedupe(texts, ["text", label], key), label, min_per_class)
    return split(frequent, label, key, seed)


def batch_predict(records: DataFrame, model: CountModel, dictionary: DataFrame, seen: DataFrame | None = None,
                  key: str = "record_id", label: str = "code", fields: Sequence[str] = TEXT_FIELDS, k: int = 3,
                  sample: int | None = None, seed: int = 42, text_column: str | None = None) -> DataFrame:
    """Predictions for every record, less those the model has seen, sampled if asked.

    ``text_column`` names a column that already holds the model's input;
    otherwise it is built from the fields.
    """
    present = [c for c in fields if c in records.columns]
    truth = [F.col(label).alias("truth")] if label in records.columns else []
    built = F.upper(text_column) if text_column else build_text(present, upper=True)
    rows = records.select(key, *truth, *present, built.alias("model_input"))
    if seen is not None:
        rows = exclude_seen(rows, seen.select(F.upper("text").alias("model_input")), "model_input")
    if sample is not None:
        rows = seeded_sample(rows, sample, key, seed)
    scored = predict_topk(model, rows, k, "model_input")
    return describe_predictions(scored, dictionary, known_systems(records.sparkSession), k)


def labeling_worksheet(predictions: DataFrame, n: int = 34, key: str = "record_id", k: int = 3,
                       fields: Sequence[str] = TEXT_FIELDS, seed: int = 42) -> DataFrame:
    """Up to n predictions per confidence band, with columns to fill in."""
    picked = seeded_sample(predictions, n, key, seed, by=["confidence_band"])
    columns = [key, *fields, *[f"pred_{i + 1}" for i in range(k)], "confidence_1", "pred_definition_1",
               "confidence_band", "model_input", "truth"]
    return worksheet_columns(picked, columns, FILL_IN)
