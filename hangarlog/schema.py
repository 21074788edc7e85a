"""Record schema: source column names, our names, and types."""

from __future__ import annotations

from pyspark.sql import types as T

# source column -> (our name, type the column holds once cleaned)
RECORD_COLUMNS = {
    "Corrected WUC": ("code", T.StringType()),
    "Tail Number": ("asset_id", T.StringType()),
    "Base": ("base", T.StringType()),
    "Start Date": ("start_date", T.DateType()),
    "Stop Date": ("stop_date", T.DateType()),
    "Discrepancy": ("discrepancy", T.StringType()),
    "Corrective Action": ("corrective_action", T.StringType()),
    "WCE Narrative": ("wce_narrative", T.StringType()),
    "How Mal": ("how_mal", T.StringType()),
    "Action Taken": ("action_taken", T.StringType()),
    "JCN": ("job_id", T.StringType()),
    "Labor": ("labor_hours", T.DoubleType()),
    "Flight Hours": ("flight_hours", T.DoubleType()),
    "When Discovered Code": ("discovered_code", T.StringType()),
    "Type Maint Code": ("maint_type_code", T.StringType()),
    "How Mal Class": ("how_mal_class", T.StringType()),
    "Units Produced": ("units_produced", T.DoubleType()),
}

# A raw extract is read as text: dates arrive in three encodings and numbers
# may hold junk, so typing happens in clean_records, never by inference.
RAW_SCHEMA = T.StructType(
    [T.StructField(source, T.StringType()) for source in RECORD_COLUMNS]
)

RECORD_SCHEMA = T.StructType(
    [T.StructField(name, kind) for name, kind in RECORD_COLUMNS.values()]
)

# The columns every profile section draws on.
PROFILE_COLUMNS = [
    "code",
    "discrepancy",
    "corrective_action",
    "asset_id",
    "start_date",
    "base",
    "flight_hours",
    "job_id",
    "discovered_code",
    "maint_type_code",
]

# Fields that make up the classifier input, in this order.
TEXT_FIELDS = [
    "discrepancy",
    "corrective_action",
    "wce_narrative",
    "how_mal",
    "action_taken",
]
