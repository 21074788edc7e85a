"""The answer to one record query: a bundle of small results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hangarlog.operators import counts
from hangarlog.operators.filters import Day, query_records, record_predicate
from hangarlog.plans.sizing import keep


def analyze(records: DataFrame, dictionary: DataFrame | None = None, asset_id: str | None = None,
            code: str | None = None, start: Day = None, end: Day = None) -> dict[str, DataFrame]:
    """Named results over the records that match.

    Of records picked by a filter only the columns needed are kept, once;
    ``sizing.release()`` lets go of them. Without a filter nothing is kept:
    each result then scans the few columns of its own.
    """
    wanted = [
        c for c in ("asset_id", "code", "start_date", "base", "discrepancy", "corrective_action",
                    "discrepancy_normalized", "corrective_action_normalized") if c in records.columns
    ]
    hits = query_records(records, asset_id, code, start, end).select(*wanted)
    if not (asset_id is None and code is None and start is None and end is None):
        hits = keep(hits)
    out = {
        "totals": counts.match_share(records, record_predicate(asset_id, code, start, end)),
        "headline": hits.agg(
            F.count(F.lit(1)).alias("total"), F.count_distinct("asset_id").alias("distinct_assets"),
            F.count_distinct("code").alias("distinct_codes"),
            F.min("start_date").alias("first_date"), F.max("start_date").alias("last_date"),
        ),
        "top_discrepancies": counts.topn_preferred(hits, "discrepancy_normalized", "discrepancy"),
        "top_fixes": counts.topn_preferred(hits, "corrective_action_normalized", "corrective_action"),
        "issues_by_month": counts.rolling_mean(counts.issues_by_month(hits)),
        "seasonality": counts.seasonality(hits),
        "base_breakdown": counts.topn_counts(hits, "base"),
        "prior_period": counts.prior_period(records, start, end, asset_id, code),
    }
    if asset_id is None:
        out["asset_leaderboard"] = counts.topn_counts(hits, "asset_id")
    if code is None:
        out["code_breakdown"] = counts.code_breakdown(hits, dictionary)
    return out
