"""Rows of test records, and rows of results in one order."""

from __future__ import annotations

import datetime as dt

SCHEMA = (
    "record_id string, code string, asset_id string, base string, start_date date, labor_hours double, "
    "flight_hours double, job_id string, discovered_code string, maint_type_code string, discrepancy string, "
    "corrective_action string"
)


def row(i, code="11AAA", asset="57-0001", base="SCOTT AFB", day="2020-01-15", labor=1.0, hours=10.0, job="j",
        found="A", kind="B", text="LEAK FOUND", fix="REPLACED SEAL"):
    date = dt.date.fromisoformat(day) if day else None
    return (f"r{i}", code, asset, base, date, labor, hours, job, found, kind, text, fix)


def table(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)
