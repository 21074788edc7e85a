"""Column expressions that grade, label and format."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hangarlog.functions.text import as_column
from hangarlog.reference_data import CONFIDENCE_BANDS, CONFIDENCE_EDGES, RELIABILITY_BINS


def confidence_band(c: Column | str) -> Column:
    high, mid, low = CONFIDENCE_BANDS
    first, second = CONFIDENCE_EDGES
    return F.when(as_column(c) >= first, high).when(as_column(c) >= second, mid).otherwise(low)


def reliability_bin(share: Column | str) -> Column:
    """Name of the numeric bin a confidence between 0 and 1 falls in."""
    c, out = as_column(share), None
    for low, high in RELIABILITY_BINS:
        inside, name = (c >= low) & (c < high), f"{low:.2f}-{high:.2f}"
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def burden_verdict(index: Column | str) -> Column:
    c = as_column(index)
    return F.when(c >= 1.25, "expensive").when(c <= 0.8, "cheap").when(c.isNotNull(), "typical")


def trend_direction(change_pct: Column | str) -> Column:
    c = as_column(change_pct)
    return F.when(c > 15, "rising").when(c < -15, "falling").when(c.isNotNull(), "steady")


def lifecycle_verdict(band: Column | str, share_pct: Column | str) -> Column:
    """What the fullest hour band says; below 32 % there is no signal."""
    b, s = as_column(band), as_column(share_pct)
    return (
        F.when(s < 32, "none")
        .when(b.endswith("High"), "high-time")
        .when(b.endswith("Low"), "low-time")
        .when(b.isNotNull(), "mid-life")
    )


def percent_text(part: Column | str, total: Column | str) -> Column:
    """'12%'; '0%' when there is no total."""
    p, t = as_column(part), as_column(total)
    return F.when(t == 0, "0%").otherwise(F.format_string("%.0f%%", F.bround(100.0 * p / F.nullif(t, F.lit(0)), 0)))


def fixed(c: Column | str, places: int, grouped: bool = False, signed: bool = False) -> Column:
    """Number with a fixed count of decimals, rounded half to even."""
    flags = ("," if grouped else "") + ("+" if signed else "")
    return F.format_string(f"%{flags}.{places}f", F.bround(as_column(c).cast("double"), places))


def code_label(code: Column | str, description: Column | str) -> Column:
    """'CODE (description)', or the bare code when it has none."""
    c, d = as_column(code), as_column(description)
    return F.when(d.isNull(), c).otherwise(F.format_string("%s (%s)", c, d))


def code_of_label(label: Column | str) -> Column:
    return F.split_part(as_column(label), F.lit(" "), F.lit(1))


def prediction_sentence(code: Column, system: Column, definition: Column, confidence: Column) -> Column:
    return F.format_string(
        "%s: %s, %s (Confidence: %s%%)", code, system, definition, fixed(confidence, 2)
    )


def as_json(struct: Column) -> Column:
    return F.to_json(struct, {"pretty": "true", "ignoreNullFields": "false"})
