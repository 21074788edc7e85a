"""Column expressions over text: trimming, normalising, tokens, model input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from hangarlog.reference_data import STOPWORDS, TEXT_SEPARATOR

# Spark's trim() drops only the space character unless told what to drop.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0" + "".join(
    chr(c) for c in [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)

WHITESPACE_RUN = r"[\s\x1c-\x1f\x85\p{Z}]+"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.trim(as_column(c), F.lit(WHITESPACE))


def normalize_code(c: Column | str) -> Column:
    """Trimmed upper-case code; null stays null."""
    return F.upper(strip(c))


def normalize_phrase(c: Column | str) -> Column:
    """Upper case, every run of other characters than A-Z and 0-9 one space."""
    return F.trim(F.regexp_replace(F.upper(as_column(c)), "[^A-Z0-9]+", " "))


def normalize_writeup(c: Column | str) -> Column:
    """Upper case, single spaces, no closing dots or spaces; null gives ''."""
    squeezed = F.regexp_replace(F.upper(F.coalesce(as_column(c), F.lit(""))), WHITESPACE_RUN, " ")
    return F.rtrim(strip(squeezed), F.lit(". "))


def title_case(c: Column | str) -> Column:
    """Capital at the start of every letter run; initcap only looks at spaces."""
    runs = F.regexp_extract_all(as_column(c), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substring(r, 2, 1 << 30)))),
        "",
    )


def blank_to_null(c: Column | str) -> Column:
    """Trimmed text, null where nothing is left."""
    stripped = strip(c)
    return F.when(F.length(stripped) > 0, stripped)


def system_of(c: Column | str) -> Column:
    return F.substring(as_column(c), 1, 2)


def subsystem_of(c: Column | str) -> Column:
    return F.substring(as_column(c), 1, 3)


def snippet(c: Column | str, n: int) -> Column:
    """First n characters on one line."""
    return F.translate(F.substring(as_column(c), 1, n), "\n", " ")


def keyword_tokens(phrase: Column | str) -> Column:
    """Keywords of a normalised phrase, each as often as it occurs."""
    words = F.split(F.lower(as_column(phrase)), " ")
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(
        words,
        lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w) & ~w.rlike("^[0-9]+$"),
    )


def build_text(fields: Sequence[Column | str], sep: str = TEXT_SEPARATOR, upper: bool = False,
               drop_nan: bool = False) -> Column:
    """Non-blank fields in the given order, joined by a separator.

    ``upper`` puts every field in upper case; ``drop_nan`` also leaves out a
    field which reads "nan" in any case.
    """
    parts = []
    for field in fields:
        part = blank_to_null(as_column(field).cast("string"))
        if drop_nan:
            part = F.when(F.lower(part) != "nan", part)
        parts.append(F.upper(part) if upper else part)
    return F.concat_ws(sep, *parts)


def concat_pair(a: Column | str, b: Column | str) -> Column:
    """Two columns with a space between; null when either is null."""
    return F.concat(as_column(a), F.lit(" "), as_column(b))
