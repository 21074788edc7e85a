"""Rows of test documents."""

from __future__ import annotations

#: Columns that clash with names the operators give to results and to work columns.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, score string, k1 string, class string, n long"


def doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), 7, "x", "y", "z", None, None)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))
