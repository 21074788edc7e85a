from __future__ import annotations

import pytest

from hangarlog.llm import frames
from llm_helpers import DOCS, doc, prose


@pytest.fixture(autouse=True)
def _dropped():
    yield
    frames.drop_stashes()


@pytest.fixture
def docs(spark):
    return lambda rows: spark.createDataFrame(rows, DOCS)


@pytest.fixture
def odd_rows():
    """Nulls, empty and very long texts, repeated rows, ties, letters of several scripts."""
    import random

    rng = random.Random(2)
    long_text = prose(rng, 30_000)
    return [doc(1, "one two three four five six"), doc(2, None), doc(3, ""), doc(4, " \n\t "), doc(5, long_text), doc(6, long_text),
            doc(7, "one two three four five six"), doc(7, "one two three four five six"), doc(None, "no name at all here"), doc(8, "Größe été Ωμέγα", source=None),
            doc(9, "short"), doc(9, "another text of the same name"), doc(None, None), doc(10, "12 34 % &")]
