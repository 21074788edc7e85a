"""Checked queries over the test tables, one or more per operator."""

from catalog import base, label_queries, profile_queries, record_queries, retrieval_queries, source_queries, text_queries  # noqa: F401


def queries():
    return dict(base.QUERIES)


def oracle_sql():
    return dict(base.ORACLES)
