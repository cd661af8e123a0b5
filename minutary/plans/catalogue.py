"""All registered queries of the engine, with their SQL."""

from __future__ import annotations

from . import candidates, matching, operations, store, texts  # noqa: F401  (each registers its queries)
from .registry import QUERIES, SQL


def flagship(spark, sf_dir):
    return QUERIES["match_b_decision"](spark, sf_dir)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
