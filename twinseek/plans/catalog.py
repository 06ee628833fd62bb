"""The registered queries of the retrieval engine and the SQL that checks each of them."""

from __future__ import annotations

from . import eval_queries, search_queries, table_queries, text_queries
from .base import ORACLES, QUERIES


def flagship(spark, sf_dir):
    return QUERIES["rrf3"](spark, sf_dir)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)


__all__ = ["flagship", "oracle_sql", "queries", "eval_queries", "search_queries", "table_queries", "text_queries"]
