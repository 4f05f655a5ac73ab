"""Registered queries with the SQL they are held against."""

from . import check_queries, index_queries, panel_queries, store_queries, summary_queries, table_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
