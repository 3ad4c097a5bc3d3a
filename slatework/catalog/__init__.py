"""All registered queries."""

from slatework.catalog.base import ORACLES, QUERIES
from slatework.catalog import aggregate_queries, bundle_queries, column_queries, evaluation_queries, history_queries, join_queries, model_queries, name_queries, slate_queries, source_queries  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
