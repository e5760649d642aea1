"""Registered queries over the given tables, with the SQL each must agree with."""

from graphloom.catalog import (graph_queries, ranking_queries, relational_queries,  # noqa: F401
                               sql_queries, stream_queries, symbol_queries, text_queries, tool_queries,
                               version_queries, workflow_queries)
from graphloom.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
