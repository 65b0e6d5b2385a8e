"""Queries over the given tables, each next to the SQL it is checked against."""

from . import chart_queries, cleaning_queries, model_queries, preparation_queries, profile_queries, project_queries, source_queries, statistics_queries, stream_queries, wide_queries  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
