"""All registered queries."""

from tidemark.plans import frequency_queries, model_queries, score_queries, series_queries, shape_queries, source_queries, stream_queries  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
