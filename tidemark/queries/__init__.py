"""All registered queries."""
from . import scoring_queries, split_queries, statistics_queries, stream_queries, temporal_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
