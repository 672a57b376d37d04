from . import account_queries, graph_queries, quality_queries, traffic_queries  # noqa: F401
from . import stream_queries  # noqa: F401, I001
from .registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
