"""All registered queries."""

from emberlog.plans import gate_queries, gateway_queries, report_queries, stream_queries, text_queries  # noqa: F401
from emberlog.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
