from .registry import QUERIES
from . import q_audit, q_compare, q_graph, q_inference, q_intervals, q_ledger, q_population, q_ranking, q_sources, q_streaming  # noqa: F401

__all__ = ["QUERIES"]
