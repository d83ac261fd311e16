"""Registered queries of the library over the driver's tables."""

from codeloom.plans import corpus_queries, data_queries, graph_queries, more_queries, overview_queries  # noqa: F401
from codeloom.plans.registry import ORACLES, QUERIES  # noqa: F401
