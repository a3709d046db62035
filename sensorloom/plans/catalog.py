"""All named queries: importing the modules registers them."""

from sensorloom.plans import aggregate_queries, base_queries, cluster_queries, model_queries  # noqa: F401
from sensorloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
