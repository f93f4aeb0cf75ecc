"""All registered queries."""

from gridspark.plans import field_queries, result_queries, version_queries  # noqa: F401  (registering)
from gridspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
