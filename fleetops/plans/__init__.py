"""Operators bound to the driver's tables."""

from fleetops.plans import aggregate_plans, function_plans, graph_plans, io_plans, join_plans, window_plans  # noqa: F401
from fleetops.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
