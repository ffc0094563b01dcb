"""Imports every query module so that the registry is complete."""

from panelcast.plans import core_queries, invariant_queries, model_queries, scale_queries, stats_queries, tuning_queries  # noqa: F401
from panelcast.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
