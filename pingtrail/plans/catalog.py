"""Loads every query module into the registry."""

from pingtrail.plans import queries_events, queries_groups, queries_nodes, queries_rows  # noqa: F401
from pingtrail.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
