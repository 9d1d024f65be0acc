"""The core's queries: importing the operators registers them."""

from textmill.operators import agreement, constraints, inference, metrics, rows, scores, vectors, views  # noqa: F401
from textmill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
