"""Queries over the driver's tables, each with its SQL counterpart where SQL can say it."""

from tablewright.catalog.registry import ORACLES, QUERIES
from tablewright.catalog import modelling, preparation, profiling, training  # noqa: F401  (registers)

__all__ = ["ORACLES", "QUERIES"]
