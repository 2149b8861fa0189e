"""Operators of a training-data pipeline. Nothing outside of this folder imports it."""

from tablewright.llm.registry import ORACLES, QUERIES
from tablewright.llm import queries, queries_structured  # noqa: F401  (register)

__all__ = ["ORACLES", "QUERIES"]
