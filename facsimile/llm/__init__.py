"""Operators of a training-data pipeline."""

from facsimile.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
