"""Operators of a training-data pipeline; ``queries`` registers one query for each."""

from clueweave.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
