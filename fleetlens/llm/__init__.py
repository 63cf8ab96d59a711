"""Operators of a training-data pipeline, each over whole tables of documents. Nothing else in the library imports this."""

from fleetlens.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
