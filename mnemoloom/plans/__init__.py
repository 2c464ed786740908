"""Registered queries: one module for each part of the library."""

from mnemoloom.plans import aggregates, chunking, graph, metrics, retrieval, sources, text  # noqa: F401
from mnemoloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
