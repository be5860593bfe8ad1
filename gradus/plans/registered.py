"""All queries of the library."""

from . import dedup, knowledge, lint, metrics, streams, structure, text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
