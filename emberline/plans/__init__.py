"""Named queries over the given tables."""

from . import board_queries, ingest_queries, io_queries, model_queries  # noqa: F401
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
