"""Registered queries over the driver's tables, and their SQL twins."""

from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
