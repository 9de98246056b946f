"""Queries over the given tables, each next to the SQL that must give the same rows."""

from . import scalars, pixels, energy, parcels, lookups, learning  # noqa: F401, I001
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
