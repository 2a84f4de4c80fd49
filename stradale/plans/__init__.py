"""Derived views over the sample tables, and the queries with their SQL twins."""

from . import more  # noqa: F401  registers its queries
from .queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
