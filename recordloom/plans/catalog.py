"""All queries."""

from recordloom.plans import basic, study  # noqa: F401  (they register themselves)
from recordloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
