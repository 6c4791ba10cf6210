"""Named query plans over the driver tables and their DuckDB oracle SQL."""

from flockwatch.plans.registry import ORACLE_SQL, QUERIES, flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
