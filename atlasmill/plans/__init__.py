"""Operators on the driver's tables, each with the SQL that must give the same rows. Importing the modules registers their queries."""

from atlasmill.plans import accounts, queries, runs, scalars, schedules, sources, streams
from atlasmill.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "accounts", "queries", "runs", "scalars", "schedules", "sources", "streams"]
