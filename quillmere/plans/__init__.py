"""Registered queries over the standard tables, each with the SQL that must give the same rows."""

from . import audits, density, geometry, inference, ingest, partition, records, relational, schedules, softlabels, statistics  # noqa: F401  (they register their queries)
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
