"""All registered queries."""

from ledgerloom.catalog import documents, duplicates, functions, ingest, reports, risk, validation  # noqa: F401
from ledgerloom.catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
