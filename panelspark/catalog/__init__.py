"""Registered queries and their equal SQL."""

from __future__ import annotations

from panelspark.catalog import fill, followup, keys, measures, records, rows, yearly  # noqa: F401
from panelspark.catalog.book import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
