"""Readers and writers."""
from opinio.sources.tables import table, DRIVER_TABLES
from opinio.sources.fixture import reviews_raw

__all__ = ["table", "DRIVER_TABLES", "reviews_raw"]
