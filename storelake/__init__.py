"""storelake: retail analytics and stock ledger operators on PySpark DataFrames."""

from storelake.sources.tables import Tables, read_tables, write_tables

__all__ = ["Tables", "read_tables", "write_tables"]
