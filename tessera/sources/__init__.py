"""Tables: scans of files, and rows that callers insert."""

from .tables import MemoryTable, Table, scan

__all__ = ["MemoryTable", "Table", "scan"]
