"""Relational operators over DataFrames."""

from .relational import filter_rows, project, run

__all__ = ["filter_rows", "project", "run"]
