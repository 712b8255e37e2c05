"""The SQL front end: lexer, syntax trees, parser."""

from .parser import parse

__all__ = ["parse"]
