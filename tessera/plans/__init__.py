"""Typed plans."""

from .binder import BoundSelect, Field, bind, bind_expression

__all__ = ["BoundSelect", "Field", "bind", "bind_expression"]
