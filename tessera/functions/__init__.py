"""Typed expressions as Spark columns."""

from .lowering import Lowering

__all__ = ["Lowering"]
