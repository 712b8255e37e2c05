"""The dialect over unbounded input: each query is a filter and a projection, so it holds no state."""

from .continuous import start

__all__ = ["start"]
