"""A single-table SQL dialect and data engine on Spark."""

from .engine import Engine, column
from .errors import (
    ColumnNotFound,
    EngineError,
    EvaluationError,
    InvalidQuery,
    SerializationError,
    StorageError,
    TableNotFound,
    TypeMismatch,
)
from .sql.syntax import ColumnDef
from .types import BOOL, FLOAT64, INT64, TEXT, TIMESTAMP, EngineType, varchar

__all__ = [
    "BOOL", "FLOAT64", "INT64", "TEXT", "TIMESTAMP", "ColumnDef", "ColumnNotFound", "Engine", "EngineError", "EngineType",
    "EvaluationError", "InvalidQuery", "SerializationError", "StorageError", "TableNotFound", "TypeMismatch", "column", "varchar",
]
