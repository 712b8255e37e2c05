"""Error taxonomy of the engine: every failure a caller can see is an EngineError."""


class EngineError(Exception):
    """Base of all errors; ``prefix`` names the category in the message."""

    prefix = "Error"

    def __init__(self, message: str):
        super().__init__(f"{self.prefix}: {message}")
        self.message = message


class StorageError(EngineError):
    prefix = "IO error"


class SerializationError(EngineError):
    prefix = "Serialization error"


class TableNotFound(EngineError):
    prefix = "Table not found"


class ColumnNotFound(EngineError):
    prefix = "Column not found"


class TypeMismatch(EngineError):
    prefix = "Type mismatch"


class InvalidQuery(EngineError):
    prefix = "Invalid query"


class EvaluationError(EngineError):
    prefix = "Evaluation error"
