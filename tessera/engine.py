"""The engine: table names, and statements over them."""

from __future__ import annotations

import warnings
from collections.abc import Iterable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession

from .errors import EvaluationError, InvalidQuery, StorageError, TableNotFound
from .functions.lowering import Lowering
from .operators.relational import run
from .plans.binder import BoundSelect, bind
from .sources.tables import MemoryTable, Table
from .sql import parse
from .sql.syntax import ColumnDef, Create
from .types import INT64, EngineType


class Engine:
    """Tables by exact name, and the dialect's statements over them.

    ``extended`` takes ``float <op> integer`` and orders texts and booleans naturally; ``allow_trailing``
    ignores what follows a statement; ``ieee_nan`` compares NaN and infinities as IEEE 754 has it. ``data_dir``
    is where created tables go when they are flushed, and what ``load`` reads; without it they stay in memory.
    """

    def __init__(self, spark: SparkSession, data_dir: str | None = None, *, extended: bool = False, allow_trailing: bool = False, ieee_nan: bool = False):
        self.spark, self.data_dir, self.extended, self.allow_trailing = spark, data_dir, extended, allow_trailing
        self._lowering = Lowering(extended, ieee_nan)
        self._tables: dict[str, Table] = {}
        spark.conf.set("spark.sql.caseSensitive", "true")
        spark.conf.set("spark.sql.ansi.enabled", "true")

    # -- tables

    def create_table(self, name: str, columns: Iterable[ColumnDef], path: str | None = None) -> MemoryTable:
        """Create an empty table; one of that name is replaced, with a warning, and if it was created here its rows go, flushed ones too."""
        if name in self._tables:
            warnings.warn(f"table {name} is replaced", stacklevel=2)
            self.drop_table(name)
        if path is None and self.data_dir:
            path = f"{self.data_dir.rstrip('/')}/{name}.parquet"
        table = self._tables[name] = MemoryTable(self.spark, name, columns, path)
        return table

    def load(self) -> list[str]:
        """Register every Parquet table of the data folder under its file's name; gives the names."""
        if not self.data_dir:
            raise StorageError("the engine has no data folder")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.data_dir)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [f.getPath() for f in files.listStatus(path)] if files.exists(path) else []
        names = sorted(p.getName().removesuffix(".parquet") for p in found if p.getName().endswith(".parquet"))
        for name in names:
            self.register_parquet(name, f"{self.data_dir.rstrip('/')}/{name}.parquet")
        return names

    def drop_table(self, name: str) -> None:
        """Forget a table. What a created table has flushed is removed; files that were only registered stay."""
        table = self._find(name)
        del self._tables[name]
        if isinstance(table, MemoryTable):
            table.remove()

    def insert(self, name: str, rows: Iterable[Iterable[object]]) -> int:
        """Append rows to a created table, checked against its schema; gives their number."""
        table = self._find(name)
        if not isinstance(table, MemoryTable):
            raise StorageError(f"{name} is read-only")
        return table.insert(rows)

    def flush(self, name: str) -> None:
        """Write a created table's staged rows to its path; the first time, in place of whatever is there."""
        table = self._find(name)
        if isinstance(table, MemoryTable):
            table.flush()

    def register(self, name: str, df: DataFrame) -> None:
        """Give a DataFrame, a streaming one too, a table name."""
        self._tables[name] = Table(name, df)

    def register_parquet(self, name: str, path: str) -> None:
        self.register(name, self.spark.read.parquet(path))

    def table(self, name: str) -> DataFrame:
        """All rows of a table."""
        return self._find(name).df()

    def lookup(self, name: str, column: str, value: object) -> DataFrame:
        """Rows of a table whose column has a value; a null matches nothing."""
        return self._find(name).lookup(column, value)

    def tables(self) -> list[str]:
        return sorted(self._tables)

    def schema(self, name: str) -> list[tuple[str, EngineType | None, bool]]:
        return [(f.name, f.type, f.nullable) for f in self._find(name).fields]

    def _find(self, name: str) -> Table:
        if name not in self._tables:
            raise TableNotFound(name)
        return self._tables[name]

    # -- statements

    def plan(self, text: str) -> BoundSelect:
        """The typed plan of a SELECT."""
        statement = parse(text, self.allow_trailing)
        if isinstance(statement, Create):
            raise InvalidQuery("only a SELECT has a plan")
        return bind(statement, self._find(statement.table).fields, self.extended)

    def sql(self, text: str) -> DataFrame:
        """Run a statement: a lazy DataFrame for SELECT, an empty one for CREATE TABLE."""
        statement = parse(text, self.allow_trailing)
        if isinstance(statement, Create):
            return self.create_table(statement.table, statement.columns).df()
        table = self._find(statement.table)
        return run(bind(statement, table.fields, self.extended), table.df(), self._lowering)

    def rows(self, text: str, limit: int | None = None) -> list[Row]:
        """Run a statement and take its rows to the driver, at most ``limit``; what fails in a row is an EvaluationError."""
        df = self.sql(text)
        try:
            return (df if limit is None else df.limit(limit)).collect()
        except PySparkException as e:
            raise EvaluationError(str(e).splitlines()[0]) from e

    def explain(self, text: str) -> str:
        """The physical plan that Spark picks."""
        return self.sql(text)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def column(name: str, kind: EngineType = INT64, nullable: bool = True) -> ColumnDef:
    """A column for ``Engine.create_table``."""
    return ColumnDef(name, kind, nullable)
