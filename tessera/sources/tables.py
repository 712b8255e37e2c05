"""What a table name stands for: a lazy DataFrame with engine types, and for created tables its staged rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ColumnNotFound, SerializationError, TypeMismatch
from ..functions.lowering import quoted
from ..plans.binder import Field
from ..sql.syntax import ColumnDef
from ..types import accepts, from_spark


def scan(df: DataFrame) -> tuple[DataFrame, list[Field]]:
    """Widen the columns to engine types; those of other types stay and can't be named in a query.

    The casts are no bar to column pruning and pushdown. Of columns whose names are equal, the first counts.
    """
    fields = [Field(f.name, from_spark(f.dataType), f.nullable) for f in df.schema.fields]
    columns = []
    for f, source in zip(fields, df.schema.fields, strict=True):
        c = F.col(quoted(f.name))
        same = f.type is None or f.type.spark == source.dataType
        columns.append(c if same else c.cast(f.type.spark).alias(f.name))
    return df.select(*columns) if len({f.name for f in fields}) == len(fields) else df, fields


class Table:
    """A table over an existing DataFrame."""

    def __init__(self, name: str, df: DataFrame):
        self.name = name
        self._df, self.fields = scan(df)

    def df(self) -> DataFrame:
        return self._df

    def lookup(self, column: str, value: object) -> DataFrame:
        """Rows with a value in a column, exactly; the comparison goes to the file reader."""
        found = next((f for f in self.fields if f.name == column), None)
        if found is None:
            raise ColumnNotFound(column)
        if found.type is None or not accepts(found.type, value):
            raise TypeMismatch(f"column {column} expects {found.type}, got {value!r}")
        return self.df().where(F.col(quoted(column)) == F.lit(value))


class MemoryTable(Table):
    """A created table. Inserted rows are checked at once and staged; a scan sees all of them.

    With ``path`` staged rows go to Parquet there at each ``flush`` (as one append, after a first that replaces), so that a
    table isn't bound by the driver; without it they stay in the driver's memory.
    """

    def __init__(self, spark: SparkSession, name: str, columns: Iterable[ColumnDef], path: str | None = None):
        self.spark, self.name, self.path = spark, name, path
        self.columns = tuple(columns)
        self.fields = [Field(c.name, c.type, c.nullable) for c in self.columns]
        self.schema = T.StructType([T.StructField(c.name, c.type.spark, c.nullable) for c in self.columns])
        self._staged: list[tuple] = []
        self._flushed = False

    def insert(self, rows: Iterable[Iterable[object]]) -> int:
        """Stage rows; all of them or, if one does not fit the schema, none."""
        checked = [self._checked(tuple(r)) for r in rows]
        self._staged += checked
        return len(checked)

    def _checked(self, row: tuple) -> tuple:
        if len(row) != len(self.columns):
            raise SerializationError(f"row has {len(row)} values; {self.name} has {len(self.columns)} columns")
        for c, value in zip(self.columns, row, strict=True):
            if value is None and not c.nullable:
                raise TypeMismatch(f"column {c.name} cannot be NULL")
            if not accepts(c.type, value):
                raise TypeMismatch(f"column {c.name} expects {c.type}, got {value!r}")
        return row

    def flush(self) -> None:
        """Write the staged rows. A created table begins empty, so its first flush, be it of no rows, replaces what is at its path."""
        if self.path and (self._staged or not self._flushed):
            self._frame().write.mode("append" if self._flushed else "overwrite").parquet(self.path)
            self._staged, self._flushed = [], True

    def remove(self) -> None:
        """Drop all rows, and the files that this table has written."""
        self._staged = []
        if self._flushed:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self._flushed = False

    def _frame(self) -> DataFrame:
        return self.spark.createDataFrame(self._staged, self.schema)

    def df(self) -> DataFrame:
        if not self._flushed:
            return self._frame()
        kept = self.spark.read.schema(self.schema).parquet(self.path)
        return kept.unionByName(self._frame()) if self._staged else kept

