"""What the operators share: input columns, blocks of texts, words, and the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that a Python worker handles at once (a longer text is a block of its own).
BLOCK = 2 << 20
#: The six ASCII white-space bytes; every other byte is part of a word.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows of an Arrow batch in the registered queries. Texts can be long, and a batch is held whole on either side of the socket.
BATCH_ROWS = 250


def small_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to at most ``BATCH_ROWS`` rows. The queries and the pipeline, which own their session, do so; operators leave it as it is."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def to_python(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` by workers that give their memory back when they are done."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return rows.mapInArrow(tidy, schema)


def release() -> None:
    """Return freed memory to the system: a worker lives on after its task, beside those of other steps."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def keyed_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that most operators need, as (doc_id, text); whatever else the input has stays behind."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``size`` bytes of the column, whatever the batches' sizes."""
    for batch in batches:
        lengths = np.diff(flat(batch.column(column))[1])
        start, total = 0, 0
        for i, n in enumerate(lengths):
            if i > start and total + n > size:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if batch.num_rows:
            yield batch.slice(start)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes, end to end, and the n + 1 offsets of its texts in them (null: empty)."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()).cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_texts(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes (null: empty)."""
    data, offsets = flat(column)
    raw, ends = data.tobytes(), offsets.tolist()
    return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


class Numbering(dict):
    """Numbers 0, 1, ... for keys as they first come up."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def word_ids(texts: list[bytes], table: dict) -> tuple[np.ndarray, np.ndarray]:
    """Table values of all words of the texts, end to end, and the n + 1 offsets of the texts' words."""
    words, counts = [], [0]
    for t in texts:
        words += t.split()
        counts.append(len(words))
    return np.fromiter(map(table.__getitem__, words), np.int64, len(words)), np.asarray(counts, np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers, the same in every process."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


@cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def shared_folder(spark: SparkSession) -> str:
    """A new folder, not yet made, in the place that driver and executors share: the one that the cluster names, else
    the warehouse, or in local mode, where there is one machine only, a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = _own_folder() if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local" else f"{spark.conf.get('spark.sql.warehouse.dir')}/tessera"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read back: lineage ends here, and a lost executor costs nothing."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    _STORED.add(path)
    frame = df.sparkSession.read.schema(df.schema).parquet(path)
    frame.stored_at = path
    return frame


#: Folders of this process's tables that are still there.
_STORED: set[str] = set()


def forget(*frames: DataFrame) -> None:
    """Remove the tables behind ``stored`` frames that nothing reads any more: what was made of them is written itself."""
    for frame in frames:
        _remove(frame.sparkSession, frame.stored_at)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Removes the tables that were stored inside it, but for those in the list that it gives."""
    before, keep = set(_STORED), []
    yield keep
    for path in _STORED - before - {frame.stored_at for frame in keep}:
        _remove(spark, path)


def forget_all(spark: SparkSession) -> None:
    """Remove every table that this process stored. Results that are still lazy can't be computed after this."""
    for path in list(_STORED):
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _STORED.discard(path)


#: A key is hot if it has more than one in so many of all rows, and this many at least.
HOT_KEYS = 1000
HOT_LEAST = 64


def hot_limit(total: int) -> int:
    return max(total // HOT_KEYS, HOT_LEAST)


def joined(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Stored rows joined with a table that has one row for each key. Hot keys, at most ``HOT_KEYS`` of them, are joined by broadcast, so that no task gets all rows of one."""
    hot = rows.groupBy(key).agg(F.count("*").alias("__times")).where(F.col("__times") > hot_limit(rows.count())).select(key)
    few = F.broadcast(table.join(F.broadcast(hot), key))
    return rows.join(few, key).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(table, key))


#: Copies of a row that are made at once.
COPIES = 1 << 14


def repeated(rows: DataFrame, times: str, number: str) -> DataFrame:
    """Each row ``times`` times, numbered from 0; copies are made in pieces, so that no array is as long as their number."""
    pieces = rows.withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / COPIES).cast("long"))))
    first = F.col("__piece") * COPIES
    return pieces.withColumn(number, F.explode(F.sequence(first, F.least(first + COPIES, F.col(times)) - 1))).drop("__piece")


def total_bytes(df: DataFrame, column: str) -> int:
    return df.agg(F.coalesce(F.sum(F.octet_length(column).cast("long")), F.lit(0))).first()[0]
