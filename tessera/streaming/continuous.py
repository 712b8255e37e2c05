"""Run a query of the dialect on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def start(df: DataFrame, sink: str, checkpoint: str, path: str | None = None, name: str | None = None) -> StreamingQuery:
    """Write a streaming result (``Engine.sql`` over a registered stream) in append mode until all that is there is read."""
    if not df.isStreaming:
        raise ValueError("the query does not read a stream")
    writer = df.writeStream.format(sink).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if name:
        writer = writer.queryName(name)
    return writer.start(path) if path else writer.start()
