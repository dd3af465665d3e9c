"""A stream of documents into an index directory: each micro-batch is a segment and a commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.fields import Field
from ..sources.store import Store


def ingest(stream: DataFrame, path: str, key: str, fields: list[Field], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start the stream. A batch's segment is named by its number, so a batch that runs again after
    a failure replaces itself; a document that comes again replaces its former version. Back-pressure is the source's (maxFilesPerTrigger and the like)."""

    def batch(df: DataFrame, number: int) -> None:
        Store(df.sparkSession, path).write(df, key, fields, mode="update", segment=f"batch-{number:012d}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
