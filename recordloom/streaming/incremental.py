"""An incremental append as a stream: each micro-batch adds the rows whose keys the table lacks.

The pipelines this library covers have no streams; this is the batch operator
append_new() under Structured Streaming, for sources that grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from recordloom.sources.files import append_new


def append_stream(rows: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Start the stream over what is there now; it ends when that is done."""
    writer = rows.writeStream.foreachBatch(lambda batch, _: append_new(batch.dropDuplicates(keys), path, keys) and None)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
