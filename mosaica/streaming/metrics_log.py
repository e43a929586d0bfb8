"""A growing log of training metrics, fed by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from mosaica.sources.sinks import append_metrics


def log_metrics(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each batch of a stream of epoch metrics as JSON lines below `path`, once however often it is tried; undefined values are left out. Runs over what is there, then ends."""
    return stream.writeStream.foreachBatch(lambda df, batch: append_metrics(df, path, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
