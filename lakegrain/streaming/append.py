"""Staged append as a stream: each micro-batch is one committed append of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def append_stream(stream: DataFrame, store: Store, partition: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends what arrives. The checkpoint holds the batches that were committed."""

    def one(batch: DataFrame, number: int) -> None:
        store.append_once(batch, partition, number)  # a batch that was committed before a failure may come again

    w = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
