"""A stream of element changes applied to a stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def apply_batch(store, batch: DataFrame, order: str = "seq"):
    """Last change per element, as one upsert and one published version. The store keeps each
    element's sequence number: an older change that comes in a later batch is ignored, and
    applying a batch again gives the same index, so a restarted stream does no harm."""
    return store.upsert(batch, order=order)


def index_stream(changes: DataFrame, store, checkpoint: str, order: str = "seq", trigger: dict | None = None) -> StreamingQuery:
    """Starts the stream. `changes` has the element columns and a sequence column (a number or an array of numbers)."""

    def run(batch: DataFrame, _: int) -> None:
        apply_batch(store, batch, order)

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
