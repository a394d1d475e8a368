"""A stream of vertex or edge rows into a bulk load, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.bulk import BulkLoad


def follow(load: BulkLoad, kind: str, rows: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Each micro-batch is a chunk named by its number, so a batch that is run again replaces itself."""
    writer = rows.writeStream.foreachBatch(lambda df, n: load.add(kind, f"stream-{n}", df)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
