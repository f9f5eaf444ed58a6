"""Streaming upserts into a table.

Each micro-batch becomes one generation. The manifest records (query, batch), so a
batch that is run again after a failure is skipped if it was committed, and replaced
if it was not. Late points are upserts like any others: there is no watermark.
"""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemill.sources.table import Table


def ingest(points: DataFrame, table: Table, checkpoint: str, name: str = "ingest") -> StreamingQuery:
    """Starts a query that takes all available (timestamp, value, seq) rows."""

    def commit(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            table.add_run(batch, name, batch_id)

    return points.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
