"""Streaming ingest: micro-batches of operations into a table of versions or a compacting store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators.state import resolve
from siltstone.operators.store import Store


def append_batches(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append each micro-batch's newest version of every key, under the batch's number.

    A batch writes its own folder in overwrite mode, so a batch that is run again
    after a failure leaves the same rows.
    """

    def sink(batch: DataFrame, number: int) -> None:
        newest = resolve(batch, keep_tombstones=True)
        newest.sortWithinPartitions("k").write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def into_store(stream: DataFrame, store: Store, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Flush each micro-batch to a store, which compacts as its levels fill.

    A batch that is run again after a failure leaves the state as it is.  Where batches
    may come out of the order of seq, the store must be one made with ``in_order=False``.
    """
    writer = stream.writeStream.foreachBatch(lambda batch, _: store.flush(batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """(k, v, seq) of the live keys of all batches."""
    return resolve(spark.read.parquet(path).select("k", "op", "v", "seq", F.lit(None).cast("string").alias("k2")))
