"""Streaming resolver: each micro-batch of points is resolved against the static tables and written by foreachBatch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.resolve import flat, resolve


def resolve_stream(points: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """points: stream of key, lat, lon. Resolution is stateless; batches are idempotent by their number."""

    def one(batch: DataFrame, number: int) -> None:
        flat(resolve(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return points.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
