"""Rules over tables that keep arriving: each micro-batch is scanned by itself, its findings go to a folder of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def scan_stream(stream: DataFrame, rule: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that writes the findings of each batch to a folder of its own, so a batch done again replaces
    what it wrote before."""

    def each(batch: DataFrame, number: int) -> None:
        rule(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
