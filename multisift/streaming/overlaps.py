"""The interval plan over micro-batches: each batch of fragments is added to a table, from which the statistics are made anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.atac import amulet


def amulet_stream(fragments: DataFrame, store: str, output: str, checkpoint: str, once: bool = True, **options) -> StreamingQuery:
    """Starts a query that keeps `output` up to date with all fragments seen. A batch that runs again after a failure replaces what it
    wrote before."""

    def update(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")
        seen = spark.read.parquet(store).drop("batch")
        amulet(seen, **options).write.mode("overwrite").parquet(output)

    writer = fragments.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
