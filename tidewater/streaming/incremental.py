"""The incremental stages as a stream (beyond what the report engine itself needs)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def stream_new(spark: SparkSession, source: str, schema: str, step: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> None:
    """Runs `step` over the files of `source` that the checkpoint hasn't seen, appends to `sink`
    once for each batch, and ends when all are done. A batch that is repeated after a failure
    overwrites its own folder, so no row comes twice."""

    def each(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    files = spark.readStream.schema(schema).parquet(source)
    files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
