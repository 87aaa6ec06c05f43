"""Incremental evaluation: new files are read once, however often the stream is started."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T


def incremental(spark: SparkSession, source: str, schema: T.StructType, target: str, state: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, files_per_batch: int = 64) -> None:
    """Append transform(new rows of source) to target until all files are read.

    Each batch goes to a folder of its own and overwrites it, so a batch that is repeated after
    a failure adds no rows twice.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
