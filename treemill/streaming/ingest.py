"""Answers as they arrive: deduplicated within a watermark, written batch by batch without repetition.

Each micro-batch goes to a folder of its own number, so a batch that is run again after a
failure replaces its output instead of adding to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, folder: str, schema, files_a_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def once_each(stream: DataFrame, key: str, time: str, lateness: str) -> DataFrame:
    """The first row of each key; state older than ``lateness`` is dropped, and rows later than that too."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def into_folder(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Runs over all that is there now and stops; starting it again continues behind it."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outcome_windows(stream: DataFrame, time: str, size: str, lateness: str) -> DataFrame:
    """Calls and failures per source and window of event time."""
    rows = stream.withWatermark(time, lateness)
    return rows.groupBy(F.window(time, size), "source").agg(F.count("*").alias("calls"), F.count_if(~F.col("api_success")).alias("failed"))
