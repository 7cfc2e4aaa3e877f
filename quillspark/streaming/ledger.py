"""Streaming views of a ledger folder. The batch summaries and these agree on the same records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions import stats
from quillspark.sources import schemas


def records(spark: SparkSession, folder: str, schema: str | None = None, files_per_trigger: int = 100) -> DataFrame:
    """JSON lines of a folder as they are added."""
    return spark.readStream.schema(schema or schemas.LEDGER).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def distinct(stream: DataFrame, key: list[str], time: str, delay: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark's delay; state for older keys is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def accuracy(stream: DataFrame, by: list[str], correct: str = "correct") -> DataFrame:
    """Running accuracy blocks; write with ``complete`` or ``update``."""
    return stats.with_accuracy(stream.groupBy(*by).agg(*stats.accuracy_block(F.col(correct))))


def windowed(stream: DataFrame, time: str, width: str, by: list[str], value: str, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums in windows of event time; late rows within the delay still count."""
    grouped = stream.withWatermark(time, delay).groupBy(F.window(time, width), *by)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def append_new(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Add all that is there to a stored ledger, a folder for each type, each file's records exactly once; then stop."""
    return stream.writeStream.format("parquet").partitionBy("type").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
