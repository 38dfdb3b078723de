"""Results as a stream: rows of run folders as they arrive, each key once, and running accuracy. An extension; batch results are the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Each key once within late of its first row; older state is dropped with the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def running_summary(stream: DataFrame, time: str, window: str = "1 day") -> DataFrame:
    """n, errors and accuracy by window of event time; a window is final once the watermark has passed it."""
    return stream.groupBy(F.window(time, window).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "error").alias("errors"), F.avg(F.col("correct").cast("double")).alias("accuracy")).select("w.start", "n", "errors", "accuracy")


def start(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Append to a Parquet folder, exactly once by its checkpoint; stops when the input there is has been read."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(sink)
