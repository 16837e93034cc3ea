"""Streaming forms of the log operators: files arrive in a folder, results leave by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How late a row may come and still count in the live view; later ones are only in the raw log.
LATENESS = "10 minutes"


def arriving(spark: SparkSession, folder: str, schema, files_per_batch: int = 64) -> DataFrame:
    """Stream of the Parquet files that arrive in ``folder``; the schema is given, never inferred."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def once(stream: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """The stream without repeated deliveries that come within LATENESS of each other."""
    return stream.withWatermark(ts, LATENESS).dropDuplicatesWithinWatermark([key])


def hourly(responses: DataFrame) -> DataFrame:
    """Per hour of event time: responses, failures, mean total time (NaN and null left out)."""
    total = F.when(~F.isnan("timings.total"), F.col("timings.total"))
    rows = responses.withWatermark("ts", LATENESS).groupBy(F.window("ts", "1 hour").start.alias("hour"))
    return rows.agg(F.count("*").alias("n"), F.count_if(~F.col("success")).alias("errors"), F.avg(total).alias("latency"))


def drain(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Writes all that has arrived to Parquet and stops; run again, it goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
