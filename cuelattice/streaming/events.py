"""Job events as a stream: an extra beyond batch parity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tail_events(spark: SparkSession, path: str, schema: str, *, files_per_batch: int = 100) -> DataFrame:
    """SNK2's log as a stream of its Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def distinct_events(events: DataFrame, *, key: str = "id", at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each event once; ids are remembered as long as events may be late."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def kind_counts(events: DataFrame, *, at: str = "ts", kind: str = "kind", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events of each kind in tumbling windows, final once the watermark has passed."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("best")).select(F.col("window.start").alias("start"), kind, "n", "best")


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet; the checkpoint lies in storage that all machines share."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
