"""Sinks: whole tables, event logs, edit-decision tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """SNK1: a table as Parquet, JSON or ORC; Spark's committer shows all of it or none."""
    df.write.mode("overwrite").format(kind).save(path)


def append_events(df: DataFrame, path: str, *, after: int, order: list[str]) -> None:
    """SNK2: events appended with ids after the greatest so far, in the order given."""
    numbered = df.withColumn("id", F.row_number().over(Window.orderBy(*order)) + after)
    numbered.write.mode("append").parquet(path)


def edit_decisions(segments: DataFrame, job: str, order: str) -> DataFrame:
    """SNK7: what a renderer needs: cuts in order with source bounds and speed."""
    n = F.row_number().over(Window.partitionBy(job).orderBy(order))
    return segments.select(job, n.alias("cut"), "source_path", F.round("source_start", 3).alias("source_start"), F.round("source_end", 3).alias("source_end"), F.round("speed", 4).alias("speed"))
