"""Transcripts and stage tables as JSON; job stores as Parquet or JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "s double, e double, w string, start double, end double, text string, source string, boundary_only boolean"
SENTENCES = "start double, end double, text string"
SEGMENTS = "segments array<struct<start:double,end:double,text:string,words:array<struct<start:double,end:double,word:string>>>>"
CLAUSES = "clauses array<struct<id:int,start:double,end:double,text:string,usable:boolean,reason:string,`order`:int,split_from:int>>"


def read_words(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """SRC4, SRC17, RSH20: (src, s, e, w, boundary_only, pos) of JSON arrays, one file a source; other spellings of keys are taken too. pos is the place in the file. A file without words is an error when its rows are read."""
    files = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("src"), F.from_json("value", f"array<struct<{WORDS.replace(' ', ':').replace(',:', ',')}>>").alias("ws"))
    empty = F.raise_error(F.concat(F.lit("the transcript has no words: "), "src")).cast(files.schema["ws"].dataType)
    rows = files.withColumn("ws", F.when(F.coalesce(F.size("ws"), F.lit(0)) > 0, F.col("ws")).otherwise(empty)).select("src", F.posexplode_outer("ws").alias("pos", "x")).select("src", "pos", "x.*")
    return rows.select("src", F.coalesce("s", "start").alias("s"), F.coalesce("e", "end").alias("e"), F.coalesce("w", "text").alias("w"), F.coalesce("boundary_only", F.lit(False)).alias("boundary_only"), F.col("pos").cast("long").alias("pos"))


def read_sentences(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.schema(SENTENCES).json(paths, multiLine=True).withColumn("src", F.input_file_name())


def flatten_segments(recognized: DataFrame, job: str) -> tuple[DataFrame, DataFrame]:
    """SRC6: (sentences, words) of recognizer output with nested segments: trimmed, blanks gone, times to three places."""
    seg = recognized.select(job, F.posexplode("segments").alias("k", "g"))
    r = lambda c: F.round(c, 3)
    sentences = seg.select(job, F.col("k").alias("pos"), r(F.col("g.start")).alias("start"), r(F.col("g.end")).alias("end"), F.trim("g.text").alias("text")).where("text <> ''")
    words = seg.select(job, "k", F.posexplode("g.words").alias("i", "x"))
    words = words.select(job, (F.col("k") * 100_000 + F.col("i")).alias("pos"), r(F.col("x.start")).alias("s"), r(F.col("x.end")).alias("e"), F.trim("x.word").alias("w")).where("w <> ''")
    return sentences, words


def read_stage(spark: SparkSession, paths: str | list[str], schema: str, field: str, *, strict: bool) -> DataFrame:
    """SRC18: a stage's list field as rows. strict: a file without the list is an error; else it gives none."""
    files = spark.read.schema(schema).json(paths, multiLine=True).withColumn("path", F.input_file_name())
    if strict:
        files = files.withColumn(field, F.coalesce(F.col(field), F.raise_error(F.concat(F.lit(f"no list `{field}` in "), "path"))))
    return files.select("path", F.inline(field))


def read_store(spark: SparkSession, location: str, table: str, *, driver: str | None = None) -> DataFrame:
    """SRC15: a table of a job store: Parquet below a folder, or over JDBC if location is a JDBC address."""
    if location.startswith("jdbc:"):
        reader = spark.read.format("jdbc").option("url", location).option("dbtable", table)
        return (reader.option("driver", driver) if driver else reader).load()
    return spark.read.parquet(f"{location.rstrip('/')}/{table}")


def json_column(df: DataFrame, column: str, schema: str) -> DataFrame:
    """SCL7: a JSON text column as values; null is an empty object."""
    return df.withColumn(column, F.from_json(F.coalesce(column, F.lit("{}")), schema))
