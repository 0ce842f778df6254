"""Subtitle files: SRT and VTT, ASS and SSA, and bracketed text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.functions.text import clean_markup, clock_seconds

_CLOCK = r"(?:\d+:)?\d+:\d+[.,]?\d*"


def _blocks(text: Column) -> Column:
    """SRT and VTT: a line of two clocks around an arrow, and the lines up to the next blank one."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    found = F.regexp_extract_all(t, F.lit(rf"(?m)^\s*({_CLOCK}\s*-->\s*{_CLOCK}[^\n]*\n(?:[^\n]*\S[^\n]*(?:\n|\z))*)"), F.lit(1))
    head = rf"({_CLOCK})\s*-->\s*({_CLOCK})[^\n]*\n"
    return F.transform(found, lambda b: F.struct(clock_seconds(F.regexp_extract(b, head, 1)).alias("start"), clock_seconds(F.regexp_extract(b, head, 2)).alias("end"), clean_markup(F.regexp_replace(b, "^" + head, "")).alias("text")))


def _dialogue(text: Column) -> Column:
    """ASS and SSA: the text of a Dialogue line is what follows its ninth comma."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^Dialogue:\s*((?:[^,\n]*,){9}[^\n]*)"), F.lit(1))
    return F.transform(found, lambda b: F.struct(clock_seconds(F.trim(F.get(F.split(b, ",", 10), F.lit(1)))).alias("start"), clock_seconds(F.trim(F.get(F.split(b, ",", 10), F.lit(2)))).alias("end"), clean_markup(F.get(F.split(b, ",", 10), F.lit(9))).alias("text")))


def _bracketed(text: Column) -> Column:
    """Lines of [clock --> clock] text."""
    line = rf"\[({_CLOCK})\s*-->\s*({_CLOCK})\]\s*([^\n]*)"
    found = F.regexp_extract_all(text, F.lit(f"({line})"), F.lit(1))
    return F.transform(found, lambda b: F.struct(clock_seconds(F.regexp_extract(b, line, 1)).alias("start"), clock_seconds(F.regexp_extract(b, line, 2)).alias("end"), clean_markup(F.regexp_extract(b, line, 3)).alias("text")))


def parse_subtitles(files: DataFrame, *, path: str = "path", content: str = "content") -> DataFrame:
    """SRC1, SRC2: (path, pos, start, end, text) of whole files; rows of empty text or no length go.

    The suffix decides for ASS and SSA; else blocks, and bracketed lines if a file has no block.
    """
    t = F.col(content)
    rows = F.when(F.lower(path).rlike(r"\.(ass|ssa)$"), _dialogue(t)).when(F.size(_blocks(t)) > 0, _blocks(t)).otherwise(_bracketed(t))
    each = files.select(path, F.posexplode(rows).alias("pos", "b"))
    return each.select(path, "pos", "b.*").where("text <> '' and end > start")


def read_subtitles(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """SRC1 from files or folders."""
    files = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    return parse_subtitles(files)


def words_of_blocks(blocks: DataFrame, job: str = "path") -> DataFrame:
    """SRC3: blocks as words whose bounds alone are known."""
    return blocks.where("text <> ''").select(job, "pos", F.col("start").alias("s"), F.col("end").alias("e"), F.col("text").alias("w"), F.lit(True).alias("boundary_only"))
