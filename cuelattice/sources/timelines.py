"""Edit timelines: native ones and editor drafts, flattened to intervals on two clocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DRAFT = (
    "materials struct<videos:array<struct<id:string,path:string>>,speeds:array<struct<id:string,speed:double>>>,"
    "tracks array<struct<type:string,segments:array<struct<material_id:string,source_timerange:struct<start:bigint,duration:bigint>,"
    "target_timerange:struct<start:bigint,duration:bigint>,extra_material_refs:array<string>>>>>,"
    "segments array<struct<segment_id:string,timeline_start:double,timeline_end:double,source_path:string,source_start:double,source_end:double,speed:double>>"
)


def read_timelines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """SRC8, SRC11: draft and native files by what they hold; files that can't be read keep their text in _corrupt_record."""
    return spark.read.schema(DRAFT + ", _corrupt_record string").json(paths, multiLine=True, mode="PERMISSIVE").withColumn("job", F.input_file_name())


def seconds(micros: str) -> F.Column:
    """Microseconds as seconds; numbers up to 10 000 are seconds already."""
    return F.when(F.col(micros) > 10_000, F.col(micros) / 1e6).otherwise(F.col(micros).cast("double"))


def flatten_draft(drafts: DataFrame, job: str = "job") -> DataFrame:
    """SRC9: (job, segment_id, timeline_start, timeline_end, source_path, source_start, source_end, speed).

    The first video or mixed track that has segments; segments whose material exists; a segment's speed is the first of
    its references that is a speed, else its source over its target. Ids count the segments that stay, rows are in the
    order of the timeline.
    """
    tracks = F.filter("tracks", lambda t: t["type"].isin("video", "mix", "mixed") & (F.size(t["segments"]) > 0))
    seg = drafts.select(job, F.posexplode(F.get(tracks, F.lit(0))["segments"]).alias("k", "g"))
    videos = drafts.select(job, F.inline("materials.videos")).groupBy(job, F.col("id").alias("material")).agg(F.min("path").alias("source_path"))
    refs = seg.select(job, "k", F.posexplode("g.extra_material_refs").alias("r", "ref"))
    speeds = drafts.select(job, F.inline("materials.speeds")).select(job, F.col("id").alias("ref"), "speed").where("speed > 0")
    speed = refs.join(speeds, [job, "ref"]).groupBy(job, "k").agg(F.min_by("speed", "r").alias("speed"))
    x = seg.select(job, "k", F.col("g.material_id").alias("material"), F.col("g.source_timerange.start").alias("ss"), F.col("g.source_timerange.duration").alias("sd"), F.col("g.target_timerange.start").alias("ts"), F.col("g.target_timerange.duration").alias("td"))
    x = x.join(videos, [job, "material"]).join(speed, [job, "k"], "left")
    ratio = F.try_divide(F.col("sd").cast("double"), F.col("td").cast("double"))
    number = F.row_number().over(Window.partitionBy(job).orderBy("k"))
    return x.select(
        job, F.concat(F.lit("seg_"), F.lpad(number.cast("string"), 3, "0")).alias("segment_id"), seconds("ts").alias("timeline_start"), (seconds("ts") + seconds("td")).alias("timeline_end"),
        "source_path", seconds("ss").alias("source_start"), (seconds("ss") + seconds("sd")).alias("source_end"), F.coalesce("speed", ratio, F.lit(1.0)).alias("speed"),
    )


def flatten_native(files: DataFrame, job: str = "job") -> DataFrame:
    """RSH6: native segments; a speed that is missing, or 1 though the lengths differ, is source over timeline."""
    x = files.select(job, F.inline("segments")).where("timeline_start is not null")
    source, target = F.col("source_end") - F.col("source_start"), F.col("timeline_end") - F.col("timeline_start")
    wrong = F.coalesce(F.col("speed"), F.lit(0.0)) <= 0
    doubt = (F.abs(F.col("speed") - 1) < 1e-6) & (F.abs(source - target) > 0.05)
    return x.withColumn("speed", F.round(F.when(wrong | doubt, F.coalesce(F.try_divide(source, target), F.lit(1.0))).otherwise(F.col("speed")), 4))


def checked(segments: DataFrame, job: str = "job", *, gap: float = 0.002, ratio: tuple[float, float] = (0.125, 8.0), tolerance: float = 0.01) -> DataFrame:
    """SRC10: segments with the exact ratio as speed, and problem: gap, ratio, speed, source_order, or null."""
    before = F.lag("timeline_end").over(Window.partitionBy(job).orderBy("timeline_start"))
    exact = F.try_divide(F.col("source_end") - F.col("source_start"), F.col("timeline_end") - F.col("timeline_start"))
    problem = (
        F.when(F.abs(F.col("timeline_start") - before) > gap, "gap").when(exact.isNull() | ~exact.between(*ratio), "ratio").when(F.abs(exact - F.col("speed")) > tolerance, "speed").when((F.col("source_start") < 0) | (F.col("source_end") <= F.col("source_start")), "source_order")
    )
    return segments.withColumns({"problem": problem, "speed": F.coalesce(exact, F.col("speed"))})


def read_registry(spark: SparkSession, paths: str | list[str], schema: str = "id string, name string, path string, modified double, signature string") -> DataFrame:
    return spark.read.schema(schema).json(paths, multiLine=True)


def cached_summaries(drafts: DataFrame, cache: DataFrame, timelines: DataFrame) -> DataFrame:
    """SRC12, RSH8: drafts with the longest timeline recommended, newest first; what the cache has under the same signature is not computed anew."""
    known = drafts.join(cache.select("id", "signature", "recommended", "total_duration"), ["id", "signature"], "left")
    fresh = timelines.groupBy("id").agg(F.max_by("timeline", F.struct("total_duration", "timeline")).alias("_best"), F.max("total_duration").alias("_most"))
    out = known.join(fresh, "id", "left").withColumns({"recommended": F.coalesce("recommended", "_best"), "total_duration": F.coalesce("total_duration", "_most")})
    return out.drop("_best", "_most").orderBy(F.col("modified").desc(), "id")


def timeline_layout(layouts: DataFrame, job: str = "job") -> DataFrame:
    """RSH7: parallel lists of ids and names as rows, each id once; a missing name is the id."""
    each = layouts.select(job, F.posexplode(F.arrays_zip("ids", "names")).alias("pos", "x")).select(job, "pos", F.col("x.ids").alias("id"), F.coalesce(F.nullif("x.names", F.lit("")), "x.ids").alias("name")).where("id is not null")
    return each.withColumn("_k", F.row_number().over(Window.partitionBy(job, "id").orderBy("pos"))).where("_k = 1").drop("_k")
