"""Gates, verdicts and record shapes at the edges of a pipeline; the boundary to models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window

from cuelattice.operators.sets import coverage


def mapped_characters(text: Column, table: dict[str, str]) -> Column:
    """STR6, STR7: characters by a table of one to one (script variants, toneless syllables); others pass."""
    single = {k: v for k, v in table.items() if len(v) == 1}
    out = F.translate(F.coalesce(text, F.lit("")), "".join(single), "".join(single.values())) if single else F.coalesce(text, F.lit(""))
    for k, v in table.items():
        if len(v) != 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def without_numerals(key: Column) -> Column:
    """STR11: a normal key without digits and Chinese numerals."""
    return F.translate(key, "0123456789零一二三四五六七八九十百千万两", "")


def numerals_alone_differ(expected: Column, actual: Column, similarity: Column, least: float) -> Column:
    """STR11: texts whose difference lies in their numerals; similarity is of the keys without them."""
    a, b = without_numerals(expected), without_numerals(actual)
    return (expected != actual) & (a != "") & ((a == b) | (similarity >= least))


def diagnosis(coverage_: Column, similarity: Column, *, low: float = 0.5, fair: float = 0.86) -> Column:
    """STR12: what an alignment's figures say."""
    return F.when(coverage_ < low, "not_found").when(similarity < fair, "text_differs").otherwise("fine")


def clean_tokens(tokens: Column) -> Column:
    """STR17: trimmed, without blanks, each once in order."""
    return F.array_distinct(F.filter(F.transform(tokens, lambda t: F.trim(t)), lambda t: t != ""))


def cut_window(start: Column, end: Column, preroll: float) -> tuple[Column, Column]:
    """SCL14: where a decoder seeks to, and how far into that the cut begins."""
    seek = F.greatest(F.lit(0), start - preroll)
    return seek, start - seek


def even_size(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """SCL14: a frame scaled down to a greatest side, both sides even."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    even = lambda x: (F.floor(x * scale / 2) * 2).cast("long")
    return even(width), even(height)


def verdict(answer: Column, confidence: Column, score: Column, *, least: float = 0.6) -> Column:
    """SCL17: an external answer as (usable, score of 100): not sure enough is null."""
    return F.struct(F.when(confidence >= least, answer).alias("usable"), F.least(F.lit(100), score * 25).cast("long").alias("score"))


def typed_answers(answers: Column, fields: dict[str, str]) -> Column:
    """SCL9: a map of answers as a struct of the wanted types; what doesn't fit is null."""
    return F.struct(*[answers[k].try_cast(t).alias(k) for k, t in fields.items()])


def cache_key(*parts: Column) -> Column:
    """SCL6: one key of everything a result depends on; null differs from empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("~")) for p in parts]), 256)


def file_fingerprints(spark: SparkSession, paths: str | list[str], sample: int = 1 << 20) -> DataFrame:
    """SCL5: (path, length, modificationTime, digest) with a digest of each file's first and last bytes."""
    files = spark.read.format("binaryFile").load(paths)
    ends = F.concat(F.expr(f"substring(content, 1, {sample})"), F.expr(f"substring(content, greatest(1, length(content) - {sample} + 1), {sample})"))
    return files.select("path", "length", "modificationTime", F.sha2(ends, 256).alias("digest"))


def quality_rollup(samples: DataFrame, keys: list[str], *, sharp: str = "sharpness", light: str = "brightness", flag: str = "flag") -> DataFrame:
    """SCL15: image measures of a segment's samples: least and mean, and the set of flags."""
    return samples.groupBy(*keys).agg(F.min(sharp).alias("least_sharp"), F.avg(light).alias("mean_light"), F.array_sort(F.collect_set(flag)).alias("flags"))


def pick_problems(picks: DataFrame, job: str, pos: str, *, least: float, most: float, roles: list[str], most_hooks: int = 3) -> DataFrame:
    """RSH4: picks with their module (hooks hook_A, hook_B, … in order, else body) and problems as an array."""
    hook = (F.col("role") == "hook") & F.col("module").isNull()
    k = F.sum(F.when(hook, 1).otherwise(0)).over(Window.partitionBy(job).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    rows = picks.withColumn("module", F.coalesce("module", F.when(hook, F.concat(F.lit("hook_"), F.char(64 + k))).otherwise("body")))
    length = F.col("end") - F.col("start")
    hooks = F.size(F.collect_set(F.when(F.col("module").startswith("hook"), F.col("module"))).over(Window.partitionBy(job)))
    body = F.max(F.col("module") == "body").over(Window.partitionBy(job))
    bad = lambda c, code: F.when(c, F.lit(code))
    return rows.withColumn("problems", F.array_compact(F.array(
        bad(F.col("src") != 1, "source"), bad(~F.col("role").isin(roles), "role"), bad(F.trim(F.coalesce("text", F.lit(""))) == "", "empty"), bad((length < least) | (length > most), "length"), bad(hooks > most_hooks, "too_many_hooks"), bad(~body, "no_body"),
    )))


def input_problems(rows: DataFrame, *, title: str, transcript: str, likes: str, duration: str, least_chars: int = 20) -> DataFrame:
    """RSH13: rows with what is wrong with them, as an array."""
    bad = lambda c, code: F.when(F.coalesce(c, F.lit(True)), F.lit(code))
    return rows.withColumn("problems", F.array_compact(F.array(bad(F.trim(title) == "", "title"), bad(F.length(F.trim(transcript)) < least_chars, "transcript"), bad(F.col(likes) < 0, "likes"), bad(F.col(duration) <= 0, "duration"))))


def best_window(windows: DataFrame, keys: list[str], order: str, score: str, *, least: float = 0.5) -> DataFrame:
    """RSH16: the first window that scores at least so much, else the best one."""
    good = F.col(score) >= least
    return windows.groupBy(*keys).agg(F.coalesce(F.min(F.when(good, F.col(order))), F.max_by(order, F.struct(F.col(score), -F.col(order)))).alias(order))


def text_between(marks: DataFrame, keys: list[str], order: str, at: str, text: str, low: str, high: str) -> DataFrame:
    """RSH17: what is said between two times, in order."""
    inside = marks.where((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high)))
    return inside.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), "").alias(text))


def uncovered(units: DataFrame, pieces: DataFrame, keys: list[str], length: Column, piece: Column, *, tolerance: float) -> DataFrame:
    """RSH19: units whose pieces don't add up to their length."""
    total = pieces.withColumn("_p", piece).groupBy(*keys).agg(F.sum("_p").alias("_sum"))
    return units.withColumn("_len", length).join(total, keys, "left").where(F.abs(F.coalesce("_sum", F.lit(0)) - F.col("_len")) > tolerance).select(*keys)


def restored_sentences(words: DataFrame, ranges: DataFrame, job: str = "job") -> DataFrame:
    """EXT8: ranges of word numbers (job, first, last) as sentences, with whether they follow one another without a gap."""
    held = words.join(ranges, job).where(F.col("pos").between(F.col("first"), F.col("last")))
    out = held.groupBy(job, "first", "last").agg(F.min("s").alias("start"), F.max("e").alias("end"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]), "").alias("text"))
    return out.withColumn("contiguous", F.coalesce(F.col("first") == F.lag("last").over(Window.partitionBy(job).orderBy("first")) + 1, F.lit(True)))


def released(plans: DataFrame, reviews: DataFrame, job: str, digest: str, *, most_attempts: int = 3) -> DataFrame:
    """EXT6, PIPE3: plans whose latest review is of the same digest and passed, or was the last attempt allowed."""
    last = reviews.groupBy(job).agg(F.max_by(F.struct(digest, "passed", "attempt"), "attempt").alias("_r"))
    ok = (F.col(f"_r.{digest}") == F.col(digest)) & (F.col("_r.passed") | (F.col("_r.attempt") >= most_attempts))
    return plans.join(last, job, "left").withColumn("state", F.when(ok & F.col("_r.passed"), "passed").when(ok, "limit_released").otherwise("held")).drop("_r")


def drop_repairs(plan: DataFrame, issues: DataFrame, job: str = "job", *, low: float, high: float) -> DataFrame:
    """EXT6: plan rows (job, id, start, end, needs) with excluded and repair, from a review's issues (job, ids, action).

    Rows that an issue says to drop or replace are excluded. If a job's issues only say drop, what stays is between low and
    high seconds and needs nothing that goes, the repair is delete_only: the plan without the excluded rows. Else it is
    compose, which makes a new order without them. A job without issues has a null repair; an action that is null counts as
    another one.
    """
    gone = F.array_distinct(F.flatten(F.collect_list(F.when(F.col("action").isin("drop", "replace"), F.col("ids")))))
    per = issues.groupBy(job).agg(F.every(F.coalesce(F.col("action") == "drop", F.lit(False))).alias("_only"), gone.alias("_gone"))
    rows = plan.join(per, job, "left").withColumn("excluded", F.coalesce(F.array_contains("_gone", F.col("id")), F.lit(False)))
    w, stays = Window.partitionBy(job), ~F.col("excluded")
    length = F.coalesce(F.sum(F.when(stays, F.col("end") - F.col("start"))).over(w), F.lit(0.0))
    torn = F.max(stays & F.coalesce(F.arrays_overlap("needs", "_gone"), F.lit(False))).over(w)
    rows = rows.withColumn("_ok", F.col("_only") & length.between(low, high) & ~torn)
    return rows.withColumn("repair", F.when(F.col("_ok"), "delete_only").when(F.col("_only").isNotNull(), "compose")).drop("_only", "_gone", "_ok")


def reuse_or_compute(inputs: DataFrame, stored: DataFrame, compute: Callable[[DataFrame], DataFrame], *, job: str = "job", digest: str = "digest") -> DataFrame:
    """PIPE3: a stage's results, of which only those of jobs whose digest is not among the stored ones are computed.

    inputs has a row for each job with the digest of what the stage reads; stored and what compute gives are results with job
    and digest, any number of rows for each. A null digest is computed anew. A job whose stored results are empty is too.
    """
    keys = [job, digest]
    held = stored.join(inputs.select(keys).distinct(), keys, "left_semi")
    return held.unionByName(compute(inputs.join(stored.select(keys).distinct(), keys, "left_anti")))


# The reports that the steps of a run write.
STEP_REPORTS = {
    "validate": "validation.json",
    "audit": "bounds_report.json",
    "audio_acceptance": "audio_acceptance.json",
    "validate_video_mapping_body": "dual_body_report.json",
    "qc_body": "qc/body/qc_report.json",
}
HOOK_REPORTS = {"validate_video_mapping_hook_": "dual_hook_%s_report.json", "qc_hook_": "qc/hook_%s/qc_report.json"}


def report_path(step: Column, reports: dict[str, str] = STEP_REPORTS, labelled: dict[str, str] = HOOK_REPORTS) -> Column:
    """RSH18: the report that a step writes; labelled has steps whose name ends in a label. Null for any other step."""
    own = [F.when(step == name, F.lit(path)) for name, path in reports.items()]
    return F.coalesce(*own, *[F.when(step.startswith(name), F.format_string(path, F.substring(step, len(name) + 1, 2**31 - 1))) for name, path in labelled.items()], F.lit(None).cast("string"))


def table_differences(spark: SparkSession, old: DataFrame, new: DataFrame) -> list[tuple[str, str]]:
    """DUP14: columns that one table has and the other has not, or of another type."""
    a, b = dict(old.dtypes), dict(new.dtypes)
    return sorted((c, f"{a.get(c, '-')} -> {b.get(c, '-')}") for c in a.keys() | b.keys() if a.get(c) != b.get(c))


def score_batches(rows: DataFrame, model: Callable[[list[dict[str, Any]]], list[dict[str, Any]]], schema: str, *, size: int = 120, retries: int = 2) -> DataFrame:
    """EXT1, EXT2, EXT5: rows through a model in batches of size. A batch that fails is tried again as a whole, then is an error.

    model takes and gives lists of records; it is made in the worker, so it must be picklable. Records are matched by the
    caller (see checked_decisions).
    """
    kind = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                asked = batch.slice(lo, size).to_pylist()
                for attempt in range(retries + 1):
                    try:
                        got = model(asked)
                        break
                    except Exception:
                        if attempt == retries:
                            raise
                yield pa.RecordBatch.from_pylist(got, schema=kind)

    return rows.mapInArrow(run, schema)


def checked_decisions(asked: DataFrame, decisions: DataFrame, job: str, key: str) -> DataFrame:
    """EXT5, DUP7: decisions about known rows; a row that was not decided, or twice, is an error when it is read."""
    bad = coverage(asked, decisions, job, key).where("problem <> 'unknown'")
    known = decisions.join(asked.select(job, key), [job, key], "left_semi")
    marked = known.join(bad.groupBy(job).agg(F.min(F.concat_ws(" ", "problem", F.col(key).cast("string"))).alias("_bad")), job, "left")
    return marked.where(F.when(F.col("_bad").isNotNull(), F.raise_error(F.concat(F.lit("decisions: "), "_bad"))).otherwise(F.lit(True))).drop("_bad")


def chosen_bounds(rows: DataFrame, choose: Callable[[DataFrame], tuple[Column, Column]] | None = None) -> DataFrame:
    """EXT4: cut bounds by a pluggable choice of columns; without one a row's own. Empty cuts go."""
    low, high = choose(rows) if choose else (F.col("start"), F.col("end"))
    return rows.withColumns({"cut_start": low, "cut_end": high}).where("cut_end > cut_start")


def compact(rows: DataFrame, names: dict[str, str], places: int = 3) -> DataFrame:
    """SCL13: columns under short names, doubles rounded."""
    kinds = dict(rows.dtypes)
    return rows.select(*[(F.round(c, places) if kinds[c] == "double" else F.col(c)).alias(short) for c, short in names.items()])


def plan_topics(plan: DataFrame, job: str, order: str) -> DataFrame:
    """GRAPH5: problems of an ordered plan (topic, facts, needs, id): a topic that comes back, a fact told twice, a need that is not just before."""
    w = Window.partitionBy(job).orderBy(order)
    x = plan.withColumns({"_new": F.coalesce(F.lag("topic").over(w) != F.col("topic"), F.lit(True)), "_prev": F.lag("id").over(w)})
    back = x.where("_new").withColumn("_k", F.row_number().over(Window.partitionBy(job, "topic").orderBy(order))).where("_k > 1").select(job, order, F.lit("topic_returns").alias("problem"))
    facts = plan.select(job, order, F.explode("facts").alias("f")).withColumn("_k", F.row_number().over(Window.partitionBy(job, "f").orderBy(order))).where("_k > 1").select(job, order, F.lit("fact_repeated").alias("problem"))
    apart = x.where((F.size("needs") > 0) & ~F.coalesce(F.array_contains("needs", F.col("_prev")), F.lit(False))).select(job, order, F.lit("need_apart").alias("problem"))
    return back.union(facts).union(apart).distinct()


