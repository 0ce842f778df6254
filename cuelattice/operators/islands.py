"""Adjacency: neighbours, gaps and islands, running sums, returns, splits.

All of these are windows over one job in its order, so they need one exchange by job and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def island_ids(df: DataFrame, job: list[str], order: list[str], breaks: Column, out: str = "island") -> DataFrame:
    """Runs between breaks, numbered from 0; the first row of a job starts a run whether it breaks or not."""
    w = Window.partitionBy(*job).orderBy(*order)
    first = F.row_number().over(w) == 1
    flagged = df.withColumn("_b", F.when(first, 0).when(F.coalesce(breaks, F.lit(True)), 1).otherwise(0))
    return flagged.withColumn(out, F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_b")


def previous(column: str, job: list[str], order: list[str], step: int = 1) -> Column:
    return F.lag(column, step).over(Window.partitionBy(*job).orderBy(*order))


def following(column: str, job: list[str], order: list[str], step: int = 1) -> Column:
    return F.lead(column, step).over(Window.partitionBy(*job).orderBy(*order))


def neighbour_context(df: DataFrame, job: str, order: str, needs_previous: Column, needs_next: Column, *, text: str = "text", long_after: float | None = None, duration: Column | None = None) -> DataFrame:
    """WIN1: utterance and atom ids, the texts around, what a row requires, whether it can stand alone, required atoms."""
    w = Window.partitionBy(job).orderBy(order)
    n = F.row_number().over(w) - 1
    name = lambda k: F.concat(F.lit("utterance-"), F.lpad(k.cast("string"), 6, "0"))
    df = df.withColumns({"_n": n, "_p": needs_previous, "_q": needs_next, "previous_text": F.coalesce(F.lag(text).over(w), F.lit("")), "next_text": F.coalesce(F.lead(text).over(w), F.lit("")), "_more": F.lead(F.lit(1)).over(w).isNotNull()})
    df = df.withColumns({"utterance_id": name(F.col("_n")), "atom_id": F.concat(name(F.col("_n")), F.lit(":0")), "requires_previous": F.col("_p"), "requires_next": F.col("_q"), "safe_standalone": ~(F.col("_p") | F.col("_q"))})
    atom = lambda k, ok: F.when(ok, F.concat(name(k), F.lit(":0")))
    df = df.withColumn("required_atom_ids", F.array_compact(F.array(atom(F.col("_n") - 1, F.col("_p") & (F.col("_n") > 0)), atom(F.col("_n") + 1, F.col("_q") & F.col("_more")))))
    if long_after is not None and duration is not None:
        df = df.withColumn("long_complete_utterance", duration > long_after)
    return df.drop("_n", "_p", "_q", "_more")


def source_runs(df: DataFrame, job: str, order: str, source: str, start: str, end: str, *, low: float, high: float) -> DataFrame:
    """WIN2: unbroken runs of one source: a gap to the row before between low and high. first, last, n, length."""
    gap = F.col(start) - previous(end, [job], [order])
    rows = island_ids(df.withColumn("_break", (F.col(source) != previous(source, [job], [order])) | ~gap.between(low, high)), [job], [order], F.col("_break"))
    return rows.groupBy(job, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"), F.sum(F.col(end) - F.col(start)).alias("length")).drop("island")


def value_runs(df: DataFrame, job: str, order: str, value: str, length: Column) -> DataFrame:
    """WIN3, WIN4: runs of one value, null joining nothing: value, first, last, n, length and the run's place."""
    rows = island_ids(df.withColumn("_break", F.coalesce(F.col(value) != previous(value, [job], [order]), F.lit(True))), [job], [order], F.col("_break"))
    return rows.withColumn("_len", length).groupBy(job, "island").agg(F.min(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"), F.sum("_len").alias("length"))


def merge_runs(df: DataFrame, job: str, order: str, unit: str, usable: str) -> DataFrame:
    """WIN5: neighbouring usable rows of one unit as one candidate: id, text, start, end, members."""
    changed = (F.col(unit) != previous(unit, [job], [order])) | (F.col(usable) != previous(usable, [job], [order]))
    rows = island_ids(df.withColumn("_break", changed), [job], [order], F.col("_break")).where(usable)
    items = F.sort_array(F.collect_list(F.struct(order, "text")))
    out = rows.groupBy(job, "island").agg(F.min(order).alias("id"), items.alias("_x"), F.min("start").alias("start"), F.max("end").alias("end"))
    return out.select(job, "id", F.array_join(F.transform("_x", lambda x: x["text"]), "").alias("text"), "start", "end", F.transform("_x", lambda x: x[order]).alias("members"))


def token_groups(df: DataFrame, job: str, order: str, final: Column, *, gap: Column | None = None, owner: str | None = None) -> DataFrame:
    """WIN9: groups of tokens that break after final marks, where the owner changes, or (without owners) at a silence."""
    ended = F.coalesce(F.lag("_f").over(Window.partitionBy(job).orderBy(order)), F.lit(False))
    rows = df.withColumn("_f", final)
    if owner is not None:
        rows = rows.withColumn("_break", ended | ~F.col(owner).eqNullSafe(previous(owner, [job], [order])))
    else:
        rows = rows.withColumn("_break", ended | (gap if gap is not None else F.lit(False)))
    return island_ids(rows, [job], [order], F.col("_break"), "group").drop("_f", "_break")


def value_returns(df: DataFrame, job: list[str], order: str, value: str) -> DataFrame:
    """WIN18, WIN19: rows at which a value comes back after another; null and empty values are passed over."""
    some = df.where(F.col(value).isNotNull() & (F.col(value) != ""))
    changed = some.withColumn("_new", F.coalesce(F.col(value) != previous(value, job, [order]), F.lit(True)))
    starts = changed.where("_new").withColumn("_k", F.row_number().over(Window.partitionBy(*job, value).orderBy(order)))
    return starts.where("_k > 1").drop("_new", "_k")


def opening_rows(df: DataFrame, job: str, order: str, length: Column, seconds: float) -> DataFrame:
    """WIN20: rows up to and with the one at which the running length reaches the window."""
    w = Window.partitionBy(job).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_len", F.greatest(length, F.lit(0))).withColumn("_before", F.coalesce(F.sum("_len").over(w), F.lit(0))).where(F.col("_before") < seconds).drop("_len", "_before")


def split_pieces(df: DataFrame, start: str, end: str, most: float) -> DataFrame:
    """WIN23: intervals cut every most from their start: piece, piece_start, piece_end; empty intervals give none."""
    n = F.ceil((F.col(end) - F.col(start)) / most).cast("int")
    rows = df.where(F.col(end) > F.col(start)).withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumns({"piece_start": F.col(start) + F.col("piece") * most, "piece_end": F.least(F.col(start) + (F.col("piece") + 1) * most, F.col(end))})


def frame_counts(df: DataFrame, job: str, order: str, length_ms: Column, fps: int) -> DataFrame:
    """WIN22: frames of each row so that sums never drift: the rounded running end less the rounded running start, 1 at least."""
    w = Window.partitionBy(job).orderBy(order)
    rows = df.withColumn("_len", length_ms).withColumn("_end", F.sum("_len").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    frames = F.floor((F.col("_end") * fps + 500) / 1000) - F.floor(((F.col("_end") - F.col("_len")) * fps + 500) / 1000)
    return rows.withColumn("frames", F.greatest(frames, F.lit(1)).cast("long")).drop("_len", "_end")


def prefix_offsets(df: DataFrame, job: list[str], order: str, length: Column, out: str = "offset") -> DataFrame:
    """SNK9, WIN21: where each row begins when rows are laid end to end."""
    w = Window.partitionBy(*job).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_len", length).withColumn(out, F.coalesce(F.sum("_len").over(w), F.lit(0))).drop("_len")


def gaps(df: DataFrame, job: str, order: str, start: str, end: str, tolerance: float) -> DataFrame:
    """WIN27: rows that don't begin where the one before ended: the gap."""
    return df.withColumn("gap", F.col(start) - previous(end, [job], [order])).where(F.abs("gap") > tolerance)


def quiet_cores(levels: DataFrame, job: str, order: str, value: str, *, threshold: float, least: int, flank: float) -> DataFrame:
    """WIN15: runs of frames below a threshold, at least so many, with a loud frame on one side: first, last, core (the quietest frame)."""
    quiet = F.col(value) < threshold
    rows = levels.withColumns({"_q": quiet, "_before": previous(value, [job], [order]), "_after": following(value, [job], [order])})
    rows = island_ids(rows.withColumn("_break", F.col("_q") != F.lag("_q").over(Window.partitionBy(job).orderBy(order))), [job], [order], F.col("_break")).where("_q")
    out = rows.groupBy(job, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"), F.min_by(order, F.struct(F.col(value), F.col(order))).alias("core"), F.min_by("_before", order).alias("_l"), F.max_by("_after", order).alias("_r"))
    loud = F.coalesce(F.col("_l") >= flank, F.lit(False)) | F.coalesce(F.col("_r") >= flank, F.lit(False))
    return out.where((F.col("n") >= least) & loud).select(job, "first", "last", "n", "core")


def context_batches(df: DataFrame, job: str, order: str, size: int, around: int) -> DataFrame:
    """WIN26: fixed batches with the rows around them as context: batch, own (false for context)."""
    n = F.row_number().over(Window.partitionBy(job).orderBy(order)) - 1
    most = F.count(F.lit(1)).over(Window.partitionBy(job))
    rows = df.withColumns({"_n": n, "_all": most})
    low = F.floor(F.greatest(F.lit(0), F.col("_n") - around) / size).cast("long")
    high = F.floor(F.least(F.col("_all") - 1, F.col("_n") + around) / size).cast("long")
    rows = rows.withColumn("batch", F.explode(F.sequence(low, high)))
    return rows.withColumn("own", F.floor(F.col("_n") / size) == F.col("batch")).drop("_n", "_all")


def pair_marks(text: Column, opening: str, closing: str) -> Column:
    """WIN16: the k-th opening number in a log with the k-th closing (end, length); a missing opening is end less length."""
    starts = F.transform(F.regexp_extract_all(text, F.lit(opening), F.lit(1)), lambda x: x.cast("double"))
    ends = F.transform(F.regexp_extract_all(text, F.lit(closing), F.lit(1)), lambda x: x.cast("double"))
    lengths = F.transform(F.regexp_extract_all(text, F.lit(closing), F.lit(2)), lambda x: x.cast("double"))
    return F.transform(ends, lambda e, k: F.struct(F.coalesce(F.get(starts, k), e - F.get(lengths, k)).alias("start"), e.alias("end"), F.get(lengths, k).alias("length")))
