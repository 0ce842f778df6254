"""Choosing rows under limits: turns, budgets, strides."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelattice.operators.folds import Row, ordered_fold


def round_robin(rows: DataFrame, job: str, order: str, category: str, turns: list[str], *, most: int) -> DataFrame:
    """TOPK2: rows taken from the categories in turn, in the order of turns, until most of a job are taken."""
    turn = F.array_position(F.array(*[F.lit(t) for t in turns]), F.col(category))
    own = F.row_number().over(Window.partitionBy(job, category).orderBy(order))
    placed = rows.where(turn > 0).withColumn("_own", own).withColumn("_place", F.row_number().over(Window.partitionBy(job).orderBy("_own", turn)))
    return placed.where(F.col("_place") <= most).drop("_own", "_place")


def other_share(rows: DataFrame, job: str, order: str, *, limit: int, taken: Column, share: float) -> DataFrame:
    """TOPK2: the first rows without a category that still have room: at most share of the limit."""
    room = F.greatest(F.lit(0), F.least(F.lit(limit) - taken, F.lit(int(limit * share))))
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(job).orderBy(order))).where(F.col("_k") <= room).drop("_k")


def budgeted_digest(rows: DataFrame, job: str, order: str, category: str, turns: list[str], *, most: int, most_chars: int = 0, share: float = 0.25, text: str = "text", other: str = "other") -> DataFrame:
    """TOPK2: (job, order) of the rows that a digest takes.

    The categories give in turn, and a row that would exceed most_chars characters in all is passed over (0: no such limit).
    Then the category other gives its first rows, at most share of most, up to the first that would exceed. A null text has
    no characters; rows of other categories than these are not taken.
    """
    turn = F.array_position(F.array(*[F.lit(t) for t in [*turns, other]]), F.col(category))
    own = F.row_number().over(Window.partitionBy(job, category).orderBy(order))
    placed = rows.where(turn > 0).select(job, order, F.length(text).alias("_size"), (F.col(category) == other).alias("_rest"), own.alias("_own"), turn.alias("_turn"))

    def step(rows: list[Row]) -> Iterator[Row]:
        taken, total, room = 0, 0, None
        for r in rows:
            if r["_rest"] and room is None:
                room = min(most - taken, int(most * share))
            if (room if r["_rest"] else most - taken) <= 0:
                continue
            total_with = total + (r["_size"] or 0)
            if 0 < most_chars < total_with:
                room = 0 if r["_rest"] else room
                continue
            taken, total = taken + 1, total_with
            room = room - 1 if r["_rest"] else room
            yield {order: r[order]}

    return ordered_fold(placed, [job], ["_rest", "_own", "_turn"], step, f"{order} {rows.schema[order].dataType.simpleString()}")


def stride_sample(rows: DataFrame, job: str, order: str, most: int) -> DataFrame:
    """TOPK3: at most so many rows of a job at even steps: those at floor(i * n / most)."""
    w = Window.partitionBy(job)
    counted = rows.withColumns({"_k": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    wanted = F.floor(F.ceil(F.col("_k") * most / F.col("_n")) * F.col("_n") / most) == F.col("_k")
    return counted.where((F.col("_n") <= most) | (wanted & (F.ceil(F.col("_k") * most / F.col("_n")) < most))).drop("_k", "_n")


def sample_points(rows: DataFrame, length: Column, n: int) -> DataFrame:
    """RSH15: n points at even steps over a length: point, at."""
    return rows.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("at", F.col("point") * length / n)
