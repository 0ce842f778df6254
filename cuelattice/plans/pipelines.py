"""Whole pipelines as compositions of operators. What a model would decide comes in as a table or is left to a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelattice.functions.text import letters_key
from cuelattice.functions.vocab import Profile
from cuelattice.operators import folds as D
from cuelattice.operators import intervals as I
from cuelattice.operators.islands import merge_runs
from cuelattice.operators.rules import flag_clauses, index_gate
from cuelattice.operators.scoring import best_label, quality_score
from cuelattice.operators.select import round_robin


def lean(words: DataFrame, profile: Profile, *, sentences: DataFrame | None = None, decisions: DataFrame | None = None, times: float = 1.0, target: tuple[float, float] = (70.0, 90.0), close_up: bool = True) -> DataFrame:
    """PIPE1, PIPE3: (job, place, first, n_members, start, end, text) of the chosen candidates in order.

    Words become clauses, rules flag them, units gather them, decisions (job, id, usable) may reject more, neighbours that
    are left are candidates, and those up to the target are taken in order. times: one second in the unit of times.
    """
    s = times
    clauses = D.split_clauses(words, sentences=sentences, most=6 * s, least=0.8 * s, silence=0.3 * s, second=s)
    flagged = flag_clauses(clauses, profile, least=0.8 * s, close_up=close_up)
    grouped = D.build_units(clauses, profile, grow=4 * s, cap=8 * s, silence=0.3 * s, close_up=close_up)
    owner = grouped.select("job", "unit", F.explode(F.sequence("first", "last")).alias("id"))
    judged = flagged.join(owner, ["job", "id"])
    if decisions is not None:
        judged = judged.join(decisions.select("job", "id", F.col("usable").alias("_d")), ["job", "id"], "left").withColumn("usable", F.col("usable") & F.coalesce("_d", F.lit(True)))
    candidates = merge_runs(judged, "job", "id", "unit", "usable")
    rows = candidates.withColumnRenamed("id", "pos")
    taken = D.greedy_prefix(rows, low=target[0], high=target[1])
    place = F.row_number().over(Window.partitionBy("job").orderBy("pos"))
    return rows.join(taken.select("job", "pos"), ["job", "pos"]).select("job", place.alias("place"), F.col("pos").alias("first"), F.size("members").alias("n_members"), "start", "end", "text")


def remix(segments: DataFrame, words: DataFrame, profile: Profile, *, bucket: float, least: float = 0.92) -> DataFrame:
    """PIPE4: (job, id, usable, reason, category, order, duplicate_of) of already cut clips (job, seg, start, end).

    A clip's text is what is said on the clock of the concatenation. Literal duplicates and clips without words are not
    used; the others are ordered by category, then time.
    """
    based = I.rebase(segments, "job", "seg", ("start", "end"))
    mid = words.select("job", "pos", "w", ((F.col("s") + F.col("e")) / 2).alias("_m")).withColumn("_m2", F.col("_m"))
    over = I.overlap_join(mid, based.select("job", "seg", "base", "base_end", "is_last"), ["job"], ("_m", "_m2"), ("base", "base_end"), bucket=bucket, slack=-0.5)
    held = over.where((F.col("_m") >= F.col("base")) & ((F.col("_m") < F.col("base_end")) | (F.col("is_last") & (F.col("_m") <= F.col("base_end")))))
    said = held.groupBy("job", "seg").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]), "").alias("text"))
    clips = segments.join(said, ["job", "seg"], "left").select("job", F.col("seg").alias("id"), "start", "end", F.coalesce("text", F.lit("")).alias("text"))
    groups = D.literal_dedup(clips, least=least)
    out = clips.join(groups, ["job", "id"]).withColumn("reason", F.when(letters_key(F.col("text")) == "", "未识别文字").when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise(""))
    out = out.withColumns({"usable": F.col("reason") == "", "category": best_label(F.col("text"), profile.categories, "other")})
    order = F.row_number().over(Window.partitionBy("job", "usable").orderBy("category", "start", "id"))
    return out.select("job", "id", "usable", "reason", "category", F.when(F.col("usable"), order).alias("order"), "duplicate_of")


def digest(rows: DataFrame, profile: Profile, *, times: float = 1.0, most: int, close_up: bool = True) -> DataFrame:
    """PIPE6, PIPE7: (job, first, category, quality, start, end) of the candidates that a planner sees."""
    s = times
    merged = D.merge_short_units(rows, profile, least=1.5 * s, most=4.7 * s, gap=0.4 * s, second=s, close_up=close_up)
    gated = merged.where(index_gate(F.col("text"), F.col("start"), F.col("end"), profile, least=1.2 * s, most=8 * s, close_up=close_up))
    length = (F.col("end") - F.col("start")) * (1000 / s)
    labelled = gated.withColumns({"category": best_label(F.col("text"), profile.categories, "other"), "quality": quality_score(F.col("text"), length, profile)})
    return round_robin(labelled, "job", "first", "category", [*profile.categories], most=most).select("job", "first", "category", "quality", "start", "end")


def whole_film(units: DataFrame, *, low: float, high: float, second: float = 1.0) -> DataFrame:
    """PIPE12: the selected order of each job that has enough material, with the number of violations.

    Each order is audited where it is made (validate.film_audit gives the same violations as rows), so units are read once.
    """
    best = D.arrange(units, low=low, high=high, second=second, audited=True).where("selected")
    whole = {units.schema[c].dataType.simpleString() for c in ("start", "end")} <= {"int", "bigint"}
    return best.select("job", F.array_join("ids", ",").alias("ids"), "score", F.col("duration").cast("bigint" if whole else "double").alias("duration"), "violations")
