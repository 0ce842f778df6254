"""Rule ladders over clauses: rejection reasons, gates, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelattice.functions.text import EDGE_MARKS, first_hit, letters_key, normal_key, script_share
from cuelattice.functions.vocab import Profile


def dangling_end(text: Column, profile: Profile) -> Column:
    """FLT7: the connector a text ends in, marks at the end aside; else null."""
    return first_hit(F.regexp_replace(F.coalesce(text, F.lit("")), EDGE_MARKS + "$", ""), profile.dangling_end)


def dependent_start(text: Column, profile: Profile) -> Column:
    """FLT7: the opening that needs what came before, marks at the start aside; else null."""
    return first_hit(F.regexp_replace(F.coalesce(text, F.lit("")), "^" + EDGE_MARKS, ""), profile.dependent_start)


def content_rejection(text: Column, profile: Profile, *, close_up: bool = True) -> Column:
    """FLT6: the first reason why a text can't stand: empty_text, context_dependent_start, incomplete_sentence, stage_chatter, malformed_speech.

    close_up: white space is removed first, as for scripts without word spaces.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "" if close_up else " ")
    t = F.trim(t)
    return (
        F.when(t == "", "empty_text")
        .when(dependent_start(t, profile).isNotNull(), "context_dependent_start")
        .when(dangling_end(t, profile).isNotNull(), "incomplete_sentence")
        .when(t.rlike(profile.chatter), "stage_chatter")
        .when(t.rlike(profile.malformed), "malformed_speech")
    )


def rule_reason(text: Column, start: Column, end: Column, profile: Profile, *, least: float, close_up: bool = True) -> Column:
    """FLT1: the first rule that rejects a clause, or null: the order of rules is part of the result.

    too_short, non_script (reported as non_chinese), hard_vocab, stage_chatter, malformed_speech, duration_gate,
    invalid_bounds. Times and least are in one unit.
    """
    t = F.coalesce(text, F.lit(""))
    speech = content_rejection(t, profile, close_up=close_up)
    return (
        F.when(F.length(F.trim(t)) < 2, "too_short")
        .when(script_share(t, profile.script) < profile.least_share, "non_chinese")
        .when(t.rlike(profile.hard_pattern), "hard_vocab")
        .when(speech.isin("stage_chatter", "malformed_speech"), speech)
        .when(start.isNull() | end.isNull(), "invalid_bounds")
        .when(end - start < least - 1e-9, "duration_gate")
    )


def flag_clauses(clauses: DataFrame, profile: Profile, *, job: str = "job", pos: str = "id", least: float, close_up: bool = True) -> DataFrame:
    """FLT2 with the exact part of DUP1: usable and reason on every row; of the usable rows of a job with one normal key the first by pos stays."""
    rows = clauses.withColumn("reason", F.coalesce(rule_reason(F.col("text"), F.col("start"), F.col("end"), profile, least=least, close_up=close_up), F.lit("")))
    key = normal_key(F.col("text"))
    rows = rows.withColumn("_key", F.when((F.col("reason") == "") & (key != ""), key))
    first = F.row_number().over(Window.partitionBy(job, "_key").orderBy(pos))
    rows = rows.withColumn("reason", F.when(F.col("_key").isNotNull() & (first > 1), "duplicate").otherwise(F.col("reason")))
    return rows.withColumn("usable", F.col("reason") == "").drop("_key")


def reject_hit(text: Column, reason: Column, profile: Profile) -> Column:
    """FLT3: the word that made a clause hard vocabulary; null for other reasons."""
    return F.when(reason == "hard_vocab", first_hit(text, profile.hard_pattern))


def index_gate(text: Column, start: Column, end: Column, profile: Profile, *, least: float, most: float | None = None, close_up: bool = True) -> Column:
    """FLT5 and FLT9: two characters, script, no hard term, a tolerable rejection, a duration within bounds."""
    rejection = content_rejection(text, profile, close_up=close_up)
    fine = rejection.isNull() | rejection.isin("context_dependent_start", "incomplete_sentence")
    ok = (F.length(text) >= 2) & (script_share(text, profile.script) >= 0.5) & ~text.rlike(profile.hard_pattern) & fine & (end - start >= least)
    return ok & (end - start <= most) if most is not None else ok


def coarse_filter(units: DataFrame, *, job: str = "job", pos: str = "id", invalid: str, other: str, product: str = "", repeats: str | None = r"(.)\1{7,}") -> DataFrame:
    """FLT8: filter_reason, or null for kept rows; of several reasons the last of these counts.

    operational_content, exact_duplicate (of any earlier row of the job, kept or not), empty_asr, obvious_asr_repetition
    (repeats is found in the letters and digits; None: no such rule), explicit_other_product (group 1 of other names a
    product that neither text nor product has).
    """
    key = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[\W_]+", "")
    rows = units.withColumn("_key", key)
    again = F.row_number().over(Window.partitionBy(job, "_key").orderBy(pos)) > 1
    named = F.regexp_extract("text", other, 1)
    switch = (F.length(named) > 0) & F.lit(bool(product)) & ~F.col("text").contains(product) & ~F.lit(product).contains(named)
    looped = F.col("_key").rlike(repeats) if repeats is not None else F.lit(False)
    reason = (
        F.when(switch, "explicit_other_product")
        .when(looped, "obvious_asr_repetition")
        .when(F.col("_key") == "", "empty_asr")
        .when(again, "exact_duplicate")
        .when(F.col("text").rlike(invalid), "operational_content")
    )
    return rows.withColumn("filter_reason", reason).drop("_key")


def second_product(text: Column, products: str, attributes: str, allowed: list[str]) -> Column:
    """FLT12: a second product and an attribute of it are named, and none of the allowed products is."""
    named = F.lit(False)
    for word in allowed:
        named = named | text.contains(word)
    return text.rlike(products) & text.rlike(attributes) & ~named


def crosses_boundary(start: Column, end: Column, boundaries: Column, margin: float = 0.12) -> Column:
    """FLT11: some inner boundary lies within the interval, margins aside."""
    inner = F.slice(boundaries, F.lit(2), F.greatest(F.size(boundaries) - 2, F.lit(0)))
    return F.exists(inner, lambda b: (b > start + margin) & (b < end - margin))


def facet(status: str, usable: Column, reason: Column) -> Column:
    """FLT13: rows of a facet: s2 (passed the rules), s2rej, s3 (usable), all."""
    passed = reason == ""
    return {"s2": passed, "s2rej": ~passed, "s3": usable, "all": F.lit(True)}[status]


def normal_letters(text: Column) -> Column:
    """STR2."""
    return letters_key(text)
