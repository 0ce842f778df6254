"""Validators: problems of a timeline or a copy as rows (job, code, level, first, last, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelattice.functions.text import letters_key
from cuelattice.functions.vocab import Profile
from cuelattice.operators import islands as W
from cuelattice.operators.folds import near_repeats
from cuelattice.operators.intervals import self_overlap
from cuelattice.operators.rules import content_rejection, dangling_end, dependent_start

ISSUE = "job, code, level, first, last"


def _issue(df: DataFrame, job: str, code: str | Column, level: str | Column, first: str | Column, last: str | Column | None = None) -> DataFrame:
    col = lambda x: F.lit(x) if isinstance(x, str) else x
    at = lambda x: F.col(x) if isinstance(x, str) else x
    return df.select(F.col(job).alias("job"), col(code).alias("code"), col(level).alias("level"), at(first).cast("long").alias("first"), (at(last) if last is not None else at(first)).cast("long").alias("last"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def segment_issues(rows: DataFrame, job: str, pos: str, *, least: float, most: float, margin: float, most_demo: float, roles: list[str]) -> DataFrame:
    """AGG15, AGG16: bounds, length and role of single rows; a length over the limit by no more than margin is a warning."""
    x = rows.withColumns({"_len": F.col("end") - F.col("start"), "_most": F.when(F.col("role") == "demo", most_demo).otherwise(most)})
    return union([
        _issue(x.where("start < 0 or end <= start"), job, "out_of_bounds", "error", pos),
        _issue(x.where("_len > _most"), job, "segment_too_long", F.when(F.col("_len") <= F.col("_most") + margin, "warning").otherwise("error"), pos),
        _issue(x.where(F.col("_len") < least), job, "segment_too_short", "error", pos),
        _issue(x.where(F.col("role").isNotNull() & ~F.col("role").isin(roles)), job, "invalid_role", "error", pos),
    ])


def text_issues(rows: DataFrame, job: str, pos: str, profile: Profile, *, close_up: bool = True) -> DataFrame:
    """AGG15: hard words, terms for review, dangling ends, other rejections."""
    t = F.col("text")
    end = dangling_end(t, profile)
    rejection = content_rejection(t, profile, close_up=close_up)
    return union([
        _issue(rows.where(t.rlike(profile.hard_pattern)), job, "banned_word", "error", pos),
        _issue(rows.where(t.rlike(profile.review_pattern)), job, "context_review", "warning", pos),
        _issue(rows.where(end.isNotNull()), job, "incomplete_sentence", "error", pos),
        _issue(rows.where(end.isNull() & rejection.isNotNull()), job, rejection, "error", pos),
    ])


def run_issues(rows: DataFrame, job: str, pos: str, *, low: float, high: float, error: float, warning: float, cluster: float) -> DataFrame:
    """WIN2, WIN3: long unbroken source runs, and clusters of one role."""
    runs = W.source_runs(rows, job, pos, "src", "start", "end", low=low, high=high)
    same = W.value_runs(rows, job, pos, "role", F.col("end") - F.col("start"))
    return union([
        _issue(runs.where(F.col("length") > error), job, "continuous_source_run", "error", "first", "last"),
        _issue(runs.where((F.col("length") > warning) & (F.col("length") <= error)), job, "long_natural_run", "warning", "first", "last"),
        _issue(same.where((F.col("n") > 2) & (F.col("length") > cluster)), job, "role_cluster", "warning", "first", "last"),
    ])


def total_issues(rows: DataFrame, job: str, pos: str, *, low: float, high: float, segments: tuple[int, int], average: float, most_demos: int) -> DataFrame:
    """AGG15: length, number and average length of rows, number of demos."""
    g = rows.groupBy(job).agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.col("start"))).alias("_t"), F.count(F.lit(1)).alias("_n"), F.count_if(F.col("role") == "demo").alias("_d"), F.min(pos).alias("first"), F.max(pos).alias("last"))
    one = lambda c, code, level: _issue(g.where(c), job, code, level, "first", "last")
    return union([
        one(F.col("_t") < low, "soft_duration_short", "warning"), one(F.col("_t") > high, "duration_too_long", "error"),
        one(F.col("_n") < segments[0], "too_few_segments", "error"), one(F.col("_n") > segments[1], "too_many_segments", "error"),
        one(F.col("_d") > most_demos, "too_many_long_demos", "warning"), one(F.col("_t") / F.col("_n") > average, "average_segment_too_long", "warning"),
    ])


def structure_issues(rows: DataFrame, job: str, pos: str) -> DataFrame:
    """AGG15: what a selling edit misses: an opening with a reason, proof, a close that stands last, roles throughout."""
    w = Window.partitionBy(job)
    x = rows.withColumns({"_k": F.row_number().over(w.orderBy(pos)), "_last": F.max(pos).over(w)})
    g = x.groupBy(job).agg(
        F.min_by("role", pos).alias("_first"), F.collect_set("role").alias("_roles"), F.min(F.when(F.col("role") == "close", F.col(pos))).alias("_close"), F.max(pos).alias("last"), F.min(pos).alias("first"),
        F.min(F.when(F.col("_k") <= 3, F.col("role").isin("bridge", "material", "craft", "color"))).alias("_abstract"), F.count_if(F.coalesce("role", F.lit("")) == "").alias("_none"),
    )
    has = lambda *r: F.arrays_overlap("_roles", F.array(*[F.lit(v) for v in r]))
    one = lambda c, code, level="warning": _issue(g.where(c), job, code, level, "first", "last")
    return union([
        one(~F.coalesce("_first", F.lit("")).isin("hook", "result", "pain", "proof", "demo", "personality", "story", "reaction", "visual"), "weak_opening_role"),
        one(~has("proof", "demo"), "missing_proof"), one(~has("close"), "missing_close"), one(~has("fit", "pain", "scene", "styling"), "missing_customer_relevance"),
        one(F.coalesce("_abstract", F.lit(False)), "abstract_opening_sequence"), one(F.col("_close") < F.col("last"), "content_after_close", "error"), one(F.col("_none") > 0, "missing_roles", "error"),
    ])


def repeated_values(rows: DataFrame, job: str, pos: str, product: str, claim: Column, *, most: int = 1, code: str = "repeated_composition_claim") -> DataFrame:
    """AGG15, AGG16: products with more than most rows that make a claim."""
    g = rows.where(claim).groupBy(job, product).agg(F.count(F.lit(1)).alias("_n"), F.min(pos).alias("first"), F.max(pos).alias("last")).where(F.col("_n") > most)
    return _issue(g, job, code, "error", "first", "last")


def overlap_issues(rows: DataFrame, job: str, pos: str, *, bucket: float, least: float) -> DataFrame:
    """JOIN24."""
    found = self_overlap(rows, [job, "src"], pos, ("start", "end"), bucket=bucket, least=least)
    return _issue(found, job, "overlapping_source_range", "error", "earlier", pos)


def repeated_texts(rows: DataFrame, job: str, pos: str, *, least: float = 0.88) -> DataFrame:
    """JOIN24: texts equal or near to an earlier row's."""
    return _issue(near_repeats(rows, job=job, order=pos, least=least), job, "duplicate_text", "error", "earlier", "id")


def distinct_issues(issues: DataFrame) -> DataFrame:
    """Each problem of a code and place once."""
    return issues.groupBy("job", "code", "first", "last").agg(F.min("level").alias("level")).select("job", "code", "level", "first", "last")


def copy_review(rows: DataFrame, profile: Profile, *, job: str = "job", pos: str = "pos", opening: float, bonus: dict[str, int], low_value: str, second: float = 1.0) -> DataFrame:
    """AGG7: one row per job: errors by kind, opening score, information density, score.

    rows: text, role, product, color, start, end. Dangling references and continuations, products and colours that come
    back, texts near to an earlier one (JOIN23), an opening scored by its length and best role.
    """
    w = Window.partitionBy(job).orderBy(pos)
    t = F.coalesce("text", F.lit(""))
    x = rows.withColumns({"_t": t, "_chars": F.length(letters_key(t)), "_len": F.greatest(F.lit(0), F.col("end") - F.col("start")), "_p": F.lag(pos).over(w), "_f": F.lead(pos).over(w)})
    x = x.withColumns({"_ref": (dependent_start(t, profile).isNotNull() | t.rlike(profile.leading_reference)) & F.col("_p").isNull(), "_cont": dangling_end(t, profile).isNotNull() & F.col("_f").isNull()})
    x = x.withColumn("_open", F.coalesce(F.sum("_len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) < opening)
    points = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in bonus.items() for v in kv]), F.coalesce("role", F.lit(""))), F.lit(0))
    g = x.withColumn("_points", points).groupBy(job).agg(
        F.count_if("_ref").alias("dangling_references"), F.count_if("_cont").alias("dangling_continuations"), F.sum("_chars").alias("_info"), F.sum("_len").alias("_time"),
        F.sum(F.when(F.col("_open"), F.col("_chars")).otherwise(0)).alias("_oc"), F.max(F.when(F.col("_open"), F.col("_points")).otherwise(0)).alias("_bonus"), F.min_by("_t", pos).alias("_first"), F.count_if(F.coalesce("product", F.lit("")) != "").alias("_products"),
    )
    jumps = W.value_returns(rows, [job], pos, "product").groupBy(job).agg(F.count(F.lit(1)).alias("product_jumps"))
    colors = W.value_returns(rows.where(F.coalesce("product", F.lit("")) != ""), [job, "product"], pos, "color").groupBy(job).agg(F.count(F.lit(1)).alias("color_jumps"))
    repeats = near_repeats(rows, job=job, order=pos, least=0.86, equal=False).groupBy(job).agg(F.count(F.lit(1)).alias("repeated_conclusions"))
    out = g.join(jumps, job, "left").join(colors, job, "left").join(repeats, job, "left").na.fill(0, ["product_jumps", "color_jumps", "repeated_conclusions"])
    score = F.least(F.lit(45), F.round(F.col("_oc") * 1.2)) + F.col("_bonus") - F.when(F.col("_first").rlike(low_value), 45).otherwise(0)
    out = out.withColumn("opening_score", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long"))
    out = out.withColumn("errors", F.col("dangling_references") + F.col("dangling_continuations") + F.col("product_jumps") + F.col("color_jumps") + F.col("repeated_conclusions") + F.when(F.col("_products") == 0, 1).otherwise(0))
    final = F.greatest(F.lit(0), 100 - 18 * F.col("errors") - F.greatest(F.lit(0), 45 - F.col("opening_score"))).cast("long")
    density = F.round(F.col("_info") / F.greatest(F.lit(1.0), F.col("_time") / second), 2)
    return out.select(job, "dangling_references", "dangling_continuations", "product_jumps", "color_jumps", "repeated_conclusions", "opening_score", density.alias("information_density"), "errors", final.alias("score"))


def film_audit(units: DataFrame, edges: DataFrame, *, job: str = "job", pos: str = "pos", low: float, high: float, weak: float = 0.4, least_hook: float = 0.5, second: float = 1.0, scene_seconds: float = 25, product_seconds: float = 12, relevant: float = 0.6) -> DataFrame:
    """JOIN22, AGG6's violations: weak or dependent openings, length outside the target, missing context, repeated claims, weak runs, one scene for too long, the product too late.

    units: claim, strength, hook, start, end; independent, scene (null if unknown) and relevance are judged where there
    are such columns; edges: (job, pos, need) where need is the pos that must come before. second: what one second is in
    the unit of times.
    """
    w = Window.partitionBy(job).orderBy(pos)
    x = units.withColumns({"_k": F.row_number().over(w), "_again": F.row_number().over(Window.partitionBy(job, "claim").orderBy(pos)) > 1, "_before": F.lag("strength").over(w)})
    need = edges.select(job, pos, "need")
    have = units.select(job, F.col(pos).alias("need"), F.lit(True).alias("_there"))
    late = need.join(have, [job, "need"], "left").where(f"_there is null or need >= {pos}")
    leans = need.select(job, pos).distinct().withColumn("_leans", F.lit(True))
    first = x.where("_k = 1").join(leans, [job, pos], "left")
    total = units.groupBy(job).agg(F.sum(F.col("end") - F.col("start")).alias("_t"), F.min(pos).alias("first"))
    more, length, opens = [], F.col("end") - F.col("start"), (F.col("hook") < least_hook) | F.col("_leans")
    if "independent" in units.columns:
        opens = opens | ~F.col("independent")
    if "scene" in units.columns:
        cut = units.withColumn("_cut", F.when(F.col("scene").eqNullSafe(F.lag("scene").over(w)), 0).otherwise(1)).withColumn("_scene", F.sum("_cut").over(w))
        shown = cut.withColumn("_for", F.sum(length).over(Window.partitionBy(job, "_scene").orderBy(pos)))
        more.append(_issue(shown.where(F.col("scene").isNotNull() & (F.col("_for") > scene_seconds * second)), job, "long_scene", "error", pos))
    if "relevance" in units.columns:
        passed = units.withColumn("_at", F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        product = passed.groupBy(job).agg(F.min(F.when(F.col("relevance") >= relevant, F.col("_at"))).alias("_at"), F.min(pos).alias("first"))
        more.append(_issue(product.where(F.col("_at").isNull() | (F.col("_at") > product_seconds * second)), job, "late_product", "error", "first"))
    return distinct_issues(union([
        *more,
        _issue(first.where(opens), job, "weak_opening", "error", pos),
        _issue(total.where((F.col("_t") < low) | (F.col("_t") > high)), job, "duration_outside_target", "error", "first"),
        _issue(late, job, "missing_context", "error", pos),
        _issue(x.where("_again"), job, "repeated_claim", "error", pos),
        _issue(x.where((F.col("strength") < weak) & (F.col("_before") < weak)), job, "weak_run", "error", pos),
    ]))
