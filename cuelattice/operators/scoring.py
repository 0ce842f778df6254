"""Aggregates and scores: counts by status, keyword labels, film metrics, transcript profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelattice.functions.text import count_of, letters_key, sentences
from cuelattice.functions.vocab import Profile
from cuelattice.operators.rules import dangling_end, dependent_start


def status_counts(jobs: DataFrame, *, newest: int, created: str = "created", key: str = "id") -> DataFrame:
    """AGG1: counts by status over the newest jobs alone, with active and total on every row."""
    top = jobs.orderBy(F.col(created).desc(), F.col(key).desc()).limit(newest)
    counts = top.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    active = F.sum(F.when(F.col("status").isin("queued", "running"), F.col("n")).otherwise(0)).over(every)
    return counts.select("status", "n", active.alias("active"), F.sum("n").over(every).alias("total"))


def facet_counts(rows: DataFrame, job: str, passed: Column, usable: Column) -> DataFrame:
    """AGG2: total, passed and rejected by rules, usable, and those that passed but are not usable (never below 0)."""
    n = lambda c: F.count_if(c).cast("long")
    out = rows.groupBy(job).agg(F.count(F.lit(1)).alias("total"), n(passed).alias("s2_passed"), n(~passed).alias("s2_rejected"), n(usable).alias("usable"))
    return out.withColumn("rejected_by_s3", F.greatest(F.lit(0).cast("long"), F.col("s2_passed") - F.col("usable")))


def label_scores(text: Column, labels: dict[str, tuple[str, ...]]) -> Column:
    """Hits of each label's words as an array of (score, label)."""
    one = lambda words: sum((count_of(text, w) for w in words), F.lit(0)).cast("int")
    return F.array(*[F.struct(one(words).alias("score"), F.lit(label).alias("label")) for label, words in labels.items()])


def best_label(text: Column, labels: dict[str, tuple[str, ...]], default: str) -> Column:
    """AGG9: the label of most hits; of equals the greatest by name; without hits the default."""
    best = F.array_max(label_scores(text, labels))
    return F.when(best["score"] > 0, best["label"]).otherwise(default)


def quality_score(text: Column, length_ms: Column, profile: Profile, *, bonus: tuple[str, ...] = (), low_information: tuple[str, ...] = ()) -> Column:
    """AGG10: points for duration, length, a final mark and keywords (each once for each category that lists it), less penalties."""
    chars = F.length(letters_key(text))
    words = sum((F.when(text.contains(w), 1).otherwise(0) for ws in profile.categories.values() for w in ws), F.lit(0))
    any_of = lambda ws: F.lit(False) if not ws else F.greatest(*[text.contains(w) for w in ws], F.lit(False))
    starts = lambda ws: F.lit(False) if not ws else F.greatest(*[F.trim(text).startswith(w) for w in ws], F.lit(False))
    return (
        F.when(length_ms.between(1200, 6500), 3).otherwise(0)
        + F.when(chars.between(8, 42), 3).otherwise(0)
        + F.when(text.rlike("[。！？!?.]$"), 2).otherwise(0)
        + words
        + F.when(any_of(bonus), 2).otherwise(0)
        - F.when(dependent_start(text, profile).isNotNull(), 2).otherwise(0)
        - F.when(starts(low_information) & (chars < 18), 5).otherwise(0)
        - F.when(dangling_end(text, profile).isNotNull(), 4).otherwise(0)
    ).cast("long")


def film_metrics(units: DataFrame, job: str, order: str) -> DataFrame:
    """AGG6: repetition, topic jumps, mean strength and relevance, the opening's strength, predicted retention.

    units: claim, topic, strength, relevance, hook.
    """
    jump = F.when(F.lag("topic").over(Window.partitionBy(job).orderBy(order)) != F.col("topic"), 1).otherwise(0)
    g = units.withColumn("_jump", jump).groupBy(job).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("claim").alias("claims"), F.sum("_jump").alias("jumps"), F.avg("strength").alias("density"), F.avg("relevance").alias("consistency"), F.min_by("hook", order).alias("opening")
    )
    g = g.withColumns({"repetition": 1 - F.col("claims") / F.col("n"), "topic_jump_rate": F.col("jumps") / F.greatest(F.lit(1), F.col("n") - 1)})
    kept = F.col("opening") * 0.25 + F.col("density") * 0.35 + F.col("consistency") * 0.25 + (1 - F.col("topic_jump_rate")) * 0.15 - F.col("repetition")
    return g.withColumn("predicted_retention", F.greatest(F.lit(0.0), F.least(F.lit(1.0), kept))).drop("jumps", "claims")


def transcript_profile(rows: DataFrame, key: str, text: str, topics: dict[str, tuple[str, ...]], hooks: dict[str, tuple[str, ...]], *, products: tuple[str, ...], colloquial: tuple[str, ...], default_hook: str = "直接陈述", default_topic: str = "其他", default_focus: str = "综合表达") -> DataFrame:
    """AGG8, AGG12: one row per transcript that has a sentence: hash, hook, focus, shares of topics, labelled sentences, rhythm, style.

    The focus is the topic of most hits, of equals the first listed.
    """
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s+|\s+$", "")
    rows = rows.select(key, t.alias("t"), sentences(t).alias("ss")).where(F.size("ss") > 0)
    total = lambda ws: sum((count_of(F.col("t"), w) for w in ws), F.lit(0)).cast("int")
    rows = rows.withColumn("hits", F.array(*[F.struct(total(ws).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("topic")) for k, (name, ws) in enumerate(topics.items())]))
    rows = rows.withColumns({"best": F.array_max("hits"), "all": F.greatest(F.lit(1), F.aggregate("hits", F.lit(0), lambda a, x: a + x["n"])), "first": F.get("ss", F.lit(0))})
    marks = lambda p: F.regexp_count("t", F.lit(p)).cast("long")
    chars = F.aggregate("ss", F.lit(0), lambda a, s: a + F.length(s))
    return rows.select(
        key, F.sha2("t", 256).alias("source_hash"), best_label(F.col("first"), hooks, default_hook).alias("hook"), F.substring("first", 1, 160).alias("hook_text"),
        F.greatest(*[F.col("first").contains(w) for w in products], F.lit(False)).alias("mentions_product"),
        F.when(F.col("best.n") > 0, F.col("best.topic")).otherwise(default_focus).alias("primary_focus"),
        F.transform(F.filter("hits", lambda x: x["n"] > 0), lambda x: F.struct(x["topic"].alias("topic"), F.round(x["n"] / F.col("all"), 3).alias("share"))).alias("distribution"),
        F.transform("ss", lambda s, k: F.struct(k.alias("position"), best_label(s, topics, default_topic).alias("label"), F.substring(s, 1, 180).alias("text"))).alias("narrative_units"),
        F.size("ss").cast("long").alias("sentence_count"), F.round(chars / F.size("ss"), 1).alias("average_chars"),
        marks("[？?]").alias("question_count"), marks("[！!]").alias("exclamation_count"), total(colloquial).cast("long").alias("colloquial_markers"),
    )


def top_shares(distribution: Column, most: int) -> Column:
    """TOPK7: the greatest shares of a distribution, by share, then name."""
    return F.slice(F.reverse(F.array_sort(F.transform(distribution, lambda x: F.struct(x["share"].alias("share"), x["topic"].alias("topic"))))), 1, most)


def landing(rows: DataFrame, job: str, module: str, length: Column, reason: str | None = None) -> DataFrame:
    """AGG3: rows and length by module, hooks with the body's length added."""
    out = rows.withColumn("_len", length).groupBy(job, module).agg(F.count(F.lit(1)).alias("n"), F.sum("_len").alias("length"))
    body = F.sum(F.when(F.col(module) == "body", F.col("length")).otherwise(0)).over(Window.partitionBy(job))
    return out.withColumn("with_body", F.when(F.col(module).startswith("hook"), F.col("length") + body).otherwise(F.col("length")))


def top_reasons(rows: DataFrame, reason: str, *, most: int = 5, chars: int = 48) -> DataFrame:
    """AGG3: the reasons given most often, cut to so many characters; of equals by name."""
    return rows.groupBy(F.substring(reason, 1, chars).alias(reason)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), reason).limit(most)


def issue_rollup(issues: DataFrame, job: str) -> DataFrame:
    """AGG4: errors, warnings and counts by code; a null level is an error."""
    level = F.coalesce("level", F.lit("error"))
    by_code = issues.withColumn("level", level).groupBy(job, "code").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("level") == "error").alias("e"), F.count_if(F.col("level") == "warning").alias("w"))
    out = by_code.groupBy(job).agg(F.sum("e").alias("error_count"), F.sum("w").alias("warning_count"), F.sort_array(F.collect_list(F.struct("code", "n"))).alias("by_type"))
    return out


def first_issues(issues: DataFrame, job: str, order: list[str], *, most: int = 10) -> DataFrame:
    """AGG5: the first errors of a job, each with the number of all."""
    w = Window.partitionBy(job)
    errors = issues.where(F.coalesce("level", F.lit("error")) == "error")
    return errors.withColumns({"place": F.row_number().over(w.orderBy(*order)), "all_errors": F.count(F.lit(1)).over(w)}).where(F.col("place") <= most)


def duration_budget(rows: DataFrame, job: str, length: Column, *, high: float, tolerance: float, long_unit: float) -> DataFrame:
    """AGG17: total length, the limit (long units may exceed it by what they are over), and whether it holds."""
    out = rows.withColumn("_len", length).groupBy(job).agg(F.sum("_len").alias("total"), F.sum(F.greatest(F.lit(0), F.col("_len") - long_unit)).alias("extra"))
    return out.withColumn("limit", F.col("extra") + high + tolerance).withColumn("fits", F.col("total") <= F.col("limit")).drop("extra")


def equivalent_units(rows: DataFrame, job: str, key: str, topic: str, facts: str, length: Column) -> DataFrame:
    """AGG19: of rows of one topic and set of facts the shortest, of equals the first: topic, facts, id, n."""
    sets = F.array_sort(F.array_distinct(F.col(facts)))
    return rows.withColumns({"_set": sets, "_len": length}).groupBy(job, topic, F.array_join("_set", "|").alias("fact_set")).agg(F.min_by(key, F.struct("_len", key)).alias(key), F.count(F.lit(1)).alias("n"))


def fact_keys(facts: DataFrame, groups: DataFrame, job: str, key: str, fact: str = "fact", group: str = "group") -> DataFrame:
    """AGG20: each row's facts by their canonical names (the least of their group), each once, sorted."""
    least = groups.groupBy(group).agg(F.min(fact).alias("canonical"))
    names = groups.join(least, group).select(fact, "canonical")
    return facts.join(names, fact, "left").groupBy(job, key).agg(F.array_sort(F.collect_set(F.coalesce("canonical", fact))).alias("facts"))


def mode_of(rows: DataFrame, job: str, order: str, value: str, allowed: list[str], default: str) -> DataFrame:
    """AGG12: the most frequent of the allowed values, of equals the first met; the default for jobs without any."""
    some = rows.where(F.col(value).isin(allowed)).groupBy(job, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = some.groupBy(job).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias("focus"))
    return rows.select(job).distinct().join(best, job, "left").select(job, F.coalesce("focus", F.lit(default)).alias("focus"))


def timeline_summary(segments: DataFrame, job: str, order: str, start: str, end: str, source_length: Column, source: str) -> DataFrame:
    """AGG13, SRC11: end of the timeline, source length, segments, distinct sources in order."""
    rows = segments.withColumn("_len", source_length)
    first = rows.groupBy(job, source).agg(F.min(order).alias("_first"), F.max(end).alias("_end"), F.sum("_len").alias("_len"), F.count(F.lit(1)).alias("_n"))
    out = first.groupBy(job).agg(F.max("_end").alias("total_duration"), F.sum("_len").alias("source_duration"), F.sum("_n").alias("segments"), F.sort_array(F.collect_list(F.struct("_first", source))).alias("_s"))
    return out.withColumn("sources", F.transform("_s", lambda x: x[source])).drop("_s")
