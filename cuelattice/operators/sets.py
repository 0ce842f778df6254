"""Exact duplicates, coverage and partition checks, keep-latest stores, set algebra on arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelattice.functions.text import character_pairs
from cuelattice.operators.graph import checkpointed


def first_of(rows: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key by order."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """SNK3, SNK4, JOIN15, JOIN16, RSH10: the last version of each key; null versions count as first."""
    return first_of(rows, list(keys), [F.col(c).desc_nulls_last() for c in order])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SNK3: rows of new in place of those of equal keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def cascade_delete(parent: DataFrame, children: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """SNK5: parent and children without the keys in gone."""
    out = {"parent": parent.join(gone.select(key), key, "left_anti")}
    for name, (child, ref) in children.items():
        out[name] = child.join(gone.select(F.col(key).alias(ref)), ref, "left_anti")
    return out


def rerun_from(stages: DataFrame, position: str, at: Column, fresh: dict[str, Column]) -> DataFrame:
    """SNK5, SNK6: stages at or after a position get fresh values, earlier ones stay."""
    return stages.withColumns({c: F.when(F.col(position) >= at, v).otherwise(F.col(c)) for c, v in fresh.items()})


def coverage(expected: DataFrame, seen: DataFrame, job: str, key: str) -> DataFrame:
    """DUP6, DUP7: per job the expected keys that are missing, seen twice, and the seen keys that nobody expects."""
    counts = seen.groupBy(job, key).agg(F.count(F.lit(1)).alias("n"))
    both = expected.select(job, key, F.lit(True).alias("_e")).distinct().join(counts, [job, key], "full")
    kind = F.when(F.col("n").isNull(), "missing").when(F.col("_e").isNull(), "unknown").when(F.col("n") > 1, "repeated")
    return both.withColumn("problem", kind).where("problem is not null").select(job, key, "problem")


def plan_problems(ordered: Column, sections: Column, allowed: Column, extra: Column) -> Column:
    """DUP8, DUP9: what is wrong with a plan: an array of codes, empty if nothing is.

    ordered: ids in order; sections: the ids of each section, nested; allowed: all ids; extra: ids set aside.
    """
    check = lambda bad, code: F.when(bad, F.lit(code))
    return F.array_compact(F.array(
        check(F.size(ordered) != F.size(F.array_distinct(ordered)), "repeated"),
        check(F.size(F.array_except(ordered, allowed)) > 0, "unknown"),
        check(F.size(F.array_intersect(ordered, extra)) > 0, "not_disjoint"),
        check(F.size(F.array_except(allowed, F.array_union(ordered, extra))) > 0, "not_covered"),
        check(~F.flatten(sections).eqNullSafe(ordered), "sections_differ"),
    ))


def layered_list(base: Column, add: Column, remove: Column) -> Column:
    """DUP10: base without remove, then add, each once in order."""
    return F.array_union(F.array_except(base, remove), add)


def patched_list(current: Column, patch: Column, remove: Column) -> Column:
    """DUP11: both without remove, sorted."""
    return F.array_sort(F.array_except(F.array_union(current, patch), remove))


def overlap_ratio(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """DUP13: shared length over the shorter one; 0 without overlap."""
    shared = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    return F.coalesce(F.try_divide(shared, F.least(a_end - a_start, b_end - b_start)), F.lit(0.0))


def pair_similarity(rows: DataFrame, job: str, key: str, text: str, *, least: float, least_chars: int = 6, few: int = 64) -> DataFrame:
    """DUP4: pairs of a job whose sets of neighbouring characters are as similar as least (Jaccard): a, b, similarity.

    The sets are written once. Rows of a job of few rows meet directly, at most few / 2 pairs a row. In larger jobs sets meet
    by their rarest elements within the job: a pair that is similar enough shares one of the first n - ceil(least * n) + 1
    of each set, so not all rows are compared with one another.
    """
    sets = rows.select(job, F.col(key).alias("id"), character_pairs(F.col(text)).alias("ps"), F.length(text).alias("chars")).where(F.col("chars") >= least_chars).drop("chars")
    sets = checkpointed(sets.withColumn("n", F.size("ps")))
    sizes = sets.groupBy(job).agg(F.count(F.lit(1)).alias("_rows"))
    own = sets.select(job, "id", "n").join(sizes, job)
    near = own.where(F.col("_rows") <= few).where("n > 0").select(job, "id", "n")
    x, y = near.select(job, F.col("id").alias("a"), F.col("n").alias("na")), near.select(job, F.col("id").alias("b"), F.col("n").alias("nb"))
    direct = x.join(y, job).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb"))).select(job, "a", "b")
    crowded = sizes.where(F.col("_rows") > few).select(job)
    each = sets.join(crowded, job, "left_semi").select(job, "id", "n", F.explode("ps").alias("p"))
    often = each.groupBy(job, "p").agg(F.count(F.lit(1)).alias("df"))
    ranked = each.join(often, [job, "p"]).withColumn("at", F.row_number().over(Window.partitionBy(job, "id").orderBy("df", "p")))
    prefix = ranked.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select(job, "id", "p")
    met = prefix.alias("x").join(prefix.alias("y"), (F.col(f"x.{job}") == F.col(f"y.{job}")) & (F.col("x.p") == F.col("y.p")) & (F.col("x.id") < F.col("y.id"))).select(F.col(f"x.{job}"), F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    pairs = direct.union(met)
    pa, pb = sets.select(job, F.col("id").alias("a"), F.col("ps").alias("pa"), F.col("n").alias("na")), sets.select(job, F.col("id").alias("b"), F.col("ps").alias("pb"), F.col("n").alias("nb"))
    both = pairs.join(pa, [job, "a"]).join(pb, [job, "b"]).select(job, "a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).alias("_shared"))
    return both.withColumn("similarity", F.col("_shared") / (F.col("na") + F.col("nb") - F.col("_shared"))).where(F.col("similarity") >= least).select(job, "a", "b", "similarity")


def free_suffix(wanted: DataFrame, used: DataFrame, name: str, *, first: int = 1) -> DataFrame:
    """SNK10: for each wanted name the first of name, name-first, name-(first + 1), … that isn't used (case aside).

    Only the used names of the form name or name-number are looked at; the free number is the first gap among them.
    """
    w = wanted.select(name).distinct().withColumn("_key", F.lower(name))
    u = used.select(F.lower(name).alias("_u")).distinct()
    base = F.regexp_extract("_u", r"^(.*?)(?:-(\d{1,9}))?$", 1)
    number = F.regexp_extract("_u", r"^(.*?)(?:-(\d{1,9}))?$", 2)
    split = u.select(base.alias("_key"), F.when(number == "", F.lit(first - 1)).otherwise(number.try_cast("int")).alias("k"), F.col("_u"))
    plain = u.select(F.col("_u").alias("_key"), F.lit(first - 1).alias("k"), "_u")
    taken = split.union(plain).where((F.col("_u") == F.col("_key")) | (F.col("_u") == F.concat("_key", F.lit("-"), F.col("k").cast("string")))).where(F.col("k") >= first - 1).select("_key", "k").distinct()
    seats = w.join(taken, "_key", "left").where(F.coalesce("k", F.lit(first - 1)) >= first - 1)
    row = F.row_number().over(Window.partitionBy(name).orderBy("k"))
    gap = seats.withColumn("_g", F.when(F.col("k").isNull(), first - 1).when(F.col("k") != row + (first - 2), row + (first - 2)))
    last = gap.groupBy(name).agg(F.min("_g").alias("_g"), F.max("k").alias("_m"))
    free = F.coalesce("_g", F.col("_m") + 1)
    return last.select(name, F.when(free == first - 1, F.col(name)).otherwise(F.concat(name, F.lit("-"), free.cast("string"))).alias("free_name"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
