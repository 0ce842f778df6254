"""Dependencies between rows: closure, missing and circular requirements, blocks.

Reachability grows by doubling: each round joins the known pairs with themselves, so a chain of n rows takes log2(n)
rounds, and a circle ends as no new pair appears. Pairs stay within a job; the number of new pairs alone comes to the
driver. Between rounds the pairs are checkpointed into the folder of spark.checkpoint.dir.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage through reliable storage."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="cuelattice-"))
    return df.checkpoint()


def reachable(edges: DataFrame, job: str, source: str = "id", target: str = "need") -> DataFrame:
    """GRAPH1: all pairs (job, source, target) with a path between them, of one edge or more."""
    pairs = checkpointed(edges.select(job, source, target).where(F.col(source).isNotNull() & F.col(target).isNotNull()).distinct())
    size = pairs.count()
    while True:
        a, b = pairs.alias("a"), pairs.alias("b")
        step = a.join(b, (F.col(f"a.{job}") == F.col(f"b.{job}")) & (F.col(f"a.{target}") == F.col(f"b.{source}"))).select(F.col(f"a.{job}").alias(job), F.col(f"a.{source}").alias(source), F.col(f"b.{target}").alias(target))
        grown = checkpointed(pairs.union(step).distinct())
        now = grown.count()
        if now == size:
            return pairs
        pairs, size = grown, now


def dependency_states(rows: DataFrame, edges: DataFrame, job: str, key: str = "id", need: str = "need", paths: DataFrame | None = None) -> DataFrame:
    """GRAPH1, GRAPH2: (job, key, state) of each row: missing (it needs, over any path, a row that isn't there), cycle (it is in or leads to a circle), else valid. paths: reachable(edges), if it is at hand."""
    paths = reachable(edges, job, key, need) if paths is None else paths
    there = rows.select(job, F.col(key).alias(need), F.lit(True).alias("_there"))
    missing = paths.join(there, [job, need], "left").where("_there is null").select(job, key).distinct().withColumn("_missing", F.lit(True))
    circles = paths.where(F.col(key) == F.col(need)).select(job, F.col(key).alias("_c"))
    leads = paths.join(circles, (paths[job] == circles[job]) & (paths[need] == circles["_c"]), "left_semi").select(job, key).distinct().withColumn("_cycle", F.lit(True))
    out = rows.select(job, key).join(missing, [job, key], "left").join(leads, [job, key], "left")
    state = F.when(F.col("_missing"), "missing").when(F.col("_cycle"), "cycle").otherwise("valid")
    return out.select(job, key, state.alias("state"))


def closure_of(requested: DataFrame, rows: DataFrame, edges: DataFrame, job: str, key: str = "id", need: str = "need") -> DataFrame:
    """GRAPH1: the requested rows and all they need, if that is whole and without circles: (job, key)."""
    paths = reachable(edges, job, key, need)
    states = dependency_states(rows, edges, job, key, need, paths)
    valid = requested.select(job, key).join(states.where("state = 'valid'"), [job, key], "left_semi")
    return valid.union(paths.join(valid, [job, key], "left_semi").select(job, F.col(need).alias(key))).distinct()


def dependency_blocks(rows: DataFrame, edges: DataFrame, job: str, *, key: str = "id", need: str = "need", topic: str = "topic", facts: str = "facts", usable: Column, start: str = "start", end: str = "end") -> DataFrame:
    """GRAPH3: for each root its whole closure as a block: members, topic, start, end, length.

    A root has no block if its closure is not valid, has a row that isn't usable, several topics, or one fact twice.
    """
    paths = reachable(edges, job, key, need)
    states = dependency_states(rows, edges, job, key, need, paths).where("state = 'valid'").select(job, F.col(key).alias("root"))
    members = paths.select(job, F.col(key).alias("root"), F.col(need).alias(key)).union(rows.select(job, F.col(key).alias("root"), key)).distinct()
    members = members.join(states, [job, "root"], "left_semi").join(rows.withColumn("_ok", usable), [job, key])
    out = members.groupBy(job, "root").agg(
        F.array_sort(F.collect_list(key)).alias("members"), F.min(topic).alias("topic"), F.count_distinct(topic).alias("_topics"), F.min("_ok").alias("_ok"), F.flatten(F.collect_list(facts)).alias("_facts"),
        F.min(start).alias("start"), F.max(end).alias("end"), F.sum(F.col(end) - F.col(start)).alias("length"),
    )
    return out.where((F.col("_topics") == 1) & F.col("_ok") & (F.size("_facts") == F.size(F.array_distinct("_facts")))).drop("_topics", "_ok", "_facts")


def merged_blocks(blocks: DataFrame, job: str) -> DataFrame:
    """GRAPH4: blocks (root, members) that share a member as one: (job, block, members), block being its least root.

    Each round hooks every label to the least label that any of its blocks meets in a member, follows the hooks to their
    ends by doubling, and relabels. Of two labels that meet one ends, so the rounds are logarithmic.
    """
    each = checkpointed(blocks.select(job, "root", F.explode("members").alias("m")))
    labels = checkpointed(blocks.select(job, "root", F.col("root").alias("block")).distinct())
    while True:
        held = each.join(labels, [job, "root"]).select(job, "m", "block").distinct()
        least = held.groupBy(job, "m").agg(F.min("block").alias("_least"))
        hooks = checkpointed(held.join(least, [job, "m"]).groupBy(job, "block").agg(F.min("_least").alias("to")))
        moved = hooks.where("block <> to")
        if not moved.limit(1).count():
            break
        while True:
            ends = hooks.select(job, F.col("block").alias("to"), F.col("to").alias("_far"))
            hooks = checkpointed(hooks.join(ends, [job, "to"]).select(job, "block", F.col("_far").alias("to"), (F.col("to") != F.col("_far")).alias("_changed")))
            if not hooks.where("_changed").limit(1).count():
                break
        labels = checkpointed(labels.join(hooks, [job, "block"]).select(job, "root", F.col("to").alias("block")))
    return each.join(labels, [job, "root"]).groupBy(job, "block").agg(F.array_sort(F.collect_set("m")).alias("members"))


def ordered_blocks(blocks: DataFrame, plan: DataFrame, job: str) -> DataFrame:
    """GRAPH4: each merged block (job, block, members) once, at the place of its first mention in a plan (job, pos, id).

    Ids of the plan that are in no block are left out. Gives (job, place, block, members), places from 1.
    """
    each = blocks.select(job, "block", F.explode("members").alias("id"))
    first = plan.join(each, [job, "id"]).groupBy(job, "block").agg(F.min("pos").alias("pos"))
    place = F.row_number().over(Window.partitionBy(job).orderBy("pos", "block"))
    return first.withColumn("place", place).join(blocks, [job, "block"]).select(job, "place", "block", "members")
