"""Minimax contiguous partition of ordered atomic groups into shards, in DataFrame functions only.

Equal texts share a hash and so a group; groups are ordered by hash. Sizes are summed by the leading digits of the hash,
which gives a list of bounded length however long the table. On that list a binary search finds the smallest capacity for
which a greedy pass needs no more than the given number of shards. It is found twice: with every bucket whole, and with
buckets of several groups divisible at will. The true optimum lies between the two; where they differ, only the buckets in
which a cut can fall are summed by further digits, until the two agree or no such bucket holds more than one group. The
list is cut there. Documents never move: a row's shard follows from its hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, salted_rank


def _greedy(items: Column, capacity: Column, fluid: bool) -> Column:
    """(shards, load, at, cuts) of a greedy pass over items (prefix, size, atom): cuts are the sums of sizes before each new shard.

    fluid: items that are no atoms may be divided.
    """
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(1).cast("long").alias("shards"), zero.alias("load"), zero.alias("at"), F.array().cast("array<bigint>").alias("cuts"))

    def state(shards: Column, load: Column, at: Column, cuts: Column) -> Column:
        return F.struct(shards.alias("shards"), load.alias("load"), at.alias("at"), cuts.alias("cuts"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["size"]
        out = F.when(acc["load"] + x["size"] <= capacity, state(acc["shards"], acc["load"] + x["size"], at, acc["cuts"]))
        if fluid:
            over = acc["load"] + x["size"] - capacity
            more = F.ceil(over / capacity).cast("long")
            cuts = F.transform(F.sequence(F.lit(0).cast("long"), more - 1), lambda k: at - over + k * capacity)
            out = out.when(~x["atom"], state(acc["shards"] + more, over - (more - 1) * capacity, at, F.concat(acc["cuts"], cuts)))
        return out.otherwise(state(acc["shards"] + 1, x["size"], at, F.array_append(acc["cuts"], acc["at"])))

    return F.aggregate(items, start, step)


def _shards_needed(items: Column, capacity: Column, fluid: bool) -> Column:
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(1).cast("long").alias("shards"), zero.alias("load"))

    def step(acc: Column, x: Column) -> Column:
        load = acc["load"] + x["size"]
        out = F.when(load <= capacity, F.struct(acc["shards"].alias("shards"), load.alias("load")))
        if fluid:
            more = F.ceil((load - capacity) / capacity).cast("long")
            out = out.when(~x["atom"], F.struct((acc["shards"] + more).alias("shards"), (load - more * capacity).alias("load")))
        return out.otherwise(F.struct((acc["shards"] + 1).alias("shards"), x["size"].alias("load")))

    return F.aggregate(items, start, step)["shards"]


def smallest_capacity(items: Column, shards: int, *, fluid: bool = False, rounds: int = 62) -> Column:
    """The smallest capacity with which a greedy pass over the items (prefix, size, atom) needs at most so many shards."""
    zero = F.lit(0).cast("long")
    total = F.aggregate(items, zero, lambda a, x: a + x["size"])
    largest = F.aggregate(items, zero, lambda a, x: F.greatest(a, F.when(x["atom"] | F.lit(not fluid), x["size"]).otherwise(zero)))
    even = F.ceil(total / F.lit(shards)).cast("long")
    start = F.struct(F.greatest(largest, even, F.lit(1).cast("long")).alias("low"), F.greatest(F.least(total, even + largest), F.lit(1).cast("long")).alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["low"] + acc["high"]) / 2).cast("long")
        fits = F.struct(acc["low"].alias("low"), mid.alias("high"))
        more = F.struct((mid + 1).alias("low"), acc["high"].alias("high"))
        return F.when(acc["low"] >= acc["high"], acc).when(_shards_needed(items, mid, fluid) <= shards, fits).otherwise(more)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve)["high"]


def _spans(early: Column, late: Column) -> Column:
    """The sums of sizes (a, b) between which each cut lies."""
    return F.transform(F.arrays_zip(early.alias("a"), late.alias("b")), lambda w: F.struct(w["a"].alias("a"), F.coalesce(w["b"], F.lit(2**62)).alias("b")))


def _open_items(items: Column, low: Column, spans: Column) -> Column:
    """Prefixes of the items to look into: those of several groups that are large, or if none is, in which a cut can fall."""
    large = F.transform(F.filter(items, lambda x: ~x["atom"] & (2 * x["size"] > low)), lambda x: x["prefix"])
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + x["size"]
        hit = ~x["atom"] & F.exists(spans, lambda w: (w["a"] < end) & (w["b"] >= acc["at"]))
        return F.struct(end.alias("at"), F.when(hit, F.array_append(acc["out"], x["prefix"])).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(large) > 0, large).otherwise(F.aggregate(items, start, step)["out"])


def _grid(rows: DataFrame, digits: int) -> DataFrame:
    return rows.groupBy(F.substring("h", 1, digits).alias("prefix")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), (F.min("h") == F.max("h")).alias("atom"))


def minimax_cuts(rows: DataFrame, shards: int, *, digits: int = 4, more_digits: int = 2) -> tuple[DataFrame, DataFrame]:
    """From rows (h, size): the cuts (shard, first, load), and the list (prefix, size, n, atom) that was cut.

    A shard holds the hashes from first up to the next shard's. Cuts lie between groups of equal h, and the largest load is
    as small as any such cuts allow.
    """
    grid = materialize(_grid(rows, digits))
    while True:
        items = F.col("items")
        # Each step is written: what the next one's lambdas name must be a column, not an expression run again for each item.
        one = materialize(grid.agg(F.sort_array(F.collect_list(F.struct("prefix", "size", "atom"))).alias("items")))
        one = materialize(one.select("items", smallest_capacity(items, shards).alias("high"), smallest_capacity(items, shards, fluid=True).alias("low")))
        cut = materialize(one.where("low < high").select("items", "low", _spans(_greedy(items, F.col("low"), False)["cuts"], _greedy(items, F.col("high"), True)["cuts"]).alias("spans")))
        found = materialize(cut.select(F.explode(_open_items(items, F.col("low"), F.col("spans"))).alias("prefix")))
        lengths = [r[0] for r in found.select(F.length("prefix")).distinct().limit(32).collect()]
        if not lengths:
            break
        finer = grid.join(F.broadcast(found), "prefix", "left_anti")
        for n in lengths:
            part = rows.withColumn("prefix", F.substring("h", 1, n)).join(F.broadcast(found.where(F.length("prefix") == n)), "prefix", "left_semi")
            finer = finer.unionByName(_grid(part, n + more_digits))
        was, grid = grid, materialize(finer)
        discard(was)

    def step(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        fits = last["load"] + r["size"] <= F.col("high")
        new = F.when(fits, F.struct(last["shard"].alias("shard"), last["first"].alias("first"), (last["load"] + r["size"]).alias("load"))).otherwise(F.struct((last["shard"] + 1).alias("shard"), r["prefix"].alias("first"), r["size"].alias("load")))
        return F.when(fits, F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), new)).otherwise(F.array_append(acc, new))

    first = F.array(F.struct(F.lit(0).alias("shard"), F.lit("").alias("first"), F.lit(0).cast("long").alias("load")))
    return one.select(F.explode(F.aggregate("items", first, step)).alias("c")).select("c.shard", "c.first", "c.load"), grid


def salt_digits(rows: int, per_salt: int = 200_000) -> int:
    """Hex digits of a salt that keep the rows of each near per_salt even if one shard has all."""
    return max(2, math.ceil(math.log(max(1, rows / per_salt), 16)))


def shard_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, digits: int = 4) -> DataFrame:
    """One row per input row: (id_col, size, text_crc32, law, shard, slot, grown_shard) under the law `bytes`.

    size: UTF-8 bytes of the text (null: none) plus 8. Equal texts share a shard, null counts as empty. Groups are equal
    texts in the order of their hashes, and the largest shard is the smallest that contiguous runs of groups allow. digits:
    the first list has 16 ** digits buckets at most. slot runs from 0 in each shard without gaps; repeated rows take a slot
    each, null ids too. An empty table gives none. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = materialize(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("h")))
    cuts, sums = minimax_cuts(rows.select("h", "size"), shards, digits=digits)
    firsts = [r["first"] for r in cuts.orderBy("shard").limit(shards).collect()]  # one for each shard
    total = sums.agg(F.sum("n")).first()[0] or 0
    shard = sum(((F.col("h") >= first).cast("int") for first in firsts[1:]), F.lit(0))
    salt = F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), "h")), 1, salt_digits(total))
    placed = rows.select("id", "size", "text_crc32", shard.cast("int").alias("shard"), salt.alias("at"))
    ranked = salted_rank(placed, ["shard"], ["id", "text_crc32"], F.col("at"), "slot")
    return ranked.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
