"""Joins over time: overlap, point in interval, greatest overlap, nearest, tolerance.

Every join has an equality on its job (or source) and, where both sides of a job can be long, on a time bucket: an
interval is listed in each bucket it touches, and a pair counts in the bucket where its overlap begins. A job's rows are
then dealt over many tasks, and no pair of far-apart rows is ever looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _bucketed(df: DataFrame, start: Column, end: Column, width: float, out: str) -> DataFrame:
    low, high = F.floor(start / width).cast("long"), F.floor(end / width).cast("long")
    return df.withColumn(out, F.explode(F.sequence(low, F.greatest(low, high))))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], *, bucket: float, slack: float = 0, how: str = "inner") -> DataFrame:
    """FLT10, JOIN1-3, JOIN8, JOIN9: pairs of equal keys whose half-open spans overlap: l.start < r.end - slack and l.end > r.start + slack.

    The columns of both sides keep their names; right columns that clash (keys aside) must be renamed before. Rows of null
    keys or bounds match nothing. how: inner, or left to keep the left rows without a match.
    """
    ls, le, rs, re_ = (F.col(c) for c in (*left_span, *right_span))
    own = list(dict.fromkeys([*keys, *left_span]))  # what a match depends on; rows get no numbers, which a retried task could change
    asked = left.select(*own).distinct() if how == "left" else left
    a = _bucketed(asked.where(ls.isNotNull() & le.isNotNull()), ls, le, bucket, "_bucket")
    b = _bucketed(right.where(rs.isNotNull() & re_.isNotNull()), rs, re_, bucket, "_bucket")
    pairs = a.join(b, [*keys, "_bucket"]).where((ls < re_ - slack) & (le > rs + slack)).where(F.col("_bucket") == F.floor(F.greatest(ls, rs) / bucket)).drop("_bucket")
    if how != "left":
        return pairs
    extra = [c for c in right.columns if c not in keys]
    return left.join(pairs.select(*own, *extra), own, "left").select(*left.columns, *extra)


def map_range(pairs: DataFrame, span: tuple[str, str], segment: tuple[str, str], source_start: str, speed: Column) -> DataFrame:
    """JOIN1: the piece of a span on a segment, on both clocks: piece_start, piece_end, source_start, source_end."""
    lo, hi = F.greatest(F.col(span[0]), F.col(segment[0])), F.least(F.col(span[1]), F.col(segment[1]))
    at = lambda t: F.col(source_start) + (t - F.col(segment[0])) * speed
    return pairs.withColumns({"piece_start": lo, "piece_end": hi, "source_from": at(lo), "source_to": at(hi)})


def first_slice(mapped: DataFrame, keys: list[str], order: list[str], fields: list[str], missing: str = "未知片段") -> DataFrame:
    """JOIN2: one row per key: the number of slices, the first by order, and all of them as an array; unmatched rows are marked."""
    item = F.struct(*order, *fields)
    found = F.sort_array(F.collect_list(F.when(F.col(order[0]).isNotNull(), item)))
    out = mapped.groupBy(*keys).agg(found.alias("slices"))
    return out.withColumns({"n_slices": F.size("slices"), "primary": F.get("slices", F.lit(0)), "note": F.when(F.size("slices") == 0, missing).otherwise("")})


def owner_join(points: DataFrame, spans: DataFrame, keys: list[str], at: Column, span: tuple[str, str], rank: str, *, bucket: float, slack: float = 1e-6) -> DataFrame:
    """JOIN4: each point with the rank of the first span (by rank) that holds it, ends included; null without one."""
    tagged = points.withColumn("_at", at)
    a = tagged.select(*keys, "_at").distinct().withColumn("_bucket", F.floor(F.col("_at") / bucket).cast("long"))
    b = _bucketed(spans.select(*keys, *span, rank), F.col(span[0]) - slack, F.col(span[1]) + slack, bucket, "_bucket")
    hit = a.join(b, [*keys, "_bucket"]).where((F.col("_at") >= F.col(span[0]) - slack) & (F.col("_at") <= F.col(span[1]) + slack))
    owner = hit.groupBy(*keys, "_at").agg(F.min(rank).alias("owner"))
    return tagged.join(owner, [*keys, "_at"], "left").select(*points.columns, "owner")


def rebase(segments: DataFrame, job: str, order: str, span: tuple[str, str]) -> DataFrame:
    """JOIN5: the segments on the clock of their concatenation: base, base_end; gaps are gone."""
    length = F.col(span[1]) - F.col(span[0])
    w = Window.partitionBy(job).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum(length).over(w), F.lit(0))
    last = F.row_number().over(Window.partitionBy(job).orderBy(F.col(order).desc())) == 1
    return segments.withColumns({"base": base, "base_end": base + length, "is_last": last})


def greatest_overlap(items: DataFrame, spans: DataFrame, keys: list[str], item: str, item_span: tuple[str, str], span: tuple[str, str], rank: str, *, bucket: float) -> DataFrame:
    """JOIN6: each item with the span it overlaps most, the first of equals; without overlap the one of nearest midpoint.

    The fallback looks at the spans before and after the item alone (by start), so a job's items and spans never meet in
    all pairs.
    """
    over = overlap_join(items, spans, keys, item_span, span, bucket=bucket)
    shared = F.least(F.col(item_span[1]), F.col(span[1])) - F.greatest(F.col(item_span[0]), F.col(span[0]))
    best = over.groupBy(*keys, item).agg(F.max_by(F.col(rank), F.struct(shared, -F.col(rank))).alias("by_overlap"))
    mid = lambda s: (F.col(s[0]) + F.col(s[1])) / 2
    both = items.select(*keys, item, mid(item_span).alias("_m"), F.lit(None).cast("struct<m:double,r:bigint>").alias("_s")).unionByName(
        spans.select(*keys, F.lit(None).cast(dict(items.dtypes)[item]).alias(item), mid(span).alias("_m"), F.struct(mid(span).cast("double").alias("m"), F.col(rank).cast("long").alias("r")).alias("_s"))
    )
    left = F.last("_s", True).over(Window.partitionBy(*keys).orderBy("_m", F.col("_s.r").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    right = F.first("_s", True).over(Window.partitionBy(*keys).orderBy("_m", F.col("_s.r").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing))
    near = both.withColumns({"_l": left, "_r": right}).where(F.col(item).isNotNull())
    dl, dr = F.col("_m") - F.col("_l.m"), F.col("_r.m") - F.col("_m")
    near = near.select(*keys, item, F.when(F.col("_r").isNull() | (dl <= dr), F.col("_l.r")).otherwise(F.col("_r.r")).alias("by_midpoint"))
    out = items.join(best, [*keys, item], "left").join(near, [*keys, item], "left")
    return out.withColumn("segment", F.coalesce("by_overlap", "by_midpoint")).withColumn("overlaps", F.col("by_overlap").isNotNull()).drop("by_overlap", "by_midpoint")


def nearest_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, other_at: str, rank: str, *, within: float) -> DataFrame:
    """JOIN11, TOPK9: the right row nearest in time, at most within away, the first by rank of equals; adds nearest and distance.

    Buckets of that width: a partner lies in the point's own or a neighbouring bucket.
    """
    own = F.floor(F.col(at) / within).cast("long")
    a = left.select(*keys, at).distinct().withColumn("_bucket", F.explode(F.array(own - 1, own, own + 1)))
    b = right.select(*keys, other_at, rank).withColumn("_bucket", F.floor(F.col(other_at) / within).cast("long"))
    far = F.abs(F.col(at) - F.col(other_at))
    hit = a.join(b, [*keys, "_bucket"]).where(far <= within).groupBy(*keys, at).agg(F.min(F.struct(far.alias("distance"), F.col(rank).alias("nearest"))).alias("_n"))
    return left.join(hit, [*keys, at], "left").select(*left.columns, F.col("_n.nearest").alias("nearest"), F.col("_n.distance").alias("distance"))


def tolerance_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, other_at: str, rank: str, *, within: float) -> DataFrame:
    """JOIN10: the first right row by rank whose time differs by less than within; adds matched, null without one."""
    own = F.floor(F.col(at) / within).cast("long")
    a = left.select(*keys, at).distinct().withColumn("_bucket", F.explode(F.array(own - 1, own, own + 1)))
    b = right.select(*keys, other_at, rank).withColumn("_bucket", F.floor(F.col(other_at) / within).cast("long"))
    hit = a.join(b, [*keys, "_bucket"]).where(F.abs(F.col(at) - F.col(other_at)) < within).groupBy(*keys, at).agg(F.min(rank).alias("matched"))
    return left.join(hit, [*keys, at], "left").select(*left.columns, "matched")


def top_by_distance(left: DataFrame, right: DataFrame, keys: list[str], item: str, at: str, other_at: str, rank: str, *, most: int = 6) -> DataFrame:
    """JOIN12: up to most right rows by distance in time for each left row of equal keys, empty keys of the left matching any.

    Every right row of the first key is ranked, as the other keys may be empty; Spark's group limit keeps most of them.
    """
    named = [k for k in keys if k != keys[0]]
    joined = left.alias("l").join(right.alias("r"), (F.col(f"l.{keys[0]}") == F.col(f"r.{keys[0]}")))
    for k in named:
        joined = joined.where((F.col(f"l.{k}") == "") | (F.col(f"l.{k}") == F.col(f"r.{k}")))
    far = F.abs(F.col(f"l.{at}") - F.col(f"r.{other_at}"))
    w = Window.partitionBy(F.col(f"l.{keys[0]}"), F.col(f"l.{item}")).orderBy(far, F.col(f"r.{rank}"))
    return joined.select(F.col(f"l.{keys[0]}"), F.col(f"l.{item}"), F.col(f"r.{rank}").alias("candidate"), far.alias("distance"), F.row_number().over(w).alias("place")).where(F.col("place") <= most)


def self_overlap(rows: DataFrame, keys: list[str], pos: str, span: tuple[str, str], *, bucket: float, least: float) -> DataFrame:
    """JOIN24: rows whose span overlaps an earlier row's of the same keys by over least: the first such row and the overlap."""
    a = rows.select(*keys, pos, F.col(span[0]).alias("_s"), F.col(span[1]).alias("_e"))
    b = rows.select(*keys, F.col(pos).alias("_p"), F.col(span[0]).alias("_os"), F.col(span[1]).alias("_oe"))
    pairs = overlap_join(a, b, keys, ("_s", "_e"), ("_os", "_oe"), bucket=bucket).where(F.col("_p") < F.col(pos))
    shared = F.least("_e", "_oe") - F.greatest("_s", "_os")
    return pairs.where(shared > least).groupBy(*keys, pos).agg(F.min(F.struct(F.col("_p").alias("earlier"), shared.alias("overlap"))).alias("_m")).select(*keys, pos, "_m.earlier", "_m.overlap")
