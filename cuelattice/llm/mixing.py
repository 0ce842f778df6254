"""Mixing sources to target weights with hash thresholds.

Each source's target is a share of all words by its weight. A source takes every document floor(target / size) times and
the documents whose hash is below a threshold once more. The threshold comes from nested histograms: words are summed by
source and hash bucket, the bucket in which the budget runs out is the only one refined, until it holds one hash. No
document is sorted, and only histograms meet. What a whole document would overshoot is filled in further passes over the
documents that still fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, word_count

HASH_DIGITS, LEVEL_DIGITS = 15, 3


def hash_digits(key: Column) -> Column:
    """A hash of the key as 15 hexadecimal digits, 60 bits."""
    return F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, HASH_DIGITS)


def source_targets(sizes: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), most_repeats: int = 3) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources by code point, null last, take the weights in turn and share the sum of all sizes by weight; a target stops at
    most_repeats times its source's size and the excess is shared again. Water filling in closed form: sources by
    most_repeats * size / weight are full up to a level, all others get the level times their weight. The table has one row
    for each source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(most_repeats)))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rows = rows.withColumns({"full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "rest_w": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)), "all": F.sum("source_size").over(every).cast("double")})
    rows = rows.withColumn("level", (F.col("all") - F.col("full")) / F.col("rest_w"))
    # The first source that the level doesn't fill; from there on all have that level.
    first = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), "level"))).over(every)
    return rows.withColumn("lev", first["level"]).select("source", "source_size", F.least(F.col("cap"), F.col("lev") * F.col("w")).alias("target"))


def _thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, cut, used): the hashes below cut fit the budget whole, with used words; a null cut takes all.

    rows: source, h, size; budgets: source, budget.
    """
    state = budgets.select("source", "budget", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("used"), F.lit(False).alias("all"))
    for depth in range(LEVEL_DIGITS, HASH_DIGITS + 1, LEVEL_DIGITS):
        s, r = state.where("not all").alias("s"), rows.alias("r")
        inside = r.join(s, F.col("r.source").eqNullSafe(F.col("s.source")) & F.col("r.h").startswith(F.col("s.prefix")))
        hist = inside.groupBy(F.col("s.source").alias("source"), F.substring("r.h", 1, depth).alias("bucket")).agg(F.sum("r.size").alias("words"), F.max("s.budget").alias("budget"), F.max("s.used").alias("base"), (F.min("r.h") == F.max("r.h")).alias("single"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("cum", F.col("base") + F.sum("words").over(upto))
        over = F.col("cum") > F.col("budget")
        edge = hist.groupBy("source").agg(F.min(F.when(over, F.struct("bucket", (F.col("cum") - F.col("words")).alias("under"), "single"))).alias("e"), F.max("cum").alias("total"))
        n, o = edge.alias("n"), state.alias("o")
        state = o.join(n, F.col("o.source").eqNullSafe(F.col("n.source")), "left").select(
            "o.source", "o.budget",
            F.when(F.col("o.all"), F.col("o.prefix")).otherwise(F.coalesce(F.col("n.e.bucket"), F.col("o.prefix"))).alias("prefix"),
            F.when(F.col("o.all"), F.col("o.used")).otherwise(F.coalesce(F.col("n.e.under"), F.col("n.total"), F.col("o.used"))).alias("used"),
            (F.col("o.all") | F.col("n.e").isNull()).alias("all"), F.coalesce("n.e.single", F.lit(False)).alias("single"),
        )
        state = materialize(state)
        if not state.where("not all and not single").limit(1).count():
            break  # every boundary bucket holds one hash: no further digit moves a threshold
        state = state.drop("single")
        if depth == LEVEL_DIGITS:  # later levels read the boundary buckets alone
            s, r = state.where("not all").alias("s"), rows.alias("r")
            rows = materialize(r.join(s, F.col("r.source").eqNullSafe(F.col("s.source")) & F.col("r.h").startswith(F.col("s.prefix"))).select("r.*"))
    return state.select("source", F.when(~F.col("all"), F.col("prefix")).alias("cut"), "used")


def sized_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, h): words of the text and hash of the id."""
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")).withColumn("h", hash_digits(F.col("id")))


def plan_mix(rows: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), most_repeats: int = 3, passes: int = 3) -> DataFrame:
    """(source, source_size, target, base, cuts, left) from (source, size, h): one row for each source.

    Every document is taken base times, and once more if one of the cuts takes it; left is what no pass could fill.
    """
    targets = materialize(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, most_repeats=most_repeats))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("base", whole).withColumn("budget", F.floor(F.col("target") - F.col("base") * F.col("source_size")).cast("long"))
    plan = materialize(plan.withColumn("left", F.when(F.col("base") >= most_repeats, F.lit(0).cast("long")).otherwise(F.col("budget"))))

    cuts: DataFrame = plan.select("source", "source_size", "target", "base", F.array().cast("array<struct<cut:string,fits:bigint>>").alias("cuts"), "left")
    for _ in range(passes):
        r, c = rows.alias("r"), cuts.where("left > 0").alias("c")
        open_rows = r.join(c, F.col("r.source").eqNullSafe(F.col("c.source"))).where(F.col("r.size") <= F.col("c.left")).where(~_taken(F.col("c.cuts"), F.col("r.h"), F.col("r.size"))).select("r.source", "r.h", "r.size")
        found = _thresholds(open_rows, cuts.where("left > 0").select("source", F.col("left").alias("budget")))
        f, o = found.alias("f"), cuts.alias("o")
        joined = o.join(f, F.col("o.source").eqNullSafe(F.col("f.source")), "left")
        step = F.struct(F.col("f.cut").alias("cut"), F.col("o.left").alias("fits"))
        cuts = materialize(joined.select("o.source", "o.source_size", "o.target", "o.base", F.when(F.col("f.used").isNotNull(), F.array_append("o.cuts", step)).otherwise(F.col("o.cuts")).alias("cuts"), (F.col("o.left") - F.coalesce("f.used", F.lit(0))).alias("left")))
    return cuts


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), most_repeats: int = 3, passes: int = 3) -> DataFrame:
    """One row per input row: (id_col, size, source_size, target, copies, taken).

    size: words [^\\x20\\x09-\\x0D]+ of the text (null: 0). copies is how often the mix takes the document whole, taken the
    words of all copies. A source's taken words do not exceed its target. Each pass takes documents that still fit in what
    the one before it left, in the order of their hashes, up to the first that does not: what is missing after the first
    pass is less than one document, and less than a smaller one after each further pass. Rows of equal id, source and size are decided alike; a null source is a
    source of its own; a null id hashes as one id. Empty texts take part with size 0. An empty table gives none. Other
    columns are ignored. Reruns agree, as hashes depend on ids alone.
    """
    rows = materialize(sized_documents(docs, id_col=id_col, text_col=text_col, source_col=source_col))
    plan = plan_mix(rows, weights=weights, most_repeats=most_repeats, passes=passes)
    r, c = rows.alias("r"), plan.alias("c")
    copies = _copies(F.col("c.base"), F.col("c.cuts"), F.col("r.h"), F.col("r.size"))
    return r.join(c, F.col("r.source").eqNullSafe(F.col("c.source"))).select(F.col("r.id").alias(id_col), F.col("r.size").alias("size"), F.col("c.source_size").alias("source_size"), F.col("c.target").alias("target"), copies.alias("copies"), (copies * F.col("r.size")).alias("taken"))


def take_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), most_repeats: int = 3, passes: int = 3) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken.

    The plan has a row for each source and meets the documents by source, so whole texts stay where they are as long as
    Spark finds the plan small enough to broadcast. Columns keep their names, whatever they are; see mix_sources for nulls,
    repeated rows and empty tables.
    """
    names = {"id_col": id_col, "text_col": text_col, "source_col": source_col}
    plan = plan_mix(materialize(sized_documents(docs, **names)), weights=weights, most_repeats=most_repeats, passes=passes)
    own = {c: f"d{k}" for k, c in enumerate(docs.columns)}  # names that clash with none of the plan's
    d, c = docs.select(*[F.col(name).alias(short) for name, short in own.items()]), plan
    copies = _copies(F.col("base"), F.col("cuts"), hash_digits(F.col(own[id_col])), word_count(F.col(own[text_col])))
    many = d.join(c, F.col(own[source_col]).cast("string").eqNullSafe(F.col("source"))).select(*own.values(), copies.alias("copies")).where("copies > 0")
    return many.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*[F.col(short).alias(name) for name, short in own.items()])


def _copies(base: Column, cuts: Column, h: Column, size: Column) -> Column:
    return base + F.when(_taken(cuts, h, size), 1).otherwise(0)


def _taken(cuts: Column, h: Column, size: Column) -> Column:
    """Whether one of the passes takes a document: it fits there and its hash is below the cut."""
    return F.exists(cuts, lambda c: (size <= c["fits"]) & F.coalesce(h < c["cut"], F.lit(True)))
