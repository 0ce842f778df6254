"""Near-duplicate classes by bottom-k sketches.

One hash function maps each word shingle to 64 bits. The k smallest hashes of a document's set are its sketch. Inverted
lists of retained values generate pairs, the sketch of a pair's union estimates its Jaccard similarity and filters, and
the full sets decide.

Why no link is lost: of the k smallest values of a union, each lies in the intersection with probability J. Two linked
documents therefore share at least o retained values, where o is chosen so that fewer have a probability below 1e-10
(of the order of hash collisions). A document need then be listed only under the k - o + 1 values of its sketch that
the fewest documents retain: one of the shared values is among them. Values of common passages stay out of the lists
in this way, without any cap.

Groups of copies never meet in all pairs: equal sets are one class from the start, and the members of long lists are
listed anew by their full sets, by size and place, where each list first compares its members with one pivot. Only what
is not in one component after that is compared pair by pair, in full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, arrow_rows, discard, materialize, release_memory, sub_batches, text_bytes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
_LOSS = 1e-10


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64 bits (public-domain splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BYTE[_SPACE] = 0
_RADIX = np.uint64(0x9E3779B97F4A7C15 | 1)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each row the range of its words; A-Z count as a-z."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = space[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(before & ~space)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    spans = np.diff(starts, append=len(data))
    at = np.arange(starts[0], len(data)) - np.repeat(starts, spans)
    powers = np.full(int(spans.max()), _RADIX, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    values = _BYTE[_LOWER[data[starts[0] :]]] * powers[at]
    return mix64(np.add.reduceat(values, starts - starts[0])), np.searchsorted(starts, offsets)


def shingle_sets(col: pa.Array, width: int) -> list[np.ndarray]:
    """For each row its sorted distinct shingle hashes (int64); a row of fewer words than width has one, a row without words none."""
    words, at = word_hashes(*text_bytes(col))
    n = len(words)
    mixed = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        mixed = mixed * _RADIX + words[k : k + len(mixed)]
    mixed = mix64(mixed + np.uint64(width)).view(np.int64)
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= width:
            s = np.sort(mixed[lo : hi - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif hi > lo:
            h = np.uint64(0)
            for w in words[lo:hi]:
                h = np.multiply(h, _RADIX) + w
            out.append(mix64(np.array([h + np.uint64(hi - lo)], np.uint64)).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def least_overlap(k: int, num: int, den: int) -> int:
    """The most retained values that two documents of similarity num/den share but for a chance of 1e-10."""
    j, total = num / den, 0.0
    for o in range(k + 1):
        total += math.comb(k, o) * j**o * (1 - j) ** (k - o)
        if total > _LOSS:
            return max(1, o)
    return k


def _sketch_batches(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in sub_batches(batches, 1, 1 << 20):
            sets = shingle_sets(batch.column(1), width)
            with np.errstate(over="ignore"):
                spread = [mix64(s.view(np.uint64)) for s in sets]
                h1 = np.array([np.bitwise_xor.reduce(s) if len(s) else 0 for s in spread], np.uint64).view(np.int64)
                h2 = np.array([np.add.reduce(s) if len(s) else 0 for s in spread], np.uint64).view(np.int64)
            kept = [s[:k] for s in sets]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in kept]))).astype(np.int32)
            sketch = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1), pa.array(h2), sketch], ["id", "n", "h1", "h2", "sketch"])

    return run


def _set_batches(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in sub_batches(batches, 1, 1 << 20):
            sets = shingle_sets(batch.column(1), width)
            offsets = np.concatenate(([0], np.cumsum([min(k, len(s)) for s in sets]))).astype(np.int32)
            sketch = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([s[:k] for s in sets])))
            yield pa.RecordBatch.from_arrays([batch.column(0), sketch, pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "sketch", "items"])

    return run


def _verify_batches(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                yes.append(den * both >= num * (len(x) + len(y) - both))
            keep = pa.array(yes, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])
            release_memory()

    return run


def _keyed_lists(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Inverted lists of full sets (id, n, items), keyed so that only sets that could be linked by size and place meet.

    A set's values are ordered from those the fewest sets hold. Two linked sets of n and m values share at least
    a = ceil(num / (num + den) * (n + m)), so one of their first n - a + 1 and m - a + 1 values. Sizes fall into bands of
    4 %: a set is listed for each band that a partner may lie in under (value, the two bands) if its place is early
    enough for the smallest partner there. Rows: v, b1, b2, own (the set's band), id, n, at (place), alone (values that no
    other set holds).
    """
    values = sets.mapInArrow(_explode_batches, f"id {sets.schema['id'].dataType.simpleString()}, n long, v long")
    often = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ordered = values.join(often, "v").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    least = F.ceil(F.col("n") * num / den)
    ordered = ordered.withColumn("alone", F.col("n") - F.size("vs"))
    early = F.slice("vs", F.lit(1), F.greatest(F.lit(0), F.col("n") - least + 1 - F.col("alone")).cast("int"))["v"]
    band = lambda n: F.floor(F.log(n) / F.lit(math.log(1.04))).cast("int")
    rows = ordered.select("id", "n", "alone", least.alias("least"), band(F.col("n")).alias("own"), F.posexplode(early).alias("k", "v"))
    rows = rows.withColumn("at", F.col("alone") + F.col("k"))
    rows = rows.withColumn("band", F.explode(F.sequence(band(F.col("least")), band(F.floor(F.col("n") * den / num) + 1))))
    smallest = F.greatest(F.floor(F.pow(F.lit(1.04), F.col("band"))), F.col("least"))
    rows = rows.where(F.col("at") <= F.col("n") - F.ceil((F.col("n") + smallest) * num / (num + den)))
    rows = rows.select("v", F.least("own", "band").alias("b1"), F.greatest("own", "band").alias("b2"), "own", "id", "n", "at", "alone")
    met = rows.groupBy("v", "b1", "b2").agg(F.count(F.lit(1)).alias("c"), F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo = b1 and hi = b2 and c > 1")
    return rows.join(met.select("v", "b1", "b2"), ["v", "b1", "b2"], "left_semi")


def _explode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        ids, n, items = batch.column(names.index("id")), batch.column(names.index("n")), batch.column(names.index("items"))
        for lo in range(0, len(ids), 500):
            values = [np.frombuffer(x.as_buffer(), np.int64) for x in items.slice(lo, 500)]
            at = pa.array(np.repeat(np.arange(len(values)), [len(x) for x in values]))
            yield pa.RecordBatch.from_arrays([ids.slice(lo, 500).take(at), n.slice(lo, 500).take(at), pa.array(np.concatenate(values))], ["id", "n", "v"])


def small(df: DataFrame, rows: int, limit: int = 100_000) -> DataFrame:
    """df to be broadcast if it has few rows (a few MB), else as it is for an exchange."""
    return F.broadcast(df) if rows <= limit else df


def marked(docs: DataFrame, ids: DataFrame, words: int = 1 << 18) -> DataFrame:
    """The rows of docs whose id is one of ids, and by chance a few others, without an exchange of docs.

    The hashes of the ids are bits of at most so many numbers of 64 bits, which every task gets. With 262,144 of them (about
    10 MB) one other row in 17 stays at a million ids, one in 5 at 3.7 million; more ids let more rows stay and lose none.
    """
    at = F.xxhash64("id")
    word = F.pmod(F.shiftright(at, 6), F.lit(words))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
    marks = ids.where("id is not null").groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    rows = docs.where("id is not null").withColumns({"_word": word, "_bit": bit})
    return rows.join(F.broadcast(marks), "_word").where(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).select(*docs.columns)


def ends(pairs: DataFrame) -> DataFrame:
    """The ids (id) that pairs (a, b) name, repeated ones included."""
    return pairs.select(F.explode(F.array("a", "b")).alias("id"))


def connected_components(edges: DataFrame) -> tuple[DataFrame, int]:
    """(id, comp) for every end of the edges (a, b), and their number: comp is the smallest id reachable.

    Least labels spread along edges and through labels of labels, so a chain needs a logarithmic number of rounds. Each
    round is written to the shared folder; only the numbers of labels and of changed ones come to the driver.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = held = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("comp")))
    n = labels.count()
    parts = 1 + n // 50_000  # what a reduce task writes is small
    while True:
        near = both.join(small(labels.select(F.col("id").alias("b"), "comp"), n), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        seen = near.join(small(labels, n), "id").select("id", F.col("comp").alias("was"), F.least("comp", "near").alias("mid"))
        jump = labels.select(F.col("id").alias("mid"), F.col("comp").alias("far"))
        after = seen.join(small(jump, n), "mid", "left").select("id", "was", F.least("mid", F.coalesce("far", "mid")).alias("comp"))
        after = materialize(after.coalesce(parts))
        changed = after.where("comp <> was").limit(1).count()
        discard(held)
        labels, held = after.select("id", "comp"), after
        if not changed:
            discard(both)
            return labels, n


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: tuple[int, int] = (80, 100), sketch_size: int = 64, short_list: int = 24, pivot_rounds: int = 6) -> DataFrame:
    """One row per input row: (id_col, n_shingles, component_id, kept).

    Documents are linked if the Jaccard similarity of their shingle sets is at least num/den. component_id is the
    smallest id reachable over links, kept tells whether it is the row's own.

    Null text and text without words: n_shingles 0, linked with nothing. Texts of fewer words than a shingle: the whole
    sequence is the one shingle. Rows of equal id are one document: its texts are linked. A null id is linked with nothing,
    has a null component_id and is kept. Ids keep their type; strings compare by code point. Other columns are ignored; an
    empty table gives none.
    """
    num, den = similarity
    k, o = sketch_size, least_overlap(sketch_size, num, den)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sigs = materialize(source.mapInArrow(_sketch_batches(shingle_words, k), f"id {kind}, n long, h1 long, h2 long, sketch array<long>"))
    full = sigs.where("n > 0 and id is not null")

    # Equal sets are one class; the smallest id stands for it.
    classes = materialize(full.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep")))
    reps = full.join(classes.select("h1", "h2", "n", F.col("rep").alias("id")), ["id", "h1", "h2", "n"], "left_semi").dropDuplicates(["id", "h1", "h2", "n"])

    # An id of several texts joins their classes.
    named = full.select("id", "n", "h1", "h2").join(classes, ["h1", "h2", "n"]).select("id", "n", "rep")
    key = F.struct("h1", "h2", "n")
    several = materialize(full.groupBy("id").agg(F.min(key).alias("k"), F.max(key).alias("m")).where("k <> m").select("id"))
    links = full.sparkSession.createDataFrame([], f"a {kind}, b {kind}")
    if several.limit(1).count():
        of = named.join(several, "id", "left_semi").select("id", "rep")
        links = materialize(of.groupBy("id").agg(F.min("rep").alias("a")).join(of, "id").select("a", F.col("rep").alias("b")).where("a <> b").distinct())

    # Values retained by several documents, and of those the rarest that an overlap of o cannot avoid.
    posts = reps.select("id", "n", F.explode("sketch").alias("v"))
    often = posts.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = posts.join(often, "v").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    need = F.least(F.lit(o), F.ceil(F.col("n") * num / den))
    listed = (F.size("vs") - need + 1).cast("int")  # those that one document alone retains are rarer and come before
    every = materialize(shared.where(listed > 0).select("id", "n", F.explode(F.slice("vs", F.lit(1), listed)["v"]).alias("v")))
    counts = every.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    lists = materialize(every.join(counts, "v").select("v", "id", "n", "c"))
    discard(every)
    parts = 1 + lists.count() // 25_000

    sets = materialize(marked(source, lists.select("id")).mapInArrow(_set_batches(shingle_words, k), f"id {kind}, sketch array<long>, items binary"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b) the links, written: by the estimate of the union's sketch first, then by the full sets. Only what the pairs name is exchanged."""
        named = marked(sets.select("id", "sketch"), ends(pairs))
        x, y = named.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), named.select(F.col("id").alias("b"), F.col("sketch").alias("sb"))
        both = pairs.join(x, "a").join(y, "b")
        union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
        likely = both.where(F.size(F.array_intersect(F.array_intersect("sa", "sb"), union)) >= F.least(F.lit(o), F.ceil(F.size(union) * num / den))).select("a", "b")
        likely = materialize(likely.coalesce(parts))
        scratch.append(likely)
        named = marked(sets.select("id", "items"), ends(likely))
        x, y = named.select(F.col("id").alias("a"), F.col("items").alias("xa")), named.select(F.col("id").alias("b"), F.col("items").alias("xb"))
        with arrow_rows(pairs.sparkSession, 500):
            return materialize(likely.join(x, "a").join(y, "b").select("a", "b", "xa", "xb").mapInArrow(_verify_batches(num, den), f"a {kind}, b {kind}").coalesce(parts))

    # Short lists give all their pairs. The members of the others are listed anew, by their full sets.
    close = F.greatest("na", "nb") * num <= F.least("na", "nb") * den
    short = lists.where(F.col("c") <= short_list)
    x, y = short.select("v", F.col("id").alias("a"), F.col("n").alias("na")), short.select("v", F.col("id").alias("b"), F.col("n").alias("nb"))
    tested = materialize(x.join(y, "v").where(F.col("a") < F.col("b")).where(close).select("a", "b").distinct().coalesce(parts))
    scratch = [lists, sets, tested]
    found = [verified(tested)]
    crowd = materialize(lists.where(F.col("c") > short_list).select("id", "n").distinct().coalesce(parts))
    keyed = materialize(_keyed_lists(marked(sets.select("id", "items"), crowd).join(crowd, "id"), num, den).coalesce(parts))
    scratch += [crowd, keyed]

    comps, n_comps, before = None, 0, None
    for turn in range(pivot_rounds + 1):
        if turn == 0:
            current, last = keyed.withColumn("comp", F.col("id")), False
            first = F.struct(F.col("alone") / F.col("n"), "id")  # a member that has the fewest words of its own stands nearest to all
        else:
            current = materialize(keyed.join(small(comps, n_comps), "id", "left").withColumn("comp", F.coalesce("comp", "id")))
            scratch.append(current)
            sums = current.groupBy("v", "b1", "b2", "comp").agg(F.sum(F.when(F.col("own") == F.col("b1"), 1).otherwise(0)).alias("l"), F.sum(F.when(F.col("own") == F.col("b2"), 1).otherwise(0)).alias("r"))
            keys = materialize(sums.groupBy("v", "b1", "b2").agg((F.sum("l") * F.sum("r") - F.sum(F.col("l") * F.col("r"))).alias("todo"), F.sum(F.col("l") + F.col("r")).alias("rows")).where("todo > 0").coalesce(parts))
            todo = keys.agg(F.sum("todo"), F.sum("rows"), F.count(F.lit(1))).first()
            scratch.append(keys)
            if not todo[0]:
                break
            current = current.join(small(keys.select("v", "b1", "b2"), todo[2]), ["v", "b1", "b2"], "left_semi")
            stuck = before is not None and 5 * todo[0] > 4 * before and todo[0] <= 64 * todo[1]  # lists of several components: more pivots settle nothing
            last, before = turn == pivot_rounds or todo[0] <= 4 * todo[1] or stuck, todo[0]
            first = F.xxhash64("id", F.lit(turn))
        who = F.struct(F.col("id").alias("x"), F.col("n").alias("nx"), F.col("at").alias("ix"), F.col("comp").alias("cx"))
        x = current.select("v", "b1", "b2", F.col("own").alias("ox"), who.alias("p"))
        if not last:
            x = current.groupBy("v", "b1", "b2", F.col("own").alias("ox")).agg(F.min_by(who, first).alias("p"))
        x = x.select("v", "b1", "b2", "ox", "p.*")
        y = current.select("v", "b1", "b2", "own", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("at").alias("iy"), F.col("comp").alias("cy"))
        share = F.ceil((F.col("nx") + F.col("ny")) * num / (num + den))
        reach = (F.col("nx") - F.col("ix") >= share) & (F.col("ny") - F.col("iy") >= share)
        pairs = x.join(y, ["v", "b1", "b2"]).where("(ox <> own or b1 = b2) and x <> y and cx <> cy").where(reach)
        if last:
            pairs = pairs.where("x < y or ox < own")
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs.coalesce(parts))
        found.append(verified(pairs))
        scratch.append(pairs)
        tested = tested.union(pairs)
        comps, n_comps = connected_components(reduce(DataFrame.union, found, links))
        if last:
            break

    discard(*scratch, *found)

    # Every document: by its class, the class by its representative, and all texts of one id together.
    out = named.join(small(comps.withColumnRenamed("id", "rep"), n_comps), "rep", "left").select("id", "n", F.coalesce("comp", "rep").alias("comp"))
    rest = sigs.where("n = 0 or id is null").select("id", "n", F.col("id").alias("comp"))
    return out.unionByName(rest).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.coalesce(F.col("id") == F.col("comp"), F.lit(True)).alias("kept"))
