"""Best-fit packing of tokenized documents into fixed-length sequences by bin completion.

The plan needs only how many pieces have each length, a table as long as a sequence at most, so it is made once for the
whole corpus: around the largest remaining piece all undominated fillings are enumerated, least waste first, and a
depth-first search goes through them, each laid out as often as the counts allow first, as long as the waste allows one bin
less than the incumbent has. The best-fit-decreasing solution is the first incumbent. Pieces then find their place by their
rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, salted_rank, salts_for, sub_batches
from .tokens import WordTokenizer

Pattern = tuple[tuple[int, ...], int]


class _Spent(Exception):
    """The budget of a search is used up."""


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit over a table of counts by length, largest first: each piece goes where the least room is left for it.

    Bins of equal contents are held as one group. A bin that takes a piece stays the tightest while it can take another, so
    it is filled up with that length before the next bin is looked at.
    """
    groups: dict[int, list[Pattern]] = {}  # by room left
    open_rooms = np.zeros(capacity + 1, bool)

    def put(room: int, pattern: Pattern) -> None:
        groups.setdefault(room, []).append(pattern)
        open_rooms[room] = True

    for x in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[x])
        while left:
            at = x + int(open_rooms[x:].argmax())
            if open_rooms[at]:
                room, (fill, times) = at, groups[at].pop()
                open_rooms[at] = bool(groups[at])
            else:
                room, fill, times = capacity, (), left
            each = min(room // x, left)
            took = min(times, left // each)
            put(room - each * x, (fill + (x,) * each, took))
            if fill and took < times:
                put(room, (fill, times - took))
            left -= took * each
    return [g for held in groups.values() for g in held]


def fillings(counts: np.ndarray, room: int, waste: int, spend: Callable[[int], None]) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of a room from what the counts hold that waste no more than allowed, least waste first.

    The sums that the lengths up to each one reach are bit sets, so all fillings of a sum are found without a dead end,
    larger pieces first. A filling is dominated, and left out, if a piece at hand fits in beside it, or fits in the place of
    one or two of its pieces and is no smaller than they are.
    """
    have = np.flatnonzero(counts[: room + 1]).tolist()
    own = [int(counts[x]) for x in have]
    spend(1 + len(have))
    mask, below = (1 << (room + 1)) - 1, [1]  # below[k]: sums of the first k lengths
    for x, n in zip(have, own, strict=True):
        bits, left, step = below[-1], min(n, room // x), 1
        while left:
            take = min(step, left)
            bits |= (bits << (take * x)) & mask
            left, step = left - take, step * 2
        below.append(bits)

    def dominated(used: dict[int, int], slack: int) -> bool:
        rest = [x for x, n in zip(have, own, strict=True) if n > used.get(x, 0)]
        held = sorted(used)
        places = [0, *held, *(y + z for k, y in enumerate(held) for z in held[k:] if y != z or used[y] > 1)]
        for size in places:
            # A single piece gives way to a longer one only, a pair to an equal one too.
            at = bisect_right(rest, size) if size in used or not size else bisect_left(rest, size)
            if at < len(rest) and rest[at] <= size + slack:
                return True
        return False

    def of_sum(k: int, left: int) -> Iterator[tuple[int, ...]]:
        spend(1)
        while left:
            x = have[k - 1]
            ways = [n for n in range(min(own[k - 1], left // x), -1, -1) if below[k - 1] >> (left - n * x) & 1]
            k -= 1
            if ways != [0]:
                for n in ways:
                    for rest in of_sum(k, left - n * x):
                        yield (x,) * n + rest
                return
        yield ()

    for total in range(room, max(room - waste, 0) - 1, -1):
        if below[-1] >> total & 1:
            for f in of_sum(len(have), total):
                if not dominated({x: f.count(x) for x in f}, room - total):
                    yield f


def bins_at_least(counts: np.ndarray, capacity: int) -> int:
    """A lower bound (Martello and Toth's L2): pieces over half a bin stand alone, and what fits beside them is limited."""
    n = np.concatenate(([0], np.cumsum(counts)))  # n[x]: pieces shorter than x
    t = np.concatenate(([0], np.cumsum(counts * np.arange(len(counts)))))
    half = capacity // 2
    low = np.arange(0, half + 1)
    alone = n[capacity + 1] - n[capacity - low + 1]
    beside, room = n[capacity - low + 1] - n[half + 1], t[capacity - low + 1] - t[half + 1]
    small = t[half + 1] - t[low]
    return int((alone + beside + np.maximum(0, -(-(small - (beside * capacity - room)) // capacity))).max())


def _completed(counts: np.ndarray, capacity: int, goal: int, spend: Callable[[int], None]) -> list[Pattern] | None:
    """Patterns of at most goal bins, by depth-first search over the fillings around the largest piece; None if there are none.

    What goal bins leave over is all that a branch may waste. Bins around equal largest pieces come in the order of their
    fillings, so no set of bins is tried twice.
    """
    state = counts.astype(np.int64)
    spare = goal * capacity - int((state * np.arange(len(state))).sum())
    path: list[Pattern] = []
    stack: list[Iterator[Pattern]] = []
    waste = bins = 0

    def options() -> Iterator[Pattern]:
        x = int(np.flatnonzero(state)[-1])
        if waste > spare or bins + bins_at_least(state, capacity) > goal:
            return
        rest = state.copy()
        rest[x] -= 1
        order = lambda f: (-sum(f), *(-y for y in f))
        last = order(path[-1][0][1:]) if path and path[-1][0][0] == x else None
        left = spare - waste
        for f in fillings(rest, capacity - x, left, spend):
            if last is None or order(f) > last:
                fill = (x, *f)
                loss = capacity - sum(fill)
                most = min(int(rest[y] + (y == x)) // fill.count(y) for y in set(fill))
                for times in range(min(most, left // loss) if loss else most, 0, -1):
                    yield fill, times

    def lay(fill: tuple[int, ...], times: int) -> None:
        nonlocal waste, bins
        for x in fill:
            state[x] -= times
        waste += times * (capacity - sum(fill))
        bins += times

    while state.any():
        stack.append(options())
        while (step := next(stack[-1], None)) is None:
            stack.pop()
            if not stack:
                return None
            fill, times = path.pop()
            lay(fill, -times)
        path.append(step)
        lay(*step)
    return path if bins <= goal else None


def bin_completion(counts: np.ndarray, capacity: int, budget: int = 100_000) -> list[Pattern]:
    """Patterns (lengths, times) that hold all pieces in as few bins as the search finds.

    counts[x] is the number of pieces of length x. The best-fit-decreasing solution is the first incumbent; the search asks
    for one bin less until it meets the lower bound or has proved that there is no such solution. budget bounds its work,
    not the result: where it ends first, the bins that waste most are searched by themselves, and the incumbent stands.
    """
    best = best_fit_decreasing(counts, capacity)
    size = lambda patterns: sum(k for _, k in patterns)
    least = bins_at_least(counts, capacity)
    left = budget

    def spend(work: int) -> None:
        nonlocal left
        left -= work
        if left < 0:
            raise _Spent

    try:
        while size(best) > least:
            found = _completed(counts, capacity, size(best) - 1, spend)
            if found is None:
                return best
            best = found
    except _Spent:
        left = budget
        for bins in (12, 24, 48):
            while size(best) > least and (found := _refit(best, capacity, bins, spend)) is not None:
                best = found
    return best


def _refit(patterns: list[Pattern], capacity: int, bins: int, spend: Callable[[int], None]) -> list[Pattern] | None:
    """The patterns with one bin less among the given number of bins that waste most, if the search finds that."""
    wasteful, counts, taken = [], np.zeros(capacity + 1, np.int64), 0
    rest = []
    for fill, times in sorted(patterns, key=lambda p: sum(p[0])):
        own = min(times, bins - taken)
        taken += own
        for x in fill:
            counts[x] += own
        wasteful.append((fill, own))
        rest.append((fill, times - own))
    try:
        found = _completed(counts, capacity, taken - 1, spend) if bins_at_least(counts, capacity) < taken else None
    except _Spent:
        return None
    return None if found is None else [*found, *((f, k) for f, k in rest if k)]


def slots(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, pieces in a bin, first bin, offset in the bin), by rank."""
    taken: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    bins = 0
    for fill, times in patterns:
        offset = 0
        for x in sorted(set(fill), reverse=True):
            k = fill.count(x)
            rows.setdefault(x, []).append((taken.get(x, 0), k, bins, offset))
            taken[x] = taken.get(x, 0) + k * times
            offset += k * x
        bins += times
    return {x: np.array(r, np.int64) for x, r in rows.items()}


def _piece_batches(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.of(path)
        for batch in sub_batches(batches, 1, 2 << 20):
            ids, at = tokenizer.encode(batch.column(1))
            row, piece, start, length, crc, own = [], [], [], [], [], []
            for k, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                doc = np.append(ids[lo:hi], np.uint32(end_id))
                for p, s in enumerate(range(0, len(doc), capacity)):
                    cut = doc[s : s + capacity]
                    row.append(k), piece.append(p), start.append(s), length.append(len(cut)), crc.append(zlib.crc32(cut))
                    if with_ids:
                        own.append(cut)
            cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                offsets = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(own).astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _place_batches(table: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                mine, rows = np.flatnonzero(length == x), table[int(x)]
                slot = rows[np.searchsorted(rows[:, 0], rank[mine], side="right") - 1]
                k = rank[mine] - slot[:, 0]
                sequence[mine] = slot[:, 2] + k // slot[:, 1]
                offset[mine] = slot[:, 3] + k % slot[:, 1] * x
            cols = [c for name, c in zip(batch.schema.names, batch.columns, strict=True) if name != "rank"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], [*(x for x in batch.schema.names if x != "rank"), "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", sequence_length: int = 2048, end_id: int = 0, budget: int = 100_000, with_ids: bool = False) -> DataFrame:
    """One row per piece: (id_col, piece, start, length, ids_crc32, sequence_id, offset), and its ids if asked for.

    A document is its token ids and end_id; only documents longer than a sequence are cut, into pieces of its length. Null
    and empty texts are the end id alone. Repeated rows are packed one by one; a null id stays null. An empty table gives
    none. Other columns are ignored. Only the number of pieces of each length, sequence_length rows at most, comes to the
    driver.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialize(source.mapInArrow(_piece_batches(tokenizer_path, sequence_length, end_id, with_ids), schema))
    histogram = pieces.groupBy("length").count().collect()
    counts = np.zeros(sequence_length + 1, np.int64)
    for row in histogram:
        counts[row["length"]] = row["count"]
    table = slots(bin_completion(counts, sequence_length, budget))
    salt = F.pmod(F.xxhash64("id", "piece"), F.lit(salts_for(int(counts.sum()), sequence_length))).cast("int")
    ranked = salted_rank(pieces, ["length"], ["id", "piece", "ids_crc32"], salt, "rank")
    placed = ranked.mapInArrow(_place_batches(table), f"{schema}, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)
