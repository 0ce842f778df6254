"""Ordered folds: steps whose decision depends on what has been gathered so far.

Windows can't express them, as the text or span of the run so far decides about the next row. Each runs over one job at
a time in Arrow batches; jobs are dealt over the cluster, and one job's rows are what a task holds.
All times of a job are in one unit, which the parameters share.
"""

from __future__ import annotations

import difflib
import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from cuelattice.functions.text import FINAL_MARKS
from cuelattice.functions.vocab import Profile

Row = dict[str, Any]
EDGE = r"[\s。！？!?…，,；;：:]+"


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], step: Callable[[list[Row]], Iterable[Row]], schema: str) -> DataFrame:
    """Rows of each key in order through step, which gives rows of the schema (without the keys, which are added).

    One exchange by key and one sort; a task then walks its keys in Arrow batches and holds the rows of one key at a time.
    """
    key_ddl = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    ddl = f"{key_ddl}, {schema}"
    kind = to_arrow_schema(_parse_datatype_string(ddl))

    def table(rows: list[Row]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in kind], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out = None, [], []

        def close() -> None:
            named = dict(zip(keys, at or (), strict=False))
            out.extend({**r, **named} for r in step(held))

        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != at and held:
                    close()
                    held = []
                    if len(out) >= 10_000:
                        yield table(out)
                        out.clear()
                at = key
                held.append(row)
        if held:
            close()
        if out:
            yield table(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, ddl)


def ratio(a: str, b: str) -> float:
    """The share of matching characters by longest common blocks; the order of arguments matters."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def letters(text: str | None) -> str:
    return "".join(c.lower() for c in text or "" if c.isalnum())


def key_of(text: str | None) -> str:
    return re.sub(r"[^一-鿿A-Za-z0-9]+", "", text or "").lower()


def ends_final(text: str | None) -> bool:
    return bool(text) and text[-1] in FINAL_MARKS + "."


class Speech:
    """The profile's patterns as Python sees them."""

    def __init__(self, profile: Profile, close_up: bool):
        self.end, self.start = re.compile(profile.dangling_end), re.compile(profile.dependent_start)
        self.lead, self.chatter, self.malformed = re.compile(profile.leading_reference), re.compile(profile.chatter), re.compile(profile.malformed)
        self.gap = "" if close_up else " "

    def dangling(self, text: str | None) -> bool:
        return bool(self.end.search(re.sub(EDGE + "$", "", text or "")))

    def dependent(self, text: str | None) -> bool:
        return bool(self.start.search(re.sub("^" + EDGE, "", text or "")))

    def tolerable(self, text: str | None) -> bool:
        t = re.sub(r"\s+", self.gap, text or "").strip()
        return bool(t) and (self.dependent(t) or self.dangling(t) or not (self.chatter.search(t) or self.malformed.search(t)))


def merge_adjacent(rows: list[Row], belongs: Callable[[Row, Row], bool], absorb: Callable[[Row, Row], None]) -> list[Row]:
    """Each row joins the run before it if it belongs to it as it is by then."""
    runs: list[Row] = []
    for row in rows:
        if runs and belongs(runs[-1], row):
            absorb(runs[-1], row)
        else:
            runs.append(dict(row))
    return runs


def join_texts(a: str, b: str) -> str:
    a, b = a.rstrip(" ，,"), b.lstrip(" ，,")
    marks = "，,。！？!?；;：:"
    return a + b if not a or not b or a[-1] in marks or b[0] in marks else f"{a}，{b}"


def build_units(clauses: DataFrame, profile: Profile, *, job: str = "job", order: str = "id", grow: float, cap: float, silence: float, close_up: bool = True) -> DataFrame:
    """WIN6, RSH3: clauses in sentence units: (job, unit, first, last, n, start, end, text).

    A clause joins the unit before it if the silence is short, the unit does not end in a final mark, the whole stays
    within cap, and the unit is shorter than grow or one of the two leans on the other.
    """
    speech = Speech(profile, close_up)

    def belongs(unit: Row, row: Row) -> bool:
        leans = speech.dangling(unit["text"]) or speech.dependent(row["text"])
        return row["start"] - unit["end"] < silence - 1e-9 and not ends_final(unit["tail"]) and row["end"] - unit["start"] <= cap + 1e-9 and (unit["end"] - unit["start"] < grow - 1e-9 or leans)

    def absorb(unit: Row, row: Row) -> None:
        unit.update(text=unit["text"] + row["text"], end=row["end"], last=row[order], n=unit["n"] + 1, tail=row["text"])

    def step(rows: list[Row]) -> Iterator[Row]:
        units = merge_adjacent([{**r, "text": r["text"] or "", "tail": r["text"] or "", "first": r[order], "last": r[order], "n": 1} for r in rows], belongs, absorb)
        return ({**u, "unit": k} for k, u in enumerate(units))

    return ordered_fold(clauses.select(job, order, "text", "start", "end"), [job], [order], step, "unit long, first long, last long, n long, start double, end double, text string")


def merge_blocks(blocks: DataFrame, profile: Profile, *, job: str = "job", order: str = "id", gap: float, soft: tuple[float, int], hard: tuple[float, int], close_up: bool = True) -> DataFrame:
    """WIN7: subtitle blocks merged while the pause is short and no sentence has ended: up to soft (span, blocks), up to hard if they lean on each other."""
    speech = Speech(profile, close_up)

    def belongs(run: Row, row: Row) -> bool:
        span = row["end"] - run["start"]
        leans = speech.dangling(run["text"]) or speech.dependent(row["text"])
        return row["start"] - run["end"] <= gap and not ends_final(run["text"]) and (run["n"] < soft[1] and span <= soft[0] or leans and run["n"] < hard[1] and span <= hard[0])

    def absorb(run: Row, row: Row) -> None:
        run.update(text=run["text"] + (row["text"] or ""), end=row["end"], n=run["n"] + 1)

    def step(rows: list[Row]) -> Iterator[Row]:
        return iter(merge_adjacent([{**r, "first": r[order], "n": 1, "text": r["text"] or ""} for r in rows], belongs, absorb))

    return ordered_fold(blocks.select(job, order, "text", "start", "end"), [job], [order], step, "first long, n long, start double, end double, text string")


def merge_short_units(rows: DataFrame, profile: Profile, *, job: str = "job", order: str = "id", least: float, most: float, gap: float, second: float = 1.0, close_up: bool = True) -> DataFrame:
    """WIN8: short, leaning and unfinished rows merged in a first pass; in a second what is still short joins what stands before.

    second: what one second is in the unit of times.
    """
    speech = Speech(profile, close_up)

    def near(a: Row, b: Row) -> bool:
        return -0.05 * second <= b["start"] - a["end"] <= gap and b["end"] - a["start"] <= most and speech.tolerable(a["text"]) and speech.tolerable(b["text"])

    def wanted(a: Row, b: Row) -> bool:
        text = b["text"].strip()
        if min(a["end"] - a["start"], b["end"] - b["start"]) < least or speech.dangling(a["text"]) or speech.dependent(text) or speech.lead.match(text):
            return True
        return a["text"].strip()[-1:] not in "。！？!?." and b["end"] - a["start"] <= 10 * second and b["start"] - a["end"] <= 0.25 * second

    def absorb(a: Row, b: Row) -> None:
        a.update(text=join_texts(a["text"], b["text"]), end=max(a["end"], b["end"]), n=a["n"] + b["n"])

    def step(rows: list[Row]) -> Iterator[Row]:
        runs = merge_adjacent([{**r, "first": r[order], "n": 1, "text": r["text"] or ""} for r in sorted(rows, key=lambda r: r["start"])], lambda a, b: near(a, b) and wanted(a, b), absorb)
        return iter(merge_adjacent(runs, lambda a, b: b["end"] - b["start"] < least and near(a, b), absorb))

    return ordered_fold(rows.select(job, order, "text", "start", "end"), [job], [order], step, "first long, n long, start double, end double, text string")


def _owner(t: Row, spans: list[tuple[float, float]], slack: float) -> int | None:
    mid = (t["s"] + t["e"]) / 2
    return next((k for k, (a, b) in enumerate(spans) if a - slack <= mid <= b + slack), None)


def _halves(group: list[Row], most: float, second: float, clause_marks: str) -> list[list[Row]]:
    """WIN11: a group over most is cut where the start is nearest to the middle, marks and pauses counting in favour; so are its parts."""
    if len(group) < 2 or group[-1]["e"] - group[0]["s"] <= most + 1e-9:
        return [group]
    mid, best = (group[0]["s"] + group[-1]["e"]) / 2, None
    for k in range(1, len(group)):
        if group[k]["s"] - group[0]["s"] > most + 1e-9:
            break
        score = abs(group[k]["s"] - mid) - (0.5 * second if group[k - 1]["w"][-1:] in clause_marks else 0) - (0.3 * second if group[k]["s"] - group[k - 1]["e"] >= 0.15 * second else 0)
        if best is None or score < best[0]:
            best = (score, k)
    k = best[1] if best else max(1, len(group) // 2)
    return _halves(group[:k], most, second, clause_marks) + _halves(group[k:], most, second, clause_marks)


def split_clauses(words: DataFrame, *, job: str = "job", sentences: DataFrame | None = None, most: float, least: float, silence: float, second: float = 1.0, clause_marks: str = "，,、；;：:") -> DataFrame:
    """WIN9 to WIN12, RSH2: words (s, e, w) to clauses (job, id, start, end, text, split_from).

    Words group by the sentence that holds their middle (or, without sentences, between silences) and end at final marks;
    groups shorter than least join the one before, or the next, within most; longer ones are cut. split_from names a
    sentence that gave several clauses. Blank words and empty spans go.
    """
    span_rows = [] if sentences is None else [sentences.groupBy(job).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))]
    rows = words.select(job, F.col("s").cast("double").alias("s"), F.col("e").cast("double").alias("e"), F.trim("w").alias("w")).where("w <> '' and e > s")
    if span_rows:
        rows = rows.join(span_rows[0].select(job, F.to_json("spans").alias("spans")), job, "left")

    def short(g: list[Row]) -> bool:
        return g[-1]["e"] - g[0]["s"] < least - 1e-9

    def room(a: list[Row], b: list[Row]) -> bool:  # lengths are summed, the silence between them aside
        return a[-1]["e"] - a[0]["s"] + b[-1]["e"] - b[0]["s"] <= most + 1e-9 and not ends_final(a[-1]["w"])

    def step(rows: list[Row]) -> Iterator[Row]:
        spans = [(x["start"], x["end"]) for x in json.loads(rows[0].get("spans") or "[]")] if rows else []
        groups: list[list[Row]] = []
        was = None
        for t in rows:
            own = _owner(t, spans, 1e-6) if spans else None
            broken = not groups or ends_final(groups[-1][-1]["w"]) or (own != was if spans else t["s"] - groups[-1][-1]["e"] >= silence - 1e-9)
            if broken:
                groups.append([t])
                was = own
            else:
                groups[-1].append(t)
        for absorbs in (lambda a, b: short(b) and room(a, b), lambda a, b: short(a) and room(a, b)):
            held: list[list[Row]] = []
            for g in groups:
                if held and absorbs(held[-1], g):
                    held[-1] = held[-1] + g
                else:
                    held.append(g)
            groups = held
        parts = [p for g in groups for p in _halves(g, most, second, clause_marks)]
        out = [{"id": k, "start": round(p[0]["s"], 3), "end": round(p[-1]["e"], 3), "text": "".join(t["w"] for t in p)} for k, p in enumerate(parts)]
        owners = [_owner({"s": c["start"], "e": c["end"]}, spans, 1e-6) for c in out]
        return ({**c, "split_from": o if o is not None and owners.count(o) > 1 else None} for c, o in zip(out, owners, strict=True))

    return ordered_fold(rows, [job], ["s", "e"], step, "id long, start double, end double, text string, split_from long")


def safe_split(sentences: DataFrame, *, job: str = "job", order: str = "id", most: float, least: float, hard: float) -> DataFrame:
    """WIN13: sentences over most cut at the latest word boundary after a mark that keeps both parts in bounds; the sentence whole if that fails.

    sentences: words as an array of (s, e, w).
    """

    def cut(words: list[Row]) -> list[list[Row]]:
        parts, rest = [], words
        while rest[-1]["e"] - rest[0]["s"] > most:
            good = [k for k in range(1, len(rest)) if rest[k - 1]["w"][-1:] in "，,、；;：:。！？!?." and least <= rest[k - 1]["e"] - rest[0]["s"] <= most and rest[-1]["e"] - rest[k]["s"] >= least]
            if not good:
                return [words] if rest[-1]["e"] - rest[0]["s"] > hard or not parts else [*parts, rest]
            parts.append(rest[: good[-1]])
            rest = rest[good[-1] :]
        return [*parts, rest]

    def step(rows: list[Row]) -> Iterator[Row]:
        for r in rows:
            words = [{"s": x["s"], "e": x["e"], "w": x["w"]} for x in r["words"]]
            pieces = cut(words) if words else []
            for k, p in enumerate(pieces):
                yield {"id": r[order], "part": k, "parts": len(pieces), "start": float(p[0]["s"]), "end": float(p[-1]["e"]), "text": " ".join(x["w"] for x in p)}

    return ordered_fold(sentences.select(job, order, "words"), [job], [order], step, "id long, part long, parts long, start double, end double, text string")


def pack_batches(units: DataFrame, *, job: str = "job", order: str = "unit", size: str = "n", most: int = 120) -> DataFrame:
    """WIN25: units in batches of at most most members; a larger unit is a batch of its own, none is split."""

    def step(rows: list[Row]) -> Iterator[Row]:
        batch, held = 0, 0
        for r in rows:
            if held and held + r[size] > most:
                batch, held = batch + 1, 0
            held += r[size]
            yield {"unit": r[order], "batch": batch}

    return ordered_fold(units.select(job, order, size), [job], [order], step, "unit long, batch long")


def thin_boundaries(marks: DataFrame, *, job: str = "job", at: str = "at", apart: float) -> DataFrame:
    """WIN24: marks that lie more than apart after the last one kept."""

    def step(rows: list[Row]) -> Iterator[Row]:
        last = None
        for r in rows:
            if last is None or r[at] - last > apart:
                last = r[at]
                yield {"at": last}

    return ordered_fold(marks.select(job, F.col(at).cast("double").alias(at)), [job], [at], step, "at double")


def merge_cut_blocks(rows: DataFrame, *, job: str = "job", order: str = "pos", gap: float, most: float) -> DataFrame:
    """WIN14, JOIN25: rows overlapping a kept one go; neighbours of one source, role and module close together are merged; where two still overlap the cut is in the middle."""

    def same(a: Row, b: Row) -> bool:
        return all(a[k] == b[k] for k in ("src", "role")) and -1e-6 <= b["start"] - a["end"] <= gap and b["end"] - a["start"] <= most

    def step(rows: list[Row]) -> Iterator[Row]:
        kept: list[Row] = []
        for r in rows:
            if not any(k["src"] == r["src"] and min(k["end"], r["end"]) - max(k["start"], r["start"]) > 0.5 * (r["end"] - r["start"]) for k in kept):
                kept.append({**r, "first": r[order], "n": 1})
        out = merge_adjacent(kept, same, lambda a, b: a.update(end=max(a["end"], b["end"]), n=a["n"] + 1))
        for a, b in zip(out, out[1:], strict=False):
            if a["src"] == b["src"] and a["start"] < b["start"] < a["end"]:
                a["end"] = b["start"] = (a["end"] + b["start"]) / 2
        return iter(out)

    return ordered_fold(rows.select(job, order, "src", "role", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")), [job], [order], step, "first long, src long, role string, n long, start double, end double")


class Leaders:
    """Keys in order, and the first of them that equals a key or is as similar (ratio(key, leader) >= least).

    Only pairs that can be so similar are compared in full. Of m matching characters, 2 m is at least least of both lengths;
    they are shared characters, and parted into no more blocks than there are characters without a match, nor than b has
    characters that difflib takes blocks from, all but the last of a block begin shared pairs of characters, and together
    they are no longer than the longest common subsequence. What was found for a key holds for its copies.
    """

    def __init__(self, least: float):
        self.least, self.keys, self.known = least, [], {}
        self.lengths, self.blocks = np.zeros(64, np.int64), np.zeros(64, np.int64)
        self.bags = np.zeros((64, 64), np.uint16), np.zeros((64, 256), np.uint16)

    def place(self, key: str) -> tuple[int, bool]:
        """The leader's number, and whether the key has just become it."""
        if key in self.known:
            return self.known[key], False
        codes = np.frombuffer(key.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        pairs = (codes[:-1] * 31 + codes[1:]) % 256
        counted = [np.minimum(np.bincount(x, minlength=n), 65535).astype(np.uint16) for x, n in ((codes % 64, 64), (pairs, 256))]
        at = next((i for i in self._able(key, *counted) if ratio(key, self.keys[i]) >= self.least), None)
        new = at is None
        if new:
            at = len(self.keys)
            self._add(key, codes, counted)
        self.known[key] = at
        return at, new

    def _able(self, key: str, letters_: np.ndarray, pairs: np.ndarray) -> Iterator[int]:
        """Leaders that can be as similar, in order."""
        n, size = len(self.keys), len(key)
        both = self.lengths[:n] + size
        need = self.least * both / 2 - 1e-6
        able = np.flatnonzero(np.minimum(self.lengths[:n], size) >= need)
        if size < 65_536:  # else a count may not fit
            able = able[np.minimum(self.bags[0][able], letters_).sum(axis=1, dtype=np.int64) >= need[able]]
            blocks = np.minimum(self.blocks[able], both[able] - 2 * need[able] + 1)
            able = able[np.minimum(self.bags[1][able], pairs).sum(axis=1, dtype=np.int64) >= need[able] - blocks]
        return (i for i in able.tolist() if common_lengths(key, self.keys[i], [0])[0] >= need[i])

    def _add(self, key: str, codes: np.ndarray, counted: list[np.ndarray]) -> None:
        n = len(self.keys)
        if n == len(self.lengths):
            self.lengths, self.blocks, *bags = (np.concatenate([x, np.zeros_like(x)]) for x in (self.lengths, self.blocks, *self.bags))
            self.bags = tuple(bags)
        each = np.unique(codes, return_counts=True)[1]
        self.keys.append(key)
        self.lengths[n] = len(key)
        self.blocks[n] = each[each <= len(key) // 100 + 1].sum() if len(key) >= 200 else len(key)  # difflib's autojunk
        for bag, x in zip(self.bags, counted, strict=True):
            bag[n] = x


def greedy_near_duplicates(rows: DataFrame, *, job: str = "job", order: str = "id", text: str = "text", least: float = 0.9) -> DataFrame:
    """DUP1, DUP5, JOIN23: (job, id, duplicate_of): the first kept row whose normal key is equal or as similar; empty keys are never duplicates.

    Leaders says which pairs aren't compared in full.
    """

    def step(rows: list[Row]) -> Iterator[Row]:
        leaders, ids = Leaders(least), []
        for r in rows:
            key, match = key_of(r[text]), None
            if key:
                at, new = leaders.place(key)
                if new:
                    ids.append(r[order])
                else:
                    match = ids[at]
            yield {"id": r[order], "duplicate_of": match}

    return ordered_fold(rows.select(job, order, text), [job], [order], step, "id long, duplicate_of long")


def near_repeats(rows: DataFrame, *, job: str = "job", order: str = "id", text: str = "text", least: float, shortest: int = 6, equal: bool = True) -> DataFrame:
    """JOIN23, JOIN24: (job, id, earlier): rows with the first row before them, kept or not, of as similar letters, both of shortest or more; with equal also of equal letters of any number."""

    def step(rows: list[Row]) -> Iterator[Row]:
        before: list[tuple[Any, str]] = []
        for r in rows:
            key = letters(r[text])
            matcher = difflib.SequenceMatcher(None, key, "")
            for i, k in before if key else ():
                near = equal and key == k
                if not near and min(len(key), len(k)) >= shortest:
                    matcher.set_seq2(k)
                    near = matcher.real_quick_ratio() >= least and matcher.quick_ratio() >= least and matcher.ratio() >= least
                if near:
                    yield {"id": r[order], "earlier": i}
                    break
            before.append((r[order], key))

    return ordered_fold(rows.select(job, order, text), [job], [order], step, "id long, earlier long")


def literal_dedup(clips: DataFrame, *, job: str = "job", order: str = "id", least: float = 0.92) -> DataFrame:
    """DUP3: leader clusters: a clip joins the first group whose first member is as similar. duplicate_of is the group's best (longest key, longest time, least id), null for itself; empty texts stay alone."""

    def step(rows: list[Row]) -> Iterator[Row]:
        leaders, groups, blank = Leaders(least), [], []
        for r in rows:
            r["key"] = letters(r["text"])
            if not r["key"]:
                blank.append([r])
                continue
            at, new = leaders.place(r["key"])
            if new:
                groups.append([r])
            else:
                groups[at].append(r)
        for g in groups + blank:
            best = max(g, key=lambda r: (len(r["key"]), r["end"] - r["start"], -r[order]))
            for r in g:
                yield {"id": r[order], "duplicate_of": None if r is best else best[order]}

    return ordered_fold(clips.select(job, order, "text", "start", "end"), [job], [order], step, "id long, duplicate_of long")


def dependency_dedup(rows: DataFrame, *, job: str = "job", order: str = "id", least: float = 0.9) -> DataFrame:
    """DUP2: near-duplicates by falling quality, then start; a row that others need replaces one that nobody needs, and two such rows both stay; what is left needs its whole closure. rows: id, text, start, quality, needs."""

    def whole(needs: dict[Any, list]) -> set:
        """Ids whose needs all exist and lead into no cycle: those that can be resolved from the ones that need nothing."""
        left, users = {i: len(set(ns)) for i, ns in needs.items()}, {}
        for i, ns in needs.items():
            for n in set(ns):
                users.setdefault(n, []).append(i)
        ready = [i for i, n in left.items() if not n]
        for i in ready:  # grows while it is read
            for u in users.get(i, ()):
                left[u] -= 1
                if not left[u]:
                    ready.append(u)
        return set(ready)

    def step(rows: list[Row]) -> Iterator[Row]:
        needs = {r[order]: list(r["needs"] if r["needs"] is not None else []) for r in rows}
        wanted = {n for ns in needs.values() for n in ns}
        chosen: list[tuple[Any, str]] = []
        for r in sorted(rows, key=lambda r: (-r["quality"], r["start"])):
            key = letters(r["text"])
            if not key:
                continue
            at = next((k for k, (_, o) in enumerate(chosen) if key == o or min(len(key), len(o)) >= 8 and ratio(key, o) >= least), None)
            if at is None or r[order] in wanted and chosen[at][0] in wanted:
                chosen.append((r[order], key))
            elif r[order] in wanted:
                chosen[at] = (r[order], key)
        sound = whole(needs)
        keep, todo = set(), [i for i, _ in chosen if i in sound]
        while todo:
            i = todo.pop()
            if i not in keep:
                keep.add(i)
                todo.extend(needs[i])
        return ({"id": r[order]} for r in rows if r[order] in keep)

    return ordered_fold(rows.select(job, order, "text", "start", "quality", "needs"), [job], [order], step, "id long")


def _match_bits(b: str) -> dict[str, int]:
    """Of each character of b the places where it stands, counted from b's end, as bits."""
    codes = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32)[::-1]
    return {chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes)}


def _rows_up(a: str, lo: int, hi: int, row: int, bits: dict[str, int], ones: int) -> Iterator[tuple[int, int]]:
    """From the row of a[hi:] those of a[hi - 1:] to a[lo:]: a zero bit k says that a longest common subsequence with b's last k + 1 characters is one longer than with its last k."""
    for i in range(hi - 1, lo - 1, -1):
        u = row & bits.get(a[i], 0)
        row = (row + u | row - u) & ones
        yield i, row


def common_lengths(a: str, b: str, places: Iterable[int]) -> dict[int, int]:
    """Lengths of longest common subsequences of a[i:] and b for each of the places i."""
    wanted, bits, ones = set(places), _match_bits(b), (1 << len(b)) - 1
    if not wanted:
        return {}
    return {i: len(b) - row.bit_count() for i, row in _rows_up(a, min(wanted), len(a), ones, bits, ones) if i in wanted} | {i: 0 for i in wanted if i >= len(a)}


def longest_common(a: str, b: str) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, the earliest in b that still allows its length.

    Rows are bits of one long number; of n rows only about 2 sqrt(n) are held, the others are made again where the walk comes by.
    """
    same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    out = [(k, k) for k in range(same)]
    a, b = a[same:], b[same:]
    if not a or not b:
        return out
    n, m = len(a), len(b)
    bits, ones, each = _match_bits(b), (1 << m) - 1, max(1, int(n**0.5))
    marks = {n: ones} | {i: row for i, row in _rows_up(a, 0, n, ones, bits, ones) if i % each == 0}
    held: dict[int, int] = {}

    def row_of(i: int) -> int:
        if i not in held:
            hi = min(n, (i // each + 1) * each)
            held.clear()
            held[hi] = marks[hi]
            held.update(_rows_up(a, i // each * each, hi, marks[hi], bits, ones))
        return held[i]

    def length(row: int, j: int) -> int:
        return m - j - (row & (1 << m - j) - 1).bit_count()

    wide = -(-m // 8)
    i, j, row, below = 0, 0, row_of(0), row_of(1)
    now, then = length(row, 0), length(below, 0)
    packed = row.to_bytes(wide, "little"), below.to_bytes(wide, "little")
    while now:
        if a[i] != b[j] and then != now:  # b's character helps nobody
            at, bit = divmod(m - 1 - j, 8)
            now, then, j = now - (~packed[0][at] >> bit & 1), then - (~packed[1][at] >> bit & 1), j + 1
            continue
        if a[i] == b[j]:
            out.append((i + same, j + same))
            j += 1
        i += 1
        if i == n:
            break
        row, below = below, row_of(i + 1)
        now, then = length(row, j), length(below, j)
        packed = packed[1], below.to_bytes(wide, "little")
    return out


def first_letters(w: pa.Array) -> np.ndarray:
    """The code points of the first letters of strings; 0 for those without one."""
    coded = w.dictionary_encode()
    points = np.array([ord(k[0]) if (k := letters(x)) else 0 for x in coded.dictionary.to_pylist()] + [0], np.uint32)
    return points[coded.indices.fill_null(len(points) - 1).to_numpy(zero_copy_only=False)]


def align_texts(asked: DataFrame, *, job: str = "job", order: str = "id", least: float = 0.6) -> DataFrame:
    """A text aligned to timed characters by one longest common subsequence (chars: array of (s, e, w)): start and end of what matches, and the share of the text that does; null times below least.

    A row depends on no other, so none is moved; a task holds the characters of one row as columns.
    """
    ddl = f"{job} {asked.schema[job].dataType.simpleString()}, id long, coverage double, start double, end double"
    kind = to_arrow_schema(_parse_datatype_string(ddl))

    def one(text: str | None, chars: pa.StructArray) -> tuple[float, float | None, float | None]:
        want, points = letters(text), first_letters(chars.field("w"))
        places = np.flatnonzero(points)
        pairs = longest_common(points[places].tobytes().decode("utf-32-le"), want)
        share = len(pairs) / len(want) if want else 0.0
        if not pairs or share < least:
            return round(share, 4), None, None
        at = lambda field, pair: float(chars.field(field)[int(places[pair[0]])].as_py())
        return round(share, 4), at("s", pairs[0]), at("e", pairs[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, texts = batch.column("chars"), batch.column("text").to_pylist()
            ends, values = chars.offsets.to_numpy(), chars.values  # a null row has no characters
            found = [one(t, values.slice(lo, hi - lo)) for t, lo, hi in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            cols = [batch.column(job), batch.column(order).cast(pa.int64()), *([f[k] for f in found] for k in range(3))]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.float64()) for c in cols], schema=kind)

    return asked.select(job, order, "text", "chars").mapInArrow(run, ddl)


def accept_shots(asked: DataFrame, *, job: str = "job", order: str = "pos", most_overlap: float = 0.5) -> DataFrame:
    """JOIN13: replacements taken in order unless the shot was used, or shares half of the shorter one with a shot used before. asked: shot, start, end."""

    def step(rows: list[Row]) -> Iterator[Row]:
        used: list[Row] = []
        for r in rows:
            why = None
            for u in used:
                shared = min(u["end"], r["end"]) - max(u["start"], r["start"])
                shorter = min(u["end"] - u["start"], r["end"] - r["start"])
                why = "used" if u["shot"] == r["shot"] else "overlap" if shorter > 0 and shared / shorter >= most_overlap else why
                if why:
                    break
            if why is None:
                used.append(r)
            yield {"pos": r[order], "accepted": why is None, "reason": why}

    return ordered_fold(asked.select(job, order, "shot", "start", "end"), [job], [order], step, "pos long, accepted boolean, reason string")


def greedy_prefix(rows: DataFrame, *, job: str = "job", order: str = "pos", low: float, high: float) -> DataFrame:
    """EXT3: rows in order until the low mark is reached, passing over those that would exceed the high one."""

    def step(rows: list[Row]) -> Iterator[Row]:
        total = 0.0
        for r in rows:
            length = r["end"] - r["start"]
            if total < low and total + length <= high:
                total += length
                yield {"pos": r[order], "total": float(total)}

    return ordered_fold(rows.select(job, order, "start", "end"), [job], [order], step, "pos long, total double")


def covering_window(start: float, end: float, spans: list[tuple[float, float]], *, grid: float, pad: float, cap: float) -> tuple[float, float]:
    """SCL16: the span padded, grown to the sentences it touches, on a grid; over cap it falls back to the padded span, cut to cap."""
    lo, hi = start - pad, end + pad
    for a, b in spans:
        if a < hi and b > lo:
            lo, hi = min(lo, a), max(hi, b)
    lo, hi = max(0.0, lo // grid * grid), -(-hi // grid) * grid
    if hi - lo > cap:
        lo = max(0.0, (start - pad) // grid * grid)
        hi = min(-(-(end + pad) // grid) * grid, lo + cap)
    return lo, hi


def canonical_digest(value: Any) -> str:
    """SCL4: sha256 of JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def find_object(value: Any, needed: set[str]) -> dict | None:
    """SCL10: the first object with all needed keys, in nested values or in text that holds JSON; a schema (with `properties`) is passed over."""
    if isinstance(value, str):
        decoder, at = json.JSONDecoder(), 0
        while m := re.compile(r"[{\[]").search(value, at):
            try:
                inner, at = decoder.raw_decode(value, m.start())
            except ValueError:
                at = m.end()
                continue
            found = find_object(inner, needed)
            if found is not None:
                return found
        return None
    if isinstance(value, dict):
        if "properties" in value:
            return None
        if needed <= value.keys():
            return value
        value = list(value.values())
    if isinstance(value, list):
        for v in value:
            found = find_object(v, needed)
            if found is not None:
                return found
    return None


def greatest_counters(value: Any, names: set[str]) -> dict[str, int]:
    """AGG14: of each named counter the greatest value anywhere in a nested value."""
    out: dict[str, int] = {}
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            for k, x in v.items():
                if k in names and isinstance(x, int) and not isinstance(x, bool):
                    out[k] = max(out.get(k, 0), x)
            stack.extend(v.values())
        elif isinstance(v, list):
            stack.extend(v)
    return out


UNIT = ["id", "start", "end", "topic", "claim", "strength", "relevance", "hook", "role", "needs", "independent", "usable"]


def unit_columns(units: DataFrame) -> list[Column]:
    """The columns of units that an order is judged by; without scenes none is known."""
    return [*map(F.col, UNIT), F.col("scene") if "scene" in units.columns else F.lit(None).cast("string").alias("scene")]


def violations(film: list[Row], low: float, high: float, *, second: float = 1.0, weak: float = 0.4, least_hook: float = 0.5, relevant: float = 0.6) -> list[tuple[Any, str]]:
    """AGG6: (id, code) of what is wrong with an order; validate.film_audit gives the same as rows."""
    if not film:
        return [(None, "empty")]
    first, out = film[0], []
    length = sum(u["end"] - u["start"] for u in film)
    if not first["independent"] or len(first["needs"]) or first["hook"] < least_hook:
        out.append((first["id"], "weak_opening"))
    if not low <= length <= high:
        out.append((first["id"], "duration_outside_target"))
    shown, told, before, scene_time, elapsed, product_at = set(), set(), None, 0.0, 0.0, None
    for u in film:
        span = u["end"] - u["start"]
        same_scene = before is not None and u["scene"] is not None and u["scene"] == before["scene"]
        scene_time = scene_time + span if same_scene else span
        broken = {
            "missing_context": not shown.issuperset(u["needs"]),
            "repeated_claim": u["claim"] in told,
            "weak_run": before is not None and before["strength"] < weak and u["strength"] < weak,
            "long_scene": u["scene"] is not None and scene_time > 25 * second,
        }
        out += [(u["id"], code) for code, is_so in broken.items() if is_so]
        if product_at is None and u["relevance"] >= relevant:
            product_at = elapsed
        elapsed += span
        before = u
        shown.add(u["id"])
        told.add(u["claim"])
    if product_at is None or product_at > 12 * second:
        out.append((first["id"], "late_product"))
    return out


#: So many free units of a job fit into the code of an order (six bits each); jobs of more are arranged one at a time.
MOST_CODED = 10


def _added(hi: np.ndarray, lo: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A compensated sum and one more value, as Python's sum does it."""
    t = hi + x
    big = np.abs(hi) >= np.abs(x)
    return t, lo + np.where(big, (hi - t) + x, (x - t) + hi)


def _rounded(x: np.ndarray) -> np.ndarray:
    """round(x, 3): near halves, where a product may err, by Python itself."""
    y = x * 1000
    out = np.rint(y) / 1000
    for k in np.flatnonzero(np.abs(np.abs(y - np.floor(y)) - 0.5) < 1e-6):
        out[k] = round(float(x[k]), 3)
    return out


def _codes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Equal values by equal numbers, and what is null."""
    coded = col.dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), col.is_null().to_numpy(zero_copy_only=False)


def _beams(batch: pa.RecordBatch, job: str, bounds: np.ndarray, *, low: float, high: float, openings: int, width: int, least_relevance: float, least_candidates: int, second: float, weak: float = 0.4, least_hook: float = 0.5, relevant: float = 0.6) -> tuple[list[int], dict[str, np.ndarray]]:
    """arrange for all jobs of a batch at once (job k: rows bounds[k] to bounds[k + 1], in the order of id): the jobs to arrange one at a time instead, and columns job, code (of the ids), n, strategy, duration, score, selected, wrong (violations).

    The strategies share one tree of orders; each has its own places in a beam, and an order goes on while any strategy holds it.
    """
    num = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64)
    yes = lambda c: batch.column(c).fill_null(False).to_numpy(zero_copy_only=False)
    start, end, strength, relevance, hook = map(num, ("start", "end", "strength", "relevance", "hook"))
    span, (topic, _), (role, _), (claim, _), (scene, no_scene) = end - start, *map(_codes, map(batch.column, ("topic", "role", "claim", "scene")))
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    free = yes("usable") & (relevance >= least_relevance)
    counts = np.bincount(of[free], minlength=len(bounds) - 1)
    alone = np.flatnonzero(counts > MOST_CODED)
    free &= counts[of] <= MOST_CODED
    rows = np.flatnonzero(free)  # of the free units, by job and id
    counts = np.bincount(of[rows], minlength=len(bounds) - 1)
    first = np.cumsum(counts) - counts
    of, start, end, span, strength, relevance, hook, topic, role, claim, scene, no_scene = (x[rows] for x in (of, start, end, span, strength, relevance, hook, topic, role, claim, scene, no_scene))
    place = np.arange(len(rows)) - first[of]
    bit = np.int64(1) << place
    each = np.repeat(np.arange(len(rows)), counts[of])  # pairs of free units of a job
    other = np.arange(len(each)) - np.repeat(np.cumsum(counts[of]) - counts[of], counts[of]) + first[of[each]]
    pair = lambda same: np.bincount(each[same], weights=bit[other[same]].astype(np.float64), minlength=len(rows)).astype(np.int64)
    blocked = bit | pair(claim[each] == claim[other])
    needs = batch.column("needs").take(pa.array(rows)).to_pylist() if batch.column("needs").values.slice(0, 1) else None
    has, need = np.zeros(len(rows), bool), np.zeros(len(rows), np.int64)
    if needs is not None:
        ids = batch.column("id").take(pa.array(rows)).to_pylist()
        for k, ns in enumerate(needs):
            if ns:
                at, n = first[of[k]], counts[of[k]]
                has[k] = True
                for i in ns:
                    need[k] |= next((1 << j for j in range(n) if ids[at + j] == i), 1 << 62)  # a bit that no order has
    if len(rows):
        alike = np.bincount(each[role[each] == role[other]], minlength=len(rows))
        most = np.zeros(len(counts), np.int64)
        np.maximum.at(most, of, alike)
        leads = np.flatnonzero(alike == most[of])[::-1]
        lead = np.full(len(counts), -1)
        lead[of[leads]] = role[leads]  # the first of equals is written last
    opening = np.flatnonzero(yes("independent")[rows] & ~has & (hook >= least_hook))
    opening = opening[np.lexsort((-hook[opening], of[opening]))]
    rank_in = lambda groups: np.arange(len(groups)) - np.searchsorted(groups, groups)
    at = rank_in(of[opening])
    opening, at = opening[at < openings], at[at < openings]

    u, n = opening, 1
    zero = np.zeros(len(u))
    s = {"job": of[u], "mask": blocked[u], "shown": bit[u], "last": u, "code": place[u] + 1, "total": span[u], "total_lo": zero, "power": strength[u], "power_lo": zero, "near": relevance[u], "near_lo": zero, "jumps": zero, "weak": zero, "long": zero, "elapsed": span[u], "scene": span[u], "hook": hook[u], "lead": (role[u] == lead[of[u]]).astype(np.float64) if len(u) else zero}
    s["long"] = (~no_scene[u] & (span[u] > 25 * second)).astype(np.float64)
    s["product"] = np.where(relevance[u] >= relevant, 0.0, np.nan)
    s["at"], s["on"] = np.stack([at] * 3), np.ones((3, len(u)), bool)
    done: list[dict[str, np.ndarray]] = []

    def judge(s: dict[str, np.ndarray], n: int) -> None:
        power, total = s["power"] + s["power_lo"], s["total"] + s["total_lo"]
        kept = 0.25 * s["hook"] + 0.35 * power / n + 0.25 * (s["near"] + s["near_lo"]) / n + 0.15 * (1 - s["jumps"] / max(1, n - 1))
        wrong = s["weak"] + s["long"] + ~(s["product"] <= 12 * second)
        s["base"], s["wrong"], s["length"] = 100 * np.clip(kept, 0.0, 1.0), wrong, total
        plain = _rounded(s["base"] - 20 * (wrong + ~((total >= 0) & (total <= high))))
        more = 0.3 * np.minimum(total, low)
        s["rank"] = np.stack([plain + b + more for b in (3 * s["lead"], 3 * power, 3 * (n - 1 - s["jumps"]))])

    while len(s["job"]):
        judge(s, n)
        if n > 1:
            for k in range(3):
                alive = np.flatnonzero(s["on"][k])
                order = alive[np.lexsort((s["at"][k][alive], -s["rank"][k][alive], s["job"][alive]))]
                s["at"][k][order] = rank_in(s["job"][order])
            s["on"] &= s["at"] < width
        good = np.flatnonzero((s["length"] >= low) & (s["length"] <= high) & s["on"].any(axis=0))
        done.append({c: s[c][..., good] for c in ("job", "code", "length", "base", "wrong", "rank", "at", "on")} | {"n": np.full(len(good), n)})
        # the next unit
        held = np.flatnonzero(s["on"].any(axis=0))
        size = counts[s["job"][held]]
        p = np.repeat(held, size)
        u = np.arange(len(p)) - np.repeat(np.cumsum(size) - size, size) + first[s["job"][p]]
        ok = (s["mask"][p] & bit[u]) == 0
        p, u = p[ok], u[ok]
        ok = (s["length"][p] + end[u]) - start[u] <= high
        if needs is not None:
            ok &= (need[u] & ~s["shown"][p]) == 0
        p, u = p[ok], u[ok]
        last, step = s["last"][p], span[u]
        c = {"job": s["job"][p], "mask": s["mask"][p] | blocked[u], "shown": s["shown"][p] | bit[u], "last": u, "code": s["code"][p] << 6 | place[u] + 1, "hook": s["hook"][p]}
        for name, x in (("total", step), ("power", strength[u]), ("near", relevance[u])):
            c[name], c[name + "_lo"] = _added(s[name][p], s[name + "_lo"][p], x)
        c["jumps"] = s["jumps"][p] + (topic[last] != topic[u])
        c["weak"] = s["weak"][p] + ((strength[last] < weak) & (strength[u] < weak))
        c["scene"] = np.where((scene[last] == scene[u]) & ~no_scene[u], s["scene"][p] + step, step)
        c["long"] = s["long"][p] + (~no_scene[u] & (c["scene"] > 25 * second))
        c["product"] = np.where(np.isnan(s["product"][p]) & (relevance[u] >= relevant), s["elapsed"][p], s["product"][p])
        c["elapsed"] = s["elapsed"][p] + step
        c["lead"] = s["lead"][p] + (role[u] == lead[c["job"]])
        c["at"], c["on"] = s["at"][:, p] * 64 + place[u], s["on"][:, p]
        s, n = c, n + 1

    d = {c: np.concatenate([x[c] for x in done], axis=-1) for c in done[0]} if done else None
    if d is None or not len(d["job"]):
        return alone.tolist(), {}
    left, picks = np.ones(len(d["job"]), bool), []
    for k in range(3):
        best = np.full(len(counts), -np.inf)
        able = np.flatnonzero(left & d["on"][k])
        np.maximum.at(best, d["job"][able], d["rank"][k][able])
        top = able[d["rank"][k][able] == best[d["job"][able]]]
        top = top[np.lexsort((d["at"][k][top], d["n"][top], d["job"][top]))]
        top = top[rank_in(d["job"][top]) == 0]
        left[top] = False
        picks.append(top)
    found = np.bincount(d["job"][np.concatenate(picks)], minlength=len(counts))
    several = np.bincount(d["job"], minlength=len(counts))
    alone = np.concatenate([alone, np.flatnonzero((found < max(3, least_candidates)) & (several >= least_candidates))])  # others fill up
    full = np.flatnonzero((found == 3) & (found >= least_candidates))
    chosen = np.stack([x[np.searchsorted(d["job"][x], full)] for x in picks], axis=1) if len(full) else np.zeros((0, 3), np.int64)
    score = _rounded((d["base"] - 20 * d["wrong"])[chosen.ravel()]).reshape(-1, 3)
    selected = np.arange(3) == score.argmax(axis=1)[:, None]
    flat = chosen.ravel()
    return sorted(set(alone.tolist())), {"job": d["job"][flat], "code": d["code"][flat], "n": d["n"][flat], "strategy": np.tile(np.arange(3), len(full)), "duration": d["length"][flat], "score": score.ravel(), "wrong": d["wrong"][flat], "selected": selected.ravel(), "rows": rows, "first": first}


def arrange(units: DataFrame, *, job: str = "job", low: float, high: float, openings: int = 8, width: int = 60, least_relevance: float = 0.4, least_candidates: int = 3, second: float = 1.0, audited: bool = False) -> DataFrame:
    """TOPK4: orders of a job's units by beam search: (job, candidate, strategy, ids, duration, score, selected), and audited the number of violations.

    units: id, start, end, topic, claim, strength, relevance, hook, role, needs, independent, usable, and scene if
    there is one; second: what one second is in the unit of times. An order opens with an
    independent unit of hook 0.5 or more, repeats no claim and plays what a unit needs before it. Three strategies rank
    partial orders: by the leading role, by strength, by unbroken topics. Jobs with fewer than least_candidates different
    orders give none.
    """

    def score(seq: list[Row], floor: float) -> float:
        n = len(seq)
        jumps = sum(a["topic"] != b["topic"] for a, b in zip(seq, seq[1:], strict=False)) / max(1, n - 1)
        repeats = 1 - len({u["claim"] for u in seq}) / n
        kept = 0.25 * seq[0]["hook"] + 0.35 * sum(u["strength"] for u in seq) / n + 0.25 * sum(u["relevance"] for u in seq) / n + 0.15 * (1 - jumps) - repeats
        return round(100 * max(0.0, min(1.0, kept)) - 20 * len(violations(seq, floor, high, second=second)), 3)

    def step(rows: list[Row]) -> Iterator[Row]:
        free = [r for r in rows if r["usable"] and r["relevance"] >= least_relevance]
        roles = [r["role"] for r in free]
        lead = max(dict.fromkeys(roles), key=roles.count) if roles else None
        extra = {
            "focus": lambda s: 3 * sum(u["role"] == lead for u in s),
            "density": lambda s: 3 * sum(u["strength"] for u in s),
            "continuity": lambda s: 3 * sum(a["topic"] == b["topic"] for a, b in zip(s, s[1:], strict=False)),
        }
        starts = sorted((r for r in free if r["independent"] and not len(r["needs"]) and r["hook"] >= 0.5), key=lambda r: -r["hook"])[:openings]
        total = lambda s: sum(u["end"] - u["start"] for u in s)
        seen: dict[tuple, tuple[str, list[Row]]] = {}
        others: dict[tuple, list[Row]] = {}
        known: dict[tuple, float] = {}  # the strategies meet the same orders

        def plain(s: list[Row]) -> float:
            ids = tuple(u["id"] for u in s)
            if ids not in known:
                known[ids] = score(s, 0)
            return known[ids]

        for name, bonus in extra.items():
            rank = lambda s, b=bonus: plain(s) + b(s) + 0.3 * min(total(s), low)
            beam, done = [[s] for s in starts], []
            for _ in range(len(free)):
                done += [s for s in beam if low <= total(s) <= high]
                beam = [[*s, u] for s in beam for u in free if u["id"] not in {x["id"] for x in s} and u["claim"] not in {x["claim"] for x in s} and set(u["needs"]) <= {x["id"] for x in s} and total(s) + u["end"] - u["start"] <= high]
                beam = sorted(beam, key=rank, reverse=True)[:width]
                if not beam:
                    break
            for s in sorted(done, key=rank, reverse=True):
                ids = tuple(u["id"] for u in s)
                if ids not in seen:
                    seen[ids] = (name, s)
                    break
            others.update({tuple(u["id"] for u in s): s for s in done})
        for ids, s in sorted(others.items(), key=lambda x: -score(x[1], low)):
            if len(seen) >= least_candidates:
                break
            seen.setdefault(ids, ("alternative", s))
        if len(seen) < least_candidates:
            return
        scored = [(ids, name, total(s), score(s, low)) for ids, (name, s) in seen.items()]
        best = max(x[3] for x in scored)
        chosen = next(x[0] for x in scored if x[3] == best)
        for k, (ids, name, length, value) in enumerate(scored):
            yield {"candidate": f"c{k}", "strategy": name, "ids": list(ids), "duration": float(length), "score": value, "selected": ids == chosen, "violations": len(violations(seen[ids][1], low, high, second=second))}

    names = ["focus", "density", "continuity"]
    ddl = f"{job} {units.schema[job].dataType.simpleString()}, candidate string, strategy string, ids array<long>, duration double, score double, selected boolean" + ", violations long" * audited
    kind = to_arrow_schema(_parse_datatype_string(ddl))

    def arranged(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Of whole jobs, one after the other."""
        code = _codes(rows.column(job))[0]
        bounds = np.concatenate([[0], np.flatnonzero(code[1:] != code[:-1]) + 1, [len(code)]])
        alone, d = _beams(rows, job, bounds, low=low, high=high, openings=openings, width=width, least_relevance=least_relevance, least_candidates=least_candidates, second=second)
        if d:
            back = 6 * (d["n"].repeat(d["n"]) - 1 - (np.arange(d["n"].sum()) - np.repeat(np.cumsum(d["n"]) - d["n"], d["n"])))
            at = (d["code"].repeat(d["n"]) >> back & 63) - 1 + d["first"][d["job"].repeat(d["n"])]
            ids = rows.column("id").cast(pa.int64()).take(pa.array(d["rows"][at]))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(d["n"])]).astype(np.int32)), ids)
            words = [pa.array(x).take(pa.array(d["strategy"])) for x in (["c0", "c1", "c2"], names)]
            cols = [rows.column(job).take(pa.array(bounds[d["job"]])), *words, lists, *(pa.array(d[c]) for c in ("duration", "score", "selected", *["wrong"] * audited))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, kind, strict=True)], schema=kind)
        for k in alone:
            held = rows.slice(bounds[k], bounds[k + 1] - bounds[k]).to_pylist()
            out = [{**r, job: held[0][job]} for r in step(held)]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):  # so much at once stays in the processor's memory
                part = batch.slice(at, 2000)
                rest = part if rest is None else pa.concat_batches([rest, part])
                code = _codes(rest.column(job))[0]
                edge = int(np.flatnonzero(code != code[-1])[-1]) + 1 if (code != code[-1]).any() else 0
                if edge:
                    yield from arranged(rest.slice(0, edge))
                    rest = rest.slice(edge)
        if rest is not None and rest.num_rows:
            yield from arranged(rest)

    return units.select(job, *unit_columns(units)).repartition(job).sortWithinPartitions(job, "id").mapInArrow(run, ddl)


#: Jobs with a longer film than this, or more orders or remarks, are reviewed one at a time.
MOST_SHOWN = 64


def _faults(film: np.ndarray, size: np.ndarray, u: dict[str, np.ndarray], low: float, high: float, second: float, *, weak: float = 0.4, least_hook: float = 0.5, relevant: float = 0.6) -> tuple[np.ndarray, np.ndarray]:
    """violations of many films of units without needs (film: a row of unit numbers, of which size count), a column for each place where one may stand in their list; and the films' lengths."""
    n, most = film.shape
    out = np.zeros((n, 3 * most + 3), bool)
    hi, lo, shown, elapsed, product = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.full(n, np.nan)
    claims = u["claim"][film]
    for k in range(most):
        on, x = k < size, film[:, k]
        span = np.where(on, u["span"][x], 0.0)
        hi, lo = _added(hi, lo, span)
        before = film[:, k - 1]
        same = ~u["no_scene"][x] & (u["scene"][x] == u["scene"][before]) & (k > 0)
        shown = np.where(same, shown + span, span)
        out[:, 2 + 3 * k] = on & (claims[:, :k] == claims[:, k : k + 1]).any(axis=1)
        out[:, 3 + 3 * k] = on & (k > 0) & (u["strength"][before] < weak) & (u["strength"][x] < weak)
        out[:, 4 + 3 * k] = on & ~u["no_scene"][x] & (shown > 25 * second)
        product = np.where(np.isnan(product) & on & (u["relevance"][x] >= relevant), elapsed, product)
        elapsed = elapsed + span
    length = hi + lo
    out[:, 0] = ~u["independent"][film[:, 0]] | (u["hook"][film[:, 0]] < least_hook)
    out[:, 1] = ~((low <= length) & (length <= high))
    out[:, -1] = ~(product <= 12 * second)
    return out, length


def _spread(counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of counts rows, each from its first: (the group, the row) of all rows."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + first[of]


def _struct(col: pa.Array) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Lists of structs: their lengths (null: 0), and the fields end to end."""
    flat = col.flatten()
    return pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64), dict(zip([f.name for f in flat.type], flat.flatten(), strict=True))


def _reviews(batch: pa.RecordBatch, *, low: float, high: float, rounds: int, least_relevance: float, second: float) -> tuple[list[int], dict[str, pa.Array]]:
    """review_orders for all jobs of a batch at once (columns units, orders, remarks): the jobs to review one at a time instead, and what comes out for the others, the number of the row as row."""
    jobs = batch.num_rows
    (n_units, f), (n_orders, o), (n_said, m) = (_struct(batch.column(c)) for c in ("units", "orders", "remarks"))
    if rounds < 1 or not (pa.types.is_integer(f["id"].type) and pa.types.is_integer(m["id"].type)):
        return list(range(jobs)), {}
    of, o_of, m_of = (np.repeat(np.arange(jobs), n) for n in (n_units, n_orders, n_said))
    base, o_base = np.cumsum(n_units) - n_units, np.cumsum(n_orders) - n_orders
    num = lambda c: c.to_numpy(zero_copy_only=False).astype(np.float64)
    yes = lambda c: c.fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
    u = {c: num(f[c]) for c in ("strength", "relevance", "hook")} | {"span": num(f["end"]) - num(f["start"]), "independent": yes(f["independent"])}
    (u["claim"], _), (topic, _), (role, no_role), (u["scene"], u["no_scene"]) = (_codes(f[c]) for c in ("claim", "topic", "role", "scene"))
    usable, score, o_len = yes(f["usable"]) & (u["relevance"] >= least_relevance), num(o["score"]), pc.fill_null(pc.list_value_length(o["ids"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)

    # Units by their numbers in the batch.
    named = o["ids"].flatten()
    of_named = np.repeat(np.arange(len(o_of)), o_len)
    ids = pa.concat_arrays([f["id"].cast(pa.int64()), named.cast(pa.int64()), m["id"].cast(pa.int64())])
    code, absent = _codes(ids)
    key = np.concatenate([of, o_of[of_named], m_of]) * (int(code.max(initial=0)) + 1) + code
    order = np.argsort(key[: len(of)], kind="stable")
    held = key[: len(of)][order]
    found = np.minimum(np.searchsorted(held, key[len(of) :]), max(0, len(held) - 1))
    found = np.where(held[found] == key[len(of) :], order[found], -1) if len(held) else np.full(len(found), -1)
    found[absent[len(of) :]] = -1
    named_at, said_at, said_none = found[: len(named)], found[len(named) :], absent[len(of) + len(named) :]

    # What isn't plain is reviewed one at a time.
    odd = (n_said > MOST_SHOWN) | (n_orders > MOST_SHOWN) | (n_units < 1)
    odd[of[order[1:][held[1:] == held[:-1]]]] = True
    odd[of[absent[: len(of)] | (pc.fill_null(pc.list_value_length(f["needs"]), 1).to_numpy(zero_copy_only=False) > 0) | ~np.isfinite(u["strength"] + u["relevance"] + u["hook"] + u["span"])]] = True
    odd[o_of[(o_len < 1) | (o_len > MOST_SHOWN) | ~np.isfinite(score)]] = True
    odd[o_of[of_named[named_at < 0]]] = True
    selected = np.flatnonzero(yes(o["selected"]))[::-1]
    now = np.full(jobs, -1)
    now[o_of[selected]] = selected  # the first is written last
    odd |= now < 0
    live = np.flatnonzero(~odd)
    if not len(live):
        return np.flatnonzero(odd).tolist(), {}

    most = int(o_len[~odd[o_of]].max())
    seqs = np.zeros((len(o_of), most), np.int64)
    place = np.arange(len(named)) - np.repeat(np.cumsum(o_len) - o_len, o_len)
    fits = place < most
    seqs[of_named[fits], place[fits]] = np.maximum(named_at[fits], 0)
    ranked = np.lexsort((-score, o_of))
    film, size, initial = seqs[now], o_len[now], now.copy()
    passed, turns, length = np.zeros(jobs, bool), np.zeros(jobs, np.int64), np.zeros(jobs)
    col = np.arange(most)
    within = lambda js, xs: (film[js] == xs[:, None]) & (col < size[js][:, None])
    events: list[tuple[np.ndarray, int, pa.Array, pa.Array, pa.Array]] = []
    changed = np.zeros(jobs, bool)

    def give_way(js: np.ndarray, xs: np.ndarray, attempt: int, reason: pa.Array) -> None:
        """In each of the jobs js the unit xs, if it is shown, to the strongest that can stand there."""
        hit = within(js, xs)
        able = np.flatnonzero(hit.any(axis=1))
        js, xs, at = js[able], xs[able], hit[able].argmax(axis=1)
        p, c = _spread(n_units[js], base[js])
        old = xs[p]
        ok = usable[c] & ((topic[c] == topic[old]) | (~no_role[c] & (role[c] == role[old])))
        p, c = p[ok], c[ok]
        ok = ~within(js[p], c).any(axis=1)
        p, c = p[ok], c[ok]
        trial = film[js[p]]
        trial[np.arange(len(p)), at[p]] = c
        ok = ~_faults(trial, size[js[p]], u, low, high, second)[0].any(axis=1)
        p, c = p[ok], c[ok]
        best = np.lexsort((c, -u["strength"][c], p))
        p, c = p[best], c[best]
        top = np.flatnonzero(np.diff(p, prepend=-1))
        p, c = p[top], c[top]
        if len(p):
            film[js[p], at[p]] = c
            changed[js[p]] = True
            text = f["id"].cast(pa.string())
            events.append((js[p], attempt, text.take(pa.array(xs[p])), text.take(pa.array(c)), reason.take(pa.array(able[p]))))

    said_in = num(m["attempt"])  # null: nan
    for attempt in range(rounds):
        wrong, length[live] = _faults(film[live], size[live], u, low, high, second)
        heard = np.flatnonzero(np.isnan(said_in) | (said_in == attempt))
        heard = heard[~odd[m_of[heard]]]
        heard = heard[said_none[heard] | (said_at[heard] >= 0) & within(m_of[heard], said_at[heard]).any(axis=1)]
        good = ~wrong.any(axis=1) & (np.bincount(m_of[heard], minlength=jobs)[live] == 0)
        passed[live], turns[live] = good, attempt + 1
        live, wrong = live[~good], wrong[~good]
        if attempt == rounds - 1 or not len(live):
            break
        going = np.zeros(jobs, bool)
        going[live] = True
        heard = heard[going[m_of[heard]]]
        changed[:] = False
        was = film[live]
        for k in np.flatnonzero(wrong.any(axis=0)):
            name, at = ("weak_opening", 0) if k == 0 else ("duration_outside_target", 0) if k == 1 else ("late_product", 0) if k == wrong.shape[1] - 1 else (("repeated_claim", "weak_run", "long_scene")[(k - 2) % 3], (k - 2) // 3)
            rows = np.flatnonzero(wrong[:, k])
            give_way(live[rows], was[rows, at], attempt, pa.array([name]).take(pa.array(np.zeros(len(rows), np.int64))))
        nth = np.arange(len(heard)) - np.searchsorted(m_of[heard], m_of[heard])
        for k in range(int(nth.max(initial=-1)) + 1):
            rows = heard[(nth == k) & ~said_none[heard]]
            give_way(m_of[rows], said_at[rows], attempt, m["reason"].take(pa.array(rows)))
        stuck = live[~changed[live]]
        p, at = _spread(n_orders[stuck], o_base[stuck])
        to = ranked[at]
        other = ((seqs[to] != film[stuck[p]]) & (col < o_len[to][:, None])).any(axis=1) | (o_len[to] != size[stuck[p]])
        p, to = p[other], to[other]
        nth = np.arange(len(p)) - np.searchsorted(p, p)
        pick = nth == np.minimum(attempt, np.bincount(p, minlength=len(stuck))[p] - 1)
        js, to = stuck[p[pick]], to[pick]
        events.append((js, attempt, o["candidate"].take(pa.array(now[js])), o["candidate"].take(pa.array(to)), pa.array(["whole_film"]).take(pa.array(np.zeros(len(js), np.int64)))))
        now[js], film[js], size[js] = to, seqs[to], o_len[to]

    out = np.flatnonzero(~odd)
    at = np.concatenate([np.zeros(0, np.int64), *(e[0] for e in events)])
    order = pa.array(np.argsort(at, kind="stable"))
    text = lambda k: pa.concat_arrays([pa.array([], pa.string()), *(e[k].cast(pa.string()) for e in events)]).take(order)
    attempts = pa.array(np.repeat(np.array([e[1] for e in events], np.int32), [len(e[0]) for e in events])).take(order)
    lists = lambda n, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), values)
    shown = film[out][col < size[out][:, None]]
    return np.flatnonzero(odd).tolist(), {
        "row": pa.array(out), "passed": pa.array(passed[out]), "rounds": pa.array(turns[out].astype(np.int32)), "initial_ids": o["ids"].take(pa.array(initial[out])), "ids": lists(size[out], ids.take(pa.array(shown))), "duration": pa.array(length[out]),
        "replaced": lists(np.bincount(at, minlength=jobs)[out], pa.StructArray.from_arrays([attempts, text(2), text(3), text(4)], ["attempt", "old", "new", "reason"])),
    }


def review_orders(units: DataFrame, orders: DataFrame, remarks: DataFrame, *, job: str = "job", low: float, high: float, rounds: int = 3, least_relevance: float = 0.4, second: float = 1.0) -> DataFrame:
    """TOPK5: the selected order of each job after at most rounds reviews: passed, rounds, initial_ids, ids, duration, replaced.

    orders: as arrange gives them. remarks: what a reviewer says, (job, attempt, id, reason); a null attempt is said in
    every round, a null id of the whole film, an id that isn't shown nothing. A unit with a remark or violation gives way
    to the strongest one not shown, of its topic or role, with which the film has no violation; if none gives way, the
    best other order takes over (the next best in the second round). Nothing passes that still has a remark or violation.
    """
    films = units.select(job, *unit_columns(units)).groupBy(job).agg(F.sort_array(F.collect_list(F.struct("id", *[c for c in UNIT if c != "id"], F.col("scene").cast("string").alias("scene")))).alias("units"))
    plans = orders.groupBy(job).agg(F.sort_array(F.collect_list(F.struct("candidate", "ids", "score", "selected"))).alias("orders"))
    said = remarks.groupBy(job).agg(F.sort_array(F.collect_list(F.struct("attempt", "id", "reason"))).alias("remarks"))
    rows = plans.join(films, job).join(said, job, "left").select(job, "units", "orders", "remarks")

    def step(r: Row) -> Row:
        by_id = {u["id"]: u for u in r["units"]}
        ranked = sorted(r["orders"], key=lambda o: -o["score"])
        now = next(o for o in r["orders"] if o["selected"])
        film = [by_id[i] for i in now["ids"]]
        replaced, passed, attempt = [], False, 0
        for attempt in range(rounds):
            shown = [u["id"] for u in film]
            heard = [(m["id"], m["reason"]) for m in r["remarks"] or [] if m["attempt"] in (None, attempt) and (m["id"] is None or m["id"] in shown)]
            wrong = violations(film, low, high, second=second) + heard
            passed = not wrong
            if passed or attempt == rounds - 1:
                break
            count = len(replaced)
            for unit, reason in wrong:
                at = next((k for k, u in enumerate(film) if u["id"] == unit), None)
                if at is None:
                    continue
                old, shown = film[at], {u["id"] for u in film}
                spare = [u for u in r["units"] if u["usable"] and u["id"] not in shown and u["relevance"] >= least_relevance and (u["topic"] == old["topic"] or u["role"] is not None and u["role"] == old["role"])]
                trials = ([*film[:at], u, *film[at + 1 :]] for u in sorted(spare, key=lambda u: -u["strength"]))
                good = next((t for t in trials if not violations(t, low, high, second=second)), None)
                if good:
                    replaced.append({"attempt": attempt, "old": str(unit), "new": str(good[at]["id"]), "reason": reason})
                    film = good
            others = [o for o in ranked if o["ids"] != [u["id"] for u in film]]
            if count == len(replaced) and others:
                to = others[min(attempt, len(others) - 1)]
                replaced.append({"attempt": attempt, "old": now["candidate"], "new": to["candidate"], "reason": "whole_film"})
                now, film = to, [by_id[i] for i in to["ids"]]
        first = next(o for o in r["orders"] if o["selected"])
        return {"passed": passed, "rounds": attempt + 1, "initial_ids": first["ids"], "ids": [u["id"] for u in film], "duration": float(sum(u["end"] - u["start"] for u in film)), "replaced": replaced}

    ddl = f"{job} {units.schema[job].dataType.simpleString()}, passed boolean, rounds int, initial_ids array<long>, ids array<long>, duration double, replaced array<struct<attempt:int,old:string,new:string,reason:string>>"
    kind = to_arrow_schema(_parse_datatype_string(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("units")), 0).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + 20_000, side="right")))  # so many units at once
                part = batch.slice(lo, hi - lo)
                lo = hi
                alone, d = _reviews(part, low=low, high=high, rounds=rounds, least_relevance=least_relevance, second=second)
                if d:
                    cols = [part.column(job).take(d.pop("row")), *d.values()]
                    yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(cols, kind, strict=True)], schema=kind)
                if alone:
                    held = part.take(pa.array(alone)).to_pylist()
                    yield pa.RecordBatch.from_pylist([{**step(r), job: r[job]} for r in held], schema=kind)

    return rows.mapInArrow(run, ddl)
