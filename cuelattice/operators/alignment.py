"""Picks found again in what was said: anchored text alignment, silences as a fallback, and a probe of many picks.

A pick is a span with a text. The characters around it come by a range join of a fixed margin, so a task holds the picks
of one job with some seconds of characters each, never a whole recording for each pick.
Times are in the unit of the caller; second is what one second is in it.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.operators.folds import Row, common_lengths, letters, longest_common, ordered_fold
from cuelattice.operators.intervals import overlap_join

#: Seconds round a pick that can hold characters its alignment looks at.
MARGIN = 3.0

SCHEMA = "id long, mode string, start double, end double, coverage double, text string, reason string, said string, similarity double, word_coverage double"


class Match(NamedTuple):
    share: float
    start: float
    end: float
    whole: bool  # the last character was found


def around(picks: DataFrame, chars: DataFrame, *, job: str, order: str, margin: float) -> DataFrame:
    """PIPE8: picks with the characters (job, s, e, w) that lie within margin of them, as an array in the order of time; empty without any."""
    spans = picks.select(job, order, (F.col("start") - margin).alias("_from"), (F.col("end") + margin).alias("_to"))
    near = overlap_join(spans, chars.select(job, F.col("s").cast("double").alias("s"), F.col("e").cast("double").alias("e"), "w"), [job], ("_from", "_to"), ("s", "e"), bucket=4 * margin)
    held = near.groupBy(job, order).agg(F.sort_array(F.collect_list(F.struct("s", "e", "w"))).alias("chars"))
    return picks.join(held, [job, order], "left")


def search(chars: list[Row], want: str, anchor: float, window: tuple[float, float], limit: float) -> Match | None:
    """Of all places in the window where the text's first character stands, the one from which most of the text follows up to limit; of equals the nearest to the anchor."""
    starts, heard = [c["s"] for c in chars], "".join(c["ch"] for c in chars)
    reach = bisect_right(starts, limit)
    places = [i for i in range(bisect_left(starts, window[0]), min(reach, bisect_right(starts, window[1]))) if want and heard[i] == want[0]]
    if not places:
        return None
    most = common_lengths(heard[:reach], want, places)  # one pass tells what follows from every place
    best = max(most.values())
    i = min((i for i in places if most[i] == best), key=lambda i: abs(starts[i] - anchor))
    pairs = longest_common(heard[i:reach], want)
    return Match(len(pairs) / len(want), starts[i], chars[i + pairs[-1][0]]["e"], pairs[-1][1] == len(want) - 1)


def gap_bounds(chars: list[Row], m: Match, second: float) -> tuple[float, float]:
    """A match with some air on both sides, but never into its neighbours; more at the end if the last character wasn't found."""
    before = max((c["e"] for c in chars if c["e"] <= m.start + 1e-6), default=None)
    after = min((c["s"] for c in chars if c["s"] >= m.end - 1e-6), default=None)
    start, end = m.start - 0.08 * second, m.end + (0.18 if m.whole else 0.5) * second
    if before is not None:
        start = min(m.start, max(start, before + 0.02 * second))
    if after is not None:
        end = max(m.end, min(end, after - 0.02 * second))
    return round(max(0.0, start), 3), round(end, 3)


def without_head(text: str, k: int) -> str:
    """The text from after its k-th letter."""
    places = [i for i, c in enumerate(text) if letters(c)]
    return text[places[k - 1] + 1 :] if k else text


def align_pick(chars: list[Row], text: str, start: float, end: float, second: float) -> tuple[float, float, float, str, str] | None:
    """STR10: (start, end, share found, how, text) of a text among characters, or None.

    It is sought near the pick's start and no further than just after its end, as the same words may be said twice. If too
    little is found, up to three letters are left off its head, in the result too; then its first and last three letters
    are sought on their own.
    """
    want = letters(text)
    for k in range(4):
        if not chars or len(want) - k < 3:
            break
        m = search(chars, want[k:], start, (start - 2.2 * second, start + 2.2 * second), end + 0.45 * second)
        if m and m.share >= (0.8 if k else 0.6):
            return *gap_bounds(chars, m, second), round(m.share, 2), f"char-{k}" if k else "char", without_head(text, k)
    if chars and len(want) >= 3:
        head = search(chars, want[:3], start, (start - 2.2 * second, start + 2.2 * second), start + 2.5 * second)
        tail = search(chars, want[-3:], end, (end - 2.5 * second, end + 2.2 * second), end + 2.0 * second)
        if head and tail and min(head.share, tail.share) >= 0.55:
            both = Match(min(head.share, tail.share), head.start, tail.end, tail.whole)
            return *gap_bounds(chars, both, second), round(both.share, 2), "headtail", text
    return None


def nearest(cores: list[float], at: float, within: float) -> float | None:
    """The silence nearest to a time, the first of equals."""
    return min((c for c in cores if abs(c - at) <= within), key=lambda c: abs(c - at), default=None)


def align_picks(
    picks: DataFrame, chars: DataFrame, *, job: str = "job", order: str = "id", cores: DataFrame | None = None, banned: str | None = None, pad: tuple[float, float], second: float = 1.0, most_shared: float = 0.2
) -> DataFrame:
    """PIPE8: each pick (job, id, start, end, text) with its cut: mode, start, end, coverage, text, reason, what is said there.

    mode: char, char-1 to char-3, headtail (STR10); snap, where both ends lie near a silence (cores: job, at); expand, the
    padded span without the silence at its ends; skipped, if padding would bring in a banned pattern (reason
    banned_neighbour), or if the pick shares more than most_shared seconds with an earlier one that stays (overlap). An
    aligned cut counts if its length is 0.3 to 1.7 of the pick's and the two touch. Picks without text are never aligned;
    null spans give nothing. said, similarity and word_coverage compare the letters in the cut with the text's.
    """
    bad = re.compile(banned) if banned else None
    rows = around(picks.where("start is not null and end is not null").select(job, order, F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "text"), chars, job=job, order=order, margin=MARGIN * second)
    if cores is None:
        rows = rows.withColumn("cores", F.array().cast("array<double>"))
    else:
        marks = cores.select(job, (F.col("at") - 0.6 * second).cast("double").alias("_a"), (F.col("at") + 0.6 * second).cast("double").alias("_b"), F.col("at").cast("double").alias("at"))
        by = overlap_join(picks.select(job, order, F.col("start").alias("_s"), F.col("end").alias("_e")), marks, [job], ("_s", "_e"), ("_a", "_b"), bucket=10 * second, slack=-1e-6)
        rows = rows.join(by.groupBy(job, order).agg(F.array_sort(F.collect_list("at")).alias("cores")), [job, order], "left")

    def place(r: Row, near: list[Row]) -> Row:
        start, end = r["start"], r["end"]
        found = align_pick(near, r["text"] or "", start, end, second)
        if found and 0.3 * (end - start) <= found[1] - found[0] <= 1.7 * (end - start) and found[0] <= end and found[1] >= start:
            return dict(zip(("start", "end", "coverage", "mode", "text"), found, strict=True))
        a, b = (nearest(r["cores"] or [], t, 0.6 * second) for t in (start, end))
        if a is not None and b is not None and b - a >= 0.6 * second and start - a <= 0.3 * second and b - end <= 0.5 * second:
            return {"start": round(a, 3), "end": round(b, 3), "coverage": 0.0, "mode": "snap"}
        lo, hi = max(0.0, start - pad[0]), end + pad[1]
        inside = [c for c in near if start <= c["s"] <= end]
        if inside:
            lo, hi = max(lo, inside[0]["s"] - 0.15 * second), min(hi, max(c["e"] for c in inside) + 0.25 * second)
        said = lambda x, y: "".join(c["w"] for c in near if x <= c["s"] <= y)
        if bad and (bad.search(said(lo - 0.2 * second, start)) or bad.search(said(end, hi + 0.2 * second))):
            return {"mode": "skipped", "reason": "banned_neighbour"}
        return {"start": round(lo, 3), "end": round(hi, 3), "coverage": 0.0, "mode": "expand"}

    def step(held: list[Row]) -> Iterator[Row]:
        kept: list[tuple[float, float]] = []
        for r in held:
            near = [{**c, "ch": letters(c["w"])[0]} for c in r["chars"] or [] if letters(c["w"])]
            out = {"id": r[order], "text": r["text"], "reason": None, **place(r, near)}
            if out["mode"] != "skipped" and any(min(b, r["end"]) - max(a, r["start"]) > most_shared * second for a, b in kept):
                out |= {"mode": "skipped", "reason": "overlap", "start": None, "end": None, "coverage": None}
            said, plan = "", letters(out["text"])
            if out["mode"] != "skipped":
                kept.append((r["start"], r["end"]))
                said = "".join(letters(c["w"]) for c in near if c["e"] > out["start"] + 1e-6 and c["s"] < out["end"] - 1e-6)
            like = difflib.SequenceMatcher(None, plan, said).ratio() if plan and said else 0.0
            yield {**out, "said": said, "similarity": round(like, 3), "word_coverage": round(len(said) / len(plan), 3) if plan else 0.0}

    return ordered_fold(rows, [job], [order], step, SCHEMA)


def probe(aligned: DataFrame, issues: DataFrame, *, job: str = "job", least: float = 0.5) -> DataFrame:
    """PIPE9: aligned picks with clean: placed, without an issue (job, id, code), and with at least so many of the planned letters said. issues: their codes in order."""
    codes = issues.groupBy(job, "id").agg(F.array_sort(F.collect_set("code")).alias("issues"))
    out = aligned.join(codes, [job, "id"], "left").withColumn("issues", F.coalesce("issues", F.array().cast("array<string>")))
    return out.withColumn("clean", (F.col("mode") != "skipped") & (F.size("issues") == 0) & (F.col("word_coverage") >= least))
