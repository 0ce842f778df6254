"""Secrets in whole texts: patterns, and windows of high entropy.

Strings of key characters are candidates. A window slides over each; its Shannon entropy follows from the counts of its
characters, which change by one arriving and one leaving, and is held against the threshold of the candidate's character
class. Windows that the allow list knows are let be.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sub_batches, text_bytes

#: Kinds of the contract and their patterns (fixed values): the span is the whole match; assign counts the length of group 2.
BASE = {
    "assign": (re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
KINDS = {k: n for n, k in enumerate((*BASE, "entropy"))}

#: Class of a candidate: its characters, the least entropy in bits of a window, what it must hold.
CLASSES = (
    ("hex", re.compile(r"[0-9A-Fa-f]+"), 3.0, (r"[0-9]", r"[A-Fa-f]")),
    ("upper", re.compile(r"[A-Z0-9]+"), 3.4, (r"[0-9]", r"[A-Z]")),
    ("lower", re.compile(r"[a-z0-9]+"), 3.4, (r"[0-9].*[0-9].*[0-9]", r"[a-z]")),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 3.7, (r"[0-9]", r"[a-z]", r"[A-Z]")),
)
ALLOWED = (r"(?i)example|sample|dummy|placeholder|changeme|xxxx|0{8}", r"(?i)0123456789|abcdefghij", r"^[a-z]+(?:[-_/][a-z]+)*[-_/]?\d{0,4}$", r"^(?:[A-Za-z]+[-_/])+\d{0,4}$")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_RUN = re.compile(r"[A-Za-z0-9]+")
_IN_KEY = np.zeros(256, bool)
_IN_KEY[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
_IN_HEX = np.zeros(256, bool)
_IN_HEX[list(b"0123456789abcdef")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True

Span = tuple[str, int, int]


def window_entropies(text: str, width: int) -> Iterator[tuple[int, float]]:
    """(start, bits) of each window; a shorter text is one window. Counts change by one character in, one out."""
    width = min(width, len(text))
    if not width:
        return
    weight = [k * math.log2(k) if k else 0.0 for k in range(width + 2)]  # one arrives before one leaves
    counts: dict[str, int] = {}
    total = 0.0
    for k, c in enumerate(text):
        n = counts.get(c, 0)
        total += weight[n + 1] - weight[n]
        counts[c] = n + 1
        if k >= width:
            old = text[k - width]
            n = counts[old]
            total += weight[n - 1] - weight[n]
            counts[old] = n - 1
        if k >= width - 1:
            yield k - width + 1, math.log2(width) - total / width


def base_spans(text: str, hexes: bool = True) -> list[Span]:
    """Matches by kind, leftmost and not overlapping; those of too few characters drop out after they matched.

    hexes: False if the text is known to hold no 16 hexadecimal characters.
    """
    out = []
    low = text.lower()
    for kind, (pattern, group, least) in BASE.items():
        if kind == "assign" and not any(w in low for w in KEYWORDS) or kind == "access" and "AKIA" not in text or kind == "hex" and not hexes:
            continue
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return out


def _judged(word: str, width: int) -> Iterator[tuple[int, str, float]]:
    """(start, part, least entropy) of what is measured in a candidate.

    A candidate of one class is measured whole. One whose separators hide its class (lower case and digits behind a prefix)
    is measured by its separator-free runs of a window or more, each under its own class.
    """
    kind = _class_of(word)
    if kind is not None:
        yield 0, word, kind
        return
    for m in _RUN.finditer(word):
        if m.end() - m.start() >= width and m.end() - m.start() < len(word) and (kind := _class_of(m.group())) is not None:
            yield m.start(), m.group(), kind


def _class_of(word: str) -> float | None:
    """The least entropy of the first class that has all characters of the word, if the word holds what that class must."""
    kind = next(((bits, needs) for _, chars, bits, needs in CLASSES if chars.fullmatch(word)), None)
    return kind[0] if kind is not None and all(re.search(x, word) for x in kind[1]) else None


def entropy_spans(text: str, *, width: int = 20, allowed: tuple[str, ...] = ALLOWED) -> list[Span]:
    """Runs of windows that are too random for their class. A window that holds a match of the allow list, or lies in one, is let be."""
    out = []
    for m in _CANDIDATE.finditer(text):
        word = m.group()
        known: list[tuple[int, int]] | None = None
        for start, part, least in _judged(word, width):
            known = [x.span() for pattern in allowed for x in re.finditer(pattern, word)] if known is None else known
            lo = hi = None
            for at, bits in window_entropies(part, width):
                end = min(at + width, len(part))
                if bits >= least and not any((start + at <= a and b <= start + end) or (a <= start + at and start + end <= b) for a, b in known):
                    if hi is not None and at > hi:
                        out.append(("entropy", m.start() + start + lo, m.start() + start + hi))
                        lo = None
                    lo = at if lo is None else lo
                    hi = end
            if lo is not None:
                out.append(("entropy", m.start() + start + lo, m.start() + start + hi))
    return out


def find_secrets(text: str, *, width: int = 20, allowed: tuple[str, ...] = ALLOWED, hexes: bool = True, keys: bool = True) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start, then kind. Entropy adds what no base span holds.

    hexes, keys: False if the text is known to hold no string of that kind.
    """
    order = lambda s: (s[1], KINDS[s[0]])
    base = sorted(base_spans(text, hexes), key=order)
    more = [s for s in (entropy_spans(text, width=width, allowed=allowed) if keys else ()) if not any(b[1] <= s[1] and s[2] <= b[2] for b in base)]
    return base, sorted(base + more, key=order)


def redact(text: str, spans: list[Span], mask: str = "[secret]") -> str:
    """The text with every span masked; spans that overlap or touch are masked together."""
    out, at = [], 0
    end = -1
    for _, lo, hi in sorted(spans, key=lambda s: (s[1], s[2])):
        if lo > end:
            out += [text[at:lo], mask]
        end = max(end, hi)
        at = end
    return "".join(out) + text[at:]


def _run_rows(inside: np.ndarray, offsets: np.ndarray, blocks: int) -> np.ndarray:
    """Rows that may hold a run of marked bytes which covers so many aligned blocks of four."""
    full = inside[: len(inside) // 4 * 4].reshape(-1, 4).all(axis=1)
    hit = np.zeros(len(offsets) - 1, bool)
    n = len(full) - blocks + 1
    if n > 0:
        runs = np.logical_and.reduce([full[k : k + n] for k in range(blocks)])
        hit[np.searchsorted(offsets, np.flatnonzero(runs) * 4, side="right") - 1] = True
    return hit


def suspects(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that may hold 16 hexadecimal characters, and rows that may hold 20 key characters and hold a digit.

    A run of 4 * k + 3 bytes covers k aligned blocks of four, wherever it begins.
    """
    data, offsets = text_bytes(col)
    digits = np.searchsorted(np.flatnonzero(_DIGIT[data]), offsets)
    return _run_rows(_IN_HEX[data], offsets, 3), _run_rows(_IN_KEY[data], offsets, 4) & (digits[1:] > digits[:-1])


def _scan_batches(width: int, allowed: tuple[str, ...], mask: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in sub_batches(batches, 1, 1 << 20):
            hexes, keys = suspects(batch.column(1))
            out: list[tuple] = []
            for text, h, k in zip(batch.column(1).to_pylist(), hexes.tolist(), keys.tolist(), strict=True):
                base, spans = find_secrets(text or "", width=width, allowed=allowed, hexes=h, keys=k)
                if not spans:
                    out.append((0, 0, 0, nothing, "", text))
                    continue
                kinds = [s[0] for s in base]
                line = ",".join(f"{k}:{lo}:{hi}" for k, lo, hi in base)
                out.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(line.encode()).hexdigest(), ",".join(f"{k}:{lo}:{hi}" for k, lo, hi in spans), redact(text, spans, mask) if mask is not None and spans else text))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 3
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            if mask is None:
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays[:5]], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
            else:
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(2, batch.num_columns)), arrays[5]], [*batch.schema.names[2:], "text"])

    return run


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 20, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """One row per input row: (id_col, n_assign, n_access, n_hex, base_sha256, spans), in code points, ends exclusive.

    spans joins kind:start:end of all spans by start, then kind (assign, access, hex, entropy); base_sha256 is of the
    first three kinds alone. Null and empty texts have none. Repeated rows and null ids are answered row by row. Other
    columns are ignored; an empty table gives none.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_scan_batches(width, allowed, None), f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def redact_secrets(docs: DataFrame, *, text_col: str = "text", mask: str = "[secret]", width: int = 20, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """docs with every secret in the text masked; all rows and columns stay, null texts stay null."""
    names = docs.columns
    rest = [c for c in names if c != text_col]
    held = [F.col(c).alias(f"c{k}") for k, c in enumerate(rest)]
    source = docs.select(F.lit(0).alias("id"), F.col(text_col).cast("string").alias("text"), *held)
    schema = "".join(f"c{k} {docs.schema[c].dataType.simpleString()}, " for k, c in enumerate(rest)) + "text string"
    out = source.mapInArrow(_scan_batches(width, allowed, mask), schema)
    return out.select(*[(F.col("text") if c == text_col else F.col(f"c{rest.index(c)}")).alias(c) for c in names])
