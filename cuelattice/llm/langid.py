"""Language identification as inference of a mixture of languages.

A word's likelihood under a language is that of its letter trigrams. Expectation maximisation estimates the share of each
language in a document from its words' likelihoods. From all learned languages the weakest leaves and the shares of the
others are estimated again, down to one; of these sets the one of highest likelihood less a penalty for each language is
chosen. The posterior is relative to the learned languages; that a text is in none of them shows in the share of its
trigrams that no learned language has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sub_batches, text_bytes

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: Bytes as features see them: letters in lower case and all bytes of other scripts as they are, anything else a gap.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigram_codes(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, word starts, words before each row) of the trigrams around each byte of each word, gaps at its ends.

    codes has one entry for each byte of a word; word starts index it.
    """
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    # A gap stands between rows, so no trigram crosses them.
    room = np.full(len(data) + len(offsets) + 1, 32, np.uint8)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    room[np.arange(len(data)) + row + 1] = _FOLD[data]
    # Lower case of two-byte Latin letters: U+00C0-U+00DE.
    second = np.flatnonzero((room[:-1] == 0xC3) & (room[1:] >= 0x80) & (room[1:] <= 0x9E)) + 1
    room[second] += 0x20
    inside = np.flatnonzero(room != 32)
    wide = room.astype(np.uint32)
    codes = (wide[inside - 1] << np.uint32(16)) | (wide[inside] << np.uint32(8)) | wide[inside + 1]
    codes = ((codes * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int32)
    starts = np.flatnonzero(room[inside - 1] == 32)
    at = offsets + np.arange(len(offsets)) + 1  # where rows begin in room
    return codes, starts, np.searchsorted(inside[starts], at)


def _count_batches(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in sub_batches(batches, 1, 1 << 20):
            codes, starts, rows = trigram_codes(*text_bytes(batch.column(1)), bits)
            edges = np.append(starts, len(codes))[rows]
            langs = np.repeat(np.arange(len(batch)), np.diff(edges))
            names = batch.column(0).to_pylist()
            for name in set(names):
                mine = np.array([x == name for x in names])[langs] if len(langs) else np.zeros(0, bool)
                held[name] = held.get(name, 0) + np.bincount(codes[mine], minlength=1 << bits)
        for name, counts in held.items():
            full = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(full), pa.string()), pa.array(full.astype(np.int32)), pa.array(counts[full].astype(np.int64))], ["lang", "code", "n"])

    return run


class LanguageModel:
    """Log likelihoods of hashed trigrams by language: names, an array of languages by codes, and the codes that any language has."""

    def __init__(self, names: list[str], table: np.ndarray, bits: int, seen: np.ndarray):
        self.names, self.table, self.bits, self.seen = names, table, bits, seen


def fit(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", key: Column, rows_per_language: int = 10_000, bits: int = 16) -> LanguageModel:
    """Fit on a bounded sample: about rows_per_language rows of each language, by a hash of key.

    Rows of null text or language are not used. The model's size depends on bits and the number of languages alone; counts
    are summed by language and code before they come to the driver, so at most 2 ** bits rows a language do.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(key), F.lit(1_000_000)).alias("h")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    names = sorted(sizes)
    if not names:
        return LanguageModel([], np.zeros((0, 1 << bits), np.float32), bits, np.zeros(1 << bits, bool))
    share = F.create_map(*[x for k in names for x in (F.lit(k), F.lit(int(1_000_000 * min(1.0, rows_per_language / sizes[k]))))])
    sample = rows.where(F.col("h") < share[F.col("lang")]).select("lang", "text")
    counts = np.zeros((len(names), 1 << bits))
    at = {name: k for k, name in enumerate(names)}
    for r in sample.mapInArrow(_count_batches(bits), "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[at[r["lang"]], r["code"]] = r["n"]
    seen = max(1, int((counts.sum(0) > 0).sum()))
    table = np.log((counts + 0.1) / (counts.sum(1, keepdims=True) + 0.1 * seen * 2))
    return LanguageModel(names, table.astype(np.float32), bits, counts.sum(0) > 0)


def _shares(p: np.ndarray, row: np.ndarray, edges: np.ndarray, theta: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM: (shares, log likelihood) of each row, from words' likelihoods p (languages by words)."""
    sizes = np.maximum(1, np.diff(edges))
    full = np.flatnonzero(np.diff(edges))
    like = np.zeros(theta.shape[1])
    for k in range(rounds + 1):
        joint = p * theta[:, row]
        total = np.maximum(joint.sum(0), 1e-30)
        if k == rounds:
            if len(full):
                like[full] = np.add.reduceat(np.log(total), edges[:-1][full])
            return theta, like
        joint /= total
        theta = theta.copy()
        if len(full):
            theta[:, full] = np.add.reduceat(joint, edges[:-1][full], axis=1) / sizes[full]
    raise AssertionError


def infer(model: LanguageModel, col: pa.Array, *, rounds: int = 6, penalty: float = 3.0, floor: float = 1e-3) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(language, its share, number of languages, share of unseen trigrams) of each row; UNKNOWN for rows without letters."""
    data, offsets = text_bytes(col)
    n, k = len(col), len(model.names)
    codes, starts, edges = trigram_codes(data, offsets, model.bits)
    sizes = np.diff(edges)
    pred, score, count = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
    if k and len(starts):
        words = np.stack([np.add.reduceat(model.table[j][codes], starts) for j in range(k)])
        words -= words.max(0)
        p = np.maximum(np.exp(words), floor)
        del words
        row = np.repeat(np.arange(n), sizes)
        keep = np.ones((k, n), bool)
        own, best = np.full((k, n), 1.0 / k), np.full(n, -np.inf)
        for m in range(k, 0, -1):
            own, like = _shares(p, row, edges, own, (rounds if m == k else 2) if m > 1 else 0)
            value = like - penalty * m * np.log(np.maximum(2, sizes)) / 2
            better = value >= best  # of equal values the smaller set
            best = np.where(better, value, best)
            count = np.where(better, m, count)
            pred = np.where(better, own.argmax(0), pred)
            score = np.where(better, own.max(0), score)
            # The weakest language leaves; the last of equal ones.
            weakest = k - 1 - np.where(keep, own, np.inf)[::-1].argmin(0)
            keep[weakest, np.arange(n)] = False
            own = np.where(keep, np.maximum(own, 1e-6), 0.0)
            own /= np.maximum(own.sum(0), 1e-30)
        # A single language's share is 1 by construction; the score tells how sure the words are of it.
        sure = np.add.reduceat(p[pred[row], np.arange(len(row))] / p.sum(0), edges[:-1][sizes > 0])
        each = np.zeros(n)
        each[sizes > 0] = sure / sizes[sizes > 0]
        score = score * each
    at = np.append(starts, len(codes))[edges]
    strange = np.concatenate(([0], np.cumsum(~model.seen[codes], dtype=np.int64)))
    unseen = (strange[at[1:]] - strange[at[:-1]]) / np.maximum(1, np.diff(at))
    out = []
    ascii_letter = np.zeros(n, bool)
    if len(data):
        letters = np.searchsorted(np.flatnonzero((_FOLD[data] != 32) & (data < 128)), offsets)
        ascii_letter = letters[1:] > letters[:-1]
    for r in range(n):
        known = ascii_letter[r]
        if not known and offsets[r + 1] > offsets[r]:
            known = _LETTER.search(col[r].as_py()) is not None
        out.append(model.names[pred[r]] if known and k else UNKNOWN)
    und = np.array([x == UNKNOWN for x in out], bool)
    return out, np.where(und, 0.0, np.clip(score, 0.0, 1.0)), np.where(und, 0, count), np.where(und, 1.0, unseen)


def _predict_batches(model: LanguageModel, options: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, 0, 1 << 20):
            text = batch.column(0)
            lang, score, count, unseen = infer(model, text.fill_null("") if text.null_count else text, **options)
            own = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(count, pa.int32()), pa.array(unseen, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *own], [*batch.schema.names[1:], *NEW])

    return run


def _keep_batches(model: LanguageModel, most_unseen: float, least_score: float, options: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, 0, 1 << 20):
            text = batch.column(0)
            lang, score, _, unseen = infer(model, text.fill_null("") if text.null_count else text, **options)
            keep = np.array([x != UNKNOWN for x in lang], bool) & (unseen <= most_unseen) & (score >= least_score)
            yield pa.RecordBatch.from_arrays(batch.columns[1:], batch.schema.names[1:]).filter(pa.array(keep))

    return run


NEW = ("lang_pred", "score", "n_languages", "unseen")


def _source(docs: DataFrame, names: list[str], text_col: str) -> tuple[DataFrame, str]:
    """The text and the named columns under names of our own, and the schema of the latter."""
    rows = docs.select(F.col(text_col).cast("string").alias("_"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(names)])
    return rows, ", ".join(f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(names))


def identify(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", keep: list[str] | None = None, **options) -> DataFrame:
    """The kept columns of docs (all by default) with lang_pred, score, n_languages and unseen.

    lang_pred is a learned language, or `und` for null texts and texts without letters (score 0, unseen 1); unseen is the
    share of the text's trigrams that no learned language has. Of languages that are equally likely the first by name is
    predicted. Rows are answered one by one; columns of docs named like the new ones are dropped. An empty table gives none.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in NEW]
    source, schema = _source(docs, names, text_col)
    own = "lang_pred string, score double, n_languages int, unseen double"
    out = source.mapInArrow(_predict_batches(model, options), f"{schema}, {own}" if schema else own)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], *NEW)


def keep_known(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", most_unseen: float = 0.3, least_score: float = 0.0, **options) -> DataFrame:
    """The rows of docs in a learned language, with their columns as they are, whatever their names.

    Null texts and texts without letters go, and texts of which more than most_unseen of the trigrams are in no learned
    language: another language or script, or no language at all. Texts that mix learned languages stay.
    """
    source, schema = _source(docs, docs.columns, text_col)
    out = source.mapInArrow(_keep_batches(model, most_unseen, least_score, options), schema)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])


def training_fold(key: Column, folds: int = 3, held_out: int = 1) -> Column:
    """Whether a row is held out: crc32 of its key as text modulo folds. A null key is not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == held_out, F.lit(False))
