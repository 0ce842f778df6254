"""Media columns: WAV bytes in a column, stored as Parquet, and fingerprints of spectral peak pairs as time-coded arrays."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, sub_batches, text_bytes

FRAME, HOP, BLOCK = 256, 128, 64
_HANN = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)).astype(np.float32)


def wav_bytes(payload: bytes, rate: int = 8000) -> bytes:
    """One channel of unsigned 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def wav_samples(media: bytes) -> bytes:
    """The samples of such a file; any other kind of file is an error."""
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not one channel of 8-bit samples")
        return w.readframes(w.getnframes())


def peak_pairs(samples: list[np.ndarray], most_frames: int = 1 << 12) -> list[tuple[np.ndarray, np.ndarray]]:
    """(codes, times) of each row of 8-bit samples.

    Frames of 256 samples step by 128, the last padded with silence. A frame's two strongest local maxima are its peaks;
    each is paired with the strongest peak of the next frame and of the one after. A code holds both bins and the step
    between them, its time is the first frame.
    """
    frames = [1 + -(-max(0, len(s) - FRAME) // HOP) for s in samples]
    first = np.concatenate(([0], np.cumsum(frames)))
    bins = np.zeros((int(first[-1]), 2), np.int32)

    def spectra(rows: list[np.ndarray], at: int) -> None:
        block = np.concatenate(rows)
        size = np.abs(np.fft.rfft(block * _HANN, axis=1)).astype(np.float32)
        inner = size[:, 1:-1]
        peak = np.where((inner > size[:, :-2]) & (inner >= size[:, 2:]) & (inner > 1e-3), inner, 0)
        one = peak.argmax(1)
        some = np.take_along_axis(peak, one[:, None], 1)[:, 0] > 0
        np.put_along_axis(peak, one[:, None], 0, 1)
        two = peak.argmax(1)
        more = np.take_along_axis(peak, two[:, None], 1)[:, 0] > 0
        bins[at : at + len(block), 0] = np.where(some, one + 1, 0)
        bins[at : at + len(block), 1] = np.where(more, two + 1, 0)

    waiting, n, at = [], 0, 0
    for s, k in zip(samples, frames, strict=True):
        whole = np.zeros(FRAME + HOP * (k - 1), np.float32)
        whole[: len(s)] = (s.astype(np.float32) - 128) / 128
        view = np.lib.stride_tricks.sliding_window_view(whole, FRAME)[::HOP]
        for lo in range(0, k, most_frames):
            part = view[lo : lo + most_frames]
            if n and n + len(part) > most_frames:
                spectra(waiting, at)
                at, waiting, n = at + n, [], 0
            waiting.append(part)
            n += len(part)
    if n:
        spectra(waiting, at)
    row = np.repeat(np.arange(len(samples)), frames)
    codes, times, rows = [], [], []
    for step in (1, 2):
        if len(bins) <= step:
            continue
        same = row[step:] == row[:-step]
        for k in (0, 1):
            a, b = bins[:-step, k], bins[step:, 0]
            ok = np.flatnonzero(same & (a > 0) & (b > 0))
            codes.append((a[ok] << 10) | (b[ok] << 2) | step)
            times.append(ok - first[row[ok]])
            rows.append(row[ok])
    if not codes:
        return [(np.zeros(0, np.int32), np.zeros(0, np.int32)) for _ in samples]
    code, time, own = np.concatenate(codes).astype(np.int32), np.concatenate(times).astype(np.int32), np.concatenate(rows)
    order = np.lexsort((code, time, own))
    code, time = code[order], time[order]
    cut = np.searchsorted(own[order], np.arange(len(samples) + 1))
    return [(code[lo:hi], time[lo:hi]) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]


def _wav_batches(rate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, 1, 2 << 20):
            data, offsets = text_bytes(batch.column(1))
            media, sizes = [], []
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                n = hi - lo
                media.append(wav_bytes(data[lo:hi].tobytes() + bytes(max(BLOCK, -(-n // BLOCK) * BLOCK) - n), rate))
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    return run


def text_to_wav(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: int = 8000) -> DataFrame:
    """(id_col, n_bytes, media): the UTF-8 bytes, zero bytes up to a positive multiple of 64, as 8-bit samples of a WAV file.

    Null counts as empty. Rows are answered one by one; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_wav_batches(rate), f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sub_batches(batches, 2, 1 << 20):
        media = batch.column(2).to_pylist()
        held = [wav_samples(x) for x in media]
        pairs = peak_pairs([np.frombuffer(x, np.uint8) for x in held])
        cut = pa.array(np.concatenate(([0], np.cumsum([len(c) for c, _ in pairs]))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cut, pa.array(np.concatenate([p[k] for p in pairs]))) for k in (0, 1)]
        own = [
            pa.array([len(x) for x in held], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in held]),
            pa.array([zlib.crc32(x[-BLOCK:]) for x in held], pa.int64()), pa.array([len(x) for x in media], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in media]), *lists,
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *own], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "codes", "times"])


def fingerprint_media(media: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """What the stored WAV files of text_to_wav hold, read back: sizes, digests, and the fingerprint (codes, times).

    One row per input row; equal files give equal values. A null file is an error.
    """
    kind = media.schema[id_col].dataType.simpleString()
    source = media.select(F.col(id_col).alias("id"), "n_bytes", "media")
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codes array<int>, times array<int>"
    return source.mapInArrow(_fingerprint_batches, schema).withColumnRenamed("id", id_col)


def store_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: int = 8000) -> DataFrame:
    """text_to_wav written to Parquet in the shared folder, and read from there: what follows sees the stored bytes alone."""
    return materialize(text_to_wav(docs, id_col=id_col, text_col=text_col, rate=rate))
