"""PCM audio in WAV files as samples and levels."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

LEVELS = "path string, frame long, level double"


def _levels(frame_ms: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with wave.open(io.BytesIO(content)) as w:
                    if w.getsampwidth() != 2:
                        raise ValueError(f"not 16-bit samples: {path}")
                    step = max(1, w.getframerate() * frame_ms // 1000)
                    at = 0
                    while data := w.readframes(step * 4096):  # a bounded stretch at a time
                        x = np.frombuffer(data, "<i2").reshape(-1, w.getnchannels())[:, 0].astype(np.float64)
                        n = len(x) // step
                        if n:
                            level = np.sqrt((x[: n * step].reshape(n, step) ** 2).mean(axis=1))
                            yield pd.DataFrame({"path": path, "frame": np.arange(at, at + n), "level": level})
                            at += n

    return run


def read_levels(spark: SparkSession, paths: str | list[str], frame_ms: int = 20) -> DataFrame:
    """SRC16, WIN15: (path, frame, level): root mean square of each frame of 16-bit samples, first channel."""
    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(_levels(frame_ms), LEVELS)
