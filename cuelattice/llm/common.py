"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: The ASCII white space that parts words: [\x20\x09-\x0D].
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library keeps what it likes
    _LIBC = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where that is unset (tests on one machine)."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        held = sc._jsc.sc().getCheckpointDir()
        path = held.get() if held.isDefined() else None
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="cuelattice-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema or df.schema).parquet(path)
    out._written = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the tables that materialize wrote for these frames; no frame that is read later may depend on them."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for what is written inside: rows of two whole sets are wide."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and the rows' offsets in them; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_ranges(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most limit bytes together; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def sub_batches(batches: Iterator[pa.RecordBatch], text_index: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the text in each stays near limit bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(text_index))
        for lo, hi in row_ranges(offsets, limit):
            yield batch.slice(lo, hi - lo)
        release_memory()


def release_memory() -> None:
    """Give what a worker has freed back to the system: workers stay alive between stages."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def salted_rank(df: DataFrame, group: list[str], order: list[str], salt: Column, out: str) -> DataFrame:
    """Gapless rank from 0 within group, dealt over salts, so that no group has to meet in one task.

    Groups are not null. Rows go by (salt, order). The counts by group and salt are small; their running sums give each salt its offset.
    """
    rows = df.withColumn("_salt", salt)
    counts = rows.groupBy(*group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = Window.partitionBy(*group, "_salt").orderBy(*order)
    ranked = rows.withColumn("_own", F.row_number().over(own) - 1)
    same = None
    left, right = ranked.alias("r"), offsets.alias("o")
    for c in [*group, "_salt"]:
        one = F.col(f"r.{c}") == F.col(f"o.{c}")
        same = one if same is None else same & one
    return left.join(right, same).select("r.*", F.col("o._before").alias("_before")).withColumn(out, (F.col("_own") + F.col("_before")).cast("long")).drop("_own", "_before", "_salt")


def salts_for(rows: int, groups: int, per_salt: int = 200_000) -> int:
    """How many salts keep the rows of a salt near per_salt even if one group has all rows."""
    return max(16, -(-rows // per_salt))
