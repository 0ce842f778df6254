"""Token ids in a binary format of fixed bit width.

A block is one byte string:

    bytes 0-3    b"CLTB"
    bytes 4-7    version (1), bits of an id: two little-endian unsigned 16-bit numbers
    bytes 8-15   documents, as unsigned 64-bit
    bytes 16-23  ids, as unsigned 64-bit
    then         for each document, and one more: the ids before it in the block, as unsigned 64-bit
    then         the ids, each in the same number of bits, least bit first, end to end, padded to whole bytes and 8 more

As the width is fixed, the id at any place is read without those before it. A table of blocks in ascending order is
written through Spark's own writer, so it goes to any store and survives lost executors; the documents' names stand in a
column beside the bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_dir, sub_batches
from .tokens import WordTokenizer

_HEAD = struct.Struct("<4sHHQQ")


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """Ids in bits each, and 8 bytes of padding. An id of more bits is an error."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit in {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes() + bytes(8)
    out = []
    step = 1 << 16  # ends on a whole byte at any width
    for k in range(0, len(ids), step):
        part = ids[k : k + step].astype("<u4")
        each = np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
        out.append(np.packbits(each.ravel(), bitorder="little").tobytes())
    return b"".join(out) + bytes(8)


def unpack_ids(packed: np.ndarray, bits: int, first: int, count: int) -> np.ndarray:
    """count ids from the one numbered first, out of what pack_ids made (as bytes in an array)."""
    if bits in (8, 16, 32):
        return packed[first * bits // 8 : (first + count) * bits // 8].view(f"<u{bits // 8}").astype(np.uint32)
    at = (first + np.arange(count, dtype=np.int64)) * bits
    value = np.zeros(count, np.uint64)
    for k in range(5):
        value |= packed[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((value >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def write_block(ids: np.ndarray, offsets: np.ndarray, bits: int) -> bytes:
    """Ids end to end and the documents' offsets in them, as a block."""
    return _HEAD.pack(b"CLTB", 1, bits, len(offsets) - 1, len(ids)) + offsets.astype("<u8").tobytes() + pack_ids(ids, bits)


def read_block(block: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """(bits, offsets, packed ids) of a block, without a copy."""
    mark, version, bits, documents, ids = _HEAD.unpack_from(block)
    if mark != b"CLTB" or version != 1:
        raise ValueError("not a block of packed ids")
    data = np.frombuffer(block, np.uint8)
    at = _HEAD.size + 8 * (documents + 1)
    if len(data) != at + -(-ids * bits // 8) + 8:
        raise ValueError("a block of packed ids is cut short")
    return bits, data[_HEAD.size : at].view("<u8").astype(np.int64), data[at:]


def read_document(block: bytes, k: int) -> np.ndarray:
    """The ids of the k-th document of a block."""
    bits, offsets, packed = read_block(block)
    return unpack_ids(packed, bits, int(offsets[k]), int(offsets[k + 1] - offsets[k]))


def _encode_batches(path: str, end_id: int | None, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.of(path)
        block, was = 0, None
        for batch in sub_batches(batches, 2, 8 << 20):  # a word is looked up once in each
            ids, at = tokenizer.encode(batch.column(2))
            if end_id is not None:
                ids = np.insert(ids, at[1:], np.uint32(end_id))
                at = at + np.arange(len(at))
            buckets = np.asarray(batch.column(0))
            edges = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                block = block + 1 if was == buckets[lo] else 0
                was = buckets[lo]
                names = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), batch.column(1).slice(lo, hi - lo))
                data = write_block(ids[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], bits)
                yield pa.RecordBatch.from_arrays([pa.array([was], pa.int32()), pa.array([block], pa.int32()), pa.array([at[hi] - at[lo]], pa.int64()), names, pa.array([data], pa.binary())], ["bucket", "block", "n_ids", "ids_of", "data"])

    return run


def vocabulary_of(tokenizer_path: str, end_id: int | None = None) -> int:
    """One more than the largest id that the tokenizer file and the end id can give."""
    whole = WordTokenizer.of(tokenizer_path).whole
    return max([*whole.get_vocab(with_added_tokens=True).values(), -1 if end_id is None else end_id]) + 1


def write_token_blocks(docs: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, vocabulary: int | None = None, buckets: int | None = None) -> None:
    """Write the ids of all documents to path, in ascending order of id_col, nulls first.

    Documents are dealt to buckets by range, equal ids by a hash of their text, so neither a hot id nor null ids meet in one
    task. There are as many buckets as shuffle partitions, or as the table has scan partitions if those are more. Null and
    empty texts have the end id alone. Repeated rows are written one by one. vocabulary: ids are below it; that of the
    tokenizer file if None.
    """
    spark = docs.sparkSession
    bits = bits_for(vocabulary_of(tokenizer_path, end_id) if vocabulary is None else vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    n = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs._jdf.queryExecution().toRdd().getNumPartitions())
    order = [F.col("id").asc_nulls_first(), F.col("tie")]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("bucket"), "id", "text")
    blocks = dealt.mapInArrow(_encode_batches(tokenizer_path, end_id, bits), f"bucket int, block int, n_ids long, ids_of array<{kind}>, data binary")
    blocks.write.option("compression", "zstd").parquet(path)


def _decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bucket, block, names, data in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3), strict=True):
            bits, offsets, packed = read_block(data.as_buffer())
            n = len(offsets) - 1
            crc = []
            ids, base = np.zeros(0, np.uint32), 0
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if hi - base > len(ids):  # unpack about a million ids at a time
                    base, more = lo, max(hi - lo, min(1 << 20, int(offsets[-1]) - lo))
                    ids = unpack_ids(packed, bits, base, more)
                crc.append(zlib.crc32(ids[lo - base : hi - base]))
            yield pa.RecordBatch.from_arrays([names.values, pa.array([bucket.as_py()] * n, pa.int32()), pa.array([block.as_py()] * n, pa.int32()), pa.array(offsets[:-1]), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], ["id", "bucket", "block", "at", "n_tokens", "ids_crc32"])


def token_places(spark, path: str) -> DataFrame:
    """(id, file, bucket, block, place): where each document's ids lie, without reading them."""
    return spark.read.parquet(path).select(F.input_file_name().alias("file"), "bucket", "block", F.posexplode("ids_of").alias("place", "id")).select("id", "file", "bucket", "block", "place")


def read_tokens(spark, path: str, wanted: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, ids) of the documents named in wanted: each is unpacked at its place, the rest of its block is not."""
    own = token_places(spark, path).join(wanted.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    kind = own.schema["id"].dataType.simpleString()
    places = own.groupBy("bucket", "block").agg(F.collect_list(F.struct("place", "id")).alias("p"))
    held = spark.read.parquet(path).select("bucket", "block", "data").join(places, ["bucket", "block"])
    return held.select(F.transform("p", lambda x: x["id"]).alias("names"), F.transform("p", lambda x: x["place"]).alias("places"), "data").mapInArrow(_place_batches, f"id {kind}, ids array<int>")


def _place_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for names, places, data in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            block = data.as_buffer()
            yield pa.RecordBatch.from_arrays([names.values, pa.array([read_document(block, k).astype(np.int32) for k in places.as_py()], pa.list_(pa.int32()))], ["id", "ids"])


def read_token_index(spark, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the files: start counts the ids of all documents before it."""
    blocks = spark.read.parquet(path)
    kind = blocks.schema["ids_of"].dataType.elementType.simpleString()
    docs = blocks.select("bucket", "block", "ids_of", "data").mapInArrow(_decode_batches, f"id {kind}, bucket int, block int, at long, n_tokens long, ids_crc32 long")
    sizes = blocks.groupBy("bucket", "block").agg(F.sum("n_ids").alias("n"))
    inside = Window.partitionBy("bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    totals = blocks.groupBy("bucket").agg(F.sum("n_ids").alias("n"))  # as many rows as buckets
    before = totals.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    starts = sizes.join(before, "bucket").select("bucket", "block", (F.col("before") + F.col("inside")).alias("base"))
    return docs.join(starts, ["bucket", "block"]).select("id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, vocabulary: int | None = None) -> DataFrame:
    """Write all documents' ids to files in the shared folder and describe each document from what is read back.

    One row per input row: (id_col, start, n_tokens, ids_crc32). Null and empty texts have the end id alone; null ids come
    first; repeated rows each have their own place. Ids keep their type. An empty table gives none. Other columns are
    ignored.
    """
    import uuid

    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"
    write_token_blocks(docs, path, tokenizer_path, id_col=id_col, text_col=text_col, end_id=end_id, vocabulary=vocabulary)
    return read_token_index(spark, path).withColumnRenamed("id", id_col)
