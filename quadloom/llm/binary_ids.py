"""Token ids in bit-packed files: each id takes the bits that the vocabulary's largest id needs.

The format is a Parquet table of blocks, so that Spark's committer deals with lost tasks. A block holds whole
documents, in ascending doc_id over all shards: `doc_ids`, `lengths` (ids of each), `packed` (ids of `width`
bits, lowest bit first, back to back) and `block_start` (ids of the shard before it), by which any document's
ids are found without unpacking others. Null texts count as empty, null doc_ids come first, repeated rows
each have their place (one after the other, in any order), an empty table gives an empty file set. Extra columns of any name take no part; a
document of any length is in one block.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadloom.llm.common import id_cache, shared_folder, texts

BLOCK_IDS = 1 << 18

_BLOCKS = "shard int, block int, block_start long, n_ids long, width int, doc_ids array<long>, lengths array<long>, packed binary"


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Each id in width bits, lowest first."""
    if width == 16:
        return ids.astype("<u2").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)).astype(np.uint8) & 1
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack_bits(packed: bytes, width: int, start: int, n: int) -> np.ndarray:
    """n ids from the start-th on; reads only their own bytes."""
    if width == 16:
        return np.frombuffer(packed, "<u2", n, 2 * start).astype("<u4")
    first, last = start * width // 8, -(-(start + n) * width // 8)
    bits = np.unpackbits(np.frombuffer(packed, np.uint8, last - first, first), bitorder="little")
    bits = bits[start * width - first * 8 :][: n * width].reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


def _pack(path: str, end_id: int, width: int, block_ids: int):
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("block_start", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("packed", pa.binary())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, shard = id_cache(path, True), TaskContext.get().partitionId()
        doc_ids, lengths, held, n, number, start = [], [], [], 0, 0, 0

        def block():
            ids = np.frombuffer(b"".join(held), "<u4")
            return pa.record_batch([pa.array([x], t) for x, t in zip((shard, number, start, n, width, doc_ids, lengths, pack_bits(ids, width)), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, own in zip(batch.column(0).to_pylist(), cache.of(batch.column(1)), strict=True):
                ids = own + end
                doc_ids.append(doc_id)
                lengths.append(len(ids) // 4)
                held.append(ids)
                n += len(ids) // 4
                if n >= block_ids:
                    yield block()
                    start += n
                    doc_ids, lengths, held, n, number = [], [], [], 0, number + 1
        if held:
            yield block()

    return run


def write_ids(documents: DataFrame, tokenizer_path: str, at: str, *, end_id: int = 0, block_ids: int = BLOCK_IDS) -> None:
    """Writes each document's ids and end_id to bit-packed files under the folder `at`, in ascending doc_id order over the shards."""
    from tokenizers import Tokenizer

    width = max(1, (Tokenizer.from_file(tokenizer_path).get_vocab_size() - 1).bit_length())
    docs = texts(documents)
    ordered = docs.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(_pack(tokenizer_path, end_id, width, block_ids), _BLOCKS).write.option("compression", "zstd").parquet(at)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, block_start, width, doc_ids, lengths, packed in zip(*(batch.column(i) for i in range(6)), strict=True):
            doc_ids, lengths, packed = doc_ids.as_py(), lengths.as_py(), packed.as_py()
            ids = unpack_bits(packed, width.as_py(), 0, sum(lengths))
            ends = np.cumsum(lengths)
            starts = ends - lengths
            crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.record_batch([pa.array([shard.as_py()] * len(crcs), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(starts + block_start.as_py(), pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_ids(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of each document, from the files alone."""
    files = spark.read.schema(_BLOCKS).parquet(at)
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # One row for each shard, that is for each task that wrote: bounded by the number of partitions.
    starts = totals.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("shard_start"))
    docs = files.select("shard", "block_start", "width", "doc_ids", "lengths", "packed").mapInArrow(_read, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(starts), "shard").select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def document_ids(spark: SparkSession, at: str, doc_id: int) -> list[int]:
    """One document's ids, by random access: its block is found by Spark, only its own bits are unpacked."""
    row = spark.read.schema(_BLOCKS).parquet(at).where(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).first()
    if row is None:
        raise KeyError(doc_id)
    k = row.doc_ids.index(doc_id)
    return unpack_bits(bytes(row.packed), row.width, sum(row.lengths[:k]), row.lengths[k]).tolist()


def binary_ids(documents: DataFrame, tokenizer_path: str, at: str | None = None, **options) -> DataFrame:
    """Writes the files (to a folder of its own in the shared one unless `at` is given), then reads them back."""
    spark = documents.sparkSession
    at = at or f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(documents, tokenizer_path, at, **options)
    return read_ids(spark, at)
