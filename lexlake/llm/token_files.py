"""Token ids in bit-packed blocks, in id order, with random access.

A block holds whole documents. Its payload packs each id in the fewest bits
that the vocabulary needs, lowest bit first; ``ends`` are the documents' ends
in ids, so document k of a block is at bits ends[k-1]*width .. ends[k]*width.
Blocks lie in Parquet: Spark commits them as a whole, re-run tasks replace
their own output, and a reader takes any block by (segment, block).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexlake.llm.byte_tokens import bits_needed, table
from lexlake.llm.common import NULL_KEY, order_key, partitions, range_bounds, range_of, short_batches

#: A block is closed by the document that brings it to so many ids.
BLOCK_IDS = 65_536

BLOCKS = "segment int, block int, first long, n_ids long, width int, keys array<bigint>, ends array<bigint>, payload binary"


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids below 2**width in width bits each."""
    if width == 16:
        return ids.astype("<u2").tobytes()
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if width % 8 == 0:
        return raw[:, : width // 8].tobytes()
    bits = np.unpackbits(raw, axis=1, bitorder="little")[:, :width]
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(payload: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """Ids start .. stop-1 of a payload; only their bytes are touched."""
    lo, hi = start * width // 8, -(-stop * width // 8)
    raw = np.frombuffer(payload, dtype=np.uint8, count=hi - lo, offset=lo)
    if width % 8 == 0:
        out = np.zeros((stop - start, 4), dtype=np.uint8)
        out[:, : width // 8] = raw.reshape(-1, width // 8)
    else:
        skip = start * width - 8 * lo
        bits = np.unpackbits(raw, bitorder="little")[skip : skip + (stop - start) * width].reshape(-1, width)
        full = np.zeros((stop - start, 32), dtype=np.uint8)
        full[:, :width] = bits
        out = np.packbits(full, axis=1, bitorder="little")
    return np.ascontiguousarray(out).view("<u4").ravel()


def sent_as(vocabulary: int, end_id: int) -> np.dtype:
    """The whole numbers in which ids are shuffled."""
    return np.dtype("<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4")


def write_token_blocks(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text, ends it with ``end_id`` and writes the blocks
    of all documents in ascending id order (nulls first; equal ids in a fixed
    order). Null text is empty text: its end id alone. An empty table writes an
    empty file set. Other columns are ignored.
    """
    spark = docs.sparkSession
    short_batches(spark)
    key, n = order_key(id_col), partitions(spark)
    bounds = range_bounds(docs, key, n)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids before the shuffle, in two bytes each where the vocabulary allows it."""
        tokens = table(tokenizer_path)
        kind = sent_as(tokens.size, end_id)
        for batch in batches:
            bucket = pa.array(range_of(bounds, batch.column(0).to_numpy()).astype(np.int32))
            for lo, hi, ids, ends in tokens.encode(batch.column(1)):
                ended = np.insert(ids, ends, end_id).astype(kind)
                offsets = np.append(0, ends + np.arange(1, len(ends) + 1)) * kind.itemsize
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ended)])
                yield pa.record_batch([bucket.slice(lo, hi - lo), batch.column(0).slice(lo, hi - lo), packed.cast(pa.binary())], names=["segment", "k", "ids"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = table(tokenizer_path).size
        kind, width = sent_as(size, end_id), bits_needed(max(end_id + 1, size))
        schema = pa.schema(
            [("segment", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32())]
            + [("keys", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("payload", pa.binary())]
        )
        segment, block, first, keys, ends, held = None, 0, 0, [], [], []

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype=kind)
            row = (segment, block, first, ends[-1], width, keys, ends, pack(ids, width))
            return pa.record_batch([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for seg, k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)):
                if seg != segment:
                    if keys:
                        yield close()
                    segment, block, first, keys, ends, held = seg, 0, 0, [], [], []
                held.append(ids)
                keys.append(k)
                ends.append((ends[-1] if ends else 0) + len(ids) // kind.itemsize)
                if ends[-1] >= BLOCK_IDS:
                    yield close()
                    block, first, keys, ends, held = block + 1, first + ends[-1], [], [], []
        if keys:
            yield close()

    sent = docs.select(key.alias("k"), text_col).mapInArrow(encode, "segment int, k long, ids binary")
    sorted_ = sent.repartitionById(n, "segment").sortWithinPartitions("segment", "k", "ids")
    sorted_.mapInArrow(blocks, BLOCKS).write.option("compression", "zstd").parquet(path)


def read_token_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with ``start``: the ids of all blocks before, from the totals of
    the segments (one row each)."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals = blocks.groupBy("segment").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("segment", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return blocks.join(F.broadcast(offsets), "segment").withColumn("start", F.col("offset") + F.col("first")).drop("offset", "first")


def map_documents(spark: SparkSession, path: str, per_block: Callable, schema: str) -> DataFrame:
    """``per_block(doc ids, starts, ends, ids)`` → columns of ``schema``, for
    each block: ``ids`` are the block's, ``ends`` the documents' ends in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, ends, payload, width, start in zip(*(c.to_pylist() for c in batch.columns)):
                ids = unpack(payload, width, 0, ends[-1])
                starts = [start + e for e in (0, *ends[:-1])]
                yield per_block([None if k == NULL_KEY else k for k in keys], starts, ends, ids)

    return read_token_blocks(spark, path).select("keys", "ends", "payload", "width", "start").mapInArrow(run, schema)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids (array of int) of every document in the files."""

    def arrays(keys: list, starts: list, ends: list, ids: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(ids.astype(np.int32)))
        return pa.record_batch([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), lists], names=["doc_id", "start", "ids"])

    return map_documents(spark, path, arrays, "doc_id long, start long, ids array<int>")


def read_block(spark: SparkSession, path: str, segment: int, block: int) -> DataFrame:
    """One block; the reader skips row groups by the segment and block statistics."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    return blocks.where((F.col("segment") == segment) & (F.col("block") == block))
