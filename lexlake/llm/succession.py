"""Each document with the next one in id order, without a global sort task.

Documents go to ranges of the id. The first document of each range is also
sent, as a ghost, to the range before, and the first of all to the last range,
so every row meets its successor in its own sorted partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from lexlake.llm.common import NULL_KEY, order_key, partitions, range_bounds, range_of, range_starts, short_batches

_LAST = 2**63 - 1


def with_next(docs: DataFrame, pair: Callable, schema: str, id_col: str, text_col: str, make: Callable[[], Callable[[str], str]]) -> DataFrame:
    """``pair(of, id, text, mark, next text, next mark)`` → one tuple of ``schema`` for each row.

    ``make()`` gives, once a task, the function ``of`` that marks a text. Texts are shuffled compressed. Null ids come first and come back as
    null; rows with equal ids follow each other in a fixed order; null text is empty text. A
    table of one row is followed by itself; an empty table gives no rows.
    """
    spark = docs.sparkSession
    short_batches(spark)
    target = _arrow_schema(schema)
    key, n = order_key(id_col), partitions(spark)
    bounds = range_bounds(docs, key, n)
    starts = range_starts(docs, key, bounds)
    filled = sorted(starts)
    before = {starts[b]: filled[i - 1] for i, b in enumerate(filled)}  # of the first: the last
    head = starts[filled[0]] if filled else None

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, press = make(), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            keys = batch.column(0).to_numpy()
            texts = [t or "" for t in batch.column(1).to_numpy(zero_copy_only=False)]
            marks = [of(t) for t in texts]
            packed = [press.compress(t.encode()) for t in texts]
            bucket = range_of(bounds, keys).tolist()
            order, ghost = keys.tolist(), [False] * len(keys)
            for i, k in enumerate(keys.tolist()):
                if k in before:
                    order.append(_LAST if k == head else k)
                    ghost.append(True)
                    bucket.append(before[k])
                    marks.append(marks[i])
                    packed.append(packed[i])
            yield pa.record_batch(
                [pa.array(bucket, pa.int32()), pa.array(order, pa.int64()), pa.array(ghost), pa.array(marks, pa.string()), pa.array(packed, pa.binary())],
                names=["bucket", "k", "ghost", "mark", "packed"],
            )

    def succeed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, unpack = make(), zstandard.ZstdDecompressor().decompress
        held = None
        for batch in batches:
            out = []
            for bucket, k, ghost, mark_, packed in zip(*(c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns)):
                text = unpack(packed).decode() if packed else ""
                if held is not None and held[0] == bucket:
                    out.append(pair(of, None if held[1] == NULL_KEY else held[1], held[2], held[3], text, mark_))
                held = None if ghost else (bucket, k, text, mark_)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(target), target)], schema=target)

    sent = docs.select(key.alias("k"), text_col).mapInArrow(mark, "bucket int, k long, ghost boolean, mark string, packed binary")
    sorted_ = sent.repartitionById(n, "bucket").sortWithinPartitions("bucket", "k", "ghost", "packed")
    return sorted_.mapInArrow(succeed, schema)


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))
