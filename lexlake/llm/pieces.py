"""SentencePiece encoding and decoding by a distinct-chunk table.

No piece of the model holds a whitespace marker after another character, so
BPE never merges across the start of a marked word. A text is cut before each
run of spaces; every distinct chunk is segmented once for each table and its
ids are joined back by position. The table lives in the Python worker (bounded,
kept between its tasks): joining on a table of the whole corpus would shuffle
each word of each document, several times the input.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from lexlake.llm.common import short_batches, with_fields

MARK = "▁"
#: Chunks held in a worker. A full table keeps what it has, which holds the
#: frequent chunks; further ones are segmented where they stand.
TABLE_CHUNKS = 400_000
_RUNS = re.compile(r" +[^ ]*|[^ ]+")


class ChunkTable(dict):
    """Chunk (with one leading space taken off) → (ids as int32 bytes, decoded text)."""

    def __init__(self, model_path: str) -> None:
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        crossing = [p for i in range(self.sp.get_piece_size()) if re.search(f"[^{MARK}]{MARK}", p := self.sp.id_to_piece(i))]
        if crossing:
            raise ValueError(f"pieces of {model_path} cross whitespace markers: {crossing[:3]}")
        self.lone_mark = self.sp.piece_to_id(MARK)

    def __missing__(self, chunk: str) -> tuple[bytes, str]:
        ids = self.sp.encode(chunk, num_threads=1) if chunk else [self.lone_mark]
        found = (array("i", ids).tobytes(), " " + self.sp.decode(ids))
        if len(self) < TABLE_CHUNKS:
            self[chunk] = found
        return found

    def chunks(self, text: str) -> list[str]:
        """The chunks of the text with the model's dummy space before it."""
        text = text.replace(MARK, " ")
        if "  " not in text and not text.startswith(" "):
            return text.split(" ")
        return [c[1:] for c in _RUNS.findall(" " + text)]

    def encode(self, text: str) -> tuple[bytes, str]:
        if not text:
            return b"", ""
        ids, decoded = zip(*map(self.__getitem__, self.chunks(text)))
        return b"".join(ids), "".join(decoded)[1:]


_TABLES: dict[str, ChunkTable] = {}


def table(model_path: str) -> ChunkTable:
    if model_path not in _TABLES:
        _TABLES[model_path] = ChunkTable(model_path)
    return _TABLES[model_path]


def encode_pieces(docs: DataFrame, model_path: str, text_col: str = "text", end_id: int | None = None) -> DataFrame:
    """Adds ``ids`` (array of int, ``end_id`` last if given) and ``decoded``.

    Exactly what the library gives for the whole text. Null text counts as
    empty, which has no ids but the end id and decodes to the empty text.
    Rows are independent: repeated rows get equal results, an empty table stays
    empty. Columns named ids or decoded are replaced.
    """
    short_batches(docs.sparkSession)
    docs = docs.drop("ids", "decoded")
    schema = with_fields(docs.schema, "ids array<int>, decoded string")
    end = b"" if end_id is None else np.array([end_id], dtype=np.int32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = table(model_path).encode
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            ids, decoded = zip(*(of(t or "") for t in texts)) if texts else ((), ())
            ids = [x + end for x in ids]
            offsets = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
            values = pa.array(np.frombuffer(b"".join(ids), dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(decoded, pa.string())],
                names=[*batch.schema.names, "ids", "decoded"],
            )

    return docs.mapInArrow(run, schema)
