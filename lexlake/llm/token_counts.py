"""Token counts of sections by offset-mapped attribution.

A whole document is encoded once. Its tokens' character spans are joined with
the sections' intervals (sorted search within the document), and a token that
crosses a boundary is given to one section by an explicit rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexlake.llm.byte_tokens import Spans
from lexlake.llm.common import short_batches, with_fields

SECTIONS = "section long, first_char long, n_chars long, n_tokens long, n_crossing long"


def line_starts(text: str) -> np.ndarray:
    """A section is a line with its line feed; a text has one at least."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    starts = np.concatenate([[0], np.flatnonzero(points == 10) + 1])
    return starts[:-1] if len(starts) > 1 and starts[-1] == len(points) else starts


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and those of them that cross a boundary.

    first: the section of the token's first character. last: of its last
    character. most: the section that holds most of its characters, the earlier
    one on a tie. Each token counts once, so the counts sum to all tokens.
    """
    a = np.searchsorted(sections, starts, side="right") - 1
    b = np.searchsorted(sections, np.maximum(ends - 1, starts), side="right") - 1
    crossing, to = a != b, a.copy()
    if rule == "last":
        to = b.copy()
    elif rule == "most":
        for i in np.flatnonzero(crossing):
            cuts = np.concatenate([[starts[i]], sections[a[i] + 1 : b[i] + 1], [ends[i]]])
            to[i] = a[i] + int(np.argmax(np.diff(cuts)))
    n = len(sections)
    return np.bincount(to, minlength=n), np.bincount(to[crossing], minlength=n)


def section_token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "most") -> DataFrame:
    """One row for each line of each document: id, section (from 0), first_char,
    n_chars (with the line feed), n_tokens, n_crossing.

    Null and empty texts have one section of no characters and tokens. Null ids
    stay null; repeated rows give their rows again; an empty table gives none.
    Other columns are ignored.
    """
    short_batches(docs.sparkSession)
    schema = with_fields(docs.select(id_col).schema, SECTIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = Spans(tokenizer_path)
        for batch in batches:
            out, rows = [], []
            texts = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, ids, ends in spans.table.encode(batch.column(1)):
                for text, own in zip(texts[lo:hi], np.split(ids, ends[:-1])):
                    sections = line_starts(text or "")
                    n, crossing = attribute(*spans.of(text or "", own), sections, rule)
                    sizes = np.diff(np.append(sections, len(text or "")))
                    out.append(np.stack([np.arange(len(sections)), sections, sizes, n, crossing]))
                    rows.append(len(sections))
            if out:
                columns = np.concatenate(out, axis=1).astype(np.int64)
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(rows)), rows)))
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns)], names=[id_col, "section", "first_char", "n_chars", "n_tokens", "n_crossing"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)
