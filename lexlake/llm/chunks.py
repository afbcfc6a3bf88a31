"""Texts of a batch cut at spaces: what is known of each distinct chunk is
looked up once and gathered back by position with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled together, beyond a single text.
SLICE_BYTES = 4_000_000


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, stop row, their texts) of about ``size`` bytes. Null is empty."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, side="right")))
        yield lo, hi, texts.slice(lo, hi - lo)
        lo = hi


def cut(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct chunks, the number of each chunk in turn, and where the
    texts' chunks begin and end. A text has one chunk at least."""
    lists = pc.split_pattern(texts, " ")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    return names, coded.indices.to_numpy().astype(np.int64), bounds - bounds[0]


def gathered(held: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The int32 values of all codes in turn, and where each code's values end."""
    counts = np.fromiter(map(len, held), dtype=np.int64, count=len(held)) // 4
    starts, each = np.cumsum(counts) - counts, counts[codes]
    stop = np.cumsum(each)
    at = np.repeat(starts[codes] - (stop - each), each)
    at += np.arange(len(at))
    return np.frombuffer(b"".join(held), dtype=np.int32)[at], stop
