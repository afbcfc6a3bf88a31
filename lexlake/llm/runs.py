"""Periodic runs of words by internal pattern matching.

A run is a stretch of consecutive words with smallest period q (words q apart
are the same), of at least ``max(least, 2 q)`` words, that no neighbouring word
extends. Texts are read a few at a time in each task:

* a suffix array with the ranks of all substrings of 2**k words gives each
  substring's occurrences as a range, and longest common extensions;
* a wavelet tree over the suffix array answers range-successor queries: the
  next occurrence of a block at or behind a position;
* each dyadic block asks for its occurrences in the window behind it. Those
  that overlap by half form arithmetic progressions, which are stepped over in
  one. Distances of occurrences are candidate periods, which extensions verify.

A run of period q holds, in its first ``length - q`` words, a whole block of
2**k words for some k whose window reaches q words on, so none is missed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexlake.llm.common import short_batches, with_fields

#: Words of the smallest blocks, which start at every other word, and the fewest
#: words that a run can have for these blocks to find it.
_BLOCK, LEAST = 4, 12
#: A text can only have a run if it has this many words again: length - q >= 6.
_AGAIN = LEAST // 2
#: Bytes of text that are worked on at a time; a longer text is alone.
_SLICE_BYTES = 4 << 20
#: Odd constants that mix the words of a window.
_MIX = np.random.default_rng(11).integers(0, 2**63, _AGAIN + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Suffixes:
    """Suffixes of several texts (``ids``: word numbers, ``doc``: text numbers,
    ascending) in order, each text's for itself."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray) -> None:
        n = len(ids)
        key = doc.astype(np.int64) * (int(ids.max()) + 1) + ids
        self.array = np.argsort(key, kind="stable")
        first = np.append(True, np.diff(key[self.array]) != 0)
        #: ranks[k][i]: first place, in the array, of the suffixes whose 2**k
        #: words (fewer at the end of the text) are those at i.
        self.ranks = [self._spread(first)]
        while not first.all():
            step, rank = 1 << (len(self.ranks) - 1), self.ranks[-1]
            slots = np.flatnonzero(~(first & np.append(first[1:], True)))
            at = self.array[slots]
            further = np.minimum(at + step, n - 1)
            second = np.where((at + step < n) & (doc[further] == doc[at]), rank[further], -1)
            key = rank[at].astype(np.int64) * (n + 1) + second + 1
            order = np.argsort(key, kind="stable")
            self.array[slots] = at[order]
            first = first.copy()
            first[slots] = np.append(True, np.diff(key[order]) != 0)
            self.ranks.append(self._spread(first))

    def _spread(self, first: np.ndarray) -> np.ndarray:
        rank = np.empty(len(first), dtype=np.int32)
        rank[self.array] = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
        return rank

    def occurrences(self, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of the array with all occurrences of the 2**k words at ``at``."""
        left = self.ranks[k][at].astype(np.int64)
        return left, left + np.bincount(self.ranks[k], minlength=len(self.array))[left]

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on are those from j on (i < j, of one text)."""
        a, b, n = i.copy(), j.copy(), len(self.array)
        for k in range(len(self.ranks) - 1, -1, -1):
            same = (b < n) & (self.ranks[k][np.minimum(a, n - 1)] == self.ranks[k][np.minimum(b, n - 1)])
            a, b = a + (same << k), b + (same << k)
        return a - i

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i are those before j (i < j, of one text)."""
        a, b = i.copy(), j.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            same = (a >= 1 << k) & (self.ranks[k][np.maximum(a - (1 << k), 0)] == self.ranks[k][np.maximum(b - (1 << k), 0)])
            a, b = a - (same << k), b - (same << k)
        return i - a


class WaveletTree:
    """Range-successor queries on a permutation of 0 .. n - 1."""

    def __init__(self, values: np.ndarray) -> None:
        self.n = len(values)
        self.levels = []
        for bit in range(self.n.bit_length() - 1, -1, -1):
            one = (values >> bit) & 1 == 1
            zeros = np.concatenate([[0], np.cumsum(~one)]).astype(np.int32)
            self.levels.append((bit, zeros, int(zeros[-1])))
            values = np.concatenate([values[~one], values[one]])

    def successor(self, left: np.ndarray, right: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest value of at least ``least`` in left .. right - 1, else -1."""
        least = np.minimum(least, self.n)
        less, a, b = np.zeros(len(left), dtype=np.int64), left, right
        for bit, zeros, n_zeros in self.levels:
            one = (least >> bit) & 1 == 1
            za, zb = zeros[a].astype(np.int64), zeros[b].astype(np.int64)
            less += np.where(one, zb - za, 0)
            a, b = np.where(one, n_zeros + a - za, za), np.where(one, n_zeros + b - zb, zb)
        found = less < right - left
        left_over, a, b, value = np.where(found, less, 0), left, right, np.zeros(len(left), dtype=np.int64)
        for bit, zeros, n_zeros in self.levels:
            za, zb = zeros[a].astype(np.int64), zeros[b].astype(np.int64)
            one = left_over >= zb - za
            left_over = left_over - np.where(one, zb - za, 0)
            value |= one.astype(np.int64) << bit
            a, b = np.where(one, n_zeros + a - za, za), np.where(one, n_zeros + b - zb, zb)
        return np.where(found, value, -1)


def _periods(s: Suffixes, tree: WaveletTree, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, candidate period) from the blocks of 2**k words at ``at``."""
    size = 1 << k
    left, right = s.occurrences(k, at)
    again = right - left > 1
    at, left, right = at[again], left[again], right[again]
    # Larger blocks leave the short periods to smaller ones.
    nearest = 1 if size == _BLOCK else 2 * size - 1
    x = tree.successor(left, right, at + nearest)
    starts, periods = [], []
    while True:
        live = (x >= 0) & (x <= at + 4 * size - 2)
        at, left, right, x = at[live], left[live], right[live], x[live]
        if not len(at):
            break
        y = tree.successor(left, right, x + 1)
        p = np.where((y >= 0) & (y - x <= size // 2), y - x, 0)
        last = x.copy()
        many = np.flatnonzero(p)
        step = p[many]
        reach = x[many] + step + s.ahead(x[many], x[many] + step)
        last[many] += (reach - size - x[many]) // step * step
        # A progression that the block itself begins is a run of that period alone.
        own = at[many] + step + s.ahead(at[many], at[many] + step) >= x[many] + size
        goal = np.minimum(last, at + 4 * size - 2)
        n = np.where(p > 0, (goal - x) // np.maximum(p, 1) + 1, 1)
        n[many[own]] = 0
        row = np.repeat(np.arange(len(at)), n)
        turn = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        starts += [at[row], at[many[own]]]
        periods += [x[row] + turn * p[row] - at[row], step[own]]
        x = np.where(p > 0, tree.successor(left, right, last + 1), y)
    empty = np.zeros(0, dtype=np.int64)
    return np.concatenate([empty, *starts]), np.concatenate([empty, *periods])


def find_runs(ids: np.ndarray, doc: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (text, start, length, period), in order; start counts from 0 in ids."""
    if least < LEAST:
        raise ValueError(f"runs of under {LEAST} words are not looked for: {least}")
    none = np.zeros((0, 4), dtype=np.int64)
    if len(ids) < least:
        return none
    s = Suffixes(ids, doc)
    tree = WaveletTree(s.array)
    every = np.arange(len(ids))
    begin = np.flatnonzero(np.append(True, np.diff(doc) != 0))
    sizes = np.diff(np.append(begin, len(ids)))
    offset, left = every - np.repeat(begin, sizes), np.repeat(begin + sizes, sizes) - every
    starts, periods = [], []
    k = _BLOCK.bit_length() - 1
    while k < len(s.ranks) and 2 * (1 << k) - 1 <= sizes.max():
        apart = _BLOCK // 2 if 1 << k == _BLOCK else 1 << k
        a, p = _periods(s, tree, k, every[(offset % apart == 0) & (left >= 1 << k)])
        starts.append(a)
        periods.append(p)
        k += 1
    pairs = np.unique(np.stack([np.concatenate(starts), np.concatenate(periods)]), axis=1) if starts else np.zeros((2, 0), dtype=np.int64)
    at, p = pairs
    before, after = s.behind(at, at + p), s.ahead(at, at + p)
    length = before + p + after
    ok = length >= np.maximum(least, 2 * p)
    start, length, p = (at - before)[ok], length[ok], p[ok]
    if not len(start):
        return none
    # The same stretch also has the multiples of its period: the smallest counts.
    order = np.lexsort([p, length, start])
    start, length, p = start[order], length[order], p[order]
    one = np.append(True, (np.diff(start) != 0) | (np.diff(length) != 0))
    start, length, p = start[one], length[one], p[one]
    order = np.lexsort([p, start])
    return np.stack([doc[start], start, length, p], axis=1)[order]


def _has_repeats(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Numbers of the texts with a window of ``_AGAIN`` words that comes again."""
    n = len(ids) - _AGAIN + 1
    if n < 1:
        return np.zeros(0, dtype=doc.dtype)
    words = ids.astype(np.uint64)
    key = doc[:n].astype(np.uint64) * _MIX[-1]
    for i in range(_AGAIN):
        key += words[i : i + n] * _MIX[i]
        key = (key ^ (key >> np.uint64(31))) * _MIX[i]
    whole = np.flatnonzero(doc[_AGAIN - 1 :] == doc[:n])
    order = whole[np.argsort(key[whole])]
    same = np.flatnonzero(np.diff(key[order]) == 0)
    return np.unique(doc[order[same]])


def runs_of_texts(texts: list[bytes], least: int = LEAST) -> list[tuple[list[tuple[int, int, int]], bytes, int]]:
    """(runs as (start, length, period), collapsed text, words) of each text."""
    words = [t.split() for t in texts]
    number: dict[bytes, int] = defaultdict(count().__next__)
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    ids = np.fromiter((number[w] for part in words for w in part), dtype=np.int64, count=int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    repeating = np.zeros(len(texts), dtype=bool)
    repeating[_has_repeats(ids, doc)] = True
    kept = repeating[doc]
    ids, doc = ids[kept], doc[kept]
    found = find_runs(ids, doc, least) if len(ids) else np.zeros((0, 4), dtype=np.int64)
    begin = np.cumsum(np.where(repeating, sizes, 0)) - np.where(repeating, sizes, 0)
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for d, start, length, p in found.tolist():
        runs[d].append((start - int(begin[d]), length, p))
    out = []
    for d, part in enumerate(words):
        left = part
        if d in runs:
            gone = np.zeros(len(part), dtype=bool)
            for start, length, p in runs[d]:
                gone[start + p : start + length] = True
            left = [part[i] for i in np.flatnonzero(~gone).tolist()]
        out.append((runs.get(d, []), b" ".join(left), len(part)))
    return out


def _slices(texts: list[str | None]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for text in texts:
        raw = (text or "").encode()
        if part and size + len(raw) > _SLICE_BYTES:
            yield part
            part, size = [], 0
        part.append(raw)
        size += len(raw)
    if part:
        yield part


def collapse_runs(docs: DataFrame, least: int = LEAST, text_col: str = "text", runs_col: str = "runs", collapsed_col: str = "collapsed", words_col: str = "n_words") -> DataFrame:
    """``docs`` with each row's runs (array of start, length, period, by start,
    then period; starts count words from 0), its text without the repetitions (a
    run keeps its first period; words joined by one space) and its word count.

    Words are separated by ASCII white space. ``least``: fewest words of a run,
    12 or more. Null and empty texts have no words, no runs and an empty
    collapsed text. A text of any length is read whole; repeated rows each get
    their own result; an empty table gives no rows. Other columns stay; the
    three result names must be new.
    """
    taken = {runs_col, collapsed_col, words_col} & set(docs.columns)
    if taken:
        raise ValueError(f"columns exist already: {sorted(taken)}")
    short_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for part in _slices(batch.column(at).to_pylist()):
                found = runs_of_texts(part, least)
                runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in f[0]] for f in found], run_type)
                left = pa.array([f[1].decode() for f in found], pa.string())
                mine = batch.slice(lo, len(part))
                yield pa.record_batch([*mine.columns, runs, left, pa.array([f[2] for f in found], pa.int64())], names=[*batch.schema.names, runs_col, collapsed_col, words_col])
                lo += len(part)

    schema = with_fields(docs.schema, f"`{runs_col}` array<struct<start:long,length:long,period:long>>, `{collapsed_col}` string, `{words_col}` long")
    return docs.mapInArrow(run, schema)
