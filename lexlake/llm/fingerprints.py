"""I-Match document fingerprints.

Terms whose inverse document frequency lies in a band form the lexicon. A
document's in-band terms are sorted, and each of several randomised subsets of
the lexicon picks some of them for one hash. A subset keeps a share of the
lexicon given by its rate; coarse rates tell exact from changed documents,
fine rates measure how much two documents share.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.llm.common import short_batches, with_fields

#: Share of all documents that hold a lexicon term: idf = ln(1/share).
#: A document has D distinct terms on average, so at most D / LEAST_SHARE terms
#: reach the lower share, however many documents there are. That bounds the
#: lexicon which is broadcast.
LEAST_SHARE, MOST_SHARE = 0.0005, 0.1

#: Each rate r keeps a term with probability 2**-r; SUBSETS_PER_RATE subsets each.
RATES, SUBSETS_PER_RATE = (1, 3, 5, 7, 9, 11), 16
N_SUBSETS = len(RATES) * SUBSETS_PER_RATE

#: Terms that a task counts before it passes the counts on.
COUNTED_TERMS = 500_000
_WORDS = re.compile(r"\w+").findall
#: ASCII without what is part of no term.
_SPACED = {i: " " for i in range(128) if not _WORDS(chr(i))}


def _multipliers() -> np.ndarray:
    drawn = np.random.default_rng(20240229).integers(0, 2**63, N_SUBSETS, dtype=np.uint64)
    return drawn * np.uint64(2) + np.uint64(1)


_MULTIPLY = _multipliers()
_SHIFT = (64 - np.repeat(np.array(RATES), SUBSETS_PER_RATE)).astype(np.uint64)


def terms_of(text: str | None) -> set[str]:
    """The distinct lower-case terms: runs of letters, digits and underscores."""
    text = (text or "").lower()
    return set(text.translate(_SPACED).split() if text.isascii() else _WORDS(text))


def _hashes(terms: Iterable[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, terms), dtype=np.uint64)


def subsets_of(hashes: np.ndarray) -> np.ndarray:
    """The subsets that pick each term, a bit each."""
    picked = (hashes[:, None] * _MULTIPLY[None, :]) >> _SHIFT[None, :] == 0
    return np.packbits(picked, axis=1)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each term of a task, or of so many terms: combined before the shuffle."""
    df: Counter[str] = Counter()

    def rows() -> pa.RecordBatch:
        return pa.record_batch([pa.array(df.keys(), pa.string()), pa.array(df.values(), pa.int64())], names=["term", "df"])

    for batch in batches:
        for text in batch.column(0).to_numpy(zero_copy_only=False):
            df.update(terms_of(text))
            if len(df) >= COUNTED_TERMS:
                yield rows()
                df.clear()
    yield rows()


def lexicon(docs: DataFrame, text_col: str = "text") -> list[str]:
    """The terms in the band, counted over all documents, in order of their hashes.

    Rows are documents: repeated ones and null or empty texts (without terms) count
    in their number. Terms at either end of the band belong to it. Of an empty
    table the lexicon is empty.
    """
    short_batches(docs.sparkSession)
    n_docs = docs.count()
    counts = docs.select(text_col).mapInArrow(_document_frequencies, "term string, df long")
    counts = counts.groupBy("term").agg(F.sum("df").alias("df"))
    band = counts.where(F.col("df").between(LEAST_SHARE * n_docs, MOST_SHARE * n_docs))
    found = band.select("term").toArrow().column(0).to_pylist()
    return sorted(found, key=lambda t: (xxhash.xxh64_intdigest(t), t))


def fingerprint(hashes: np.ndarray, subsets: np.ndarray) -> str:
    """Four hex digits a subset; 0000 where the subset picks no term.

    hashes: sorted distinct terms; subsets: ``subsets_of`` them.
    """
    out = np.zeros(N_SUBSETS, dtype=">u2")
    if len(hashes):
        at = np.flatnonzero(np.unpackbits(subsets, axis=1).T.ravel().view(bool))
        subset, term = np.divmod(at, len(hashes))
        chosen, ends = hashes[term].tobytes(), np.cumsum(np.bincount(subset, minlength=N_SUBSETS)).tolist()
        start, digest = 0, xxhash.xxh64_intdigest
        for k, end in enumerate(ends):
            if end > start:
                out[k] = digest(chosen[8 * start : 8 * end]) % 65535 + 1
                start = end
    return out.tobytes().hex()


class Fingerprinter:
    """Text → fingerprint over a lexicon.

    A text without in-band terms falls back to all its terms; a text without
    terms (null, empty, no word) has all zeros.
    """

    def __init__(self, lex: list[str]) -> None:
        self.lex, self.place = lex, {t: i for i, t in enumerate(lex)}
        self.hashes = _hashes(lex)
        self.subsets = np.concatenate([np.zeros((0, N_SUBSETS // 8), dtype=np.uint8), *(subsets_of(self.hashes[i : i + 4096]) for i in range(0, len(lex), 4096))])

    def __call__(self, text: str | None) -> str:
        terms = terms_of(text)
        places = np.fromiter(map(self.place.get, terms, repeat(-1)), dtype=np.int32, count=len(terms))
        banded = np.sort(places[places >= 0])
        if len(banded):
            return fingerprint(self.hashes[banded], self.subsets[banded])
        hashes = np.unique(_hashes(terms))
        return fingerprint(hashes, subsets_of(hashes))


_HELD: list[Fingerprinter] = []


def fingerprinter(lex: list[str]) -> Fingerprinter:
    """The worker's own for a broadcast lexicon, kept between its tasks."""
    if not _HELD or _HELD[0].lex is not lex:
        _HELD[:] = [Fingerprinter(lex)]
    return _HELD[0]


def likeness(a: str, b: str) -> float:
    """0 to 1: the share of equal hashes among the subsets that pick a term in
    either text, over the rates fine enough to leave a quarter of the subsets
    empty (there it estimates the share of common terms). Equal fingerprints: 1."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(v), dtype=">u2").reshape(len(RATES), -1) for v in (a, b))
    used, same = ((x > 0) | (y > 0)).sum(1), ((x > 0) & (x == y)).sum(1)
    fine = used <= SUBSETS_PER_RATE * 3 // 4
    if not used[fine].sum():
        fine = np.ones(len(RATES), dtype=bool)
    return float(same[fine].sum() / max(1, used[fine].sum()))


def fingerprint_texts(docs: DataFrame, lex: list[str], text_col: str = "text") -> DataFrame:
    """Adds ``fingerprint`` to the other columns. Null counts as empty text;
    equal texts, also repeated rows, get equal fingerprints."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lex)
    docs = docs.drop("fingerprint")
    schema = with_fields(docs.schema, "fingerprint string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = fingerprinter(shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([of(t) for t in texts], pa.string())], names=[*batch.schema.names, "fingerprint"]
            )

    return docs.mapInArrow(run, schema)
