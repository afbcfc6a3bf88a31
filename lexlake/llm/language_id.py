"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. A word that no
language knows is scored by its character n-grams: at each position the longest
n-gram that is known, down to single characters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.llm.common import if_small, short_batches, stored, with_fields

#: Labelled documents that a language is fitted on, about (drawn by a hash of
#: id and text). The bound on the fit's work and on the model that is broadcast:
#: it holds all words and n-grams of these documents, whatever the corpus.
FIT_DOCS_PER_LANGUAGE = 1_000
ORDERS = (5, 4, 3, 2, 1)
#: Occurrences that stand for none: the least frequency of a language.
NO_OCCURRENCE = 0.1
#: Words whose evidence counts in full; longer texts are scaled down to them.
EVIDENCE_WORDS = 50
#: Weight of an unseen word beside a known one.
UNSEEN_WEIGHT = 0.5
UNDETERMINED = "und"
#: Unseen words whose n-grams a worker keeps.
CACHE_WORDS = 300_000
_ALNUM = re.compile(r"[^\W\d_]+").findall
_LETTERS = regex.compile(r"\p{L}+").findall
#: ASCII without letters.
_SPACED = {i: " " for i in range(128) if not chr(i).isalpha()}


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters (Unicode category L)."""
    text = (text or "").lower()
    if text.isascii():
        return text.translate(_SPACED).split()
    words = _ALNUM(text)
    # Numbers that are no decimal digits (½, ²) count as alphanumeric, not as letters.
    return words if "".join(words).isalpha() else _LETTERS(text)


@dataclass
class Model:
    """Languages, and the known words (order 0) and n-grams with the languages
    that have them: entry i has those at ``starts[i]`` to ``starts[i + 1]``, each
    with its log frequency over the least one (of the order)."""

    languages: list[str]
    orders: np.ndarray
    grams: list[str]
    starts: np.ndarray
    langs: np.ndarray
    values: np.ndarray


def _grams(word: str, order: int) -> list[str]:
    marked = f"_{word}_"
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (order 0) and n-grams by language, summed for each batch."""
    for batch in batches:
        words: dict[str, Counter] = {}
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            words.setdefault(lang, Counter()).update(words_of(text))
        for lang, counted in words.items():
            tables = {0: counted} | {k: Counter() for k in ORDERS}
            for word, n in counted.items():
                for k in ORDERS:
                    for g in _grams(word, k):
                        tables[k][g] += n
            for k, t in tables.items():
                yield pa.record_batch(
                    [pa.array([lang] * len(t), pa.string()), pa.array([k] * len(t), pa.int32()), pa.array(t.keys(), pa.string()), pa.array(t.values(), pa.int64())],
                    names=["lang", "k", "gram", "n"],
                )


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Fits on labelled rows; those with null text or language don't count.

    The id only draws rows. All languages are told apart, and all words and
    n-grams of the drawn documents are kept. Without any labelled text the model
    knows no language and predicts ``und``.
    """
    short_batches(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    sizes = stored(rows.groupBy("lang").agg(F.count("*").alias("docs")))
    share = F.least(F.lit(1.0), FIT_DOCS_PER_LANGUAGE / F.col("docs"))
    drawn = rows.join(if_small(sizes), "lang").where(F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) < share * 1_000_000)
    counts = stored(drawn.select("lang", "text").mapInArrow(_count, "lang string, k int, gram string, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("lang", "k").agg(F.sum("n").alias("total")).collect()  # seven rows a language at most
    languages = sorted(r["lang"] for r in sizes.select("lang").collect())
    number = {lang: i for i, lang in enumerate(languages)}
    total = np.ones((len(ORDERS) + 1, max(1, len(languages))))
    for r in totals:
        total[r["k"], number[r["lang"]]] = r["total"]
    names = F.create_map(*[F.lit(x) for pair in number.items() for x in pair]) if number else F.lit(None).cast("map<string,int>")
    entries = counts.groupBy("k", "gram").agg(F.collect_list(F.struct(F.element_at(names, F.col("lang")).alias("lang"), "n")).alias("by")).toArrow()
    orders, by = entries.column("k").to_numpy(), entries.column("by").combine_chunks()
    langs, n = (by.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    starts = by.offsets.to_numpy().astype(np.int64)
    order = np.repeat(orders, np.diff(starts))
    values = np.log(n / total[order, langs]) - np.log(NO_OCCURRENCE / total.max(axis=1))[order]
    return Model(languages, orders, entries.column("gram").to_pylist(), starts, langs.astype(np.int32), values)


class Scorer:
    """Scores texts by a model; keeps the n-grams of unseen words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        at = lambda rows: {model.grams[i]: i for i in rows.tolist()}
        self.grams = at(np.flatnonzero(model.orders > 0))  # the length tells the order
        #: Word → the int32 bytes of its entry, or of its n-grams' if it is unseen.
        self.words = {w: np.int32(i).tobytes() for w, i in at(np.flatnonzero(model.orders == 0)).items()}
        self.most = len(self.words) + CACHE_WORDS

    def backoff(self, word: str) -> bytes:
        """Entries of the longest known n-gram at each position of an unseen word."""
        marked, found, get = f"_{word}_", [], self.grams.get
        for i in range(len(marked)):
            for k in range(min(ORDERS[0], len(marked) - i), 0, -1):
                at = get(marked[i : i + k])
                if at is not None:
                    found.append(at)
                    break
        packed = np.array(found, dtype=np.int32).tobytes()
        if len(self.words) < self.most:
            self.words[word] = packed
        return packed

    def predict(self, text: str | None) -> tuple[str, float]:
        words = Counter(words_of(text))
        if not words or not self.model.languages:
            return UNDETERMINED, 0.0
        held = [self.backoff(w) if h is None else h for w, h in zip(words, map(self.words.get, words))]
        n, m = np.fromiter(words.values(), dtype=np.float64, count=len(words)), self.model
        size = np.fromiter(map(len, held), dtype=np.int64, count=len(held)) // 4
        entries = np.frombuffer(b"".join(held), dtype=np.int32)
        first = np.minimum(np.cumsum(size) - size, len(entries) - 1)
        unseen = m.orders[entries[first]] > 0 if len(entries) else np.zeros(len(n), dtype=bool)
        weights = np.repeat(np.where(unseen, UNSEEN_WEIGHT, 1.0) * n / np.maximum(size, 1), size)
        start, each = m.starts[entries], m.starts[entries + 1] - m.starts[entries]
        at = np.repeat(start - (np.cumsum(each) - each), each) + np.arange(each.sum())
        total = np.bincount(m.langs[at], weights=np.repeat(weights, each) * m.values[at], minlength=len(m.languages))
        total *= min(1.0, EVIDENCE_WORDS / n.sum())
        chances = np.exp(total - total.max())
        best = int(np.argmax(total))
        return m.languages[best], float(chances[best] / chances.sum())


_HELD: list[Scorer] = []


def scorer(model: Model) -> Scorer:
    """The worker's own for a broadcast model, kept between its tasks."""
    if not _HELD or _HELD[0].model is not model:
        _HELD[:] = [Scorer(model)]
    return _HELD[0]


def predict_language(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Adds ``pred_col`` and ``score_col`` (the share of the best language, 0 to 1).

    ``und`` with score 0 for null texts and texts without a letter. Ties go to
    the first language by name. Every row is scored from its whole text alone,
    so repeated rows get equal results and an empty table stays empty. Columns
    of these two names are replaced.
    """
    short_batches(docs.sparkSession)
    docs = docs.drop(pred_col, score_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = scorer(shared.value).predict
        for batch in batches:
            found = [predict(t) for t in batch.column(batch.schema.get_field_index(text_col)).to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=[*batch.schema.names, pred_col, score_col],
            )

    return docs.mapInArrow(run, with_fields(docs.schema, f"`{pred_col}` string, `{score_col}` double"))
