"""Phrase collocation mining by best-first branch and bound.

Phrases of two to four words are scored by their counts against
those of their two parts, cut where the score is lowest. Phrases grow to the
right. A prefix of count f whose first words have count l gives every phrase
that begins with it at most the score ``2 f / (l + f)`` (in millionths), since
the phrase occurs f times at most and its other part as often as the phrase.

The frontier is expanded best first, in steps: all prefixes whose bound reaches
a threshold, which starts at about the score of the 4 × ``top``-th two-word
phrase of a language. A step is one pass over the texts for each length. When
``top`` phrases at or above the threshold survive, all that could be among the
first ``top``, ties included, are known: the language is settled. Otherwise its
threshold is lowered and it is expanded further.

Tasks hold bit sets of fixed size of the prefixes to expand. Strangers that the
hashes let in are only counted in vain: counts are of the phrases themselves.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexlake.llm.common import if_small, short_batches, stored

UNDETERMINED = "und"
#: Bits of a bit set, 4 MB: 2**19 longs reach the driver.
_BITS = 1 << 25
#: Bytes of text whose phrases are counted together in a task.
_SLICE_BYTES = 8 << 20
#: Phrases of a batch that is sent.
_SEND = 50_000
#: The first threshold lets in so many times ``top`` phrases; each later one more.
_FIRST, _MORE = 4, 8
_MIX = np.random.default_rng(13).integers(0, 2**63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

# Bytes that end a piece; words are separated by blanks and tabs.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_TO_BREAK = bytes.maketrans(PIECE_ENDS, b"." * len(PIECE_ENDS))
_BREAK = b"."


class Slice:
    """The words of some texts of one language, with a break after each piece."""

    def __init__(self, lang: str, texts: list[str]) -> None:
        self.lang = lang
        whole = "\n".join(texts).encode().lower().translate(_TO_BREAK).replace(_BREAK, b" . ")
        number: dict[bytes, int] = defaultdict(count().__next__)
        number[_BREAK]
        words = whole.split()
        self.ids = np.fromiter((number[w] for w in words), dtype=np.int64, count=len(words))
        self.words = list(number)
        self.solid = self.ids != 0
        self._hashes: list[np.ndarray] = []

    def windows(self, k: int) -> np.ndarray:
        """True where k words begin that no break cuts."""
        n = max(len(self.ids) - k + 1, 0)
        ok = np.ones(n, dtype=bool)
        for i in range(k):
            ok &= self.solid[i : i + n]
        return ok

    def hashes(self, k: int) -> np.ndarray:
        """A hash of the k words from each place on."""
        if not self._hashes:
            self._hashes.append(word_hashes(self.lang, self.words)[self.ids])
        while len(self._hashes) < k:
            before, one = self._hashes[-1], self._hashes[0]
            n = max(len(self.ids) - len(self._hashes), 0)
            self._hashes.append(_joined(before[:n], one[len(one) - n :]))
        return self._hashes[k - 1]

    def counts(self, k: int, wanted: np.ndarray) -> Iterator[tuple[list[str], np.ndarray]]:
        """The distinct phrases of k words at the wanted places, and how often, some at a time."""
        at = np.flatnonzero(wanted)
        key = self.ids[at]
        for i in range(1, k):  # pairs of numbers are numbered again, so keys stay exact
            _, key = np.unique(key * len(self.words) + self.ids[at + i], return_inverse=True)
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        for lo in range(0, len(first), _SEND):
            rows = self.ids[at[first[lo : lo + _SEND]][:, None] + np.arange(k)].tolist()
            yield [b" ".join([self.words[i] for i in row]).decode() for row in rows], n[lo : lo + _SEND]


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a + np.uint64(1)) * _MIX[0] + b
    x = (x ^ (x >> np.uint64(31))) * _MIX[1]
    return x ^ (x >> np.uint64(29))


def _place(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(39)).astype(np.int64)


def phrase_places(langs: list[str], phrases: list[str]) -> np.ndarray:
    """Places of phrases in a bit set, as ``Slice.hashes`` gives them."""
    out = np.empty(len(phrases), dtype=np.int64)
    for i, (lang, phrase) in enumerate(zip(langs, phrases)):
        hashes = word_hashes(lang, phrase.encode().split(b" "))
        h = hashes[:1]
        for j in range(1, len(hashes)):
            h = _joined(h, hashes[j : j + 1])
        out[i] = _place(h)[0]
    return out


def bit_set(phrases: DataFrame, column: str = "phrase") -> np.ndarray:
    """The bit set (packed) of a table's (lang, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(phrase_places(*(c.to_pylist() for c in batch.columns)), pa.int64())], names=["place"])

    places = phrases.select("lang", column).mapInArrow(run, "place long")
    longs = places.groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
    out = np.zeros(_BITS // 64, dtype=np.int64)
    table = longs.toArrow()  # as many rows as the set has longs, at most
    out[table["at"].to_numpy()] = table["bits"].to_numpy()
    return out


def _within(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = _place(hashes)
    return (bits[place >> 6] >> (place & 63)) & 1 == 1


def _counted(docs: DataFrame, wanted: Callable[[Slice], Iterator[tuple[int, np.ndarray]]]) -> DataFrame:
    """lang, k, phrase, f: counts of the phrases of k words at the places that
    ``wanted`` names for a slice of one language. docs: lang, text."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = defaultdict(list)
        size: dict[str, int] = defaultdict(int)

        def found(lang: str) -> Iterator[pa.RecordBatch]:
            part = Slice(lang, held.pop(lang))
            size.pop(lang)
            for k, at in wanted(part):
                for phrases, n in part.counts(k, at):
                    columns = [pa.array([lang] * len(phrases), pa.string()), pa.array(np.full(len(phrases), k, dtype=np.int32)), pa.array(phrases, pa.string()), pa.array(n, pa.int64())]
                    yield pa.record_batch(columns, names=["lang", "k", "phrase", "f"])

        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                if text:
                    held[lang].append(text)
                    size[lang] += len(text)
                    if sum(size.values()) >= _SLICE_BYTES:
                        yield from found(max(size, key=size.get))
        for lang in list(held):
            yield from found(lang)

    rows = docs.select("lang", "text").mapInArrow(run, "lang string, k int, phrase string, f long")
    return rows.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))


def _words(first: int, last: int, column: str = "phrase") -> Column:
    """Words first .. last (from 1) of a phrase."""
    return F.array_join(F.slice(F.split(column, " "), first, last - first + 1), " ")


#: floor(2000000 a / (l + r)), exact beyond 64 bits.
_SHARE = "cast((cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast({} as decimal(20,0))) as long)"


def _scored(phrases: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """lang, phrase, a, l, r, score of phrases of k words (lang, phrase, f);
    counts: lang, phrase, f of all shorter ones that are frequent."""
    cuts = [F.struct(F.lit(i).alias("k"), _words(1, i).alias("left"), _words(i + 1, k).alias("right")) for i in range(1, k)]
    rows = phrases.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.array(*cuts)).alias("cut")).select("lang", "phrase", "a", "cut.*")
    side = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    rows = rows.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    rows = rows.withColumn("score", F.expr(_SHARE.format("r")))
    best = rows.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "b.a", "b.l", "b.r", "b.score")


def _bound(prefixes: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """prefixes (of k words, lang, phrase, a) with bound: what a phrase that
    begins with it can score at most."""
    heads = F.array(*[_words(1, i) for i in range(1, k)])
    rows = prefixes.select("lang", "phrase", "a", F.explode(heads).alias("head"))
    rows = rows.join(counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    return rows.groupBy("lang", "phrase").agg(F.min(F.expr(_SHARE.format("a"))).alias("bound"))


def _limits(scored: DataFrame, times: int) -> DataFrame:
    """lang, limit: the largest score that ``times`` phrases reach, else 0."""
    at = scored.groupBy("lang", "score").agg(F.count("*").alias("phrases"))  # a million scores a language at most
    above = Window.partitionBy("lang").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("reached", F.sum("phrases").over(above) >= times)
    return at.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("reached"), F.col("score"))), F.lit(0).cast("long")).alias("limit"))


def _not_within(phrases: DataFrame, longer: DataFrame, k: int, percent: int) -> DataFrame:
    """Phrases of k words without a phrase one word longer that holds them and
    occurs at least ``percent`` per cent as often. (A still longer one has such
    a part of k + 1 words.)"""
    parts = longer.select("lang", "f", F.explode(F.array(_words(1, k), _words(2, k + 1))).alias("phrase"))
    most = parts.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = phrases.join(most, ["lang", "phrase"], "left").where(F.expr(f"most is null or 100 * cast(most as decimal(20,0)) < {percent} * cast(a as decimal(20,0))"))
    return kept.drop("most")


def mine_phrases(docs: DataFrame, top: int = 2000, least: int = 30, percent: int = 80, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top``
    phrases of two to four words by score, then count (both descending), then
    phrase (in byte order).

    A-Z is lower-cased; pieces end at ``. , ; : ! ?`` and line ends, words at
    blanks and tabs. a counts all occurrences of the phrase within pieces,
    overlaps included (``least`` or more), l and r those of the parts of its
    lowest-scoring cut (the first of equal ones), n the language's words. A
    phrase within a longer one that occurs ``percent`` per cent as often or more
    is left out. Null languages are ``und``, null texts empty; repeated rows
    count each time; texts of any length are read whole; an empty table gives no
    rows; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNDETERMINED)).alias("lang"), F.col(text_col).alias("text"))
    words = stored(_counted(docs, lambda s: iter([(1, s.windows(1))])).drop("k"))
    totals = stored(words.groupBy("lang").agg(F.sum("f").alias("n")))
    single = stored(words.where(F.col("f") >= least))
    live = spark.sparkContext.broadcast(bit_set(single))

    def pairs(s: Slice) -> Iterator[tuple[int, np.ndarray]]:
        ok = _within(live.value, s.hashes(1)) & s.solid
        yield 2, ok[:-1] & ok[1:]

    double = stored(_counted(docs, pairs).where(F.col("f") >= least).drop("k"))
    shorter = single.union(double)
    scored = stored(_scored(double, single, 2))
    bounds = stored(_bound(scored, single, 2))
    settled, times, open_ = [], _FIRST * top, None
    while True:
        limits = _limits(scored, times)
        limits = stored(limits if open_ is None else limits.join(if_small(open_), "lang", "left_semi"))
        found = _expanded(docs.join(if_small(limits.select("lang")), "lang", "left_semi"), limits, scored, bounds, shorter, least, percent)
        reached = found.groupBy("lang").agg(F.count("*").alias("phrases"))
        open_ = stored(limits.where("limit > 0").join(reached, "lang", "left").where(F.coalesce("phrases", F.lit(0)) < top).select("lang"))
        settled.append(found.join(if_small(open_), "lang", "left_anti"))
        if not open_.head(1):
            break
        times *= _MORE
    every = reduce(DataFrame.union, settled)
    first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = every.withColumn("rank", F.row_number().over(first).cast("long")).where(F.col("rank") <= top)
    return ranked.join(if_small(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _expanded(docs: DataFrame, limits: DataFrame, scored: DataFrame, bounds: DataFrame, shorter: DataFrame, least: int, percent: int) -> DataFrame:
    """The phrases that score at least their language's limit and survive.

    Two-word phrases grow where their bound reaches the limit; those that score
    it themselves are also looked for within all three-word phrases. So it goes
    on with three words, whose growth also needs the counts of what can follow
    the first word of a four-word phrase.
    """
    spark = docs.sparkSession
    reaching = lambda df, column: df.join(if_small(limits), "lang").where(F.col(column) >= F.col("limit")).drop("limit")
    sets = lambda *dfs: [spark.sparkContext.broadcast(bit_set(df)) for df in dfs]
    grow2, keep2 = reaching(bounds, "bound").select("lang", "phrase"), reaching(scored, "score")
    begin, end = sets(grow2.union(keep2.select("lang", "phrase")), keep2)

    def triples(s: Slice) -> Iterator[tuple[int, np.ndarray]]:
        h = s.hashes(2)
        yield 3, s.windows(3) & (_within(begin.value, h[:-1]) | _within(end.value, h[1:]))

    three = stored(_counted(docs, triples).where(F.col("f") >= least).drop("k"))
    scored3 = stored(_scored(three, shorter, 3))
    grow3, keep3 = stored(reaching(_bound(scored3, shorter, 3), "bound").select("lang", "phrase")), reaching(scored3, "score")
    begin3, end3, tails = sets(grow3.union(keep3.select("lang", "phrase")), keep3, grow3.select("lang", _words(2, 3).alias("phrase")))

    def fours(s: Slice) -> Iterator[tuple[int, np.ndarray]]:
        h = s.hashes(3)
        yield 4, s.windows(4) & (_within(begin3.value, h[:-1]) | _within(end3.value, h[1:]))
        yield 3, s.windows(3) & _within(tails.value, s.hashes(2)[:-1])

    more = stored(_counted(docs, fours).where(F.col("f") >= least))
    four = more.where("k = 4").drop("k")
    counts = shorter.union(three.union(more.where("k = 3").drop("k")).dropDuplicates(["lang", "phrase"]))
    grown = four.withColumn("prefix", _words(1, 3)).join(grow3.withColumnRenamed("phrase", "prefix"), ["lang", "prefix"], "left_semi").drop("prefix")
    keep4 = reaching(_scored(grown, counts, 4), "score")
    return stored(_not_within(keep2, three, 2, percent).union(_not_within(keep3, four, 3, percent)).union(keep4))
