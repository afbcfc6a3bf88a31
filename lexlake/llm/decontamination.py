"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders; runs of one placeholder
count once. Windows of the resulting templates are hashed, and a document's
windows are joined by hash with the benchmark's. The slots of matching windows
must be consistent: within an occurrence (the windows of a document and an item
at one offset), each benchmark value stands for one document value, and the other
way round. So a question with other numbers or names is still found, and so are
several of its variants in one document.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexlake.llm import chunks
from lexlake.llm.common import short_batches, stored, with_fields

WINDOW = 8
#: Units that become a placeholder after a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg lb oz ml l gal s sec second seconds min minute minutes h hr hour hours day days week weeks "
    "month months year years percent usd eur gbp dollar dollars euro euros cent cents meter meters metre metres kilometer "
    "kilometers kilometre kilometres gram grams kilogram kilograms liter liters litre litres inch inches foot feet mile miles pound pounds"
).split()
#: Share of an item's windows, with consistent slots, that makes a document contaminated,
LEAST_SHARE = 0.5
#: or so many of them in one item.
LEAST_WINDOWS = 20
#: Bits of the filter of benchmark windows that tasks get: a fixed size, whatever the benchmark's.
FILTER_BITS = 1 << 24
_TOKENS = re.compile(r"[^\W_]+(?:[.,]\d+)*|[.!?\n]")
_WORD, _NUMBER, _TITLE, _UNIT, _STOP = range(5)
_UNITS = frozenset(UNITS)
#: Hashes of the placeholders, by kind.
_PLACEHOLDERS = np.array([xxhash.xxh64_intdigest(f"<{k}>") for k in ("word", "number", "name", "unit", "stop")], dtype=np.uint64)
#: Tokens and chunks that a task keeps at most.
_CACHE_WORDS = 600_000
#: Plain words that a window has at least. Items of as many tokens are looked for.
LEAST_WORDS = 4
#: Tokens that an item without any such window has at least: its own words, numbers
#: and names are then looked for as they stand.
LEAST_EXACT = 3
_WINDOWS = "text_hash long, pos int, size int, n_windows int, h long, slots array<string>"


class Vocabulary(dict):
    """Token → its number; names, hashes and classes by number."""

    def __init__(self) -> None:
        self.names, self.hashes, self.classes = [], array("Q"), array("b")
        #: Chunk between spaces → the int32 bytes of its tokens' numbers.
        self.chunks: dict[str, bytes] = {}

    def __missing__(self, token: str) -> int:
        low = token.lower()
        if token in ".!?\n":
            kind = _STOP
        elif token[0].isdigit():
            kind = _NUMBER
        elif low in _UNITS:
            kind = _UNIT
        elif token[0].isupper() and token[1:].islower():
            kind = _TITLE
        else:
            kind = _WORD
        self.names.append(token)
        self.hashes.append(xxhash.xxh64_intdigest(low))
        self.classes.append(kind)
        self[token] = len(self.classes) - 1
        return self[token]

    def chunk(self, chunk: str) -> bytes:
        """No token holds a space, so chunks are read on their own."""
        tokens = (chunk,) if chunk.isalpha() else _TOKENS.findall(chunk)
        found = self.chunks[chunk] = array("i", [self[t] for t in tokens]).tobytes()
        return found


class Templates:
    """The template tokens of the texts of a slice, one text after another.

    each: hashes, placeholders have their kind's. row: the text of a token. first
    and length: where a text's tokens begin, and how many there are.
    """

    def __init__(self, vocabulary: Vocabulary, texts: pa.Array) -> None:
        names, codes, bounds = chunks.cut(texts)
        known = vocabulary.chunks.get
        ids, stop = chunks.gathered([vocabulary.chunk(c) if (k := known(c)) is None else k for c in names], codes)
        ends = stop[bounds[1:] - 1]
        kinds = np.frombuffer(vocabulary.classes, dtype=np.int8)[ids] if len(ids) else np.zeros(0, dtype=np.int8)
        words = np.flatnonzero(kinds != _STOP)
        row = np.searchsorted(ends, words, side="right")
        begins, opening = _changes(row), _changes(row)
        opening[1:] |= np.diff(words) > 1
        kind = kinds[words]
        after_number = np.zeros(len(words), dtype=bool)
        after_number[1:] = (kind[:-1] == _NUMBER) & ~begins[1:]
        kind = np.where(kind == _UNIT, np.where(after_number, _UNIT, _WORD), np.where((kind == _TITLE) & opening, _WORD, kind))
        begins |= kind == _WORD
        begins[1:] |= kind[1:] != kind[:-1]
        start = np.flatnonzero(begins)
        self.kind, self.row = kind[start], row[start]
        self._names, self._ids = vocabulary.names, ids[words]
        self._start, self._stop = start, np.append(start[1:], len(words))
        hashes = np.frombuffer(vocabulary.hashes, dtype=np.uint64)[self._ids[start]] if len(ids) else np.zeros(0, dtype=np.uint64)
        self.each = np.where(self.kind == _WORD, hashes, _PLACEHOLDERS[self.kind])
        self.length = np.bincount(self.row, minlength=len(texts))
        self.first = np.cumsum(self.length) - self.length
        self._plain = np.concatenate([[0], np.cumsum(self.kind == _WORD)])
        #: The tokens as they stand: hashes, texts, where a text's begin, how many it has.
        self.exact = np.frombuffer(vocabulary.hashes, dtype=np.uint64)[self._ids] if len(ids) else np.zeros(0, dtype=np.uint64)
        self.exact_row = row
        self.exact_length = np.bincount(row, minlength=len(texts))
        self.exact_first = np.cumsum(self.exact_length) - self.exact_length

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the windows of that size with enough plain words begin, and their hashes."""
        if not LEAST_WORDS <= size <= len(self.each):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        within, total = _hashed(self.each, self.row, size)
        at = np.flatnonzero(within & (self._plain[size:] - self._plain[: len(total)] >= LEAST_WORDS))
        return at, total[at]

    def exact_windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where windows of that many tokens as they stand begin, and their hashes."""
        if size > len(self.exact):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        within, total = _hashed(self.exact, self.exact_row, size)
        at = np.flatnonzero(within)
        return at, total[at]

    def slots(self, at: int, size: int) -> list[str]:
        """Values of the placeholders in a window."""
        found = (i for i in range(at, at + size) if self.kind[i] != _WORD)
        return [" ".join(self._names[w] for w in self._ids[self._start[i] : self._stop[i]].tolist()).lower() for i in found]


def _hashed(each: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether a window lies in one text, and its hash, for each place."""
    total = np.zeros(len(each) - size + 1, dtype=np.uint64)
    for k in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + each[k : k + len(total)]
    total ^= total >> np.uint64(31)
    total *= np.uint64(0xD6E8FEB86659FD93)
    return row[: len(total)] == row[size - 1 :], total


def _changes(row: np.ndarray) -> np.ndarray:
    """The first of each run of equal values."""
    out = np.ones(len(row), dtype=bool)
    out[1:] = row[1:] != row[:-1]
    return out


def _windows(keep: bytes | None, sizes: list[int]):
    """Windows of each row (item, text_hash, text) that have enough plain words;
    ``n_windows`` counts them. Benchmark texts (``keep`` is None) have windows of
    WINDOW tokens, shorter ones a window of their own length; those without a
    window of enough plain words have windows of their tokens as they stand,
    marked by a negative size and without slots. Documents have windows of all
    ``sizes``, if their hash is in the filter."""
    names = ("item", "text_hash", "pos", "size", "n_windows", "h", "slots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        bits = None if keep is None else np.frombuffer(keep, dtype=np.uint8)
        for batch in batches:
            for lo, hi, texts in chunks.slices(batch.column(2)):
                if len(vocabulary) + len(vocabulary.chunks) > _CACHE_WORDS:
                    vocabulary = Vocabulary()
                read = Templates(vocabulary, texts)
                rows, places, lengths, hashes, slots = [], [], [], [], []
                whole_sizes = [z for z in sizes if z > 0] if sizes else range(LEAST_WORDS, WINDOW + 1)
                exact_sizes = [-z for z in sizes if z < 0] if sizes else range(LEAST_EXACT, WINDOW + 1)

                def filtered(h: np.ndarray) -> np.ndarray:
                    slot = h % np.uint64(FILTER_BITS)
                    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1) == 1

                for size in whole_sizes:
                    at, h = read.windows(size)
                    own = np.minimum(read.length[read.row[at]], WINDOW) == size if bits is None else filtered(h)
                    at, h = at[own], h[own]
                    rows.append(read.row[at])
                    places.append(at - read.first[read.row[at]])
                    lengths.append(np.full(len(at), size))
                    hashes.append(h)
                    slots += [read.slots(i, size) for i in at.tolist()]
                bare = np.ones(hi - lo, dtype=bool)
                bare[np.concatenate([np.zeros(0, dtype=np.int64), *rows]).astype(np.int64)] = False
                for size in exact_sizes:
                    at, h = read.exact_windows(size)
                    mine = read.exact_row[at]
                    own = bare[mine] & (np.minimum(read.exact_length[mine], WINDOW) == size) if bits is None else filtered(h)
                    at, h, mine = at[own], h[own], mine[own]
                    rows.append(mine)
                    places.append(at - read.exact_first[mine])
                    lengths.append(np.full(len(at), -size))
                    hashes.append(h)
                    slots += [[] for _ in range(len(at))]
                if not rows:
                    continue
                row, place, length, h = map(np.concatenate, (rows, places, lengths, hashes))
                n_windows = np.bincount(row, minlength=hi - lo)[row]
                ids, text_hash = (batch.column(k).take(pa.array(row + lo)) for k in (0, 1))
                whole = [pa.array(x.astype(np.int32)) for x in (place, length, n_windows)]
                yield pa.record_batch([ids, text_hash, *whole, pa.array(h.astype(np.uint64).view(np.int64)), pa.array(slots, pa.list_(pa.string()))], names=names)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each contaminated (document, item): id, item_id, windows
    (of the item found with consistent slots), n_windows (the item's), share,
    exact (all slot values equal the item's).

    ``n_windows`` counts the item's windows that can be found: those of at least
    four plain words, by their place in the item. A place is found if a window of
    any occurrence has consistent slots. An item without any such window (short
    sums, lists of names and numbers) is looked for by windows of its tokens as
    they stand, numbers and names included.

    Whole texts are read. Null texts and texts under three tokens match nothing.
    Items of up to seven tokens have one window, of their own length. Repeated
    rows count as one document; different texts of one id are documents of their
    own, as are those of a null id. Of several texts of one item the one with the
    largest share counts; rows with a null item are left out. A number, name or
    unit placeholder never makes a window alone. Either table may be empty: no
    rows. Ids may be of any type that can be compared. Other columns are ignored.
    """
    return of_texts(docs, benchmark, id_col, text_col, item_col, item_text_col).drop("text_hash")


def of_texts(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``contaminated`` with ``text_hash`` (XXH64), which tells texts of one id apart."""
    spark = docs.sparkSession
    short_batches(spark)
    items = benchmark.select(F.col(item_col).alias("item"), F.xxhash64(item_text_col).alias("text_hash"), F.col(item_text_col).alias("text"))
    theirs = stored(items.where("item is not null and text is not null").mapInArrow(_windows(None, []), with_fields(items.select("item").schema, _WINDOWS)))
    sizes = sorted(r["size"] for r in theirs.select("size").distinct().collect())  # at most WINDOW
    slot = F.pmod(F.col("h"), F.lit(FILTER_BITS))
    # A bit set of fixed size: the words of 32 bits that hold a window, at most FILTER_BITS / 32 rows.
    words = theirs.select(F.floor(slot / 32).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(pmod(h, {FILTER_BITS}), 32) as int))").alias("b"))
    held = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    bits = np.zeros(FILTER_BITS // 32, dtype="<u4")
    bits[held["w"].to_numpy(dtype=np.int64)] = held["b"].to_numpy(dtype=np.int64).astype("<u4")
    rows = docs.select(F.col(id_col).alias("item"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).where("text is not null")
    ours = rows.mapInArrow(_windows(bits.tobytes(), sizes or [WINDOW]), with_fields(rows.select("item").schema, _WINDOWS))
    ours = ours.select(F.col("item").alias("doc"), "text_hash", F.col("pos").alias("at"), "size", "h", F.col("slots").alias("found")).distinct()

    one = theirs.select("item", F.col("text_hash").alias("variant"), "pos", "size", "n_windows", "h", "slots").distinct()
    pairs = ours.join(one, ["h", "size"]).where(F.size("slots") == F.size("found")).withColumn("offset", F.col("at") - F.col("pos"))
    # Within an occurrence values must stand for each other one to one: the commonest are kept.
    text = ["doc", "text_hash", "item", "variant"]
    once = [*text, "offset"]
    mapped = pairs.select(*once, "pos", "n_windows", F.explode_outer(F.arrays_zip("slots", "found")).alias("m"))
    mapped = mapped.select(*once, "pos", "n_windows", F.col("m.slots").alias("was"), F.col("m.found").alias("now"))
    mapped = mapped.withColumn("n", F.count("*").over(Window.partitionBy(*once, "was", "now")))
    best = Window.partitionBy(*once, "was").orderBy(F.desc("n"), "now")
    back = Window.partitionBy(*once, "now").orderBy(F.desc("n"), "was")
    checked = mapped.withColumns({"stands": F.first("now").over(best), "stood": F.first("was").over(back)})
    ok = F.col("was").isNull() | ((F.col("stands") == F.col("now")) & (F.col("stood") == F.col("was")))
    same = F.coalesce(F.col("was") == F.col("now"), F.lit(True))
    windows = checked.groupBy(*once, "pos").agg(F.max("n_windows").alias("n_windows"), F.min(ok).alias("ok"), F.min(same).alias("same"))
    places = windows.where("ok").groupBy(*text, "pos").agg(F.max("n_windows").alias("n_windows"), F.max("same").alias("same"))
    found = places.groupBy(*text).agg(F.count("*").alias("windows"), F.max("n_windows").cast("long").alias("n_windows"), F.min("same").alias("exact"))
    found = found.withColumn("share", F.col("windows") / F.col("n_windows"))
    found = found.where((F.col("share") >= LEAST_SHARE) | (F.col("windows") >= LEAST_WINDOWS))
    most = F.max(F.struct("share", "exact", "windows", "n_windows")).alias("m")
    found = found.groupBy("doc", "text_hash", "item").agg(most)
    return found.select(F.col("doc").alias(id_col), "text_hash", F.col("item").alias("item_id"), "m.windows", "m.n_windows", "m.share", "m.exact")
