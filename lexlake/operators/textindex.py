"""A stored inverted index for substring search.

``build_index`` writes three Parquet tables under a folder that all executors
can reach:

  documents  id and the columns of the indexed rows; of more than ``FIRST`` rows
             also tier, see below
  grams      gram, texts: how many texts hold it
  postings   bucket, gram, segment, ids: the ascending ids, of one segment of
             ``SEGMENT`` neighbouring ids, whose text holds the gram; of grams
             that a lookup can read, those in ``LISTED`` * ``LONGER`` texts or
             fewer (and a few that the bit set takes for such)

A gram is ``GRAM`` neighbouring characters. Rows of ``postings`` lie by bucket
(a hash of the gram) and in order of the gram within it, so a lookup reads a few
row groups. A list never holds more than a segment's ids.

Every row of a tier ranks before, or equal to, all rows of the next one, and each
tier is about ``GROWTH`` - 1 times as large as those before it together.

The terms with the rarest grams are looked up, as many as lead to ``NAMED`` texts:
``_listed`` intersects the lists of a term's rarest grams segment by segment, and
the candidates are verified against the texts. The lists of the others would grow
with the number of terms times that of texts, so ``_scanned`` looks for all of
them together in one pass over the texts, tier by tier: tasks get bit sets of fixed
size of the terms' beginnings and of the whole terms and pass on what both hold.
A term that has found as many rows as it can rank is left out from the next tier
on, so a term passes on about ``GROWTH`` times as many rows, however many texts
there are.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from lexlake.shared import short_batches

#: Characters of a gram.
GRAM = 3
#: Ids that a posting list can hold: a power of two.
SEGMENT = 1 << 16
#: Grams of a term whose lists are intersected; of these only such as are at most
#: ``LONGER`` times as frequent as the rarest.
RAREST, LONGER = 3, 8
#: Texts that may hold a term's rarest gram for the term to be looked up.
LISTED = 64
#: Texts that the terms of a search may have looked up for them.
NAMED = 1 << 16
#: Rows of the first tier, about, and of each next one with all before it as a multiple
#: of those; rows whose order settles where tiers end.
FIRST, GROWTH, SAMPLE = 4096, 4, 16384
#: Characters of a term's beginning at most, a power of two; that of a shorter term
#: is the greatest power of two of its characters, and up to three the term itself.
WHOLE = 8
#: Rows of a file of texts, so that small tables are scanned by many tasks too.
FILE_ROWS = 4096
#: Bits of a set of strings (8 MB): a power of two of 2^15 or more.
BITS = 1 << 26
#: Folders that the postings are dealt to.
BUCKETS = 64
#: Stands between the parts of a text.
_BETWEEN = "\1"


def _bucket(gram: Column | str) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _sorted(order: list[tuple[str, bool]]) -> list[Column]:
    return [F.desc_nulls_last(c) if falling else F.asc_nulls_first(c) for c, falling in order]


def _before(order: list[tuple[str, bool]], row: Row) -> Column:
    """Whether a row ranks before the given one."""
    out = F.lit(False)
    for (name, falling), value in reversed([*zip(order, row)]):
        c = F.col(name)
        if value is None:
            before = c.isNotNull() if falling else F.lit(False)
        else:
            before = F.coalesce(c > F.lit(value), F.lit(False)) if falling else F.coalesce(c < F.lit(value), F.lit(True))
        out = before | (c.eqNullSafe(F.lit(value)) & out)
    return out


def _tiered(rows: DataFrame, order: list[tuple[str, bool]]) -> DataFrame:
    """The rows with their tier, or as they are if one is enough. A sample settles
    where tiers end, so that their sizes are approximate but not their order; rows
    of equal rank are dealt by chance."""
    n = rows.select(*[c for c, _ in order]).count()
    if n <= FIRST:
        return rows
    chance, full = F.rand(0).alias("_chance"), [*order, ("_chance", False)]
    sample = rows.select(*[c for c, _ in order], chance).orderBy(F.rand(1)).limit(SAMPLE).orderBy(*_sorted(full)).collect()
    ends = [FIRST * GROWTH**k for k in range(n.bit_length()) if FIRST * GROWTH**k < n]
    tier = F.lit(len(ends))
    for k, end in reversed([*enumerate(ends)]):
        tier = F.when(_before(full, sample[max(1, len(sample) * end // n)]), k).otherwise(tier)
    return rows.withColumn("_chance", F.rand(2)).withColumn("tier", tier).drop("_chance")


def build_index(rows: DataFrame, path: str, text_cols: list[str], order: list[tuple[str, bool]]) -> None:
    """Indexes the texts of ``text_cols`` of all rows; nulls are empty. Repeated
    rows are indexed as often as they come; none is called id or tier. ``order`` names the columns by which
    ``search`` ranks rows, each with whether it falls (nulls last) or rises (nulls
    first); each file holds its rows in that order. ``path`` must be new."""
    spark = rows.sparkSession
    short_batches(spark)
    tiers = ["tier"] if "tier" in (rows := _tiered(rows, order)).columns else []
    rows = rows.sortWithinPartitions(*tiers, *_sorted(order)).withColumn("id", F.monotonically_increasing_id())
    rows.write.option("maxRecordsPerFile", FILE_ROWS).option("compression", "zstd").partitionBy(*tiers).parquet(f"{path}/documents")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in text_cols]
    texts = spark.read.parquet(f"{path}/documents").select("id", F.concat_ws(_BETWEEN, *parts).alias("text"))
    low, width = SEGMENT.bit_length() - 1, 21  # bits of a character

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                chars = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
                found.append(np.unique(sum(chars[k : len(chars) - GRAM + 1 + k] << width * (GRAM - 1 - k) for k in range(GRAM))))
            if found:
                codes, n = np.unique(np.concatenate(found), return_counts=True)
                chars = np.stack([codes >> width * (GRAM - 1 - k) & (1 << width) - 1 for k in range(GRAM)], axis=1)
                run = chars.astype("<u4").tobytes().decode("utf-32-le")
                yield pa.record_batch([pa.array([run[k : k + GRAM] for k in range(0, len(run), GRAM)], pa.string()), pa.array(n, pa.int64())], names=["gram", "texts"])

    counts = texts.select("text").mapInArrow(count, "gram string, texts long")
    counts.groupBy("gram").agg(F.sum("texts").alias("texts")).write.parquet(f"{path}/grams")
    rare = spark.read.parquet(f"{path}/grams").where(F.col("texts") <= LISTED * LONGER).select("gram")
    known, lengths = _bit_set(rare)

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lists of a batch, so that a gram is shuffled once for many texts."""
        for batch in batches:
            lists: dict[tuple[str, int], list[int]] = defaultdict(list)
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for gram in _strings(text, lengths, known.value):
                    lists[gram, i >> low].append(i)
            grams, segments = zip(*lists) if lists else ((), ())
            yield pa.record_batch([pa.array(grams, pa.string()), pa.array(segments, pa.int64()), pa.array(list(lists.values()), pa.list_(pa.int64()))], names=["gram", "segment", "ids"])

    lists = texts.mapInArrow(invert, "gram string, segment long, ids array<long>").withColumn("bucket", _bucket("gram"))
    whole = lists.repartition("bucket").groupBy("bucket", "gram", "segment").agg(F.sort_array(F.flatten(F.collect_list("ids"))).alias("ids"))
    whole.sortWithinPartitions("bucket", "gram", "segment").write.partitionBy("bucket").parquet(f"{path}/postings")
    known.unpersist()


def _grams(path: str, terms: DataFrame) -> DataFrame:
    """(query, gram, texts) of terms of ``GRAM`` characters or more; ``texts`` is
    null for a gram that no text has."""
    starts = F.sequence(F.lit(1), F.length("query") - GRAM + 1)
    own = F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("query"), i, GRAM)))
    return terms.where(F.length("query") >= GRAM).select("query", F.explode(own).alias("gram")).join(terms.sparkSession.read.parquet(f"{path}/grams"), "gram", "left")


def _listed(grams: DataFrame, path: str) -> DataFrame:
    """(query, id): the texts that hold the rarest grams of each term, a superset
    of those that hold the term. ``grams`` are of ``NAMED`` terms at most."""
    postings = grams.sparkSession.read.schema("gram string, segment long, ids array<long>, bucket int").parquet(f"{path}/postings")
    rare = Window.partitionBy("query").orderBy("texts", "gram")
    chosen = grams.withColumn("r", F.row_number().over(rare)).withColumn("least", F.min("texts").over(Window.partitionBy("query")))
    chosen = chosen.where((F.col("r") <= RAREST) & (F.col("texts") <= LONGER * F.col("least")))
    chosen = chosen.withColumn("lists", F.max("r").over(Window.partitionBy("query"))).select("query", "gram", "lists", _bucket("gram").alias("bucket"))
    met = F.broadcast(chosen).join(postings, ["bucket", "gram"]).groupBy("query", "segment", "lists").agg(F.collect_list("ids").alias("found")).where(F.size("found") == F.col("lists"))
    common = F.aggregate(F.slice("found", 2, RAREST), F.element_at("found", 1), lambda a, b: F.array_intersect(a, b))
    return met.select("query", F.explode(common).alias("id"))


#: What hashes are mixed with; where in its hash a string's places in a bit set begin.
_ODD, _MIX, _SHIFTS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), (0, 19, 37)
_BIT = (1 << np.arange(8)).astype(np.uint8)


def _mixed(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(29))) * _MIX


def _windows(text: str, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each of the ascending sizes a hash of every stretch of so many characters."""
    n = len(text)
    h, w = _mixed(np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) * _ODD + _ODD), 1
    for size in sizes:
        if size > n:
            return
        while 2 * w <= size:  # two halves
            h, w = _mixed(h[:-w] * _ODD + h[w:]), 2 * w
        h_size = h if size == w else _mixed(h[: n - size + 1] * _ODD + h[size - w : n - w + 1])  # two pieces that may overlap
        yield size, h_size ^ (h_size >> np.uint64(32))


def _whole(hashes: np.ndarray, size: int, at: np.ndarray, n: int | np.ndarray, pieces: int) -> np.ndarray:
    """Hashes of the strings of n characters that begin at ``at``, by those of their
    pieces of ``size`` characters, the last of which may overlap."""
    h = hashes[at]
    for rest in [*[k * size for k in range(1, pieces - 1)], n - size]:
        h = _mixed(h * _ODD + hashes[at + rest])
    return h ^ (h >> np.uint64(32))


#: The lengths of strings by that of their beginnings, ascending, and by pieces.
Lengths = dict[int, dict[int, list[int]]]


def _by_size(lengths: list[int]) -> Lengths:
    out: Lengths = {}
    for n in sorted(lengths):
        size = n if n < 4 else min(WHOLE, 1 << (n.bit_length() - 1))
        out.setdefault(size, {}).setdefault(-(-n // size), []).append(n)
    return out


def _place(hashes: np.ndarray, shift: int, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(shift) & np.uint64(bits - 1)).view(np.int64)


def _held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where the hashes are that the set may hold."""
    at = None
    for shift in _SHIFTS:
        place = _place(hashes if at is None else hashes[at], shift, 8 * len(bits))
        held = np.flatnonzero(np.take(bits, place >> 3, mode="clip") & np.take(_BIT, place & 7, mode="clip"))
        at = held if at is None else at[held]
        if not len(at):
            break
    return at


def _strings(text: str, lengths: Lengths, bits: np.ndarray) -> set[str]:
    """The stretches of the text that the set may hold, of the lengths given."""
    found: set[str] = set()
    for size, hashes in _windows(text, [*lengths]):
        begun = _held(bits, hashes)
        for pieces, own in lengths[size].items() if len(begun) else ():
            at, n = np.repeat(begun, len(own)), np.tile(own, len(begun))
            whole = at + n <= len(text)
            at, n = at[whole], n[whole]
            held = _held(bits, _whole(hashes, size, at, n, pieces))
            found.update([text[a:b] for a, b in zip(at[held].tolist(), (at + n)[held].tolist())])
    return found


def _bit_set(strings: DataFrame) -> tuple[Broadcast, Lengths]:
    """A set of ``BITS`` bits of the beginnings of the strings of the only column and
    of the whole strings, with their lengths, for ``_strings``."""
    n_bits, name = BITS, strings.columns[0]
    lengths = _by_size([r[0] for r in strings.select(F.length(name)).distinct().collect()])
    parts_of = {n: (size, pieces) for size, of in lengths.items() for pieces, own in of.items() for n in own}

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_length: dict[int, list[str]] = defaultdict(list)
            for string in batch.column(0).to_pylist():
                by_length[len(string)].append(string)
            for n, own in by_length.items():
                size, pieces = parts_of[n]
                hashes, at = next(_windows("".join(own), [size]))[1], np.arange(0, n * len(own), n)
                flat = np.concatenate([hashes[at], _whole(hashes, size, at, n, pieces)])
                yield pa.record_batch([pa.array(np.concatenate([_place(flat, s, n_bits) for s in _SHIFTS]) + 1)], names=["place"])

    marked = strings.mapInArrow(places, "place long")
    pages = marked.groupBy(F.bitmap_bucket_number("place").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    bits = np.zeros(n_bits // 8, np.uint8)
    for page in pages.collect():  # BITS in all
        bits[(page["page"] - 1) * 4096 : page["page"] * 4096] = np.frombuffer(page["bits"], np.uint8)
    return strings.sparkSession.sparkContext.broadcast(bits), lengths


def _passed_on(documents: DataFrame, text_cols: list[str], sets: list[tuple[Broadcast, Lengths]], limit: int) -> DataFrame:
    """(query, id, led) of the strings in the sets, the first for the first column
    (``led``) and the other for the rest, and of a few others. A task passes on no
    string more than ``limit`` times for a file, since rows of a file lie in the
    order of ranks; ``led`` rows count by themselves."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = -1, Counter()
        for batch in batches:
            out: list[tuple[str, int, bool]] = []
            columns = [c.to_pylist() for c in batch.columns[1:]]
            for k, i in enumerate(batch.column(0).to_pylist()):
                if i <= last or i >> 33 != last >> 33:  # rows in order share the upper bits
                    seen = Counter()
                last, own = i, set()
                for c, texts in enumerate(columns):
                    known, lengths = sets[c > 0]
                    for string in _strings(texts[k] or "", lengths, known.value):
                        if string not in own and seen[c == 0, string] < limit:
                            seen[c == 0, string] += 1
                            out.append((string, i, c == 0))
                        own.add(string)
            strings, ids, led = zip(*out) if out else ((), (), ())
            yield pa.record_batch([pa.array(strings, pa.string()), pa.array(ids, pa.int64()), pa.array(led, pa.bool_())], names=["query", "id", "led"])

    return documents.select("id", *[F.col(c).cast("string") for c in text_cols]).mapInArrow(scan, _HITS)


_HITS = "query string, id long, led boolean"


def _scanned(terms: DataFrame, path: str, text_cols: list[str], limit: int) -> DataFrame:
    """(query, id, led): texts that hold each term, among them the best ``limit``;
    ``led``: in the first column. What a tier has is stored under ``path``. After
    it a term with ``limit`` rows is looked for in the first column only, and one
    with ``limit`` such rows no more: what is left ranks behind them."""
    spark, documents = terms.sparkSession, terms.sparkSession.read.parquet(f"{path}/documents")
    tiers = sorted(r["tier"] for r in documents.select("tier").distinct().collect()) if "tier" in documents.columns else []
    sets, at = [_bit_set(terms)] * 2, f"{path}/found/{uuid.uuid4().hex}"
    if len(tiers) < 2:
        return _passed_on(documents, text_cols, sets, limit).join(terms, "query")
    for tier in tiers:
        _passed_on(documents.where(F.col("tier") == tier), text_cols, sets, limit).write.parquet(f"{at}/tier={tier}")
        for known, _ in sets:
            known.unpersist()
        found = spark.read.schema(_HITS).parquet(*[f"{at}/tier={t}" for t in tiers if t <= tier])
        if tier != tiers[-1]:
            counts = found.groupBy("query").agg(F.count("*").alias("n"), F.count_if("led").alias("n_led"))
            terms.join(counts, "query", "left").select("query", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "n_led")]).write.parquet(f"{at}/counts-{tier}")
            counts = spark.read.parquet(f"{at}/counts-{tier}")
            sets = [_bit_set(counts.where(F.col(c) < limit).select("query")) for c in ("n_led", "n")]
    return found.join(terms, "query")


def search(spark: SparkSession, queries: DataFrame, path: str, first: str, order: list[tuple[str, bool]], limit: int, text_cols: list[str]) -> DataFrame:
    """query_id, rank, the indexed columns and ``in_<first>`` of the best
    ``limit`` rows that hold each query of two characters or more: those with it
    in column ``first`` before the others, then by ``order``, the index's own."""
    documents = spark.read.parquet(f"{path}/documents").drop("tier")
    terms = queries.where(F.length("query") >= GRAM - 1).select("query").distinct()
    # A term with a gram that no text has is in none.
    counted = _grams(path, terms).groupBy("query").agg(F.min("texts").alias("least"), F.count_if(F.col("texts").isNull()).alias("lacking"))
    asked = f"{path}/asked/{uuid.uuid4().hex}"
    terms.join(counted, "query", "left").where("coalesce(lacking, 0) = 0").select("query", "least").write.parquet(asked)
    terms, most, named = spark.read.parquet(asked), 0, 0
    for r in terms.where(f"least <= {LISTED}").groupBy("least").count().orderBy("least").collect():
        if (named := named + r["least"] * r["count"]) > NAMED:
            break
        most = r["least"]
    rare, rest = terms.where(f"least <= {most}").select("query"), terms.where(f"least is null or least > {most}").select("query")

    contained = [F.coalesce(F.contains(F.col(c), F.col("query")), F.lit(False)) for c in text_cols]
    listed = documents.select("id", *text_cols).join(F.broadcast(_listed(_grams(path, rare), path)), "id")
    listed = listed.select("query", "id", contained[text_cols.index(first)].alias("led"), F.greatest(*contained, F.lit(False)).alias("held")).where("held").drop("held")
    hits = listed.union(_scanned(rest, path, [first, *[c for c in text_cols if c != first]], limit))

    shown = documents.drop(*[c for c in text_cols if c != first])
    hits = hits.withColumnRenamed("led", f"in_{first}").join(shown, "id")
    best = Window.partitionBy("query").orderBy(F.desc(f"in_{first}"), *_sorted(order), "id")
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    return queries.select("query_id", "query").join(ranked, "query").drop("query", "id")
