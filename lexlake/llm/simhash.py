"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are laid out in tiles. Tile pairs whose population counts
(or sizes) differ beyond the radius are skipped; the others are compared with
numpy exclusive-or and bit counts, so no pair within the radius is lost. A
comparison gives a spanning forest of its links, never all pairs of a group.

* Up to radius 3, a tile is a vector of population counts of equal bit
  segments; a fingerprint goes to its own tile and to those later tiles whose
  counts differ by at most the radius in sum. That stays close to linear.
* Beyond, tiles are ranges of (size, population count), compared pairwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.llm import signature_join
from lexlake.llm.common import LEAST_ID, components, if_small, partitions, range_bounds, range_of, row_key, short_batches, stored

#: Shingles hashed at a time, for very long texts.
_SLICE = 1 << 12
#: Rows and columns compared at a time.
_ROWS, _COLUMNS = 256, 8192
#: Pairs whose further lanes are compared at a time.
_PAIRS = 1 << 15
#: Range tiles of a table: of so many rows at least, and as many tiles as need
#: be for so many rows at most. A task holds the rows of one tile.
_LEAST_TILE, _USUAL_TILES, _MOST_ROWS = 2048, 48, 500_000
#: Rows of later tiles that a task holds at a time; rows of a batch it sends.
_LATER, _SEND = 1 << 14, 1 << 12
#: Odd constants of the further lanes.
_SPREAD = np.random.default_rng(64).integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Lanes that are compared first.
_COARSE = 2


def shingle_hashes(text: str | None, size: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of ``size`` words, repeats included, in slices.

    A-Z is lower-cased, words are separated by ASCII white space. Fewer words
    make one shingle; no word makes none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(size, len(words))
    starts, ends = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for lo in range(0, len(starts), _SLICE):
        hi = min(lo + _SLICE, len(starts))
        yield np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[lo:hi], ends[lo:hi])), dtype=np.uint64, count=hi - lo)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct hashes of ``shingle_hashes``, in order."""
    return np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *shingle_hashes(text, size)]))


def simhash(text: str | None, size: int, lanes: int = 1, count: bool = False) -> tuple[np.ndarray, int, int]:
    """``lanes`` words of 64 bits; if asked to ``count``, of the distinct
    shingles only, with their number and a digest of their set (else 0, 0). A
    bit is 1 if set in over half the hashes; lane 0 is made of the hashes
    themselves, further lanes of mixed ones. No word: zeros."""
    total, n, distinct, digest = np.zeros(64 * lanes, dtype=np.int64), 0, 0, 0
    parts = shingle_hashes(text, size)
    if count:
        whole = shingle_set(text, size)
        distinct, digest = len(whole), int(np.uint64(xxhash.xxh64_intdigest(whole.tobytes())).view(np.int64))
        parts = (whole[lo : lo + _SLICE] for lo in range(0, distinct, _SLICE))
    for h in parts:
        mixed = np.empty((len(h), lanes), dtype="<u8")
        mixed[:, 0] = h
        for k in range(1, lanes):
            x = (h ^ _SPREAD[k]) * _SPREAD[0]
            x = (x ^ (x >> np.uint64(29))) * _SPREAD[k]
            mixed[:, k] = x ^ (x >> np.uint64(32))
        bits = np.unpackbits(mixed.view(np.uint8).reshape(len(h), 8 * lanes), axis=1, bitorder="little")
        # Bytes hold the sums of 255 rows, which is the fast way to add them up.
        total += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        n += len(h)
    return np.packbits(total * 2 > n, bitorder="little").view("<u8"), distinct, digest


def fingerprints(docs: DataFrame, shingle: int, lanes: int = 1, count: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key (``row_key``), text_hash, fp (bytes), and n_shingles
    (distinct ones) and set_hash if asked to ``count`` (else 0) of each row."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(t, shingle, lanes, count) for t in batch.column(2).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([f.tobytes() for f, _, _ in found], pa.binary()), *(pa.array([f[k] for f in found], pa.int64()) for k in (1, 2))],
                names=["key", "text_hash", "fp", "n_shingles", "set_hash"],
            )

    rows = docs.select(row_key(id_col, text_col).alias("key"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), text_col)
    return rows.mapInArrow(run, "key long, text_hash long, fp binary, n_shingles long, set_hash long")


class Forest:
    """Union of linked rows; the smallest index is the root."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        while True:
            above = self.parent[rows]
            if (above == rows).all():
                return rows
            rows = above

    def link(self, i: int, others: np.ndarray) -> None:
        rows = np.append(others, i)
        roots = np.unique(self.roots(rows))
        if len(roots) > 1:
            self.parent[roots] = roots[0]
        self.parent[rows] = roots[0]


def _distances(a: np.ndarray, b: np.ndarray, radius: int, coarse: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers within the radius whose first lanes are within
    ``coarse``; a, b: (rows, lanes) of uint64."""
    first = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
    for k in range(1, min(_COARSE, a.shape[1])):
        first = first + np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    row, column = np.nonzero(first <= min(coarse, radius))
    if a.shape[1] > _COARSE:
        near = np.zeros(len(row), dtype=bool)
        for lo in range(0, len(row), _PAIRS):
            at = slice(lo, lo + _PAIRS)
            rest = np.bitwise_count(a[row[at], _COARSE:] ^ b[column[at], _COARSE:]).sum(axis=1, dtype=np.int64)
            near[at] = first[row[at], column[at]] + rest <= radius
        row, column = row[near], column[near]
    return row, column


class Tile:
    """The rows of one tile with a spanning forest of their links, that later
    rows join piece by piece: only the tile itself stays in memory."""

    def __init__(self, nodes: np.ndarray, fps: np.ndarray, sizes: np.ndarray, radius: int, likeness: float = 0.0, coarse: int = 64 * _COARSE) -> None:
        self.nodes, self.fps, self.sizes = nodes, fps, sizes
        self.radius, self.likeness, self.coarse = radius, likeness, coarse
        self.forest = Forest(len(nodes))

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """Links (node, other node) within the tile."""
        return self._joined(self.nodes, self.fps, self.sizes, 0)

    def later(self, nodes: np.ndarray, fps: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of the tile's rows with others, not of those with each other."""
        return self._joined(nodes, fps, sizes, len(self.nodes))

    def _joined(self, nodes: np.ndarray, fps: np.ndarray, sizes: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        home, every = len(self.nodes), np.arange(first + len(nodes))
        self.forest.parent = np.concatenate([self.forest.parent, every[home:]])
        was_root = self.forest.parent == every
        for lo in range(0, home, _ROWS):
            for left in range(0 if first else lo, len(nodes), _COLUMNS):
                row, column = _distances(self.fps[lo : lo + _ROWS], fps[left : left + _COLUMNS], self.radius, self.coarse)
                row, column = row + lo, column + left
                ok = column + first > row
                if self.likeness:
                    x, y = self.sizes[row], sizes[column]
                    ok &= np.minimum(x, y) >= self.likeness * np.maximum(x, y)
                for i, part in zip(*_runs(row[ok], column[ok] + first)):
                    self.forest.link(i, part)
        root = self.forest.roots(every)
        at = np.flatnonzero(was_root & (root != every))
        named = np.concatenate([self.nodes, nodes]) if first else nodes
        self.forest.parent = root[:home]
        return named[at], named[root[at]]


def _runs(row: np.ndarray, column: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    if not len(row):
        return [], []
    cuts = np.flatnonzero(np.diff(row)) + 1
    return row[np.concatenate([[0], cuts])].tolist(), np.split(column, cuts)


_LINKS = "u long, v long"
_SENT = "tile long, home int, node long, size long, fp binary"


def _compared(sent: DataFrame, radius: int, likeness: float, coarse: int, n: int) -> DataFrame:
    """Streams the sorted rows of each tile into one comparison after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        tile, current = None, None

        def linked() -> pa.RecordBatch:
            nonlocal tile
            rows = [np.concatenate([part[k] for part in held]) for k in range(3)]
            held.clear()
            if tile is None:
                tile = Tile(*rows, radius, likeness, coarse)
                u, v = tile.own()
            else:
                u, v = tile.later(*rows)
            return pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            at, home, node, size = (batch.column(k).to_numpy() for k in range(4))
            fp = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype="<u8").reshape(len(at), -1)
            cuts = [0, *(np.flatnonzero(np.diff(at) | np.diff(home)) + 1).tolist(), len(at)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if held and (current != (at[a], home[a]) or (tile is not None and sum(len(part[0]) for part in held) >= _LATER)):
                    yield linked()
                if current is None or current[0] != at[a]:
                    # A tile without rows of its own has nothing to compare.
                    tile = Tile(node[:0], fp[:0], size[:0], radius) if home[a] else None
                current = at[a], home[a]
                held.append((node[a:b], fp[a:b], size[a:b]))
        if held:
            yield linked()

    sorted_ = sent.repartition(n, "tile").sortWithinPartitions("tile", "home", "node")
    return sorted_.mapInArrow(run, _LINKS)


def _signature_tiles(nodes: DataFrame, n_nodes: int, radius: int) -> DataFrame:
    """Own tile (home 0) and the later tiles within reach (home 1)."""
    segments = 4 if n_nodes <= 4_000_000 else 8 if n_nodes <= 200_000_000 else 16
    width = 64 // segments
    reach = _half_ball(segments, radius)
    weights = (width + 1) ** np.arange(segments, dtype=np.int64) if segments < 16 else 5 ** np.arange(16, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8)
            counts = np.unpackbits(raw.reshape(-1, 8), axis=1, bitorder="little").reshape(-1, segments, width).sum(axis=2, dtype=np.int64)
            for lo in range(0, len(reach), 64):  # keeps the batches short
                goals = counts[:, None, :] + reach[None, lo : lo + 64, :]
                row, k = np.nonzero(((goals >= 0) & (goals <= width)).all(axis=2))
                tile = (goals[row, k] * weights).sum(axis=1)
                at = pa.array(row)
                yield pa.record_batch(
                    [pa.array(tile), pa.array((k + lo > 0).astype(np.int32)), batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at)],
                    names=["tile", "home", "node", "size", "fp"],
                )

    return nodes.mapInArrow(run, _SENT)


def _half_ball(segments: int, radius: int) -> np.ndarray:
    """The zero vector, then one of each ±v with |v| in sum at most the radius."""
    found = [(0,) * segments]

    def grow(prefix: tuple[int, ...], left: int) -> None:
        if len(prefix) == segments:
            if any(prefix) and next(x for x in prefix if x) > 0:
                found.append(prefix)
            return
        for x in range(-left, left + 1):
            grow((*prefix, x), left - abs(x))

    grow((), radius)
    return np.array(found, dtype=np.int64)


def _range_tiles(nodes: DataFrame, n_nodes: int, radius: int, likeness: float) -> DataFrame:
    """Each pair of tiles that can hold a link is one task's comparison: the
    earlier tile is its home. A tile with itself is a comparison as well."""
    n_tiles = int(np.clip(n_nodes // _LEAST_TILE, 1, max(_USUAL_TILES, n_nodes // _MOST_ROWS)))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fp = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype="<u8").reshape(batch.num_rows, -1)
                pop = np.bitwise_count(fp).sum(axis=1, dtype=np.int64)
                size = np.minimum(batch.column(1).to_numpy(), 1 << 30)
                # size, population count, then bits of the fingerprint: below 2**53
                key = (size << 22) | (np.minimum(pop >> 1, 1023) << 12) | (fp[:, 0] >> np.uint64(52)).astype(np.int64)
                yield pa.record_batch([*batch.columns, pa.array(pop), pa.array(key)], names=["node", "size", "fp", "pop", "k"])

    rows = stored(nodes.mapInArrow(keyed, "node long, size long, fp binary, pop long, k long"))
    bounds = range_bounds(rows, F.col("k"), n_tiles)

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = range_of(bounds, batch.column(2).to_numpy()).astype(np.int64)
            yield pa.record_batch([pa.array(t), batch.column(0), batch.column(1)], names=["t", "size", "pop"])

    extent = rows.select("size", "pop", "k").mapInArrow(tiled, "t long, size long, pop long")
    extent = extent.groupBy("t").agg(F.min("size"), F.max("size"), F.min("pop"), F.max("pop")).collect()  # a row a tile
    pairs = [
        (a[0], b[0])
        for a, b in product(extent, extent)
        if a[0] <= b[0] and a[4] + radius >= b[3] and b[4] + radius >= a[3] and a[2] >= likeness * b[1] and b[2] >= likeness * a[1]
    ]
    partners: dict[int, list[tuple[int, int]]] = {}
    for a, b in pairs:
        partners.setdefault(a, []).append((a * n_tiles + b, 0))
        if a != b:
            partners.setdefault(b, []).append((a * n_tiles + b, 1))
    goals = {t: np.array(v, dtype=np.int64) for t, v in partners.items()}

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = range_of(bounds, batch.column(3).to_numpy())
            for x in np.unique(t).tolist():
                mine = batch.select(["node", "size", "fp"]).take(pa.array(np.flatnonzero(t == x)))
                many = max(1, _SEND // mine.num_rows)
                for lo in range(0, len(goals[x]), many):
                    goal = goals[x][lo : lo + many]
                    at = pa.array(np.tile(np.arange(mine.num_rows), len(goal)))
                    tile, home = (pa.array(np.repeat(goal[:, k], mine.num_rows).astype(kind)) for k, kind in ((0, np.int64), (1, np.int32)))
                    yield pa.record_batch([tile, home, *mine.take(at).columns], names=["tile", "home", "node", "size", "fp"])

    return rows.select("node", "size", "fp", "k").mapInArrow(sent, _SENT)


def links(nodes: DataFrame, radius: int, likeness: float = 0.0, coarse: int = 64 * _COARSE) -> DataFrame:
    """(u, v) of spanning forests of all links within the radius, and within
    ``coarse`` in the first two lanes (the default rules nothing out).

    nodes: node, size, fp, each (size, fp) once. ``likeness``: least ratio of
    two sizes, 0 for none (all sizes are 0 then).
    """
    spark = nodes.sparkSession
    short_batches(spark)
    n_nodes = nodes.count()
    if radius <= 3 and not likeness:
        sent = _signature_tiles(nodes, n_nodes, radius)
    else:
        sent = _range_tiles(nodes, n_nodes, radius, likeness)
    return _compared(sent, radius, likeness, coarse, partitions(spark))


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """node, n and body: the distinct shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "n", "body"])

    return texts.select("node", "text").mapInArrow(run, "node long, n long, body binary")


def near_duplicates(docs: DataFrame, shingle: int, radius: int, lanes: int = 1, likeness: float = 0.0, coarse: int = 64 * _COARSE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: key, text_hash, fp, component (key of the smallest
    id reachable over links of at most ``radius`` bits, itself included).

    ``likeness``: least Jaccard similarity of two texts' shingle sets, in whole
    hundredths. Links within the radius then only make groups of candidates, whose
    sets decide, by signature trees. Null text is empty text; texts without a word
    have fingerprint zero and link like any other. Rows of one id are one node. Rows without an id are nodes of
    their own for each text, and count as smaller than any id (ids lie above -2**62). Equal fingerprints
    are one node, so repeated rows and groups of copies cost one comparison. An
    empty table gives no rows. Other columns are ignored.
    """
    rows = stored(fingerprints(docs, shingle, lanes, likeness > 0, id_col, text_col))
    same = ["fp", "n_shingles", "set_hash"]
    least = F.min(F.struct("key", "text_hash"))
    nodes = stored(rows.groupBy(*same).agg(least.alias("l")).select(F.col("l.key").alias("node"), "l.text_hash", F.col("n_shingles").alias("size"), "fp", "set_hash"))
    found = components(links(nodes.select("node", "size", "fp"), radius, likeness, coarse))
    if likeness:
        found = stored(found)
        wanted = stored(nodes.join(if_small(found.select("node")), "node", "left_semi").select("node", F.col("node").alias("key"), "text_hash"))
        texts = docs.select(row_key(id_col, text_col).alias("key"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))
        texts = texts.join(if_small(wanted), ["key", "text_hash"]).dropDuplicates(["node", "text_hash"])
        found = components(signature_join.verified(_sets(texts, shingle), found, round(100 * likeness)))
    named = nodes.join(found, "node", "left").select(F.col("size").alias("n_shingles"), "fp", "set_hash", F.coalesce("component", "node").alias("component"))
    return rows.join(named, same).select("key", "text_hash", "fp", "component")


def hex_digits(fp: str = "fp") -> F.Column:
    """16 hex digits, highest bit first, of a one-lane fingerprint."""
    return F.lower(F.hex(F.concat(*[F.substring(F.col(fp), i, 1) for i in range(8, 0, -1)])))


def from_key(key: str) -> F.Column:
    """The id of a key: null again where it stands for null."""
    return F.when(F.col(key) >= LEAST_ID, F.col(key))
