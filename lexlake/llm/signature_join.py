"""N-gram Jaccard join with signature trees.

A text's set holds the distinct hashes of its shingles. Texts of equal sets are
one node. A node's signature is a bitmap of its hashes; a signature tree over
some nodes keeps, in each inner node, the OR of the bitmaps below and the range
of sizes. Two trees are descended together and a pair of tree nodes is left
when no pair below can overlap enough, or when all below are linked already.

1. Every two sets that are alike enough share a hash among the first few of
   each in one fixed order (rare hashes first). So the trees are those of the
   sets that share such a hash: a forest dealt over tasks by hash.
2. These trees hold bitmaps alone; their descent leaves pairs that may link.
   Only a spanning forest of them is kept, so a group of copies costs its size.
3. The components of these pairs get trees with the sets themselves: the exact
   similarity decides. A large component is cut into tiles; those that are
   linked throughout need no comparison with each other.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.llm.common import components, if_small, partitions, row_key, short_batches, stored

#: Counters of the sketch of document frequencies, and rows that a task sends it in.
_COUNTERS, _PARTS = 1 << 18, 16
#: Bytes of text that are worked on at a time; a longer text is alone.
_SLICE_BYTES = 4 << 20
#: Distinct sets that a task remembers so as not to send copies.
_SEEN = 500_000
#: Children of a tree node.
_FANOUT = 8
#: Sets of a group that one task holds. More than that sharing a hash are one
#: group of candidates at once; more in a component are cut into tiles.
_MOST_SHARING, _TILE = 4096, 256
_MIX = np.random.default_rng(12).integers(0, 2**63, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def most_differing(a: int, b: int, percent: int) -> int:
    """Elements in only one of two sets of these sizes whose Jaccard similarity
    is at least ``percent``: the largest number possible."""
    return (100 - percent) * (a + b) // (100 + percent)


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending.

    A-Z is lower-cased; words are separated by ASCII white space. Fewer words
    make one shingle, no word makes none.
    """
    part, n_bytes = [], 0
    for text in texts:
        raw = (text or "").encode().lower()
        if part and n_bytes + len(raw) > _SLICE_BYTES:
            yield from _sets_of(part, size)
            part, n_bytes = [], 0
        part.append(raw)
        n_bytes += len(raw)
    yield from _sets_of(part, size)


def _sets_of(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    words = [t.split() for t in texts]
    lengths = [len(w) for w in words]
    number: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter((number[w] for part in words for w in part), dtype=np.int64, count=sum(lengths))
    digest = xxhash.xxh64_intdigest
    hashed = np.fromiter((digest(w) for w in number), dtype=np.uint64, count=len(number))[ids]
    del words, number, ids
    lo = 0
    for n in lengths:
        own, lo, k = hashed[lo : lo + n], lo + n, min(n, size)
        h = np.full(max(n - k + 1, 0) if n else 0, k, dtype=np.uint64)
        for i in range(k):
            h = (h + own[i : i + len(h)]) * _MIX[0]
            h = (h ^ (h >> np.uint64(29))) * _MIX[1]
            h ^= h >> np.uint64(32)
        yield np.unique(h)


def set_digest(hashes: np.ndarray) -> int:
    """Names a set among all sets."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 12)).view(np.int64))


def _width(n: int) -> int:
    return max(64, 1 << (2 * n - 1).bit_length())


def bitmap(hashes: np.ndarray) -> bytes:
    """A bit for each hash, two to four times as many bits as hashes."""
    width = _width(len(hashes))
    bits = np.zeros(width, dtype=np.uint8)
    bits[(hashes & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(bits: int, width: int, narrow: int) -> int:
    """A bitmap of ``narrow`` bits out of a wider one."""
    while width > narrow:
        width //= 2
        bits = (bits >> width) | (bits & ((1 << width) - 1))
    return bits


class _Node:
    """Bitmaps combined by OR, the range of sizes, the least number of bits of a
    set, and whether all below are linked."""

    __slots__ = ("bits", "width", "least", "most", "fewest", "below", "row", "whole")

    def __init__(self, below: list[_Node] | None = None, row: int = -1, bits: int = 0, size: int = 0) -> None:
        self.below, self.row, self.whole = below, row, below is None
        if below is None:
            self.bits, self.width, self.least, self.most, self.fewest = bits, _width(size), size, size, bits.bit_count()
            return
        self.width = min(n.width for n in below)
        self.least, self.most = min(n.least for n in below), max(n.most for n in below)
        self.bits, fewest = 0, []
        for n in below:
            self.bits |= _folded(n.bits, n.width, self.width)
            # Folding can merge the two halves bit for bit.
            fewest.append(n.fewest if n.width == self.width else -(-n.fewest * self.width // n.width))
        self.fewest = min(fewest)
        self.row = below[0].row


class SignatureForest:
    """Links among sets (``sizes``, ``bits``: bitmaps as integers), found by
    descending signature trees together. ``alike(i, j)`` has the last word on
    a pair whose bitmaps allow it; ``labels``: what is linked from the start."""

    def __init__(self, sizes: list[int], bits: list[int], percent: int, alike: Callable[[int, int], bool] | None = None, labels: list[int] | None = None) -> None:
        self.sizes, self.bits, self.percent, self.alike = sizes, bits, percent, alike
        self.parent = list(range(len(sizes)))
        first: dict[int, int] = {}
        for i, label in enumerate(labels or []):
            self.parent[i] = first.setdefault(label, i)
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def tree(self, rows: list[int]) -> _Node:
        """Over the rows in order of linked set, size and bitmap."""
        rows = sorted(rows, key=lambda i: (self.root(i), self.sizes[i], self.bits[i]))
        nodes = [_Node(row=i, bits=self.bits[i], size=self.sizes[i]) for i in rows]
        while len(nodes) > 1:
            nodes = [_Node(nodes[k : k + _FANOUT]) for k in range(0, len(nodes), _FANOUT)]
        return nodes[0]

    def _linked(self, node: _Node) -> bool:
        if not node.whole:
            root = self.root(node.row)
            node.whole = all(self._linked(n) and self.root(n.row) == root for n in node.below)
        return node.whole

    def _possible(self, a: _Node, b: _Node) -> bool:
        if 100 * a.most < self.percent * b.least or 100 * b.most < self.percent * a.least:
            return False
        width = min(a.width, b.width)
        if a.width == b.width:
            shared, fewest = (a.bits & b.bits).bit_count(), a.fewest + b.fewest
        else:
            x, y = _folded(a.bits, a.width, width), _folded(b.bits, b.width, width)
            shared = (x & y).bit_count()
            fewest = sum((s.bit_count() if n.below is None else -(-n.fewest * width // n.width)) for n, s in ((a, x), (b, y)))
        return fewest - 2 * shared <= most_differing(a.most, b.most, self.percent)

    def descend(self, a: _Node, b: _Node) -> None:
        """Links between the rows of two trees, or of one with itself."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a is b:
                if a.below is not None and not self._linked(a):
                    parts = a.below
                    todo += [(parts[i], parts[j]) for i in range(len(parts)) for j in range(i + 1, len(parts))]
                    todo += [(n, n) for n in parts]  # popped first: neighbours link early
                continue
            if self._linked(a) and self._linked(b) and self.root(a.row) == self.root(b.row):
                continue
            if not self._possible(a, b):
                continue
            if a.below is None and b.below is None:
                if self.alike is None or self.alike(a.row, b.row):
                    self.links.append((a.row, b.row))
                    x, y = self.root(a.row), self.root(b.row)
                    self.parent[max(x, y)] = min(x, y)
            elif b.below is None or (a.below is not None and a.most - a.least >= b.most - b.least):
                todo += [(n, b) for n in a.below]
            else:
                todo += [(a, n) for n in b.below]


def _exactly(sets: list[np.ndarray], percent: int) -> Callable[[int, int], bool]:
    def alike(i: int, j: int) -> bool:
        a, b = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
        same = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
        return 100 * same >= percent * (len(a) + len(b) - same)

    return alike


def _summaries(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """key, n, node of each row; at a task's end its sketch of shingle counts (part, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(_COUNTERS, dtype=np.int64)
        names = ["key", "n", "node", "part", "counts"]
        for batch in batches:
            n, node = [], []
            for hashes in shingle_sets(batch.column(1).to_pylist(), size):
                n.append(len(hashes))
                node.append(set_digest(hashes))
                np.add.at(sketch, (hashes >> np.uint64(46)).astype(np.int64), 1)
            rows = len(n)
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=names)
        if sketch.any():
            parts = [p.tobytes() for p in sketch.reshape(_PARTS, -1)]
            none = pa.nulls(_PARTS, pa.int64())
            yield pa.record_batch([none, none, none, pa.array(range(_PARTS), pa.int32()), pa.array(parts, pa.binary())], names=names)

    rows = docs.select(row_key(id_col, text_col).alias("key"), text_col)
    return rows.mapInArrow(run, "key long, n long, node long, part int, counts binary")


def _sketch(summaries: DataFrame) -> np.ndarray:
    """The classes (binary logarithms) of the tasks' summed counters: 256 kB."""

    def add(key, pdf):
        total = np.zeros(_COUNTERS // _PARTS, dtype=np.int64)
        for raw in pdf["counts"]:
            total += np.frombuffer(raw, dtype=np.int64)
        return type(pdf)({"part": [key[0]], "classes": [np.log2(total + 1).astype(np.uint8).tobytes()]})

    found = summaries.where("part is not null").select("part", "counts").groupBy("part").applyInPandas(add, "part int, classes binary")
    out = np.zeros((_PARTS, _COUNTERS // _PARTS), dtype=np.uint8)
    for r in found.collect():  # one row a part
        out[r["part"]] = np.frombuffer(r["classes"], dtype=np.uint8)
    return out.reshape(-1)


def _prefixes(docs: DataFrame, classes, size: int, percent: int, text_col: str) -> DataFrame:
    """node, n, bits and prefix (the first hashes in the fixed order) of the sets
    with a shingle; a task sends a set once, different tasks may send it again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, seen = classes.value, set()
        for batch in batches:
            node, n, bits, prefix = [], [], [], []
            for hashes in shingle_sets(batch.column(0).to_pylist(), size):
                name = set_digest(hashes)
                if not len(hashes) or name in seen:
                    continue
                if len(seen) < _SEEN:
                    seen.add(name)
                most = len(hashes) - -(-percent * len(hashes) // 100) + 1
                order = np.lexsort([hashes, of[(hashes >> np.uint64(46)).astype(np.int64)]])[:most]
                node.append(name)
                n.append(len(hashes))
                bits.append(bitmap(hashes))
                prefix.append(hashes[order].view(np.int64))
            yield pa.record_batch([pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(bits, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))], names=["node", "n", "bits", "prefix"])

    return docs.select(text_col).mapInArrow(run, "node long, n long, bits binary, prefix array<long>")


def _forest_links(rows: DataFrame, percent: int, exact: bool) -> DataFrame:
    """(u, v): links within each group. rows: g, h (a group), side (rows of
    different sides only, null for all), label (rows of one label are linked
    already), node, and body: the bitmap, or if ``exact`` the hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None

        def links() -> pa.RecordBatch:
            side, label, node, n, body = zip(*held)
            sets = [np.frombuffer(x, dtype=np.uint64) for x in body] if exact else []
            bits = [int.from_bytes(bitmap(x) if exact else x, "little") for x in (sets if exact else body)]
            forest = SignatureForest(list(n), bits, percent, _exactly(sets, percent) if exact else None, list(label))
            left, right = [i for i, s in enumerate(side) if s == 0], [i for i, s in enumerate(side) if s == 1]
            if left and right:
                forest.descend(forest.tree(left), forest.tree(right))
            else:
                whole = forest.tree(left or right)
                forest.descend(whole, whole)
            u, v = ([node[pair[k]] for pair in forest.links] for k in (0, 1))
            return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            for g, h, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (g, h) != current:
                    if len(held) > 1:
                        yield links()
                    held.clear()
                current = g, h
                held.append(row)
        if len(held) > 1:
            yield links()

    sorted_ = rows.select("g", "h", "side", "label", "node", "n", "body").repartition(partitions(rows.sparkSession), "g", "h").sortWithinPartitions("g", "h", "node")
    return sorted_.mapInArrow(run, "u long, v long")


def _candidates(nodes: DataFrame, percent: int) -> DataFrame:
    """(u, v): a spanning forest of the pairs that share a hash of their prefixes
    and whose bitmaps allow the similarity (or that a very large group shares)."""
    keyed = nodes.select("node", F.explode("prefix").alias("g"))
    # Hashes that the same sets share are one group: sums tell the sets apart.
    same = F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("same")
    groups = keyed.groupBy("g").agg(F.count("*").alias("size"), same, F.min("node").alias("least")).where("size > 1")
    groups = stored(groups.groupBy("size", "same").agg(F.min("g").alias("g"), F.min("least").alias("least")))
    shared = stored(keyed.join(if_small(groups.select("g", "size", "least")), "g"))
    hot = shared.where((F.col("size") > _MOST_SHARING) & (F.col("node") != F.col("least"))).select(F.col("node").alias("u"), F.col("least").alias("v"))
    rest = shared.where(F.col("size") <= _MOST_SHARING).join(nodes.select("node", "n", F.col("bits").alias("body")), "node")
    rest = rest.select("g", F.lit(0).alias("h"), F.lit(0).alias("side"), F.col("node").alias("label"), "node", "n", "body")
    return hot.union(_forest_links(rest, percent, exact=False))


def _with_sets(docs: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """node, n and hashes of the wanted sets (node, key: a row that has it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(name, h) for name, h in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), size)) if set_digest(h) == name]
            columns = [pa.array([f[0] for f in found], pa.int64()), pa.array([len(f[1]) for f in found], pa.int64()), pa.array([f[1].tobytes() for f in found], pa.binary())]
            yield pa.record_batch(columns, names=["node", "n", "body"])

    rows = docs.select(row_key(id_col, text_col).alias("key"), text_col).join(if_small(wanted), "key").select("node", text_col)
    # Several rows can have the wanted row's id: those of other sets fall out in
    # ``run``, equal ones here.
    return rows.mapInArrow(run, "node long, n long, body binary").dropDuplicates(["node"])


def verified(sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """(u, v): spanning forests of the exact links within each candidate group.

    sets: node, n, body; found: node, component. A component of more than
    ``_TILE`` sets is first linked within two random deals into tiles; then its
    sets, ordered by what is linked, are tiled again and pairs of tiles are
    compared unless all their sets are linked or their sizes rule links out.
    """
    found = stored(found)
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    placed = stored(sets.join(found.join(sizes, "component"), "node"))
    large = placed.where(F.col("size") > _TILE)
    links = []
    for deal in range(2):
        tile = F.pmod(F.xxhash64("node", F.lit(deal)), F.ceil(F.col("size") / _TILE))
        rows = large.select(F.col("component").alias("g"), tile.cast("int").alias("h"), F.lit(0).alias("side"), F.col("node").alias("label"), "node", "n", "body")
        links.append(_forest_links(rows, percent, exact=True))
    early = stored(links[0].union(links[1]))
    label = F.coalesce("linked", "node")
    linked = components(early).select("node", F.col("component").alias("linked"))
    flat = placed.select("component", "node", "n", "size").join(linked, "node", "left").select("component", "node", "n", "size", label.alias("label"))
    # Tiles of a component: ranges of (label, size) from a hash of the label, so
    # that sets that are linked lie in the same tiles. Counts of labels come first.
    by_label = flat.where(F.col("size") > _TILE).groupBy("component", "label").agg(F.count("*").alias("members"))
    single = F.col("members") <= _TILE // 2
    mixed = F.pmod(F.xxhash64("label"), F.ceil(F.col("size") / _TILE))
    own = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / _TILE))
    flat = flat.join(by_label, ["component", "label"], "left")
    tile = F.when(F.col("size") <= _TILE, 0).when(single, mixed).otherwise(F.xxhash64("label", own))
    flat = stored(flat.select("component", "node", "label", "n", tile.cast("long").alias("tile"), F.when(single | (F.col("size") <= _TILE), F.lit(None)).otherwise(F.col("label")).alias("one")))
    tiles = stored(flat.groupBy("component", "tile").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.first("one").alias("one")))
    other = tiles.select("component", *[F.col(c).alias(f"{c}2") for c in ("tile", "least", "most", "one")])
    fits = (100 * F.col("most") >= percent * F.col("least2")) & (100 * F.col("most2") >= percent * F.col("least"))
    pairs = tiles.join(other, "component").where((F.col("tile") <= F.col("tile2")) & fits & ~F.coalesce(F.col("one") == F.col("one2"), F.lit(False)))
    pairs = stored(pairs.select("component", "tile", "tile2", F.xxhash64("tile", "tile2").alias("pair")))
    sent = pairs.select("component", "tile", "pair", F.lit(0).alias("side")).union(pairs.where("tile <> tile2").select("component", "tile2", "pair", F.lit(1)))
    rows = flat.select("component", "tile", "node", "label").join(sent, ["component", "tile"]).join(placed.select("node", "n", "body"), "node")
    rows = rows.select(F.col("component").alias("g"), F.col("pair").alias("h"), "side", "label", "node", "n", "body")
    return early.union(_forest_links(rows, percent, exact=True))


def jaccard_classes(docs: DataFrame, shingle: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: key (``row_key``), n_shingles (distinct ones) and
    component (key of the smallest id reachable over links, itself included).

    Texts are linked when the Jaccard similarity of their shingle sets is at
    least ``percent`` / 100, compared in whole numbers. Null text is empty text;
    texts without a word have no shingles and are linked with nothing, not even
    each other. Texts of equal sets are linked, so repeated rows and groups of
    copies cost one comparison. Rows of one id are told apart by their sets. Rows
    without an id are rows of their own for each text and count as smaller than
    any id. A text of any length is read whole; an
    empty table gives no rows; other columns are ignored.
    """
    if not 50 <= percent <= 100:
        raise ValueError(f"a similarity of 50 to 100 per cent is needed: {percent}")
    spark = docs.sparkSession
    short_batches(spark)
    docs = docs.select(id_col, text_col)
    all_rows = stored(_summaries(docs, shingle, id_col, text_col))
    classes = spark.sparkContext.broadcast(_sketch(all_rows))
    rows = all_rows.where("part is null").select("key", "n", "node")
    sent = stored(_prefixes(docs, classes, shingle, percent, text_col))
    nodes = stored(sent.groupBy("node").agg(*[F.any_value(c).alias(c) for c in ("n", "bits", "prefix")]))
    found = stored(components(_candidates(nodes, percent)))
    keys = rows.where("n > 0").groupBy("node").agg(F.min("key").alias("key"))
    wanted = stored(keys.join(if_small(found.select("node")), "node", "left_semi"))
    links = verified(_with_sets(docs, wanted, shingle, id_col, text_col), found, percent)
    linked = stored(components(links))
    named = stored(keys.join(linked, "node", "left").select("node", "key", F.coalesce("component", "node").alias("component")))
    least = named.groupBy("component").agg(F.min("key").alias("least"))
    named = named.join(least, "component").select("node", "least")
    out = rows.join(named, "node", "left")
    return out.select("key", F.col("n").alias("n_shingles"), F.coalesce("least", "key").alias("component"))
