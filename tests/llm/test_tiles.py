"""Tiles of the near-duplicate comparison: many of them, in small pieces."""

import random

import numpy as np
import pytest

from lexlake.llm import common, simhash


def _some(seed, n=120, flips=6):
    rng = random.Random(seed)
    fps = [rng.getrandbits(64) for _ in range(n)]
    for f in fps[: n // 2]:
        for _ in range(3):
            for b in rng.sample(range(64), rng.randint(0, flips)):
                f ^= 1 << b
            fps.append(f)
    fps = sorted(set(fps))
    rng.shuffle(fps)
    return fps


def _roots(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in links:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("home", [0, 1, 90, 300])
def test_a_tile_takes_later_rows_in_pieces(home):
    fps = _some(home)
    words = np.array(fps, dtype=np.uint64).reshape(-1, 1)
    nodes, none = np.arange(len(fps)), np.zeros(len(fps), dtype=np.int64)
    home = min(home, len(fps))
    tile = simhash.Tile(nodes[:home], words[:home], none[:home], 4)
    parts = [tile.own(), *(tile.later(nodes[i : i + 11], words[i : i + 11], none[i : i + 11]) for i in range(home, len(fps), 11))]
    got = [(int(u), int(v)) for part in parts for u, v in zip(*part)]
    near = [(i, j) for i in range(home) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 4]
    assert set(map(tuple, map(sorted, got))) <= {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps))} and len(got) < max(1, len(fps))
    assert _roots(len(fps), got) == _roots(len(fps), near)


@pytest.mark.parametrize("likeness", [0.0, 0.8])
def test_range_tiles_lose_no_link(spark, monkeypatch, likeness):
    monkeypatch.setattr(simhash, "_LEAST_TILE", 16)
    monkeypatch.setattr(common, "BATCH_ROWS", 7)
    fps = _some(7)
    sizes = [random.Random(f).randint(5, 9) if likeness else 0 for f in fps]
    nodes = spark.createDataFrame([(i, s, bytearray(f.to_bytes(8, "little"))) for i, (f, s) in enumerate(zip(fps, sizes))], "node long, size long, fp binary")
    got = {r["node"]: r["component"] for r in simhash.components(simhash.links(nodes, 5, likeness)).collect()}
    pairs = ((i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if min(sizes[i], sizes[j]) >= likeness * max(sizes[i], sizes[j]))
    want = _roots(len(fps), [(i, j) for i, j in pairs if (fps[i] ^ fps[j]).bit_count() <= 5])
    assert [got.get(i, i) for i in range(len(fps))] == want
    monkeypatch.undo()
    common.short_batches(spark)
