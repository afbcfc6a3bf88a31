"""The Jaccard join against all pairs, at every depth of its trees."""

import random

import numpy as np
import pytest

from lexlake.llm import queries, signature_join


def plain_set(text, size=4):
    words = (text or "").encode().lower().split()
    k = min(size, len(words))
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def plain_classes(rows, percent=85):
    """id → (set size, smallest id reachable) by all pairs."""
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                same = len(a & b)
                if 100 * same >= percent * (len(a) + len(b) - same):
                    x, y = root(i), root(j)
                    parent[max(x, y)] = min(x, y)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), k), k)
    return {k: (len(s), least[root(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets))}


def some_rows(seed, n_groups=40):
    rnd = random.Random(seed)
    word = lambda: f"w{int(rnd.paretovariate(0.6)) % 4000}"
    passage, texts = [word() for _ in range(60)], []
    for g in range(n_groups):
        base = [word() for _ in range(rnd.choice([3, 6, 7, 8, 12, 40, 90, 200, 400]))]
        if g % 3 == 0:  # a passage that many texts share
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        for _ in range(rnd.choice([1, 2, 3, 60 if g == 1 else 4])):
            copy = list(base)
            for _ in range(rnd.randint(0, 1 + len(base) // 35)):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy).title() if rnd.random() < 0.2 else "\t".join(copy))
    # A chain whose ends are not alike, and texts around the limit.
    base = [f"c{i}" for i in range(120)]
    for step in range(12):
        base = base[2:] + [f"d{step}", f"e{step}"]
        texts.append(" ".join(base))
    texts += ["", None, " \n", "", "one", "ONE", "one two three", "one two three four five six seven eight nine", "one two three four five six seven eight nine ten"]
    rnd.shuffle(texts)
    return [(3 * i + 7, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("limits", [(4096, 256, 500_000), (5, 4, 3)], ids=["usual", "split"])
def test_join_equals_all_pairs(spark, monkeypatch, limits):
    for name, value in zip(("_MOST_SHARING", "_TILE", "_SEEN"), limits):
        monkeypatch.setattr(signature_join, name, value)
    rows = some_rows(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.key: (r.n_shingles, r.component) for r in signature_join.jaccard_classes(docs).collect()}
    want = plain_classes(rows)
    assert got == want
    assert sum(k != c for k, (_, c) in want.items()) > 30


def test_forest_finds_all_links():
    """Random sets around the limit: the same classes as all pairs, for one tree
    and for two."""
    rnd = np.random.default_rng(8)
    for turn in range(40):
        base = [np.unique(rnd.integers(0, 2**63, rnd.integers(5, 300), dtype=np.uint64)) for _ in range(6)]
        sets = []
        for _ in range(60):
            own = base[rnd.integers(len(base))]
            keep = own[rnd.random(len(own)) > rnd.choice([0, 0.05, 0.1, 0.16])]
            sets.append(np.unique(np.append(keep, rnd.integers(0, 2**63, max(1, len(own) // 30), dtype=np.uint64))))
        percent = int(rnd.choice([60, 85, 95]))
        alike = signature_join._exactly(sets, percent)
        forest = signature_join.SignatureForest([len(s) for s in sets], [int.from_bytes(signature_join.bitmap(s), "little") for s in sets], percent, alike)
        if turn % 2:
            pairs = [(i, j) for i in range(30) for j in range(30, 60)]
            forest.descend(forest.tree(list(range(30))), forest.tree(list(range(30, 60))))
        else:
            pairs = [(i, j) for i in range(60) for j in range(i)]
            forest.descend(*[forest.tree(list(range(60)))] * 2)
        parent = list(range(60))
        for i, j in pairs:
            if alike(i, j):
                old, new = parent[i], parent[j]
                parent = [new if p == old else p for p in parent]
        roots = [forest.root(i) for i in range(60)]
        assert len(forest.links) == 60 - len(set(roots))
        assert all((roots[i] == roots[j]) == (parent[i] == parent[j]) for i in range(60) for j in range(60))


def test_edges_and_other_columns(spark):
    rows = [(None, "a b c d e", "x"), (None, "a b c d f", "x"), (5, "A B c d e", None), (5, "A B c d e", None), (6, None, None), (7, "", None), (8, "z", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = signature_join.jaccard_classes(docs).collect()
    by = [(r.n_shingles, r.key, r.component if r.component > 0 else None) for r in got if r.key > 0]
    assert sorted(by, key=str) == sorted([(2, 5, None), (2, 5, None), (0, 6, 6), (0, 7, 7), (1, 8, 8)], key=str)
    assert len(got) == 7 and signature_join.jaccard_classes(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        signature_join.jaccard_classes(docs, percent=10)


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, sf_dir).select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op12_jaccard_join(spark, sf_dir).collect()}
    assert got == plain_classes(rows)
