"""Runs of words against a plain search of every period, and the query against
a plain version of its whole contract."""

import hashlib
import random
import zlib

import pytest

from lexlake.llm import queries, runs


def plain_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_words(rnd):
    n, letters, kind = rnd.randint(0, 150), rnd.choice([1, 2, 2, 3, 5]), rnd.random()
    draw = lambda m: [str(rnd.randrange(letters)) for _ in range(m)]
    if kind < 0.4:
        return draw(n)
    if kind < 0.7:  # repeated stretches one after another
        words = []
        while len(words) < n:
            words += draw(rnd.randint(1, 20)) * rnd.randint(1, 5)
        return words
    if kind < 0.85:  # runs within runs
        return (list(rnd.choice(["a", "b", "aab", "ab"]) * rnd.randint(1, 12)) + ["a"]) * rnd.randint(1, 6)
    x, y = ["a"], ["a", "b"]
    for _ in range(rnd.randint(1, 8)):
        x, y = y, y + x
    return y


def test_runs_are_all_found():
    rnd = random.Random(5)
    n_runs = 0
    for _ in range(400):
        texts = [some_words(rnd) for _ in range(rnd.randint(1, 5))]
        for words, (found, left, n) in zip(texts, runs.runs_of_texts([" ".join(t).encode() for t in texts])):
            assert found == plain_runs(words) and n == len(words)
            assert left.decode() == collapsed(words, found)
            n_runs += len(found)
    assert n_runs > 1000


def test_long_texts():
    """One word over and over, and a long period, in well under quadratic work."""
    same = b"a " * 300_000
    period = [str(i) for i in range(40_000)]
    (one, left, _), (two, _, _) = runs.runs_of_texts([same, " ".join(period * 5 + period[:7]).encode()])
    assert one == [(0, 300_000, 1)] and left == b"a"
    assert two == [(0, 200_007, 40_000)]


def test_edges_and_other_columns(spark):
    rep = "x\ty\v" * 8
    rows = [(1, None, "p", 0), (2, "", "q", 0), (3, rep, "r", 0), (3, rep, "r", 0), (None, " lone\r\n", None, 0), (4, "A a " * 6, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, period int")
    got = sorted(((r.doc_id, r.text, [tuple(x) for x in r.runs], r.collapsed, r.n_words, r.start) for r in runs.collapse_runs(docs).collect()), key=str)
    want = [
        (1, None, [], "", 0, "p"), (2, "", [], "", 0, "q"), (3, rep, [(0, 16, 2)], "x y", 16, "r"), (3, rep, [(0, 16, 2)], "x y", 16, "r"),
        (None, " lone\r\n", [], "lone", 1, None), (4, "A a " * 6, [(0, 12, 2)], "A a", 12, "s"),
    ]
    assert got == sorted(want, key=str)
    assert runs.collapse_runs(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        runs.collapse_runs(docs.withColumn("runs", docs["start"]))


def test_query(spark, sf_dir):
    docs = queries.documents(spark, sf_dir).select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        words = (d.text or "").encode().split()
        words, n, h = [w.decode() for w in words], len(words), zlib.crc32(str(d.doc_id).encode())
        if n > 3000:
            continue
        if h % 10 == 0 and n:
            g = h // 10
            a, planted = g % n, planted + 1
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = plain_runs(words)
        best = min(((-n_, s, q) for s, n_, q in found), default=None)
        first = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
        lines = "".join(f"{s},{n_},{q}\n" for s, n_, q in found)
        assert got[d.doc_id] == (len(found), *first, *(hashlib.sha256(t.encode()).hexdigest() for t in (lines, collapsed(words, found))))
    assert planted > 5
