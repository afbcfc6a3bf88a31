"""Phrases against a plain count of everything, and the query against its SQL."""

import os
import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexlake.llm import phrases, queries

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import oracle  # noqa: E402

LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, top, least, percent):
    """(lang, rank, phrase, a, l, r, n, score) by counting all phrases."""
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least}
        within = defaultdict(int)
        for p, a in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    within[p[i : i + k]] = max(within[p[i : i + k]], a)
        kept = []
        for p, a in often.items():
            if len(p) > 1 and not (p in within and 100 * within[p] >= percent * a):
                score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        n = sum(a for p, a in counts.items() if len(p) == 1)
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def some_rows(seed):
    rnd = random.Random(seed)
    rows = []
    for lang, size in (("en", 60), ("de", 300), (None, 25), ("und", 25), ("xx", 3)):
        fixed = [[f"{lang}{rnd.randrange(30)}" for _ in range(rnd.randint(2, 6))] for _ in range(25)]
        for _ in range(size):
            words = []
            for _ in range(rnd.randint(0, 60)):
                words += rnd.choice(fixed) if rnd.random() < 0.5 else [f"É{int(rnd.paretovariate(0.8)) % 200}".title()]
                words.append(rnd.choice([" ", "\t ", " ", ", ", ".", "\n", "\x0b", "?! "]))
            rows.append((lang, "".join(w if w[0] in " \t,.\n\x0b?" else w + rnd.choice([" ", "\t"]) for w in words)))
    return rows + [("en", None), ("en", ""), (None, " . "), ("zz", ""), ("de", "a b " * 400)]


@pytest.mark.parametrize("top,first,slice_bytes", [(2000, 4, 8 << 20), (20, 1, 2000), (5, 1, 500)])
def test_phrases_equal_plain_counts(spark, monkeypatch, top, first, slice_bytes):
    monkeypatch.setattr(phrases, "_FIRST", first)
    monkeypatch.setattr(phrases, "_MORE", 2)
    monkeypatch.setattr(phrases, "_SLICE_BYTES", slice_bytes)
    rows = some_rows(4)
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "lang string, text string, phrase string").repartition(4)
    got = sorted(tuple(r) for r in phrases.mine_phrases(docs, top, 12, 80).collect())
    want = plain(rows, top, 12, 80)
    assert got == want and len({r[0] for r in want}) == 3
    assert phrases.mine_phrases(docs.where("false"), top).count() == 0


def test_places_are_those_of_the_texts():
    s = phrases.Slice("en", ["One two, three four five", "six"])
    assert s.windows(2).sum() == 3
    at = np.flatnonzero(s.windows(3))
    assert phrases.phrase_places(["en"], ["three four five"])[0] == phrases._place(s.hashes(3)[at])[0]


def test_large_counts(spark):
    """Products beyond 64 bits stay exact."""
    a = 6 * 10**12 + 1
    pairs = spark.createDataFrame([("en", "x y", a)], "lang string, phrase string, f long")
    single = spark.createDataFrame([("en", "x", a + 7), ("en", "y", 3 * a)], "lang string, phrase string, f long")
    assert phrases._scored(pairs, single, 2).first().score == 2_000_000 * a // (4 * a + 7)


def test_query_equals_sql(spark, sf_dir):
    con = oracle.connection(sf_dir)
    missing, extra, n = oracle.differences(queries.op13_phrases(spark, sf_dir), con, queries.ORACLES["op13_phrases"])
    assert not missing and not extra and n > 20, (missing, extra, n)
