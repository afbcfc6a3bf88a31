"""Op 9 over the whole table against mentions found by another regex engine, and
names that come back in other forms."""

import re
from collections import defaultdict

import regex

from lexlake.llm import pii, queries


def _python(pattern):
    for script in ("Latin", "Cyrillic", "Greek"):
        pattern = pattern.replace(rf"\p{{Is{script}}}", rf"\p{{Script={script}}}")
    return regex.compile(pattern)


ANY = _python(pii.ANY)
KINDS = {k: _python(p) for k, p in pii.PATTERNS.items()}
BUT_IBAN = _python("|".join(p for k, p in pii.PATTERNS.items() if k != "iban"))


def _luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def _mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _mentions(text):
    """(start, end, kind, canonical form) of every real mention."""
    out = []

    def take(found, at):
        for m in found:
            kind = next(k for k, p in KINDS.items() if p.fullmatch(m[0]))
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "iban" and _mod97(m[0].replace(" ", "")) != 1:
                take(BUT_IBAN.finditer(m[0]), at + m.start())
            elif kind != "card" or _luhn(digits):
                national = digits[-10:] if m[0].startswith("+1") else digits
                canon = {"email": m[0].lower(), "card": digits, "ssn": digits, "iban": m[0].replace(" ", ""), "phone": national}.get(kind)
                if kind == "name":
                    female = regex.match(f"(?:{pii.FEMALE})\\b", m[0])
                    kind, canon = "name_f" if female else "name_m", m[0].split(" ", 1)[1]
                if kind == "secret":
                    canon = re.sub(r"^[A-Za-z_-]+ {0,2}[=:] {0,2}[\"']?", "", m[0])
                out.append((at + m.start(), at + m.end(), kind, canon or m[0]))

    take(ANY.finditer(text), 0)
    return out


def test_whole_table_equals_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in queries.documents(spark, sf_dir).collect()}
    rows = queries.op9_pii_surrogates(spark, sf_dir).collect()
    made, seen = {}, 0
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        found = _mentions(text or "")
        full = sorted({c for _, _, k, c in found if k.startswith("name") and " " in c}, key=len, reverse=True)
        bare = re.compile("|".join(rf"(?<![^\W\d_]){re.escape(c)}(?![^\W\d_]|['-])" for c in full)) if full else None
        cuts, at, again = [], 0, 0
        for start, end, _, _ in [*found, (len(text or ""), 0, "", "")]:
            lead = (text or "")[at:start]
            parts = bare.split(lead) if bare else [lead]
            again += len(parts) - 1
            cuts.append("(?:.+?)".join(map(re.escape, parts)))
            at = end
        assert r["n_entities"] == len(found) + again
        if not found:
            assert r["text"] == text
            continue
        got = re.fullmatch("(.+?)".join(cuts), r["text"], re.S)
        assert got, r["doc_id"]
        for (start, end, kind, canon), put in zip(found, got.groups()):
            seen += 1
            assert put != text[start:end]
            plain = {"email": str.lower, "iban": lambda x: x.replace(" ", "")}.get(kind, lambda x: x)(put)
            if kind in ("card", "ssn", "phone"):
                assert re.sub("[0-9]", "0", put) == re.sub("[0-9]", "0", text[start:end])
                plain = re.sub("[^0-9]", "", put)[-10 if kind == "phone" and put.startswith("+1") else 0 :]
            if kind.startswith("name"):
                plain = put.split(" ", 1)[1]
            if kind == "secret":
                plain = re.sub(r"^[A-Za-z_-]+ {0,2}[=:] {0,2}[\"']?", "", put)
            assert kind != "card" or _luhn(plain)
            assert kind != "iban" or _mod97(plain) == 1
            assert made.setdefault((kind, canon), plain) == plain
    by = defaultdict(set)
    for (kind, canon), put in made.items():
        assert put not in by[kind] and (kind, put) not in made
        by[kind].add(put)
    assert seen > 10


def _replaced(spark, rows, key="k"):
    return {r["doc_id"]: r for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), key).collect()}


def test_names_keep_their_words(spark):
    rows = [
        (1, "Mr John Smith met Mr Smith. John Smith left; John Smithson and Mary John Smith-Lee stayed."),
        (2, "Mrs Jane Doe and Mrs Doe, then Mr Doe"), (3, "John Smith is not named with an honorific here"),
        (4, "Ms O'Neil-Roy Case saw Herr Roy; O'Neil-Roy Case wrote"), (5, "Mr Jo Li and Mr Ann Jo Li: Jo Li, Ann Jo Li"),
    ]
    out = _replaced(spark, rows)
    given, surname, one, again = re.match(r"Mr (\w+) (\w+) met Mr (\w+)\. (.+?) left; John Smithson and Mary John Smith-Lee stayed\.$", out[1]["text"]).groups()
    assert surname == one != "Smith" and again == f"{given} {surname}" and given.endswith("dor") and out[1]["n_entities"] == 3
    jane, doe, again, his = re.match(r"Mrs (\w+) (\w+) and Mrs (\w+), then Mr (\w+)$", out[2]["text"]).groups()
    assert doe == again == his not in ("Doe", surname) and jane.endswith("na")
    assert (out[3]["text"], out[3]["n_entities"]) == (rows[2][1], 0)
    full, roy, again = re.match(r"Ms (.+?) saw Herr (.+?); (.+?) wrote$", out[4]["text"]).groups()
    assert full == again != "O'Neil-Roy Case" and roy != "Roy" and out[4]["n_entities"] == 3
    short, long, short2, long2 = re.match(r"Mr (.+?) and Mr (.+?): (.+?), (.+?)$", out[5]["text"]).groups()
    assert (short, long) == (short2, long2) and long.split()[1:][-1] == short.split()[1] and out[5]["n_entities"] == 4


def test_many_copies_are_spread(spark, monkeypatch):
    monkeypatch.setattr(pii, "HOT_COPIES", 20)
    rows = [(i, "write to a.b@example.com") for i in range(300)] + [(300 + i, f"c{i}@example.com") for i in range(10)] + [(400, None), (401, "none")]
    out = _replaced(spark, rows)
    assert len(out) == len(rows) and len({out[i]["text"] for i in range(300)}) == 1 and len({out[300 + i]["text"] for i in range(10)}) == 10
    assert "a.b@" not in out[0]["text"] and out[401]["text"] == "none" and {out[i]["n_entities"] for i in range(310)} == {1}
