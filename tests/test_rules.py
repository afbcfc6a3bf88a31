"""Rules that literal cases pin down: names, ids, scenarios and reviews."""

import random

from lexlake.operators import matrix, versions
from lexlake.sources import landed


def resolved(spark, titles, asked):
    docs = spark.createDataFrame([(i, f"c{i}", t) for i, t in enumerate(titles)], "document_id long, external_id string, title string")
    rows = versions.resolve_documents(spark.createDataFrame(list(enumerate(asked)), "query_id long, query string"), docs).collect()
    return {asked[r.query_id]: (r.status, r.document_id, r.candidates, r.children) for r in rows}


def test_a_law_is_not_stood_in_for_by_its_rules(spark):
    asked = ["增值税法", "中华人民共和国增值税法", "增值税法实施条例", "c0", None, " "]
    got = resolved(spark, ["中华人民共和国增值税法实施条例", None], asked)
    assert got["增值税法"] == got["中华人民共和国增值税法"] == ("parent_missing", None, 1, ["中华人民共和国增值税法实施条例"])
    assert got["增值税法实施条例"][:2] == ("name", 0) and got["c0"][:2] == ("external_id", 0)
    assert got[None][0] == got[" "][0] == "not_found"


def test_one_rule_among_other_hits_is_ambiguous(spark):
    got = resolved(spark, ["营业税法实施条例", "营业税法解释"], ["营业税法", "营业税法解"])
    assert got["营业税法"] == ("ambiguous", None, 2, []) and got["营业税法解"] == ("substring", 1, 1, [])


def entries(spark, rows):
    return spark.createDataFrame([(i, f"title {i}", u, None, "", n) for i, (u, n) in enumerate(rows)], "seq long, title string, url string, pubDate string, label string, indexno string").repartition(3)


def test_a_dropped_entry_drops_no_other(spark):
    url = "https://x.example.org/c{}/content.html".format
    got = landed.policy_refs(entries(spark, [(url(1), "I1"), (url(2), "I1"), (url(2), "I3")])).collect()
    assert {(r.url, r.external_id) for r in got} == {(url(1), "I1"), (url(2), "I3")}
    rnd = random.Random(3)
    rows = [(url(rnd.randrange(40)), f"I{rnd.randrange(40)}") for _ in range(120)]
    seen, want = set(), set()
    for u, n in rows:
        if u not in seen and n not in seen:
            seen |= {u, n}
            want.add((u, n))
    got = [(r.url, r.external_id) for r in landed.policy_refs(entries(spark, rows)).collect()]
    assert set(got) == want and len(got) == len(want)
    assert landed.policy_refs(entries(spark, rows).where("false")).count() == 0


def test_echoed_roles_are_cut_at_their_separator(spark):
    texts = ["境內居住者申報｜個人", "扣繳|代理人", " 兩者 | a ｜ b", "｜個人", "扣繳代理人", None, "|"]
    rows = spark.createDataFrame([("TW", "t", t, "個人", 1, 1, i) for i, t in enumerate(texts)], "country string, tax_key string, scenario string, taxpayer_role string, document_id long, batch_no int, row_no int")
    got = {r.pos: (r.scenario, r.role, r.others) for r in matrix.known_scenarios(rows, 6).collect()}
    assert got == {i + 1: (s, "個人", 1) for i, s in enumerate(["境內居住者申報", "扣繳", "兩者 | a", "｜個人", "扣繳代理人", ""])}


def test_reviews(spark):
    req = spark.createDataFrame([(i, "TW", "draft") for i in range(1, 6)], "requirement_id long, country string, status string")
    cells = [(1, "rate", "v", True), (1, "formula", "w", False), (2, "rate", "v", False), (3, "rate", "v", True), (4, "rate", "v", False)]
    fields = spark.createDataFrame([(i, k, v, [], 0.5, "import", f, "why", 9) for i, k, v, f in cells], f"requirement_id long, field_key string, value string, citations {matrix.CITATIONS}, confidence double, source string, needs_review boolean, review_reason string, stale_change_id long")
    decisions = spark.createDataFrame([(1, "rate", None, True), (2, "rate", " v ", False), (3, "rate", "x", False), (5, "formula", "\tnew ", True), (77, "rate", "x", True)], "requirement_id long, field_key string, value string, clear_flag boolean")
    new, rows = matrix.apply_reviews(fields, req, decisions)
    status = {r.requirement_id: r.status for r in rows.collect()}
    assert status == {1: "reviewed", 2: "reviewed", 3: "draft", 4: "draft", 5: "reviewed"}
    got = {(r.requirement_id, r.field_key): (r.value, r.source, r.needs_review, r.review_reason, r.stale_change_id) for r in new.collect()}
    assert got[1, "rate"] == ("v", "import", False, "", None) and got[2, "rate"] == ("v", "manual", False, "why", 9)
    assert got[3, "rate"] == ("x", "manual", True, "why", 9) and got[5, "formula"] == ("new", "manual", False, "", None) and len(got) == 6


def test_archived_laws_are_streamed(spark, monkeypatch):
    import io
    import json
    import zipfile

    monkeypatch.setattr(landed, "_PIECE", 7)
    laws = [{"LawName": f'a "quoted" ]{{ name {i}', "LawURL": f"x?pcode=A{i:07}", "LawArticles": [{"ArticleNo": "第 1 條", "ArticleContent": "x\n" * i}]} for i in range(5)]
    plain = json.dumps({"UpdateDate": "x", "Laws": laws}, ensure_ascii=False, indent=1).encode("utf-8-sig")
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.JSON", plain)
        z.writestr("b.txt", b"no")
        z.writestr("c.json", json.dumps({"Laws": []}))
        z.writestr("d.json", json.dumps({"Laws": laws[:2]}))
    assert [json.loads(x) for x in landed._laws_in(io.BytesIO(plain))] == laws
    files = spark.createDataFrame([("p", plain), ("z", held.getvalue()), ("e", b""), ("n", None), ("o", b'{"Other": [1]}')], "path string, content binary")
    got = [(r.path, json.loads(r.law)) for r in landed.archived_laws(files).collect()]
    assert [law for p, law in got if p == "p"] == laws and [law for p, law in got if p == "z"] == laws + laws[:2] and len(got) == 12
    refs = landed.archived_law_refs(files.where("path = 'p'"), spark.createDataFrame([("A0000003",)], "external_id string")).collect()
    assert [(r.external_id, r.title) for r in refs] == [("A0000003", 'a "quoted" ]{ name 3')]
