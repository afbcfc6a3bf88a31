"""Small cases with known results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexlake.functions import text as T
from lexlake.functions.citations import extract_citations
from lexlake.functions.docnum import numbers_in
from lexlake.operators import corpus, graph, matrix, normalize, versions
from lexlake.sources import landed
from lexlake.streaming import ingest


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text, value", [("一", 1), ("十一", 11), ("二十八", 28), ("一百三十三", 133), ("〇", 0), ("两千零五", 2005), ("第一条", None), ("12", None), ("abc", None), ("", None), (None, None)])
def test_numerals(spark, text, value):
    assert one(spark, T.cn_to_int(F.col("t")), t=text) == value


@pytest.mark.parametrize(
    "key, parent",
    [("增值税法实施条例", "增值税法"), ("所得稅法施行細則", "所得稅法"), ("消费税暂行条例实施细则", "消费税暂行条例"), ("營利事業所得稅查核準則", None), ("所得稅法", None), ("实施条例", None), ("税收征收管理法实施细则#3", "税收征收管理法")],
)
def test_parents(spark, key, parent):
    assert one(spark, T.parent_key(F.col("k")), k=key) == parent


def test_keys_and_text(spark):
    assert one(spark, T.norm_key(F.col("k")), k="《中华人民共和国增值税法》 实施条例") == "增值税法实施条例"
    assert one(spark, T.norm_key(F.col("k")), k="中华人民共和国") == "中华人民共和国"
    assert one(spark, T.norm_key(F.col("k")), k="臺財稅#1") == "台財稅#1"
    assert one(spark, T.normalize_text(F.col("t")), t="　Ａ b\t\tc\r\n\n\n\n“x”—1 ") == 'A b c\n\n"x"-1'
    assert one(spark, T.core_title(F.col("t")), t="国家税务总局关于增值税征收管理的公告") == "增值税征收管理"
    assert one(spark, T.core_title(F.col("t")), t="关于发票的函") == "关于发票的函"
    assert one(spark, T.core_title(F.col("t")), t="国家税务总局关于电池消费税征收管理有关事项的公告") == "电池消费税征收管理"
    assert one(spark, T.core_title(F.col("t")), t="关于《增值税发票开具指南》的通知") == "增值税发票开具指南"


def citations_of(spark, *rows):
    """Per (text, parent, own): the list of (key, relation, raw)."""
    held = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "i int, t string, p string, o string")
    found = held.select("i", extract_citations(F.col("t"), F.col("p"), F.col("o")).alias("c")).orderBy("i").collect()
    return [[(c["entity_key"], c["relation_type"], c["raw_text"]) for c in r["c"]] for r in found]


def test_citations_keep_order_runs_and_first_readings(spark):
    texts = ["依據所得稅法第十四條之一、第88條及第92條規定", "依本條例第3條、第4條", "根据《企业所得税法》、《环境保护税法》和", "依据财税〔2026〕15号废止国税发〔2003〕67号", "企业所得税法和企业所得税法实施条例", "修正 所得稅法第 4 條"]
    found = citations_of(spark, *[(t, None, "貨物稅條例") for t in texts])
    assert found[0][:3] == [("所得稅法#14-1", "authority_of", "依據所得稅法第十四之一條"), ("所得稅法#88", "authority_of", "、第88條"), ("所得稅法#92", "authority_of", "及第92條")]
    assert ("所得稅法#14-1", "interprets", "依據所得稅法第十四之一條") in found[0]
    assert found[1] == [("貨物稅條例#3", "cites", "本條例第3條"), ("貨物稅條例#4", "cites", "、第4條")]
    assert [x[:2] for x in found[2]] == [("企业所得税法", "authority_of"), ("环境保护税法", "authority_of"), ("企业所得税法", "interprets"), ("环境保护税法", "interprets")]
    assert ("国税发〔2003〕67号", "supersedes", "废止国税发〔2003〕67号") in found[3]
    assert found[4][0][:2] == ("企业所得税法", "authority_of") and found[5][0][:2] == ("所得稅法#4", "amends")


def test_citations(spark):
    keys = lambda text, parent=None: {c[:2] for c in citations_of(spark, (text, parent, None))[0]}
    assert ("企业所得税法#133", "interprets") in keys("企业所得税法第一百三十三条")
    assert keys("税法第一条", parent="增值税法") == {("增值税法#1", "authority_of")} and keys("税法第一条") == set()
    assert keys("依本法第88條", parent="所得稅法") == {("所得稅法#88", "authority_of")}
    found = keys("本準則依所得稅法第八十條第五項及稅捐稽徵法第一條之一規定訂定之。")
    assert {k for k, _ in found} == {"所得稅法#80", "稅捐稽徵法#1-1"}
    assert {k for k, _ in keys("所得稅法第66條之9、第92條")} == {"所得稅法#66-9", "所得稅法#92"}
    assert ("台財稅字第10904512340號", "supersedes") in keys("停止適用臺財稅字第10904512340號")
    assert keys("") == keys(None) == set()


@pytest.mark.parametrize(
    "text, numbers",
    [
        ("根据财税〔2026〕15号", ["财税〔2026〕15号"]), ("财税[2026]15号和财税（2026） 15 号", ["财税〔2026〕15号"]), ("海关总署 税务总局公告2025年第256号", ["海关总署税务总局公告2025年第256号"]),
        ("和国家税务总局公告2026年第6号", ["国家税务总局公告2026年第6号"]), ("国税函发〔1995〕156号", ["国税函发〔1995〕156号"]), ("人社部发〔2024〕3号", ["人社部发〔2024〕3号"]), ("第 15 号", []), (None, []),
    ],
)
def test_document_numbers(text, numbers):
    assert numbers_in(text) == numbers


def provisions(spark, rows):
    return spark.createDataFrame([(1, i, k, "h", t) for i, (k, t) in enumerate(rows)], "pair_id long, ordinal int, node_key string, heading string, text string")


def test_diff_renumbers_greedily(spark):
    old = provisions(spark, [("a#1", "same"), ("a#2", "the old text of two"), ("a#3", "moved provision with some length"), ("a#4", "gone")])
    new = provisions(spark, [("a#1", "same"), ("a#2", "the new text of two"), ("a#9", "moved provision with some length!"), ("a#8", "moved provision with some length"), ("a#7", "fresh one")])
    rows = {r["node_key"]: r for r in versions.with_severity(versions.diff_provisions(old, new)).collect()}
    assert {k: r["change_type"] for k, r in rows.items()} == {"a#2": "modified", "a#8": "renumbered", "a#4": "removed", "a#7": "added", "a#9": "added"}
    assert rows["a#8"]["similarity"] == 1.0 and rows["a#8"]["severity"] == "cosmetic" and rows["a#4"]["severity"] == "critical"
    assert rows["a#2"]["diff_text"].startswith("--- old/a#2\n+++ new/a#2") and rows["a#7"]["similarity"] == 0.0


def test_severity_rules(spark):
    of = lambda a, b: one(spark, T.severity(F.lit("modified"), F.col("a"), F.col("b"), F.lit(None)), a=a, b=b)
    assert of("甲，乙。", "甲 乙") == "cosmetic" and of("abcdefghij" * 3, "abcdefghij" * 2 + "abcdefghiX") == "minor"
    assert of("abcdefghij", "abcdefghiX") == "major" and of("abcd", "wxyz") == "critical"


def test_versions_by_publication_date(spark):
    day = lambda y, m, d: dt.datetime(y, m, d)
    rows = [(1, 7, day(2026, 1, 1), day(2020, 6, 1), "a"), (2, 7, day(2026, 1, 2), day(2023, 6, 1), "b"), (3, 7, day(2026, 1, 3), None, "a"), (4, 7, day(2026, 1, 4), day(2021, 1, 1), "a")]
    snaps = spark.createDataFrame(rows, "snapshot_id long, document_id long, fetched_at timestamp, issued_at timestamp, content_hash string")
    assert [r["snapshot_id"] for r in versions.detect_snapshots(snaps).orderBy("snapshot_id").collect()] == [1, 2, 3]
    asked = spark.createDataFrame([(1, 7, day(2020, 5, 31)), (2, 7, day(2020, 6, 1)), (3, 7, day(2022, 1, 1)), (4, 7, day(2030, 1, 1))], "request_id long, document_id long, day timestamp")
    assert {r["request_id"]: r["snapshot_id"] for r in versions.snapshot_at(asked, snaps).collect()} == {1: None, 2: 1, 3: 4, 4: 3}


def test_resolution_order(spark):
    titles = ["增值税法", "增值税法实施条例", "消费税法", "个人所得税法", "企业所得税法"]
    docs = spark.createDataFrame([(i, f"x{i}", t) for i, t in enumerate(titles)], "document_id long, external_id string, title string")
    asked = spark.createDataFrame([(1, "x3"), (2, "消费税法"), (3, "《中华人民共和国增值税法》"), (4, "增值税"), (5, "所得税法"), (6, "关税"), (7, "个人所得")], "query_id long, query string")
    got = {r["query_id"]: (r["status"], r["document_id"]) for r in versions.resolve_documents(asked, docs).collect()}
    assert got[1] == ("external_id", 3) and got[2] == ("title", 2) and got[3] == ("name", 0)
    assert got[5] == ("ambiguous", None) and got[6] == ("not_found", None) and got[7] == ("substring", 3)


def test_closest_parent(spark):
    docs = spark.createDataFrame([(1, "營利事業所得稅查核準則", "營利事業所得稅查核準則", "regulation"), (2, "所得稅法", "所得稅法", "statute"), (3, "稅捐稽徵法", "稅捐稽徵法", "statute"), (4, "x", "某辦法", "regulation")], "document_id long, entity_key string, title string, doc_type string")
    rel = spark.createDataFrame([("營利事業所得稅查核準則", "所得稅法", "authority_of"), ("營利事業所得稅查核準則", "稅捐稽徵法", "authority_of"), ("所得稅法", "所得來源國稅法", "authority_of"), ("x", "未知法", "authority_of")], "from_key string, to_key string, relation_type string")
    got = {r["document_id"]: (r["root_key"], r["missing_parent"]) for r in graph.find_root(docs, rel).collect()}
    # Climbing goes on from a statute that was reached; only the asked statute is its own root.
    assert got == {1: ("所得稅法", "所得來源國稅法"), 2: ("所得稅法", None), 3: ("稅捐稽徵法", None), 4: ("x", "未知法")}


def test_impact_lists_the_seed_only_through_a_cycle(spark):
    rel = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "x")], "from_key string, to_key string")
    seeds = spark.createDataFrame([("a",), ("x",)], "seed string")
    got = {(r["seed"], r["node"]): r["depth"] for r in graph.impact_spread(seeds, rel, 3).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 2, ("a", "a"): 3, ("x", "d"): 1}


def test_corpus_rows(spark):
    rows = [("关于增值税的通知", "财税[2026]15号", "税收政策-增值税,税费征管", "全文有效", "2026-01-02", "/a"), ("国税发〔2003〕67号 发票", "", "", "全文废止", "bad", "http://b"), ("  ", "x", "", "", "", "")]
    c = corpus.load_corpus(spark.createDataFrame(rows, "title string, document_number string, tax_type string, aging string, written_date string, url string"), "k", "v", "https://h/")
    got = {r["document_number"]: r for r in c.collect()}
    assert set(got) == {"财税〔2026〕15号", "国税发〔2003〕67号"} and got["财税〔2026〕15号"]["tax_keys"] == ["cn_vat", "cn_collection"]
    assert got["国税发〔2003〕67号"]["tax_keys"] == ["cn_collection"] and got["国税发〔2003〕67号"]["written_date"] is None and got["财税〔2026〕15号"]["url"] == "https://h/a"
    assert [r["document_number"] for r in corpus.repealed_numbers(c).collect()] == ["国税发〔2003〕67号"]
    with pytest.raises(ValueError):
        corpus.load_corpus(spark.createDataFrame([(1,)], "x int"), "k", "v", "")


FIELDS = "requirement_id long, field_key string, value string, citations array<struct<node_key:string,quote:string>>, confidence double, source string, needs_review boolean, review_reason string, stale_change_id long"


def test_stale_cells_take_the_first_changed_citation(spark):
    cell = lambda k, *nodes, flagged=False: (1, k, "v", [(n, "q") for n in nodes], 0.5, "extracted", flagged, "", None)
    fields = spark.createDataFrame([cell("rate", "z#1", "a#1", "b#2"), cell("incentives", "a#1"), cell("tax_base", "c#3"), cell("formula", "a#1", flagged=True)], FIELDS)
    day = dt.datetime(2026, 8, 1, 12)
    changes = spark.createDataFrame([(1, 7, "a#1", "modified", "minor", day), (2, 7, "《a》#1", "modified", "critical", day), (3, 8, "b#2", "added", "critical", None)], "change_id long, document_id long, node_key string, change_type string, severity string, detected_at timestamp")
    documents = spark.createDataFrame([(7, "增值税法")], "document_id long, title string")
    reason = "法定稅率／徵收率／費率 所依據的 《a》#1（增值税法）於 2026-08-01 偵測到modified 異動（critical），請重新確認。"
    assert [tuple(r) for r in matrix.stale_cells(fields, changes, documents).collect()] == [(1, "rate", 2, reason)]


def test_merged_cells(spark):
    allowed = spark.createDataFrame([("n1",), ("n2",)], "node_key string")
    old = [(1, "rate", "old", [("n0", "q")], 0.3, "extracted", True, "was", 9), (1, "formula", "typed", [], 0.0, "manual", False, "", None), (1, "tax_base", "cited", [("n0", "q")], 0.9, "extracted", False, "", 5)]
    row = lambda batch, n, field, value, conf, *nodes: (1, batch, n, field, value, conf, [(x, " quote ") for x in nodes])
    new = [
        row(1, 1, "rate", " 13% ", 0.6, "n1"), row(1, 2, "rate", "junk", 0.9, "n1"), row(2, 1, "rate", "13%", 0.8, "n1", "n2", "bad"),
        row(1, 1, "formula", "x", 0.9, "n1"), row(1, 1, "tax_base", "y", 0.9), row(1, 1, "deductions", "a", 0.9), row(2, 1, "deductions", "b", 0.5, "n2"), row(1, 1, "administration", "  ", 0.9, "n1"),
    ]
    extracted = spark.createDataFrame(new, "requirement_id long, batch_no int, row_no int, field_key string, value string, confidence double, citations array<struct<node_key:string,quote:string>>")
    got = {r["field_key"]: r for r in matrix.merge_extracted(extracted, spark.createDataFrame(old, FIELDS), allowed).collect()}
    rate = got["rate"]
    assert (rate["value"], rate["confidence"], rate["needs_review"], rate["review_reason"], rate["stale_change_id"]) == ("13%", 0.8, False, "", None)
    assert [tuple(c) for c in rate["citations"]] == [("n1", "quote"), ("n2", "quote")]
    assert got["formula"]["value"] == "typed" and got["tax_base"]["value"] == "cited" and got["tax_base"]["stale_change_id"] == 5
    assert (got["deductions"]["value"], got["deductions"]["confidence"], got["deductions"]["needs_review"], got["deductions"]["review_reason"]) == ("a\nb", 0.5, True, matrix.CONFLICT)
    assert set(got) == {"rate", "formula", "tax_base", "deductions"}


def test_identity_and_headers(spark):
    key = matrix.identity_key([F.col(c) for c in "abcd"])
    assert one(spark, key, a="resident_individual", b="annual_filing", c="general_income", d="standard") == "resident_individual|annual_filing|general_income|standard"
    assert one(spark, key, a="x", b="", c="y", d="z") == ""
    assert one(spark, matrix.header_field(F.col("h")), h="Sub - Item") == "_scenario" and one(spark, matrix.header_field(F.col("h")), h="備註") is None


def test_batches_fit_the_budget(spark):
    blocks = spark.createDataFrame([(1, i, s) for i, s in enumerate([10, 15, 40, 5, 5, 30])], "document_id long, pos int, size long")
    assert [r["batch_no"] for r in matrix.pack_batches(blocks, 30).orderBy("pos").collect()] == [0, 0, 1, 2, 2, 3]


def test_charsets_and_pages(spark):
    page = "<html><head><meta charset='gb2312'></head><body><h1>增值税公告2026</h1><div id='content'><a>打印</a><p>一、甲</p><p>二、乙</p></div></body></html>"
    raw = spark.createDataFrame([("s", "id", "cn_mof", bytearray(page.encode("gb18030")), "text/html", "u", {})], "source_key string, external_id string, connector string, content binary, content_type string, url string, metadata map<string,string>")
    assert [(r["node_key"], r["text"], r["title"]) for r in normalize.normalize_all(raw).orderBy("ordinal").collect()] == [("id#1", "甲", "增值税公告2026"), ("id#2", "乙", "增值税公告2026")]
    assert normalize.charset_of(b"", "text/html; charset=GB2312") == "gb18030" and normalize.charset_of(b"<meta charset=big5>", None) == "big5" and normalize.charset_of(b"", None) == "utf-8"


def test_sheets(spark, tmp_path):
    (tmp_path / "m.md").write_text("# t\n| A | **B** |\n|---|:--:|\n| 1<br>2 | x |\n")
    (tmp_path / "m.csv").write_text('A,"B"\n1,"x, y"\n,\n')
    rows = lambda name: [r["cells"] for r in landed.read_matrix(spark, str(tmp_path / name)).orderBy("row_no").collect()]
    assert rows("m.md") == [["A", "B"], ["1\n2", "x"]] and rows("m.csv") == [["A", "B"], ["1", "x, y"]]


def test_stream_keeps_versions_and_reruns(spark, tmp_path):
    land, out, check = (str(tmp_path / n) for n in ("land", "out", "check"))
    at = lambda d: dt.datetime(2026, 1, d)
    for d, text in ((1, "one"), (2, "one"), (3, "two"), (4, "one")):
        spark.createDataFrame([(1, at(d), at(1), 0, "a#1", "h", text)], ingest.FETCHES).write.mode("append").parquet(land)
        ingest.ingest_stream(spark, land, out, check, threshold=None).awaitTermination()
    kinds = [r["change_type"] for r in spark.read.parquet(f"{out}/changes").collect()]
    assert spark.read.parquet(f"{out}/snapshots").count() == 3 and kinds == ["modified", "modified"]
    batch = spark.createDataFrame([(1, at(4), at(1), 0, "a#1", "h", "one")], ingest.FETCHES)
    ingest.apply_batch(batch, 3, out, None)
    assert spark.read.parquet(f"{out}/snapshots").count() == 3


def test_landed_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text("<p>x</p>")
    (tmp_path / "in" / "CFR-2025-title26-vol3.xml").write_text("<R/>")
    (tmp_path / "in" / "gone.html").write_text("")
    rows = landed.read_raw(spark, str(tmp_path / "in"), "s", "us_govinfo_cfr").collect()
    assert {(r["external_id"], r["content_type"]) for r in rows} == {("a", "text/html"), ("CFR-2025-title26-vol3", "application/xml")}


def test_dimension_gaps_and_source_keywords(spark):
    schema = "document_id long, country string, tax_key string, taxpayer_class string, tax_scheme string, subject_matter string, scenario_key string"
    rows = [(1, "TW", "tw_income", "a", "b", "c", "d"), (1, "TW", "tw_income", "a", "x", "", "d"), (1, "TW", "tw_income", None, None, None, None), (2, "TW", "other", "a", "b", "c", "d")]
    vocab = spark.createDataFrame([("TW", "tw_income", d, v) for d, v in (("taxpayer_class", "a"), ("tax_scheme", "b"), ("subject_matter", "c"), ("scenario_key", "d"))], "country string, tax_key string, dimension string, value_key string")
    got = {tuple(r) for r in matrix.dimension_gaps(spark.createDataFrame(rows, schema), vocab).collect()}
    assert got == {(1, 1, 1), (2, 4, 0)}
    assert corpus.key_words(["cn_vat", "no such key"]) == ["增值税", "增值稅", "营业税", "營業稅"] and corpus.key_words([]) == []


def test_substring_search(spark):
    texts = ["增值税法", "增值税法实施条例", "a", "ab", "abcabc", ""]
    queries = ["税法", "增值税法", "a", "abc", "zz", "", "c", "cab", "实施条例x"]
    found = versions.containing(spark.createDataFrame([(q,) for q in queries], "query string"), spark.createDataFrame([(t,) for t in texts], "text string"))
    assert {tuple(r) for r in found.collect()} == {(q, t) for q in queries for t in texts if q and q in t}


def test_report_reads_in_order(spark, tmp_path):
    from lexlake.sources import reports

    day = dt.datetime(2026, 8, 1, 12)
    changes = spark.createDataFrame([(1, 1, "a#1", "modified", "minor", day), (2, 1, "a#2", "added", "critical", day), (3, 9, "b#1", "added", "major", day)], "change_id long, document_id long, node_key string, change_type string, severity string, detected_at timestamp")
    documents = spark.createDataFrame([(1, "增值税法", "CN")], "document_id long, title string, country string")
    analyses = spark.createDataFrame([(2, "s", 0.9, ["x", "y"])], "change_id long, summary string, confidence double, affected_parties array<string>")
    report = reports.change_report(changes, documents, analyses, F.timestamp_seconds(F.unix_seconds(F.lit(day)) + 60), 7)
    reports.write_report(report, str(tmp_path / "r"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
    assert text.startswith(f"# {reports.REPORT_TITLE}") and "共偵測到 **3** 筆異動" in text and "- 受影響對象：x, y" in text and "- 信心度：90%" in text
    assert text.index("## ??") < text.index("### 🟠") < text.index("## 中國") < text.index("### 🔴") < text.index("### 🟡") and "### 🟠 MAJOR b#1 — b#1" in text
    none = reports.change_report(changes.limit(0), documents, analyses, F.lit(day), 7).collect()
    assert len(none) == 1 and "過去 7 天內無偵測到異動" in none[0]["text"]
