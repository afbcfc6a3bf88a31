"""Substring search by the stored index against a plain scan."""

import random

import pytest
from pyspark.sql import functions as F

from lexlake.operators import corpus, textindex


def rows_of(seed):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice("ab c增值税é😀") for _ in range(rnd.randint(0, n)))
    rows = [(text(12), rnd.choice([text(60), text(300), None, ""]), f"n{i % 7}", None if i % 5 == 0 else i % 11, "clash") for i in range(120)]
    return rows + [rows[3], rows[3], (None, "ab", "n0", 1, "x")]


@pytest.mark.parametrize("segment", [1 << 16, 4], ids=["usual", "split"])
def test_search_equals_scan(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(textindex, "SEGMENT", segment)
    rows = rows_of(2)
    docs = spark.createDataFrame(rows, "title string, content string, document_number string, written_date int, gram string").repartition(3)
    path = str(tmp_path / "index")
    corpus.index_corpus(docs, path)
    rnd = random.Random(7)
    terms = ["ab", "增值", "值", "", None, "zzz", "a\x01b", "c\x00", "增值税增值税增", " ", "😀é"]
    for title, content, *_ in rows:
        whole = (title or "") + (content or "")
        at = rnd.randrange(max(1, len(whole)))
        terms.append(whole[at : at + rnd.randint(1, 8)])
    asked = spark.createDataFrame(list(enumerate(terms)), "query_id long, query string")
    got = {}
    for r in corpus.corpus_search(asked, path, 4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.title, r.document_number, r.in_title))
    for i, term in enumerate(terms):
        hits = [(t, c, n, w) for t, c, n, w, _ in rows if term is not None and len(term) >= 2 and (term in (t or "") or term in (c or ""))]
        hits.sort(key=lambda h: (term not in (h[0] or ""), h[3] is None, -(h[3] or 0), h[2], h[0] is not None, h[0] or ""))
        assert sorted(got.get(i, [])) == [(k + 1, t, n, term in (t or "")) for k, (t, c, n, w) in enumerate(hits[:4])], term


def test_no_nested_loop_and_short_lists(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "SEGMENT", 8)
    docs = spark.range(100).select(F.lit("the title").alias("title"), F.concat(F.lit("the text "), "id").alias("content"), F.lit("").alias("document_number"), F.lit(None).cast("date").alias("written_date"))
    path = str(tmp_path / "index")
    corpus.index_corpus(docs.repartition(2), path)
    assert spark.read.parquet(f"{path}/postings").agg(F.max(F.size("ids"))).first()[0] <= 8
    found = corpus.corpus_search(spark.createDataFrame([(1, "the t")], "query_id long, query string"), path, 5)
    assert found.count() == 5
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("listed, whole, bits", [(0, 32, 1 << 26), (0, 4, 1 << 15), (3, 4, 1 << 26)], ids=["scan", "beginnings", "both"])
def test_scan_equals_lists(spark, tmp_path, monkeypatch, listed, whole, bits):
    for name, value in (("LISTED", listed), ("WHOLE", whole), ("BITS", bits)):
        monkeypatch.setattr(textindex, name, value)
    test_search_equals_scan(spark, tmp_path, monkeypatch, 1 << 16)


def test_frequent_terms_shuffle_no_lists(spark, tmp_path):
    """Many terms of frequent grams: no list is read, and no string is passed on oftener than it can rank."""
    docs = spark.range(2000).select(F.lit("the title").alias("title"), F.concat(F.lit("the common text of "), F.col("id") % 50, F.lit(" pieces")).alias("content"), F.lit("").alias("document_number"), F.lit(None).cast("date").alias("written_date"))
    path = str(tmp_path / "index")
    corpus.index_corpus(docs.repartition(2), path)
    terms = spark.range(50).select(F.col("id").alias("query_id"), F.concat(F.lit("text of "), "id", F.lit(" p")).alias("query"))
    found = textindex._scanned(terms.select("query"), path, ["title", "content"], 5)
    assert found.count() <= 50 * 5 * spark.read.parquet(f"{path}/documents").select(F.shiftright("id", 33)).distinct().count()
    assert corpus.corpus_search(terms, path, 5).count() == 50 * 5


@pytest.mark.parametrize("named", [1 << 16, 40, 0], ids=["listed", "some", "scanned"])
def test_tiers_equal_scan(spark, tmp_path, monkeypatch, named):
    for name, value in (("FIRST", 3), ("GROWTH", 2), ("SAMPLE", 50), ("NAMED", named)):
        monkeypatch.setattr(textindex, name, value)
    test_search_equals_scan(spark, tmp_path, monkeypatch, 1 << 16)
    tiers = spark.read.parquet(str(tmp_path / "index/documents")).groupBy("tier").agg(F.min(F.coalesce("written_date", F.lit(-1))).alias("least"), F.max(F.coalesce("written_date", F.lit(-1))).alias("most"))
    tiers = tiers.orderBy("tier").collect()
    assert len(tiers) >= 4 and all(a.least >= b.most for a, b in zip(tiers, tiers[1:]))


def frequent(spark, path, n, partitions):
    """n documents in which each of 50 terms is, and titles for one more."""
    every = F.concat_ws(" ", *[F.lit(f"a common piece {i}.") for i in range(50)])
    docs = spark.range(n, numPartitions=partitions).select(F.concat(F.lit("the title "), F.col("id") % 9).alias("title"), every.alias("content"), F.col("id").cast("string").alias("document_number"), F.lit(None).cast("date").alias("written_date"))
    corpus.index_corpus(docs, path)
    return spark.createDataFrame([(f"common piece {i}.",) for i in range(50)] + [("the title",)], "query string")


def test_scan_does_not_grow_with_files(spark, tmp_path, monkeypatch):
    """Rows passed on by the scan go with the terms, not with terms times files of texts."""
    monkeypatch.setattr(textindex, "FIRST", 20, raising=False)
    terms = frequent(spark, str(tmp_path / "index"), 2000, 40)
    found = textindex._scanned(terms, str(tmp_path / "index"), ["title", "content"], 5)
    assert 51 * 5 <= found.count() <= 51 * 100
    asked = terms.withColumn("query_id", F.monotonically_increasing_id())
    assert corpus.corpus_search(asked, str(tmp_path / "index"), 5).count() == 51 * 5


def test_only_whole_terms_are_passed_on(spark, tmp_path):
    """Strings that begin like a term aren't: they are as many as the places in the texts."""
    path = str(tmp_path / "index")
    docs = spark.range(300).select(F.lit("t").alias("title"), F.concat(F.lit("beginning "), "id").alias("content"), F.lit("").alias("document_number"), F.lit(None).cast("date").alias("written_date"))
    corpus.index_corpus(docs, path)
    terms = spark.createDataFrame([("beginning 7",), ("beginning 77",), ("nothing has it",)], "query string")
    sought = textindex._bit_set(terms)
    raw = textindex._passed_on(spark.read.parquet(f"{path}/documents"), ["title", "content"], [sought, sought], 10)
    assert {r.query for r in raw.collect()} == {"beginning 7", "beginning 77"}


def test_lists_that_no_lookup_reads_are_not_stored(spark, tmp_path):
    path = str(tmp_path / "index")
    frequent(spark, path, 600, 3)
    grams, postings = spark.read.parquet(f"{path}/grams"), spark.read.parquet(f"{path}/postings")
    assert grams.where("gram = 'com'").first().texts == 600
    assert grams.where("texts <= 512").count() > 0
    assert postings.groupBy("gram").agg(F.sum(F.size("ids")).alias("texts")).exceptAll(grams).count() == 0
    assert postings.select("gram").distinct().exceptAll(grams.where("texts <= 512").select("gram")).count() == 0


def test_equal_ranks_are_dealt_to_all_tiers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "FIRST", 20, raising=False)
    docs = spark.range(400).select(F.lit("t").alias("title"), F.concat(F.lit("the text "), "id").alias("content"), F.lit("").alias("document_number"), F.lit(None).cast("date").alias("written_date"))
    corpus.index_corpus(docs, str(tmp_path / "index"))
    found = spark.read.parquet(str(tmp_path / "index/documents"))
    sizes = {r.tier: r["count"] for r in found.groupBy("tier").count().collect()}
    assert sorted(sizes) == [0, 1, 2, 3] and sum(sizes.values()) == 400 and sizes[0] < 60 < sizes[2]
    assert found.select("id").distinct().count() == 400
