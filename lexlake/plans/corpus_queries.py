"""Queries of the reference corpus and evidence (S1, E*) with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.operators import corpus as C
from lexlake.plans.bindings import AS_OF, DAY0, bound, with_ctes
from lexlake.plans.text_queries import _classified, _core_cut
from lexlake.shared import shared_dir

_NUMBER = "CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('财税〔', CAST(2000 + doc_id % 25 AS VARCHAR), '〕', CAST(doc_id AS VARCHAR), '号') END"
_INFERRED = _classified("title", "'CN'")
_KEYS = f"CASE doc_id % 6 WHEN 0 THEN 'cn_vat|cn_collection' WHEN 1 THEN 'cn_enterprise_income' WHEN 2 THEN 'cn_property' WHEN 4 THEN 'cn_stamp' ELSE CASE WHEN {_INFERRED} = 'cn_other' THEN '' ELSE {_INFERRED} END END"
_WRITTEN = "CASE doc_id % 4 WHEN 0 THEN concat('2024-0', CAST(1 + doc_id % 9 AS VARCHAR), '-15') WHEN 1 THEN concat('2023-0', CAST(1 + doc_id % 9 AS VARCHAR), '-03') WHEN 2 THEN concat('2022-0', CAST(1 + doc_id % 9 AS VARCHAR), '-07') END"
_URL = "CASE WHEN doc_id % 2 = 0 THEN concat('http://fgk.example.org/zcfgk/c', CAST(100000 + doc_id AS VARCHAR), '/content.html') ELSE concat('http://x.example.org/', CAST(10000000 + doc_id AS VARCHAR), '/') END"
_CORPUS = with_ctes("corpus_rows") + f", k AS (SELECT doc_id, title, content, aging, {_NUMBER} AS document_number, {_KEYS} AS keys, {_WRITTEN} AS written, {_URL} AS url FROM corpus_rows WHERE doc_id % 50 <> 49)"


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.load_corpus(bound(spark, sf_dir, "corpus_rows"), "policy", "v1", "http://fgk.example.org")


def s1_load_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _corpus(spark, sf_dir)
    day = F.date_format("written_date", "yyyy-MM-dd")
    return rows.select("title", "document_number", F.array_join("tax_keys", "|").alias("keys"), "aging", day.alias("written"), F.sha2("content", 256).alias("sha"))


S1_SQL = _CORPUS + " SELECT title, document_number, keys, aging, written, sha256(content) AS sha FROM k"


def s1_load_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.load_stats(bound(spark, sf_dir, "corpus_rows"), _corpus(spark, sf_dir))


S1B_SQL = _CORPUS + " SELECT (SELECT count(*) FROM corpus_rows) AS read, count(*) AS stored, count(*) FILTER (document_number <> '') AS with_document_number FROM k"


def e1_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with other brackets, and ones that nothing has."""
    keys = bound(spark, sf_dir, "docs").select(F.col("document_id").alias("query_id"), F.translate("external_id", "〔〕", "[]").alias("number"))
    return C.corpus_lookup(keys, _corpus(spark, sf_dir)).select("query_id", "document_number", "title")


E1_SQL = _CORPUS + " SELECT d.doc_id AS query_id, concat('财税〔', CAST(2000 + d.doc_id % 25 AS VARCHAR), '〕', CAST(d.doc_id AS VARCHAR), '号') AS document_number, k.title FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id AND k.document_number <> ''"

def _terms(text: str) -> str:
    """A search term out of each document: parts of its title or text, terms that
    nothing has, and ones that are too short."""
    text_part = f"substr({text}, CAST(1 + doc_id * 37 % 300 AS INT), CAST(9 + doc_id % 12 AS INT))"
    return f"""CASE doc_id % 8 WHEN 0 THEN substr(title, CAST(1 + doc_id % 5 AS INT), 4) WHEN 1 THEN substr(title, 3, 2) WHEN 2 THEN concat('zzzz', CAST(doc_id AS STRING))
      WHEN 3 THEN 'x' ELSE {text_part} END"""


def e2_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of all documents, searched in an index of the whole corpus."""
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    C.index_corpus(_corpus(spark, sf_dir), path)
    terms = bound(spark, sf_dir, "corpus_rows").select(F.col("doc_id").alias("query_id"), F.expr(_terms("content")).alias("query"))
    return C.corpus_search(terms, path, 10)


E2_SQL = _CORPUS + f""", q AS (SELECT doc_id AS query_id, {_terms("content")} AS query FROM corpus_rows), t AS (SELECT DISTINCT query FROM q WHERE length(query) >= 2),
  h AS (SELECT query, title, document_number, contains(title, query) AS in_title, row_number() OVER (PARTITION BY query ORDER BY contains(title, query) DESC, written DESC NULLS LAST, document_number, encode(title)) AS rank FROM t JOIN k ON contains(title, query) OR contains(content, query))
  SELECT query_id, rank, title, document_number, in_title FROM q JOIN h USING (query) WHERE rank <= 10"""


def e3_tax_key_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tax_key_index(_corpus(spark, sf_dir))


E3_SQL = _CORPUS + " SELECT document_number, split_part(keys, '|', 1) AS tax_key FROM k WHERE document_number <> '' AND keys <> ''"


def e3_repealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.repealed_numbers(_corpus(spark, sf_dir))


E3B_SQL = _CORPUS + " SELECT DISTINCT document_number FROM k WHERE document_number <> '' AND aging IN ('全文废止', '全文失效')"


def e4_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.corpus_stats(_corpus(spark, sf_dir))


E4_SQL = _CORPUS + " SELECT 'policy' AS corpus_key, count(*) AS documents, count(*) FILTER (document_number <> '') AS with_number, count(*) FILTER (aging IN ('全文废止', '全文失效')) AS repealed, 'v1' AS version FROM k"


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes whose new text cites two numbers, and their document's evidence otherwise."""
    docs = bound(spark, sf_dir, "docs")
    cites = F.when(F.col("document_id") % 3 > 0, F.concat(F.lit("另见"), "external_id", F.lit("和财税〔2001〕1号。"))).otherwise("nothing")
    changes = docs.select(F.col("document_id").alias("change_id"), "document_id", cites.alias("new_text"), F.concat(F.lit("D"), "document_id").alias("node_key"))
    fallback = docs.select("document_id", F.lit(1).alias("rank"), F.lit("search").alias("origin"), "title", F.lit("s").alias("snippet"), "url")
    return C.change_evidence(changes, _corpus(spark, sf_dir), fallback)


def e5_change_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("change_id", "rank", "origin", "title", "document_number", "repealed")


_EVIDENCE = _CORPUS + """, c AS (SELECT d.document_id, d.title, d.external_id, d.url FROM docs d), n AS (SELECT document_id, 1 AS pos, external_id AS document_number FROM c WHERE document_id % 3 > 0 UNION ALL SELECT document_id, 2, '财税〔2001〕1号' FROM c WHERE document_id % 3 > 0 AND document_id <> 1),
  h AS (SELECT n.document_id AS change_id, CAST(row_number() OVER (PARTITION BY n.document_id ORDER BY pos) AS INT) AS rank, k.title, k.document_number, k.aging, k.content, k.written, k.url FROM n JOIN k ON k.document_number = n.document_number),
  e AS (SELECT change_id, rank, 'corpus' AS origin, title, document_number, aging IN ('全文废止', '全文失效') AS repealed, substr(content, 1, 600) AS snippet, written, aging, url FROM h UNION ALL SELECT document_id, 1, 'search', title, NULL, false, 's', NULL, NULL, url FROM c WHERE document_id NOT IN (SELECT change_id FROM h))"""
_EVIDENCE = _EVIDENCE.replace("WITH ", with_ctes("docs").rstrip() + ", ", 1)
E5_SQL = _EVIDENCE + " SELECT change_id, rank, origin, title, document_number, repealed FROM e"


def e10_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.render_evidence(_evidence(spark, sf_dir)).select("change_id", F.sha2("text", 256).alias("sha"))


_LINE = "CASE WHEN coalesce({0}, '') <> '' THEN concat('   {1}：', {0}, chr(10)) ELSE '' END"
_CORPUS_ENTRY = f"""concat({_LINE.format("document_number", "文號")}, {_LINE.format("written", "成文日期")}, concat('   時效性：', CASE WHEN repealed THEN '⛔ ' ELSE '' END, aging, '（截至 v1）', chr(10)), {_LINE.format("snippet", "原文節錄")}, {_LINE.format("url", "來源")})"""
_SEARCH_ENTRY = f"""concat({_LINE.format("snippet", "摘要")}, {_LINE.format("url", "來源")})"""
E10_SQL = _EVIDENCE + f""", g AS (SELECT change_id, origin, bool_or(repealed) AS warn, string_agg(concat(CAST(rank AS VARCHAR), '. **', title, '**', chr(10), CASE origin WHEN 'corpus' THEN {_CORPUS_ENTRY} ELSE {_SEARCH_ENTRY} END, chr(10)), '' ORDER BY rank) AS body FROM e GROUP BY 1, 2)
  SELECT change_id, sha256(regexp_replace(CASE origin WHEN 'corpus' THEN concat('{C.EVIDENCE_PARTS["corpus"][0]}', chr(10), chr(10), body, CASE WHEN warn THEN '{C.REPEALED_NOTE.strip()}' ELSE '' END)
    ELSE concat('{C.EVIDENCE_PARTS["search"][0]}', chr(10), chr(10), body, '{C.EVIDENCE_PARTS["search"][1]}') END, '\\s+$', '')) AS sha FROM g"""


def e6_official(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library entries of the corpus titles, published some days off; every third
    document's number is unknown to the library."""
    docs = bound(spark, sf_dir, "docs")
    asked = docs.withColumn("external_id", F.when(F.col("document_id") % 3 == 0, F.concat("external_id", F.lit("x"))).otherwise(F.col("external_id")))
    lib = docs.select("title", F.col("external_id").alias("document_number"), F.timestamp_seconds(F.lit(DAY0) + F.col("document_id") * 7 % 1000 * 86_400).alias("pub_date"))
    return C.official_evidence(asked, lib, 3, 90)


E6_SQL = with_ctes("docs") + f""", d AS (SELECT *, CASE WHEN length(c) >= 4 THEN c ELSE trim(title) END AS core, CAST(document_id % 1000 AS INT) AS day FROM (SELECT *, {_core_cut("title")} AS c FROM docs) x), l AS (SELECT title, external_id AS num, CAST(document_id * 7 % 1000 AS INT) AS pub FROM docs),
  h AS (SELECT d.document_id, l.title, l.num, l.pub FROM d JOIN l ON l.num = d.external_id WHERE d.document_id % 3 > 0 UNION ALL SELECT d.document_id, l.title, l.num, l.pub FROM d JOIN l ON contains(l.title, d.core) AND abs(d.day - l.pub) <= 90 WHERE d.document_id % 3 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY pub DESC, encode(title), encode(num)) AS rank FROM h) SELECT document_id, rank, title, num AS document_number FROM r WHERE rank <= 3"""


def e7_plan_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap is wide, so all planned queries show."""
    docs = bound(spark, sf_dir, "docs")
    cache = docs.where("document_id % 4 = 0").select(F.sha2("title", 256).alias("query_hash"), F.timestamp_seconds(F.lit(AS_OF - 86_400 * 3) - F.col("document_id") % 2 * 86_400 * 30).alias("fetched_at"))
    changes = bound(spark, sf_dir, "changes")
    return C.plan_queries(changes, docs, cache, "major", 7, 1_000_000, F.timestamp_seconds(F.lit(AS_OF)))


E7_SQL = with_ctes("docs", "changes") + """, w AS (SELECT document_id, max(CASE severity WHEN 'critical' THEN 3 WHEN 'major' THEN 2 WHEN 'minor' THEN 1 ELSE 0 END) AS severity_rank FROM changes GROUP BY 1)
  SELECT sha256(d.title) AS query_hash, w.document_id, w.severity_rank, d.title AS query FROM w JOIN docs d USING (document_id) WHERE severity_rank >= 2 AND d.title NOT IN (SELECT title FROM docs WHERE document_id % 4 = 0)"""


def e8_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.evaluate_classifier(_corpus(spark, sf_dir))


_EVAL = f", g AS (SELECT split_part(keys, '|', 1) AS official, {_INFERRED} AS guessed, document_number FROM k WHERE keys <> '')"
E8_SQL = _CORPUS + _EVAL + " SELECT official, count(*) AS documents, count(*) FILTER (official = guessed) AS hits, round(avg(CASE WHEN official = guessed THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) FILTER (document_number <> '') AS with_number FROM g GROUP BY 1"


def e8_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.confusion(_corpus(spark, sf_dir))


E8B_SQL = _CORPUS + _EVAL + " SELECT official, guessed, count(*) AS n FROM g GROUP BY 1, 2"


def e9_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that cite their own number and one that nobody has."""
    rows = _corpus(spark, sf_dir)
    own = F.when(F.col("document_number") != "", F.concat(F.lit("按"), "document_number", F.lit("，参见财税〔1999〕1号。"))).otherwise("")
    return C.citation_coverage(rows.withColumn("content", own))


E9_SQL = _CORPUS + " SELECT 2 * count(*) AS citations, count(*) AS resolved, round(count(*) / (2 * count(*)), 6) AS share FROM k WHERE document_number <> ''"


def e11_search_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bound(spark, sf_dir, "docs")
    rows = docs.select("document_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("pos"), "title", "url")
    rows = rows.select(
        "document_id", "pos", F.concat(F.lit("<b>"), "title", F.lit("</b>")).alias("title"), F.concat(F.lit("a <em>snippet</em> "), F.col("pos")).alias("description"),
        F.when(F.col("pos") == 3, "").otherwise(F.when(F.col("document_id") % 2 == 0, F.col("url")).otherwise(F.concat("url", F.col("pos")))).alias("url"),
    )
    return C.search_evidence(rows).select("document_id", "pos", "title", "snippet", "url")


E11_SQL = with_ctes("docs") + """SELECT document_id, p AS pos, title, concat('a snippet ', CAST(p AS VARCHAR)) AS snippet, CASE WHEN document_id % 2 = 0 THEN url ELSE concat(url, CAST(p AS VARCHAR)) END AS url
  FROM docs CROSS JOIN (VALUES (1), (2)) AS v(p) WHERE document_id % 2 = 1 OR p = 1"""

QUERIES = {
    "s1_load_corpus": s1_load_corpus, "s1_load_stats": s1_load_stats, "e1_lookup": e1_lookup, "e2_search": e2_search, "e3_tax_key_index": e3_tax_key_index, "e3_repealed": e3_repealed, "e4_stats": e4_stats, "e5_change_evidence": e5_change_evidence,
    "e6_official": e6_official, "e7_plan_queries": e7_plan_queries, "e8_evaluate": e8_evaluate, "e8_confusion": e8_confusion, "e9_coverage": e9_coverage, "e10_render": e10_render, "e11_search_evidence": e11_search_evidence,
}
ORACLES = {
    "s1_load_corpus": S1_SQL, "s1_load_stats": S1B_SQL, "e1_lookup": E1_SQL, "e2_search": E2_SQL, "e3_tax_key_index": E3_SQL, "e3_repealed": E3B_SQL, "e4_stats": E4_SQL, "e5_change_evidence": E5_SQL, "e6_official": E6_SQL, "e7_plan_queries": E7_SQL,
    "e8_evaluate": E8_SQL, "e8_confusion": E8B_SQL, "e9_coverage": E9_SQL, "e10_render": E10_SQL, "e11_search_evidence": E11_SQL,
}
