"""Queries of row-level functions (C1–C17, N1, C22) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake import refdata as R
from lexlake.functions import text as T
from lexlake.functions.citations import extract_citations
from lexlake.functions.docnum import docnum_all, docnum_first, norm_docnum
from lexlake.operators import corpus as C
from lexlake.operators import graph as G
from lexlake.plans.bindings import bound, with_ctes
from lexlake.shared import short_batches

_DIGITS = "零一二三四五六七八九"
_NUMERAL = """concat(CASE WHEN n >= 1000 THEN concat(substr(z, 1 + n // 1000 % 10, 1), '千') ELSE '' END, CASE WHEN n >= 100 AND n // 100 % 10 > 0 THEN concat(substr(z, 1 + n // 100 % 10, 1), '百') ELSE '' END,
  CASE WHEN n // 10 % 10 > 0 THEN concat(CASE WHEN n < 20 THEN '' ELSE substr(z, 1 + n // 10 % 10, 1) END, '十') ELSE '' END, CASE WHEN n % 10 > 0 THEN substr(z, 1 + n % 10, 1) ELSE '' END)"""


def c1_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerals of 1 to 9999 spelled by rule out of part keys, read back; every
    seventh is spoilt and must pass through."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("id"), (F.col("p_partkey") % 9999 + 1).cast("int").alias("n"))
    spelled = part.withColumn("z", F.lit(_DIGITS)).withColumn("s", F.expr(_NUMERAL.replace("//", "DIV")))
    spelled = spelled.withColumn("s", F.when(F.col("id") % 7 == 0, F.concat("s", F.lit("x"))).otherwise(F.col("s")))
    return spelled.select("id", T.cn_to_int(F.col("s")).cast("long").alias("value"), T.to_arabic(F.col("s")).alias("arabic"))


C1_SQL = f"""SELECT id, CASE WHEN id % 7 <> 0 THEN n END AS value, CASE WHEN id % 7 <> 0 THEN CAST(n AS VARCHAR) ELSE concat(s, 'x') END AS arabic
FROM (SELECT *, {_NUMERAL} AS s FROM (SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_partkey % 9999 + 1 AS BIGINT) AS n, '{_DIGITS}' AS z FROM part) a) b"""


def n1_normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dirty = F.concat(F.lit("　“"), F.regexp_replace("text", "\n", "\r\n"), F.lit("”\t\t–　１２\n\n\n\nＡ "))
    return docs.select("doc_id", F.sha2(T.normalize_text(dirty), 256).alias("sha"))


N1_SQL = r"""SELECT doc_id, sha256(trim(concat('"', regexp_replace(text, '[ \t]+', ' ', 'g'), '" - 12', chr(10), chr(10), 'A'))) AS sha FROM documents"""


def c2_norm_docnum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bound(spark, sf_dir, "corpus_rows")
    return rows.select("doc_id", norm_docnum(F.col("document_number")).alias("number"))


C2_SQL = with_ctes("corpus_rows") + "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('财税〔', CAST(2000 + doc_id % 25 AS VARCHAR), '〕', CAST(doc_id AS VARCHAR), '号') END AS number FROM corpus_rows"


def c3_docnum_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = bound(spark, sf_dir, "cited").withColumn("t", F.concat("text", F.lit("。另见国家税务总局公告2025年第6号和国税发[2003] 67 号。")))
    return cited.select("doc_id", docnum_first(F.col("t")).alias("first"), F.array_join(docnum_all("t"), "|").alias("numbers"))


C3_SQL = with_ctes("cited") + """SELECT doc_id, CASE WHEN kind = 2 THEN own ELSE '国家税务总局公告2025年第6号' END AS first,
  concat(CASE WHEN kind = 2 THEN concat(own, '|') ELSE '' END, '国家税务总局公告2025年第6号|国税发〔2003〕67号') AS numbers
  FROM (SELECT *, concat('财税〔', CAST(y AS VARCHAR), '〕', CAST(a AS VARCHAR), '号') AS own FROM cited) x"""


def c5_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5, C6, C7, C8, C9, C10, C16 on the titles of documents."""
    docs = bound(spark, sf_dir, "docs")
    key = T.norm_key(F.concat(F.lit(" 《"), F.col("title"), F.lit("》")))
    title, kind = F.col("title"), F.col("doc_type")
    return docs.select(
        "document_id", key.alias("entity_key"), T.parent_key(key).alias("parent"), T.parent_from_title(title, kind).alias("title_parent"), T.entity_type(key).alias("entity_type"),
        T.doc_type(title, F.lit("")).alias("guessed_type"), T.hierarchy_level(title).alias("level"), T.law_name(title).alias("law_name"), T.core_title(title).alias("core"),
    )


def _first_hit(text: str, table: list[tuple[str, str]], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, '{k}') THEN '{v}'" for k, v in table) + f" ELSE {otherwise} END"


def _core_cut(title: str) -> str:
    ending = "(有关|有关事项|有关问题)?的?(公告|通知|决定|批复|规定|意见|办法|函)$"
    return f"regexp_replace(regexp_replace(regexp_replace(trim({title}), '^.*?关于', ''), '{ending}', ''), '^[《》 　]+|[《》 　]+$', '', 'g')"


_parent = "CASE " + " ".join(
    f"WHEN ends_with(k, '{s}') AND length(k) > {len(s)} AND regexp_matches(left(k, length(k) - {len(s)}), '(法|條例|条例|通則|通则)$') THEN left(k, length(k) - {len(s)})" for s in R.CHILD_SUFFIXES
) + " END"
_SUFFIXED = " OR ".join(f"ends_with(b, '{s}')" for s in R.LAW_TITLE_SUFFIXES)
C5_SQL = with_ctes("docs") + f"""SELECT document_id, k AS entity_key, {_parent} AS parent,
  CASE WHEN doc_type = 'statute' THEN NULL WHEN q <> '' THEN q ELSE {_first_hit("title", R.STATUTE_OF_KEYWORD)} END AS title_parent,
  CASE WHEN regexp_matches(k, '(法|條例|条例)(#|$)') THEN 'statute' WHEN regexp_matches(k, '準則|辦法|規則|細則|细则|办法|规则|暂行条例') THEN 'regulation' ELSE 'ruling' END AS entity_type,
  {_first_hit("title", R.TITLE_DOC_TYPES, "'announcement'")} AS guessed_type,
  CASE WHEN ends_with(title, '法') AND NOT contains(title, '办法') THEN 'law' WHEN ends_with(title, '条例') THEN 'regulation' WHEN regexp_matches(title, '(细则|办法|规则)$') THEN 'rule'
    WHEN regexp_matches(title, '公告|通知|批复') THEN 'notice' ELSE 'unknown' END AS level,
  CASE WHEN {_SUFFIXED} THEN b END AS law_name, CASE WHEN length(c) >= 4 THEN c ELSE trim(title) END AS core
FROM (SELECT *, regexp_extract(title, '《([一-鿿]{{4,30}}(?:法|條例|条例))》', 1) AS q, regexp_replace(title, '^中华人民共和国', '') AS b,
  regexp_replace(regexp_replace(regexp_replace(title, '\\s', '', 'g'), '[《》]', '', 'g'), '^中华人民共和国', '') AS k,
  {_core_cut("title")} AS c FROM docs) x"""


def c4_document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with provisions take the stem of their node keys, others their title."""
    docs = bound(spark, sf_dir, "docs")
    prov = bound(spark, sf_dir, "prov").where("snapshot_id % 2 = 0").withColumn("document_id", F.col("snapshot_id"))
    return G.document_entity_key(docs, prov).select("document_id", "entity_key")


C4_SQL = with_ctes("docs") + r"""SELECT document_id, CASE WHEN document_id % 2 = 0 THEN concat('D', CAST(document_id AS VARCHAR))
  ELSE regexp_replace(regexp_replace(regexp_replace(title, '\s', '', 'g'), '[《》]', '', 'g'), '^中华人民共和国', '') END AS entity_key FROM docs"""


def _classified(title: str, country: str) -> str:
    whens = " ".join(f"WHEN {country} = '{of}' AND (" + " OR ".join(f"contains({title}, '{w}')" for w in words) + f") THEN '{key}'" for key, of, words in R.TAX_TYPES)
    return f"CASE {whens} ELSE concat(lower({country}), '_other') END"


def c11_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bound(spark, sf_dir, "docs")
    rows = docs.withColumn("land", F.explode(F.array(F.lit("TW"), F.lit("CN"), F.lit("US"))))
    return rows.select("document_id", "land", T.classify_tax(F.col("title"), F.col("land")).alias("tax_key"))


C11_SQL = with_ctes("docs") + f"SELECT document_id, land, {_classified('title', 'land')} AS tax_key FROM docs CROSS JOIN (VALUES ('TW'), ('CN'), ('US')) AS l(land)"

_TAX_KEYS = "CASE doc_id % 6 WHEN 0 THEN 'cn_vat|cn_collection' WHEN 1 THEN 'cn_enterprise_income' WHEN 2 THEN 'cn_property' WHEN 3 THEN '' WHEN 4 THEN 'cn_stamp' ELSE '' END"


def c13_tax_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, "corpus_rows").select("doc_id", F.array_join(T.parse_tax_keys(F.col("tax_type")), "|").alias("keys"))


C13_SQL = f"SELECT doc_id, {_TAX_KEYS} AS keys FROM documents"


def c14_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four layouts of one date, and a text that is none."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_orderdate").cast("date").alias("d"))
    of = lambda fmt: F.date_format("d", fmt)
    roc = F.concat((F.year("d") - 1911).cast("string"), F.lit("年"), F.month("d").cast("string"), F.lit("月"), F.dayofmonth("d").cast("string"), F.lit("日"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    corpus = F.when(F.col("id") % 4 == 0, of("yyyy-MM-dd")).when(F.col("id") % 4 == 1, of("yyyy/MM/dd")).when(F.col("id") % 4 == 2, F.concat(of("yyyy"), F.lit("年"), of("M"), F.lit("月"), of("d"), F.lit("日"))).otherwise("soon")
    return o.select(
        "id", day(T.parse_date(corpus, "corpus")).alias("corpus_day"), day(T.parse_date(of("yyyyMMdd"), "ymd")).alias("ymd_day"), day(T.parse_date(roc, "roc")).alias("roc_day"),
        day(T.parse_date(F.concat(of("yyyy-MM-dd"), F.lit(" 10:00:00")), "api")).alias("api_day"),
    )


C14_SQL = """SELECT id, CASE WHEN id % 4 < 3 THEN s END AS corpus_day, s AS ymd_day, s AS roc_day, s AS api_day
FROM (SELECT CAST(o_orderkey AS BIGINT) AS id, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS s FROM orders) x"""


def c15_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bound(spark, sf_dir, "corpus_rows")
    url = T.absolute_url(F.col("url"), F.lit("http://fgk.example.org/"))
    law = F.concat(F.lit("https://law.example.org/LawAll.aspx?pcode=G0"), F.lpad(F.col("doc_id").cast("string"), 6, "0"))
    return rows.select("doc_id", T.to_https(url).alias("url"), T.url_doc_id(url).alias("url_id"), T.pcode(law).alias("pcode"))


C15_SQL = """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('https://fgk.example.org/zcfgk/c', CAST(100000 + doc_id AS VARCHAR), '/content.html') ELSE concat('https://x.example.org/', CAST(10000000 + doc_id AS VARCHAR), '/') END AS url,
  CASE WHEN doc_id % 2 = 0 THEN concat('c', CAST(100000 + doc_id AS VARCHAR)) ELSE CAST(10000000 + doc_id AS VARCHAR) END AS url_id, concat('G0', lpad(CAST(doc_id AS VARCHAR), 6, '0')) AS pcode FROM documents"""


def c22_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    found = bound(spark, sf_dir, "cited").select("doc_id", F.explode(extract_citations(F.col("text"), none, none)).alias("c"))
    return found.select("doc_id", "c.entity_key", "c.relation_type")


#: What the texts cite, by kind, with the relation that the words around it tell. Each is interpreted as well.
CITED_SQL = """SELECT doc_id, concat(tw_law, '#', CAST(a AS VARCHAR)) AS entity_key, 'authority_of' AS relation_type FROM cited WHERE kind = 0
UNION SELECT doc_id, concat(tw_law, '#', CAST(b AS VARCHAR)), 'authority_of' FROM cited WHERE kind = 0
UNION SELECT doc_id, cn_law, 'authority_of' FROM cited WHERE kind = 1
UNION SELECT doc_id, concat('财税〔', CAST(y AS VARCHAR), '〕', CAST(a AS VARCHAR), '号'), 'supersedes' FROM cited WHERE kind = 2
UNION SELECT doc_id, concat(tw_law, '#', CAST(a AS VARCHAR), '-2'), 'amends' FROM cited WHERE kind = 3"""
C22_SQL = with_ctes("cited") + f", k AS ({CITED_SQL}) SELECT doc_id, entity_key, relation_type FROM k UNION SELECT doc_id, entity_key, 'interprets' FROM k"


def c12_classify_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = C.load_corpus(bound(spark, sf_dir, "corpus_rows"), "policy", "v1", "http://fgk.example.org")
    return C.classify_docs(bound(spark, sf_dir, "docs"), corpus).select("document_id", "tax_key")


_OFFICIAL = "CASE WHEN document_id % 4 = 0 OR document_id % 50 = 49 THEN NULL WHEN document_id % 6 = 0 THEN 'cn_vat' WHEN document_id % 6 = 1 THEN 'cn_enterprise_income' WHEN document_id % 6 = 2 THEN 'cn_property' WHEN document_id % 6 = 4 THEN 'cn_stamp' WHEN i <> 'cn_other' THEN i END"
C12_SQL = with_ctes("docs") + f"""SELECT document_id, coalesce({_OFFICIAL}, {_classified('title', 'country')}) AS tax_key FROM (SELECT *, {_classified('title', "'CN'")} AS i FROM docs) x"""

QUERIES = {
    "c1_numerals": c1_numerals, "n1_normalize_text": n1_normalize_text, "c2_norm_docnum": c2_norm_docnum, "c3_docnum_all": c3_docnum_all, "c4_document_keys": c4_document_keys,
    "c5_to_c10_c16_keys_names_types": c5_keys, "c11_classify_tax": c11_classify, "c12_classify_docs": c12_classify_docs, "c13_tax_keys": c13_tax_keys, "c14_dates": c14_dates,
    "c15_urls": c15_urls, "c22_citations": c22_citations,
}
ORACLES = {
    "c1_numerals": C1_SQL, "n1_normalize_text": N1_SQL, "c2_norm_docnum": C2_SQL, "c3_docnum_all": C3_SQL, "c4_document_keys": C4_SQL, "c5_to_c10_c16_keys_names_types": C5_SQL,
    "c11_classify_tax": C11_SQL, "c12_classify_docs": C12_SQL, "c13_tax_keys": C13_SQL, "c14_dates": C14_SQL, "c15_urls": C15_SQL, "c22_citations": C22_SQL,
}
