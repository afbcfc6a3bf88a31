"""Queries of documents, versions and diffs (V*, C17, N9) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.functions.docnum import norm_docnum
from lexlake.operators import corpus as C
from lexlake.operators import normalize as N
from lexlake.operators import versions as V
from lexlake.plans.bindings import DAY0, DUCK, bound, with_ctes
from lexlake.plans.text_queries import C12_SQL
from lexlake.plans.text_queries import _parent as _PARENT_SQL

_DIFF = """d AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.node_key, b.node_key) AS node_key, a.text AS o, b.text AS n, a.ordinal AS oo, b.ordinal AS bo, a.pair_id IS NOT NULL AS has_a, b.pair_id IS NOT NULL AS has_b
  FROM v1 a FULL JOIN v2 b ON a.pair_id = b.pair_id AND a.node_key = b.node_key) """
_PUNCT = r"[\s　,，.。;；:：、]+"
_RATIO = """(2 * len(list_filter(range(1, 1 + least(length(x), length(y))), lambda i: substr(x, i, 1) <> substr(y, i, 1))) + abs(length(x) - length(y))) / greatest(length(x), length(y), 1)"""


def v4_diff_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minimum slice: two versions of every document, diffed by key and
    rated, counted per change type and severity."""
    diffs = V.diff_provisions(bound(spark, sf_dir, "v1"), bound(spark, sf_dir, "v2"), threshold=None, with_diff=False)
    return V.with_severity(diffs).groupBy("change_type", "severity").agg(F.count("*").alias("n"))


V4_SQL = with_ctes("v1", "v2") + f""", {_DIFF}, e AS (SELECT *, replace(coalesce(o, ''), ' ', '') AS x, replace(coalesce(n, ''), ' ', '') AS y FROM d WHERE NOT (has_a AND has_b AND o IS NOT DISTINCT FROM n)),
  f AS (SELECT CASE WHEN NOT has_b THEN 'removed' WHEN NOT has_a THEN 'added' ELSE 'modified' END AS change_type, CASE WHEN NOT (has_a AND has_b) THEN 'critical'
    WHEN regexp_replace(o, '{_PUNCT}', '', 'g') = regexp_replace(n, '{_PUNCT}', '', 'g') THEN 'cosmetic' WHEN {_RATIO} > 0.3 THEN 'critical' WHEN {_RATIO} > 0.1 THEN 'major' ELSE 'minor' END AS severity FROM e)
  SELECT change_type, severity, count(*) AS n FROM f GROUP BY ALL"""


def v4_diff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    diffs = V.diff_provisions(bound(spark, sf_dir, "v1"), bound(spark, sf_dir, "v2"), threshold=None, with_diff=False)
    return diffs.select("pair_id", "node_key", "change_type", F.sha2(F.coalesce("old_text", F.lit("")), 256).alias("old_sha"), F.sha2(F.coalesce("new_text", F.lit("")), 256).alias("new_sha"), "similarity")


V4_ROWS_SQL = with_ctes("v1", "v2") + f""", {_DIFF} SELECT pair_id, node_key, CASE WHEN NOT has_b THEN 'removed' WHEN NOT has_a THEN 'added' ELSE 'modified' END AS change_type,
  sha256(coalesce(o, '')) AS old_sha, sha256(coalesce(n, '')) AS new_sha, CASE WHEN NOT (has_a AND has_b) THEN 0.0 END AS similarity FROM d WHERE NOT (has_a AND has_b AND o IS NOT DISTINCT FROM n)"""


def v5_renumbered_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renumbering by equal texts: counts a document (SQL matches by rank within
    a text; which of two equal texts is taken doesn't change the count)."""
    diffs = V.diff_provisions(bound(spark, sf_dir, "v1"), bound(spark, sf_dir, "v2"), threshold=1.0, with_diff=False)
    return diffs.groupBy("pair_id", "change_type").agg(F.count("*").alias("n"))


V5_SQL = with_ctes("v1", "v2") + f""", {_DIFF}, r AS (SELECT pair_id, o AS t, row_number() OVER (PARTITION BY pair_id, o ORDER BY oo) AS k FROM d WHERE NOT has_b),
  a AS (SELECT pair_id, n AS t, row_number() OVER (PARTITION BY pair_id, n ORDER BY bo) AS k FROM d WHERE NOT has_a), m AS (SELECT r.pair_id, count(*) AS n FROM r JOIN a USING (pair_id, t, k) GROUP BY 1),
  c AS (SELECT pair_id, count(*) FILTER (NOT has_b) AS removed, count(*) FILTER (NOT has_a) AS added, count(*) FILTER (has_a AND has_b AND o <> n) AS modified FROM d GROUP BY 1),
  u AS (SELECT pair_id, 'removed' AS change_type, removed - coalesce(m.n, 0) AS n FROM c LEFT JOIN m USING (pair_id) UNION ALL SELECT pair_id, 'added', added - coalesce(m.n, 0) FROM c LEFT JOIN m USING (pair_id)
    UNION ALL SELECT pair_id, 'modified', modified FROM c UNION ALL SELECT pair_id, 'renumbered', n FROM m)
  SELECT pair_id, change_type, n FROM u WHERE n > 0"""


def v6_v7_full_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy renumbering at 0.9, difflib ratios and unified diffs (no SQL for difflib)."""
    return V.with_severity(V.diff_provisions(bound(spark, sf_dir, "v1"), bound(spark, sf_dir, "v2"))).select("pair_id", "node_key", "change_type", "similarity", "diff_text", "severity")


def v3_detect_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.detect_snapshots(bound(spark, sf_dir, "snaps")).select("document_id", "snapshot_id")


V3_SQL = with_ctes("snaps") + """SELECT document_id, snapshot_id FROM (SELECT *, lag(content_hash) OVER w AS b, row_number() OVER w AS r FROM snaps WINDOW w AS (PARTITION BY document_id ORDER BY fetched_at, snapshot_id)) x
  WHERE r = 1 OR b IS DISTINCT FROM content_hash"""


def v1_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents meet refs that change title and type, and as many new refs come."""
    docs = bound(spark, sf_dir, "docs")
    refs = docs.where("document_id % 2 = 0").select(
        "source_key", F.when(F.col("document_id") % 4 == 0, F.col("external_id")).otherwise(F.concat("external_id", F.lit("新"))).alias("external_id"),
        F.when(F.col("document_id") % 4 == 0, F.concat("title", F.lit("（修正）"))).otherwise(F.concat("title", "external_id")).alias("title"), F.lit("law?").alias("doc_type"), F.lit("").alias("url"), "issued_at",
    )
    out = V.upsert_documents(docs, refs)
    return out.select("source_key", "external_id", "doc_type", "title", "url")


V1_SQL = with_ctes("docs") + """SELECT source_key, external_id, CASE WHEN document_id % 4 = 0 THEN 'statute' ELSE doc_type END AS doc_type, CASE WHEN document_id % 4 = 0 THEN concat(title, '（修正）') ELSE title END AS title, url FROM docs
  UNION ALL SELECT source_key, concat(external_id, '新'), 'statute', concat(title, external_id), '' FROM docs WHERE document_id % 4 = 2"""


def v8_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive snapshots of the twenty documents, by line number as key."""
    prov = bound(spark, sf_dir, "prov").withColumn("node_key", F.col("heading"))
    changes = V.detect_changes(bound(spark, sf_dir, "snaps"), prov, threshold=None, with_diff=False)
    return changes.groupBy("document_id", "from_snapshot_id", "to_snapshot_id", "change_type").agg(F.count("*").alias("n"))


V8_SQL = with_ctes("snaps", "prov") + """, p AS (SELECT document_id, snapshot_id AS t, lag(snapshot_id) OVER (PARTITION BY document_id ORDER BY fetched_at, snapshot_id) AS f FROM snaps),
  q AS (SELECT * FROM p WHERE f IS NOT NULL), o AS (SELECT q.t, q.f, q.document_id, v.heading, v.text FROM q JOIN prov v ON v.snapshot_id = q.f), n AS (SELECT q.t, q.f, q.document_id, v.heading, v.text FROM q JOIN prov v ON v.snapshot_id = q.t),
  j AS (SELECT coalesce(o.document_id, n.document_id) AS document_id, coalesce(o.f, n.f) AS f, coalesce(o.t, n.t) AS t, o.text AS a, n.text AS b, o.t IS NULL AS fresh, n.t IS NULL AS gone FROM o FULL JOIN n ON o.t = n.t AND o.heading = n.heading)
  SELECT document_id, f AS from_snapshot_id, t AS to_snapshot_id, CASE WHEN gone THEN 'removed' WHEN fresh THEN 'added' ELSE 'modified' END AS change_type, count(*) AS n FROM j WHERE gone OR fresh OR a <> b GROUP BY ALL"""


def _twenty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, "docs")


def v9_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.version_timeline(_twenty(spark, sf_dir), bound(spark, sf_dir, "snaps"), bound(spark, sf_dir, "prov"), bound(spark, sf_dir, "changes"))
    at = {c: F.unix_timestamp(c) for c in ("dated_at", "first_crawled", "last_crawled")}
    return rows.withColumns(at)


V9_SQL = with_ctes("docs", "snaps", "prov", "changes") + f""", p AS (SELECT snapshot_id, count(*) AS n FROM prov GROUP BY 1), c AS (SELECT to_snapshot_id AS snapshot_id, count(*) AS n FROM changes GROUP BY 1), s AS (SELECT *, coalesce(issued_at, fetched_at) AS dated FROM snaps)
  SELECT s.document_id, d.title, concat('v', CAST(row_number() OVER (PARTITION BY s.document_id ORDER BY dated, s.snapshot_id) AS VARCHAR)) AS version, s.snapshot_id, {DUCK.epoch("dated")} AS dated_at, s.issued_at IS NOT NULL AS official,
  coalesce(p.n, 0) AS n_provisions, coalesce(c.n, 0) AS n_changes, {DUCK.epoch("min(s.fetched_at) OVER (PARTITION BY s.document_id)")} AS first_crawled, {DUCK.epoch("max(s.fetched_at) OVER (PARTITION BY s.document_id)")} AS last_crawled
  FROM s JOIN docs d ON d.document_id = s.document_id LEFT JOIN p ON p.snapshot_id = s.snapshot_id LEFT JOIN c ON c.snapshot_id = s.snapshot_id"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.timestamp_seconds(F.lit(DAY0 - 200 * 86_400) + F.col("o_orderkey") * 13 % 300 * 86_400)
    return o.select(F.col("o_orderkey").cast("long").alias("request_id"), (F.col("o_custkey") % 22).cast("long").alias("document_id"), day.alias("day"))


_REQ = f"req AS (SELECT CAST(o_orderkey AS BIGINT) AS request_id, CAST(o_custkey % 22 AS BIGINT) AS document_id, {DUCK.ts(f'{DAY0 - 200 * 86_400} + CAST(o_orderkey AS BIGINT) * 13 % 300 * 86400')} AS day FROM orders)"


def v10_version_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.snapshot_at(_requests(spark, sf_dir), bound(spark, sf_dir, "snaps")).select("request_id", "document_id", "snapshot_id")


V10_SQL = with_ctes("snaps") + f""", s AS (SELECT *, coalesce(issued_at, fetched_at) AS dated FROM snaps), {_REQ}, h AS (SELECT r.request_id, s.snapshot_id, row_number() OVER (PARTITION BY r.request_id ORDER BY s.dated DESC, s.snapshot_id DESC) AS k
  FROM req r JOIN s ON s.document_id = r.document_id AND s.dated < r.day + INTERVAL 1 DAY) SELECT r.request_id, r.document_id, h.snapshot_id FROM req r LEFT JOIN h ON h.request_id = r.request_id AND h.k = 1"""


def v11_diff_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each snapshot two requests of its document: the day it was fetched
    against ten days before, and a day before all against it."""
    snaps, k = bound(spark, sf_dir, "snaps"), F.col("snapshot_id")
    rows = snaps.select("document_id", k, F.explode(F.array(F.lit(10), F.lit(1000))).alias("back"))
    at = lambda days: F.timestamp_seconds(F.lit(DAY0) + F.expr("snapshot_id DIV 24") * 86_400 - days * 86_400)
    rows = rows.select((k * 2 + (F.col("back") == 10).cast("int")).alias("request_id"), "document_id", at(F.col("back")).alias("day_from"), at(F.lit(0)).alias("day_to"))
    prov = bound(spark, sf_dir, "prov").withColumn("node_key", F.col("heading"))
    return V.diff_between(rows, snaps, prov, threshold=None)


V11_SQL = with_ctes("snaps", "prov") + f""", s AS (SELECT *, coalesce(issued_at, fetched_at) AS dated FROM snaps), r AS (SELECT document_id, snapshot_id // 24 AS i, back, snapshot_id * 2 + CASE back WHEN 10 THEN 1 ELSE 0 END AS request_id FROM snaps CROSS JOIN (VALUES (10), (1000)) AS b(back)),
  x AS (SELECT r.request_id, w.k, s.snapshot_id, row_number() OVER (PARTITION BY r.request_id, w.k ORDER BY s.dated DESC, s.snapshot_id DESC) AS n FROM r CROSS JOIN (VALUES (0), (1)) AS w(k) JOIN s ON s.document_id = r.document_id AND s.dated < {DUCK.ts(f"{DAY0} + r.i * 86400 - w.k * r.back * 86400")} + INTERVAL 1 DAY),
  p AS (SELECT r.request_id, a.snapshot_id AS f, b.snapshot_id AS t FROM r LEFT JOIN x a ON a.request_id = r.request_id AND a.k = 1 AND a.n = 1 LEFT JOIN x b ON b.request_id = r.request_id AND b.k = 0 AND b.n = 1),
  o AS (SELECT p.request_id, v.heading, v.text FROM p JOIN prov v ON v.snapshot_id = p.f WHERE p.f <> p.t), n AS (SELECT p.request_id, v.heading, v.text FROM p JOIN prov v ON v.snapshot_id = p.t WHERE p.f <> p.t),
  c AS (SELECT coalesce(o.request_id, n.request_id) AS request_id, count(*) FILTER (o.request_id IS NULL) AS added, count(*) FILTER (n.request_id IS NULL) AS removed, count(*) FILTER (o.text <> n.text) AS modified FROM o FULL JOIN n ON o.request_id = n.request_id AND o.heading = n.heading GROUP BY 1)
  SELECT p.request_id, f IS NOT NULL AND t IS NOT NULL AS found, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, coalesce(modified, 0) AS modified, CAST(0 AS BIGINT) AS renumbered,
  f IS NOT NULL AND t IS NOT NULL AND coalesce(added, 0) + coalesce(removed, 0) + coalesce(modified, 0) = 0 AS unchanged FROM p LEFT JOIN c USING (request_id)"""


def v12_list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.list_documents(bound(spark, sf_dir, "docs"), bound(spark, sf_dir, "snaps"))
    return rows.select("document_id", "title", "n_versions", F.unix_timestamp("latest").alias("latest"))


V12_SQL = with_ctes("docs", "snaps") + f"""SELECT document_id, title, n_versions, {DUCK.epoch("latest")} AS latest FROM (SELECT d.document_id, d.title, coalesce(s.n, 0) AS n_versions, s.latest, row_number() OVER (PARTITION BY d.title ORDER BY s.latest DESC NULLS LAST, d.document_id) AS r FROM docs d
  LEFT JOIN (SELECT document_id, count(*) AS n, max(coalesce(issued_at, fetched_at)) AS latest FROM snaps GROUP BY 1) s USING (document_id)) x WHERE r = 1"""


def v13_statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bound(spark, sf_dir, "docs").withColumn("tax_key", F.concat(F.lit("t"), F.col("document_id") % 6))
    return V.statutes_for_tax(docs, "TW", "t3").select("document_id", "doc_type")


V13_SQL = with_ctes("docs") + "SELECT document_id, doc_type FROM docs WHERE country = 'TW' AND document_id % 6 = 3 AND doc_type IN ('statute', 'regulation')"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, titles, bracketed names, fragments, a law of which only the
    implementing rules are stored, an id in blanks, a part of many names, nonsense."""
    docs = bound(spark, sf_dir, "docs")
    kind = F.col("document_id") % 5
    text = F.when(kind == 0, F.col("external_id")).when(kind == 1, F.col("title")).when(kind == 2, F.concat(F.lit("《"), F.col("title"), F.lit("》"))).when(kind == 3, F.substring("title", 3, 6))
    other = F.element_at(F.array(F.lit("环境保护税法"), F.concat("external_id", F.lit(" ")), F.lit("税法"), F.lit("no such law")), (F.col("document_id") % 4 + 1).cast("int"))
    text = text.otherwise(other)
    return docs.select(F.col("document_id").alias("query_id"), text.alias("query"))


def v14_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.resolve_documents(_asked(spark, sf_dir), bound(spark, sf_dir, "docs"))
    return found.withColumn("children", F.array_join("children", "/"))


_NORM = r"regexp_replace(regexp_replace(regexp_replace({}, '\s', '', 'g'), '[《》]', '', 'g'), '^中华人民共和国', '')"
_ASK = "q AS (SELECT document_id AS query_id, CASE document_id % 5 WHEN 0 THEN external_id WHEN 1 THEN title WHEN 2 THEN concat('《', title, '》') WHEN 3 THEN substr(title, 3, 6) ELSE CASE document_id % 4 WHEN 0 THEN '环境保护税法' WHEN 1 THEN concat(external_id, ' ') WHEN 2 THEN '税法' ELSE 'no such law' END END AS query FROM docs)"


V14_SQL = with_ctes("docs") + f""", {_ASK}, k AS (SELECT document_id, external_id, title, {_NORM.format("title")} AS k FROM docs), w AS (SELECT query_id, query, {_NORM.format("query")} AS w FROM q),
  p1 AS (SELECT k AS top, {_PARENT_SQL} AS u1 FROM (SELECT DISTINCT k FROM k) x), p2 AS (SELECT top, u1, {_PARENT_SQL} AS u2 FROM (SELECT *, u1 AS k FROM p1) x), p3 AS (SELECT top, u1, u2, {_PARENT_SQL} AS u3 FROM (SELECT *, u2 AS k FROM p2) x),
  p4 AS (SELECT top, u1, u2, u3, {_PARENT_SQL} AS u4 FROM (SELECT *, u3 AS k FROM p3) x),
  a1 AS (SELECT w.query_id, min(k.document_id) AS d FROM w JOIN k ON k.external_id = w.query GROUP BY 1), a2 AS (SELECT w.query_id, min(k.document_id) AS d FROM w JOIN k ON k.title = w.query GROUP BY 1), a3 AS (SELECT w.query_id, min(k.document_id) AS d FROM w JOIN k ON k.k = w.w GROUP BY 1 HAVING count(*) = 1),
  h AS (SELECT w.query_id, k.document_id, k.title, coalesce(u1 = w.w, false) OR coalesce(u2 = w.w, false) OR coalesce(u3 = w.w, false) OR coalesce(u4 = w.w, false) AS child FROM w JOIN k ON contains(k.k, w.w) JOIN p4 ON p4.top = k.k WHERE w.w <> '' AND w.query_id NOT IN (SELECT query_id FROM a1 UNION SELECT query_id FROM a2 UNION SELECT query_id FROM a3)),
  c AS (SELECT query_id, count(*) AS n, min(document_id) AS d, bool_and(child) AS missing, string_agg(DISTINCT title, '/' ORDER BY title) AS children FROM h GROUP BY 1)
  SELECT w.query_id, CASE WHEN a1.d IS NOT NULL THEN 'external_id' WHEN a2.d IS NOT NULL THEN 'title' WHEN a3.d IS NOT NULL THEN 'name' WHEN c.missing THEN 'parent_missing' WHEN c.n = 1 THEN 'substring' WHEN c.n > 1 THEN 'ambiguous' ELSE 'not_found' END AS status,
    coalesce(a1.d, a2.d, a3.d, CASE WHEN NOT c.missing AND c.n = 1 THEN c.d END) AS document_id, coalesce(c.n, 0) AS candidates, CASE WHEN c.missing THEN c.children ELSE '' END AS children
  FROM w LEFT JOIN a1 USING (query_id) LEFT JOIN a2 USING (query_id) LEFT JOIN a3 USING (query_id) LEFT JOIN c USING (query_id)"""


def v15_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.suggest_documents(_asked(spark, sf_dir), bound(spark, sf_dir, "docs"), 5)


V15_SQL = with_ctes("docs") + f""", {_ASK}, h AS (SELECT q.query_id, d.document_id, row_number() OVER (PARTITION BY q.query_id ORDER BY encode(d.title), d.document_id) AS rank FROM q JOIN docs d ON contains(d.title, q.query) OR contains(d.external_id, q.query)),
  f AS (SELECT document_id, row_number() OVER (ORDER BY encode(title), document_id) AS rank FROM docs) SELECT query_id, rank, document_id FROM h WHERE rank <= 5 UNION ALL SELECT q.query_id, f.rank, f.document_id FROM q CROSS JOIN f WHERE f.rank <= 5 AND q.query_id NOT IN (SELECT query_id FROM h)"""


def v16_change_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = bound(spark, sf_dir, "changes").withColumn("node_key", F.concat(F.lit("L"), F.col("change_id") % 12))
    prov = bound(spark, sf_dir, "prov").withColumn("node_key", F.col("heading"))
    sha = lambda c: F.sha2(c, 256).alias(c)
    return V.change_texts(changes, prov).select("change_id", sha("old_text"), sha("new_text"))


V16_SQL = with_ctes("changes", "prov") + """SELECT c.change_id, sha256(o.text) AS old_text, sha256(n.text) AS new_text FROM changes c
  LEFT JOIN prov o ON o.snapshot_id = c.from_snapshot_id AND o.heading = concat('L', CAST(c.change_id % 12 AS VARCHAR)) LEFT JOIN prov n ON n.snapshot_id = c.to_snapshot_id AND n.heading = concat('L', CAST(c.change_id % 12 AS VARCHAR))"""


def n9_hash_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.hash_documents(bound(spark, sf_dir, "prov"), ["snapshot_id"])


N9_SQL = "SELECT doc_id AS snapshot_id, sha256(text) AS content_hash, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_provisions FROM documents"


def v2_filter_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts a source of the refs kept for VAT and property taxes."""
    corpus = C.load_corpus(bound(spark, sf_dir, "corpus_rows"), "policy", "v1", "http://fgk.example.org")
    refs = bound(spark, sf_dir, "docs").withColumn("external_id", norm_docnum(F.col("external_id")))
    return C.filter_refs(refs, ["cn_vat", "cn_property", "tw_property"], corpus)[1]


V2_SQL = C12_SQL.replace("SELECT document_id, coalesce(", "SELECT source_key, count(*) AS found, count(*) FILTER (k) AS kept, count(*) FILTER (NOT k) AS filtered FROM (SELECT source_key, coalesce(").replace(
    " AS tax_key FROM", " IN ('cn_vat', 'cn_property', 'tw_property') AS k FROM") + ") y GROUP BY 1"


def v2_source_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with keys of their own: some known, an unknown one, or none."""
    corpus = C.load_corpus(bound(spark, sf_dir, "corpus_rows"), "policy", "v1", "http://fgk.example.org")
    refs = bound(spark, sf_dir, "docs").withColumn("external_id", norm_docnum(F.col("external_id")))
    n = F.substring("source_key", 2, 9).cast("int") % 3
    keys = F.when(n == 0, F.array(F.lit("cn_vat"), F.lit("no_such_key"))).when(n == 1, F.array(F.lit("no_such_key")))
    return C.filter_refs(refs, None, corpus, bound(spark, sf_dir, "sources").withColumn("tax_keys", keys))[1]


V2B_SQL = C12_SQL.replace("SELECT document_id, coalesce(", "SELECT source_key, count(*) AS found, count(*) FILTER (k) AS kept, count(*) FILTER (NOT k) AS filtered FROM (SELECT source_key, CAST(substr(source_key, 2) AS INT) % 3 <> 0 OR coalesce(").replace(
    " AS tax_key FROM", " = 'cn_vat' AS k FROM") + ") y GROUP BY 1"

QUERIES = {
    "v2_source_keys": v2_source_keys,
    "v4_diff_severity": v4_diff_severity, "v4_diff_rows": v4_diff_rows, "v5_renumbered_equal": v5_renumbered_equal, "v6_v7_full_diff": v6_v7_full_diff, "v3_detect_snapshots": v3_detect_snapshots, "v1_upsert": v1_upsert,
    "v8_change_log": v8_change_log, "v9_timeline": v9_timeline, "v10_version_at": v10_version_at, "v11_diff_between": v11_diff_between, "v12_list_documents": v12_list_documents, "v13_statutes": v13_statutes,
    "v14_resolve": v14_resolve, "v15_suggest": v15_suggest, "v16_change_texts": v16_change_texts, "n9_hash_documents": n9_hash_documents, "v2_filter_refs": v2_filter_refs,
}
ORACLES = {
    "v2_source_keys": V2B_SQL,
    "v4_diff_severity": V4_SQL, "v4_diff_rows": V4_ROWS_SQL, "v5_renumbered_equal": V5_SQL, "v3_detect_snapshots": V3_SQL, "v1_upsert": V1_SQL, "v8_change_log": V8_SQL, "v9_timeline": V9_SQL, "v10_version_at": V10_SQL,
    "v11_diff_between": V11_SQL, "v12_list_documents": V12_SQL, "v13_statutes": V13_SQL, "v14_resolve": V14_SQL, "v15_suggest": V15_SQL, "v16_change_texts": V16_SQL, "n9_hash_documents": N9_SQL, "v2_filter_refs": V2_SQL,
}
