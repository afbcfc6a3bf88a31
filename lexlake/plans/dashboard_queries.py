"""Queries of dashboards, reports, sources and streams (D*, S*, N*, T1) with their SQL."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.operators import dashboard as D
from lexlake.operators.corpus import EVIDENCE_PARTS, NO_EVIDENCE
from lexlake.operators import normalize as N
from lexlake.plans.bindings import AS_OF, DAY0, DUCK, bound, with_ctes
from lexlake.plans.matrix_queries import _CELLS
from lexlake.plans.text_queries import C5_SQL, _classified
from lexlake.shared import shared_dir
from lexlake.functions.text import classify_tax, norm_key
from lexlake.sources import landed, reports
from lexlake.streaming import ingest

_AS_OF, _CUT = DUCK.ts(str(AS_OF)), DUCK.ts(str(AS_OF - 10 * 86_400))
_DOCS = f"dt AS (SELECT *, {_classified('title', 'country')} AS tax_key FROM docs)"


def as_of() -> Column:
    return F.timestamp_seconds(F.lit(AS_OF))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, "docs").withColumn("tax_key", classify_tax(F.col("title"), F.col("country")))


def d1_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.tax_type_rollup(_docs(spark, sf_dir), bound(spark, sf_dir, "snaps"), bound(spark, sf_dir, "changes"), as_of(), 10)
    return out.withColumn("latest", F.unix_timestamp("latest"))


D1_SQL = with_ctes("docs", "snaps", "changes") + f""", {_DOCS}, s AS (SELECT document_id, count(*) AS n, max(coalesce(issued_at, fetched_at)) AS l FROM snaps GROUP BY 1),
  c AS (SELECT document_id, count(*) AS n, count(*) FILTER (severity IN ('critical', 'major')) AS k FROM changes WHERE detected_at >= {_CUT} GROUP BY 1),
  g AS (SELECT country, tax_key, count(*) AS documents, CAST(coalesce(sum(s.n), 0) AS BIGINT) AS versions, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS recent, CAST(coalesce(sum(c.k), 0) AS BIGINT) AS critical, max(s.l) AS l FROM dt LEFT JOIN s USING (document_id) LEFT JOIN c USING (document_id) GROUP BY 1, 2)
  SELECT country, tax_key, documents, versions, recent, critical, {DUCK.epoch("l")} AS latest, CAST(floor((epoch({_AS_OF}) - epoch(l)) / 86400) AS INT) AS days_since, CASE WHEN critical > 0 THEN 'critical' WHEN recent > 0 THEN 'changed' ELSE 'stable' END AS status FROM g"""


def d2_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.tax_type_summary("cn_vat", _docs(spark, sf_dir), bound(spark, sf_dir, "snaps"), bound(spark, sf_dir, "prov"), bound(spark, sf_dir, "changes"), bound(spark, sf_dir, "analyses"), as_of(), 10)


D2_SQL = with_ctes("docs", "snaps", "prov", "changes", "analyses") + f""", {_DOCS}, l AS (SELECT document_id, snapshot_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY coalesce(issued_at, fetched_at) DESC, snapshot_id DESC) AS r FROM snaps) x WHERE r = 1), p AS (SELECT snapshot_id, count(*) AS n FROM prov GROUP BY 1),
  c AS (SELECT document_id, count(*) AS n, count(confidence) AS a, round(avg(confidence), 6) AS m FROM changes LEFT JOIN analyses USING (change_id) WHERE detected_at >= {_CUT} GROUP BY 1)
  SELECT dt.document_id, dt.title, coalesce(p.n, 0) AS n_provisions, coalesce(c.n, 0) AS n_changes, coalesce(c.a, 0) AS n_analysed, c.m AS confidence FROM dt LEFT JOIN l USING (document_id) LEFT JOIN p USING (snapshot_id) LEFT JOIN c ON c.document_id = dt.document_id WHERE dt.tax_key = 'cn_vat'"""


def d3_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda name: bound(spark, sf_dir, name)
    return D.dashboard_stats(_docs(spark, sf_dir), of("snaps"), of("sources"), of("changes"), of("analyses"), as_of(), 10)


D3_SQL = with_ctes("docs", "snaps", "sources", "changes", "analyses") + f""", {_DOCS} SELECT (SELECT count(*) FROM dt) AS documents, (SELECT count(DISTINCT tax_key) FROM dt) AS tax_types, (SELECT count(*) FROM snaps) AS snapshots,
  (SELECT count(*) FROM sources WHERE enabled) AS sources, count(*) AS recent, count(*) FILTER (summary IS NULL) AS unanalysed, round(avg(confidence), 3) AS confidence FROM changes LEFT JOIN analyses USING (change_id) WHERE detected_at >= {_CUT}"""


def d4_list_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top 50 of the CN changes in the window, with the cells they affect."""
    rows = D.list_changes(bound(spark, sf_dir, "changes"), _docs(spark, sf_dir), bound(spark, sf_dir, "snaps").select("snapshot_id", "issued_at", "fetched_at"), as_of(), 10, country="CN", limit=50)
    out = D.change_feed(rows, bound(spark, sf_dir, "fields"), bound(spark, sf_dir, "requirements"))
    return out.select("change_id", "document_id", "title", "tax_key", "official", F.unix_timestamp("dated_at").alias("dated_at"), "affected")


D4_SQL = with_ctes("docs", "snaps", "changes", "flat_fields") + f""", {_DOCS}, {_CELLS}, n AS (SELECT k, count(DISTINCT (requirement_id, field_key)) AS affected FROM ci GROUP BY 1),
  t AS (SELECT c.change_id, c.document_id, dt.title, dt.tax_key, s.issued_at IS NOT NULL AS official, s.snapshot_id, coalesce(s.issued_at, s.fetched_at) AS dated, c.node_key, c.detected_at FROM changes c JOIN dt USING (document_id) LEFT JOIN snaps s ON s.snapshot_id = c.to_snapshot_id
    WHERE c.detected_at >= {_CUT} AND dt.country = 'CN' ORDER BY dated DESC NULLS LAST, c.detected_at DESC, c.change_id LIMIT 50)
  SELECT change_id, document_id, title, tax_key, CASE WHEN snapshot_id IS NOT NULL THEN official END AS official, {DUCK.epoch("dated")} AS dated_at, coalesce(n.affected, 0) AS affected FROM t LEFT JOIN n ON n.k = t.node_key"""


def d5_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provisions carry keys of the changes, some of them twice in a version."""
    changes = bound(spark, sf_dir, "changes")
    key = F.concat(F.lit("L"), (F.col("snapshot_id") + F.col("ordinal")) % 20, F.lit("#"), F.col("ordinal") % 50)
    out = D.change_detail(changes, _docs(spark, sf_dir), bound(spark, sf_dir, "prov").withColumn("node_key", key), bound(spark, sf_dir, "analyses"), bound(spark, sf_dir, "fields"), bound(spark, sf_dir, "requirements"))
    return out.select("change_id", "title", "summary", "confidence", "affected", F.sha2("new_text", 256).alias("new_sha"))


D5_SQL = with_ctes("docs", "changes", "analyses", "flat_fields", "prov") + f""", {_CELLS}, n AS (SELECT k, count(DISTINCT (requirement_id, field_key)) AS affected FROM ci GROUP BY 1),
  lk AS (SELECT snapshot_id, concat('L', CAST((snapshot_id + ordinal) % 20 AS VARCHAR), '#', CAST(ordinal % 50 AS VARCHAR)) AS node_key, arg_max(text, ordinal) AS text FROM prov GROUP BY 1, 2)
  SELECT c.change_id, d.title, a.summary, a.confidence, coalesce(n.affected, 0) AS affected, sha256(p.text) AS new_sha FROM changes c LEFT JOIN docs d USING (document_id) LEFT JOIN analyses a ON a.change_id = c.change_id LEFT JOIN n ON n.k = c.node_key LEFT JOIN lk p ON p.snapshot_id = c.to_snapshot_id AND p.node_key = c.node_key"""


def d6_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the latest 100 runs."""
    return D.list_runs(bound(spark, sf_dir, "runs"), 100).select("run_id", "status", F.floor("seconds").alias("seconds"))


D6_SQL = with_ctes("runs") + "SELECT run_id, status, CAST(floor(epoch(finished_at) - epoch(started_at)) AS BIGINT) AS seconds FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 100"


def d6_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.run_health(bound(spark, sf_dir, "runs"), 200)


D6B_SQL = with_ctes("runs") + """SELECT count(*) AS total, round(count(*) FILTER (status = 'completed') / count(*), 3) AS success_rate, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'running') AS running
  FROM (SELECT * FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 200) x"""


def d7_analysis_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of keys in the sparse graph, with their context lists and texts."""
    changes = bound(spark, sf_dir, "changes").withColumn("node_key", F.concat(F.lit("K"), F.col("change_id")))
    evidence = bound(spark, sf_dir, "docs").select(F.col("document_id").alias("change_id"), F.lit(1).alias("rank"), F.lit("search").alias("origin"), "title", F.lit("s").alias("snippet"), "url")
    # 7 × 143 is 1 of 1000, so this is the key of a change that made the snapshot.
    key = F.concat(F.lit("K"), F.col("snapshot_id") * 143 % 1000 + F.col("ordinal") * 1000)
    out = D.analysis_inputs(changes, _docs(spark, sf_dir), bound(spark, sf_dir, "prov").withColumn("node_key", key), bound(spark, sf_dir, "thin"), evidence)
    join = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    return out.select("change_id", "title", join("parent_law"), join("child"), join("sibling"), "evidence", F.sha2("old_text", 256).alias("old_sha"), F.sha2("new_text", 256).alias("new_sha"))


D7_SQL = with_ctes("docs", "changes", "thin", "prov") + f""", pk AS (SELECT snapshot_id, concat('K', CAST(snapshot_id * 143 % 1000 + ordinal * 1000 AS VARCHAR)) AS node_key, text FROM prov), k AS (SELECT change_id, document_id, from_snapshot_id, to_snapshot_id, concat('K', CAST(change_id AS VARCHAR)) AS e FROM changes), p AS (SELECT from_key AS e, string_agg(DISTINCT to_key, ',' ORDER BY to_key) AS l FROM thin GROUP BY 1), c AS (SELECT to_key AS e, string_agg(DISTINCT from_key, ',' ORDER BY from_key) AS l FROM thin GROUP BY 1),
  s AS (SELECT t.from_key AS e, string_agg(DISTINCT u.from_key, ',' ORDER BY u.from_key) AS l FROM thin t JOIN thin u ON u.to_key = t.to_key AND u.from_key <> t.from_key GROUP BY 1)
  SELECT k.change_id, d.title, coalesce(p.l, '') AS parent_law, coalesce(c.l, '') AS child, coalesce(s.l, '') AS sibling, CASE WHEN x.title IS NULL THEN '{NO_EVIDENCE}' ELSE '{EVIDENCE_PARTS["search"][0]}' || chr(10) || chr(10) || '1. **' || x.title || '**' || chr(10) || '   摘要：s' || chr(10) || '   來源：' || x.url || chr(10) || chr(10) || '{EVIDENCE_PARTS["search"][1]}' END AS evidence, sha256(o.text) AS old_sha, sha256(n.text) AS new_sha FROM k LEFT JOIN docs d USING (document_id) LEFT JOIN pk o ON o.snapshot_id = k.from_snapshot_id AND o.node_key = k.e LEFT JOIN pk n ON n.snapshot_id = k.to_snapshot_id AND n.node_key = k.e LEFT JOIN docs x ON x.document_id = k.change_id LEFT JOIN p ON p.e = k.e LEFT JOIN c ON c.e = k.e LEFT JOIN s ON s.e = k.e"""


def d8_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that began with the tables' hundredth hour."""
    docs = _docs(spark, sf_dir)
    kept = F.col("tax_key") == "cn_vat"
    discovered = docs.groupBy("source_key").agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("filtered"))
    flagged = bound(spark, sf_dir, "changes").where("change_id % 4 = 0").select("change_id")
    return D.run_stats(discovered, docs.where(kept), bound(spark, sf_dir, "snaps"), bound(spark, sf_dir, "changes"), flagged, F.timestamp_seconds(F.lit(DAY0 + 360_000)))


_BEGAN = DUCK.ts(str(DAY0 + 360_000))
D8_SQL = with_ctes("docs", "snaps", "changes") + f""", {_DOCS}, s AS (SELECT document_id, count(*) AS n FROM snaps WHERE fetched_at >= {_BEGAN} GROUP BY 1), c AS (SELECT document_id, count(*) AS n, count(*) FILTER (change_id % 4 = 0) AS f FROM changes WHERE detected_at >= {_BEGAN} GROUP BY 1)
  SELECT source_key, count(*) FILTER (v) AS found, count(*) FILTER (NOT v) AS filtered, CAST(coalesce(sum(s.n) FILTER (v), 0) AS BIGINT) AS new, count(*) FILTER (v AND s.n IS NULL) AS unchanged, CAST(coalesce(sum(c.n) FILTER (v), 0) AS BIGINT) AS changes, CAST(coalesce(sum(c.f) FILTER (v), 0) AS BIGINT) AS flagged
  FROM (SELECT *, tax_key = 'cn_vat' AS v FROM dt) d LEFT JOIN s USING (document_id) LEFT JOIN c USING (document_id) GROUP BY 1"""


def d2_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.tax_type_versions("cn_vat", _docs(spark, sf_dir), bound(spark, sf_dir, "snaps"))
    return out.withColumns({c: F.unix_timestamp(c) for c in ("first_seen", "last_updated")})


D2B_SQL = with_ctes("docs", "snaps") + f""", {_DOCS}, s AS (SELECT *, coalesce(issued_at, fetched_at) AS d FROM snaps), v AS (SELECT document_id, count(*) AS n, min(d) AS a, max(d) AS z, arg_max(issued_at IS NOT NULL, (d, snapshot_id)) AS o FROM s GROUP BY 1)
  SELECT document_id, title, source_key, coalesce(n, 0) AS versions, {DUCK.epoch("a")} AS first_seen, {DUCK.epoch("z")} AS last_updated, coalesce(o, false) AS official_date FROM dt LEFT JOIN v USING (document_id) WHERE tax_key = 'cn_vat'"""


def d2_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda name: bound(spark, sf_dir, name)
    out = D.tax_type_changes("cn_vat", _docs(spark, sf_dir), of("snaps"), of("changes"), of("analyses"), as_of(), 10)
    return out.select("change_id", "document_id", "title", "severity", "summary", "confidence", "official_date", F.unix_timestamp("dated_at").alias("dated_at"))


D2C_SQL = with_ctes("docs", "snaps", "changes", "analyses") + f""", {_DOCS} SELECT c.change_id, c.document_id, dt.title, c.severity, coalesce(a.summary, '') AS summary, a.confidence, s.issued_at IS NOT NULL AS official_date, {DUCK.epoch("coalesce(s.issued_at, s.fetched_at)")} AS dated_at
  FROM changes c JOIN dt ON dt.document_id = c.document_id AND dt.tax_key = 'cn_vat' LEFT JOIN snaps s ON s.snapshot_id = c.to_snapshot_id LEFT JOIN analyses a ON a.change_id = c.change_id WHERE c.detected_at >= {_CUT}"""


def d2_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nesting of one tax type's documents, one a title."""
    docs = _docs(spark, sf_dir).withColumn("entity_key", norm_key(F.col("title")))
    return D.tax_type_tree("cn_vat", docs).select("document_id", "entity_key", "depth", F.array_join("path", " > ").alias("path"))


D2T_SQL = (with_ctes("docs") + _DOCS).replace("WITH ", "WITH RECURSIVE ", 1).replace("dt AS (", ", dt AS (", 1) + f""", x AS ({C5_SQL}),
  d AS (SELECT * FROM (SELECT x.*, dt.title, row_number() OVER (PARTITION BY entity_key ORDER BY x.document_id DESC) AS r FROM x JOIN dt ON dt.document_id = x.document_id WHERE dt.tax_key = 'cn_vat') y WHERE r = 1),
  p AS (SELECT d.document_id, d.entity_key, d.title, CASE WHEN a.entity_key IS NOT NULL THEN nullif(d.parent, d.entity_key) WHEN b.entity_key IS NOT NULL THEN nullif(d.title_parent, d.entity_key) END AS parent FROM d LEFT JOIN d a ON a.entity_key = d.parent LEFT JOIN d b ON b.entity_key = d.title_parent),
  w AS (SELECT document_id, entity_key, CAST(0 AS BIGINT) AS depth, title AS path FROM p WHERE parent IS NULL UNION ALL SELECT p.document_id, p.entity_key, w.depth + 1, concat(w.path, ' > ', p.title) FROM p JOIN w ON p.parent = w.entity_key)
  SELECT document_id, entity_key, depth, path FROM w"""


def s9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blocks of the report, with their text."""
    analyses = bound(spark, sf_dir, "analyses").withColumn("affected_parties", F.when(F.col("change_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))))
    rows = reports.change_report(bound(spark, sf_dir, "changes").withColumn("diff_text", F.when(F.col("change_id") % 4 == 0, "-x")), _docs(spark, sf_dir), analyses, as_of(), 10)
    return rows.select("part", "country", "change_id", "text")


_N = "chr(10)"
_NAME = "CASE country WHEN 'TW' THEN '" + reports.COUNTRIES["TW"] + "' WHEN 'US' THEN '" + reports.COUNTRIES["US"] + "' WHEN 'CN' THEN '" + reports.COUNTRIES["CN"] + "' ELSE country END"
_BADGE = "CASE severity " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in reports.BADGES.items()) + " END"
S9_SQL = with_ctes("docs", "changes", "analyses") + f""", r AS (SELECT c.*, coalesce(d.country, '??') AS country, d.title, a.summary, a.confidence, a.effective_date, a.parent_law_impact FROM changes c LEFT JOIN docs d USING (document_id) LEFT JOIN analyses a ON a.change_id = c.change_id WHERE detected_at >= {_CUT})
  SELECT 0 AS part, NULL AS country, NULL AS change_id, CASE WHEN count(*) > 0 THEN concat('# {reports.REPORT_TITLE}', {_N}, {_N}, '期間：過去 10 天 | 產出時間：', strftime({_AS_OF}, '%Y-%m-%d %H:%M'), ' UTC', {_N}, {_N}, '共偵測到 **', CAST(count(*) AS VARCHAR), '** 筆異動', {_N}, {_N}, '{reports.DISCLAIMER}', {_N})
    ELSE concat('# {reports.REPORT_TITLE}', {_N}, {_N}, '過去 10 天內無偵測到異動。', {_N}) END AS text FROM r
  UNION ALL SELECT DISTINCT 1, country, NULL, concat({_N}, '## ', {_NAME}, {_N}) FROM r
  UNION ALL SELECT 1, country, change_id, concat('### ', {_BADGE}, ' ', coalesce(title, node_key), ' — ', node_key, {_N}, {_N}, '- 異動類型：', change_type, {_N}, '- 偵測時間：', strftime(detected_at, '%Y-%m-%d'), {_N},
    CASE WHEN summary IS NOT NULL THEN concat({_N}, '**摘要**：', summary, {_N}, {_N}, CASE WHEN effective_date <> '' THEN concat('- 生效日：', effective_date, {_N}) ELSE '' END, CASE WHEN change_id % 2 = 0 THEN concat('- 受影響對象：a, b', {_N}) ELSE '' END,
      CASE WHEN parent_law_impact <> '' THEN concat({_N}, '**母法影響**：', parent_law_impact, {_N}, {_N}) ELSE '' END, '- 信心度：', CAST(CAST(round(confidence * 100) AS INT) AS VARCHAR), '%', {_N}) ELSE '' END,
    CASE WHEN change_id % 4 = 0 THEN concat({_N}, '<details><summary>Diff</summary>', {_N}, {_N}, '```diff', {_N}, '-x', {_N}, '```', {_N}, '</details>', {_N}, {_N}) ELSE '' END, '---', {_N}) FROM r"""


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def s10_purge_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CN rows with an imported cell are backed up, deleted and restored."""
    req, fields, backup = bound(spark, sf_dir, "requirements"), bound(spark, sf_dir, "fields"), _scratch(spark, "backup")
    left, cells = reports.purge_requirements(req, fields, backup, country="CN", source="import")
    again, back = reports.restore_requirements(spark, backup, left, cells)
    count = lambda df, step, kind: df.agg(F.count("*").alias("n")).select(F.lit(step).alias("step"), F.lit(kind).alias("kind"), "n")
    return count(left, "purged", "rows").union(count(cells, "purged", "cells")).union(count(again, "restored", "rows")).union(count(back, "restored", "cells"))


S10_SQL = with_ctes("requirements", "flat_fields") + """, g AS (SELECT requirement_id FROM requirements WHERE country = 'CN' AND requirement_id IN (SELECT requirement_id FROM flat_fields WHERE source = 'import'))
  SELECT 'purged' AS step, 'rows' AS kind, count(*) AS n FROM requirements WHERE requirement_id NOT IN (FROM g) UNION ALL SELECT 'purged', 'cells', count(*) FROM flat_fields WHERE requirement_id NOT IN (FROM g) UNION ALL SELECT 'restored', 'rows', count(*) FROM requirements UNION ALL SELECT 'restored', 'cells', count(*) FROM flat_fields"""


def _law_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Batches of up to 50 JSON laws, out of neighbouring documents, and the laws wanted."""
    law = F.struct(
        F.lit("法律").alias("LawLevel"), F.col("title").alias("LawName"), F.concat(F.lit("https://law.example.org/LawAll.aspx?pcode=G"), F.lpad(F.col("document_id").cast("string"), 7, "0")).alias("LawURL"),
        F.date_format("issued_at", "yyyyMMdd").alias("LawModifiedDate"), F.when(F.col("document_id") % 5 == 0, "廢").otherwise("").alias("LawAbandonNote"),
    )
    docs = bound(spark, sf_dir, "docs")
    batch = docs.groupBy(F.expr("document_id DIV 50").alias("batch")).agg(F.to_json(F.struct(F.lit("20260101").alias("UpdateDate"), F.collect_list(law).alias("Laws"))).alias("text"))
    return batch, docs.where("document_id % 3 = 0").select(F.concat(F.lit("G"), F.lpad(F.col("document_id").cast("string"), 7, "0")).alias("external_id"))


def s2_law_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch, wanted = _law_batches(spark, sf_dir)
    return landed.tw_law_refs(batch, wanted).select("external_id", "title", F.unix_timestamp("issued_at").alias("issued"), "abandoned")


def s2_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches as archives of two members, every third one as plain JSON."""
    batch, wanted = _law_batches(spark, sf_dir)

    def packed(frames):
        for pdf in frames:
            out = []
            for n, text in zip(pdf["batch"], pdf["text"]):
                raw = text.encode("utf-8-sig")
                if n % 3:
                    held = io.BytesIO()
                    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                        z.writestr("readme.txt", "laws")
                        z.writestr("ChLaw.json", raw)
                    raw = held.getvalue()
                out.append((f"batch-{n}", raw))
            yield pd.DataFrame(out, columns=["path", "content"])

    files = batch.mapInPandas(packed, "path string, content binary")
    return landed.archived_law_refs(files, wanted).select("external_id", "title", F.unix_timestamp("issued_at").alias("issued"), "abandoned")


S2_SQL = with_ctes("docs") + f"SELECT concat('G', lpad(CAST(document_id AS VARCHAR), 7, '0')) AS external_id, title, {DUCK.epoch('issued_at')} AS issued, document_id % 5 = 0 AS abandoned FROM docs WHERE document_id % 3 = 0"


def s3_policy_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with blank and undated rows; of four in a row, each shares its
    address with one and its index number with another."""
    docs, at = bound(spark, sf_dir, "docs"), F.col("document_id")
    block, place = F.expr("document_id DIV 4"), (at % 4).cast("int")
    page = block * 2 + F.element_at(F.array(*map(F.lit, (0, 1, 1, 0))), place + 1)
    index = F.when(block % 3 != 2, F.concat(F.lit("I"), block * 10 + F.element_at(F.array(*map(F.lit, (1, 1, 3, 3))), place + 1)))
    rows = docs.select(
        at.alias("seq"), F.when(at % 10 == 0, " ").otherwise(F.concat("title", F.when(block % 5 == 0, F.col("external_id")).otherwise(""))).alias("title"),
        F.concat(F.lit("http://x.example.org/c"), page + 100_000, F.lit("/content.html")).alias("url"), F.date_format("issued_at", "yyyy-MM-dd HH:mm:ss").alias("pubDate"), F.lit("").alias("label"), index.alias("indexno"),
    )
    return landed.policy_refs(rows, F.timestamp_seconds(F.lit(DAY0 + 20 * 86_400))).select("external_id", "title", "url")


S3_SQL = with_ctes("docs").replace("WITH ", "WITH RECURSIVE ", 1) + f""", p AS (SELECT *, document_id // 4 AS g, CAST(document_id % 4 AS INT) AS m FROM docs WHERE document_id % 10 <> 0 AND issued_at >= {DUCK.ts(str(DAY0 + 20 * 86_400))}),
  q AS (SELECT *, concat('c', CAST(g * 2 + [0, 1, 1, 0][m + 1] + 100000 AS VARCHAR)) AS page FROM p),
  e AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY document_id) AS k, concat(title, CASE WHEN g % 5 = 0 THEN external_id ELSE '' END) AS title, concat('https://x.example.org/', page, '/content.html') AS url,
    CASE WHEN g % 5 = 0 THEN external_id WHEN g % 3 <> 2 THEN concat('I', CAST(g * 10 + [1, 1, 3, 3][m + 1] AS VARCHAR)) ELSE page END AS external_id FROM q),
  r AS (SELECT g, k, true AS keep, [url, external_id] AS seen FROM e WHERE k = 1 UNION ALL
    SELECT e.g, e.k, NOT list_has_any(r.seen, [e.url, e.external_id]), CASE WHEN list_has_any(r.seen, [e.url, e.external_id]) THEN r.seen ELSE list_concat(r.seen, [e.url, e.external_id]) END FROM r JOIN e ON e.g = r.g AND e.k = r.k + 1)
  SELECT e.external_id, e.title, e.url FROM e JOIN r ON r.g = e.g AND r.k = e.k WHERE r.keep"""


def s4_ecfr_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    v = o.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.concat(F.lit("1."), "o_orderkey").alias("identifier"), (F.col("o_custkey") % 12).cast("string").alias("part"), (F.col("o_orderkey") % 3 != 0).alias("substantive"))
    return landed.ecfr_part_refs(v, [str(i) for i in range(0, 12, 2)]).select("external_id", "title", F.date_format("issued_at", "yyyy-MM-dd").alias("issued"), "latest_section")


S4_SQL = """SELECT concat('26-CFR-', p) AS external_id, concat('26 CFR Part ', p) AS title, d AS issued, s AS latest_section FROM (SELECT CAST(o_custkey % 12 AS VARCHAR) AS p, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS d, concat('1.', CAST(o_orderkey AS VARCHAR)) AS s,
  row_number() OVER (PARTITION BY o_custkey % 12 ORDER BY CAST(o_orderdate AS DATE) DESC, concat('1.', CAST(o_orderkey AS VARCHAR)) DESC) AS r FROM orders WHERE o_orderkey % 3 <> 0 AND o_custkey % 12 % 2 = 0) x WHERE r = 1"""


def s5_register_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    kinds = F.array(*map(F.lit, ("Rule", "Proposed Rule", "Notice", "Presidential Document", "Other")))
    rows = o.select(F.col("o_orderkey").cast("string").alias("document_number"), F.col("o_orderpriority").alias("title"), F.element_at(kinds, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("type"), F.lit("u").alias("html_url"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("publication_date"))
    return landed.fr_refs(rows).select("external_id", "title", "doc_type", F.date_format("issued_at", "yyyy-MM-dd").alias("issued"))


S5_SQL = "SELECT CAST(o_orderkey AS VARCHAR) AS external_id, o_orderpriority AS title, CASE o_orderkey % 5 WHEN 0 THEN 'regulation' WHEN 1 THEN 'regulation' WHEN 3 THEN 'statute' ELSE 'announcement' END AS doc_type, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS issued FROM orders"


def _ruling_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages built around each document: two rows, one too short."""
    cell = F.format_string("<table><tr><td>%d.%d.%d</td><td>x</td><td><a href='/r?id=%d'>ruling %d</a></td></tr><tr><td><a href='/no'>no</a></td></tr></table>", 100 + F.col("document_id") % 14, 1 + F.col("document_id") % 12, 1 + F.col("document_id") % 28, F.col("document_id"), F.col("document_id"))
    return bound(spark, sf_dir, "docs").select(F.col("document_id").alias("page_id"), cell.alias("html"))


def s6_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = landed.listing_refs(_ruling_page(spark, sf_dir), "ruling", "https://law.example.org/")
    return refs.select("page_id", "external_id", "title", "url", F.date_format("issued_at", "yyyy-MM-dd").alias("issued"))


S6_SQL = """SELECT doc_id AS page_id, CAST(doc_id AS VARCHAR) AS external_id, concat('ruling ', CAST(doc_id AS VARCHAR)) AS title, concat('https://law.example.org/r?id=', CAST(doc_id AS VARCHAR)) AS url,
  concat(CAST(2011 + doc_id % 14 AS VARCHAR), '-', lpad(CAST(1 + doc_id % 12 AS VARCHAR), 2, '0'), '-', lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0')) AS issued FROM documents"""


def s6_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the raw pages (rows only: real markup)."""
    return landed.listing_refs(spark.read.parquet(f"{sf_dir}/pages.parquet"), "mof", "https://law.example.org").select("page_id", "seq", "external_id", "title", "url")


def s8_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown line for each document, between delimiter and prose lines."""
    d, k = bound(spark, sf_dir, "docs"), F.col("document_id")
    line = F.concat(F.lit("| **"), "title", F.lit("** | a<br/>b | "), k, F.lit(" |"))
    parts = [(0, line), (1, F.lit("| --- | :-: | --- |")), (2, F.concat(F.lit("prose on "), "external_id"))]
    lines = d.select(F.explode(F.array(*[F.struct((k * 3 + i).alias("row_no"), v.alias("value")) for i, v in parts])).alias("l")).select("l.*")
    return landed.markdown_cells(lines).select("row_no", F.array_join("cells", ";").alias("cells"))


S8_SQL = with_ctes("docs") + "SELECT document_id * 3 AS row_no, concat(title, ';a', chr(10), 'b;', CAST(document_id AS VARCHAR)) AS cells FROM docs"


def _raw(spark: SparkSession, sf_dir: str, connector: str, content: Column, kind: str = "text/html") -> DataFrame:
    docs = bound(spark, sf_dir, "docs")
    return docs.select("source_key", F.col("document_id").cast("string").alias("external_id"), F.lit(connector).alias("connector"), F.encode(content, "UTF-8").alias("content"), F.lit(kind).alias("content_type"), "url", F.create_map(F.lit("title"), F.col("title")).alias("metadata"))


def n2_tw_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    art = lambda kind, no, text: F.struct(F.lit(kind).alias("ArticleType"), no.alias("ArticleNo"), text.alias("ArticleContent"))
    no = F.concat(F.lit("第 "), F.col("document_id") % 9 + 1, F.lit(" 條"))
    body = F.to_json(F.struct(F.col("title").alias("LawName"), F.array(art("C", F.lit(""), F.lit("第 一 章")), art("A", no, F.concat(F.lit(" text　of "), "document_id")), art("A", F.lit("第 10-1 條"), F.lit("two")), art("A", F.lit("x"), F.lit(" "))).alias("LawArticles")))
    return N.normalize_tw_law(_raw(spark, sf_dir, "tw_moj_law", body)).select("external_id", "node_key", "heading", "text", "abandoned")


N2_SQL = with_ctes("docs") + """SELECT CAST(document_id AS VARCHAR) AS external_id, concat(title, '#', CAST(document_id % 9 + 1 AS VARCHAR)) AS node_key, concat('第 ', CAST(document_id % 9 + 1 AS VARCHAR), ' 條') AS heading, concat('text of ', CAST(document_id AS VARCHAR)) AS text, false AS abandoned FROM docs
  UNION ALL SELECT CAST(document_id AS VARCHAR), concat(title, '#10-1'), '第 10-1 條', 'two', false FROM docs"""


def n3_to_n8_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each parser on pages built around each document, through the dispatch."""
    d = F.col("document_id").cast("string")
    ruling = F.concat(F.lit("<html><h2>T"), d, F.lit("</h2><div class='content'><p>主旨：one "), d, F.lit("</p><p>說明：two</p></div></html>"))
    cn = F.concat(F.lit("<div class='article-content'><div class='tools'>下载</div><p>第一条 one "), d, F.lit("</p><p>第十二条 two</p></div>"))
    cfr = F.concat(F.lit("<R xmlns='urn:x'><SECTION><SECTNO>§ 1."), d, F.lit("</SECTNO><SUBJECT>S</SUBJECT><P>body <I>it</I></P></SECTION><SECTION><SECTNO>9</SECTNO></SECTION></R>"))
    state = F.concat(F.lit("<html><title>t</title><main><p>state "), d, F.lit("</p></main></html>"))
    parts = [_raw(spark, sf_dir, c, body) for c, body in (("tw_mof_ruling", ruling), ("cn_chinatax", cn), ("us_ecfr", cfr), ("us_state_tax", state))]
    raw = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return N.normalize_all(raw).select("external_id", "ordinal", "node_key", "heading", "text")


_LAWLIKE = " OR ".join(f"ends_with(b, '{s}')" for s in ("法", "条例", "细则", "办法", "规则"))
N8_SQL = with_ctes("docs") + f""", x AS (SELECT CAST(document_id AS VARCHAR) AS d, regexp_replace(title, '^中华人民共和国', '') AS b FROM docs), y AS (SELECT *, CASE WHEN {_LAWLIKE} THEN b ELSE d END AS k FROM x)
  SELECT d AS external_id, 0 AS ordinal, concat(d, '#主旨') AS node_key, '主旨' AS heading, concat('one ', d) AS text FROM y UNION ALL SELECT d, 1, concat(d, '#說明'), '說明', 'two' FROM y
  UNION ALL SELECT d, 0, concat(k, '#1'), '第一条', concat('one ', d) FROM y UNION ALL SELECT d, 1, concat(k, '#12'), '第十二条', 'two' FROM y
  UNION ALL SELECT d, 0, concat('26 CFR § 1.', d), concat('§ 1.', d, '  S'), concat('S', chr(10), 'body it') FROM y UNION ALL SELECT d, 0, concat('US:', d), 't', concat('state ', d) FROM y"""


def n6_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generic page parser on the raw pages (rows only: real markup)."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    raw = pages.select(F.lit("p").alias("source_key"), F.col("page_id").cast("string").alias("external_id"), F.lit("us_state_tax").alias("connector"), F.encode("html", "UTF-8").alias("content"), F.lit("text/html; charset=utf-8").alias("content_type"), "url", F.create_map().cast("map<string,string>").alias("metadata"))
    return N.normalize_all(raw).select("external_id", "node_key", "heading", F.sha2("text", 256).alias("sha"))


#: state: a section with a heading, one without, a page without sections; {} is the document's id.
_STATE_PAGES = {
    "TX": ('<div class="section"><h3>Sec. 171.{} RATE</h3><p>one {}</p><p>two</p></div>', '<div class="codeSect"><p>loose {}</p></div>', "<p>whole {}</p>"),
    "FL": ('<div class="section"><h2>{}.05 Title</h2>body {}</div>', '<div class="statute-text">loose {}</div>', '<div class="content">whole {}</div>'),
    "WA": ('<div class="RCWSection"><b>82-{}</b> body {}</div>', '<div class="lawsection">loose {}</div>', '<div id="ctl00_ContentPlaceHolder1_panelText">whole {}</div>'),
    "IL": ('<div class="Section"><b>Sec. {}.5</b> body {}</div>', '<div class="ilcssection">loose {}</div>', '<div id="content">whole {}</div>'),
    "NY": ('<article class="bill-section"><h3>§ {}a. Title</h3>body {}</article>', '<div class="law-section">loose {}</div>', "<main>whole {}</main>"),
    "CA": ('<div class="lawcode"><p>one {}</p>', '<div class="section-text">loose {}</div></div>', "<p>whole {}</p>"),
}


def n6_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in the layouts of six states, every fifth without sections."""
    docs, at = bound(spark, sf_dir, "docs"), F.col("document_id")
    filled = lambda template: F.replace(F.lit(template), F.lit("{}"), at.cast("string"))
    state = F.element_at(F.array(*map(F.lit, _STATE_PAGES)), (at % 6 + 1).cast("int"))
    page = F.lit("")
    for name, (headed, loose, whole) in _STATE_PAGES.items():
        body = F.when(at % 5 == 0, filled(whole)).otherwise(F.concat(filled(headed), filled(loose)))
        page = F.when(state == name, F.concat(F.lit("<html><body>"), body, F.lit("<div>foot</div></body></html>"))).otherwise(page)
    meta = F.create_map(F.lit("state"), state, F.lit("chapter"), F.lit("171"), F.lit("act_id"), F.lit("5"), F.lit("article"), F.lit("9"), F.lit("section"), at.cast("string"))
    raw = docs.select("source_key", at.cast("string").alias("external_id"), F.lit("us_state_tax").alias("connector"), F.encode(page, "UTF-8").alias("content"), F.lit("text/html; charset=utf-8").alias("content_type"), "url", meta.alias("metadata"))
    return N.normalize_all(raw).select("external_id", "ordinal", "node_key", "heading", "text")


_N6_ROWS = {  # state: number and text of the headed section, its heading; heading of the loose one; fallback; heading and text of a whole page
    "TX": ("concat('171.', d)", "concat('one ', d, chr(10), 'two')", "concat('Sec. 171.', d, ' RATE')", "Ch. 171", "TX Tax Code-171", "Texas Tax Code Ch. 171", "concat('whole ', d, chr(10), 'foot')", "TX Tax Code"),
    "FL": ("concat(d, '.05')", "concat(d, '.05 Title', chr(10), 'body ', d)", "concat(d, '.05 Title')", "Ch. 171", "Florida Statutes-171", "Florida Statutes Ch. 171", "concat('whole ', d)", "Florida Statutes"),
    "WA": ("concat('82-', d)", "concat('82-', d, chr(10), 'body ', d)", "concat('82-', d)", "171", "WAC-171", "WAC 171", "concat('whole ', d)", "WAC"),
    "IL": ("concat(d, '.5')", "concat('Sec. ', d, '.5', chr(10), 'body ', d)", "concat('Sec. ', d, '.5')", "Act 5", "35 ILCS-5", "35 ILCS Act 5", "concat('whole ', d)", "35 ILCS"),
    "NY": ("concat(d, 'a')", "concat('§ ', d, 'a. Title', chr(10), 'body ', d)", "concat('§ ', d, 'a. Title')", "Article 9", "NY Tax Law-9", "NY Tax Law Article 9", "concat('whole ', d)", "NY Tax Law"),
}
_N6_PARTS = [
    part
    for k, (state, (number, text, heading, loose, fallback, page, whole, code)) in enumerate(_N6_ROWS.items())
    for part in (
        f"SELECT d, 0, concat('{state}:{code}-', {number}), {heading}, {text} FROM y WHERE i % 6 = {k} AND i % 5 <> 0",
        f"SELECT d, 1, '{state}:{fallback}', '{loose}', concat('loose ', d) FROM y WHERE i % 6 = {k} AND i % 5 <> 0",
        f"SELECT d, 0, '{state}:{fallback.replace('-9', '-Art9')}', '{page}', {whole} FROM y WHERE i % 6 = {k} AND i % 5 = 0",
    )
]
N6_SQL = "WITH y AS (SELECT doc_id AS i, CAST(doc_id AS VARCHAR) AS d FROM documents), z(external_id, ordinal, node_key, heading, text) AS (" + " UNION ALL ".join(_N6_PARTS) + """ UNION ALL
  SELECT d, 0, concat('CA:RTC-', d), concat('RTC § ', d), CASE WHEN i % 5 = 0 THEN concat('whole ', d) ELSE concat('one ', d, chr(10), 'loose ', d) END FROM y WHERE i % 6 = 5) SELECT * FROM z"""


def t1_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines landed in two rounds, the second with version 2 of their
    text; snapshots and changes counted from the stored tables."""
    land, out, check = (_scratch(spark, n) for n in ("landing", "ingest", "progress"))
    for round_, name in ((0, "v1"), (1, "v2")):
        rows = bound(spark, sf_dir, name).select(F.col("pair_id").alias("document_id"), F.timestamp_seconds(F.lit(DAY0 + round_ * 86_400)).alias("fetched_at"), F.lit(None).cast("timestamp").alias("issued_at"), F.col("ordinal").cast("int").alias("ordinal"), "node_key", "heading", "text")
        rows.write.mode("append").option("compression", ingest.CODEC).parquet(land)  # a document's lines come from one task
        ingest.ingest_stream(spark, land, out, check, threshold=None).awaitTermination()
    changes = ingest.read_table(spark, out, "changes").groupBy(F.col("change_type").alias("kind")).agg(F.count("*").alias("n"))
    return changes.union(ingest.read_table(spark, out, "snapshots").agg(F.count("*").alias("n")).select(F.lit("snapshots"), "n"))


T1_SQL = with_ctes("v1", "v2") + """, d AS (SELECT a.pair_id IS NULL AS fresh, b.pair_id IS NULL AS gone, a.text <> b.text AS moved FROM v1 a FULL JOIN v2 b ON a.pair_id = b.pair_id AND a.node_key = b.node_key WHERE coalesce(a.pair_id, b.pair_id) IN (SELECT pair_id FROM v2)),
  h AS (SELECT pair_id, string_agg(text, chr(10) ORDER BY ordinal) AS t FROM v1 GROUP BY 1), g AS (SELECT pair_id, string_agg(text, chr(10) ORDER BY ordinal) AS t FROM v2 GROUP BY 1)
  SELECT CASE WHEN gone THEN 'removed' WHEN fresh THEN 'added' ELSE 'modified' END AS kind, count(*) AS n FROM (SELECT d.* FROM d WHERE gone OR fresh OR moved) x GROUP BY 1
  UNION ALL SELECT 'snapshots', (SELECT count(*) FROM h) + (SELECT count(*) FROM h JOIN g USING (pair_id) WHERE h.t <> g.t)"""

QUERIES = {
    "d2_versions": d2_versions, "d2_changes": d2_changes, "d2_tree": d2_tree,
    "d1_rollup": d1_rollup, "d2_summary": d2_summary, "d3_stats": d3_stats, "d4_list_changes": d4_list_changes, "d5_detail": d5_detail, "d6_runs": d6_runs, "d6_health": d6_health, "d7_analysis_inputs": d7_analysis_inputs, "d8_run_stats": d8_run_stats,
    "s9_report": s9_report, "s10_purge_restore": s10_purge_restore, "s2_law_refs": s2_law_refs, "s2_archives": s2_archives, "s3_policy_refs": s3_policy_refs, "s4_ecfr_refs": s4_ecfr_refs, "s5_register_refs": s5_register_refs, "s6_listing": s6_listing, "s6_page_links": s6_page_links,
    "s8_markdown": s8_markdown, "n2_tw_law": n2_tw_law, "n3_to_n8_normalize": n3_to_n8_normalize, "n6_pages": n6_pages, "n6_states": n6_states, "t1_ingest": t1_ingest,
}
ORACLES = {
    "n6_states": N6_SQL,
    "d2_tree": D2T_SQL,
    "d2_versions": D2B_SQL, "d2_changes": D2C_SQL,
    "d1_rollup": D1_SQL, "d2_summary": D2_SQL, "d3_stats": D3_SQL, "d4_list_changes": D4_SQL, "d5_detail": D5_SQL, "d6_runs": D6_SQL, "d6_health": D6B_SQL, "d7_analysis_inputs": D7_SQL, "d8_run_stats": D8_SQL, "s9_report": S9_SQL, "s10_purge_restore": S10_SQL,
    "s2_law_refs": S2_SQL, "s2_archives": S2_SQL, "s3_policy_refs": S3_SQL, "s4_ecfr_refs": S4_SQL, "s5_register_refs": S5_SQL, "s6_listing": S6_SQL, "s8_markdown": S8_SQL, "n2_tw_law": N2_SQL, "n3_to_n8_normalize": N8_SQL, "t1_ingest": T1_SQL,
}
