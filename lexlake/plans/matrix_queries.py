"""Queries of the filing-requirement matrix (C18–C21, R*) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake import refdata as R
from lexlake.operators import matrix as M
from lexlake.plans.bindings import AS_OF, bound, with_ctes

_RANK = "CASE severity WHEN 'critical' THEN 3 WHEN 'major' THEN 2 WHEN 'minor' THEN 1 ELSE 0 END"
_CELLS = "ci AS (SELECT requirement_id, field_key, 0 AS pos, c1 AS k, needs_review FROM flat_fields WHERE c1 IS NOT NULL UNION ALL SELECT requirement_id, field_key, CASE WHEN c1 IS NULL THEN 0 ELSE 1 END, c2, needs_review FROM flat_fields WHERE c2 IS NOT NULL)"
_HARD = "field_key NOT IN ('incentives', 'administration')"

_DIMS = {
    "taxpayer_class": ["resident_individual", "domestic_enterprise", "bogus", ""], "tax_scheme": ["annual_filing", "withholding", "annual_filing", ""],
    "subject_matter": ["general_income", "", "securities", ""], "scenario_key": ["standard", "public_trust", "standard", ""],
}


def _vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The income-tax vocabulary as rows, once for each region."""
    rows = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(v).alias("value_key")) for d, vs in R.TW_INCOME_VOCABULARY.items() for v in vs])).alias("v")
    region = spark.read.parquet(f"{sf_dir}/region.parquet").where("r_regionkey = 0")
    return region.select(F.lit("TW").alias("country"), F.lit("tw_income").alias("tax_key"), rows).select("country", "tax_key", "v.*")


def _dimensioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    req = bound(spark, sf_dir, "requirements").select("requirement_id", F.lit("TW").alias("country"), "tax_key", F.col("source_document_id").alias("document_id"))
    pick = lambda vs: F.element_at(F.array(*map(F.lit, vs)), (F.col("requirement_id") % 8 / 2 + 1).cast("int"))
    return req.withColumns({d: pick(vs) for d, vs in _DIMS.items()})


def c18_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.validate_dimensions(_dimensioned(spark, sf_dir), _vocab(spark, sf_dir))
    return out.select("requirement_id", "identity_key", F.array_join("unknown", ",").alias("unknown"), F.array_join("missing", ",").alias("missing"))


C18_SQL = with_ctes("requirements") + """SELECT requirement_id, CASE WHEN tax_key = 'tw_income' AND g = 0 THEN 'resident_individual|annual_filing|general_income|standard' ELSE '' END AS identity_key,
  CASE WHEN tax_key = 'tw_income' AND g = 2 THEN 'taxpayer_class=bogus' ELSE '' END AS unknown, CASE WHEN tax_key = 'tw_income' AND g = 1 THEN 'subject_matter' ELSE '' END AS missing
  FROM (SELECT *, requirement_id % 8 // 2 AS g FROM requirements) x"""

_TEXTS = [
    "居住者綜合所得稅結算申報", "總機構在中華民國境內之營利事業 虧損扣除", "非居住者 薪資 扣繳", "受託人 信託所得 申報", "營利事業 房地合一 結算", "合夥 營利事業 證券交易 結算", "境外營利事業 期貨 申報", "plain words",
]
_KEYS_OF = [
    "resident_individual|annual_filing|general_income|standard", "domestic_enterprise|annual_filing|general_income|loss_carryforward", "nonresident_individual|withholding|salary_interest|standard", "",
    "domestic_enterprise|annual_filing|real_estate|post_2016_acquisition", "sole_proprietorship|annual_filing|securities|standard", "foreign_enterprise|annual_filing|futures|standard", "",
]


def c19_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    req = bound(spark, sf_dir, "requirements").withColumn("country", F.lit("TW"))
    text = F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("requirement_id") % 8 + 1).cast("int"))
    req = req.withColumns({"scenario": text, "taxpayer_role": F.lit(""), "identity_key": F.when(F.col("requirement_id") % 16 == 2, "kept").otherwise("")})
    return M.backfill_identity(req).select("requirement_id", "identity_key")


C19_SQL = with_ctes("requirements") + f"SELECT requirement_id, CASE WHEN requirement_id % 16 = 2 THEN 'kept' WHEN tax_key = 'tw_income' THEN {_KEYS_OF}[1 + requirement_id % 8] ELSE '' END AS identity_key FROM requirements"


def c20_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = M.migrate_tax_keys(bound(spark, sf_dir, "requirements"))
    return M.migrate_tax_keys(once).select("requirement_id", "tax_key")


C20_SQL = with_ctes("requirements") + """SELECT requirement_id, CASE WHEN starts_with(tax_key, concat(lower(country), '_')) THEN tax_key WHEN country = 'TW' AND tax_key = 'vat' THEN 'tw_business_tax' ELSE concat(lower(country), '_', tax_key) END AS tax_key FROM requirements"""

_HEADERS = ["稅目 Tax Type", "課稅情境", "Tax-payer", "Statutory Rate", "Tax Base", "計算公式 (formula)", "Filing Deadline", "remarks", "rate again", "法規依據"]
_FIELDS_OF = ["_tax", "_scenario", "_role", "rate", "tax_base", "formula", "filing_deadline", None, None, "_policy_basis"]


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet of ten columns for each document; odd ones lack the role column,
    and one remark is headed by the document's own title."""
    docs = bound(spark, sf_dir, "docs")
    sheets = docs.select(F.col("document_id").alias("sheet_id"), F.posexplode(F.array(*[F.concat(F.lit("remarks "), F.lower("external_id")) if h == "remarks" else F.lit(h) for h in _HEADERS])).alias("pos", "header"))
    return sheets.where("sheet_id % 2 = 0 or pos <> 2")


def c21_map_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.map_headers(_sheets(spark, sf_dir)).where("field is not null").select("sheet_id", "pos", "field")


C21_SQL = f"SELECT doc_id AS sheet_id, CAST(i - 1 AS INT) AS pos, {[f or 'none' for f in _FIELDS_OF]}[i] AS field FROM documents CROSS JOIN (SELECT unnest(range(1, 11)) AS i) g WHERE i NOT IN (8, 9) AND (doc_id % 2 = 0 OR i <> 3)"


def c21_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.header_problems(M.map_headers(_sheets(spark, sf_dir)))
    return out.select("sheet_id", F.array_join("unmapped", "|").alias("unmapped"), F.array_join("missing", "|").alias("missing"))


C21B_SQL = with_ctes("docs") + "SELECT document_id AS sheet_id, concat('rate again|remarks ', external_id) AS unmapped, CASE WHEN document_id % 2 = 1 THEN '_role' ELSE '' END AS missing FROM docs"


def _sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheet rows for the Taiwanese requirements: of eight, four meet a row that
    is there; bases name two articles and a whole law, one article, nothing, or are
    blank. Every tenth row
    comes again, with a formula only."""
    req, at = bound(spark, sf_dir, "requirements").where("country = 'TW'"), F.col("requirement_id")
    article = lambda n: F.concat(F.lit("第"), n.cast("string"), F.lit("條"))
    basis = F.when(at % 4 == 0, F.concat(F.lit("依所得稅法"), article(at % 90 + 1), F.lit("規定，營業稅法"), article(at % 7 + 1))).when(at % 4 == 1, F.concat(F.lit("依所得稅法"), article(at % 90 + 2))).when(at % 4 == 2, "no law").otherwise(" ")
    tax, scenario = F.when(at % 2 == 0, "綜合所得稅").otherwise("貨物稅"), F.concat(F.lit("sheet "), "requirement_id")
    row = req.select(at.alias("row_no"), tax.alias("_tax"), scenario.alias("_scenario"), F.col("taxpayer_role").alias("_role"), F.concat(F.lit(" r"), "requirement_id").alias("rate"), F.lit("  ").alias("formula"), basis.alias("_policy_basis"))
    again = row.where("row_no % 10 = 0").withColumns({"row_no": F.col("row_no") + 10_000_000, "rate": F.lit(""), "formula": F.lit("f"), "_policy_basis": F.lit(None).cast("string")})
    return row.union(again).unpivot(["row_no"], ["_tax", "_scenario", "_role", "rate", "formula", "_policy_basis"], "field", "value")


def _imported(spark: SparkSession, sf_dir: str):
    """Half of the sheet's rows are there already, reviewed, with an old rate and citation."""
    req, fields = bound(spark, sf_dir, "requirements"), bound(spark, sf_dir, "fields")
    there = req.where("country = 'TW' and requirement_id % 8 < 4").withColumns({"tax_key": F.when(F.col("requirement_id") % 2 == 0, "tw_individual_income").otherwise("tw_commodity"), "scenario": F.concat(F.lit("sheet "), "requirement_id"), "status": F.lit("reviewed"), "notes": F.lit("old")})
    req = req.join(there.select("requirement_id"), "requirement_id", "left_anti").unionByName(there)
    cited = bound(spark, sf_dir, "cited").where("a % 2 = 0").select(F.concat(F.lit("所得稅法#"), "a").alias("node_key"))
    return M.import_matrix(_sheet(spark, sf_dir), req, fields, "TW", cited, F.timestamp_seconds(F.lit(AS_OF)), "sheet of today ")


def r1_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, cells, _ = _imported(spark, sf_dir)
    imported = cells.where("source = 'import' and confidence = 0 and review_reason <> ''").join(new.select("requirement_id", "tax_key", "scenario", "notes", "status", "last_seen_at"), "requirement_id")
    keys = F.array_join(F.transform("citations", lambda c: F.concat(c["node_key"], F.lit("/"), c["quote"])), "|")
    return imported.select("tax_key", "scenario", "notes", "status", F.unix_timestamp("last_seen_at").alias("seen"), "field_key", "value", "needs_review", "review_reason", keys.alias("citations"))


_R1 = with_ctes("requirements", "cited") + """, s AS (SELECT requirement_id AS id, requirement_id % 90 + 1 AS x, requirement_id % 90 + 2 AS y FROM requirements WHERE country = 'TW'), h AS (SELECT DISTINCT a FROM cited WHERE a % 2 = 0),
  b AS (SELECT id, CASE WHEN id % 4 = 0 AND x IN (SELECT a FROM h) THEN concat('所得稅法#', CAST(x AS VARCHAR), '/', '依所得稅法第', CAST(x AS VARCHAR), '條') WHEN id % 4 = 1 AND y IN (SELECT a FROM h) THEN concat('所得稅法#', CAST(y AS VARCHAR), '/', '依所得稅法第', CAST(y AS VARCHAR), '條') ELSE '' END AS c FROM s)"""
R1_SQL = _R1 + f""" SELECT CASE WHEN id % 2 = 0 THEN 'tw_individual_income' ELSE 'tw_commodity' END AS tax_key, concat('sheet ', CAST(id AS VARCHAR)) AS scenario, CASE WHEN id % 8 < 4 THEN concat('old', chr(10), 'sheet of today') ELSE 'sheet of today' END AS notes, 'draft' AS status, {AS_OF} AS seen,
  f AS field_key, CASE f WHEN 'rate' THEN concat('r', CAST(id AS VARCHAR)) ELSE 'f' END AS value, true AS needs_review, CASE WHEN f = 'rate' AND c <> '' THEN '{M.IMPORTED_CITED}' ELSE '{M.IMPORTED_UNCITED}' END AS review_reason, CASE f WHEN 'rate' THEN c ELSE '' END AS citations
  FROM b CROSS JOIN (VALUES ('rate'), ('formula')) AS v(f) WHERE f = 'rate' OR id % 10 = 0"""


def r1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imported(spark, sf_dir)[2]


R1B_SQL = _R1 + """ SELECT count(*) + count(*) FILTER (id % 10 = 0) AS rows, count(*) + count(*) FILTER (id % 10 = 0) AS cells, count(*) FILTER (c <> '') AS resolved,
  CAST(sum(CASE id % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END) - count(*) FILTER (c <> '') AS BIGINT) AS unresolved FROM b"""


def r2_policy_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The citation texts against provisions that hold half of the articles."""
    cited = bound(spark, sf_dir, "cited")
    have = cited.where("kind = 3 AND a % 2 = 0").select(F.concat("tw_law", F.lit("#"), "a", F.lit("-2")).alias("node_key"))
    return M.resolve_policy_basis(cited.select(F.col("doc_id").alias("row_id"), F.col("text").alias("basis")), have)


R2_SQL = with_ctes("cited") + """, k AS (SELECT doc_id, concat(tw_law, '#', CAST(a AS VARCHAR)) AS n FROM cited WHERE kind = 0 UNION SELECT doc_id, concat(tw_law, '#', CAST(b AS VARCHAR)) FROM cited WHERE kind = 0
  UNION SELECT doc_id, cn_law FROM cited WHERE kind = 1 UNION SELECT doc_id, concat('财税〔', CAST(y AS VARCHAR), '〕', CAST(a AS VARCHAR), '号') FROM cited WHERE kind = 2 UNION SELECT doc_id, concat(tw_law, '#', CAST(a AS VARCHAR), '-2') FROM cited WHERE kind = 3)
  SELECT doc_id AS row_id, n AS node_key, n IN (SELECT concat(tw_law, '#', CAST(a AS VARCHAR), '-2') FROM cited WHERE kind = 3 AND a % 2 = 0) AS resolved FROM k"""


def r3_stale_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.stale_cells(bound(spark, sf_dir, "fields"), bound(spark, sf_dir, "changes"), bound(spark, sf_dir, "docs"))


_WORST = f"wc AS (SELECT node_key, change_id, document_id, change_type, severity, detected_at FROM (SELECT *, row_number() OVER (PARTITION BY node_key ORDER BY {_RANK} DESC, change_id) AS r FROM changes) x WHERE r = 1)"
_STALE = f"{_CELLS}, {_WORST}, st AS (SELECT * FROM (SELECT ci.*, wc.change_id, wc.node_key, wc.document_id, wc.change_type, wc.severity, wc.detected_at, row_number() OVER (PARTITION BY requirement_id, field_key ORDER BY pos) AS r FROM ci JOIN wc ON wc.node_key = ci.k WHERE NOT needs_review AND {_HARD}) y WHERE r = 1)"
_LABEL = "CASE field_key " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.FIELD_LABELS.items()) + " END"
R3_SQL = with_ctes("flat_fields", "changes", "docs") + f""", {_STALE} SELECT requirement_id, field_key, change_id,
  concat({_LABEL}, ' 所依據的 ', node_key, '（', coalesce(title, '來源法規'), '）於 ', strftime(detected_at, '%Y-%m-%d'), ' 偵測到', change_type, ' 異動（', severity, '），請重新確認。') AS reason FROM st LEFT JOIN docs USING (document_id)"""


def r3_flag_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields, req = M.flag_stale(bound(spark, sf_dir, "fields"), bound(spark, sf_dir, "requirements"), bound(spark, sf_dir, "changes"), bound(spark, sf_dir, "docs"))
    flagged = fields.groupBy("requirement_id").agg(F.count_if("needs_review").alias("flagged"))
    return req.join(flagged, "requirement_id").select("requirement_id", "status", "flagged")


R3B_SQL = with_ctes("flat_fields", "changes", "requirements") + f""", {_STALE} SELECT f.requirement_id, CASE WHEN count(st.change_id) > 0 THEN 'stale' ELSE 'draft' END AS status, count(*) FILTER (f.needs_review OR st.change_id IS NOT NULL) AS flagged
  FROM flat_fields f LEFT JOIN st ON st.requirement_id = f.requirement_id AND st.field_key = f.field_key GROUP BY 1"""


def r4_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.affected_cells(bound(spark, sf_dir, "changes").select("node_key"), bound(spark, sf_dir, "fields"), bound(spark, sf_dir, "requirements"))
    return out.select(F.col("key").alias("node_key"), "requirement_id", "field_key", "needs_review", "country", "tax_key")


R4_SQL = with_ctes("flat_fields", "changes", "requirements") + f", {_CELLS} SELECT DISTINCT ci.k AS node_key, ci.requirement_id, ci.field_key, ci.needs_review, r.country, r.tax_key FROM ci JOIN (SELECT DISTINCT node_key FROM changes) c ON c.node_key = ci.k JOIN requirements r ON r.requirement_id = ci.requirement_id"


def r5_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.list_requirements(bound(spark, sf_dir, "requirements"), bound(spark, sf_dir, "fields")).select("requirement_id", "n_fields", "n_cited", "n_review", "confidence", "unconfirmed")


R5_SQL = with_ctes("requirements", "flat_fields") + """SELECT r.requirement_id, f.n_fields, f.n_cited, f.n_review, f.confidence, m.t IS NOT NULL AND m.t IS DISTINCT FROM r.last_seen_at AS unconfirmed FROM requirements r
  JOIN (SELECT country, tax_key, max(last_seen_at) AS t FROM requirements GROUP BY 1, 2) m ON m.country = r.country AND m.tax_key = r.tax_key
  JOIN (SELECT requirement_id, count(*) AS n_fields, count(*) FILTER (c1 IS NOT NULL OR c2 IS NOT NULL) AS n_cited, count(*) FILTER (needs_review) AS n_review, round(avg(confidence) FILTER (c1 IS NOT NULL OR c2 IS NOT NULL), 6) AS confidence FROM flat_fields GROUP BY 1) f ON f.requirement_id = r.requirement_id"""


def r6_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = bound(spark, sf_dir, "fields").where("(requirement_id + length(field_key)) % 3 <> 0")
    fields = fields.withColumn("stale_change_id", F.when(F.col("needs_review"), F.col("requirement_id")))
    out = M.requirement_detail(bound(spark, sf_dir, "requirements"), fields, bound(spark, sf_dir, "changes"))
    return out.select("requirement_id", "ordinal", "field_key", "value", "is_missing", "change_node_key", "change_severity")


R6_SQL = with_ctes("flat_fields", "changes") + f"""SELECT requirement_id, CAST(list_position({[k for k, _ in R.FIELD_SPECS]}, field_key) - 1 AS INT) AS ordinal, field_key, CASE WHEN kept THEN value END AS value, NOT kept AS is_missing, c.node_key AS change_node_key, c.severity AS change_severity
  FROM (SELECT *, (requirement_id + length(field_key)) % 3 <> 0 AS kept FROM flat_fields) f LEFT JOIN changes c ON f.kept AND f.needs_review AND c.change_id = f.requirement_id"""


def r7_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.review_queue(bound(spark, sf_dir, "fields"), bound(spark, sf_dir, "requirements"), "CN", "cn_vat").select("requirement_id", "field_key", "scenario", "value")


R7_SQL = with_ctes("flat_fields", "requirements") + "SELECT requirement_id, field_key, scenario, value FROM flat_fields JOIN requirements USING (requirement_id) WHERE needs_review AND country = 'CN' AND tax_key = 'cn_vat'"


def r8_apply_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of even rows are cleared, every other one with a new value; rates
    without a flag are confirmed by the same value in blanks, without clearing;
    every seventh row has no flag at all."""
    fields, req = bound(spark, sf_dir, "fields"), bound(spark, sf_dir, "requirements")
    fields = fields.withColumn("needs_review", F.col("needs_review") & (F.col("requirement_id") % 7 != 0))
    key = ["requirement_id", "field_key"]
    cleared = fields.where("needs_review and requirement_id % 2 = 0").select(*key, F.when(F.col("requirement_id") % 4 == 0, F.concat("value", F.lit("!"))).alias("value"), F.lit(True).alias("clear_flag"))
    same = fields.where("not needs_review and requirement_id % 3 = 0 and field_key = 'rate'").select(*key, F.concat(F.lit(" "), "value", F.lit("\t")).alias("value"), F.lit(False).alias("clear_flag"))
    new, rows = M.apply_reviews(fields, req, cleared.union(same))
    counted = new.groupBy("requirement_id").agg(F.count_if(F.col("value").endswith("!")).alias("edited"), F.count_if(F.col("source") == "manual").alias("manual"), F.count_if("needs_review").alias("open"), F.max(F.length("value")).alias("longest"))
    return rows.join(counted, "requirement_id").select("requirement_id", "status", "edited", "manual", "open", "longest")


R8_SQL = with_ctes("flat_fields") + """, f AS (SELECT * EXCLUDE (needs_review), needs_review AND requirement_id % 7 <> 0 AS flagged FROM flat_fields),
  g AS (SELECT *, flagged AND requirement_id % 2 = 0 AS a, NOT flagged AND requirement_id % 3 = 0 AND field_key = 'rate' AS b FROM f)
  SELECT requirement_id, CASE WHEN count(*) FILTER (a OR b) > 0 AND count(*) FILTER (flagged AND NOT a) = 0 THEN 'reviewed' ELSE 'draft' END AS status, count(*) FILTER (a AND requirement_id % 4 = 0) AS edited,
    count(*) FILTER (source = 'manual' OR b OR (a AND requirement_id % 4 = 0)) AS manual, count(*) FILTER (flagged AND NOT a) AS open, CAST(max(length(value) + CASE WHEN a AND requirement_id % 4 = 0 THEN 1 ELSE 0 END) AS INT) AS longest FROM g GROUP BY 1"""


def r9_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches for every cell of even rows: the second's value is part of the
    first's, or a conflict; the second batch repeats a row, one citation in two
    is not allowed, and every fifth row has an unknown dimension."""
    fields = bound(spark, sf_dir, "fields").withColumn("stale_change_id", F.col("requirement_id"))
    base = fields.where("requirement_id % 2 = 0").select("requirement_id", "field_key", F.explode(F.array(*[F.struct(F.lit(b).alias("batch_no"), F.lit(r).alias("row_no")) for b, r in ((1, 1), (2, 1), (2, 2))])).alias("s"))
    second = F.when(F.col("requirement_id") % 4 == 0, F.concat(F.lit("z"), "s.row_no")).otherwise(" b ")
    value = F.when(F.col("s.batch_no") == 2, second).otherwise("abc")
    cite = F.when(F.length("field_key") % 2 == 0, F.array(F.struct(F.lit("N1").alias("node_key"), F.lit("q" * 40).alias("quote")), F.struct(F.lit("N2").alias("node_key"), F.lit("z").alias("quote")))).otherwise(F.array().cast(M.CITATIONS))
    unknown = (F.col("requirement_id") % 5 == 0) & (F.col("s.batch_no") == 2)
    rows = base.select("requirement_id", "field_key", "s.batch_no", "s.row_no", value.alias("value"), (F.col("s.batch_no") / 10).alias("confidence"), cite.alias("citations"), unknown.alias("unknown_dimensions"))
    allowed = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.concat(F.lit("N"), "r_regionkey").alias("node_key")).where("node_key <> 'N2'")
    out = M.merge_extracted(rows, fields, allowed)
    quote = F.coalesce(F.length(F.try_element_at("citations", F.lit(1))["quote"]), F.lit(0))
    return out.select(
        "requirement_id", "field_key", "value", "source", "confidence", "needs_review", "review_reason", F.size("citations").cast("long").alias("n_citations"), quote.cast("long").alias("quote_length"),
        F.col("stale_change_id").isNotNull().alias("stale"),
    )


R9_SQL = with_ctes("flat_fields") + f"""SELECT requirement_id, field_key, CASE WHEN t AND z THEN concat('abc', chr(10), 'z1') WHEN t THEN 'abc' ELSE value END AS value, CASE WHEN t THEN 'extracted' ELSE source END AS source,
  CASE WHEN t AND e THEN 0.2 WHEN t THEN 0.0 ELSE confidence END AS confidence, CASE WHEN t THEN z OR NOT e OR u ELSE needs_review END AS needs_review,
  CASE WHEN NOT t THEN '' WHEN u AND w = '' THEN '{M.UNKNOWN_DIMENSION}' WHEN u THEN concat(w, '（{M.UNKNOWN_DIMENSION}）') ELSE w END AS review_reason,
  CASE WHEN t THEN CASE WHEN e THEN 1 ELSE 0 END ELSE n END AS n_citations, CASE WHEN t THEN CASE WHEN e THEN 30 ELSE 0 END WHEN n > 0 THEN 2 ELSE 0 END AS quote_length, NOT t AS stale
  FROM (SELECT *, requirement_id % 2 = 0 AND source NOT IN ('manual', 'import') AND NOT (n > 0 AND NOT e) AS t, CASE WHEN z THEN '{M.CONFLICT}' WHEN NOT e THEN '{M.UNCITED}' ELSE '' END AS w
    FROM (SELECT *, length(field_key) % 2 = 0 AS e, requirement_id % 4 = 0 AS z, requirement_id % 5 = 0 AS u, CAST(c1 IS NOT NULL AS BIGINT) + CAST(c2 IS NOT NULL AS BIGINT) AS n FROM flat_fields) x) y"""


def r10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as blocks under 500 characters."""
    blocks = bound(spark, sf_dir, "prov").select(F.col("snapshot_id").alias("document_id"), F.col("ordinal").alias("pos"), F.length("text").alias("size"))
    out = M.pack_batches(blocks, 500)
    return out.select("document_id", F.col("pos").cast("long").alias("pos"), F.col("batch_no").cast("long").alias("batch_no"))


R10_SQL = with_ctes("prov").replace("WITH ", "WITH RECURSIVE ", 1) + """, b AS (SELECT snapshot_id AS d, ordinal AS p, CAST(length(text) AS BIGINT) AS s FROM prov),
  f AS (SELECT d, p, s AS used, CAST(0 AS BIGINT) AS n FROM b WHERE p = 0 UNION ALL SELECT b.d, b.p, CASE WHEN f.used > 0 AND f.used + b.s > 500 THEN b.s ELSE f.used + b.s END, f.n + CASE WHEN f.used > 0 AND f.used + b.s > 500 THEN 1 ELSE 0 END FROM f JOIN b ON b.d = f.d AND b.p = f.p + 1)
  SELECT d AS document_id, p AS pos, n AS batch_no FROM f"""


def r11_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.extraction_coverage(M.validate_dimensions(_dimensioned(spark, sf_dir), _vocab(spark, sf_dir)))


R11_SQL = with_ctes("requirements") + """SELECT source_document_id AS document_id, count(*) AS emitted, CAST(max(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS distinct_identities, count(*) FILTER (NOT ok) AS without_identity FROM (SELECT *, tax_key = 'tw_income' AND requirement_id % 8 // 2 = 0 AS ok FROM requirements) x GROUP BY 1"""


def r11_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dimensioned(spark, sf_dir).where("tax_key = 'tw_income'")
    return M.unused_values(rows, _vocab(spark, sf_dir)).select("dimension", "value_key")


_VALUES = ", ".join(f"('{d}', '{v}')" for d, vs in R.TW_INCOME_VOCABULARY.items() for v in vs)
_PICKS = " UNION ".join(f"SELECT '{d}' AS d, {vs}[1 + CAST(requirement_id % 8 // 2 AS INT)] AS v FROM requirements WHERE tax_key = 'tw_income'" for d, vs in _DIMS.items())
R11B_SQL = with_ctes("requirements") + f", u AS ({_PICKS}) SELECT d AS dimension, v AS value_key FROM (VALUES {_VALUES}) AS t(d, v) WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.d = t.d AND u.v = t.v)"


def r12_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.matrix_profile(bound(spark, sf_dir, "requirements"), bound(spark, sf_dir, "fields"))


R12_SQL = with_ctes("requirements", "flat_fields") + """SELECT 'tax_key' AS facet, tax_key AS name, count(*) AS n FROM requirements GROUP BY 2 UNION ALL SELECT 'role', taxpayer_role, count(*) FROM requirements GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM flat_fields GROUP BY 2
  UNION ALL SELECT 'citation', CASE WHEN c1 IS NOT NULL OR c2 IS NOT NULL THEN 'cited' ELSE 'uncited' END, count(*) FROM flat_fields GROUP BY 2"""


def r13_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.jurisdiction_mismatches(bound(spark, sf_dir, "requirements"), bound(spark, sf_dir, "docs"), bound(spark, sf_dir, "sources"))


R13_SQL = with_ctes("requirements", "docs", "sources") + "SELECT r.requirement_id, r.country, s.country AS source_country FROM requirements r JOIN docs d ON d.document_id = r.source_document_id JOIN sources s ON s.source_key = d.source_key WHERE r.country <> s.country"


def r14_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.term_audit(bound(spark, sf_dir, "prov"), ["the", "en", "License", "no such term"])


R14_SQL = with_ctes("prov") + """SELECT t AS term, CAST(sum((length(text) - length(replace(text, t, ''))) // length(t)) AS BIGINT) AS occurrences, count(*) FILTER (contains(text, t)) AS provisions FROM prov CROSS JOIN (VALUES ('the'), ('en'), ('License'), ('no such term')) AS v(t) GROUP BY 1"""


def r14_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = bound(spark, sf_dir, "prov").select(F.col("snapshot_id").alias("document_id"), F.col("ordinal").alias("pos"), F.length("text").cast("long").alias("size"))
    return M.rendered_sizes(view, 2000)


R14B_SQL = with_ctes("prov") + """SELECT snapshot_id AS document_id, CAST(sum(s) AS BIGINT) AS rendered, CAST(coalesce(max(u) FILTER (u <= 2000), 0) AS BIGINT) AS sent, sum(s) > 2000 AS truncated FROM (SELECT snapshot_id, length(text) AS s, sum(length(text)) OVER (PARTITION BY snapshot_id ORDER BY ordinal) AS u FROM prov) x GROUP BY 1"""


def r15_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios with the role echoed behind either separator, or with nothing before it."""
    req = bound(spark, sf_dir, "requirements")
    kind = F.col("requirement_id") % 4
    echoed = F.when(kind == 0, F.concat(F.lit(" "), "scenario", F.lit(" ｜"), "taxpayer_role")).when(kind == 1, F.concat("scenario", F.lit("|"), "taxpayer_role", F.lit("｜x")))
    echoed = echoed.when(kind == 2, F.concat(F.lit("｜ "), "scenario")).otherwise(F.concat("scenario", F.lit("，"), "taxpayer_role"))
    rows = req.select("country", "tax_key", echoed.alias("scenario"), "taxpayer_role", F.col("source_document_id").alias("document_id"), F.lit(1).alias("batch_no"), F.col("requirement_id").alias("row_no"))
    return M.known_scenarios(rows, 60)


R15_SQL = with_ctes("requirements") + """, e AS (SELECT *, CASE requirement_id % 4 WHEN 0 THEN scenario WHEN 1 THEN concat(scenario, '|', taxpayer_role) WHEN 2 THEN concat('｜ ', scenario) ELSE concat(scenario, '，', taxpayer_role) END AS s FROM requirements),
  f AS (SELECT country, tax_key, s AS scenario, taxpayer_role AS role, min((source_document_id, requirement_id)) AS seq FROM e GROUP BY 1, 2, 3, 4),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY country, tax_key ORDER BY seq, scenario, role) AS INT) AS pos, count(*) OVER (PARTITION BY country, tax_key) AS total FROM f) SELECT country, tax_key, pos, scenario, role, greatest(total - 60, 0) AS others FROM r WHERE pos <= 60"""


def r11_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sixth row has a value that no vocabulary knows, every fifth lacks one."""
    rows = _dimensioned(spark, sf_dir)
    rows = rows.withColumns({"tax_scheme": F.when(F.col("requirement_id") % 6 == 0, "no such scheme").otherwise(F.col("tax_scheme")), "scenario_key": F.when(F.col("requirement_id") % 5 == 0, "").otherwise(F.col("scenario_key"))})
    return M.dimension_gaps(rows.where("tax_key = 'tw_income'"), _vocab(spark, sf_dir))


def r11_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    req = bound(spark, sf_dir, "requirements")
    key = F.when(F.col("requirement_id") % 3 == 0, "").otherwise(F.concat(F.lit("i"), F.col("requirement_id") % 7))
    rows = req.select(F.col("source_document_id").alias("document_id"), key.alias("identity_key"), F.col("requirement_id").alias("row_no"), "tax_key", "taxpayer_role", "scenario")
    return M.extraction_preview(rows)


R11D_SQL = with_ctes("requirements") + """SELECT document_id, identity, count(*) AS rows, arg_min(tax_key, requirement_id) AS tax_key, arg_min(taxpayer_role, requirement_id) AS taxpayer_role, arg_min(scenario, requirement_id) AS scenario
  FROM (SELECT *, source_document_id AS document_id, CASE WHEN requirement_id % 3 = 0 THEN concat('row ', CAST(requirement_id AS VARCHAR)) ELSE concat('i', CAST(requirement_id % 7 AS VARCHAR)) END AS identity FROM requirements) x GROUP BY 1, 2"""


def r12_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.scenario_wordings(bound(spark, sf_dir, "requirements"))


R12B_SQL = with_ctes("requirements") + """, e AS (SELECT country, tax_key, scenario, count(*) AS c FROM requirements GROUP BY 1, 2, 3)
  SELECT country, tax_key, rows, wordings, CAST(rank AS INT) AS rank, scenario FROM (SELECT *, CAST(sum(c) OVER (PARTITION BY country, tax_key) AS BIGINT) AS rows, count(*) OVER (PARTITION BY country, tax_key) AS wordings, row_number() OVER (PARTITION BY country, tax_key ORDER BY encode(scenario)) AS rank FROM e) x WHERE rank <= 12"""


def r14_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = bound(spark, sf_dir, "fields").where("requirement_id % 4 > 0")
    return M.rate_lines(bound(spark, sf_dir, "requirements"), fields)


R14C_SQL = with_ctes("requirements", "flat_fields") + """SELECT r.requirement_id, r.country, r.tax_key, substr(taxpayer_role, 1, 16) AS role, coalesce(substr(value, 1, 24), '-') AS rate FROM requirements r LEFT JOIN flat_fields f ON f.requirement_id = r.requirement_id AND field_key = 'rate' AND r.requirement_id % 4 > 0"""


def r14_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view of the opening lines against all lines."""
    prov = bound(spark, sf_dir, "prov")
    return M.view_against_all(prov.where("ordinal = 0"), prov, ["the", "License", "no such term"])


R14D_SQL = with_ctes("prov") + """SELECT t AS term, CAST(coalesce(sum((length(text) - length(replace(text, t, ''))) // length(t)) FILTER (ordinal = 0), 0) AS BIGINT) AS in_view, count(*) FILTER (contains(text, t)) AS in_store,
  coalesce(sum((length(text) - length(replace(text, t, ''))) // length(t)) FILTER (ordinal = 0), 0) = 0 AND count(*) FILTER (contains(text, t)) > 0 AS missed FROM prov CROSS JOIN (VALUES ('the'), ('License'), ('no such term')) AS v(t) GROUP BY 1"""


def r14_doc_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.document_types(bound(spark, sf_dir, "docs"))


R14E_SQL = with_ctes("docs") + "SELECT doc_type, count(*) AS documents FROM docs GROUP BY 1"

QUERIES = {
    "r11_gaps": r11_gaps, "r11_preview": r11_preview, "r12_scenarios": r12_scenarios, "r14_rates": r14_rates, "r14_view": r14_view, "r14_doc_types": r14_doc_types,
    "c18_validate": c18_validate, "c19_backfill": c19_backfill, "c20_migrate": c20_migrate, "c21_map_headers": c21_map_headers, "c21_problems": c21_problems, "r1_import": r1_import, "r1_counts": r1_counts, "r2_policy_basis": r2_policy_basis, "r3_stale_cells": r3_stale_cells,
    "r3_flag_stale": r3_flag_stale, "r4_affected": r4_affected, "r5_list": r5_list, "r6_detail": r6_detail, "r7_review_queue": r7_review_queue, "r8_apply_reviews": r8_apply_reviews, "r9_merge": r9_merge, "r10_pack": r10_pack, "r11_coverage": r11_coverage,
    "r11_unused": r11_unused, "r12_profile": r12_profile, "r13_mismatches": r13_mismatches, "r14_terms": r14_terms, "r14_sizes": r14_sizes, "r15_scenarios": r15_scenarios,
}
ORACLES = {
    "r11_preview": R11D_SQL, "r12_scenarios": R12B_SQL, "r14_rates": R14C_SQL, "r14_view": R14D_SQL, "r14_doc_types": R14E_SQL,
    "c18_validate": C18_SQL, "c19_backfill": C19_SQL, "c20_migrate": C20_SQL, "c21_map_headers": C21_SQL, "c21_problems": C21B_SQL, "r1_import": R1_SQL, "r1_counts": R1B_SQL, "r2_policy_basis": R2_SQL, "r3_stale_cells": R3_SQL, "r3_flag_stale": R3B_SQL, "r4_affected": R4_SQL,
    "r5_list": R5_SQL, "r6_detail": R6_SQL, "r7_review_queue": R7_SQL, "r8_apply_reviews": R8_SQL, "r9_merge": R9_SQL, "r10_pack": R10_SQL, "r11_coverage": R11_SQL, "r11_unused": R11B_SQL, "r12_profile": R12_SQL, "r13_mismatches": R13_SQL,
    "r14_terms": R14_SQL, "r14_sizes": R14B_SQL, "r15_scenarios": R15_SQL,
}
