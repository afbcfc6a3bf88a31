"""The filing-requirement matrix.

  requirements  requirement_id, country, tax_key, scenario, taxpayer_role,
                identity_key, status, notes, last_seen_at
  fields        requirement_id, field_key, value, citations (array of struct
                node_key, quote), confidence, source, needs_review,
                review_reason, stale_change_id
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lexlake import refdata as R
from lexlake.functions.citations import extract_citations
from lexlake.functions.text import classify_tax, norm_key
from lexlake.operators import timeline
from lexlake.shared import shared_dir

CITATIONS = "array<struct<node_key:string,quote:string>>"
QUOTE_LENGTH = 30


def derivable() -> Column:
    return F.col("field_key").isin(*[k for k, yes in R.FIELD_SPECS if yes])


def identity_key(dims: list[Column]) -> Column:
    """The four dimensions joined by '|', '' unless all are set."""
    bare = [F.trim(F.coalesce(d, F.lit(""))) for d in dims]
    return F.when(reduce(Column.__and__, [b != "" for b in bare]), F.concat_ws("|", *bare)).otherwise("")


def validate_dimensions(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """C18. rows (country, tax_key and the four dimension columns) with each
    value kept only if its regime's vocabulary (country, tax_key, dimension,
    value_key) has it, unknown (array of dimension=value), missing (only if any
    dimension was given) and identity_key. Regimes without a vocabulary have
    no values, no errors."""
    allowed = vocab.groupBy("country", "tax_key").agg(F.collect_set(F.concat_ws("=", "dimension", "value_key")).alias("allowed"))
    out = rows.join(F.broadcast(allowed), ["country", "tax_key"], "left")  # one row a regime
    given = {d: F.trim(F.coalesce(F.col(d), F.lit(""))) for d in R.DIMENSIONS}
    ok = {d: (v != "") & F.coalesce(F.array_contains("allowed", F.concat(F.lit(f"{d}="), v)), F.lit(False)) for d, v in given.items()}
    any_given = reduce(Column.__or__, [v != "" for v in given.values()])
    known = F.col("allowed").isNotNull()
    unknown = F.array_compact(F.array(*[F.when(known & (v != "") & ~ok[d], F.concat(F.lit(f"{d}="), v)) for d, v in given.items()]))
    missing = F.array_compact(F.array(*[F.when(known & any_given & (v == ""), F.lit(d)) for d, v in given.items()]))
    out = out.withColumns({"unknown": unknown, "missing": missing, **{f"__{d}": F.when(ok[d], v).otherwise("") for d, v in given.items()}})
    out = out.drop("allowed", *R.DIMENSIONS).withColumnsRenamed({f"__{d}": d for d in R.DIMENSIONS})
    return out.withColumn("identity_key", identity_key([F.col(d) for d in R.DIMENSIONS]))


def infer_dimensions(scenario: Column, role: Column) -> dict[str, Column]:
    """C19. Taiwan income-tax dimensions of free text, by ordered rules.

    Fixed values: the words of each rule and the order of the rules.
    """
    text = F.concat(F.trim(F.coalesce(scenario, F.lit(""))), F.lit(" "), F.trim(F.coalesce(role, F.lit(""))))
    has = lambda *words: reduce(Column.__or__, [text.contains(w) for w in words])
    sole = has("獨資", "合夥")
    who = (
        F.when(has("非中華民國境內居住", "非居住者"), "nonresident_individual")
        .when(has("居住之個人", "居住者", "個人"), F.when(has("扣繳義務人"), "withholding_agent").otherwise("resident_individual"))
        .when(has("總機構在中華民國境外", "境外營利事業", "外國營利事業"), "foreign_enterprise")
        .when(has("總機構在中華民國境內", "境內總機構", "營利事業"), F.when(sole, "sole_proprietorship").otherwise("domestic_enterprise"))
        .when(sole, "sole_proprietorship")
        .when(has("受託人"), "trustee").when(has("受益人"), "beneficiary").when(has("扣繳義務人"), "withholding_agent").otherwise("")
    )
    scheme = (
        F.when(has("扣繳"), "withholding").when(has("未分配盈餘", "盈餘分配"), "profit_distribution").when(has("免稅", "不計入", "不課稅"), "not_taxable")
        .when(has("結算", "申報", "綜合所得稅", "營利事業", "居住者"), "annual_filing").otherwise("")
    )
    what = (
        F.when(has("房地", "房屋", "土地"), "real_estate").when(has("證券", "股票"), "securities").when(has("期貨"), "futures").when(has("信託"), "trust_income")
        .when(has("薪資", "利息", "股利", "扣繳"), F.when(scheme == "withholding", "salary_interest").otherwise("general_income"))
        .when(has("所得", "營所稅", "綜所稅", "營利事業", "居住者", "個人"), "general_income").otherwise("")
    )
    case = F.coalesce(R.first_contained(text, R.SCENARIO_WORDS), F.lit("standard"))
    return dict(zip(R.DIMENSIONS, (who, scheme, what, case)))


def backfill_identity(requirements: DataFrame, country: str = "TW", tax_key: str = "tw_income") -> DataFrame:
    """C19. Fills identity_key where it is empty and the inferred dimensions are
    a complete set of the vocabulary; rows with a key are left alone."""
    dims = infer_dimensions(F.col("scenario"), F.col("taxpayer_role"))
    valid = reduce(Column.__and__, [c.isin(*R.TW_INCOME_VOCABULARY[d]) for d, c in dims.items()])
    mine = (F.col("country") == country) & (F.col("tax_key") == tax_key) & (F.coalesce("identity_key", F.lit("")) == "")
    return requirements.withColumn("identity_key", F.when(mine & valid, F.concat_ws("|", *dims.values())).otherwise(F.col("identity_key")))


def _migrated(country: Column, key: Column) -> Column:
    renamed = R.mapped({f"{c}|{k}": v for (c, k), v in R.RENAMED_TAX_KEYS.items()})
    land = F.upper(F.coalesce(country, F.lit("CN")))
    return F.when(key.startswith(F.concat(F.lower(land), F.lit("_"))), key).otherwise(
        F.coalesce(F.try_element_at(renamed, F.concat_ws("|", land, key)), F.concat_ws("_", F.lower(land), key))
    )


def migrate_tax_keys(requirements: DataFrame) -> DataFrame:
    """C20. Keys without their country's prefix get it, or their new name; idempotent."""
    return requirements.withColumn("tax_key", _migrated(F.col("country"), F.col("tax_key")))


def migrate_corpus_keys(corpus: DataFrame) -> DataFrame:
    """C20 on the array column (the corpus is CN)."""
    return corpus.withColumn("tax_keys", F.transform("tax_keys", lambda k: _migrated(F.lit("CN"), k)))


def header_field(header: Column) -> Column:
    """C21. The field of a header text, by the first hint it contains, without
    regard to case, white space and hyphens; null if none."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"(?U)[\s\-]+", "")
    hints = [(k.lower().replace(" ", "").replace("-", ""), v) for k, v in R.HEADER_HINTS]
    return R.first_contained(bare(header), hints)


def map_headers(headers: DataFrame) -> DataFrame:
    """C21. headers (sheet_id, pos, header) with field; the first column of a
    field keeps it."""
    w = Window.partitionBy("sheet_id", "field").orderBy("pos")
    out = headers.withColumn("field", header_field(F.col("header")))
    return out.withColumn("field", F.when(F.row_number().over(w) == 1, F.col("field")))


def header_problems(mapped: DataFrame) -> DataFrame:
    """C21. Per sheet: unmapped headers, and missing identity columns."""
    have = F.collect_set("field")
    named = F.array_compact(F.array(*[F.when(~F.array_contains(have, f), F.lit(f)) for f in ("_tax", "_scenario", "_role")]))
    unmapped = F.sort_array(F.collect_set(F.when(F.col("field").isNull() & (F.trim("header") != ""), F.trim("header"))))
    return mapped.groupBy("sheet_id").agg(unmapped.alias("unmapped"), named.alias("missing"))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


#: Why an imported cell is to be reviewed.
IMPORTED_CITED = "由試算表匯入，已對應條文但內容未經人工確認"
IMPORTED_UNCITED = "由試算表匯入，尚未對應條文，法規異動時無法自動追蹤"
#: Characters of a policy basis that stand for a citation without a text of its own.
BASIS_QUOTE = 100


def _basis_citations(cells: DataFrame, provisions: DataFrame) -> DataFrame:
    """row_no, cited (what the row's policy basis names and a provision has, in
    order, each name once), resolved, unresolved. A basis that names nothing
    counts as one unresolved."""
    none = F.lit(None).cast("string")
    basis = cells.where("field = '_policy_basis'").groupBy("row_no").agg(F.max(_stripped(F.col("value"))).alias("basis")).where("basis <> ''")
    named = basis.select("row_no", "basis", F.posexplode_outer(extract_citations("basis", none, none)).alias("pos", "c"))
    named = named.groupBy("row_no", F.col("c.entity_key").alias("name")).agg(F.min(F.struct("pos", F.coalesce(F.when(F.col("c.raw_text") != "", F.col("c.raw_text")), F.substring("basis", 1, BASIS_QUOTE)).alias("quote"))).alias("m"))
    stored = provisions.select(norm_key(F.col("node_key")).alias("key"), "node_key").where("key <> ''").groupBy("key").agg(F.min("node_key").alias("node_key"))
    rows = named.withColumn("key", norm_key(F.col("name"))).join(stored, "key", "left")
    entry = F.struct("m.pos", "node_key", "m.quote")
    cited = F.array_sort(F.collect_list(F.when(F.col("node_key").isNotNull(), entry)))
    found = rows.groupBy("row_no").agg(cited.alias("cited"), F.count_if(F.col("node_key").isNotNull()).alias("resolved"), F.count_if(F.col("node_key").isNull()).alias("unresolved"))
    return found.withColumn("cited", F.transform("cited", lambda c: F.struct(c["node_key"].alias("node_key"), c["quote"].alias("quote"))))


def import_matrix(cells: DataFrame, requirements: DataFrame, fields: DataFrame, country: str, provisions: DataFrame, as_of: Column, source_note: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """R1. Sheet cells (row_no, field, value) → (requirements, fields, one row of
    counts: rows, cells, resolved, unresolved) after an upsert on (country,
    tax_key, scenario, role).

    Rows without a scenario are skipped. A touched row is a draft again, stamped
    with ``as_of``, and gets the note once. Non-blank cells come as source
    ``import`` with confidence 0, flagged, and with the citations of their row's
    policy basis (``_policy_basis``) that stored provisions have, or none: old
    citations go with the old value. Of rows with the same key the last non-blank
    cell counts. Null values are blank; an empty sheet changes nothing."""
    key = ["country", "tax_key", "scenario", "taxpayer_role"]
    pick = lambda f: F.max(F.when(F.col("field") == f, _stripped(F.col("value"))))
    rows = cells.groupBy("row_no").agg(pick("_tax").alias("tax"), pick("_scenario").alias("scenario"), F.coalesce(pick("_role"), F.lit("")).alias("taxpayer_role"))
    rows = rows.where("scenario <> ''").withColumns({"country": F.lit(country), "tax_key": classify_tax(F.coalesce("tax", F.lit("")), F.lit(country))})
    rows = rows.join(_basis_citations(cells, provisions), "row_no", "left").select(*key, "row_no", "cited", "resolved", "unresolved")
    touched = rows.groupBy(*key).agg(F.lit(True).alias("touched"))
    merged = requirements.join(touched, key, "full_outer").withColumn("requirement_id", F.coalesce("requirement_id", F.xxhash64(*key)))
    hit, noted, note = F.col("touched").isNotNull(), F.coalesce("notes", F.lit("")), source_note.strip()
    if note:
        noted = F.when(hit & ~noted.contains(note), F.concat_ws("\n", F.when(noted != "", noted), F.lit(note))).otherwise(noted)
    stamped = {"notes": noted, "status": F.when(hit, "draft").otherwise(F.col("status")), "last_seen_at": F.when(hit, as_of).otherwise(F.col("last_seen_at"))}
    merged = merged.withColumns(stamped)
    put = cells.withColumn("value", _stripped(F.col("value"))).where((F.col("value") != "") & F.col("field").isin(*[k for k, _ in R.FIELD_SPECS]))
    put = put.join(rows, "row_no").join(merged.select("requirement_id", *key), key)
    last = F.max_by(F.struct("value", F.coalesce("cited", F.array().cast(CITATIONS)).alias("cited")), F.struct("row_no", "value")).alias("n")
    put = put.groupBy("requirement_id", F.col("field").alias("field_key")).agg(last).select("requirement_id", "field_key", "n.*").withColumnRenamed("value", "new_value")
    both = fields.join(put, ["requirement_id", "field_key"], "full_outer")
    hit = F.col("new_value").isNotNull()
    set_ = lambda c, v: F.when(hit, v).otherwise(F.col(c)).alias(c)
    reason = F.when(F.size("cited") > 0, IMPORTED_CITED).otherwise(IMPORTED_UNCITED)
    new_fields = both.select(
        "requirement_id", "field_key", set_("value", F.col("new_value")), set_("citations", F.col("cited")).cast(CITATIONS).alias("citations"),
        set_("confidence", F.lit(0.0)), set_("source", F.lit("import")), set_("needs_review", F.lit(True)), set_("review_reason", reason), "stale_change_id",
    )
    blank = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    counts = rows.agg(F.count("*").alias("rows"), blank(F.sum("resolved")).alias("resolved"), blank(F.sum("unresolved")).alias("unresolved"))
    counts = counts.crossJoin(put.agg(F.count("*").alias("cells"))).select("rows", "cells", "resolved", "unresolved")  # one row each
    return merged.select(*requirements.columns), new_fields.select(*fields.columns), counts


def resolve_policy_basis(rows: DataFrame, provisions: DataFrame) -> DataFrame:
    """R2. rows (row_id, basis) → row_id, node_key, resolved: each article that the
    text cites, and whether any stored provision has that key."""
    none = F.lit(None).cast("string")
    cited = rows.withColumn("c", F.explode(extract_citations("basis", none, none))).select("row_id", norm_key(F.col("c.entity_key")).alias("node_key")).distinct()
    have = provisions.select(norm_key(F.col("node_key")).alias("node_key"), F.lit(True).alias("resolved")).distinct()
    return cited.join(have, "node_key", "left").na.fill(False, ["resolved"])


def _worst_changes(changes: DataFrame) -> DataFrame:
    """The most severe change of each provision; of equals the first by id."""
    rank = F.element_at(R.mapped(R.SEVERITIES), F.col("severity"))
    best = F.max_by(F.struct("change_id", "document_id", "node_key", "change_type", "severity", "detected_at"), F.struct(rank, -F.col("change_id"))).alias("c")
    return changes.groupBy(norm_key(F.col("node_key")).alias("key")).agg(best)


def _cited(fields: DataFrame) -> DataFrame:
    return fields.select("requirement_id", "field_key", F.posexplode(F.transform("citations", lambda c: c["node_key"])).alias("pos", "node_key")).withColumn("key", norm_key(F.col("node_key")))


def stale_cells(fields: DataFrame, changes: DataFrame, documents: DataFrame) -> DataFrame:
    """R3. requirement_id, field_key, change_id, reason of the cells to flag:
    derivable, not flagged yet, and citing a changed provision; the first
    citation that changed gives the reason, with its document's title."""
    open_ = fields.where(derivable() & ~F.col("needs_review"))
    hits = _cited(open_).join(_worst_changes(changes), "key")
    first = hits.groupBy("requirement_id", "field_key").agg(F.min_by("c", "pos").alias("c")).select("requirement_id", "field_key", "c.*")
    first = first.join(documents.select("document_id", "title"), "document_id", "left")
    label = F.coalesce(F.try_element_at(R.mapped(R.FIELD_LABELS), F.col("field_key")), F.col("field_key"))
    day = F.coalesce(F.date_format("detected_at", "yyyy-MM-dd"), F.lit(""))
    # Fixed value: the wording of the reason.
    reason = F.format_string("%s 所依據的 %s（%s）於 %s 偵測到%s 異動（%s），請重新確認。", label, "node_key", F.coalesce("title", F.lit("來源法規")), day, "change_type", "severity")
    return first.select("requirement_id", "field_key", "change_id", reason.alias("reason"))


def flag_stale(fields: DataFrame, requirements: DataFrame, changes: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R3 applied: (fields, requirements) with the flags, the rows' status stale."""
    stale = stale_cells(fields, changes, documents)
    out = fields.join(stale, ["requirement_id", "field_key"], "left")
    hit = F.col("change_id").isNotNull()
    out = out.withColumns({"needs_review": hit | F.col("needs_review"), "review_reason": F.coalesce("reason", "review_reason"), "stale_change_id": F.coalesce("change_id", "stale_change_id")})
    rows = requirements.join(stale.select("requirement_id", F.lit(True).alias("hit")).distinct(), "requirement_id", "left")
    rows = rows.withColumn("status", F.when(F.col("hit"), "stale").otherwise(F.col("status")))
    return out.select(*fields.columns), rows.select(*requirements.columns)


def affected_cells(node_keys: DataFrame, fields: DataFrame, requirements: DataFrame) -> DataFrame:
    """R4. (node_key normalised, requirement_id, field_key, needs_review, country,
    tax_key): cells that cite a key, reviewed ones too, each once a key."""
    wanted = node_keys.select(norm_key(F.col("node_key")).alias("key")).distinct()
    cited = fields.where(F.size("citations") > 0).select("requirement_id", "field_key", "needs_review", F.transform("citations", lambda c: c["node_key"]).alias("nodes"))
    # The cells of a few input files are dealt to all tasks before their keys are made; a cell drops its own repeats.
    cells = cited.repartition("requirement_id").join(requirements.select("requirement_id", "country", "tax_key"), "requirement_id")
    cells = cells.withColumn("key", F.explode(F.array_distinct(F.transform("nodes", norm_key)))).drop("nodes")
    return cells.join(wanted, "key").select("requirement_id", "field_key", "key", "needs_review", "country", "tax_key")


def list_requirements(requirements: DataFrame, fields: DataFrame) -> DataFrame:
    """R5. Per row: fields, cited and flagged counts, mean confidence of cited
    cells, unconfirmed (not stamped by its tax type's latest run); flagged first."""
    cited = F.size("citations") > 0
    counts = fields.groupBy("requirement_id").agg(
        F.count("*").alias("n_fields"), F.count_if(cited).alias("n_cited"), F.count_if("needs_review").alias("n_review"),
        F.round(F.avg(F.when(cited, F.col("confidence"))), 6).alias("confidence"),
    )
    newest = requirements.groupBy("country", "tax_key").agg(F.max("last_seen_at").alias("newest")).where("newest is not null")
    rows = requirements.join(newest, ["country", "tax_key"], "left").join(counts, "requirement_id", "left")
    unconfirmed = F.col("newest").isNotNull() & ~F.col("newest").eqNullSafe(F.col("last_seen_at"))
    rows = rows.withColumn("unconfirmed", unconfirmed).select(*requirements.columns, "unconfirmed", "n_fields", "n_cited", "n_review", "confidence")
    return rows.na.fill(0, ["n_fields", "n_cited", "n_review"]).orderBy(F.desc("n_review"), "scenario", "requirement_id")


def requirement_detail(requirements: DataFrame, fields: DataFrame, changes: DataFrame) -> DataFrame:
    """R6. Every row × the eleven columns, missing cells marked, with the node key
    and severity of the change that made a cell stale. The specs are eleven
    rows; each row is exploded in place."""
    specs = F.explode(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(k).alias("field_key")) for i, (k, _) in enumerate(R.FIELD_SPECS)]))
    rows = requirements.select("requirement_id", specs.alias("s")).select("requirement_id", "s.*")
    linked = changes.select(F.col("change_id").alias("stale_change_id"), F.col("node_key").alias("change_node_key"), F.col("severity").alias("change_severity"))
    rows = rows.join(fields, ["requirement_id", "field_key"], "left").withColumn("is_missing", F.col("value").isNull())
    # Cells without a change go by a hash of their own, or all of them would meet in one task.
    dealt = F.coalesce("stale_change_id", F.xxhash64("requirement_id", "field_key"))
    out = rows.withColumn("__dealt", dealt).join(linked.withColumnRenamed("stale_change_id", "__change"), (F.col("__dealt") == F.col("__change")) & (F.col("stale_change_id") == F.col("__change")), "left")
    return out.select("stale_change_id", *[c for c in rows.columns if c != "stale_change_id"], "change_node_key", "change_severity")


def review_queue(fields: DataFrame, requirements: DataFrame, country: str | None = None, tax_key: str | None = None) -> DataFrame:
    """R7. Flagged cells, filtered, in order."""
    rows = fields.where("needs_review").join(requirements.select("requirement_id", "country", "tax_key", "scenario"), "requirement_id")
    for name, value in (("country", country), ("tax_key", tax_key)):
        rows = rows.where(F.col(name) == value) if value else rows
    return rows.orderBy("country", "tax_key", "scenario", "requirement_id", "field_key")


def apply_reviews(fields: DataFrame, requirements: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R8. decisions (requirement_id, field_key, value or null, clear_flag), one a
    cell: a value (trimmed, an equal one too) makes the cell manual, null accepts
    it as it is; clear_flag drops the flag; a missing cell is made. A row that a
    decision touches is reviewed when none of its cells is flagged any more.
    Decisions on rows that don't exist do nothing."""
    known = requirements.select("requirement_id")
    d = decisions.join(known, "requirement_id", "left_semi").select("requirement_id", "field_key", F.lit(True).alias("touched"), F.col("value").alias("new_value"), "clear_flag")
    both = fields.join(d, ["requirement_id", "field_key"], "full_outer")
    edited = F.col("new_value").isNotNull()
    cleared = F.coalesce("clear_flag", F.lit(False))
    out = both.select(
        "requirement_id", "field_key", F.when(edited, _stripped(F.col("new_value"))).otherwise(F.col("value")).alias("value"), F.coalesce("citations", F.array().cast(CITATIONS)).alias("citations"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.when(edited, "manual").otherwise(F.coalesce("source", F.lit("manual"))).alias("source"),
        (F.coalesce("needs_review", F.lit(False)) & ~cleared).alias("needs_review"), F.when(cleared, "").otherwise(F.coalesce("review_reason", F.lit(""))).alias("review_reason"),
        F.when(~cleared, F.col("stale_change_id")).alias("stale_change_id"), "touched",
    )
    flags = out.groupBy("requirement_id").agg(F.bool_or("needs_review").alias("left_open"), F.bool_or("touched").alias("asked"))
    rows = requirements.join(flags, "requirement_id", "left")
    done = F.coalesce("asked", F.lit(False)) & ~F.coalesce("left_open", F.lit(False))
    rows = rows.withColumn("status", F.when(done, "reviewed").otherwise(F.col("status")))
    return out.select(*fields.columns), rows.select(*requirements.columns)


#: Why a merged cell is to be reviewed.
CONFLICT, UNCITED = "多個批次給出不同內容，已合併待人工確認", "無條文依據，需人工確認"
UNKNOWN_DIMENSION, MISSING_DIMENSION = "含未知的身分維度值", "身分維度值缺漏"
_MERGED = f"struct<written:boolean,value:string,citations:{CITATIONS},confidence:double,needs_review:boolean,review_reason:string>"


def merge_extracted(extracted: DataFrame, fields: DataFrame, allowed_nodes: DataFrame) -> DataFrame:
    """R9. extracted (requirement_id, batch_no, row_no, field_key, value,
    confidence, citations, and where known unknown_dimensions and
    missing_dimensions) merged into fields.

    Citations count only if their node was supplied; quotes are cut. In a batch
    the first duplicate of a cell wins, and blank values don't count. The first
    batch that writes a cell replaces it: uncited values have confidence 0 and
    are flagged. Later batches add a line unless the text holds their value
    already, which is a conflict; citations unite and the highest confidence
    counts. Uncited values never touch a cited cell, nor any a human one
    (manual, import). Rows with dimension issues flag the cell. A written cell
    is no longer stale. A cell has at most one value a batch, so what is folded
    in one row is as long as the run has batches.
    """
    cell = ["requirement_id", "field_key"]
    w = Window.partitionBy(*cell, "batch_no").orderBy("row_no")
    issues = [(c, text) for c, text in (("unknown_dimensions", UNKNOWN_DIMENSION), ("missing_dimensions", MISSING_DIMENSION)) if c in extracted.columns]
    issue = F.concat_ws("、", *[F.when(F.col(c), text) for c, text in issues]) if issues else F.lit("")
    # Dealt by cell first: the window would sort all rows of an input file in its task.
    rows = extracted.where(F.trim("value") != "").repartition(*cell).withColumn("r", F.row_number().over(w)).where("r = 1")
    rows = rows.select(*cell, "batch_no", F.trim("value").alias("value"), "confidence", "citations", issue.alias("issue"))
    known = allowed_nodes.select(F.col("node_key").alias("node")).distinct()
    cites = rows.select(*cell, "batch_no", F.posexplode("citations").alias("pos", "c")).join(known, F.trim("c.node_key") == F.col("node"))
    quote = F.substring(F.trim(F.coalesce("c.quote", F.lit(""))), 1, QUOTE_LENGTH)
    kept = F.sort_array(F.collect_list(F.struct("pos", F.struct(F.col("node").alias("node_key"), quote.alias("quote")).alias("c"))))
    cites = cites.groupBy(*cell, "batch_no").agg(F.transform(kept, lambda x: x["c"]).alias("cites"))
    rows = rows.join(cites, [*cell, "batch_no"], "left").withColumn("cites", F.coalesce("cites", F.array().cast(CITATIONS)))
    batches = rows.groupBy(*cell).agg(F.sort_array(F.collect_list(F.struct("batch_no", "value", "confidence", "cites", "issue"))).alias("batches"))

    def united(old: Column, new: Column) -> Column:
        def add(held: Column, c: Column) -> Column:
            return F.when(F.exists(held, lambda h: h["node_key"] == c["node_key"]), held).otherwise(F.array_append(held, c))

        return F.aggregate(new, old, add)

    def put(a: Column, x: Column) -> Column:
        cited = F.size(x["cites"]) > 0
        more = a["written"] & (a["value"] != "")
        conflict = more & ~F.contains(a["value"], x["value"])
        confidence = F.when(cited, x["confidence"]).otherwise(0.0)
        reason = F.when(conflict, CONFLICT).when(more, a["review_reason"]).when(~cited, UNCITED).otherwise("")
        flagged = F.when(reason == "", x["issue"]).otherwise(F.concat(reason, F.lit("（"), x["issue"], F.lit("）")))
        has_issue = x["issue"] != ""
        out = F.struct(
            F.lit(True).alias("written"),
            F.when(~more, x["value"]).when(conflict, F.concat(a["value"], F.lit("\n"), x["value"])).otherwise(a["value"]).alias("value"),
            F.when(more, united(a["citations"], x["cites"])).otherwise(x["cites"]).alias("citations"),
            F.when(more, F.greatest(a["confidence"], confidence)).otherwise(confidence).alias("confidence"),
            (has_issue | F.when(more, a["needs_review"] | conflict).otherwise(~cited)).alias("needs_review"),
            F.when(has_issue, flagged).otherwise(reason).alias("review_reason"),
        )
        return F.when((F.size(a["citations"]) > 0) & ~cited, a).otherwise(out.cast(_MERGED))

    both = fields.join(batches, cell, "full_outer")
    human = F.coalesce(F.col("source").isin("manual", "import"), F.lit(False))
    start = F.struct(
        F.lit(False).alias("written"), F.coalesce("value", F.lit("")).alias("value"), F.coalesce("citations", F.array().cast(CITATIONS)).alias("citations"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("needs_review", F.lit(False)).alias("needs_review"), F.coalesce("review_reason", F.lit("")).alias("review_reason"),
    ).cast(_MERGED)
    nothing = F.array().cast(batches.schema["batches"].dataType)
    both = both.withColumn("m", F.aggregate(F.when(human | F.col("batches").isNull(), nothing).otherwise(F.col("batches")), start, put))
    written = F.col("m.written")
    return both.select(
        *cell, *[F.when(written, F.col(f"m.{c}")).otherwise(F.col(c)).alias(c) for c in ("value", "citations", "confidence")], F.when(written, "extracted").otherwise(F.col("source")).alias("source"),
        *[F.when(written, F.col(f"m.{c}")).otherwise(F.col(c)).alias(c) for c in ("needs_review", "review_reason")], F.when(~written, F.col("stale_change_id")).alias("stale_change_id"),
    ).select(*fields.columns)


#: A document of more blocks than this is packed by several tasks.
LONG_DOCUMENT = 1_000_000


def _packed_in_order(rows: DataFrame, budget: int) -> DataFrame:
    """One pass over the sorted sizes of a task's documents, which holds one running sum."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, used, n = None, 0, 0
        for batch in batches:
            numbers = []
            for d, size in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if d != document:
                    document, used, n = d, 0, 0
                elif used > 0 and used + size > budget:
                    used, n = 0, n + 1
                used += size
                numbers.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(numbers, pa.int32())], names=["document_id", "pos", "batch_no"])

    ordered = rows.repartition("document_id").sortWithinPartitions("document_id", "pos")
    schema = StructType([*rows.select("document_id", "pos").schema.fields, StructField("batch_no", IntegerType())])
    return ordered.mapInArrow(pack, schema)


def _packed_by_jumps(rows: DataFrame, budget: int) -> DataFrame:
    """The same by binary lifting. Where a batch that begins at a block ends
    follows from running sums: one look-up for each block. Those jumps are doubled
    round by round, and each round marks as many further starts as there are, from
    the first block on."""
    by = "document_id"
    base = timeline.running_sum(timeline.place(timeline.in_blocks(rows, by, ["pos"]), by, "n"), by, "size", "until")
    base = base.select(by, "pos", "size", "n", "until").checkpoint(eager=True)
    none = F.lit(None).cast("long")
    held = base.select(by, F.col("until").alias("at"), F.lit(0).alias("kind"), F.col("n").cast("long").alias("n"), none.alias("of"))
    before = F.col("until") - F.col("size")
    full, empty = (base.select(by, at.alias("at"), F.lit(kind).alias("kind"), none.alias("n"), F.col("n").cast("long").alias("of")) for kind, at in ((1, before + budget), (2, before)))
    asked = timeline.in_blocks(held.union(full).union(empty), by, ["at", "kind", "n"])
    asked = timeline.last_value(asked, by, F.col("n"), "last", own=True).where("kind > 0")
    # The first block that doesn't fit; an over-long one, and blocks of no size before it, stand alone.
    ends = asked.groupBy(by, F.col("of").alias("n")).agg(F.max(F.when(F.col("kind") == 1, F.coalesce("last", F.lit(0)))).alias("fits"), F.max(F.when(F.col("kind") == 2, F.coalesce("last", F.lit(0)))).alias("nothing"))
    after = F.when(F.col("fits") > F.col("nothing"), F.col("fits") + 1).otherwise(F.col("nothing") + 2)
    last = base.groupBy(by).agg(F.max("n").alias("blocks"))
    jumps = ends.select(by, "n", after.alias("to")).join(last, by).where("to <= blocks").select(by, "n", "to").checkpoint(eager=True)
    starts = base.where("n = 1").select(by, F.col("n").cast("long").alias("n"))
    while True:
        more = starts.join(jumps, [by, "n"]).select(by, F.col("to").alias("n")).checkpoint(eager=True)
        if more.isEmpty():
            break
        starts = starts.union(more)
        jumps = jumps.join(jumps.select(by, F.col("n").alias("to"), F.col("to").alias("further")), [by, "to"]).select(by, "n", F.col("further").alias("to")).checkpoint(eager=True)
    numbered = base.join(starts.withColumn("begins", F.lit(1)), [by, "n"], "left").select(by, "pos", F.coalesce("begins", F.lit(0)).alias("begins"))
    numbered = timeline.running_sum(timeline.in_blocks(numbered, by, ["pos"]), by, "begins", "batch_no")
    return numbered.select(by, "pos", (F.col("batch_no") - 1).cast("int").alias("batch_no"))


def pack_batches(blocks: DataFrame, budget: int = 20_000) -> DataFrame:
    """R10. blocks (document_id, pos, size) with batch_no: next-fit in order under
    a budget of characters; an over-long block stands alone; a null size is 0.
    Documents of over LONG_DOCUMENT blocks are spread over tasks; texts don't
    take part."""
    rows = blocks.select("document_id", F.col("pos").cast("int").alias("pos"), F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"))
    shared_dir(rows.sparkSession)
    many = rows.groupBy("document_id").agg(F.count("*").alias("blocks")).where(F.col("blocks") > LONG_DOCUMENT).select("document_id").checkpoint(eager=True)
    if many.isEmpty():
        return _packed_in_order(rows, budget)
    # At most one document in LONG_DOCUMENT blocks is a long one.
    few = F.broadcast(many)
    return _packed_in_order(rows.join(few, "document_id", "left_anti"), budget).union(_packed_by_jumps(rows.join(few, "document_id", "left_semi"), budget))


def extraction_coverage(extracted: DataFrame) -> DataFrame:
    """R11. Per document: rows emitted, distinct identities, rows without one
    (rows carry document_id and identity_key)."""
    key = F.when(F.col("identity_key") != "", F.col("identity_key"))
    return extracted.groupBy("document_id").agg(F.count("*").alias("emitted"), F.countDistinct(key).alias("distinct_identities"), F.count_if(key.isNull()).alias("without_identity"))


def dimension_gaps(extracted: DataFrame, vocab: DataFrame) -> DataFrame:
    """R11. Per document: values of the four dimensions that the regime's
    vocabulary lacks (unknown), and rows with some dimensions but not all of
    them (incomplete). Regimes without a vocabulary know no value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.trim(F.coalesce(F.col(d), F.lit(""))).alias("value_key")) for d in R.DIMENSIONS])).alias("p")
    filled = reduce(Column.__add__, [(F.trim(F.coalesce(F.col(d), F.lit(""))) != "").cast("int") for d in R.DIMENSIONS])
    rows = extracted.select("document_id", "country", "tax_key", pairs).select("document_id", "country", "tax_key", "p.*").where("value_key <> ''")
    known = vocab.select("country", "tax_key", "dimension", "value_key").distinct()
    unknown = rows.join(known, ["country", "tax_key", "dimension", "value_key"], "left_anti").groupBy("document_id").agg(F.count("*").alias("unknown"))
    partial = extracted.groupBy("document_id").agg(F.count_if((filled > 0) & (filled < len(R.DIMENSIONS))).alias("incomplete"))
    return partial.join(unknown, "document_id", "left").na.fill(0, ["unknown"]).select("document_id", "unknown", "incomplete")


def extraction_preview(extracted: DataFrame) -> DataFrame:
    """R11. What a run would write, a row for each identity of a document (rows
    without one stand for themselves): tax key, role, scenario of its first row
    and how many rows fold into it."""
    own = F.when(F.col("identity_key") != "", F.col("identity_key")).otherwise(F.concat(F.lit("row "), F.col("row_no").cast("string")))
    first = F.min_by(F.struct("tax_key", "taxpayer_role", "scenario"), "row_no").alias("f")
    folded = extracted.groupBy("document_id", own.alias("identity")).agg(F.count("*").alias("rows"), first)
    return folded.select("document_id", "identity", "rows", "f.*")


def unused_values(extracted: DataFrame, vocab: DataFrame) -> DataFrame:
    """R11. Vocabulary values that no document of the regime used."""
    used = extracted.select("country", "tax_key", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value_key")) for d in R.DIMENSIONS])).alias("u"))
    return vocab.join(used.select("country", "tax_key", "u.*").distinct(), ["country", "tax_key", "dimension", "value_key"], "left_anti")


def matrix_profile(requirements: DataFrame, fields: DataFrame) -> DataFrame:
    """R12. (facet, name, n): rows a tax type, cells a source, cited cells, rows a role."""
    count = lambda df, facet, name: df.groupBy(name.alias("name")).agg(F.count("*").alias("n")).select(F.lit(facet).alias("facet"), "name", "n")
    cited = F.when(F.size("citations") > 0, "cited").otherwise("uncited")
    parts = [count(requirements, "tax_key", F.col("tax_key")), count(requirements, "role", F.col("taxpayer_role")), count(fields, "source", F.col("source")), count(fields, "citation", cited)]
    return reduce(DataFrame.union, parts)


def scenario_wordings(requirements: DataFrame, n: int = 12) -> DataFrame:
    """R12. Per tax type its rows, distinct scenario wordings and the first n of
    them in order (a top-k report): country, tax_key, rows, wordings, rank, scenario."""
    regime = ["country", "tax_key"]
    each = requirements.groupBy(*regime, F.trim("scenario").alias("scenario")).agg(F.count("*").alias("c"))
    counts = each.groupBy(*regime).agg(F.sum("c").alias("rows"), F.count("*").alias("wordings"))
    top = each.withColumn("rank", F.row_number().over(Window.partitionBy(*regime).orderBy("scenario"))).where(F.col("rank") <= n)
    return top.join(counts, regime).select(*regime, "rows", "wordings", "rank", "scenario")


def jurisdiction_mismatches(requirements: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """R13. Rows whose country differs from that of their source document's source."""
    rows = requirements.select("requirement_id", "country", "source_document_id").join(documents.select(F.col("document_id").alias("source_document_id"), "source_key"), "source_document_id")
    rows = rows.join(sources.select("source_key", F.col("country").alias("source_country")), "source_key")
    return rows.where("country <> source_country").select("requirement_id", "country", "source_country")


def term_audit(provisions: DataFrame, terms: list[str]) -> DataFrame:
    """R14. Per term: occurrences and provisions that hold it."""
    found = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), (F.size(F.split("text", _quoted(t), -1)) - 1).alias("n")) for t in terms])).alias("f")
    return provisions.select(found).groupBy("f.term").agg(F.sum("f.n").alias("occurrences"), F.count_if(F.col("f.n") > 0).alias("provisions"))


def rate_lines(requirements: DataFrame, fields: DataFrame) -> DataFrame:
    """R14. Per row of the matrix: tax key, role and rate, shortened, '-' for none."""
    short = lambda c, n: F.coalesce(F.when(c != "", F.substring(c, 1, n)), F.lit("-"))
    rates = fields.where("field_key = 'rate'").select("requirement_id", F.replace("value", F.lit("\n"), F.lit(" ")).alias("rate"))
    rows = requirements.select("requirement_id", "country", "tax_key", "taxpayer_role").join(rates, "requirement_id", "left")
    return rows.select("requirement_id", "country", "tax_key", short(F.col("taxpayer_role"), 16).alias("role"), short(F.col("rate"), 24).alias("rate"))


def view_against_all(view: DataFrame, provisions: DataFrame, terms: list[str]) -> DataFrame:
    """R14. Per term: its occurrences in the text of a view, and the provisions of
    the whole store that hold it; a term that is stored but not in the view is
    what a reader of the view misses."""
    shown = term_audit(view, terms).select("term", F.col("occurrences").alias("in_view"))
    stored = term_audit(provisions, terms).select("term", F.col("provisions").alias("in_store"))
    return shown.join(stored, "term").withColumn("missed", (F.col("in_view") == 0) & (F.col("in_store") > 0))


def document_types(documents: DataFrame) -> DataFrame:
    """R14. Documents a type."""
    return documents.groupBy("doc_type").agg(F.count("*").alias("documents"))


def _quoted(term: str) -> str:
    return "\\Q" + term + "\\E"


def rendered_sizes(view: DataFrame, budget: int) -> DataFrame:
    """R14. view (document_id, pos, size): characters rendered, sent within the
    budget in order, and whether the view was cut."""
    running = F.sum("size").over(Window.partitionBy("document_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = view.withColumn("until", running)
    sent = F.coalesce(F.max(F.when(F.col("until") <= budget, F.col("until"))), F.lit(0))
    return rows.groupBy("document_id").agg(F.sum("size").alias("rendered"), sent.alias("sent"), (F.sum("size") > budget).alias("truncated"))


#: What stands between a scenario and a role that was echoed into it.
ROLE_SEPARATORS = ("｜", "|")


def known_scenarios(extracted: DataFrame, cap: int = 60) -> DataFrame:
    """R15. (country, tax_key, pos, scenario, role, others): the distinct pairs by
    first sighting, at most ``cap`` (the list's length is the feature) and the
    count of the others. A scenario is cut at the first ｜, else the first |,
    unless nothing stands before it. Null scenarios and roles are empty."""
    whole = _stripped(F.col("scenario"))
    bare = whole
    for mark in reversed(ROLE_SEPARATORS):
        head = _stripped(F.substring_index(whole, mark, 1))
        bare = F.when(whole.contains(mark) & (head != ""), head).otherwise(bare)
    seen = extracted.select("country", "tax_key", bare.alias("scenario"), _stripped(F.col("taxpayer_role")).alias("role"), F.struct("document_id", "batch_no", "row_no").alias("seq"))
    first = seen.groupBy("country", "tax_key", "scenario", "role").agg(F.min("seq").alias("seq"))
    # Spark keeps the first ``cap`` of a list before it shuffles; totals are counts alone.
    w = Window.partitionBy("country", "tax_key").orderBy("seq", "scenario", "role")
    shown = first.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= cap)
    totals = first.groupBy("country", "tax_key").agg(F.count("*").alias("total"))
    return shown.join(totals, ["country", "tax_key"]).select("country", "tax_key", "pos", "scenario", "role", F.greatest(F.col("total") - cap, F.lit(0)).alias("others"))
