"""Rollups and feeds. documents carry source_key, country and tax_key; times are
compared with an explicit ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexlake.operators.corpus import NO_EVIDENCE, render_evidence
from lexlake.operators.graph import document_forest, entity_context
from lexlake.operators.matrix import affected_cells
from lexlake.operators.versions import change_texts, dated_at
from lexlake.functions.text import norm_key


def since(as_of: Column, days: int) -> Column:
    return as_of - F.make_dt_interval(F.lit(days))


def tax_type_rollup(documents: DataFrame, snapshots: DataFrame, changes: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """D1. Per (country, tax_key): documents, versions, recent changes, critical
    ones (critical or major), the latest dated version, full days since, status
    (critical, changed, stable); most changes first, then by key. Versions and
    changes are counted per document first, then joined."""
    seen = snapshots.groupBy("document_id").agg(F.count("*").alias("versions"), F.max(dated_at()).alias("latest"))
    severe = F.count_if(F.col("severity").isin("critical", "major"))
    recent = changes.where(F.col("detected_at") >= since(as_of, days)).groupBy("document_id").agg(F.count("*").alias("recent"), severe.alias("critical"))
    rows = documents.select("document_id", "country", "tax_key").join(seen, "document_id", "left").join(recent, "document_id", "left")
    out = rows.groupBy("country", "tax_key").agg(
        F.count("*").alias("documents"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("versions", "recent", "critical")], F.max("latest").alias("latest")
    )
    age = F.floor((as_of.cast("double") - F.col("latest").cast("double")) / 86_400).cast("int")
    status = F.when(F.col("critical") > 0, "critical").when(F.col("recent") > 0, "changed").otherwise("stable")
    return out.withColumns({"days_since": age, "status": status}).orderBy(F.desc("recent"), "tax_key", "country")


def tax_type_summary(tax_key: str, documents: DataFrame, snapshots: DataFrame, provisions: DataFrame, changes: DataFrame, analyses: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """D2. Per document of the tax type: provisions of its latest version, changes
    in the window, analysed ones and their mean confidence."""
    docs = documents.where(F.col("tax_key") == tax_key).select("document_id", "title")
    latest = snapshots.groupBy("document_id").agg(F.max(F.struct(dated_at().alias("d"), "snapshot_id")).alias("v")).select("document_id", "v.snapshot_id")
    counted = latest.join(provisions.groupBy("snapshot_id").agg(F.count("*").alias("n_provisions")), "snapshot_id").select("document_id", "n_provisions")
    recent = changes.where(F.col("detected_at") >= since(as_of, days)).select("change_id", "document_id").join(analyses.select("change_id", "confidence"), "change_id", "left")
    recent = recent.groupBy("document_id").agg(F.count("*").alias("n_changes"), F.count("confidence").alias("n_analysed"), F.round(F.avg("confidence"), 6).alias("confidence"))
    return docs.join(counted, "document_id", "left").join(recent, "document_id", "left").na.fill(0, ["n_provisions", "n_changes", "n_analysed"])


def tax_type_versions(tax_key: str, documents: DataFrame, snapshots: DataFrame) -> DataFrame:
    """D2. Per document of the tax type: versions, the first and the last date,
    and whether the authority dated the last."""
    docs = documents.where(F.col("tax_key") == tax_key).select("document_id", "title", "source_key")
    dated = F.struct(dated_at().alias("d"), F.col("issued_at").isNotNull().alias("official"))
    seen = snapshots.groupBy("document_id").agg(F.count("*").alias("versions"), F.min(dated_at()).alias("first_seen"), F.max_by(dated, F.struct(dated_at(), F.col("snapshot_id"))).alias("v"))
    seen = seen.select("document_id", "versions", "first_seen", F.col("v.d").alias("last_updated"), F.col("v.official").alias("official_date"))
    return docs.join(seen, "document_id", "left").na.fill(0, ["versions"]).na.fill(False, ["official_date"])


def tax_type_changes(tax_key: str, documents: DataFrame, snapshots: DataFrame, changes: DataFrame, analyses: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """D2. The changes in the window of the tax type's documents with their
    analysis and the date of the version they produced; the newest first, by
    that date, else by detection."""
    docs = documents.where(F.col("tax_key") == tax_key).select("document_id", "title")
    dated = snapshots.select(F.col("snapshot_id").alias("to_snapshot_id"), dated_at().alias("dated_at"), F.col("issued_at").isNotNull().alias("official_date"))
    rows = changes.where(F.col("detected_at") >= since(as_of, days)).join(docs, "document_id").join(dated, "to_snapshot_id", "left")
    rows = rows.join(analyses.select("change_id", F.coalesce("summary", F.lit("")).alias("summary"), "confidence"), "change_id", "left").na.fill("", ["summary"]).na.fill(False, ["official_date"])
    return rows.orderBy(F.desc(F.coalesce("dated_at", "detected_at")), "change_id")


def tax_type_tree(tax_key: str, documents: DataFrame) -> DataFrame:
    """D2. The tax type's documents nested (G12)."""
    return document_forest(documents.where(F.col("tax_key") == tax_key))


def dashboard_stats(documents: DataFrame, snapshots: DataFrame, sources: DataFrame, changes: DataFrame, analyses: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """D3. One row of headline figures: tax types, documents, snapshots, enabled
    sources, and of the changes in the window their number, those without an
    analysis and the mean confidence."""
    docs = documents.agg(F.count("*").alias("documents"), F.countDistinct("tax_key").alias("tax_types"))
    enabled = sources.where("enabled") if "enabled" in sources.columns else sources
    marked = changes.where(F.col("detected_at") >= since(as_of, days)).select("change_id").join(analyses.select("change_id", "confidence", F.lit(True).alias("analysed")), "change_id", "left")
    rows = marked.agg(F.countDistinct("change_id").alias("recent"), F.count_if(F.col("analysed").isNull()).alias("unanalysed"), F.round(F.avg("confidence"), 3).alias("confidence"))
    counted = snapshots.agg(F.count("*").alias("snapshots")).crossJoin(enabled.agg(F.count("*").alias("sources")))
    return docs.crossJoin(counted).crossJoin(rows)  # one row each


def list_changes(changes: DataFrame, documents: DataFrame, snapshots: DataFrame, as_of: Column, days: int, country: str | None = None, tax_key: str | None = None, severity: str | None = None, limit: int | None = None) -> DataFrame:
    """D4. Changes detected in the window with their document, newest dated
    version first; the limit comes after all filters (a top-k, no total sort)."""
    rows = changes.where(F.col("detected_at") >= since(as_of, days))
    rows = rows.where(F.col("severity") == severity) if severity else rows
    for name, value in (("country", country), ("tax_key", tax_key)):
        documents = documents.where(F.col(name) == value) if value else documents
    dated = snapshots.select(F.col("snapshot_id").alias("to_snapshot_id"), dated_at().alias("dated_at"), F.col("issued_at").isNotNull().alias("official"))
    rows = rows.join(documents.select("document_id", "title", "country", "tax_key"), "document_id").join(dated, "to_snapshot_id", "left")
    rows = rows.orderBy(F.desc_nulls_last("dated_at"), F.desc("detected_at"), "change_id")
    return rows.limit(limit) if limit else rows


def change_feed(changes: DataFrame, fields: DataFrame, requirements: DataFrame) -> DataFrame:
    """D4. change rows with the number of matrix cells that they affect."""
    keyed = changes.withColumn("key", norm_key(F.col("node_key")))
    cells = affected_cells(changes.select("node_key"), fields, requirements).groupBy("key").agg(F.count("*").alias("affected"))
    return keyed.join(cells, "key", "left").na.fill(0, ["affected"]).drop("key")


def change_detail(changes: DataFrame, documents: DataFrame, provisions: DataFrame, analyses: DataFrame, fields: DataFrame, requirements: DataFrame) -> DataFrame:
    """D5. D4's row with texts, analysis and affected cells."""
    rows = change_texts(change_feed(changes, fields, requirements), provisions)
    return rows.join(documents.select("document_id", "title"), "document_id", "left").join(analyses.select("change_id", "summary", "confidence"), "change_id", "left")


def list_runs(runs: DataFrame, n: int) -> DataFrame:
    """D6. The latest n runs with their duration in seconds."""
    took = F.col("finished_at").cast("double") - F.col("started_at").cast("double")
    return runs.withColumn("seconds", F.round(took, 3)).orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)


def run_health(runs: DataFrame, n: int = 100) -> DataFrame:
    """D6. One row over the latest n runs: total, success_rate (completed ones, to
    three places; null without runs), failed, running."""
    of = lambda status: F.count_if(F.col("status") == status)
    rate = F.round(F.try_divide(of("completed"), F.count("*")), 3)
    return list_runs(runs, n).agg(F.count("*").alias("total"), rate.alias("success_rate"), of("failed").alias("failed"), of("running").alias("running"))


def analysis_inputs(changes: DataFrame, documents: DataFrame, provisions: DataFrame, relations: DataFrame, evidence: DataFrame) -> DataFrame:
    """D7. Per change: title, texts, diff, context lists by role, evidence text."""
    rows = change_texts(changes, provisions).join(documents.select("document_id", "title"), "document_id", "left")
    roles = ("parent_law", "child", "sibling")
    context = entity_context(changes.select(F.col("node_key").alias("entity_key")), relations, roles)
    of = lambda role: F.sort_array(F.collect_list(F.when(F.col("role") == role, F.col("other"))))  # noqa: E731  # each once
    lists = context.groupBy("entity_key").agg(*[of(r).alias(r) for r in roles]).withColumns({r: F.when(F.size(r) > 0, F.col(r)) for r in roles})
    rows = rows.withColumn("entity_key", norm_key(F.col("node_key"))).join(lists, "entity_key", "left")
    rows = rows.join(render_evidence(evidence).withColumnRenamed("text", "evidence"), "change_id", "left")
    return rows.withColumn("evidence", F.coalesce("evidence", F.lit(NO_EVIDENCE)))


def run_stats(discovered: DataFrame, documents: DataFrame, snapshots: DataFrame, changes: DataFrame, flagged: DataFrame, started: Column) -> DataFrame:
    """D8. Per source of a run that began at ``started``: found (refs kept),
    filtered (refs left out), new snapshots, unchanged documents (fetched, but
    without a new one), changes and flagged cells. discovered: source_key, kept,
    filtered (V2's counts); flagged: change_id of each flagged cell."""
    new = snapshots.where(F.col("fetched_at") >= started).groupBy("document_id").agg(F.count("*").alias("new"))
    cells = flagged.groupBy("change_id").agg(F.count("*").alias("flagged"))
    moved = changes.where(F.col("detected_at") >= started).select("document_id", "change_id").join(cells, "change_id", "left")
    moved = moved.groupBy("document_id").agg(F.count("*").alias("changes"), F.coalesce(F.sum("flagged"), F.lit(0)).alias("flagged"))
    rows = documents.select("document_id", "source_key").join(new, "document_id", "left").join(moved, "document_id", "left").na.fill(0, ["new", "changes", "flagged"])
    per = rows.groupBy("source_key").agg(F.sum("new").alias("new"), F.count_if(F.col("new") == 0).alias("unchanged"), F.sum("changes").alias("changes"), F.sum("flagged").alias("flagged"))
    out = discovered.select("source_key", F.col("kept").alias("found"), "filtered").join(per, "source_key", "left")
    return out.na.fill(0, ["new", "unchanged", "changes", "flagged"])


def latest_per_document(changes: DataFrame) -> DataFrame:
    """The newest change of each document, for feeds that show one line each."""
    w = Window.partitionBy("document_id").orderBy(F.desc("detected_at"), F.desc("change_id"))
    return changes.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
