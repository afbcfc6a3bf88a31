"""Change reports as text, and backups of matrix rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from lexlake import refdata as R
from lexlake.operators.dashboard import since

# Badges and country names.
BADGES = {"critical": "🔴 CRITICAL", "major": "🟠 MAJOR", "minor": "🟡 MINOR", "cosmetic": "⚪ COSMETIC"}
COUNTRIES = {"TW": "台灣 🇹🇼", "US": "美國 🇺🇸", "CN": "中國 🇨🇳"}


# The wording of reports.
REPORT_TITLE, DISCLAIMER = "稅法異動報告", "> ⚠️ 本報告為 AI 輔助生成之參考資料，非法律意見。"
_ORDER = ["part", "country", "worst", "newest", "change_id"]


def change_report(changes: DataFrame, documents: DataFrame, analyses: DataFrame, as_of: Column, days: int = 7, title: str = REPORT_TITLE) -> DataFrame:
    """S9. The Markdown blocks of the report on the window: part 0 is its head (one
    row, with the number of changes), part 1 has a heading for each country
    (change_id null) and a block for each change, worst first, then newest.
    Sorting by ``part, country, worst, newest, change_id`` (nulls first) gives
    the report; no task holds more than its share of the blocks. analyses may
    lack effective_date, affected_parties (array) and parent_law_impact, changes
    diff_text; nulls and blanks leave their lines out."""
    known = ["change_id", "summary", "confidence", *[c for c in ("effective_date", "affected_parties", "parent_law_impact") if c in analyses.columns]]
    rows = changes.where(F.col("detected_at") >= since(as_of, days)).join(documents.select("document_id", "title", "country"), "document_id", "left")
    rows = rows.join(analyses.select(*known, F.lit(True).alias("analysed")), "change_id", "left")

    def line(column: str, before: str, after: str = "\n", value: Column | None = None) -> Column:
        if column not in rows.columns:
            return F.lit("")
        value = F.col(column) if value is None else value
        return F.when(value != "", F.concat(F.lit(before), value, F.lit(after))).otherwise("")

    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    blank = lambda c: F.coalesce(c, F.lit(""))
    badge = F.coalesce(F.try_element_at(R.mapped(BADGES), F.col("severity")), F.col("severity"))
    head = text("### ", blank(badge), " ", F.coalesce("title", "node_key", F.lit("")), " — ", blank(F.col("node_key")), "\n\n- 異動類型：", blank(F.col("change_type")), "\n- 偵測時間：", F.date_format("detected_at", "yyyy-MM-dd"), "\n")
    parties = F.array_join("affected_parties", ", ") if "affected_parties" in rows.columns else None
    share = F.round(F.coalesce("confidence", F.lit(0.0)) * 100).cast("int").cast("string")
    note = text("\n**摘要**：", blank(F.col("summary")), "\n\n", line("effective_date", "- 生效日："), line("affected_parties", "- 受影響對象：", value=parties), line("parent_law_impact", "\n**母法影響**：", "\n\n"), "- 信心度：", share, "%\n")
    diff = line("diff_text", "\n<details><summary>Diff</summary>\n\n```diff\n", "\n```\n</details>\n\n")
    worst = F.coalesce(-F.try_element_at(R.mapped(R.SEVERITIES), F.col("severity")), F.lit(9))
    blocks = rows.select(
        F.lit(1).alias("part"), F.coalesce("country", F.lit("??")).alias("country"), worst.alias("worst"), (-F.unix_micros("detected_at")).alias("newest"), "change_id",
        text(head, F.when(F.col("analysed"), note).otherwise(""), diff, "---\n").alias("text"),
    )
    none = [F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in ("worst", "newest", "change_id")]
    name = F.coalesce(F.try_element_at(R.mapped(COUNTRIES), F.col("country")), F.col("country"))
    headings = blocks.select("part", "country").distinct().select("part", "country", *none, text("\n## ", name, "\n").alias("text"))
    period = text(f"# {title}\n\n期間：過去 {days} 天 | 產出時間：", F.date_format(as_of, "yyyy-MM-dd HH:mm"), " UTC\n\n共偵測到 **", F.col("n").cast("string"), f"** 筆異動\n\n{DISCLAIMER}\n")
    empty = F.lit(f"# {title}\n\n過去 {days} 天內無偵測到異動。\n")
    top = blocks.agg(F.count("*").alias("n")).select(F.lit(0).alias("part"), F.lit(None).cast("string").alias("country"), *none, F.when(F.col("n") > 0, period).otherwise(empty).alias("text"))
    return top.unionByName(headings).unionByName(blocks)


def write_report(report: DataFrame, path: str) -> None:
    """S9. The blocks as text files that read in order of their names."""
    order = [F.col(c).asc_nulls_first() for c in _ORDER]
    report.repartitionByRange(*order).sortWithinPartitions(*order).select("text").write.mode("overwrite").text(path)


def purge_requirements(requirements: DataFrame, fields: DataFrame, backup: str, country: str | None = None, tax_key: str | None = None, source: str | None = None) -> tuple[DataFrame, DataFrame]:
    """S10. Backs the chosen rows with their fields up as JSON, then gives
    (requirements, fields) without them. ``source`` keeps rows of which any
    field came from there."""
    gone = requirements
    for name, value in (("country", country), ("tax_key", tax_key)):
        gone = gone.where(F.col(name) == value) if value else gone
    if source:
        gone = gone.join(fields.where(F.col("source") == source).select("requirement_id").distinct(), "requirement_id", "left_semi")
    cells = fields.groupBy("requirement_id").agg(F.collect_list(F.struct(*[c for c in fields.columns if c != "requirement_id"])).alias("fields"))
    gone.join(cells, "requirement_id", "left").write.mode("errorifexists").json(backup)
    ids = gone.select("requirement_id")
    return requirements.join(ids, "requirement_id", "left_anti"), fields.join(ids, "requirement_id", "left_anti")


def restore_requirements(spark: SparkSession, backup: str, requirements: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S10. The tables with a backup's rows again; rows that exist stay as they are."""
    inner = StructType([f for f in fields.schema.fields if f.name != "requirement_id"])
    schema = StructType([*requirements.schema.fields, StructField("fields", ArrayType(inner))])
    saved = spark.read.schema(schema).json(backup).join(requirements.select("requirement_id"), "requirement_id", "left_anti")
    cells = saved.select("requirement_id", F.explode("fields").alias("f")).select("requirement_id", "f.*")
    return requirements.unionByName(saved.select(*requirements.columns)), fields.unionByName(cells.select(*fields.columns))
