"""The reference corpus: lookup, search, statistics and evidence for changes.

  corpus  corpus_key, corpus_version, document_number, title, effect_level,
          tax_keys, aging, written_date, url, content
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexlake import refdata as R
from lexlake.functions.docnum import docnum_all, docnum_first, norm_docnum
from lexlake.functions.text import absolute_url, classify_tax, core_title, parse_date, parse_tax_keys
from lexlake.operators import textindex
from lexlake.operators.versions import containing

COLUMNS = "title channel content document_number effect_level tax_type aging labels issuing_department written_date url".split()
SNIPPET = 600


def load_corpus(rows: DataFrame, corpus_key: str, version: str, base_url: str) -> DataFrame:
    """S1. Rows of the landed layout → corpus. Only title is required; other
    columns default to ''. Blank titles go; BOMs are stripped; the document
    number falls back to the one in the title, the tax keys to the title's type."""
    if "title" not in rows.columns:
        raise ValueError(f"the corpus has no title column: {rows.columns}")
    clean = lambda c: F.trim(F.translate(F.coalesce(F.col(c).cast("string"), F.lit("")), "﻿", "")) if c in rows.columns else F.lit("")
    rows = rows.select(*[clean(c).alias(c) for c in COLUMNS]).where("title <> ''")
    # Only titles that can hold a needed number go through Python.
    asked = F.when((F.col("document_number") == "") & F.contains("title", F.lit("号")), F.col("title"))
    number = F.when(F.col("document_number") != "", norm_docnum(F.col("document_number"))).otherwise(F.coalesce(docnum_first(asked), F.lit("")))
    keys, inferred = parse_tax_keys(F.col("tax_type")), classify_tax(F.col("title"), F.lit("CN"))
    none = F.array().cast("array<string>")
    return rows.select(
        F.lit(corpus_key).alias("corpus_key"), F.lit(version).alias("corpus_version"), number.alias("document_number"), "title", "channel", "effect_level",
        F.col("tax_type").alias("tax_type_raw"), F.when(F.size(keys) > 0, keys).when(inferred != "cn_other", F.array(inferred)).otherwise(none).alias("tax_keys"),
        "aging", "labels", "issuing_department", parse_date(F.col("written_date"), "corpus").alias("written_date"), absolute_url(F.col("url"), F.lit(base_url)).alias("url"), "content",
    )


def load_stats(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """S1. One row: read, stored, with_document_number."""
    stored = corpus.agg(F.count("*").alias("stored"), F.count_if(F.col("document_number") != "").alias("with_document_number"))
    return rows.agg(F.count("*").alias("read")).crossJoin(stored)  # one row each


def write_corpus(corpus: DataFrame, path: str, replace: bool = True) -> None:
    """S1. Stored by corpus_key; ``replace`` overwrites only the keys in ``corpus``."""
    writer = corpus.write.partitionBy("corpus_key").mode("overwrite" if replace else "append")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def _one_per_number(corpus: DataFrame) -> DataFrame:
    """Of equal numbers the latest written, then the first title."""
    w = Window.partitionBy("document_number").orderBy(F.desc_nulls_last("written_date"), "title")
    return corpus.where("document_number <> ''").withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def corpus_lookup(keys: DataFrame, corpus: DataFrame) -> DataFrame:
    """E1. keys (query_id, number) with the corpus row of that number, null where
    there is none. Brackets and white space don't matter."""
    k = keys.withColumn("document_number", norm_docnum(F.col("number")))
    return k.join(_one_per_number(corpus), "document_number", "left")


def index_corpus(corpus: DataFrame, path: str) -> None:
    """E2. The stored index of titles and contents that ``corpus_search`` reads."""
    textindex.build_index(corpus.select("title", "content", "document_number", "written_date"), path, ["title", "content"], _BEST_FIRST)


#: Newest first; a column and whether it falls.
_BEST_FIRST = [("written_date", True), ("document_number", False), ("title", False)]


def corpus_search(queries: DataFrame, index: str, limit: int = 10) -> DataFrame:
    """E2. (query_id, rank, title, document_number, in_title) of the corpus at
    ``index`` (see ``index_corpus``): title hits before content hits, newest
    first, at most ``limit`` a query. Queries under two characters and null ones
    find nothing."""
    found = textindex.search(queries.sparkSession, queries, index, "title", _BEST_FIRST, limit, ["title", "content"])
    return found.select("query_id", "title", "document_number", "in_title", "rank")


def tax_key_index(corpus: DataFrame) -> DataFrame:
    """E3. document_number → its first tax key."""
    return _one_per_number(corpus.where(F.size("tax_keys") > 0)).select("document_number", F.element_at("tax_keys", 1).alias("tax_key"))


def is_repealed() -> Column:
    return F.coalesce(F.col("aging").isin(*R.REPEALED), F.lit(False))


def repealed_numbers(corpus: DataFrame) -> DataFrame:
    """E3."""
    return corpus.where(is_repealed() & (F.col("document_number") != "")).select("document_number").distinct()


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """E4. Per corpus: documents, with_number, repealed, latest version."""
    return corpus.groupBy("corpus_key").agg(
        F.count("*").alias("documents"), F.count_if(F.col("document_number") != "").alias("with_number"), F.count_if(is_repealed()).alias("repealed"),
        F.max("corpus_version").alias("version"),
    )


def classify_docs(docs: DataFrame, corpus: DataFrame) -> DataFrame:
    """C12. docs (title, external_id, country) with tax_key: the official label
    by number where it is known, else by title."""
    index = tax_key_index(corpus).withColumnRenamed("tax_key", "official")
    out = docs.withColumn("document_number", norm_docnum(F.col("external_id"))).join(index, "document_number", "left").drop("document_number")
    return out.withColumn("tax_key", F.coalesce("official", classify_tax(F.col("title"), F.col("country")))).drop("official")


_KNOWN_KEYS = [key for key, _, _ in R.TAX_TYPES]


def key_words(tax_keys: list[str]) -> list[str]:
    """V2. The keywords of tax keys, for a source's own search; unknown keys have none."""
    return [w for key, _, words in R.TAX_TYPES if key in tax_keys for w in words]


def filter_refs(refs: DataFrame, tax_keys: list[str] | None, corpus: DataFrame, sources: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """V2. (kept refs with tax_key, counts per source: found, kept, filtered).

    ``tax_keys`` override the sources' own (sources: source_key, tax_keys array).
    Unknown keys don't count; a source without any known key keeps all its refs."""
    typed = classify_docs(refs, corpus)
    given = [k for k in tax_keys or [] if k in _KNOWN_KEYS]
    if tax_keys or sources is None:
        wanted = F.col("tax_key").isin(*given) if given else F.lit(True)
    else:
        known = F.filter("tax_keys", lambda k: k.isin(*_KNOWN_KEYS))
        typed = typed.join(sources.select("source_key", known.alias("__wanted")), "source_key", "left")
        wanted = (F.coalesce(F.size("__wanted"), F.lit(0)) <= 0) | F.array_contains("__wanted", F.col("tax_key"))
    marked = typed.withColumn("__kept", F.coalesce(wanted, F.lit(True)))
    counts = marked.groupBy("source_key").agg(F.count("*").alias("found"), F.count_if("__kept").alias("kept"), F.count_if(~F.col("__kept")).alias("filtered"))
    return marked.where("__kept").select(*refs.columns, "tax_key"), counts


def change_evidence(changes: DataFrame, corpus: DataFrame, document_evidence: DataFrame | None = None) -> DataFrame:
    """E5. (change_id, rank, origin, title, snippet, url, document_number, repealed,
    written_date, aging, corpus_version):
    the numbers that the new text cites, then those in the node key, each once
    and in order, where the corpus has them. A change without any falls back to
    its document's evidence (document_id, rank, origin, title, snippet, url)."""
    numbers = F.array_distinct(F.concat(docnum_all("new_text"), docnum_all("node_key")))
    cited = changes.select("change_id", F.posexplode(numbers).alias("pos", "document_number"))
    rows = cited.join(_one_per_number(corpus), "document_number")
    w = Window.partitionBy("change_id").orderBy("pos")
    out = rows.select(
        "change_id", F.row_number().over(w).alias("rank"), F.lit("corpus").alias("origin"), "title", F.substring("content", 1, SNIPPET).alias("snippet"), "url",
        "document_number", is_repealed().alias("repealed"), F.date_format("written_date", "yyyy-MM-dd").alias("written_date"), "aging", "corpus_version",
    )
    if document_evidence is None:
        return out
    bare = changes.select("change_id", "document_id").join(out.select("change_id").distinct(), "change_id", "left_anti")
    more = bare.join(document_evidence, "document_id")
    return out.unionByName(more.select("change_id", "rank", "origin", "title", "snippet", "url", F.lit(False).alias("repealed")), allowMissingColumns=True)


def official_evidence(documents: DataFrame, library: DataFrame, n: int = 3, days: int = 90) -> DataFrame:
    """E6. (document_id, rank, title, document_number): library entries of the
    document's number; else those whose title holds the core title and that
    were published within ``days`` of it; the newest n. Core titles meet the
    titles of a month that hold their rarest piece in it, so no two meet that
    share the month alone. Documents without a date or a core title have only
    what their number finds.

    Documents of one number, or of one core title and day, have the same answer, so
    it is found once for them all; and of the entries of one title and day none but
    the newest n can be in it."""
    order = [F.desc("pub_date"), F.col("lib_title"), F.col("number")]
    newest = lambda df, *by: df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("r") <= n).drop("r")
    lib = library.select(F.col("title").alias("lib_title"), norm_docnum(F.col("document_number")).alias("number"), "pub_date")
    docs = documents.select("document_id", norm_docnum(F.col("external_id")).alias("number"), core_title(F.col("title")).alias("core"), "issued_at")
    numbered = docs.where("number <> ''").join(newest(lib.where("number <> ''"), "number"), "number").select("document_id", "lib_title", "number", "pub_date")
    left = docs.join(numbered.select("document_id").distinct(), "document_id", "left_anti").where("issued_at is not null and core <> ''")
    month = lambda c: F.year(c) * 12 + F.month(c)
    reach = days // 28 + 1
    left = left.select("document_id", "core", F.to_date("issued_at").alias("day"))
    asked = left.select("core", "day").distinct().withColumn("m", F.explode(F.sequence(month("day") - reach, month("day") + reach)))
    dated = newest(lib.where("pub_date is not null").withColumn("pub_day", F.to_date("pub_date")), "lib_title", "pub_day").withColumn("m", month("pub_day"))
    held = containing(asked.select("m", F.col("core").alias("query")).distinct(), dated.select("m", F.col("lib_title").alias("text")).distinct(), ["m"])
    near = asked.join(held.withColumnsRenamed({"query": "core", "text": "lib_title"}), ["m", "core"]).join(dated, ["m", "lib_title"]).where(F.abs(F.datediff("day", "pub_day")) <= days)
    near = left.join(newest(near, "core", "day"), ["core", "day"])
    both = numbered.union(near.select("document_id", "lib_title", "number", "pub_date"))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("document_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= n).select("document_id", "rank", F.col("lib_title").alias("title"), F.col("number").alias("document_number"))


def plan_queries(changes: DataFrame, documents: DataFrame, cache: DataFrame, floor: str, ttl_days: int, cap: int, as_of: Column) -> DataFrame:
    """E7. One query for each document with a change of at least ``floor`` (never
    cosmetic), but for those cached within the TTL; the worst first, ``cap`` at
    most (the run's budget). (document_id, query, query_hash, severity_rank)"""
    rank = F.element_at(R.mapped(R.SEVERITIES), F.col("severity"))
    worst = changes.groupBy("document_id").agg(F.max(rank).alias("severity_rank")).where(F.col("severity_rank") >= max(1, R.SEVERITIES[floor]))
    planned = worst.join(documents.select("document_id", F.col("title").alias("query")), "document_id").withColumn("query_hash", F.sha2("query", 256))
    fresh = cache.where(F.col("fetched_at") >= as_of - F.make_dt_interval(F.lit(ttl_days))).select("query_hash").distinct()
    return planned.join(fresh, "query_hash", "left_anti").orderBy(F.desc("severity_rank"), "document_id").limit(cap)


def evaluate_classifier(corpus: DataFrame) -> DataFrame:
    """E8. Per official key: documents, hits of the title classifier, accuracy,
    and how many titles or numbers carry a document number."""
    rows = corpus.where(F.size("tax_keys") > 0).withColumn("official", F.element_at("tax_keys", 1))
    guess = classify_tax(F.col("title"), F.lit("CN"))
    hit = guess == F.col("official")
    return rows.groupBy("official").agg(
        F.count("*").alias("documents"), F.count_if(hit).alias("hits"), F.round(F.avg(hit.cast("double")), 6).alias("accuracy"),
        F.count_if(F.col("document_number") != "").alias("with_number"),
    )


def confusion(corpus: DataFrame) -> DataFrame:
    """E8. official × guessed counts."""
    rows = corpus.where(F.size("tax_keys") > 0)
    return rows.groupBy(F.element_at("tax_keys", 1).alias("official"), classify_tax(F.col("title"), F.lit("CN")).alias("guessed")).agg(F.count("*").alias("n"))


def citation_coverage(corpus: DataFrame) -> DataFrame:
    """E9. One row: distinct (document, number) citations in contents, and how
    many of them the corpus itself resolves."""
    cited = corpus.select(F.explode(docnum_all("content")).alias("document_number"))
    have = corpus.where("document_number <> ''").select("document_number", F.lit(1).alias("known")).distinct()
    found = cited.groupBy("document_number").agg(F.count("*").alias("n")).join(have, "document_number", "left")
    total, known = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("known") == 1, F.col("n"))), F.lit(0))
    return found.agg(total.alias("citations"), known.alias("resolved"), F.round(F.try_divide(known, total), 6).alias("share"))


# The wording of rendered evidence, by origin: heading, closing note.
NO_EVIDENCE = "## 外部佐證\n\n（查無外部資料，請僅依條文原文分析，並據此下修 confidence）"
EVIDENCE_PARTS = {
    "corpus": ("## 法規原文（本地法規庫，可視為權威原文）", ""),
    "official": (
        "## 官方法規庫檢索結果（国家税务总局，官方來源）",
        "ℹ️ 以上為官方法規庫的檢索結果：標題、文號與時效性為官方資料，可據以引用；但此處僅有摘要而非全文，若需引用具體條文內容，請於 citations 標註連結並說明未取得全文。\n\n",
    ),
    "search": ("## 網路搜尋結果（第三方摘要，非官方原文）", "⚠️ 以上為搜尋引擎結果，非官方原文。僅在與條文原文一致時採用；若與原文衝突，以原文為準並在分析中指出矛盾。"),
}
REPEALED_NOTE = "⚠️ 上列標記為廢止／失效的法規不得作為現行有效依據引用；若本次異動仍援引該法規，請在 risk_assessment 中指出。\n\n"


def render_evidence(evidence: DataFrame) -> DataFrame:
    """E10. change_id, text: the entries by origin (corpus, official, search), each
    numbered in rank order with number, date, status, snippet and address where
    it has them; a part with repealed entries warns of them. An entry without
    title or any other column counts as blank there."""
    has = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in evidence.columns else F.lit("") for c in ("title", "document_number", "written_date", "aging", "corpus_version", "snippet", "url")}
    repealed = F.coalesce(F.col("repealed"), F.lit(False)) if "repealed" in evidence.columns else F.lit(False)
    searched, local = F.col("origin") == "search", F.col("origin") == "corpus"

    def line(label: Column | str, value: Column, shown: Column | None = None) -> Column:
        label = F.lit(label) if isinstance(label, str) else label
        return F.when((value != "") if shown is None else shown, F.concat(F.lit("   "), label, F.lit("："), value, F.lit("\n"))).otherwise("")

    date, stamp = line("成文日期", has["written_date"]), F.when(local & (has["corpus_version"] != ""), F.concat(F.lit("（截至 "), has["corpus_version"], F.lit("）"))).otherwise("")
    aging = F.when(has["aging"] != "", F.concat(F.when(repealed, "⛔ ").otherwise(""), has["aging"], stamp)).otherwise("")
    snippet = line(F.when(local, "原文節錄").otherwise("摘要"), has["snippet"])
    details = F.when(searched, F.concat(snippet, line("時間", has["written_date"]), line("來源", has["url"], F.lit(True))))
    details = details.otherwise(F.concat(line("文號", has["document_number"]), date, line("時效性", aging), snippet, line("來源", has["url"])))
    body = F.concat(F.lit(". **"), has["title"], F.lit("**\n"), details, F.lit("\n"))
    entries = F.sort_array(F.collect_list(F.struct("rank", body.alias("body"))))
    numbered = F.array_join(F.transform(entries, lambda e, i: F.concat((i + 1).cast("string"), e["body"])), "")
    parts = evidence.groupBy("change_id", "origin").agg(numbered.alias("entries"), F.bool_or(repealed).alias("warn"))
    of = lambda i: F.element_at(F.create_map(*[F.lit(x) for origin, v in EVIDENCE_PARTS.items() for x in (origin, v[i])]), F.col("origin"))
    warning = F.when(F.col("warn") & (F.col("origin") != "search"), REPEALED_NOTE).otherwise("")
    text = F.concat(of(0), F.lit("\n\n"), F.col("entries"), of(1), warning)
    place = F.array_position(F.lit(list(EVIDENCE_PARTS)), F.col("origin"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place.alias("place"), text.alias("text")))), lambda p: p["text"]), "")
    return parts.groupBy("change_id").agg(F.regexp_replace(whole, r"(?U)\s+$", "").alias("text"))


def search_evidence(results: DataFrame) -> DataFrame:
    """E11. Landed search results (document_id, pos, title, description, url)
    without tags; rows without an address go; the first of each (document, url)."""
    bare = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "<[^>]+>", ""))
    w = Window.partitionBy("document_id", "url").orderBy("pos")
    rows = results.where(F.coalesce(F.col("url"), F.lit("")) != "").withColumn("r", F.row_number().over(w)).where("r = 1")
    return rows.select("document_id", "pos", F.lit("search").alias("origin"), bare("title").alias("title"), bare("description").alias("snippet"), "url")
