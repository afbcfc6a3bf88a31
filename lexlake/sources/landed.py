"""Landed files → refs, raw documents and sheet rows.

  refs  source_key, external_id, title, doc_type, url, issued_at, metadata
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.functions.docnum import docnum_first
from lexlake.functions.markup import parse
from lexlake.functions.text import doc_type, parse_date, pcode, to_https, url_doc_id
from lexlake.shared import shared_dir

_LAW = "struct<LawLevel:string,LawName:string,LawURL:string,LawModifiedDate:string,LawAbandonNote:string,LawHistories:string,LawArticles:array<struct<ArticleType:string,ArticleNo:string,ArticleContent:string>>>"
#: Characters of an archive's member that are read at a time; laws of a batch that is sent.
_PIECE, _SEND = 1 << 16, 200


def _laws_in(member: io.BufferedIOBase) -> Iterator[str]:
    """The objects of the ``Laws`` array of a JSON text, one by one: no more than
    one of them and a piece of the text is held."""
    text, decoder, held, within = io.TextIOWrapper(member, "utf-8-sig"), json.JSONDecoder(), "", False
    while True:
        piece = text.read(_PIECE)
        held += piece
        if not within:
            start = re.search(r'"Laws"\s*:\s*\[', held)
            if start is None:
                if not piece:
                    return
                continue
            held, within = held[start.end() :], True
        while True:
            held = held.lstrip(" \t\r\n,")
            if held.startswith("]"):
                return
            try:
                _, end = decoder.raw_decode(held)
            except json.JSONDecodeError:
                break  # the rest of this law is still to be read
            yield held[:end]
            held = held[end:]
        if not piece:
            if held:
                raise ValueError(f"the batch ends within a law: {held[:80]}")
            return


def archived_laws(files: DataFrame) -> DataFrame:
    """S2. (path, law): the laws of landed batches, each as JSON. files: path,
    content: zip archives, whose JSON members are read one after another, or
    plain JSON; a BOM doesn't matter. Unpacked texts are streamed. Empty and null
    contents hold no law."""

    def members(content: bytes) -> Iterator[io.BufferedIOBase]:
        if content[:2] != b"PK":
            yield io.BytesIO(content)
            return
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name in z.namelist():
                if name.lower().endswith(".json"):
                    with z.open(name) as member:
                        yield member

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                for member in members(content or b""):
                    for law in _laws_in(member):
                        out.append((path, law))
                        if len(out) == _SEND:
                            yield pd.DataFrame(out, columns=["path", "law"])
                            out = []
            yield pd.DataFrame(out, columns=["path", "law"])

    return files.select("path", "content").mapInPandas(run, "path string, law string")


def _law_refs(laws: DataFrame, pcodes: DataFrame, source_key: str) -> DataFrame:
    law = laws.withColumn("external_id", pcode(F.col("law.LawURL")))
    return law.join(pcodes, "external_id", "left_semi").select(
        F.lit(source_key).alias("source_key"), "external_id", F.col("law.LawName").alias("title"), F.lit("statute").alias("doc_type"), F.col("law.LawURL").alias("url"),
        parse_date(F.col("law.LawModifiedDate"), "ymd").alias("issued_at"), (F.trim(F.coalesce("law.LawAbandonNote", F.lit(""))) != "").alias("abandoned"), F.to_json("law").alias("payload"),
    )


def tw_law_refs(texts: DataFrame, pcodes: DataFrame, source_key: str = "tw_moj_law") -> DataFrame:
    """S2. Batch JSON (text) → one ref a configured law (pcodes: external_id), its
    payload and flag."""
    laws = texts.select(F.explode(F.from_json("text", f"struct<Laws:array<{_LAW}>>")["Laws"]).alias("law"))
    return _law_refs(laws, pcodes, source_key)


def archived_law_refs(files: DataFrame, pcodes: DataFrame, source_key: str = "tw_moj_law") -> DataFrame:
    """S2. The same out of landed archives (``archived_laws``)."""
    return _law_refs(archived_laws(files).select(F.from_json("law", _LAW).alias("law")), pcodes, source_key)


def _first_of_both(rows: DataFrame, a: str, b: str) -> DataFrame:
    """The rows that, by seq, have neither value of a row kept before them.

    In a round the rows that come first for both their values are kept and all
    that share a value with them go; so no order needs one task."""
    shared_dir(rows.sparkSession)
    left = rows.withColumn("__at", F.struct("seq", a, b)).dropDuplicates(["__at"]).checkpoint(eager=True)
    kept = []
    while True:
        first = lambda c: left.groupBy(c).agg(F.min("__at").alias(f"__{c}"))  # noqa: B023, E731
        now = left.join(first(a), a).join(first(b), b).where(F.col("__at").eqNullSafe(F.col(f"__{a}")) & F.col("__at").eqNullSafe(F.col(f"__{b}")))
        now = now.select(*left.columns).checkpoint(eager=True)
        if now.isEmpty():
            return reduce(DataFrame.union, kept or [now]).drop("__at")
        kept.append(now)
        left = left.join(now.select(a), a, "left_anti").join(now.select(b), b, "left_anti").select(*left.columns).checkpoint(eager=True)


def policy_refs(entries: DataFrame, since: Column | None = None, keywords: list[str] | None = None, source_key: str = "cn_chinatax") -> DataFrame:
    """S3. Result entries (seq, title, url, pubDate, label, indexno) → refs. Blank
    titles and addresses go; the id is the title's number, else the index
    number, else the address's id, else the title's first 80 characters. By seq, a
    row counts unless one that counts has its address or id already."""
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    rows = entries.select("seq", blank("title").alias("title"), to_https(blank("url")).alias("url"), parse_date(F.col("pubDate"), "api").alias("issued_at"), F.coalesce("label", F.lit("")).alias("label"), "indexno")
    rows = rows.where("title is not null and url is not null")
    rows = rows.where(F.col("issued_at").isNull() | (F.col("issued_at") >= since)) if since is not None else rows
    rows = rows.where(F.col("title").rlike("|".join(map(re.escape, keywords)))) if keywords else rows
    key = F.coalesce(docnum_first(F.col("title")), blank("indexno"), url_doc_id(F.col("url")), F.substring("title", 1, 80))
    rows = _first_of_both(rows.withColumn("external_id", key), "url", "external_id")
    return rows.select(F.lit(source_key).alias("source_key"), "external_id", "title", doc_type(F.col("title"), F.col("label")).alias("doc_type"), "url", "issued_at")


def ecfr_part_refs(versions: DataFrame, parts: list[str], since: Column | None = None) -> DataFrame:
    """S4. Section versions (date, identifier, name, part, substantive) → one ref
    a configured part, of its latest substantive amendment."""
    rows = versions.where(F.coalesce("substantive", F.lit(True))).where(F.col("part").isin(*parts)).withColumn("amended", F.try_to_timestamp("date", F.lit("yyyy-M-d")))
    rows = rows.where(F.col("amended").isNull() | (F.col("amended") >= since)) if since is not None else rows
    best = F.max_by(F.struct("amended", "identifier"), F.struct(F.coalesce("amended", F.lit("0001-01-01").cast("timestamp")), "identifier")).alias("v")
    return rows.groupBy("part").agg(best).select(
        F.concat(F.lit("26-CFR-"), "part").alias("external_id"), F.concat(F.lit("26 CFR Part "), "part").alias("title"), F.lit("regulation").alias("doc_type"),
        F.col("v.amended").alias("issued_at"), F.col("v.identifier").alias("latest_section"),
    )


def fr_refs(results: DataFrame) -> DataFrame:
    """S5. Register results (document_number, title, type, html_url, publication_date) → refs."""
    kind = F.when(F.col("type").isin("Rule", "Proposed Rule"), "regulation").when(F.col("type") == "Presidential Document", "statute").otherwise("announcement")
    return results.select(F.col("document_number").alias("external_id"), "title", kind.alias("doc_type"), F.col("html_url").alias("url"), F.try_to_timestamp("publication_date", F.lit("yyyy-M-d")).alias("issued_at"))


def listing_refs(pages: DataFrame, kind: str, base_url: str, keywords: list[str] | None = None) -> DataFrame:
    """S6. Listing pages (page_id, html) → refs. ruling: table rows of three cells
    at least, date in the first; interpretation: rows with a numbered link; mof:
    links of four characters at least, with a date beside them."""

    def rows(html: str) -> Iterator[tuple]:
        page = parse(html)
        boxes = page.select("a" if kind == "mof" else "tr" if kind == "ruling" else ".interpretation-item, .search-result, tr")
        for box in boxes:
            cells = list(box.select("td"))
            link = box if kind == "mof" else next((a for a in box.select("a") if a.attrs.get("href")), None)
            if link is None or not link.attrs.get("href") or (kind == "ruling" and len(cells) < 3):
                continue
            title, href = link.text(), link.attrs["href"]
            near, up = "", box.parent if kind == "mof" else None
            while up is not None and up.tag not in ("li", "tr", "div"):
                up = up.parent
            near = up.text(" ") if up is not None else cells[0].text() if kind == "ruling" else ""
            if kind == "mof" and (len(title) < 4 or (keywords and not any(k in title for k in keywords))):
                continue
            yield title, href if href.startswith("http") else f"{base_url.rstrip('/')}/{href.lstrip('/')}", near

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = [(p, i, *r) for p, html in zip(pdf["page_id"], pdf["html"]) for i, r in enumerate(rows(html or ""))]
            yield pd.DataFrame(out, columns=["page_id", "seq", "title", "url", "near"])

    found = pages.select("page_id", "html").mapInPandas(run, "page_id long, seq int, title string, url string, near string")
    number = F.regexp_extract("title", r"(釋字第\s*\d+\s*號|憲判字第\s*\d+\s*號)", 1)
    query_id = F.regexp_extract("url", r"[?&]id=([^&]+)", 1)
    blank = lambda c: F.when(c != "", c)
    key = {
        "ruling": F.coalesce(blank(query_id), F.substring("title", 1, 50)),
        "interpretation": F.coalesce(blank(number), F.substring("title", 1, 50)),
        "mof": F.coalesce(docnum_first(F.col("title")), url_doc_id(F.col("url")), F.substring("title", 1, 80)),
    }[kind]
    part = lambda i: F.regexp_extract("near", r"(\d{2,4})[-./年](\d{1,2})[-./月](\d{1,2})", i)
    year = part(1).try_cast("int") + F.when(part(1).try_cast("int") < 200, 1911).otherwise(0)
    date = F.try_to_timestamp(F.format_string("%d-%s-%s", year, part(2), part(3)), F.lit("y-M-d"))
    types = {"ruling": F.lit("ruling"), "interpretation": F.lit("interpretation"), "mof": doc_type(F.col("title"), F.lit(""))}
    return found.select("page_id", "seq", key.alias("external_id"), "title", types[kind].alias("doc_type"), "url", date.alias("issued_at"))


def read_raw(spark: SparkSession, path: str, source_key: str, connector: str) -> DataFrame:
    """S7. Landed files as raw documents; the id is the file name's stem, the
    volume id of bulk XML its name's. Empty files (gone) are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(name.endswith(".json"), "application/json").when(name.endswith(".xml"), "application/xml").otherwise("text/html")
    volume = F.regexp_extract(name, r"(CFR-\d{4}-title\d+-vol\d+)", 1)
    return files.select(
        F.lit(source_key).alias("source_key"), F.coalesce(F.when(volume != "", volume), F.regexp_replace(name, r"\.[^.]+$", "")).alias("external_id"), F.lit(connector).alias("connector"),
        "content", kind.alias("content_type"), F.col("path").alias("url"), F.create_map().cast("map<string,string>").alias("metadata"),
    )


def markdown_cells(lines: DataFrame) -> DataFrame:
    """S8. Lines (row_no, value) of Markdown tables → (row_no, cells); delimiter
    and empty rows go, <br> becomes a line feed, ** goes."""
    line = F.trim("value")
    rows = lines.where(line.startswith("|") & line.endswith("|") & (F.length(line) > 1))
    raw = F.split(F.substring(line, F.lit(2), F.length(line) - 2), r"\|")
    cells = F.transform(raw, lambda c: F.trim(F.replace(F.regexp_replace(F.trim(c), r"(?i)<\s*br\s*/?\s*>", "\n"), F.lit("**"), F.lit(""))))
    rows = rows.select("row_no", cells.alias("cells"), F.regexp_replace(F.array_join(raw, ""), r"[-:\s]", "").alias("rest"))
    return rows.where("rest <> ''").drop("rest")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """S8. (path, row_no, cells): CSV, or Markdown tables by the file's name. The
    row number orders the rows of a file; row 0 of each is the header."""
    if path.endswith((".md", ".markdown")):
        text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("row_no", "value"))
        rows = text.groupBy("path", "row_no").agg(F.first("value").alias("value"))
        return markdown_cells(rows).withColumn("path", F.lit(path))
    rows = spark.read.option("multiLine", "true").option("header", "false").option("escape", '"').csv(path)
    cells = F.transform(F.array(*[F.col(c) for c in rows.columns]), lambda c: F.trim(F.coalesce(c, F.lit(""))))
    out = rows.select(F.monotonically_increasing_id().alias("row_no"), cells.alias("cells")).where(F.exists("cells", lambda c: c != ""))
    return out.withColumn("path", F.lit(path))
