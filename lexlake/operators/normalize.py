"""Landed raw documents → provisions.

  raw         source_key, external_id, connector, content BINARY, content_type,
              url, metadata MAP<STRING,STRING>
  provisions  source_key, external_id, title, ordinal, node_key, heading, text
One parser a connector; each reads single documents in Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.functions.markup import parse
from lexlake.functions.text import normalize_text
from lexlake.shared import short_batches
from lexlake.refdata import CN_DIGITS, CN_UNITS

SCHEMA = "source_key string, external_id string, title string, ordinal int, node_key string, heading string, text string"
Provision = tuple[str, str, str]  # node_key, heading, text

# Page furniture of policy-library pages.
_CHROME = (
    ".tools, .toolbar, .share, .download, .subscribe, .btn-group, .action-bar, .article-tools, .sidebar, .aside, .nav, .breadcrumb, .menu, .font-size, "
    ".fontsize, .related, .relation, .associated, .footer, .copyright, .qrcode, .scan, .annotation-panel"
)
_CHROME_LINKS = {"下载文字版", "下载图片版", "打印", "下载", "收藏", "订阅", "分享", "纠错或建议", "历史沿革", "关联解读", "关联文件", "关联问答"}
_CHROME_TEXT = re.compile(
    "下载文字版|下载图片版|字体:\\s*【[大中小]】|【大】\\s*【中】\\s*【小】|分享到:|收藏\\s*订阅|已推送.*?我的订阅|此稿件无标签.*?订阅更多|语音播报:|扫一扫在手机打开当前页"
    "|【打印】\\s*【下载】|纠错或建议|历史沿革|关联解读|关联文件|关联问答|关于《.*?》的解读|个人中心-我的订阅|进入\\s*\"?订阅设置\"?"
)
# The headings of a ruling's sections.
_SECTION_HEADS = re.compile(r"((?:主\s*旨|說\s*明|理\s*由|解釋文|理由書|主文|事實|爭點)[：:])")
_ARTICLES = re.compile(r"(第[一二三四五六七八九十百千零〇两]+条)")
_NUMBERED = re.compile(r"([一二三四五六七八九十]+)、")


_PLACES = re.compile(f"([{''.join(CN_DIGITS)}]*)([{''.join(CN_UNITS)}]?)")


def numeral(text: str) -> str:
    """A Chinese numeral in Arabic digits; other texts pass through."""
    if not text or not set(text) <= CN_DIGITS.keys() | CN_UNITS.keys():
        return text
    places = ((CN_DIGITS[d[-1]] if d else 0, u) for d, u in _PLACES.findall(text))
    return str(sum((value or 1) * CN_UNITS[u] if u else value for value, u in places))


def clean(text: str) -> str:
    """The text normaliser on one string (C: same folding as normalize_text)."""
    text = unicodedata.normalize("NFKC", text).replace("\r\n", "\n")
    text = re.sub(r"\n{3,}", "\n\n", re.sub("[ \t\xa0]+", " ", text))
    return text.translate(str.maketrans("‘’“”‐‑‒–—―．", "''\"\"------.")).strip()


def charset_of(content: bytes, content_type: str | None) -> str:
    """N7. From the header, else the first 500 bytes, else utf-8; gb2312 is read as gb18030."""
    found = re.search(r"charset=([^\s;]+)", content_type or "", re.I)
    name = found[1] if found else None
    if name is None:
        head = re.search(r"""charset=["']?([a-z0-9_-]+)""", content[:500].decode("ascii", "replace").lower())
        name = head[1] if head else "utf-8"
    return name.lower().replace("gb2312", "gb18030")


def decode_content(content: bytes | None, content_type: str | None) -> str:
    try:
        return (content or b"").decode(charset_of(content or b"", content_type), "replace")
    except LookupError:
        return (content or b"").decode("utf-8", "replace")


def _split(pattern: re.Pattern, text: str) -> list[tuple[str, str]]:
    parts = pattern.split(text)
    return [(a.strip(), b.strip()) for a, b in zip(parts[1::2], parts[2::2])]


def tw_ruling(row: dict) -> tuple[str, list[Provision]]:
    """N3. Sections of a ruling, else its whole text."""
    page, key = parse(decode_content(row["content"], "charset=utf-8")), row["external_id"]
    titles = (page.first(s) for s in ("h2", "h3", ".title", "#law-name", "title"))
    title = next((t.text() for t in titles if t is not None and t.text()), key)
    body = page.first(".law-content, .content, #content, main, article") or page.first("body") or page
    text = clean(body.text("\n"))
    found = [(h.rstrip("：:"), clean(b)) for h, b in _split(_SECTION_HEADS, text)]
    if not text:
        return title, []
    return title, [(f"{key}#{h}", h, b) for h, b in found] or [(key, "全文", text)]


def cn_tax(row: dict, anchored: bool = False) -> tuple[str, list[Provision]]:
    """N4. Articles 第X条, else sections 一、, else the whole text. ``anchored``
    splits only at the start of a line."""
    page, meta = parse(decode_content(row["content"], row["content_type"])), row["metadata"]
    title = (meta.get("title") or "").strip()
    if not title:
        heads = (page.first(s) for s in ("h1", "h2", ".article-title", ".law-title", "#title", "title"))
        title = next((t.text() for t in heads if t is not None and len(t.text()) > 2), row["external_id"])
    bare = re.sub("^中华人民共和国", "", title)
    key = bare if bare.endswith(("法", "条例", "细则", "办法", "规则")) else row["external_id"]
    body = page.first(".article-content, .law-content, .TRS_Editor, #content, main, article") or page.first(".content") or page.first("body") or page
    for e in list(body.select(_CHROME)):
        e.drop()
    for e in list(body.select("a")):
        if e.text() in _CHROME_LINKS:
            e.drop()
    text = "\n".join(line for line in _CHROME_TEXT.sub("", clean(body.text("\n"))).splitlines() if line.strip())
    at = (lambda p: re.compile("(?m)^" + p.pattern)) if anchored else (lambda p: p)
    articles = _split(at(_ARTICLES), text)
    if articles:
        return title, [(f"{key}#{numeral(h[1:-1])}", h, clean(b)) for h, b in articles]
    sections = _split(at(_NUMBERED), text)
    if sections:
        return title, [(f"{key}#{numeral(h)}", f"{h}、", clean(b)) for h, b in sections]
    return title, [(key, "全文", text)] if text else []


def us_cfr(row: dict) -> tuple[str, list[Provision]]:
    """N5. One provision a SECTION, in any namespace; empty ones go."""
    root = ElementTree.fromstring(row["content"])
    name = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    text = lambda e: clean("".join(e.itertext()))
    out = []
    for section in (e for e in root.iter() if name(e) == "SECTION"):
        parts = {n: next((text(c) for c in section if name(c) == n), None) for n in ("SECTNO", "SUBJECT")}
        body = "\n".join(t for t in (text(c) for c in section if name(c) not in parts) if t)
        if parts["SECTNO"] is None or not (body or parts["SUBJECT"]):
            continue
        number, subject = re.sub(r"\s+", " ", parts["SECTNO"]), parts["SUBJECT"] or ""
        key = f"26 CFR {number}" if number.startswith("§") else f"26 CFR § {number}"
        out.append((key, f"{number}  {subject}".strip(), clean(f"{subject}\n{body}")))
    part = row["metadata"].get("part")
    title = next((text(e) for e in root.iter() if name(e) in ("CFRTITLE", "TITLENUM")), row["external_id"])
    return f"26 CFR Part {part}" if part else title, out


# The layouts of the states' pages.
#: state: sections, headings, number in a heading, fallback body, default code, metadata
#: key of the fallback, heading of a section without one, heading of a page without sections.
_STATES = {
    "TX": ("div.section, .codeSect", "b, .section-heading, h3, h4", r"Sec\.?\s*([\d.]+[A-Z]?)", "body", "TX Tax Code", "chapter", "Ch. {}", "Texas Tax Code Ch. {}"),
    "FL": ("div.section, div.statute-text", "h2, h3, .section-number", r"([\d.]+)", "div#siteContent, div.content", "Florida Statutes", "chapter", "Ch. {}", "Florida Statutes Ch. {}"),
    "WA": ("div.RCWSection, div.WACSection, .lawsection", ".section-header, b, h3", r"([\d-]+)", "div#ctl00_ContentPlaceHolder1_panelText", "WAC", "chapter", "{}", "WAC {}"),
    "IL": ("div.Section, tr.sectionRow, .ilcssection", "b, .sectionNumber", r"Sec\.?\s*([\d.]+)", "div#content", "35 ILCS", "act_id", "Act {}", "35 ILCS Act {}"),
    "NY": ("div.law-section, article.bill-section", "h3, .section-title, .section-number", r"§\s*([\d-]+[a-z]?)", "div.law-text, main", "NY Tax Law", "article", "Article {}", "NY Tax Law Article {}"),
}


def us_state(row: dict) -> tuple[str, list[Provision]]:
    """N6. Six state layouts, and main, article or content for the others."""
    page, meta = parse(decode_content(row["content"], row["content_type"])), row["metadata"]
    text = lambda e: clean(e.text("\n")) if e is not None else ""
    state, title = meta.get("state", ""), meta.get("title") or text(page.first("title, h1")) or row["external_id"]
    body = page.first("body") or page
    if state == "CA":
        code, section = meta.get("statute_code", "RTC"), meta.get("section", "")
        box = page.first("div.lawcode") or page.first("div#lawcontent") or body
        whole = "\n".join(t for t in map(text, box.select("p, div.section-text, .lawtext")) if t) or text(box)
        return title, [(f"CA:{code}-{section}", f"{code} § {section}", whole)] if whole else []
    if state not in _STATES:
        whole = text(page.first("main, article, div#content, div.content") or body)
        return title, [(f"{state or 'US'}:{meta.get('external_id', '')}", text(page.first("title, h1")) or meta.get("external_id", ""), whole)]
    sections, heads, number, fallback, default, fallback_key, unnamed, page_heading = _STATES[state]
    code, other, out = meta.get("statute_code", default), meta.get(fallback_key, ""), []
    for e in page.select(sections):
        heading = text(e.first(heads))
        found = re.search(number, heading)
        parts = [t for t in map(text, e.select("p, .body-text, .text")) if t and t != heading] if state == "TX" else []
        whole = "\n".join(parts) or text(e)
        if whole or state == "TX":
            out.append((f"{state}:{code}-{found[1] if found else other}", heading or unnamed.format(other), whole))
    return title, out or [(f"{state}:{code}-{'Art' if state == 'NY' else ''}{other}", page_heading.format(other), text(page.first(fallback) or body))]


def _parsed(raw: DataFrame, parser: Callable[[dict], tuple[str, list[Provision]]]) -> DataFrame:
    """A document that can't be parsed gives no rows but doesn't end the job."""
    short_batches(raw.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for row in pdf.to_dict("records"):
                row["metadata"] = dict(row["metadata"] or {})
                row["metadata"].setdefault("external_id", row["external_id"])
                try:
                    title, found = parser(row)
                except (ElementTree.ParseError, TypeError):
                    continue
                rows += [(row["source_key"], row["external_id"], title, i, *p) for i, p in enumerate(found)]
            yield pd.DataFrame(rows, columns=["source_key", "external_id", "title", "ordinal", "node_key", "heading", "text"])

    return raw.select("source_key", "external_id", "content", "content_type", "metadata").mapInPandas(run, SCHEMA)


_LAW = "struct<LawName:string,LawModifiedDate:string,LawAbandonNote:string,LawHistories:string,LawArticles:array<struct<ArticleType:string,ArticleNo:string,ArticleContent:string>>>"
HISTORIES = 2000


def normalize_tw_law(raw: DataFrame) -> DataFrame:
    """N2. Law JSON → provisions with abandoned and histories; chapter rows and
    empty articles go."""
    law = raw.select("source_key", "external_id", F.from_json(F.decode("content", "UTF-8"), _LAW).alias("law"))
    name = F.coalesce("law.LawName", "external_id")
    rows = law.select("source_key", "external_id", name.alias("title"), "law", F.posexplode("law.LawArticles").alias("ordinal", "a"))
    rows = rows.where("coalesce(a.ArticleType, 'A') <> 'C' and trim(coalesce(a.ArticleContent, '')) <> ''")
    no = F.trim(F.coalesce("a.ArticleNo", F.lit("")))
    number, bare = F.regexp_extract(no, r"第\s*(\d+(?:-\d+)?)\s*條", 1), F.regexp_replace(no, r"\s+", "")
    key = F.when(number != "", F.concat_ws("#", "title", number)).when(bare != "", F.concat_ws("#", "title", bare)).otherwise(F.col("title"))
    return rows.select(
        "source_key", "external_id", "title", "ordinal", key.alias("node_key"), no.alias("heading"), normalize_text(F.trim("a.ArticleContent")).alias("text"),
        (F.trim(F.coalesce("law.LawAbandonNote", F.lit(""))) != "").alias("abandoned"), F.substring("law.LawHistories", 1, HISTORIES).alias("histories"),
    )


#: Connector → parser (interpretations and register notices are read as rulings).
PARSERS = {"tw_mof_ruling": tw_ruling, "tw_constitutional": tw_ruling, "us_federal_register": tw_ruling, "cn_chinatax": cn_tax, "cn_mof": cn_tax, "us_ecfr": us_cfr, "us_govinfo_cfr": us_cfr, "us_state_tax": us_state}


def normalize_all(raw: DataFrame) -> DataFrame:
    """N8. Every connector's documents through its parser."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    parts = [normalize_tw_law(raw.where("connector = 'tw_moj_law'")).select(*columns)]
    for parser in dict.fromkeys(PARSERS.values()):
        own = [c for c, p in PARSERS.items() if p is parser]
        parts.append(_parsed(raw.where(F.col("connector").isin(*own)), parser))
    return reduce(DataFrame.unionByName, parts)


def hash_documents(provisions: DataFrame, by: list[str]) -> DataFrame:
    """N9. content_hash of each document: of its provision texts in order, joined
    by line feeds."""
    ordered = F.sort_array(F.collect_list(F.struct("ordinal", "text")))
    return provisions.groupBy(*by).agg(lines_hash(ordered).alias("content_hash"), F.count("*").alias("n_provisions"))


def lines_hash(ordered: F.Column) -> F.Column:
    """N9 of provisions (structs with ``text``) in order."""
    return F.sha2(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n"), 256)


def text_hash() -> F.Column:
    """N9. Of one provision."""
    return F.sha2("text", 256)
