"""Row-level text expressions: numerals, keys, names, dates, URLs, severity."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexlake import refdata as R

# What the text normaliser folds.
_SPACES = "          　"
_FOLD_FROM, _FOLD_TO = "‘’“”‐‑‒–—―．", "''\"\"------."


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def normalize_text(text: Column) -> Column:
    """NFKC, one kind of space and line feed, at most one blank line, plain
    quotes and dashes, trimmed. Null stays null."""
    out = F.translate(nfkc(text), _SPACES, " " * len(_SPACES))
    out = F.regexp_replace(F.regexp_replace(out, "\r\n", "\n"), "[ \t]+", " ")
    out = F.translate(F.regexp_replace(out, "\n{3,}", "\n\n"), _FOLD_FROM, _FOLD_TO)
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


def cn_to_int(text: Column) -> Column:
    """Chinese numeral → int: 一百三十三 → 133, 十一 → 11, 〇 → 0; null for anything else."""
    chars = F.split(F.trim(text), "")
    digit, unit = F.create_map(*_pairs(R.CN_DIGITS)), F.create_map(*_pairs(R.CN_UNITS))

    def step(a: Column, c: Column) -> Column:
        d, u = F.try_element_at(digit, c), F.try_element_at(unit, c)
        held = F.when(a["pending"] == 0, 1).otherwise(a["pending"])
        return F.struct(
            (a["total"] + F.coalesce(u * held, F.lit(0))).alias("total"),
            F.when(u.isNotNull(), 0).otherwise(F.coalesce(d, F.lit(0))).alias("pending"),
            (a["ok"] & (d.isNotNull() | u.isNotNull())).alias("ok"),
        )

    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("pending"), F.lit(True).alias("ok"))
    found = F.aggregate(chars, start, step, lambda a: F.when(a["ok"], a["total"] + a["pending"]))
    return F.when(F.length(F.trim(text)) > 0, found)


def _pairs(table: dict[str, int]) -> list[Column]:
    return [F.lit(x) for pair in table.items() for x in pair]


def to_arabic(text: Column) -> Column:
    """The numeral in Arabic digits; what is none passes through."""
    return F.coalesce(cn_to_int(text).cast("string"), text)


def norm_key(key: Column) -> Column:
    """Entity key: no white space and 《》, 臺 → 台, no leading 中华人民共和国 before a name."""
    out = F.regexp_replace(F.translate(F.regexp_replace(key, r"(?U)\s+", ""), "臺《》", "台"), "^中华人民共和国(?=.)", "")
    return out


def document_stem(key: Column) -> Column:
    return F.substring_index(key, "#", 1)


_CHILD_NAME = rf"^(.*{R.PARENT_SHAPE.removesuffix('$')}) *(?:{'|'.join(R.CHILD_SUFFIXES)})$"


def parent_key(key: Column) -> Column:
    """The law that a child's own name implies, if the rest reads like a law."""
    found = F.regexp_extract(F.trim(document_stem(key)), _CHILD_NAME, 1)
    return F.when(found != "", found)


def parent_from_title(title: Column, doc_type: Column) -> Column:
    """The first 《…法》 of a title, else the statute of the first keyword; statutes have none."""
    quoted = F.regexp_extract(title, R.TITLE_STATUTE, 1)
    found = F.when(quoted != "", quoted).otherwise(R.first_contained(title, R.STATUTE_OF_KEYWORD))
    return F.when(F.coalesce(doc_type != "statute", F.lit(True)), found)


def entity_type(key: Column) -> Column:
    return (
        F.when(key.rlike("(法|條例|条例)(#|$)"), "statute")
        .when(key.rlike("準則|辦法|規則|細則|细则|办法|规则|暂行条例"), "regulation")
        .when(key.contains("台財稅"), "ruling")
        .when(key.contains("釋字") | key.contains("憲判字"), "interpretation")
        .otherwise("ruling")
    )


def doc_type(title: Column, label: Column) -> Column:
    """From the title, else from the effect label, else announcement."""
    return F.coalesce(R.first_contained(title, R.TITLE_DOC_TYPES), R.first_contained(label, R.LABEL_DOC_TYPES), F.lit("announcement"))


def hierarchy_level(title: Column) -> Column:
    return (
        F.when(title.endswith("法") & ~title.contains("办法"), "law")
        .when(title.endswith("条例"), "regulation")
        .when(title.rlike("(细则|办法|规则)$"), "rule")
        .when(title.rlike("公告|通知|批复"), "notice")
        .otherwise("unknown")
    )


def law_name(title: Column) -> Column:
    """The title without 中华人民共和国 if it ends like a law's, else null."""
    bare = F.regexp_replace(title, "^中华人民共和国", "")
    return F.when(reduce(Column.__or__, [bare.endswith(s) for s in R.LAW_TITLE_SUFFIXES]), bare)


def classify_tax(title: Column, country: Column) -> Column:
    """The first tax type of the country with a keyword in the title, else <country>_other."""
    land = F.upper(F.coalesce(country, F.lit("")))
    out = F.when(land == "", "other").otherwise(F.concat(F.lower(land), F.lit("_other")))
    for key, of, words in reversed(R.TAX_TYPES):
        hit = reduce(Column.__or__, [title.contains(w) for w in words])
        out = F.when((land == of) & hit, key).otherwise(out)
    return out


def parse_tax_keys(raw: Column) -> Column:
    """Comma-separated labels → tax keys: text after the last '-', mapped, unknown
    ones dropped, distinct in order."""
    labels = F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda x: F.trim(F.substring_index(F.trim(x), "-", -1)))
    keys = F.transform(labels, lambda x: F.try_element_at(R.mapped(R.TAX_LABELS), x))
    return F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))


def parse_date(text: Column, kind: str) -> Column:
    """Timestamp of landed date texts. corpus: y-m-d, y/m/d, y年m月d日, with or
    without time; ymd: YYYYMMDD; roc: Minguo years 112.3.4 or 112年3月4日; api:
    y-m-d with or without time. Null where it doesn't fit."""
    t = F.trim(text)
    try_ = lambda fmt: F.try_to_timestamp(t, F.lit(fmt))
    if kind == "ymd":
        return F.when(t.rlike("^[0-9]{8}$"), try_("yyyyMMdd"))
    if kind == "roc":
        part = lambda i: F.regexp_extract(t, r"([0-9]{2,3})[年./-]\s*([0-9]{1,2})[月./-]\s*([0-9]{1,2})", i)
        year = part(1).try_cast("int") + 1911
        return F.try_to_timestamp(F.format_string("%d-%s-%s", year, part(2), part(3)), F.lit("y-M-d"))
    if kind == "api":
        return F.coalesce(F.when(F.length(t) > 10, try_("yyyy-M-d H:m:s")), F.when(F.length(t) <= 10, try_("yyyy-M-d")))
    t = F.substring(t, 1, 19)
    formats = ("yyyy-M-d", "yyyy/M/d", "yyyy年M月d日", "yyyy-M-d H:m:s")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in formats])


def absolute_url(url: Column, base: Column) -> Column:
    joined = F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(url, "^/+", ""))
    return F.when(F.coalesce(url, F.lit("")) == "", "").when(url.startswith("http"), url).otherwise(joined)


def to_https(url: Column) -> Column:
    return F.regexp_replace(url, "^http://", "https://")


def url_doc_id(url: Column) -> Column:
    """Document id in a policy-library address: c5251620, else a run of digits."""
    first = F.regexp_extract(url, r"/(c\d{5,})/content\.html", 1)
    rest = F.regexp_extract(url, r"/(\d{8,})/", 1)
    t, c = F.regexp_extract(url, r"/t(\d+)_", 1), F.regexp_extract(url, r"content_(\d+)", 1)
    return F.coalesce(*[F.when(x != "", x) for x in (first, rest, t, c)])


def pcode(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?i)pcode=([A-Za-z]\d+)", 1)
    return F.when(found != "", F.upper(found))


# Fixed value: what ends a notice's title.
NOTICE_END = "(?:有关(?:事项|问题)?)?的?(?:公告|通知|决定|批复|规定|意见|办法|函)$"


def core_title(title: Column) -> Column:
    """What a notice is about: between 关于 and its ending, without 《》; the whole
    title if under 4 characters are left."""
    cut = F.regexp_replace(F.regexp_replace(F.trim(title), "^.*?关于", ""), NOTICE_END, "")
    cut = F.regexp_replace(cut, "^[《》 　]+|[《》 　]+$", "")
    return F.when(F.length(cut) >= 4, cut).otherwise(F.trim(title))


def change_ratio(old: Column, new: Column) -> Column:
    """Positions that differ, both sides counted, over the longer text without spaces."""
    a, b = (F.split(F.replace(x, F.lit(" "), F.lit("")), "") for x in (old, new))
    la, lb = (F.length(F.replace(x, F.lit(" "), F.lit(""))) for x in (old, new))
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() & y.isNotNull() & (x != y), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    longer = F.greatest(la, lb)
    return F.when(longer > 0, (2 * differ + F.abs(la - lb)) / longer).otherwise(F.lit(0.0))


def is_cosmetic(old: Column, new: Column) -> Column:
    """Equal but for white space and punctuation."""
    bare = lambda x: F.regexp_replace(x, r"(?U)[\s,，.。;；:：、]+", "")
    return bare(old) == bare(new)


def severity(change_type: Column, old: Column, new: Column, similarity: Column) -> Column:
    ratio = change_ratio(old, new)
    modified = F.when(is_cosmetic(old, new), "cosmetic").when(ratio > 0.3, "critical").when(ratio > 0.1, "major").otherwise("minor")
    return (
        F.when(change_type.isin("added", "removed"), "critical")
        .when((change_type == "renumbered") & (similarity > 0.98), "cosmetic")
        .when(change_type == "modified", modified)
        .otherwise("minor")
    )
