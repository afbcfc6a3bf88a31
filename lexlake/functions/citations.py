"""Citations in provision texts, as an array of structs, in built-in expressions.

Each reading is a pattern with a relation. A pattern's groups are taken from all
its matches at once, so a text's citations are arrays that are zipped, turned
into keys and put one after another; the first of each (target, relation) stays.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexlake.functions.text import to_arabic
from lexlake.refdata import CN_NUMERALS

ONE = "struct<entity_key:string,relation_type:string,raw_text:string,confidence:double>"

# The shapes of names, articles and numbers, and the words around them.
_HAN = "(?:(?!第)[一-鿿])"
_TW_LAW = f"{_HAN}{{2,20}}(?:法|條例|準則|辦法|規則|細則)"
_CN_LAW = f"{_HAN}{{2,20}}(?:法|条例|细则|办法|规则|规定|规程)"
_N = f"[{CN_NUMERALS}]"
_TW_ART = rf"(?:\d+(?:-\d+)?(?:之\d+)?|{_N}{{1,8}}(?:之{_N}{{1,3}})?)"
_CN_ART = rf"(?:\d+|{_N}{{1,8}})"
_TW_RULING = r"(?P<id>(?:台|臺)財稅(?:發|字)?第\s*\d+\s*號)"
_CN_NUMBERS = [
    r"(?:国家税务总局|财政部\s*税务总局)公告\d{4}年第\d+号",
    r"财税[〔\[]\d{4}[〕\]]\d+号",
    r"国税[发函][〔\[]\d{4}[〕\]]\d+号",
    r"税总[发函][〔\[]\d{4}[〕\]]\d+号",
]
_CN_NUMBER = f"(?P<id>{'|'.join(_CN_NUMBERS)})"
_PARENT = "(?:本法|税法|稅法|母法)"
_SELF = "(?:本條例|本条例|本細則|本细则|本辦法|本办法|本準則|本准则)"
_DEICTIC = ["本法", "税法", "稅法", "母法", "該法", "该法", "本條例", "本条例", "本細則", "本细则", "本辦法", "本办法", "本準則", "本准则"]
_VERBS = ["依據", "據", "依据", "依照", "依", "按照", "按", "根据", "根據", "修正", "修改", "修订", "增訂", "刪除", "删除", "废止", "查"]
_MARKERS = ["依據", "依据", "依照", "根據", "根据", "按照", "依", "按"]
_TW_END = "停止適用|廢止|不再適用"
_CN_END = "废止|失效|停止执行"
_CHILD = "实施条例|实施细则|實施條例|實施細則"
_SHAPE = r"[一-鿿]{2,20}(?:法|條例|条例|準則|准则|辦法|办法|規則|规则|細則|细则|規定|规定)"
_BETWEEN = "[、,，及和與]"
_BESIDE = "[項款類目、，,及與和]"

# The twenty readings, in the order in which they claim a text:
# relation, what the target is, characters of which a match holds one, pattern.
READINGS = [
    ("authority_of", "article", "條", rf"(?:依|依據|按|按照)\s*(?P<law>{_TW_LAW})第\s*(?P<art>{_TW_ART})\s*條"),
    ("amends", "article", "條", rf"(?:修正|修改|增訂|刪除)\s*(?P<law>{_TW_LAW})第\s*(?P<art>{_TW_ART})\s*條"),
    ("supersedes", "number", "號", rf"(?:{_TW_END})\s*{_TW_RULING}"),
    ("supersedes", "number", "號", rf"{_TW_RULING}[^。；\n]{{0,20}}(?:業經|已|應)?\s*(?:{_TW_END})"),
    ("authority_of", "parent", "條条", rf"{_PARENT}第\s*(?P<art>{_TW_ART})\s*[條条]"),
    ("cites", "self", "條条", rf"{_SELF}第\s*(?P<art>{_TW_ART})\s*[條条]"),
    ("interprets", "article", "條", rf"(?P<law>{_TW_LAW})第\s*(?P<art>{_TW_ART})\s*條(?:第\s*(?P<par>\d+)\s*項)?(?:第\s*\d+\s*(?:款|類|目))?"),
    ("interprets", "number", "號", _TW_RULING),
    ("interprets", "number", "號", r"(?P<id>釋字第\s*\d+\s*號)"),
    ("interprets", "number", "號", r"(?P<id>憲判字第\s*\d+\s*號)"),
    ("authority_of", "law", "法", rf"《?(?P<law>[一-鿿]{{2,15}}法)》?\s*(?:及其|和)\s*《?[一-鿿]{{2,15}}(?:{_CHILD})》?"),
    ("authority_of", "article", "条", rf"(?:依据|依照|按照|根据)\s*《?(?P<law>{_CN_LAW})》?第(?P<art>{_CN_ART})条"),
    ("authority_of", "laws", "》", r"(?:依据|依照|按照|根据)\s*(?P<run>(?:《[一-鿿]{4,30}(?:法|条例|细则|办法|规则|规定|规程)》[\s、和及]*)+)"),
    ("authority_of", "named law", "規", rf"(?:依|依據|按|按照)\s*(?P<law>{_TW_LAW})\s*(?:第\s*\d+\s*條)?\s*規定"),
    ("amends", "article", "条", rf"(?:修改|修订|废止|删除)\s*《?(?P<law>{_CN_LAW})》?第(?P<art>{_CN_ART})条"),
    ("supersedes", "number", "号", rf"(?:{_CN_END})\s*{_CN_NUMBER}"),
    ("supersedes", "number", "号", rf"{_CN_NUMBER}[^。；\n]{{0,20}}(?:已经|已|予以)?\s*(?:{_CN_END})"),
    ("interprets", "article", "条", rf"《?(?P<law>{_CN_LAW})》?第(?P<art>{_CN_ART})条(?:第(?P<par>\d+)款)?"),
    ("interprets", "number", "号", _CN_NUMBER),
    ("interprets", "named law", "》", r"《(?P<law>[一-鿿]{4,30}(?:法|条例|细则|办法|规则|规定|规程))》"),
]
_SUB_ARTICLE = rf"(?U)第\s*(\d+|{_N}{{1,8}})\s*[條条]\s*之\s*(\d+|{_N}{{1,3}})"
#: Further articles of the law just named: 、第92條.
_ONE_MORE = rf"{_BETWEEN}\s*第\s*({_TW_ART})\s*[條条]"
_MORE = rf"(?P<more>(?:{_BETWEEN}\s*第\s*{_TW_ART}\s*[條条])*)"
#: A law's own name: behind a verb, behind the last of a marker, or behind the end of another reference.
_OWN_NAMES = [rf"(?:{'|'.join(sorted(_VERBS, key=len, reverse=True))})\s*(.*)", *(rf".*{m}\s*({_SHAPE})" for m in _MARKERS), f"({_SHAPE})"]
_OWN_NAME = rf"(?U)^(?:[{CN_NUMERALS}0-9]*{_BESIDE}+(?={_SHAPE}$))?(?:{'|'.join(_OWN_NAMES)})$"


def own_name(name: Column) -> Column:
    """本準則依所得稅法 → 所得稅法; a name of another shape stays."""
    name = F.regexp_replace(name, r"(?U)^[\s《》]+|[\s《》]+$", "")
    return F.regexp_replace(name, _OWN_NAME, "".join(f"${i}" for i in range(1, len(_OWN_NAMES) + 1)))


def article_key(law: Column, article: Column) -> Column:
    """所得稅法, 十四之一 → 所得稅法#14-1."""
    parts = F.split(F.regexp_replace(article, r"(?U)\s+", ""), "之", 2)
    return F.concat(F.substring_index(law, "#", 1), F.lit("#"), F.array_join(F.transform(parts, to_arabic), "-"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _mentions(text: Column, relation: str, kind: str, needle: str, pattern: str, parent: Column, own: Column) -> Column:
    """What one reading finds, match by match: relation, kind, base (a name or
    number as it stands), article (null for none), paragraph and raw text."""
    pattern = f"(?P<main>{pattern})" + (_MORE if kind in ("article", "parent", "self") else "")
    groups, java = re.compile(pattern).groupindex, "(?U)" + pattern.replace("(?P<", "(?<")
    seen = reduce(Column.__or__, [text.contains(c) for c in needle])

    def mention(base: Column, raw: Column, article: Column | None = None, paragraph: Column | None = None) -> Column:
        article, paragraph = F.lit(None).cast("string") if article is None else article, F.lit("") if paragraph is None else paragraph
        fields = {"relation": F.lit(relation), "kind": F.lit(kind), "base": base, "article": article, "paragraph": paragraph, "raw": raw}
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    def read(match: Column) -> Column:
        group = {name: F.regexp_extract(match, java, i) for name, i in groups.items()}
        if kind == "laws":
            return F.transform(F.regexp_extract_all(group["run"], F.lit("《([^》]+)》"), F.lit(1)), lambda name: mention(name, match))
        if "art" not in group:
            return F.array(mention(group.get("law", group.get("id")), group["main"]))
        base = {"parent": parent, "self": own}.get(kind, group.get("law"))
        more = F.transform(F.regexp_extract_all(group["more"], F.lit("(?U)" + _ONE_MORE), F.lit(0)), lambda raw: mention(base, raw, F.regexp_extract(raw, "(?U)" + _ONE_MORE, 1)))
        return F.concat(F.array(mention(base, group["main"], group["art"], group.get("par"))), more)

    return F.flatten(F.transform(F.when(seen, F.regexp_extract_all(text, F.lit(java), F.lit(0))).otherwise(F.array().cast("array<string>")), read))


def _citation(m: Column) -> Column:
    """The citation of a mention; its key is null if it names no law."""
    number = F.translate(F.regexp_replace(m["base"], r"(?U)\s+", ""), "臺", "台")
    name = F.when(m["kind"] == "number", number).when(m["kind"].isin("parent", "self"), m["base"]).otherwise(own_name(m["base"]))

    def keyed(name: Column) -> Column:
        lost = (name == "") | (m["kind"].isin("article", "laws", "named law") & name.isin(*_DEICTIC))
        paragraph = F.when(m["paragraph"] != "", F.concat(F.lit("#"), m["paragraph"])).otherwise("")
        return F.when(lost, None).when(m["article"].isNull(), name).otherwise(F.concat(article_key(name, m["article"]), paragraph))

    return F.struct(_let(name, keyed).alias("entity_key"), m["relation"].alias("relation_type"), F.trim(m["raw"]).alias("raw_text"), F.lit(1.0).alias("confidence")).cast(ONE)


def extract_citations(text: Column | str, parent: Column | str, own: Column | str) -> Column:
    """(entity_key, relation_type, raw_text, confidence) of a text. ``parent``
    and ``own`` resolve 本法 and 本條例, which are dropped without them. Null and
    texts without a citation give an empty array."""
    text, parent, own = (F.col(c) if isinstance(c, str) else c for c in (text, parent, own))
    parent, own = (F.when(c != "", c) for c in (parent, own))

    def found(bare: Column) -> Column:
        every = F.concat(*[_mentions(bare, *reading, parent, own) for reading in READINGS])
        return F.filter(F.transform(every, _citation), lambda c: c["entity_key"].isNotNull())

    def first_of_each(held: Column) -> Column:
        pair = lambda c: F.concat_ws("\n", c["entity_key"], c["relation_type"])
        return _let(F.transform(held, pair), lambda pairs: F.filter(held, lambda c, i: F.array_position(pairs, pair(c)) == i + 1))

    worth_it = F.coalesce(text.rlike("[條条號号法規规》]"), F.lit(False))
    bare = F.regexp_replace(text, _SUB_ARTICLE, "第$1之$2條")
    return F.when(worth_it, _let(_let(bare, found), first_of_each)).otherwise(F.array().cast(f"array<{ONE}>"))
