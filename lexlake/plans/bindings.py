"""Legal-shaped inputs out of the driver's tables, by the same text in Spark and
in the SQL engine of the check. Where the two differ, a Dialect says how."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents pages".split()

# Titles that documents cycle through.
TITLES = [
    "中华人民共和国增值税法", "中华人民共和国增值税法实施条例", "中华人民共和国企业所得税法", "中华人民共和国企业所得税法实施条例", "中华人民共和国个人所得税法",
    "国家税务总局关于增值税征收管理有关事项的公告", "财政部关于印花税若干具体问题的通知", "国家税务总局关于电池消费税征收管理的公告", "土地增值税清算管理办法", "车辆购置税征收管理办法",
    "中华人民共和国消费税暂行条例", "中华人民共和国消费税暂行条例实施细则", "税务登记管理办法", "国家税务总局关于发票管理的批复", "关于《契税法》实施后有关优惠政策衔接问题的公告",
    "所得稅法", "所得稅法施行細則", "營利事業所得稅查核準則", "加值型及非加值型營業稅法", "加值型及非加值型營業稅法施行細則",
    "遺產及贈與稅法", "稅捐稽徵法", "貨物稅條例", "使用牌照稅法", "各類所得扣繳率標準",
    "房屋稅條例", "土地稅法", "土地稅法施行細則", "菸酒稅法", "證券交易稅條例",
    "26 CFR Part 1 income tax", "Texas Tax Code corporate tax", "Sales and use rules", "individual tax credits", "国务院关于深化改革的意见",
    "税收征收管理法", "税收征收管理法实施细则", "资源税法", "环境保护税法实施条例", "海關進口稅則",
]


class Dialect:
    def __init__(self, spark: bool) -> None:
        self.spark = spark

    def ts(self, seconds: str) -> str:
        return f"timestamp_seconds({seconds})" if self.spark else f"make_timestamp(CAST({seconds} AS BIGINT) * 1000000)"

    def epoch(self, ts: str) -> str:
        return f"unix_timestamp(CAST({ts} AS TIMESTAMP))" if self.spark else f"CAST(floor(epoch({ts})) AS BIGINT)"

    def sha(self, text: str) -> str:
        return f"sha2({text}, 256)" if self.spark else f"sha256({text})"

    def lines(self) -> str:
        """doc_id, ln (from 0), line of every document."""
        if self.spark:
            return "SELECT doc_id, CAST(ln AS BIGINT) AS ln, line FROM {documents} LATERAL VIEW posexplode(split(text, '\\n')) x AS ln, line"
        return "SELECT doc_id, unnest(generate_series(0, len(l) - 1)) AS ln, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"

    def array(self, items: str) -> str:
        return f"array({items})" if self.spark else f"[{items}]"

    def div(self, a: str, b: str) -> str:
        return f"({a} DIV {b})" if self.spark else f"(({a}) // ({b}))"


DAY0 = 1_704_067_200  # 2024-01-01
AS_OF = DAY0 + 20 * 86_400

_values = ", ".join(f"({i}, '{t}')" for i, t in enumerate(TITLES))


def _titles(d: Dialect) -> str:
    return f"SELECT * FROM (VALUES {_values}) AS t(k, title)"


def _docs(d: Dialect) -> str:
    return f"""SELECT x.doc_id AS document_id, concat('n', CAST(x.doc_id % 25 AS STRING)) AS source_key,
      CASE (x.doc_id % 25) % 3 WHEN 0 THEN 'TW' WHEN 1 THEN 'CN' ELSE 'US' END AS country, t.title,
      CASE x.doc_id % 4 WHEN 0 THEN 'statute' WHEN 1 THEN 'regulation' WHEN 2 THEN 'ruling' ELSE 'announcement' END AS doc_type,
      concat('财税〔', CAST(2000 + x.doc_id % 25 AS STRING), '〕', CAST(x.doc_id AS STRING), '号') AS external_id,
      concat('http://law.example.org/zcfgk/c', CAST(100000 + x.doc_id AS STRING), '/content.html') AS url,
      {d.ts(f"{DAY0} + x.doc_id % 1000 * 86400")} AS issued_at
    FROM {{documents}} x JOIN ({_titles(d)}) t ON t.k = x.doc_id % 40"""


def _sources(d: Dialect) -> str:
    return """SELECT concat('n', CAST(n_nationkey AS STRING)) AS source_key,
      CASE n_nationkey % 3 WHEN 0 THEN 'TW' WHEN 1 THEN 'CN' ELSE 'US' END AS country, n_nationkey % 4 <> 3 AS enabled FROM {nation}"""


def _snaps(d: Dialect) -> str:
    fetched = f"{DAY0} + doc_id * 3600"
    return f"""SELECT doc_id AS snapshot_id, {d.div("doc_id", "5")} AS document_id, {d.ts(fetched)} AS fetched_at,
      CASE WHEN doc_id % 3 <> 0 THEN {d.ts(f"{fetched} - (doc_id * 37 % 400) * 86400")} END AS issued_at, {d.sha("text")} AS content_hash FROM {{documents}}"""


def _prov(d: Dialect) -> str:
    """Version 1 of each document's lines as provisions of snapshot doc_id."""
    return f"""SELECT doc_id AS snapshot_id, ln AS ordinal, concat('D', CAST(doc_id AS STRING), '#', CAST(ln AS STRING)) AS node_key,
      concat('L', CAST(ln AS STRING)) AS heading, line AS text FROM ({d.lines()}) l"""


def _v1(d: Dialect) -> str:
    return f"SELECT snapshot_id AS pair_id, ordinal, node_key, heading, text FROM ({_prov(d)}) p"


def _v2(d: Dialect) -> str:
    """Lines of version 2: some dropped, some edited, some renumbered, one added
    (in Spark with the document's own lines, which so stay in one task)."""
    if d.spark:
        closing = "named_struct('ln', 9999L, 'own', false, 'line', 'a new closing provision')"
        return f"""SELECT doc_id AS pair_id, ln AS ordinal,
      concat('D', CAST(doc_id AS STRING), '#', CAST(CASE WHEN doc_id % 4 = 0 AND ln >= 10 AND own THEN ln + 1000 ELSE ln END AS STRING)) AS node_key,
      CASE WHEN own THEN concat('L', CAST(ln AS STRING)) ELSE 'new' END AS heading, CASE WHEN ln % 5 = 2 AND own THEN replace(line, 'e', 'E') ELSE line END AS text
    FROM {{documents}} LATERAL VIEW inline(concat(coalesce(transform(split(text, '\\n'), (x, i) -> named_struct('ln', CAST(i AS BIGINT), 'own', true, 'line', x)), array()),
      CASE WHEN doc_id % 3 = 0 THEN array({closing}) ELSE array() END)) l AS ln, own, line
    WHERE ln % 7 <> 3 OR NOT own"""
    return f"""SELECT doc_id AS pair_id, ln AS ordinal,
      concat('D', CAST(doc_id AS STRING), '#', CAST(CASE WHEN doc_id % 4 = 0 AND ln >= 10 THEN ln + 1000 ELSE ln END AS STRING)) AS node_key,
      concat('L', CAST(ln AS STRING)) AS heading, CASE WHEN ln % 5 = 2 THEN replace(line, 'e', 'E') ELSE line END AS text
    FROM ({d.lines()}) l WHERE ln % 7 <> 3
    UNION ALL SELECT doc_id, 9999, concat('D', CAST(doc_id AS STRING), '#9999'), 'new', 'a new closing provision' FROM {{documents}} WHERE doc_id % 3 = 0"""


def _changes(d: Dialect) -> str:
    return """SELECT event_id AS change_id, user_id AS document_id, CAST(ts AS TIMESTAMP) AS detected_at, event_id * 7 % 1000 AS to_snapshot_id, event_id * 7 % 1000 - 1 AS from_snapshot_id,
      concat('L', CAST(user_id % 20 AS STRING), '#', CAST(event_id % 50 AS STRING)) AS node_key,
      CASE event_id % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' WHEN 2 THEN 'modified' ELSE 'renumbered' END AS change_type,
      CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'major' WHEN 'click' THEN 'minor' ELSE 'cosmetic' END AS severity FROM {events}"""


def _analyses(d: Dialect) -> str:
    return "SELECT event_id AS change_id, concat('s', CAST(event_id AS STRING)) AS summary, value - floor(value) AS confidence, CASE WHEN event_id % 2 = 0 THEN '2026-01-01' END AS effective_date, CASE WHEN event_id % 3 = 0 THEN 'impact' ELSE '' END AS parent_law_impact FROM {events} WHERE event_type = 'purchase'"


_TYPES = "CASE l_linenumber % 5 WHEN 0 THEN 'authority_of' WHEN 1 THEN 'interprets' WHEN 2 THEN 'cites' WHEN 3 THEN 'amends' ELSE 'supersedes' END"


def _relations(d: Dialect) -> str:
    """Hubs on purpose: 997 sources, 100 targets at sf0.01."""
    return f"""SELECT concat('K', CAST((l_partkey * 7 + l_linenumber) % 997 AS STRING)) AS from_key, concat('K', CAST(l_suppkey % 997 AS STRING)) AS to_key,
      {_TYPES} AS relation_type, CAST(1 - l_discount AS DOUBLE) AS confidence, concat('e', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS evidence_text,
      l_orderkey * 10 + l_linenumber AS seq FROM {{lineitem}}"""


def _thin(d: Dialect) -> str:
    """A sparse graph over all line items: orders are documents or articles, and
    each points at a few earlier ones, so keys grow with the table."""
    return """SELECT DISTINCT concat('K', CAST(l_orderkey AS STRING), CASE WHEN l_orderkey % 3 = 0 THEN concat('#', CAST(l_linenumber % 4 AS STRING)) ELSE '' END) AS from_key,
      concat('K', CAST(CAST(floor((l_orderkey + l_linenumber) / 3) AS BIGINT) AS STRING), CASE WHEN l_partkey % 3 = 0 THEN concat('#', CAST(l_partkey % 4 AS STRING)) ELSE '' END) AS to_key,
      CASE WHEN l_orderkey % 2 = 0 THEN 'authority_of' ELSE 'interprets' END AS relation_type FROM {lineitem}"""


def _edges(d: Dialect) -> str:
    """Edges of documents and articles, one for each line item."""
    return """SELECT concat('K', CAST((l_partkey * 7 + l_linenumber) % 997 AS STRING), CASE WHEN l_orderkey % 3 = 0 THEN concat('#', CAST(l_orderkey % 4 AS STRING)) ELSE '' END) AS from_key,
      concat('K', CAST(l_suppkey % 997 AS STRING), CASE WHEN l_partkey % 3 = 0 THEN concat('#', CAST(l_partkey % 4 AS STRING)) ELSE '' END) AS to_key,
      CASE WHEN l_orderkey % 2 = 0 THEN 'authority_of' ELSE 'interprets' END AS relation_type FROM {lineitem}"""


_FIELDS = "('applicability', 0), ('taxable_event', 1), ('rate', 2), ('taxable_items', 3), ('formula', 4), ('tax_base', 5), ('deductions', 6), ('incentives', 7), ('filing_deadline', 8), ('payment_deadline', 9), ('administration', 10)"


def _requirements(d: Dialect) -> str:
    return f"""SELECT c_custkey AS requirement_id, CASE c_nationkey % 3 WHEN 0 THEN 'TW' WHEN 1 THEN 'CN' ELSE 'US' END AS country,
      CASE c_custkey % 4 WHEN 0 THEN 'vat' WHEN 1 THEN 'cn_vat' WHEN 2 THEN 'tw_income' ELSE 'income' END AS tax_key,
      concat('scenario ', CAST(c_custkey % 97 AS STRING)) AS scenario, concat('role ', CAST(c_custkey % 5 AS STRING)) AS taxpayer_role, '' AS identity_key,
      'draft' AS status, c_custkey % 1000 AS source_document_id, '' AS notes,
      CASE WHEN c_custkey % 7 <> 0 THEN {d.ts(f"{DAY0} + c_custkey % 3 * 86400")} END AS last_seen_at FROM {{customer}}"""


def _flat_fields(d: Dialect) -> str:
    """Cells with two citation keys as plain columns."""
    return f"""SELECT c_custkey AS requirement_id, f.field_key, concat('v', CAST(c_custkey * 11 + f.n AS STRING)) AS value,
      CASE WHEN (c_custkey + f.n) % 3 > 0 THEN concat('L', CAST(c_custkey % 40 AS STRING), '#', CAST((c_custkey + f.n * 7) % 100 AS STRING)) END AS c1,
      CASE WHEN (c_custkey + f.n) % 3 > 1 THEN concat('L', CAST((c_custkey + 1) % 40 AS STRING), '#', CAST((c_custkey * 3 + f.n) % 100 AS STRING)) END AS c2,
      CAST((c_custkey + f.n) % 10 AS DOUBLE) / 10 AS confidence, CASE (c_custkey + f.n) % 4 WHEN 0 THEN 'import' WHEN 1 THEN 'manual' ELSE 'extracted' END AS source,
      (c_custkey + f.n) % 9 = 0 AS needs_review FROM {{customer}} CROSS JOIN (VALUES {_FIELDS}) AS f(field_key, n)"""


def _fields(d: Dialect) -> str:
    """Spark only: the citations as an array of structs."""
    return f"""SELECT requirement_id, field_key, value,
      filter(array(named_struct('node_key', c1, 'quote', 'q1'), named_struct('node_key', c2, 'quote', 'q2')), c -> c.node_key IS NOT NULL) AS citations,
      confidence, source, needs_review, '' AS review_reason, CAST(NULL AS BIGINT) AS stale_change_id FROM ({_flat_fields(d)}) x"""


_LABELS = "CASE doc_id % 6 WHEN 0 THEN '税收政策-增值税,税费征管' WHEN 1 THEN '税收政策-企业所得税' WHEN 2 THEN '契税, 其他' WHEN 3 THEN '' WHEN 4 THEN '税收政策-印花税,印花税' ELSE '无' END"


def _corpus_rows(d: Dialect) -> str:
    """The landed layout of a reference corpus."""
    return f"""SELECT CASE WHEN doc_id % 50 = 49 THEN ' ' ELSE t.title END AS title, 'policy' AS channel, x.text AS content,
      CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat('财税[', CAST(2000 + doc_id % 25 AS STRING), ']', CAST(doc_id AS STRING), '号')
        ELSE concat('财税（', CAST(2000 + doc_id % 25 AS STRING), '） ', CAST(doc_id AS STRING), ' 号') END AS document_number,
      '部门规章' AS effect_level, {_LABELS} AS tax_type, CASE doc_id % 5 WHEN 0 THEN '全文废止' WHEN 1 THEN '全文失效' ELSE '全文有效' END AS aging, '' AS labels,
      'dept' AS issuing_department, CASE doc_id % 4 WHEN 0 THEN concat('2024-0', CAST(1 + doc_id % 9 AS STRING), '-15') WHEN 1 THEN concat('2023/0', CAST(1 + doc_id % 9 AS STRING), '/03')
        WHEN 2 THEN concat('2022年', CAST(1 + doc_id % 9 AS STRING), '月7日') ELSE 'unknown' END AS written_date,
      CASE WHEN doc_id % 2 = 0 THEN concat('/zcfgk/c', CAST(100000 + doc_id AS STRING), '/content.html') ELSE concat('http://x.example.org/', CAST(10000000 + doc_id AS STRING), '/') END AS url, doc_id
    FROM {{documents}} x JOIN ({_titles(d)}) t ON t.k = x.doc_id % 40"""


def _cited(d: Dialect) -> str:
    """Provision texts whose citations are known by construction: a, b are article numbers."""
    law = "CASE doc_id % 3 WHEN 0 THEN '所得稅法' WHEN 1 THEN '營業稅法' ELSE '遺產稅法' END"
    cn = "CASE doc_id % 3 WHEN 0 THEN '企业所得税法' WHEN 1 THEN '增值税暂行条例' ELSE '环境保护税法' END"
    return f"""SELECT doc_id, doc_id % 5 AS kind, {law} AS tw_law, {cn} AS cn_law, 1 + doc_id % 90 AS a, 1 + doc_id * 7 % 90 AS b, 2000 + doc_id % 25 AS y,
      CASE doc_id % 5 WHEN 0 THEN concat('依', {law}, '第', CAST(1 + doc_id % 90 AS STRING), '條及第', CAST(1 + doc_id * 7 % 90 AS STRING), '條規定辦理。')
        WHEN 1 THEN concat('根据《', {cn}, '》，制定本规定。')
        WHEN 2 THEN concat('本通知自发布之日起施行，财税〔', CAST(2000 + doc_id % 25 AS STRING), '〕', CAST(1 + doc_id % 90 AS STRING), '号同时废止。')
        WHEN 3 THEN concat('修正', {law}, '第', CAST(1 + doc_id % 90 AS STRING), '條之2。')
        ELSE 'nothing is cited here' END AS text FROM {{documents}}"""


def _runs(d: Dialect) -> str:
    return f"""SELECT event_id AS run_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' ELSE 'completed' END AS status, CAST(ts AS TIMESTAMP) AS started_at,
      {d.ts(d.epoch("ts") + " + CAST(floor(value) AS BIGINT)")} AS finished_at FROM {{events}}"""


MAKERS: dict[str, Callable[[Dialect], str]] = {
    "titles": _titles, "docs": _docs, "sources": _sources, "snaps": _snaps, "prov": _prov, "v1": _v1, "v2": _v2, "changes": _changes, "analyses": _analyses, "relations": _relations,
    "thin": _thin, "edges": _edges, "requirements": _requirements, "flat_fields": _flat_fields, "fields": _fields, "corpus_rows": _corpus_rows, "cited": _cited, "runs": _runs,
}

SPARK, DUCK = Dialect(True), Dialect(False)


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A binding as a DataFrame over the driver's tables."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    text = MAKERS[name](SPARK)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if "{" + t + "}" in text}
    return spark.sql(text, **used)


def with_ctes(*names: str) -> str:
    """WITH text of the bindings for the SQL engine; a query follows."""
    parts = []
    for name in names:
        text = MAKERS[name](DUCK)
        for t in BASE:
            text = text.replace("{" + t + "}", t)
        parts.append(f"{name} AS ({text})")
    return "WITH " + ", ".join(parts) + " "
