"""Queries of the relation graph (G*) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.functions import text as T
from lexlake.operators import graph as G
from lexlake.operators.forest import number_forest
from lexlake.plans.bindings import bound, with_ctes
from lexlake.plans.text_queries import C5_SQL

_STEM = "split_part({}, '#', 1)"
_DOCS = "kd AS (SELECT document_id, title, doc_type, concat('K', CAST(document_id // 2 AS VARCHAR)) AS entity_key FROM docs)"
_EDGES = "de AS (SELECT DISTINCT from_key, to_key FROM thin WHERE relation_type = 'authority_of' AND NOT contains(from_key, '#') AND NOT contains(to_key, '#'))"


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that stand for the keys of the graph bindings, two a key."""
    docs = bound(spark, sf_dir, "docs")
    return docs.withColumn("entity_key", F.concat(F.lit("K"), F.floor(F.col("document_id") / 2)))


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, "docs").withColumn("entity_key", T.norm_key(F.col("title")))


def _cited_provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The citation texts as the second provision of each document."""
    cited = bound(spark, sf_dir, "cited")
    return cited.select(F.col("doc_id").alias("snapshot_id"), F.col("doc_id").alias("document_id"), F.lit(2).alias("ordinal"), F.concat(F.lit("D"), "doc_id", F.lit("#2")).alias("node_key"), "text")


def g1_citation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = G.citation_edges(_cited_provisions(spark, sf_dir), _keyed(spark, sf_dir))
    return edges.select("from_key", "to_key", "relation_type")


def _cites(where: str = "") -> str:
    return f"""SELECT concat('D', CAST(doc_id AS VARCHAR), '#2') AS from_key, concat(tw_law, '#', CAST(a AS VARCHAR)) AS to_key, 'authority_of' AS relation_type, doc_id FROM cited WHERE kind = 0
UNION SELECT concat('D', CAST(doc_id AS VARCHAR), '#2'), concat(tw_law, '#', CAST(b AS VARCHAR)), 'authority_of', doc_id FROM cited WHERE kind = 0
UNION SELECT concat('D', CAST(doc_id AS VARCHAR), '#2'), cn_law, 'authority_of', doc_id FROM cited WHERE kind = 1
UNION SELECT concat('D', CAST(doc_id AS VARCHAR), '#2'), concat('财税〔', CAST(y AS VARCHAR), '〕', CAST(a AS VARCHAR), '号'), 'supersedes', doc_id FROM cited WHERE kind = 2
UNION SELECT concat('D', CAST(doc_id AS VARCHAR), '#2'), concat(tw_law, '#', CAST(a AS VARCHAR), '-2'), 'amends', doc_id FROM cited WHERE kind = 3"""


G1_SQL = with_ctes("cited") + f", k AS ({_cites()}) SELECT from_key, to_key, relation_type FROM k UNION SELECT from_key, to_key, 'interprets' FROM k"


def g2_hierarchy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.hierarchy_edges(_titled(spark, sf_dir)).select("from_key", "to_key", "confidence", F.col("seq").alias("document_id"))


G2_SQL = f"SELECT entity_key AS from_key, coalesce(parent, title_parent) AS to_key, CAST(1 AS DOUBLE) AS confidence, document_id FROM ({C5_SQL}) x WHERE coalesce(parent, title_parent) IS NOT NULL"


def g3_declared_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening citations; the fourth and later provisions say nothing here."""
    late = _cited_provisions(spark, sf_dir).withColumns({"ordinal": F.lit(9), "text": F.lit("依所得基本稅額條例第1條規定")})
    filler = [late.withColumns({"ordinal": F.lit(i), "text": F.lit("x")}) for i in (0, 1)]
    prov = _cited_provisions(spark, sf_dir).unionByName(late).unionByName(filler[0]).unionByName(filler[1])
    return G.declared_authority(_titled(spark, sf_dir), prov).select(F.col("seq").alias("document_id"), "from_key", "to_key", "confidence")


G3_SQL = with_ctes("docs", "cited") + rf"""SELECT DISTINCT d.document_id, k AS from_key, split_part(c.to_key, '#', 1) AS to_key, CAST(0.8 AS DOUBLE) AS confidence
  FROM (SELECT document_id, doc_type, regexp_replace(regexp_replace(regexp_replace(title, '\s', '', 'g'), '[《》]', '', 'g'), '^中华人民共和国', '') AS k FROM docs) d JOIN ({_cites()}) c ON c.doc_id = d.document_id
  WHERE d.doc_type <> 'statute' AND c.relation_type = 'authority_of' AND split_part(c.to_key, '#', 1) <> k"""


def g4_merge_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = bound(spark, sf_dir, "relations")
    old, new = rel.where("seq % 3 = 0"), rel.where("seq % 3 <> 0")
    return G.merge_relations(old, new).select("from_key", "to_key", "relation_type", "confidence", "evidence_text", "seq")


G4_SQL = with_ctes("relations") + """SELECT from_key, to_key, relation_type, confidence, evidence_text, seq FROM (SELECT *, row_number() OVER (PARTITION BY from_key, to_key, relation_type ORDER BY confidence DESC, seq) AS r FROM relations) x WHERE r = 1"""


def g5_build_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _titled(spark, sf_dir)
    return G.build_entities(bound(spark, sf_dir, "relations"), docs)


_KEY = r"regexp_replace(regexp_replace(regexp_replace(title, '\s', '', 'g'), '[《》]', '', 'g'), '^中华人民共和国', '')"
G5_SQL = with_ctes("docs", "relations") + f"""SELECT k AS entity_key, CASE WHEN regexp_matches(k, '(法|條例|条例)(#|$)') THEN 'statute' WHEN regexp_matches(k, '準則|辦法|規則|細則|细则|办法|规则|暂行条例') THEN 'regulation' ELSE 'ruling' END AS entity_type,
  coalesce(arg_min(title, document_id), k) AS canonical_title, max(document_id) AS current_document_id FROM (SELECT {_KEY} AS k, title, document_id FROM docs UNION ALL SELECT from_key, NULL, NULL FROM relations UNION ALL SELECT to_key, NULL, NULL FROM relations) x GROUP BY k"""


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of all suppliers, as far as the graph has them."""
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("K"), "s_suppkey").alias("seed")).distinct()


def g6_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _keyed(spark, sf_dir).select("entity_key").distinct()
    out = G.family(bound(spark, sf_dir, "thin"), keys)
    return out.select("entity_key", F.array_join("parents", ",").alias("parents"), F.array_join("children", ",").alias("children"))


G6_SQL = with_ctes("docs", "thin") + f""", {_DOCS}, {_EDGES} SELECT entity_key, coalesce(array_to_string((SELECT list(to_key ORDER BY to_key) FROM de WHERE from_key = entity_key), ','), '') AS parents,
  coalesce(array_to_string((SELECT list(from_key ORDER BY from_key) FROM de WHERE to_key = entity_key), ','), '') AS children FROM (SELECT DISTINCT entity_key FROM kd) k"""


def g7_entity_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = bound(spark, sf_dir, "thin")
    return G.entity_context(rel.select(F.col("from_key").alias("entity_key")), rel)


G7_SQL = with_ctes("thin") + f""", {_EDGES}, k AS (SELECT DISTINCT from_key AS entity_key, split_part(from_key, '#', 1) AS stem FROM thin)
  SELECT DISTINCT k.entity_key, 'parent_law' AS role, t.to_key AS other FROM k JOIN thin t ON t.from_key = k.entity_key UNION SELECT k.entity_key, 'child', t.from_key FROM k JOIN thin t ON t.to_key = k.entity_key
  UNION SELECT k.entity_key, 'sibling', u.from_key FROM k JOIN thin t ON t.from_key = k.entity_key JOIN thin u ON u.to_key = t.to_key WHERE u.from_key <> k.entity_key
  UNION SELECT k.entity_key, 'parent_document', d.to_key FROM k JOIN de d ON d.from_key = k.stem UNION SELECT k.entity_key, 'child_document', d.from_key FROM k JOIN de d ON d.to_key = k.stem"""


def g8_impact_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.impact_spread(_seeds(spark, sf_dir), bound(spark, sf_dir, "thin"), 3)


G8_SQL = with_ctes("thin").replace("WITH ", "WITH RECURSIVE ", 1) + """, s AS (SELECT DISTINCT concat('K', CAST(s_suppkey AS VARCHAR)) AS seed FROM supplier),
  r AS (SELECT s.seed, t.from_key AS node, 1 AS depth FROM s JOIN thin t ON t.to_key = s.seed UNION SELECT r.seed, t.from_key, r.depth + 1 FROM r JOIN thin t ON t.to_key = r.node WHERE r.depth < 3)
  SELECT seed, node, min(depth) AS depth FROM r GROUP BY 1, 2"""


def g8_impact_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the graph of few keys and many edges, each of them a hub."""
    return G.impact_spread(_seeds(spark, sf_dir), bound(spark, sf_dir, "relations"), 3)


G8B_SQL = with_ctes("relations").replace("WITH ", "WITH RECURSIVE ", 1) + """, s AS (SELECT DISTINCT concat('K', CAST(s_suppkey AS VARCHAR)) AS seed FROM supplier), t AS (SELECT DISTINCT from_key, to_key FROM relations),
  r AS (SELECT s.seed, t.from_key AS node, 1 AS depth FROM s JOIN t ON t.to_key = s.seed UNION SELECT r.seed, t.from_key, r.depth + 1 FROM r JOIN t ON t.to_key = r.node WHERE r.depth < 3)
  SELECT seed, node, min(depth) AS depth FROM r GROUP BY 1, 2"""


def g9_find_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of titled documents over name-derived edges: 实施条例 climb to their
    statute, which a document must carry."""
    docs = _titled(spark, sf_dir)
    return G.find_root(docs, G.hierarchy_edges(docs)).select("document_id", "root_key", "root_document_id", "missing_parent")


# Without cycles the deepest chain here is one step: name-derived parents are statutes' names.
G9_SQL = f"""WITH RECURSIVE x AS ({C5_SQL}), d AS (SELECT x.*, docs2.doc_type FROM x JOIN (SELECT doc_id AS document_id, CASE doc_id % 4 WHEN 0 THEN 'statute' WHEN 1 THEN 'regulation' WHEN 2 THEN 'ruling' ELSE 'announcement' END AS doc_type FROM documents) docs2 USING (document_id)),
  h AS (SELECT entity_key, min(document_id) AS document_id FROM d GROUP BY 1), e AS (SELECT DISTINCT entity_key AS a, coalesce(parent, title_parent) AS u FROM d WHERE coalesce(parent, title_parent) IS NOT NULL),
  n AS (SELECT a, u FROM (SELECT a, u, row_number() OVER (PARTITION BY a ORDER BY length(u) DESC, u DESC) AS r FROM e) y WHERE r = 1), s AS (SELECT n.a, n.u, h.document_id AS uid FROM n LEFT JOIN h ON h.entity_key = n.u),
  w AS (SELECT document_id, entity_key AS k, document_id AS root, 0 AS lvl, doc_type = 'statute' AS done, [entity_key] AS path FROM d UNION ALL SELECT w.document_id, s.u, s.uid, w.lvl + 1, false, list_append(w.path, s.u) FROM w JOIN s ON s.a = w.k AND s.uid IS NOT NULL AND NOT list_contains(w.path, s.u) WHERE NOT w.done AND w.lvl < 5),
  z AS (SELECT document_id, arg_max(k, lvl) AS k, arg_max(root, lvl) AS root, bool_or(done) AS done, max(lvl) AS lvl FROM w GROUP BY 1)
  SELECT z.document_id, z.k AS root_key, z.root AS root_document_id, CASE WHEN NOT z.done AND z.lvl < 5 AND s.uid IS NULL THEN s.u END AS missing_parent FROM z LEFT JOIN s ON s.a = z.k"""


def _few(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents with four articles each, and the sparse graph."""
    docs = _keyed(spark, sf_dir)
    prov = docs.select("document_id", "entity_key", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ordinal"))
    prov = prov.select("document_id", "ordinal", F.concat_ws("#", "entity_key", "ordinal").alias("node_key"))
    return docs, bound(spark, sf_dir, "thin"), prov


_FEW = _DOCS + """, fd AS (SELECT * FROM kd), fp AS (SELECT document_id, entity_key, concat(entity_key, '#', CAST(i AS VARCHAR)) AS node_key FROM fd CROSS JOIN (SELECT unnest(generate_series(0, 3)) AS i) g),
  sr AS (SELECT from_key, to_key AS target_key, min(CASE relation_type WHEN 'authority_of' THEN 0 ELSE 1 END) AS rank FROM thin WHERE split_part(from_key, '#', 1) <> split_part(to_key, '#', 1) GROUP BY 1, 2),
  sp AS (SELECT target_key, document_id, node_key, CASE min(rank) WHEN 0 THEN 'authority_of' ELSE 'interprets' END AS relation_type FROM (SELECT sr.target_key, fp.document_id, fp.node_key, sr.rank FROM sr JOIN fp ON fp.node_key = sr.from_key
    UNION ALL SELECT sr.target_key, fp.document_id, fp.node_key, sr.rank FROM sr JOIN fp ON fp.entity_key = sr.from_key) u GROUP BY 1, 2, 3)"""


def g10_supplements(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rel, prov = _few(spark, sf_dir)
    return G.supplements(docs, rel, prov)


G10_SQL = with_ctes("docs", "thin") + f", {_FEW} SELECT target_key, document_id, node_key, relation_type FROM sp"


def g11_consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statutes only are roots here, so the root step is the identity."""
    docs, rel, prov = _few(spark, sf_dir)
    view = G.consolidated_view(docs.withColumn("doc_type", F.lit("statute")), rel, prov)
    return view.groupBy("document_id", "kind").agg(F.count("*").alias("n"), F.countDistinct("source_key").alias("sources"))


G11_SQL = with_ctes("docs", "thin") + f""", {_FEW}, {_EDGES}, an AS (SELECT a.document_id, a.node_key, sp.node_key AS source_key FROM fp a JOIN sp ON sp.target_key = a.node_key), us AS (SELECT DISTINCT document_id, source_key FROM an),
  v AS (SELECT document_id, 'article' AS kind, NULL AS source_key FROM fp UNION ALL SELECT document_id, 'supplement', source_key FROM an
    UNION ALL SELECT f.document_id, 'unanchored', sp.node_key FROM fd f JOIN sp ON sp.target_key = f.entity_key WHERE NOT EXISTS (SELECT 1 FROM us WHERE us.document_id = f.document_id AND us.source_key = sp.node_key)
    UNION ALL SELECT f.document_id, 'child_provision', p.node_key FROM de JOIN fd f ON f.entity_key = de.to_key JOIN fp p ON p.entity_key = de.from_key WHERE NOT EXISTS (SELECT 1 FROM us WHERE us.document_id = f.document_id AND us.source_key = p.node_key))
  SELECT document_id, kind, count(*) AS n, count(DISTINCT source_key) AS sources FROM v GROUP BY 1, 2"""


def g12_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.document_forest(_titled(spark, sf_dir))
    return out.select("document_id", "entity_key", F.col("depth").cast("int").alias("depth"), F.array_join("path", " > ").alias("path"), "child_count", "position")


G12_SQL = f"""WITH RECURSIVE x AS ({C5_SQL}), d AS (SELECT document_id, entity_key, parent, title_parent FROM (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY document_id DESC) AS r FROM x) y WHERE r = 1),
  t AS (SELECT doc_id AS document_id, t.title FROM documents JOIN (SELECT * FROM (VALUES {{titles}}) AS v(k, title)) t ON t.k = doc_id % 40),
  p AS (SELECT d.document_id, d.entity_key, t.title, CASE WHEN a.entity_key IS NOT NULL THEN nullif(d.parent, d.entity_key) WHEN b.entity_key IS NOT NULL THEN nullif(d.title_parent, d.entity_key) END AS parent FROM d JOIN t USING (document_id) LEFT JOIN d a ON a.entity_key = d.parent LEFT JOIN d b ON b.entity_key = d.title_parent),
  w AS (SELECT document_id, entity_key, 0 AS depth, title AS path FROM p WHERE parent IS NULL UNION ALL SELECT p.document_id, p.entity_key, w.depth + 1, concat(w.path, ' > ', p.title) FROM p JOIN w ON p.parent = w.entity_key)
  SELECT document_id, entity_key, depth, path, (SELECT count(*) FROM p WHERE p.parent = w.entity_key) AS child_count, row_number() OVER (ORDER BY string_split(path, ' > ')) - 1 AS position FROM w"""


def g12_deep_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as a forest: chains of 40, each hung on a document of an earlier chain."""
    docs = bound(spark, sf_dir, "docs")
    block = F.expr("document_id DIV 40")
    parent = F.when(F.col("document_id") % 40 > 0, F.col("document_id") - 1).when(block > 0, F.expr("(document_id DIV 40) DIV 3 * 40 + 5"))
    return number_forest(docs.select(F.col("document_id").alias("key"), parent.alias("parent"), "title"), ["title"])


G12B_SQL = with_ctes("docs").replace("WITH ", "WITH RECURSIVE ", 1) + """, p AS (SELECT document_id AS key, title, CASE WHEN document_id % 40 > 0 THEN document_id - 1 WHEN document_id // 40 > 0 THEN document_id // 40 // 3 * 40 + 5 END AS parent FROM docs),
  w AS (SELECT key, 0 AS depth, [concat(title, chr(1), lpad(CAST(key AS VARCHAR), 12, '0'))] AS path, [key] AS line FROM p WHERE parent IS NULL OR parent NOT IN (SELECT key FROM p)
    UNION ALL SELECT p.key, w.depth + 1, list_append(w.path, concat(p.title, chr(1), lpad(CAST(p.key AS VARCHAR), 12, '0'))), list_append(w.line, p.key) FROM p JOIN w ON p.parent = w.key),
  z AS (SELECT a AS key, count(*) AS size FROM (SELECT unnest(line) AS a FROM w) x GROUP BY 1), c AS (SELECT parent AS key, count(*) AS n FROM p GROUP BY 1)
  SELECT w.key, CAST(w.depth AS BIGINT) AS depth, z.size, coalesce(c.n, 0) AS child_count, row_number() OVER (ORDER BY w.path) - 1 AS position FROM w JOIN z ON z.key = w.key LEFT JOIN c ON c.key = w.key"""


def _forest_sql() -> str:
    from lexlake.plans.bindings import TITLES

    return G12_SQL.replace("{titles}", ", ".join(f"({i}, '{t}')" for i, t in enumerate(TITLES)))


def g13_graph_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.graph_audit(bound(spark, sf_dir, "edges"))


G13_SQL = with_ctes("edges") + """SELECT relation_type, count(*) AS edges, count(*) FILTER (contains(to_key, '#')) AS to_articles, count(*) FILTER (NOT contains(to_key, '#')) AS to_documents,
  count(DISTINCT from_key) AS sources, count(DISTINCT to_key) AS targets FROM edges GROUP BY 1"""


def g13_document_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.document_edges(_keyed(spark, sf_dir), bound(spark, sf_dir, "edges"))


G13B_SQL = with_ctes("docs", "edges") + f""", {_DOCS}, o AS (SELECT {_STEM.format("from_key")} AS k, count(*) AS n FROM edges GROUP BY 1), i AS (SELECT {_STEM.format("to_key")} AS k, count(*) AS n FROM edges GROUP BY 1)
  SELECT document_id, entity_key, coalesce(o.n, 0) AS outbound, coalesce(i.n, 0) AS inbound FROM kd LEFT JOIN o ON o.k = entity_key LEFT JOIN i ON i.k = entity_key"""


def g13_shared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.shared_keys(_keyed(spark, sf_dir))


G13C_SQL = with_ctes("docs") + f", {_DOCS} SELECT entity_key, count(*) AS documents FROM kd GROUP BY 1 HAVING count(*) > 1"

def g13_term_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a line that holds a word; every other one is keyed like the edges."""
    docs = bound(spark, sf_dir, "docs").withColumn("entity_key", F.concat(F.when(F.col("document_id") % 2 == 0, "K").otherwise("X"), (F.col("document_id") % 2000).cast("string")))
    return G.documents_with_term(docs, bound(spark, sf_dir, "prov").withColumnRenamed("snapshot_id", "document_id"), bound(spark, sf_dir, "edges"), "the")


G13D_SQL = with_ctes("docs", "prov", "edges") + f""", k AS (SELECT document_id, doc_type, concat(CASE WHEN document_id % 2 = 0 THEN 'K' ELSE 'X' END, CAST(document_id % 2000 AS VARCHAR)) AS entity_key FROM docs),
  o AS (SELECT {_STEM.format("from_key")} AS k, count(*) AS n FROM edges GROUP BY 1), i AS (SELECT DISTINCT {_STEM.format("to_key")} AS k FROM edges), p AS (SELECT snapshot_id, count(*) AS n FROM prov WHERE contains(text, 'the') GROUP BY 1)
  SELECT k.document_id, k.doc_type, p.n AS provisions, o.n IS NOT NULL OR i.k IS NOT NULL AS known, coalesce(o.n, 0) AS outbound FROM p JOIN k ON k.document_id = p.snapshot_id LEFT JOIN o ON o.k = entity_key LEFT JOIN i ON i.k = entity_key"""

QUERIES = {
    "g13_term_documents": g13_term_documents,
    "g1_citation_edges": g1_citation_edges, "g2_hierarchy_edges": g2_hierarchy_edges, "g3_declared_authority": g3_declared_authority, "g4_merge_relations": g4_merge_relations, "g5_build_entities": g5_build_entities, "g6_family": g6_family,
    "g7_entity_context": g7_entity_context, "g8_impact_spread": g8_impact_spread, "g8_impact_hubs": g8_impact_hubs, "g9_find_root": g9_find_root, "g10_supplements": g10_supplements, "g11_consolidated": g11_consolidated, "g12_forest": g12_forest, "g12_deep_forest": g12_deep_forest,
    "g13_graph_audit": g13_graph_audit, "g13_document_edges": g13_document_edges, "g13_shared_keys": g13_shared_keys,
}
ORACLES = {
    "g13_term_documents": G13D_SQL,
    "g1_citation_edges": G1_SQL, "g2_hierarchy_edges": G2_SQL, "g3_declared_authority": G3_SQL, "g4_merge_relations": G4_SQL, "g5_build_entities": G5_SQL, "g6_family": G6_SQL, "g7_entity_context": G7_SQL, "g8_impact_spread": G8_SQL, "g8_impact_hubs": G8B_SQL,
    "g9_find_root": G9_SQL, "g10_supplements": G10_SQL, "g11_consolidated": G11_SQL, "g12_forest": _forest_sql(), "g12_deep_forest": G12B_SQL, "g13_graph_audit": G13_SQL, "g13_document_edges": G13B_SQL, "g13_shared_keys": G13C_SQL,
}
