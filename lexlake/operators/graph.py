"""The legal relation graph.

  relations  from_key, to_key, relation_type, confidence, evidence_text, seq
  entities   entity_key, entity_type, canonical_title, current_document_id
  documents  document_id, title, doc_type, external_id (and entity_key where stated)
  provisions snapshot_id, document_id, ordinal, node_key, heading, text
A key with '#' names an article, one without a document.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexlake import refdata as R
from lexlake.functions.citations import extract_citations
from lexlake.functions.text import document_stem, entity_type, norm_key, parent_from_title, parent_key
from lexlake.operators.forest import number_forest
from lexlake.shared import shared_dir


def _checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a loop in the folder of spark.checkpoint.dir."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _stored(df: DataFrame) -> DataFrame:
    """What is read several times, from Parquet in the folder of spark.checkpoint.dir."""
    path = f"{shared_dir(df.sparkSession)}/edges-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def document_entity_key(documents: DataFrame, provisions: DataFrame) -> DataFrame:
    """C4. documents with entity_key: the stem of the first keyed provision,
    else the normalised title, else the external id."""
    stem = F.trim(document_stem(F.col("node_key")))
    first = provisions.withColumn("stem", stem).where("stem <> ''").groupBy("document_id").agg(F.min_by("stem", "ordinal").alias("stem"))
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    return documents.join(first, "document_id", "left").withColumn("entity_key", norm_key(F.coalesce("stem", blank("title"), "external_id"))).drop("stem")


def citation_edges(provisions: DataFrame, documents: DataFrame) -> DataFrame:
    """G1. Edges from every provision to what it cites; 本法 and 本條例 are
    resolved by the document's parent and own key (documents with entity_key)."""
    context = documents.select("document_id", F.col("entity_key").alias("own"), parent_key(F.col("entity_key")).alias("parent"))
    cited = provisions.join(context, "document_id").withColumn("c", F.explode(extract_citations("text", "parent", "own")))
    return cited.select(
        norm_key(F.col("node_key")).alias("from_key"), norm_key(F.col("c.entity_key")).alias("to_key"), F.col("c.relation_type").alias("relation_type"),
        F.col("c.confidence").alias("confidence"), F.col("c.raw_text").alias("evidence_text"), F.xxhash64("snapshot_id", "ordinal").alias("seq"),
    )


def hierarchy_edges(documents: DataFrame) -> DataFrame:
    """G2. authority_of edges that titles and names imply, confidence 1."""
    parent = F.coalesce(parent_key(F.col("entity_key")), parent_from_title(F.col("title"), F.col("doc_type")))
    rows = documents.select(F.col("entity_key").alias("from_key"), norm_key(parent).alias("to_key"), "title", F.col("document_id").alias("seq")).where("to_key is not null")
    return rows.select("from_key", "to_key", F.lit("authority_of").alias("relation_type"), F.lit(1.0).alias("confidence"), F.col("title").alias("evidence_text"), "seq")


#: A document declares its authority in its opening provisions.
OPENING = 3


def declared_authority(documents: DataFrame, provisions: DataFrame) -> DataFrame:
    """G3. authority_of citations of the first three provisions of non-statutes,
    raised to document level (0.8), without itself, each parent once."""
    w = Window.partitionBy("document_id").orderBy("ordinal")
    opening = provisions.withColumn("r", F.row_number().over(w)).where(F.col("r") <= OPENING)
    docs = documents.where("doc_type <> 'statute'").select("document_id", "entity_key")
    none = F.lit(None).cast("string")
    cited = opening.join(docs, "document_id").withColumn("c", F.explode(extract_citations("text", none, "entity_key"))).where("c.relation_type = 'authority_of'")
    rows = cited.select("document_id", F.col("entity_key").alias("from_key"), document_stem(norm_key(F.col("c.entity_key"))).alias("to_key"), "r", F.col("c.raw_text").alias("evidence_text"))
    rows = rows.where("to_key <> '' and to_key <> from_key").groupBy("document_id", "from_key", "to_key").agg(F.min_by("evidence_text", "r").alias("evidence_text"))
    return rows.select("from_key", "to_key", F.lit("authority_of").alias("relation_type"), F.lit(0.8).alias("confidence"), "evidence_text", F.col("document_id").alias("seq"))


def merge_relations(*edges: DataFrame) -> DataFrame:
    """G4. One edge for each (from, to, type): the highest confidence, on a tie
    the first by seq. Combined before the shuffle, so hubs don't matter."""
    rows = edges[0]
    for more in edges[1:]:
        rows = rows.unionByName(more)
    best = F.min_by(F.struct("confidence", "evidence_text", "seq"), F.struct((-F.col("confidence")).alias("c"), "seq", "evidence_text")).alias("e")
    return rows.groupBy("from_key", "to_key", "relation_type").agg(best).select("from_key", "to_key", "relation_type", "e.*")


def build_entities(relations: DataFrame, documents: DataFrame) -> DataFrame:
    """G5. Every key that an edge or a document names: type from the key's
    shape, the document's title (else the key) and the current document."""
    none = F.lit(None).cast("string")
    ends = relations.select(F.explode(F.array("from_key", "to_key")).alias("k")).select(norm_key(F.col("k")).alias("entity_key"), none.alias("title"), F.lit(None).cast("long").alias("document_id"))
    own = documents.select(norm_key(F.col("entity_key")).alias("entity_key"), "title", "document_id")
    rows = ends.union(own).groupBy("entity_key").agg(F.min_by("title", "document_id").alias("title"), F.max("document_id").alias("current_document_id"))
    return rows.select("entity_key", entity_type(F.col("entity_key")).alias("entity_type"), F.coalesce("title", "entity_key").alias("canonical_title"), "current_document_id")


def _document_level(relations: DataFrame) -> DataFrame:
    plain = ~F.col("from_key").contains("#") & ~F.col("to_key").contains("#")
    return relations.where((F.col("relation_type") == "authority_of") & plain).select("from_key", "to_key").distinct()


def family(relations: DataFrame, keys: DataFrame) -> DataFrame:
    """G6. keys (entity_key) with the document-level parents and children."""
    edges = _document_level(relations)
    up = edges.groupBy(F.col("from_key").alias("stem")).agg(F.sort_array(F.collect_set("to_key")).alias("parents"))
    down = edges.groupBy(F.col("to_key").alias("stem")).agg(F.sort_array(F.collect_set("from_key")).alias("children"))
    none = F.array().cast("array<string>")
    out = keys.withColumn("stem", document_stem(norm_key(F.col("entity_key")))).join(up, "stem", "left").join(down, "stem", "left")
    return out.withColumns({"parents": F.coalesce("parents", none), "children": F.coalesce("children", none)}).drop("stem")


#: The roles of G7.
ROLES = ("parent_law", "child", "sibling", "parent_document", "child_document")


def entity_context(keys: DataFrame, relations: DataFrame, roles: tuple[str, ...] = ROLES) -> DataFrame:
    """G7. (entity_key, role, other) of the named roles: parent_law, child, sibling
    (through any shared parent), parent_document and child_document; an article
    inherits its document's family. Siblings are made for the asked keys alone.

    Keys and edges are stored once, each combined; then only siblings can be found
    twice."""
    k = _stored(keys.select("entity_key").distinct().select(norm_key(F.col("entity_key")).alias("entity_key")).distinct())
    named = F.col("relation_type").isin(*R.IMPLEMENTING)
    plain = ~F.col("from_key").contains("#") & ~F.col("to_key").contains("#")
    edges = relations.groupBy("from_key", "to_key").agg(F.coalesce(F.bool_or(named), F.lit(False)).alias("named"), F.coalesce(F.bool_or((F.col("relation_type") == "authority_of") & plain), F.lit(False)).alias("document"))
    edges = _stored(edges)
    rel, docs = edges.where("named").select("from_key", "to_key"), edges.where("document").select("from_key", "to_key")
    found = {}
    if "parent_law" in roles or "sibling" in roles:
        parents = k.join(rel, k["entity_key"] == rel["from_key"]).select("entity_key", F.col("to_key").alias("other"))
        found["parent_law"] = parents
    if "sibling" in roles:
        shared = parents.withColumnRenamed("other", "to_key").join(edges.select("from_key", "to_key"), "to_key").where("from_key <> entity_key")
        found["sibling"] = shared.select("entity_key", F.col("from_key").alias("other")).distinct()
    if "child" in roles:
        found["child"] = k.join(rel, k["entity_key"] == rel["to_key"]).select("entity_key", F.col("from_key").alias("other"))
    stems = k.withColumn("stem", document_stem(F.col("entity_key")))
    if "parent_document" in roles:
        found["parent_document"] = stems.join(docs, stems["stem"] == docs["from_key"]).select("entity_key", F.col("to_key").alias("other"))
    if "child_document" in roles:
        found["child_document"] = stems.join(docs, stems["stem"] == docs["to_key"]).select("entity_key", F.col("from_key").alias("other"))
    return reduce(DataFrame.union, [found[r].select("entity_key", F.lit(r).alias("role"), "other") for r in roles])


#: Seeds that are followed together, one a bit of a long.
SEEDS = 64


def impact_spread(seeds: DataFrame, relations: DataFrame, max_depth: int = 3) -> DataFrame:
    """G8. (seed, node, depth): everything that reaches a seed in at most
    ``max_depth`` reverse hops, at its least depth. The seed itself is listed
    only through a cycle; a null seed reaches nothing.

    Seeds go in blocks of 64, each a bit. A row is a node and a block with the
    bits of the seeds that it reaches; a hop combines them by OR before and after
    the shuffle, so a hub's row stands for 64 seeds. Pairs are only made for the
    result.
    """
    edges = _checkpointed(relations.select(F.col("to_key").alias("at"), F.col("from_key").alias("node")).distinct())
    # Row numbers within a partition are dense, so blocks are full but for the last of each.
    numbered = seeds.select("seed").where("seed is not null").distinct().select("seed", F.monotonically_increasing_id().alias("i"))
    numbered = _checkpointed(numbered.select("seed", F.shiftright("i", 6).alias("block"), (F.col("i") % SEEDS).cast("int").alias("bit")))
    mask = F.expr("shiftleft(1L, bit)")
    frontier = numbered.groupBy(F.col("seed").alias("at"), "block").agg(F.bit_or(mask).alias("bits"))
    seen, found = None, None
    for depth in range(1, max_depth + 1):
        reached = frontier.join(edges, "at").groupBy("node", "block").agg(F.bit_or("bits").alias("bits"))
        if seen is not None:
            reached = reached.join(seen.withColumnRenamed("bits", "old"), ["node", "block"], "left")
            reached = reached.select("node", "block", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long")))).alias("bits")).where("bits <> 0")
        reached = _checkpointed(reached)
        if reached.isEmpty():
            break
        level = reached.withColumn("depth", F.lit(depth))
        found = level if found is None else found.union(level)
        seen = reached if seen is None else _checkpointed(seen.union(reached).groupBy("node", "block").agg(F.bit_or("bits").alias("bits")))
        frontier = reached.withColumnRenamed("node", "at")
    if found is None:
        return numbered.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")).where("false")
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(SEEDS - 1)), lambda i: F.getbit("bits", i) == 1)
    return found.select("node", "block", "depth", F.explode(set_bits).alias("bit")).join(numbered, ["block", "bit"]).select("seed", "node", "depth")


def _affinity(parent: Column, title: Column) -> Column:
    """Length of the parent's name without suffix if the child's title holds it."""
    stem = parent
    for suffix in reversed(R.NAME_SUFFIXES):
        cut = parent.endswith(suffix) & (F.length(parent) > len(suffix) + 1)
        stem = F.when(cut, F.substring(parent, F.lit(1), F.length(parent) - len(suffix))).otherwise(stem)
    return F.when(title.contains(stem), F.length(stem)).otherwise(0)


#: Levels that a document is followed up to its statute.
LEVELS = 5


def find_root(documents: DataFrame, relations: DataFrame) -> DataFrame:
    """G9. document_id → root_key, root_document_id, missing_parent. A statute is
    its own root. Others climb to the closest parent (the one whose name their
    title carries, then the longer name), at most five levels; a parent without
    a document ends the climb and is reported."""
    docs = documents.select("document_id", "entity_key", "title", "doc_type")
    have = docs.groupBy("entity_key").agg(F.min("document_id").alias("document_id"))
    edges = _document_level(relations)
    rows = docs.select("document_id", F.col("entity_key").alias("at"), "title", (F.col("doc_type") == "statute").alias("done"))
    rows = rows.withColumns({"root_document_id": F.col("document_id"), "missing_parent": F.lit(None).cast("string"), "path": F.array("at")})
    # One step for every document that can be climbed from: its closest parent.
    up = docs.join(edges, docs["entity_key"] == edges["from_key"]).select(docs["entity_key"].alias("at"), docs["title"].alias("of"), F.col("to_key").alias("up"))
    closest = up.groupBy("at").agg(F.max_by("up", F.struct(_affinity(F.col("up"), F.col("of")), F.length("up"), "up")).alias("up"))
    derived = docs.select(F.col("entity_key").alias("at"), parent_key(F.col("entity_key")).alias("derived")).distinct()
    step = derived.join(closest, "at", "full_outer").select("at", F.coalesce("up", "derived").alias("up")).where("up is not null")
    step = _checkpointed(step.join(have.select(F.col("entity_key").alias("up"), F.col("document_id").alias("up_id")), "up", "left"))
    for _ in range(LEVELS):
        rows = rows.join(step, "at", "left")
        climbs = ~F.col("done") & F.col("up_id").isNotNull() & ~F.array_contains("path", F.col("up"))
        lost = ~F.col("done") & F.col("up").isNotNull() & F.col("up_id").isNull()
        climbs, lost = F.coalesce(climbs, F.lit(False)), F.coalesce(lost, F.lit(False))
        rows = rows.select(
            "document_id", "title", F.when(climbs, F.col("up")).otherwise(F.col("at")).alias("at"), (~climbs).alias("done"),
            F.when(climbs, F.col("up_id")).otherwise(F.col("root_document_id")).alias("root_document_id"),
            F.when(lost, F.col("up")).otherwise(F.col("missing_parent")).alias("missing_parent"),
            F.when(climbs, F.array_append("path", F.col("up"))).otherwise(F.col("path")).alias("path"),
        )
    return rows.select("document_id", F.col("at").alias("root_key"), "root_document_id", "missing_parent")


def supplements(documents: DataFrame, relations: DataFrame, provisions: DataFrame) -> DataFrame:
    """G10. (target_key, document_id, node_key, relation_type): provisions that
    point at a document or its article by authority_of or interprets, not its
    own. The strongest relation counts; a source that is a whole document
    stands for all its provisions. provisions: of each document's latest version.
    """
    rel = relations.where(F.col("relation_type").isin(*R.IMPLEMENTING)).where(document_stem(F.col("from_key")) != document_stem(F.col("to_key")))
    rank = F.when(F.col("relation_type") == "authority_of", 0).otherwise(1)
    rel = rel.groupBy("from_key", F.col("to_key").alias("target_key")).agg(F.min(rank).alias("rank"))
    nodes = provisions.join(documents.select("document_id", "entity_key"), "document_id").select("document_id", "entity_key", "node_key", norm_key(F.col("node_key")).alias("key"))
    by_article = rel.where(F.col("from_key").contains("#")).join(nodes, F.col("from_key") == F.col("key"))
    by_document = rel.where(~F.col("from_key").contains("#")).join(nodes, F.col("from_key") == F.col("entity_key"))
    both = by_article.select("target_key", "document_id", "node_key", "rank").union(by_document.select("target_key", "document_id", "node_key", "rank"))
    best = both.groupBy("target_key", "document_id", "node_key").agg(F.min("rank").alias("rank"))
    return best.withColumn("relation_type", F.when(F.col("rank") == 0, "authority_of").otherwise("interprets")).drop("rank")


def consolidated_view(documents: DataFrame, relations: DataFrame, provisions: DataFrame) -> DataFrame:
    """G11. For each document that is its own root: kind (article, supplement,
    unanchored, child_provision), node_key, source_node_key, source_document_id,
    relation. Articles come with the provisions that implement them; those that
    point at the document as a whole, and the remaining provisions of its
    children, are listed without an anchor."""
    roots = find_root(documents, relations).where("document_id = root_document_id").select("document_id", F.col("root_key"))
    nodes = provisions.select("document_id", "node_key", norm_key(F.col("node_key")).alias("key"))
    articles = roots.join(nodes, "document_id")
    none, no_id = F.lit(None).cast("string"), F.lit(None).cast("long")
    supp = _checkpointed(supplements(documents, relations, provisions).select("target_key", F.col("document_id").alias("source_id"), F.col("node_key").alias("source_key"), "relation_type"))
    anchored = articles.join(supp, articles["key"] == supp["target_key"]).select("document_id", "node_key", "source_key", "source_id", "relation_type")
    used = anchored.select("document_id", "source_key").distinct()
    loose = roots.join(supp, roots["root_key"] == supp["target_key"]).join(used, ["document_id", "source_key"], "left_anti").select("document_id", none.alias("node_key"), "source_key", "source_id", "relation_type")
    child = _document_level(relations).join(roots, F.col("to_key") == F.col("root_key")).select(F.col("document_id"), F.col("from_key").alias("entity_key"))
    child = child.join(documents.select(F.col("document_id").alias("source_id"), "entity_key"), "entity_key")
    child = child.join(provisions.select(F.col("document_id").alias("source_id"), F.col("node_key").alias("source_key")), "source_id")
    child = child.join(used, ["document_id", "source_key"], "left_anti").select("document_id", none.alias("node_key"), "source_key", "source_id", F.lit("child_provision").alias("relation_type"))
    kind = lambda df, name: df.select("document_id", F.lit(name).alias("kind"), "node_key", "source_key", "source_id", "relation_type")
    own = articles.select("document_id", "node_key", none.alias("source_key"), no_id.alias("source_id"), none.alias("relation_type"))
    return kind(own, "article").union(kind(anchored, "supplement")).union(kind(loose, "unanchored")).union(kind(child, "child_provision"))


def document_forest(documents: DataFrame) -> DataFrame:
    """G12. documents (document_id, entity_key, title, doc_type), one a key (the
    latest id), with depth, child_count, position (pre-order, from 0; siblings by
    title) and path (titles from the root). Only parents that are in the list
    count; the depth has no bound."""
    docs = documents.where("entity_key is not null").groupBy("entity_key").agg(F.max_by(F.struct("document_id", "title", "doc_type"), "document_id").alias("d")).select("entity_key", "d.*")
    named, titled = parent_key(F.col("entity_key")), norm_key(parent_from_title(F.col("title"), F.col("doc_type")))
    rows = docs.withColumns({"a": named, "b": titled})
    keys = docs.select(F.col("entity_key").alias("p"))
    rows = rows.join(keys.withColumnRenamed("p", "a").withColumn("has_a", F.lit(True)), "a", "left").join(keys.withColumnRenamed("p", "b").withColumn("has_b", F.lit(True)), "b", "left")
    parent = F.when(F.col("has_a"), F.col("a")).when(F.col("has_b"), F.col("b"))
    rows = _checkpointed(rows.select("document_id", F.col("entity_key").alias("key"), "title", parent.alias("parent")))
    placed = number_forest(rows, ["title"], "title")
    return placed.join(rows.select("key", "document_id", "title"), "key").select("document_id", F.col("key").alias("entity_key"), "title", "depth", "child_count", "position", "path")


def graph_audit(relations: DataFrame) -> DataFrame:
    """G13. Per relation type: edges, targets that are articles or documents,
    distinct ends."""
    article = F.col("to_key").contains("#")
    return relations.groupBy("relation_type").agg(
        F.count("*").alias("edges"), F.count_if(article).alias("to_articles"), F.count_if(~article).alias("to_documents"),
        F.countDistinct("from_key").alias("sources"), F.countDistinct("to_key").alias("targets"),
    )


def shared_keys(documents: DataFrame) -> DataFrame:
    """G13. Entity keys that several documents claim."""
    return documents.groupBy("entity_key").agg(F.countDistinct("document_id").alias("documents")).where("documents > 1")


def document_edges(documents: DataFrame, relations: DataFrame) -> DataFrame:
    """G13. Inbound and outbound edges of each document, its articles included."""
    rel = relations.select(document_stem(F.col("from_key")).alias("a"), document_stem(F.col("to_key")).alias("b"))
    out = rel.groupBy(F.col("a").alias("entity_key")).agg(F.count("*").alias("outbound"))
    into = rel.groupBy(F.col("b").alias("entity_key")).agg(F.count("*").alias("inbound"))
    docs = documents.select("document_id", "entity_key")
    return docs.join(out, "entity_key", "left").join(into, "entity_key", "left").na.fill(0, ["outbound", "inbound"])


def documents_with_term(documents: DataFrame, provisions: DataFrame, relations: DataFrame, term: str) -> DataFrame:
    """G13. Documents of which a provision holds the term (as it stands): the
    provisions that do, whether the graph knows the document, and its outbound
    edges, its articles' included."""
    held = provisions.where(F.contains("text", F.lit(term))).groupBy("document_id").agg(F.count("*").alias("provisions"))
    rows = held.join(documents.select("document_id", "doc_type", "entity_key"), "document_id")
    out = relations.groupBy(document_stem(F.col("from_key")).alias("entity_key")).agg(F.count("*").alias("outbound"))
    into = relations.select(document_stem(F.col("to_key")).alias("entity_key")).distinct().withColumn("named", F.lit(True))
    rows = rows.join(out, "entity_key", "left").join(into, "entity_key", "left")
    known = F.coalesce("named", F.lit(False)) | F.col("outbound").isNotNull()
    return rows.select("document_id", "doc_type", "provisions", known.alias("known"), F.coalesce("outbound", F.lit(0)).alias("outbound"))
