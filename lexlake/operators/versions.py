"""Documents, their versions and the diffs between versions.

Tables (see each function for the columns it reads):
  documents  document_id, source_key, external_id, doc_type, title, url, issued_at
  snapshots  snapshot_id, document_id, fetched_at, issued_at, content_hash
  provisions snapshot_id, ordinal, node_key, heading, text
Change detection goes by fetch time; every reading view goes by
(coalesce(issued_at, fetched_at), snapshot_id).
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexlake.functions.similarity import similarity, unified_diff
from lexlake.functions.text import norm_key, parent_key, severity
from lexlake.operators import timeline
from lexlake.operators.renumber import checkpointed, match_renumbered
from lexlake.shared import shared_dir


def dated_at() -> Column:
    return F.coalesce("issued_at", "fetched_at")


def upsert_documents(documents: DataFrame, refs: DataFrame) -> DataFrame:
    """V1. Refs are matched on (source_key, external_id), else on (source_key,
    title), which re-keys the document. Non-empty title, url and date and the
    type overwrite; an unknown type becomes statute. Several refs of one key:
    the last by title counts. New refs get the hash of their key as id."""
    keys = ["source_key", "external_id"]
    latest = Window.partitionBy(*keys).orderBy(F.desc("title"), F.desc("url"))
    refs = refs.withColumn("r", F.row_number().over(latest)).where("r = 1").drop("r")
    typed = F.when(F.col("doc_type").isin("statute", "regulation", "ruling", "interpretation", "announcement"), F.col("doc_type")).otherwise("statute")
    refs = refs.select(*keys, *[F.col(c).alias(f"new_{c}") for c in ("title", "url", "issued_at")], typed.alias("new_type"))
    by_id = documents.select(*keys, "document_id")
    by_title = documents.groupBy("source_key", F.col("title").alias("new_title")).agg(F.min("document_id").alias("titled"))
    known = refs.join(by_id, keys, "left").join(by_title, ["source_key", "new_title"], "left")
    known = known.withColumn("target", F.coalesce("document_id", "titled")).withColumn("by_id", F.col("document_id").isNotNull()).drop("document_id", "titled")
    one = Window.partitionBy("target").orderBy(F.desc("by_id"), F.desc("external_id"))
    known = known.withColumn("r", F.when(F.col("target").isNull(), 1).otherwise(F.row_number().over(one))).where("r = 1").drop("r", "by_id")
    known = known.withColumnsRenamed({"external_id": "new_external", "source_key": "new_source"})
    merged = documents.join(known, documents["document_id"] == known["target"], "full_outer")
    filled = lambda new, old: F.coalesce(F.when(F.col(new) != "", F.col(new)), F.col(old), F.col(new))
    return merged.select(
        F.coalesce("document_id", F.xxhash64("new_source", "new_external")).alias("document_id"),
        F.coalesce("new_source", "source_key").alias("source_key"),
        F.coalesce("new_external", "external_id").alias("external_id"),
        F.coalesce("new_type", "doc_type").alias("doc_type"),
        filled("new_title", "title").alias("title"),
        filled("new_url", "url").alias("url"),
        F.coalesce("new_issued_at", "issued_at").alias("issued_at"),
    )


def detect_snapshots(incoming: DataFrame) -> DataFrame:
    """V3. The fetches (document_id, fetched_at, content_hash, …) that differ
    from the one before by fetch time: A, B, A gives three. A document's fetches
    are read in blocks, however many they are."""
    rows = timeline.in_blocks(incoming, "document_id", ["fetched_at", "snapshot_id"])
    rows = timeline.last_value(rows, "document_id", F.struct(F.col("content_hash").alias("hash")), "__before", own=False)
    is_new = F.col("__before").isNull() | ~F.col("__before.hash").eqNullSafe(F.col("content_hash"))
    return rows.where(is_new).select(*incoming.columns)


def _last_of_key(provisions: DataFrame, by: list[str]) -> DataFrame:
    """The last duplicate of a node key wins."""
    last = F.max_by(F.struct(*[c for c in provisions.columns if c not in by]), "ordinal").alias("v")
    return provisions.groupBy(*by).agg(last).select(*by, "v.*")


def diff_provisions(old: DataFrame, new: DataFrame, threshold: float | None = 0.9, with_diff: bool = True) -> DataFrame:
    """V4. Changes between two sets (pair_id, node_key, ordinal, heading, text):
    pair_id, node_key, change_type, old_/new_heading, old_/new_text, diff_text,
    similarity. Similarity is 0 for added and removed. Without a threshold no
    renumbering is looked for; without with_diff, diff_text is null and the
    similarity of modified rows is not computed (null)."""
    by = ["pair_id", "node_key"]
    a, b = _last_of_key(old, by), _last_of_key(new, by)
    joined = a.select(*by, F.struct("ordinal", "heading", "text").alias("o")).join(b.select(*by, F.struct("ordinal", "heading", "text").alias("n")), by, "full_outer")
    return _changes(joined.where(_DIFFERENT), threshold, with_diff)


_DIFFERENT = "o is null or n is null or not (o.text <=> n.text)"


def _changes(joined: DataFrame, threshold: float | None, with_diff: bool) -> DataFrame:
    """V4 of what differs: pair_id, node_key, o, n (ordinal, heading, text of each
    side) and columns of the pair, which are kept."""
    by = ["pair_id", "node_key"]
    kept = [c for c in joined.columns if c not in (*by, "o", "n")]
    texts = (F.col("o.text"), F.col("n.text"))
    fields = lambda kind, sim, diff, oh="o.heading": [
        *by, *kept, kind.alias("change_type"), F.expr(oh).alias("old_heading"), F.col("n.heading").alias("new_heading"), texts[0].alias("old_text"),
        texts[1].alias("new_text"), diff.cast("string").alias("diff_text"), sim.cast("double").alias("similarity"),
    ]
    none = F.lit(None)

    def by_key(rows: DataFrame) -> DataFrame:
        """Modified, removed and added rows, in one pass; only modified ones have texts to compare."""
        kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("modified")
        both = kind == "modified"
        x, y = (F.when(both, F.coalesce(t, F.lit(""))) for t in texts)
        said = F.when(kind == "removed", F.concat(F.lit("--- "), "node_key", F.lit("\n(entire provision removed)"))).when(kind == "added", F.concat(F.lit("+++ "), "node_key", F.lit("\n(new provision)")))
        sim = F.when(~both, 0.0).otherwise(similarity(x, y)) if with_diff else F.when(~both, 0.0)
        return rows.select(*fields(kind, sim, said.otherwise(unified_diff(x, y, F.col("node_key"))) if with_diff else said))

    if threshold is None:
        return by_key(joined)
    # What changed is read several times: it is stored once, so that the versions are joined once.
    path = f"{shared_dir(joined.sparkSession)}/changed-{uuid.uuid4().hex}"
    joined.write.parquet(path)
    joined = joined.sparkSession.read.parquet(path)
    removed, added = joined.where("n is null"), joined.where("o is null")
    flat = lambda df, side: df.select("pair_id", "node_key", f"{side}.ordinal", F.coalesce(F.col(f"{side}.text"), F.lit("")).alias("text"))
    moved = checkpointed(match_renumbered(flat(removed, "o"), flat(added, "n"), threshold))
    keyed = lambda side: moved.select("pair_id", F.col(f"{side}_key").alias("node_key"))
    left = removed.select("pair_id", *kept, F.col("node_key").alias("old_key"), "o").join(moved, ["pair_id", "old_key"])
    pairs = left.join(added.select("pair_id", F.col("node_key").alias("new_key"), "n"), ["pair_id", "new_key"]).withColumn("node_key", F.col("new_key"))
    diff = unified_diff(*texts, F.concat_ws(" → ", "old_key", "new_key")) if with_diff else none
    renumbered = pairs.select(*fields(F.lit("renumbered"), F.col("similarity"), diff, oh="concat(coalesce(o.heading, ''), ' (was ', old_key, ')')"))
    gone = removed.join(keyed("old"), by, "left_anti").unionByName(added.join(keyed("new"), by, "left_anti"))
    return by_key(joined.where("o is not null and n is not null")).union(by_key(gone)).union(renumbered)


def with_severity(diffs: DataFrame) -> DataFrame:
    """C17 on the rows of V4."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return diffs.withColumn("severity", severity(F.col("change_type"), blank("old_text"), blank("new_text"), F.col("similarity")))


def _consecutive(snapshots: DataFrame) -> DataFrame:
    rows = timeline.in_blocks(snapshots.select("document_id", "fetched_at", "snapshot_id"), "document_id", ["fetched_at", "snapshot_id"])
    rows = timeline.last_value(rows, "document_id", F.col("snapshot_id"), "from_snapshot_id", own=False)
    return rows.where("from_snapshot_id is not null").select("document_id", F.col("snapshot_id").alias("to_snapshot_id"), "from_snapshot_id")


def _pair_diff(pairs: DataFrame, provisions: DataFrame, threshold: float | None, with_diff: bool) -> DataFrame:
    """V4 for (pair_id, from_snapshot_id, to_snapshot_id)."""
    side = lambda c: pairs.select("pair_id", F.col(c).alias("snapshot_id")).join(provisions, "snapshot_id").drop("snapshot_id")
    return diff_provisions(side("from_snapshot_id"), side("to_snapshot_id"), threshold, with_diff)


def detect_changes(snapshots: DataFrame, provisions: DataFrame | None, threshold: float | None = 0.9, with_diff: bool = True, by: list[str] | None = None) -> DataFrame:
    """V8. Changes between each document's consecutive snapshots, with severity;
    the first snapshot yields none. Adds document_id, from_ and to_snapshot_id.

    Without ``provisions`` the snapshots hold their own (``lines``: ordinal,
    node_key, heading, text) and stand by ``by``, columns of the document: texts
    that are dealt by any of these columns are not shuffled."""
    if provisions is None:
        return _packed_changes(snapshots, threshold, with_diff, by or ["document_id"])
    pairs = _consecutive(snapshots).withColumn("pair_id", F.col("to_snapshot_id"))
    return with_severity(_pair_diff(pairs, provisions, threshold, with_diff)).join(pairs, "pair_id").drop("pair_id")


def _packed_changes(snapshots: DataFrame, threshold: float | None, with_diff: bool, by: list[str]) -> DataFrame:
    before = F.lag(F.struct("snapshot_id", "lines")).over(Window.partitionBy(*by).orderBy("fetched_at", "snapshot_id"))
    rows = snapshots.withColumn("before", before).where("before is not null")
    side = lambda lines, name: F.transform(lines, lambda x: F.struct(F.lit(name).alias("side"), x["node_key"].alias("node_key"), F.struct(*[x[c].alias(c) for c in ("ordinal", "heading", "text")]).alias("line")))
    rows = rows.select(*by, F.col("before.snapshot_id").alias("from_snapshot_id"), F.col("snapshot_id").alias("to_snapshot_id"), F.inline(F.concat(side(F.col("before.lines"), "o"), side(F.col("lines"), "n"))))
    # The last duplicate of a key wins; a line without a key meets no other side.
    of = [*by, "from_snapshot_id", "to_snapshot_id", "node_key"]
    last = [F.max_by("line", F.when(F.col("side") == name, F.struct("line.ordinal"))).alias(name) for name in ("o", "n")]
    joined = rows.groupBy(*of, F.when(F.col("node_key").isNull(), F.col("side")).alias("alone")).agg(*last).drop("alone")
    diffs = with_severity(_changes(joined.where(_DIFFERENT).withColumn("pair_id", F.col("to_snapshot_id")), threshold, with_diff))
    pair = ["document_id", "to_snapshot_id", "from_snapshot_id"]
    return diffs.select(*[c for c in diffs.columns if c not in ("pair_id", *by, *pair)], *pair)


def version_timeline(documents: DataFrame, snapshots: DataFrame, provisions: DataFrame, changes: DataFrame) -> DataFrame:
    """V9. One row a version: version (v1..), dated_at, official, provision and
    change counts, first and last crawl of the document."""
    rows = timeline.in_blocks(snapshots.withColumn("dated_at", dated_at()), "document_id", ["dated_at", "snapshot_id"])
    rows = timeline.place(rows, "document_id", "place")
    crawled = snapshots.groupBy("document_id").agg(F.min("fetched_at").alias("first_crawled"), F.max("fetched_at").alias("last_crawled"))
    rows = rows.withColumns({"version": F.concat(F.lit("v"), "place"), "official": F.col("issued_at").isNotNull()}).join(crawled, "document_id")
    n_provisions = provisions.groupBy("snapshot_id").agg(F.count("*").alias("n_provisions"))
    n_changes = changes.groupBy(F.col("to_snapshot_id").alias("snapshot_id")).agg(F.count("*").alias("n_changes"))
    rows = rows.join(documents.select("document_id", "title"), "document_id").join(n_provisions, "snapshot_id", "left").join(n_changes, "snapshot_id", "left")
    counts = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_provisions", "n_changes")}
    return rows.withColumns(counts).select(
        "document_id", "title", "version", "snapshot_id", "dated_at", "official", "n_provisions", "n_changes", "first_crawled", "last_crawled"
    )


def end_of_day(day: Column) -> Column:
    return F.date_trunc("day", day) + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND")


def snapshot_at(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """V10. For (request_id, document_id, day): the snapshot in force at the end
    of that day, null where the document had none yet.

    Versions and requests of a document are sorted together by time, in blocks,
    and each request takes the last version before it: linear, where a range join
    would pair every request with every earlier version."""
    versions = snapshots.select("document_id", dated_at().alias("at"), F.lit(0).alias("kind"), F.struct("snapshot_id", dated_at().alias("dated_at")).alias("v"), F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"), F.lit(None).cast("timestamp").alias("day"))
    asked = requests.select("document_id", end_of_day(F.col("day")).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(versions.schema["v"].dataType).alias("v"), "request_id", "day")
    rows = timeline.in_blocks(versions.union(asked), "document_id", ["at", "kind", F.col("v.snapshot_id")])
    rows = timeline.last_value(rows, "document_id", F.col("v"), "in_force", own=True).where("kind = 1")
    return rows.select("request_id", "document_id", "day", "in_force.snapshot_id", "in_force.dated_at")


def version_at(requests: DataFrame, snapshots: DataFrame, provisions: DataFrame) -> DataFrame:
    """V10 with the provisions of that version; requests before the first
    version keep one row without a provision."""
    return snapshot_at(requests, snapshots).join(provisions, "snapshot_id", "left")


def diff_between(requests: DataFrame, snapshots: DataFrame, provisions: DataFrame, threshold: float | None = 0.9) -> DataFrame:
    """V11. For (request_id, document_id, day_from, day_to): counts of each
    change type and ``unchanged``; found is false if either day has no version."""
    at = lambda day, name: snapshot_at(requests.select("request_id", "document_id", F.col(day).alias("day")), snapshots).select("request_id", F.col("snapshot_id").alias(name))
    pairs = at("day_from", "from_snapshot_id").join(at("day_to", "to_snapshot_id"), "request_id").withColumn("pair_id", F.col("request_id"))
    kinds = ["added", "removed", "modified", "renumbered"]
    differing = pairs.where("from_snapshot_id <> to_snapshot_id")
    counts = _pair_diff(differing, provisions, threshold, with_diff=False).groupBy("pair_id").pivot("change_type", kinds).count()
    out = pairs.join(counts, "pair_id", "left").na.fill(0, kinds)
    total = sum((F.col(k) for k in kinds[1:]), F.col(kinds[0]))
    found = F.col("from_snapshot_id").isNotNull() & F.col("to_snapshot_id").isNotNull()
    return out.select("request_id", found.alias("found"), *kinds, (found & (total == 0)).alias("unchanged"))


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """document_id, snapshot_id, dated_at of the version that reading views show."""
    best = snapshots.groupBy("document_id").agg(F.max(F.struct(dated_at().alias("dated_at"), "snapshot_id")).alias("v"))
    return best.select("document_id", "v.snapshot_id", "v.dated_at")


def list_documents(documents: DataFrame, snapshots: DataFrame, country: str | None = None, tax_key: str | None = None, limit: int | None = None) -> DataFrame:
    """V12. documents (with country, tax_key) → one row a title (the newest, then
    the least id), version count, latest dates; newest first. Filters come
    before the limit."""
    for name, value in (("country", country), ("tax_key", tax_key)):
        documents = documents.where(F.col(name) == value) if value else documents
    seen = snapshots.groupBy("document_id").agg(F.count("*").alias("n_versions"), F.max(dated_at()).alias("latest"), F.max("fetched_at").alias("last_crawled"))
    rows = documents.join(seen, "document_id", "left").na.fill(0, ["n_versions"])
    w = Window.partitionBy("title").orderBy(F.desc_nulls_last("latest"), "document_id")
    rows = rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    rows = rows.orderBy(F.desc_nulls_last("latest"), "document_id")
    return rows.limit(limit) if limit else rows


def statutes_for_tax(documents: DataFrame, country: str, tax_key: str) -> DataFrame:
    """V13. Statutes and regulations of one tax type (documents with country, tax_key)."""
    return documents.where((F.col("country") == country) & (F.col("tax_key") == tax_key) & F.col("doc_type").isin("statute", "regulation"))


#: Longest piece of a text that is looked up.
GRAM = 3


def _grams(text: Column, size: Column) -> Column:
    """Distinct pieces of that size; none of a shorter text."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size))))


def containing(queries: DataFrame, texts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(query, text) and the columns of ``by``: each text that contains a query
    and agrees with it in those columns. queries: query, texts: text, with them,
    each row once. Texts are indexed by their pieces of up to GRAM characters; a
    query meets only the texts that hold its rarest piece among those it agrees
    with, and those are verified. An empty query is contained in nothing."""
    by = by or []
    index = [texts.select(*by, F.explode(_grams(F.col("text"), F.lit(k))).alias("gram"), "text") for k in range(1, GRAM + 1)]
    index = reduce(DataFrame.union, index)
    asked = queries.where(F.length("query") > 0).withColumn("grams", _grams(F.col("query"), F.least(F.lit(GRAM), F.length("query"))))
    asked = asked.select(*by, "query", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    counted = asked.join(index.groupBy(*by, "gram").agg(F.count("*").alias("texts")), [*by, "gram"])
    # A query with a piece that no text has is contained in none.
    rarest = counted.groupBy(*by, "query").agg(F.min_by("gram", F.struct("texts", "gram")).alias("gram"), F.count("*").alias("found"), F.first("n").alias("n")).where("found = n")
    return rarest.select(*by, "query", "gram").join(index, [*by, "gram"]).where(F.contains("text", "query")).select(*by, "query", "text")


#: Levels that an implementing document is followed up by its name.
DESCENT = 4


def resolve_documents(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """V14. (query_id, query) → status, document_id, candidates, children: by
    ``external_id``, else exact ``title``, else the one document of the
    normalised ``name``, else by names that hold the query: if all of them are
    implementing documents of it (up to four levels), the law itself is missing
    (``parent_missing``; children: their titles, in order) and no document
    stands in for it; one document alone is the ``substring`` hit, several are
    ``ambiguous``; none is ``not_found``. Null and blank queries find nothing.

    Distinct names are searched for distinct wanted ones, and documents are
    counted by name before they are joined.
    """
    docs = documents.select("document_id", "external_id", "title", norm_key(F.col("title")).alias("key"))
    q = queries.select("query_id", "query", norm_key(F.col("query")).alias("wanted"))
    first = lambda column: docs.groupBy(F.col(column).alias("k")).agg(F.count("*").alias("n"), F.min("document_id").alias("document_id"), F.min("title").alias("title"))
    exact = lambda wanted, column, rank: q.join(first(column), q[wanted] == F.col("k")).select("query_id", F.lit(rank).alias("rank"), "n", "document_id")
    by_id, by_title = exact("query", "external_id", 1), exact("query", "title", 2)
    by_name = exact("wanted", "key", 3).where("n = 1")
    known = by_id.union(by_title).union(by_name)
    rest = q.join(known, "query_id", "left_anti").where(F.length("wanted") > 0)
    names = first("key").withColumnRenamed("k", "text").where("text is not null")
    hits = containing(rest.select(F.col("wanted").alias("query")).distinct(), names.select("text")).join(names, "text")
    up, child = F.col("text"), F.lit(False)
    for level in range(DESCENT):
        hits = hits.withColumn(f"up{level}", parent_key(up))
        up = F.col(f"up{level}")
        child = child | F.coalesce(up == F.col("query"), F.lit(False))
    titles = F.sort_array(F.collect_set(F.when(child, F.col("title"))))  # names of one law's implementing documents
    found = hits.groupBy(F.col("query").alias("wanted")).agg(F.sum("n").alias("candidates"), F.bool_and(child).alias("missing"), F.min("document_id").alias("only"), titles.alias("children"))
    found = rest.join(found, "wanted").select("query_id", "candidates", "missing", "only", "children")
    best = known.groupBy("query_id").agg(F.min_by("document_id", "rank").alias("document_id"), F.min("rank").alias("rank"))
    how = F.element_at(F.array(*map(F.lit, ("external_id", "title", "name"))), F.col("rank"))
    out = q.join(best, "query_id", "left").join(found, "query_id", "left").na.fill(0, ["candidates"])
    status = F.when(F.col("rank").isNotNull(), how).when(F.col("missing"), "parent_missing").when(F.col("candidates") == 1, "substring").when(F.col("candidates") > 1, "ambiguous").otherwise("not_found")
    out = out.withColumn("status", status)
    document = F.when(F.col("status") == "substring", F.col("only")).otherwise(F.col("document_id"))
    children = F.when(F.col("status") == "parent_missing", F.col("children")).otherwise(F.array().cast("array<string>"))
    return out.select("query_id", "status", document.alias("document_id"), F.col("candidates").cast("long").alias("candidates"), children.alias("children"))


def suggest_documents(queries: DataFrame, documents: DataFrame, limit: int = 5) -> DataFrame:
    """V15. query_id, rank, document_id: titles or ids that contain the query,
    the first ``limit`` by title; else any first ``limit`` documents. Distinct
    queries are searched in distinct titles, of which only the first ``limit``
    documents can be suggested."""
    docs = documents.select("document_id", "external_id", "title")
    asked = queries.select("query").where("query is not null").distinct()
    w = Window.partitionBy("title").orderBy("document_id")
    leading = docs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit).select(F.col("title").alias("text"), "document_id")
    text = lambda column: docs.select(F.col(column).alias("text")).where("text is not null").distinct()
    by_title = containing(asked, text("title")).join(leading, "text").select("query", F.col("text").alias("title"), "document_id")
    by_id = containing(asked, text("external_id")).join(docs.withColumnRenamed("external_id", "text"), "text").select("query", "title", "document_id")
    w = Window.partitionBy("query").orderBy("title", "document_id")
    hits = by_title.union(by_id).distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    ranked = queries.select("query_id", "query").join(hits, "query").select("query_id", "rank", "document_id")
    first = docs.orderBy("title", "document_id").limit(limit)
    first = first.withColumn("rank", F.row_number().over(Window.orderBy("title", "document_id"))).select("rank", "document_id")
    bare = queries.join(hits.select("query").distinct(), "query", "left_anti").select("query_id").crossJoin(F.broadcast(first))  # ``limit`` rows
    return ranked.union(bare)


def change_texts(changes: DataFrame, provisions: DataFrame) -> DataFrame:
    """V16. changes with old_text and new_text of their provision."""
    one = _last_of_key(provisions.select("snapshot_id", "node_key", "ordinal", "text"), ["snapshot_id", "node_key"])
    side = lambda snap, name: one.select(F.col("snapshot_id").alias(snap), "node_key", F.col("text").alias(name))
    return changes.join(side("from_snapshot_id", "old_text"), ["from_snapshot_id", "node_key"], "left").join(side("to_snapshot_id", "new_text"), ["to_snapshot_id", "node_key"], "left")
