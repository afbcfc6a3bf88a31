"""Euler-tour numbering of a forest of any depth and width.

Subtree sizes come bottom-up and places top-down, both by pointer jumping: in
round k every node knows its ancestor 2**k levels up, so a forest of depth d
takes about log2(d) rounds of joins, and no row follows a path by itself.
Siblings are ordered together, over all parents, by ranges: no task holds the
children of one parent, or all roots, as a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexlake.shared import shared_dir


def _checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _subtree_sizes(links: DataFrame, rounds: int) -> DataFrame:
    """key, size: nodes at or below it, of all nodes that have a root. After
    round k, ``size`` counts those fewer than 2**k levels below; what still has
    an ancestor after all rounds is on a cycle or below one."""
    state = _checkpointed(links.select("key", F.col("parent").alias("up"), F.lit(1).cast("long").alias("size")))
    for _ in range(rounds):
        below = state.where("up is not null").groupBy(F.col("up").alias("key")).agg(F.sum("size").alias("more"))
        above = state.where("up is not null").select(F.col("key").alias("up"), F.col("up").alias("next"))
        state = state.join(below, "key", "left").join(above, "up", "left")
        state = _checkpointed(state.select("key", F.col("next").alias("up"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        if state.where("up is not null").isEmpty():
            break
    return state.where("up is null").select("key", "size")


def _among_siblings(rows: DataFrame, order: list[str]) -> DataFrame:
    """key, before: nodes in the subtrees of earlier siblings. rows: key, parent, size."""
    sorted_by = ["parent", *order, "key"]
    rows = rows.repartitionByRange(*sorted_by).sortWithinPartitions(*sorted_by)
    # The number of a row holds its range and its place there.
    rows = _checkpointed(rows.select("key", "parent", "size", F.monotonically_increasing_id().alias("at")))
    rows = rows.withColumn("range", F.shiftright("at", 33))
    earlier = Window.partitionBy("range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    ranges = rows.groupBy("range").agg(F.sum("size").alias("total"))
    carried = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ranges = ranges.select("range", F.coalesce(F.sum("total").over(carried), F.lit(0)).alias("carried"))
    rows = rows.join(F.broadcast(ranges), "range").withColumn("all_before", F.col("within") + F.col("carried"))
    first = rows.groupBy("parent").agg(F.min("all_before").alias("first"))
    rows = rows.join(first.withColumnRenamed("parent", "of"), F.col("parent").eqNullSafe(F.col("of")))
    return rows.select("key", (F.col("all_before") - F.col("first")).alias("before"))


def number_forest(nodes: DataFrame, order: list[str], path_col: str | None = None) -> DataFrame:
    """key, depth, size (nodes at or below), child_count, position (from 0, in
    pre-order; siblings by ``order``, then key; nulls first) and, if asked for,
    ``path``: the values of ``path_col`` from the root on.

    nodes: key (each once), parent and the columns named. A parent that isn't
    among the keys, or is the node itself, makes a root. Nodes on a cycle of
    parents, or below one, belong to no tree and are left out.
    """
    wanted = dict.fromkeys([*order, *([path_col] if path_col else [])])
    keys = nodes.select(F.col("key").alias("known"))
    rows = nodes.where("key is not null").join(keys, nodes["parent"] == F.col("known"), "left")
    rows = _checkpointed(rows.select("key", F.when(F.col("known") != F.col("key"), F.col("known")).alias("parent"), *wanted))
    rounds = rows.count().bit_length() + 1
    sizes = _subtree_sizes(rows, rounds)
    rows = _checkpointed(rows.join(sizes, "key"))
    children = rows.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("child_count"))
    step = F.when(F.col("parent").isNull(), 0).otherwise(1)
    own = F.array(path_col) if path_col else F.array().cast("array<string>")
    state = rows.join(_among_siblings(rows, order), "key")
    state = _checkpointed(state.select("key", F.col("parent").alias("up"), step.cast("long").alias("depth"), (F.col("before") + step).alias("position"), own.alias("path")))
    for _ in range(rounds):
        if state.where("up is not null").isEmpty():
            break
        above = state.select(F.col("key").alias("up"), F.col("up").alias("next"), F.struct("depth", "position", "path").alias("a"))
        state = state.join(above, "up", "left")
        add = lambda c: F.col(c) + F.coalesce(F.col(f"a.{c}"), F.lit(0))
        path = F.when(F.col("a").isNull(), F.col("path")).otherwise(F.concat(F.col("a.path"), F.col("path")))
        state = _checkpointed(state.select("key", F.col("next").alias("up"), add("depth").alias("depth"), add("position").alias("position"), path.alias("path")))
    out = state.where("up is null").join(rows.select("key", "size"), "key").join(children, "key", "left")
    columns = ["key", "depth", "size", F.coalesce("child_count", F.lit(0).cast("long")).alias("child_count"), "position"]
    return out.select(*columns, *(["path"] if path_col else []))
