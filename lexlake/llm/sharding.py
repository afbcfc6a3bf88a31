"""Sharding by global byte-size prefix sums.

Rows are dealt into ranges of the id, each range gives its total, the totals
of all ranges (one row a range) are summed up in order, and a row's global
position is its range's offset plus a running sum within the range. Cutting
the byte axis at equal targets gives contiguous shards of near equal bytes.
Everything is built-in expressions; texts never leave the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexlake.llm.common import partitions, stored


def shard_by_bytes(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Contiguous shards 0 .. n_shards-1 in ascending id order.

    A row's size is the UTF-8 length of its text (null: 0) plus 1. The shard is
    where the middle of the row's byte interval falls, so each shard's bytes
    differ from the equal target by less than one row's size at either end.
    ``slot`` counts the rows of a shard from 0 without gaps.

    Null ids come first; equal ids are ordered by size and checksum; rows equal
    in all three are interchangeable. Null and empty texts have size 1. An
    empty table gives an empty result. Other columns are ignored.
    Returns id, size, text_crc32 (null text: that of the empty text), shard, slot.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    order = [F.col(id_col).asc_nulls_first(), F.col("size"), F.col("text_crc32")]
    # Equal triples are split evenly too: the tie breaker only spreads them over ranges.
    ranged = rows.withColumn("tie", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(partitions(docs.sparkSession), *order, F.col("tie"))
    ranged = stored(ranged.withColumn("part", F.spark_partition_id()))

    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    within = Window.partitionBy("part").orderBy(*order, F.col("tie"))
    up_to = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.withColumn("end_in_part", F.sum("size").over(up_to))
        .withColumn("row_in_part", F.row_number().over(within))
        .join(F.broadcast(offsets), "part")  # one row a range
    )
    end = F.col("bytes_before") + F.col("end_in_part")
    # floor((end - size/2) * n / all), in whole numbers
    middle = (F.lit(2) * end - F.col("size")).cast("decimal(38,0)") * F.lit(n_shards)
    shard = F.floor(middle / (F.lit(2) * F.col("all_bytes")).cast("decimal(20,0)")).cast("int")
    placed = stored(
        placed.select(
            id_col, "size", "text_crc32", shard.alias("shard"), (F.col("n_before") + F.col("row_in_part") - 1).alias("row")
        )
    )
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))  # one row a shard
    return placed.join(F.broadcast(firsts), "shard").select(
        id_col, "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot")
    )
