"""Scans along timelines that no single task has to hold.

Rows are dealt to ranges of (timeline, order), so a long timeline is cut into
time blocks and short ones share a range. Each block is scanned by itself; what
stands at a block's end is carried into the later blocks of the same timeline.
A border between ranges cuts one timeline at most, so the carried values are fewer
than the ranges and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexlake.shared import shared_dir

_BLOCK, _AT = "__block", "__at"


def in_blocks(rows: DataFrame, by: str, order: list[str | Column]) -> DataFrame:
    """``rows`` with its blocks: the timelines of ``by``, each in ``order``."""
    shared_dir(rows.sparkSession)
    rows = rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    # Numbers of a partition are consecutive; the checkpoint keeps them for good.
    rows = rows.withColumn(_AT, F.monotonically_increasing_id()).checkpoint(eager=True)
    return rows.withColumn(_BLOCK, F.shiftright(_AT, 33))


def without_blocks(rows: DataFrame) -> DataFrame:
    return rows.drop(_BLOCK, _AT)


def _carried(rows: DataFrame, ends: DataFrame, by: str, carry: Column) -> DataFrame:
    """``rows`` with ``__carry``, made of the ``end`` of its timeline's earlier blocks."""
    ends = ends.withColumn("__carry", carry).where("__carry is not null").select(F.col(by).alias("__by"), F.col(_BLOCK).alias("__in"), "__carry")
    return rows.join(F.broadcast(ends), F.col(by).eqNullSafe(F.col("__by")) & (F.col(_BLOCK) == F.col("__in")), "left").drop("__by", "__in")


def _earlier(by: str) -> Window:
    return Window.partitionBy(by).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)


def last_value(rows: DataFrame, by: str, value: Column, name: str, own: bool) -> DataFrame:
    """``rows`` (in blocks) with the last non-null value of its timeline before
    each row, or up to it if ``own``."""
    rows = rows.withColumn("__value", value)
    within = Window.partitionBy(by, _BLOCK).orderBy(_AT).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    ends = rows.groupBy(by, _BLOCK).agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col(_AT))).alias("end"))
    out = _carried(rows, ends, by, F.last("end", ignorenulls=True).over(_earlier(by)))
    found = F.coalesce(F.last("__value", ignorenulls=True).over(within), F.col("__carry"))
    return out.withColumn(name, found).drop("__value", "__carry")


def place(rows: DataFrame, by: str, name: str) -> DataFrame:
    """``rows`` (in blocks) numbered from 1 along their timeline."""
    within = Window.partitionBy(by, _BLOCK).orderBy(_AT)
    ends = rows.groupBy(by, _BLOCK).agg(F.count("*").alias("end"))
    out = _carried(rows, ends, by, F.sum("end").over(_earlier(by)))
    return out.withColumn(name, F.row_number().over(within) + F.coalesce("__carry", F.lit(0))).drop("__carry")


def running_sum(rows: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """``rows`` (in blocks) with the sum of ``value`` along the timeline, each row's own included."""
    within = Window.partitionBy(by, _BLOCK).orderBy(_AT).rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy(by, _BLOCK).agg(F.sum(value).alias("end"))
    out = _carried(rows, ends, by, F.sum("end").over(_earlier(by)))
    return out.withColumn(name, F.sum(value).over(within) + F.coalesce("__carry", F.lit(0))).drop("__carry")
