"""Cells that come in few input files, or without a change, are dealt to all tasks."""

import pytest
from pyspark.sql import functions as F

from lexlake.operators import matrix as M


@pytest.fixture
def plain_plans(spark):
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k in settings:
        spark.conf.unset(k)


def cells(spark, n=2000):
    cite = F.array(*[F.struct(F.concat(F.lit(p), F.lit("L"), F.col("id") % 7).alias("node_key"), F.lit("q").alias("quote")) for p in ("", " ")])
    return spark.range(n).select(
        F.col("id").alias("requirement_id"), F.lit("rate").alias("field_key"), F.lit("v").alias("value"), cite.alias("citations"), F.lit(0.5).alias("confidence"), F.lit("extracted").alias("source"),
        F.lit(False).alias("needs_review"), F.lit("").alias("review_reason"), F.when(F.col("id") % 50 == 0, F.col("id")).alias("stale_change_id"),
    )


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_without_a_change(spark, plain_plans):
    requirements = spark.range(2000).select(F.col("id").alias("requirement_id"))
    changes = spark.range(100).select(F.col("id").alias("change_id"), F.lit("N").alias("node_key"), F.lit("major").alias("severity"))
    out = M.requirement_detail(requirements, cells(spark), changes)
    assert out.columns[0] == "stale_change_id" and out.where("change_node_key = 'N'").count() == 2
    held = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 22_000 and max(held) < 9_000


def test_affected_cells_are_not_aggregated_where_they_are_read(spark, plain_plans):
    requirements = spark.range(2000).select(F.col("id").alias("requirement_id"), F.lit("CN").alias("country"), F.lit("t").alias("tax_key"))
    keys = spark.createDataFrame([("L 3",), ("L3",), ("L9",)], "node_key string")
    out = M.affected_cells(keys, cells(spark), requirements)
    assert out.count() == 286 and {r["key"] for r in out.select("key").distinct().collect()} == {"L3"}
    assert "keys=[requirement_id" not in plan(out)


def test_merged_cells_are_dealt_before_they_are_sorted(spark, plain_plans):
    new = cells(spark).select("requirement_id", F.lit(1).alias("batch_no"), F.explode(F.array(F.lit(1), F.lit(2))).alias("row_no"), "field_key", F.concat(F.lit("new"), F.col("row_no")).alias("value"), "confidence", "citations")
    out = M.merge_extracted(new, cells(spark), spark.createDataFrame([("L3",)], "node_key string"))
    assert {r["value"] for r in out.where("requirement_id % 7 = 3").select("value").distinct().collect()} == {"new1"}
    below = plan(out).split("WindowGroupLimit")[-1].splitlines()[1:]
    assert "Exchange hashpartitioning(requirement_id" in next(line for line in below if "Sort" not in line and "Project" not in line)
