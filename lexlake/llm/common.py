"""What the operators of this subpackage share: the shared folder, stored
tables, size-checked broadcasts and ranges of an ordering column."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from lexlake.shared import shared_dir

#: Stands for a null id wherever ids are ordered; nulls come first. No id may be this.
NULL_KEY = -(2**63)
#: Keys of rows lie below it if their id is null; ids lie at or above it.
LEAST_ID = -(2**62)

#: Rows per Arrow batch.
BATCH_ROWS = 1000
#: Bytes per Arrow batch: a batch of long texts has fewer rows.
BATCH_BYTES = 16 << 20

#: A side of a join is broadcast only when it was counted and has no more rows.
BROADCAST_ROWS = 200_000


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: it is
    computed once, its lineage is cut, and lost executors don't matter."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexlake-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, which must be cheap to count, marked for broadcast if it has at
    most ``rows`` rows; beyond that Spark shuffles for the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def short_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def with_fields(schema: StructType, ddl: str) -> StructType:
    """A new schema: the fields and those of the DDL text behind them."""
    return StructType([*schema.fields, *_parse_datatype_string(ddl).fields])


def order_key(column: str) -> F.Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_KEY))


def row_key(id_col: str, text_col: str) -> F.Column:
    """The id, or where it is null a number below LEAST_ID made of the text, so
    that different rows without an id aren't taken for one."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_KEY) + F.pmod(F.xxhash64(text_col), F.lit(2**62)))


def range_bounds(df: DataFrame, key: F.Column, n: int) -> np.ndarray:
    """At most ``n`` ascending lower bounds that cut ``key`` into ranges of
    about equal counts; the first range also takes what lies below it."""
    shares = ", ".join(f"{i / n:.8f}D" for i in range(n))
    found = df.select(key.alias("k")).agg(F.expr(f"percentile_approx(k, array({shares}), 10000)")).first()[0]
    return np.unique(np.array(found or [0], dtype=np.int64))


def range_of(bounds: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return np.maximum(np.searchsorted(bounds, keys, side="right") - 1, 0)


def range_starts(df: DataFrame, key: F.Column, bounds: np.ndarray) -> dict[int, int]:
    """Range → its smallest key, for the ranges that have rows (at most as many
    entries as there are bounds)."""

    @F.pandas_udf("int")
    def bucket(keys: pd.Series) -> pd.Series:
        return pd.Series(range_of(bounds, keys.to_numpy()).astype(np.int32))

    rows = df.select(key.alias("k")).groupBy(bucket("k").alias("b")).agg(F.min("k").alias("k")).collect()
    return {r["b"]: r["k"] for r in rows}


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node with an edge.

    Rounds of large-star and small-star on tables: each node's neighbours are
    linked to the smallest one, until nothing changes. Rows are combined before
    they are shuffled and no neighbourhood is gathered.
    """
    pairs = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = checkpointed(small.where("u <> v").distinct())
        stats = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
        if after.agg(*stats).first() == pairs.agg(*stats).first():
            return after.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        pairs = after
