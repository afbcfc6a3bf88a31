"""Incremental crawl ingest (T1).

Landed fetches arrive as files. Each micro-batch is compared with the last
fetched version of its documents; what changed becomes snapshots, provisions and
change rows. A version dated in the past is accepted: detection goes by fetch
time. The tables are Parquet:

  snapshots, provisions, changes   one folder a batch: the history, never read
                                   by a batch
  latest      bucket, generation: the last version of each document with its
              provisions, bucketed by document. A batch reads the buckets that
              it touches and writes their next generation, named after it
  commits     one folder a batch, written last: for each bucket the generation
              that holds, and the one that it replaced

So what a batch reads and writes goes with the documents and buckets that it
touches and not with history. Texts are shuffled once, by bucket; the tables are
written from that, which executors keep on their disks meanwhile. A batch that was killed, or runs again as the last
one, starts from the commit before it and replaces all it wrote (by dynamic
partition overwrite). A generation is removed one batch after it was replaced.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexlake.operators.normalize import lines_hash
from lexlake.operators.versions import detect_changes

FETCHES = "document_id long, fetched_at timestamp, issued_at timestamp, ordinal int, node_key string, heading string, text string"
SNAPSHOTS = "snapshot_id long, document_id long, fetched_at timestamp, issued_at timestamp, content_hash string, batch long"
PROVISIONS = "snapshot_id long, document_id long, ordinal int, node_key string, heading string, text string, batch long"
LATEST = "document_id long, snapshot_id long, fetched_at timestamp, content_hash string, ordinal int, node_key string, heading string, text string"
COMMITS = "bucket int, generation long, replaced long"
LINE = ["ordinal", "node_key", "heading", "text"]
#: Of the stored tables, which are mostly text.
CODEC = "zstd"
#: Buckets of the latest versions; a task holds one at least. It is fixed for a table
#: once it has rows (tables made with 64 buckets need that number here).
BUCKETS = 256


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _missing(e: AnalysisException) -> bool:
    return e.getCondition() == "PATH_NOT_FOUND"


def read_table(spark: SparkSession, out: str, table: str) -> DataFrame:
    """Snapshots, provisions or changes of all committed batches."""
    done = spark.read.parquet(f"{out}/commits").select("batch").distinct()
    return spark.read.parquet(f"{out}/{table}").join(F.broadcast(done), "batch", "left_semi")  # a row a batch


def _pointers(spark: SparkSession, out: str, batch: int) -> dict[int, tuple[int, int | None]]:
    """Bucket → (generation, the one it replaced in the last batch) before ``batch``."""
    try:
        rows = spark.read.schema(COMMITS).parquet(f"{out}/commits/batch={batch - 1}").collect()  # BUCKETS rows at most
    except AnalysisException as e:
        if not _missing(e):
            raise
        try:  # batches left out of the numbering
            every = spark.read.schema(COMMITS + ", batch long").parquet(f"{out}/commits").where(F.col("batch") < batch)
        except AnalysisException as e:
            if not _missing(e):
                raise
            return {}
        last = every.agg(F.max("batch")).first()[0]
        rows = every.where(F.col("batch") == F.lit(last)).select(*_names(COMMITS)).collect()
    return {r["bucket"]: (r["generation"], r["replaced"]) for r in rows}


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def apply_batch(fetches: DataFrame, batch: int, out: str, threshold: float | None = 0.9) -> None:
    """One micro-batch of provision rows by fetch (FETCHES): writes snapshots,
    provisions, changes and the touched buckets of ``latest``, then commits. Of
    several fetches of a document in a batch each is compared with the one
    before it. A batch without rows only commits."""
    spark = fetches.sparkSession
    by = ["bucket", "document_id"]
    put = lambda df, table: df.write.mode("overwrite").option("compression", CODEC).parquet(f"{out}/{table}/batch={batch}")
    before = _pointers(spark, out, batch)
    for bucket, (_, replaced) in before.items():
        if replaced is not None:  # by the batch before, which runs no more
            _remove(spark, f"{out}/latest/bucket={bucket}/generation={replaced}")
    of = F.pmod(F.xxhash64("document_id"), F.lit(BUCKETS)).cast("int")
    touched = sorted(r["bucket"] for r in fetches.select(of.alias("bucket")).distinct().collect())  # BUCKETS rows at most
    held = [f"{out}/latest/bucket={b}/generation={before[b][0]}" for b in touched if b in before]
    last = spark.read.schema(LATEST).parquet(*held) if held else spark.createDataFrame([], LATEST)
    versions = _versions(fetches, last, of).persist(StorageLevel.DISK_ONLY)
    try:
        lines = F.inline(F.transform("lines", lambda x: F.struct(*[x[c].alias(c) for c in LINE])))
        mine = versions.where(~F.col("held"))
        put(mine.select(*_names(SNAPSHOTS)[:-1]), "snapshots")
        put(mine.select("snapshot_id", "document_id", lines), "provisions")
        # Each new snapshot is compared with its document's one before, which may be the last version.
        put(detect_changes(versions.select(*by, "snapshot_id", "fetched_at", "lines"), None, threshold, True, by), "changes")
        # The next generation: whichever version was fetched last, of every document of the bucket.
        newest = Window.partitionBy(*by).orderBy(F.desc("fetched_at"), F.desc("held"))
        rows = versions.withColumn("r", F.row_number().over(newest)).where("r = 1").select("bucket", F.lit(batch).cast("long").alias("generation"), "document_id", "snapshot_id", "fetched_at", "content_hash", lines)
        rows = rows.sortWithinPartitions("bucket", "generation", "document_id", "ordinal").select(*_names(LATEST), "bucket", "generation")
        rows.write.partitionBy("bucket", "generation").mode("overwrite").option("compression", CODEC).option("partitionOverwriteMode", "dynamic").parquet(f"{out}/latest")
    finally:
        versions.unpersist()
    after = [(b, g, None) for b, (g, _) in before.items() if b not in touched] + [(b, batch, before[b][0] if b in before else None) for b in touched]
    put(spark.createDataFrame(after, COMMITS).coalesce(1), "commits")


def _versions(fetches: DataFrame, last: DataFrame, bucket: Column) -> DataFrame:
    """The new versions among the fetches, and the last ones (``held``) of their
    buckets: one row a version, with its provisions in order (``lines``), dealt
    by bucket. This is the only time that texts are shuffled."""
    none = lambda kind: F.lit(None).cast(kind)
    fetched = fetches.dropna(subset=["document_id", "fetched_at"]).select("document_id", "fetched_at", "issued_at", none("long").alias("snapshot_id"), none("string").alias("content_hash"), F.lit(False).alias("held"), *LINE)
    kept = last.select("document_id", "fetched_at", none("timestamp").alias("issued_at"), "snapshot_id", "content_hash", F.lit(True).alias("held"), *LINE)
    rows = fetched.union(kept).withColumn("bucket", bucket).repartition("bucket").groupBy("bucket", "document_id", "held", "fetched_at")
    rows = rows.agg(*[F.max(c).alias(c) for c in ("issued_at", "snapshot_id", "content_hash")], F.sort_array(F.collect_list(F.struct("ordinal", "text", "node_key", "heading"))).alias("lines"))
    rows = rows.withColumn("content_hash", F.coalesce("content_hash", lines_hash(F.col("lines"))))
    rows = rows.withColumn("snapshot_id", F.coalesce("snapshot_id", F.xxhash64("document_id", F.unix_micros("fetched_at"), "content_hash")))
    # A fetch is compared with the one before it in the batch, the first one with the last version.
    previous = F.lag("content_hash").over(Window.partitionBy("bucket", "document_id").orderBy(F.desc("held"), "fetched_at"))
    return rows.withColumn("previous", previous).where(F.col("held") | ~F.col("previous").eqNullSafe(F.col("content_hash"))).drop("previous")


def ingest_stream(spark: SparkSession, landing_dir: str, out: str, checkpoint: str, threshold: float | None = 0.9, once: bool = True) -> StreamingQuery:
    """T1. Follows the Parquet files of FETCHES rows in ``landing_dir``; a
    document's fetch lies whole in one file. ``once`` takes what is there and ends."""
    stream = spark.readStream.schema(FETCHES).parquet(landing_dir)
    writer = stream.writeStream.foreachBatch(lambda df, i: apply_batch(df, i, out, threshold)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
