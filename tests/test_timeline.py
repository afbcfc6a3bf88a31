"""Timelines in blocks against windows over whole documents."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexlake.operators import matrix, timeline, versions


def fetches(spark, n_long=3000):
    rnd = random.Random(6)
    at = lambda i: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i)
    rows = [(k, 7, at(rnd.randrange(n_long)), at(rnd.randrange(n_long)) if k % 3 else None, rnd.choice(["a", "b", None])) for k in range(n_long)]
    rows += [(10_000 + k, k % 40 if k % 9 else None, at(rnd.randrange(50)), None, rnd.choice("ab")) for k in range(400)]
    return spark.createDataFrame(rows, "snapshot_id long, document_id long, fetched_at timestamp, issued_at timestamp, content_hash string").repartition(5)


def test_blocks_cut_one_long_document(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # or few rows would end in one task
    try:
        rows = timeline.in_blocks(fetches(spark), "document_id", ["fetched_at", "snapshot_id"])
        assert rows.where("document_id = 7").select("__block").distinct().count() > 2
        w = Window.partitionBy("document_id").orderBy("fetched_at", "snapshot_id")
        rows = timeline.last_value(timeline.place(rows, "document_id", "n"), "document_id", F.col("content_hash"), "before", own=False)
        rows = timeline.last_value(rows, "document_id", F.col("content_hash"), "until", own=True)
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        plain = rows.withColumns({"n2": F.row_number().over(w), "before2": F.last("content_hash", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "until2": F.last("content_hash", True).over(upto)})
        assert plain.where("n <> n2 or not before <=> before2 or not until <=> until2").count() == 0 and plain.count() == 3400
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_detection_and_versions_in_force(spark):
    snaps = fetches(spark, 600)
    rows = sorted((-1 if r.document_id is None else r.document_id, r.fetched_at, r.snapshot_id, r.content_hash) for r in snaps.collect())
    want = {s for k, (d, _, s, h) in enumerate(rows) if k == 0 or rows[k - 1][0] != d or rows[k - 1][3] != h}
    assert {r.snapshot_id for r in versions.detect_snapshots(snaps).collect()} == want
    day = lambda i: dt.datetime(2025, 12, 31) + dt.timedelta(days=i)
    asked = spark.createDataFrame([(i, 7 if i % 2 else i, day(i % 4)) for i in range(60)], "request_id long, document_id long, day timestamp")
    all_ = [(r.document_id, r.issued_at or r.fetched_at, r.snapshot_id) for r in snaps.collect()]
    for r in versions.snapshot_at(asked, snaps).collect():
        end = r.day + dt.timedelta(days=1)
        assert r.snapshot_id == max(((t, s) for d, t, s in all_ if d == r.document_id and t < end), default=(None, None))[1]


def test_packing_by_jumps_equals_the_fold(spark, monkeypatch):
    rnd = random.Random(12)
    rows = [(d, p, rnd.choice([0, 0, 1, 5, 9, 10, 11, 30, None])) for d in range(6) for p in range(rnd.choice([1, 2, 40, 90]))] + [(9, p, 3) for p in range(400)]
    blocks = spark.createDataFrame(rows, "document_id long, pos int, size int").repartition(4)
    want = {}
    used = n = at = None
    for d, p, size in sorted(rows):
        size = size or 0
        if d != at:
            at, used, n = d, 0, 0
        elif used > 0 and used + size > 10:
            used, n = 0, n + 1
        used += size
        want[d, p] = n
    for long in (10**6, 50, 0):
        monkeypatch.setattr(matrix, "LONG_DOCUMENT", long)
        got = [tuple(r) for r in matrix.pack_batches(blocks, 10).collect()]
        assert {(d, p): k for d, p, k in got} == want and len(got) == len(rows), long
