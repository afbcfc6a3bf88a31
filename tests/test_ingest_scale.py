"""How often the ingest shuffles texts, and that changes found that way are the same."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lexlake.operators import versions
from lexlake.streaming import ingest


def at(day):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=day)


def shuffled(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_are_shuffled_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "BUCKETS", 4)
    out, rnd = str(tmp_path / "out"), random.Random(3)
    line = lambda: "%0200x" % rnd.getrandbits(800)
    first = {d: [line() for _ in range(10)] for d in range(300)}
    second = {d: [line() if i % 2 else t for i, t in enumerate(lines[:9])] for d, lines in first.items()}
    size = sum(len(t) for lines in first.values() for t in lines)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the tables were large
    try:
        for batch, texts in enumerate((first, second)):
            rows = [(d, at(batch), None, i, f"{d}#{i}", "h", t) for d, lines in texts.items() for i, t in enumerate(lines)]
            fetches = spark.createDataFrame(rows, ingest.FETCHES)
            before = shuffled(spark)
            ingest.apply_batch(fetches, batch, out, None)
            assert shuffled(spark) - before < 1.25 * (1 + batch) * size  # the fetches and, of the second batch, the last versions
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    kinds = {r["change_type"]: r["count"] for r in ingest.read_table(spark, out, "changes").groupBy("change_type").count().collect()}
    assert kinds == {"modified": 300 * 4, "removed": 300}
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_changes_of_packed_snapshots_are_the_same(spark):
    rnd = random.Random(5)
    words = ["the tax rate is ten percent of the sum", "returns are filed each month by the payer", "exempt are farms", "repealed"]
    snapshots, provisions = [], []
    for s in range(20):
        snapshots.append((s % 6, s, at(s)))
        keys = rnd.sample(["a", "b", "c", "d", None], 4)
        provisions += [(s, i, k, f"h{i}", rnd.choice([*words, None])) for i, k in enumerate([*keys, keys[0]])]
    snapshots = spark.createDataFrame(snapshots, "document_id long, snapshot_id long, fetched_at timestamp")
    provisions = spark.createDataFrame(provisions, "snapshot_id long, ordinal int, node_key string, heading string, text string").where("node_key is not null or ordinal < 4")
    packed = snapshots.join(provisions.groupBy("snapshot_id").agg(F.collect_list(F.struct("ordinal", "node_key", "heading", "text")).alias("lines")), "snapshot_id")
    for threshold in (None, 0.9):
        plain = versions.detect_changes(snapshots, provisions, threshold)
        own = versions.detect_changes(packed, None, threshold)
        assert sorted(plain.columns) == sorted(own.columns)
        rows = sorted(map(str, plain.select(sorted(plain.columns)).collect()))
        assert rows == sorted(map(str, own.select(sorted(own.columns)).collect()))
        assert len(rows) > 20
