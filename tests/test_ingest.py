"""Batches of the ingest: what they read, and what is left when they are killed."""

import datetime as dt
import random

import pytest

from lexlake.streaming import ingest


def at(day):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=day)


def landed(spark, day, texts):
    rows = [(d, at(day), None, i, f"{d}#{i}", "h", t) for d, lines in texts.items() for i, t in enumerate(lines)]
    return spark.createDataFrame(rows, ingest.FETCHES)


def contents(spark, out):
    tables = {t: sorted(map(str, ingest.read_table(spark, out, t).collect())) for t in ("snapshots", "provisions", "changes")}
    generations = {r["bucket"]: r["generation"] for r in spark.read.parquet(f"{out}/commits").collect() if r["batch"] == spark.read.parquet(f"{out}/commits").agg({"batch": "max"}).first()[0]}
    latest = spark.read.parquet(f"{out}/latest").collect()
    tables["latest"] = sorted(str(tuple(r)[:8]) for r in latest if generations[r["bucket"]] == r["generation"])
    return tables


def history(seed, rounds=5):
    rnd = random.Random(seed)
    docs = {d: ["a", "b"] for d in range(12)}
    for day in range(rounds):
        some = rnd.sample(range(14), 5)
        for d in some:
            docs[d] = [rnd.choice("abc") for _ in range(rnd.randint(1, 3))]
        yield day, {d: docs[d] for d in some}


def test_killed_and_repeated_batches_give_equal_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "BUCKETS", 5)
    plain, broken = str(tmp_path / "plain"), str(tmp_path / "broken")
    real = ingest.detect_changes
    for day, texts in history(1):
        ingest.apply_batch(landed(spark, day, texts), day, plain, None)
        if day % 2:  # killed before the commit, after part of the tables was written

            def fail(*args):
                raise RuntimeError("killed")

            monkeypatch.setattr(ingest, "detect_changes", fail)
            with pytest.raises(RuntimeError):
                ingest.apply_batch(landed(spark, day, texts), day, broken, None)
            monkeypatch.setattr(ingest, "detect_changes", real)
        for _ in range(1 + (day == 3)):  # the last batch may also run once more after its commit
            ingest.apply_batch(landed(spark, day, texts), day, broken, None)
    assert contents(spark, plain) == contents(spark, broken)
    assert len(contents(spark, plain)["changes"]) > 5


def test_reads_only_touched_buckets_and_drops_old_generations(spark, tmp_path, monkeypatch):
    out, read = str(tmp_path / "out"), []
    monkeypatch.setattr(ingest, "BUCKETS", 4)
    for day in range(8):
        ingest.apply_batch(landed(spark, day, {1: [f"text {day}"], 2: ["the same"]} if day else {d: ["x"] for d in range(40)}), day, out, None)
        files = [p for p in (tmp_path / "out" / "latest").rglob("*.parquet")]
        read.append(len(files))
    # A generation in use and the one before it, however long the history is.
    assert max(read[2:]) <= 2 * 4 and read[-1] == read[3]
    assert ingest.read_table(spark, out, "snapshots").where("document_id = 1").count() == 8
    assert ingest.read_table(spark, out, "snapshots").where("document_id = 2").count() == 2
    assert {r["change_type"] for r in ingest.read_table(spark, out, "changes").collect()} == {"modified"}


def test_late_fetches_and_several_of_a_batch(spark, tmp_path):
    out = str(tmp_path / "out")
    first = landed(spark, 5, {1: ["five"]}).union(landed(spark, 7, {1: ["seven"]})).union(landed(spark, 6, {1: ["five"]}))
    ingest.apply_batch(first, 0, out, None)
    assert ingest.read_table(spark, out, "snapshots").count() == 2
    ingest.apply_batch(landed(spark, 1, {1: ["one"]}), 1, out, None)  # fetched before the last version: kept, not the latest
    ingest.apply_batch(landed(spark, 8, {1: ["seven"]}), 2, out, None)  # no change against the last fetched one
    ingest.apply_batch(landed(spark, 9, {1: []}), 3, out, None)  # a batch without rows
    ingest.apply_batch(landed(spark, 9, {1: ["nine"]}), 4, out, None)
    rows = ingest.read_table(spark, out, "snapshots").collect()
    assert sorted(r["fetched_at"].day for r in rows) == [2, 6, 8, 10]
