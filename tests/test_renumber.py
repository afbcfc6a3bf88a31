"""Renumbering against the greedy rule stated plainly."""

import random

import pytest
from pyspark.sql import functions as F

from lexlake.functions.similarity import ratio
from lexlake.operators import renumber
from lexlake.operators.versions import diff_provisions

SCHEMA = "pair_id long, node_key string, ordinal int, text string, class string"


def plain(removed, added, threshold):
    out = set()
    for pair in {r[0] for r in removed}:
        olds, news = (sorted((r[2], r[1], r[3] or "") for r in rows if r[0] == pair) for rows in (removed, added))
        used = set()
        for _, key, text in olds:
            best, score = None, 0.0
            for i, (_, _, other) in enumerate(news):
                s = ratio(text, other) if i not in used else 0.0
                if s >= threshold and s > score:
                    best, score = i, s
            if best is not None:
                used.add(best)
                out.add((pair, key, news[best][1], score))
    return out


def some_rows(seed, n_pairs=6, size=14):
    rnd = random.Random(seed)
    stems = ["".join(rnd.choice("abcde 第條稅") for _ in range(n)) for n in (1, 2, 3, 9, 14, 25, 60, 250)] + [""]

    def text():
        t = list(rnd.choice(stems))
        for _ in range(rnd.choice([0, 0, 0, 1, 1, 2])):
            if t:
                t[rnd.randrange(len(t))] = rnd.choice("abxy")
        return None if rnd.random() < 0.03 else "".join(t)

    side = lambda tag: [(p, f"{tag}{rnd.randrange(10**6)}-{k}", rnd.randrange(size), text(), "clash") for p in range(n_pairs) for k in range(rnd.randint(0, size))]
    return side("o"), side("n")


@pytest.mark.parametrize("threshold", [1.0, 0.9, 0.6])
def test_equals_the_greedy_rule(spark, threshold):
    removed, added = some_rows(int(threshold * 10), size=9 if threshold < 0.7 else 14)
    frames = [spark.createDataFrame(rows, SCHEMA).repartition(3) for rows in (removed, added)]
    got = renumber.match_renumbered(*frames, threshold).collect()
    want = plain(removed, added, threshold)
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 3
    assert renumber.match_renumbered(frames[0], frames[1].where("false"), threshold).count() == 0


def test_tasks_and_joins_agree(spark, monkeypatch):
    """Small pairs are matched in a task, the others by joins; long texts too."""
    removed, added = some_rows(3)
    long = [("the provision number %d of a long law " % k) * 9 for k in range(6)]
    removed += [(99, f"o{k}", k, t, "") for k, t in enumerate(long + long[:2])]
    added += [(99, f"n{k}", k % 3, t[:100] + "x" + t[101:], "") for k, t in enumerate(long)]
    frames = [spark.createDataFrame(rows, SCHEMA) for rows in (removed, added)]
    want = plain(removed, added, 0.9)
    for limit in (renumber.IN_TASK, 3 * 10**7, 0):
        monkeypatch.setattr(renumber, "IN_TASK", limit)
        assert {tuple(r) for r in renumber.match_renumbered(*frames, 0.9).collect()} == want


def test_small_pairs_store_no_pieces(spark, monkeypatch):
    monkeypatch.setattr(renumber, "similar_classes", None)
    rows = spark.createDataFrame([(1, "o1", 1, "a provision of some length", "")], SCHEMA)
    found = renumber.match_renumbered(rows, rows.withColumn("node_key", F.lit("n1")), 0.9).collect()
    assert [tuple(r) for r in found] == [(1, "o1", "n1", 1.0)]


def test_versions_are_joined_once(spark):
    """What changed is stored once and not joined again by each use."""
    rows = spark.range(300).select((F.col("id") % 7).alias("pair_id"), F.concat(F.lit("k"), "id").alias("node_key"), F.col("id").cast("int").alias("ordinal"), F.lit("h").alias("heading"), F.concat(F.lit("text "), "id").alias("text"))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    old = rows.mapInArrow(count, rows.schema)
    new = rows.withColumn("node_key", F.when(F.col("ordinal") % 3 == 0, F.concat("node_key", F.lit("x"))).otherwise(F.col("node_key")))
    kinds = diff_provisions(old, new, with_diff=False).groupBy("change_type").count().collect()
    assert [tuple(r) for r in kinds] == [("renumbered", 100)] and seen.value == 300


def test_chains_of_claims(spark):
    """An early old one takes what a class of equal texts would; the class moves up."""
    same, near = "the same provision of some length", "the same provision of some lengt!"
    removed = [(1, "o00", 0, near, "")] + [(1, f"o{i:02}", i, same, "") for i in range(1, 20)]
    added = [(1, f"n{i:02}", i, same, "") for i in range(15)] + [(1, "n99", 99, near + "?", "")]
    frames = [spark.createDataFrame(rows, SCHEMA) for rows in (removed, added)]
    assert {tuple(r) for r in renumber.match_renumbered(*frames, 0.9).collect()} == plain(removed, added, 0.9)


def test_one_pair_of_many_left_overs(spark):
    """50,000 left-overs of one pair, a third of one text, are matched in many tasks."""
    n = 25_000
    text = F.when(F.col("id") % 3 == 0, F.lit("repealed")).otherwise(F.concat(F.hex(F.xxhash64("id")), F.hex(F.xxhash64(F.col("id") + 1))))
    removed = spark.range(n).select(F.lit(1).alias("pair_id"), F.concat(F.lit("o"), "id").alias("node_key"), F.col("id").cast("int").alias("ordinal"), text.alias("text"))
    edited = F.when(F.col("text") == "repealed", F.col("text")).otherwise(F.concat(F.col("text"), F.lit("+")))
    added = removed.select("pair_id", F.concat(F.lit("n"), F.substring("node_key", 2, 9)).alias("node_key"), "ordinal", edited.alias("text"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # or few rows would end in one task
    try:
        found = renumber.match_renumbered(removed, added, 0.9).select("*", F.spark_partition_id().alias("task"))
        right, all_, tasks = found.agg(F.count_if(F.substring("old_key", 2, 9) == F.substring("new_key", 2, 9)), F.count("*"), F.count_distinct("task")).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert right == all_ == n and tasks > 1
