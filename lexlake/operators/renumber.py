"""Matching of removed and added provisions by similar text (V5).

1. Texts of a pair of versions are told apart: equal ones are one class.
2. A set-similarity join finds the classes that are alike. Texts whose ratio is
   t or more share many pieces of q neighbouring characters: with M characters
   matched of a total of T (2 M >= t T), at most T - 2 M + 1 stretches are
   matched, so at least M - (q - 1)(T - 2 M + 1) pieces, counted with repeats,
   are common. So such texts share one of the first few pieces of each in any
   fixed order; the rarest come first. Lengths bound the ratio as well, and all
   pieces are counted before difflib looks at a pair.
3. Classes that are alike to no other are matched member by member, in order.
   The others are matched by rounds of joins (see ``_settle``).

A pair of few left-overs (see ``IN_TASK``) is matched by the rule itself in the
task that holds it, so its pieces are neither shuffled nor stored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from lexlake.functions.similarity import ratio
from lexlake.shared import shared_dir


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Sizes of the character pieces that texts are compared by; the longer a text
#: is, the larger pieces are sure to be shared.
_SIZES = (2, 3, 4)


@F.pandas_udf(ArrayType(StringType()))
def _pieces(texts: pd.Series, sizes: pd.Series) -> pd.Series:
    """Each piece of neighbouring characters with its number among equal ones."""

    def of(text: str, size: int) -> list[str]:
        seen: Counter[str] = Counter()
        out = []
        for i in range(len(text) - size + 1):
            piece = text[i : i + size]
            seen[piece] += 1
            out.append(f"{piece}{seen[piece]}")
        return out

    return pd.Series([of(*row) for row in zip(texts, sizes)])


def _checked(threshold: float):
    @F.pandas_udf(DoubleType())
    def at_least(a: pd.Series, b: pd.Series) -> pd.Series:
        """The ratio, null where it is lower; the common characters bound it."""
        out = []
        for x, y in zip(a, b):
            common = sum((Counter(x) & Counter(y)).values())
            r = ratio(x, y) if 2 * common >= threshold * (len(x) + len(y)) else 0.0
            out.append(r if r >= threshold else None)
        return pd.Series(out, dtype="float64")

    return at_least


def similar_classes(old: DataFrame, new: DataFrame, threshold: float) -> DataFrame:
    """(pair_id, old_class, new_class, similarity) of different texts of a pair
    whose ratio is the threshold or more. old, new: pair_id, class, text, each
    text of a pair once."""
    reach = threshold / (2 - threshold)
    shortest = lambda n: F.ceil(n * reach - 1e-9)

    def sure(size: int, total):
        """Pieces of that size that alike texts of so many characters share."""
        return F.ceil(((2 * size - 1) * threshold / 2 - (size - 1)) * total - (size - 1) - 1e-9)

    def size_for(n):
        """The size that a pair is compared by whose shorter text has n characters."""
        out = F.lit(0)
        for size in _SIZES:  # a larger one that is sure to be shared wins
            out = F.when(sure(size, n + shortest(n)) >= 1, size).otherwise(out)
        return out

    rows = [df.select("pair_id", F.lit(side).alias("side"), "class", F.length("text").alias("length"), "text") for side, df in (("old", old), ("new", new))]
    rows = rows[0].union(rows[1])
    both = rows.groupBy("pair_id").agg(F.count_distinct("side").alias("sides")).where("sides = 2").select("pair_id")
    rows = rows.join(both, "pair_id", "left_semi")
    rows = rows.withColumns({"low": size_for(shortest(F.col("length"))), "high": size_for(F.col("length"))})
    keys = ["pair_id", "side", "class"]
    cut = rows.withColumn("size", F.explode(F.sequence("low", "high"))).where("size > 1")
    cut = checkpointed(cut.select(*keys, "length", "size", _pieces("text", "size").alias("pieces")))
    total = F.col("length") + shortest(F.col("length"))
    least = F.lit(1)
    for size in _SIZES:
        least = F.when(F.col("size") == size, F.greatest(F.lit(1), sure(size, total))).otherwise(least)
    shown = cut.select(*keys, "size", "length", (F.size("pieces") - least + 1).alias("first"), F.explode("pieces").alias("piece"))
    often = shown.groupBy("pair_id", "size", "piece").agg(F.count("*").alias("texts"))
    order = Window.partitionBy(*keys, "size").orderBy("texts", "piece")
    # Pieces of one text alone lead to nothing, but have their place in the order.
    shown = shown.join(often, ["pair_id", "size", "piece"]).withColumn("r", F.row_number().over(order)).where("r <= first and texts > 1")
    near = (F.col("old_length") >= F.col("new_length") * reach - 1e-9) & (F.col("new_length") >= F.col("old_length") * reach - 1e-9)
    side = lambda df, name, *columns: df.where(F.col("side") == name).select("pair_id", F.col("class").alias(f"{name}_class"), F.col("length").alias(f"{name}_length"), *columns)
    met = side(shown, "old", "size", "piece").join(side(shown, "new", "size", "piece"), ["pair_id", "size", "piece"]).where(near)
    met = met.select("pair_id", "size", "old_class", "new_class").distinct()
    whole = lambda name: side(cut, name, "size", F.col("pieces").alias(f"{name}_pieces"))
    met = met.join(whole("old"), ["pair_id", "size", "old_class"]).join(whole("new"), ["pair_id", "size", "new_class"])
    needed = F.lit(0)
    for size in _SIZES:
        needed = F.when(F.col("size") == size, sure(size, F.col("old_length") + F.col("new_length"))).otherwise(needed)
    met = met.where(F.size(F.array_intersect("old_pieces", "new_pieces")) >= needed).select("pair_id", "old_class", "new_class")
    # Texts too short, or a threshold too low, for a sure piece meet by length.
    few = rows.where("high = 0").withColumn("other", F.explode(F.sequence(shortest(F.col("length")), F.greatest(shortest(F.col("length")), F.floor(F.col("length") / reach + 1e-9)))))
    for a, b in (("old", "new"), ("new", "old")):
        short = few.where(F.col("side") == a).select("pair_id", F.col("class").alias(f"{a}_class"), F.col("other").alias("length"))
        every = rows.where(F.col("side") == b).select("pair_id", F.col("class").alias(f"{b}_class"), F.col("length").cast("long").alias("length"))
        met = met.union(short.join(every, ["pair_id", "length"]).select("pair_id", "old_class", "new_class"))
    text = lambda df, name: df.select("pair_id", F.col("class").alias(f"{name}_class"), F.col("text").alias(f"{name}_text"))
    met = met.distinct().join(text(old, "old"), ["pair_id", "old_class"]).join(text(new, "new"), ["pair_id", "new_class"]).where("old_text <> new_text")
    return met.select("pair_id", "old_class", "new_class", _checked(threshold)("old_text", "new_text").alias("similarity")).where("similarity is not null")


def _settle(wanted: DataFrame) -> DataFrame:
    """The greedy matching: old ones in order each take the best new one left
    (higher similarity, then earlier).

    wanted: pair_id, old_class, rank (place among the old ones of that class),
    old_key, old_at, new_key, new_at, similarity, for each new one that an old
    one could take; old ones of a class want the same. In a round each old one
    passes over what an earlier one of another class holds, and then over as many
    as there are earlier ones of its own class, which take them; a new one is
    held by the earliest that asks. When a round changes nothing, what is held is
    the greedy matching: once the first k old ones hold what they get in the end,
    so does the next one after one more round.
    """
    wanted = checkpointed(wanted)
    old, new = ["pair_id", "old_key"], ["pair_id", "new_key"]
    held = None
    while True:
        left = wanted
        if held is not None:
            others = held.select(*new, F.col("old_at").alias("held_at"), F.col("old_class").alias("held_class"))
            left = wanted.join(others, new, "left").where("held_at is null or held_class = old_class or held_at > old_at")
        best = Window.partitionBy(*old).orderBy(F.desc("similarity"), "new_at")
        asked = left.withColumn("place", F.row_number().over(best)).where("place = rank")
        taken = asked.groupBy(*new).agg(F.min_by(F.struct("old_class", "old_key", "old_at", "similarity"), "old_at").alias("o"))
        taken = checkpointed(taken.select(*new, "o.*"))
        digest = [F.count("*"), F.sum(F.xxhash64(*new, "old_key").cast("decimal(38,0)"))]
        if held is not None and taken.agg(*digest).first() == held.agg(*digest).first():
            return taken.select("pair_id", "old_key", "new_key", "similarity")
        held = taken


#: A pair is matched in one task if (characters + 1,000 for each text) of its old
#: side times those of its new side, and its characters, are no more.
IN_TASK, CHARACTERS_IN_TASK = 10**11, 1 << 22


def _common(x: str) -> Callable[[str], int]:
    """The length of the longest common subsequence with x, a column a step."""
    at: dict[str, int] = defaultdict(int)
    for i, c in enumerate(x):
        at[c] |= 1 << i
    full = (1 << len(x)) - 1

    def of(y: str) -> int:
        rest = full
        for c in y:
            met = rest & at.get(c, 0)
            rest = ((rest + met) | (rest - met)) & full
        return len(x) - rest.bit_count()

    return of


def _greedy(olds: list[tuple], news: list[tuple], threshold: float) -> Iterator[tuple]:
    """(old key, new key, similarity). olds, news: (ordinal, key, text), in order.

    Only equal texts have ratio 1, so the first equal one left is the best. What
    difflib matches is a common subsequence, which bounds its ratio."""
    left: dict[str, list[int]] = defaultdict(list)  # places of a text's unused new ones, the earliest last
    for place in range(len(news) - 1, -1, -1):
        left[news[place][2]].append(place)
    letters: dict[str, Counter] = {}
    ratios: dict[str, dict[str, float]] = {}
    for _, key, text in olds:
        best, score = (text if left.get(text) else None), 1.0
        if best is None and threshold < 1 and text:
            known, common, own = ratios.setdefault(text, {}), None, Counter(text)
            score = 0.0
            for other, places in left.items():
                if not places:
                    continue
                if other not in known:
                    known[other], needed = 0.0, threshold * (len(text) + len(other)) - 1e-9
                    if 2 * min(len(text), len(other)) >= needed:
                        if other not in letters:
                            letters[other] = Counter(other)
                        if 2 * (own & letters[other]).total() >= needed:
                            common = common or _common(text)
                            if 2 * common(other) >= needed:
                                known[other] = ratio(text, other)
                s = known[other]
                if s >= threshold and (s > score or (s == score and places[-1] < left[best][-1])):
                    best, score = other, s
        if best is not None:
            yield key, news[left[best].pop()][1], score


def _matched_in_tasks(rows: DataFrame, threshold: float) -> DataFrame:
    """match_renumbered's result for pairs that fit a task. rows: pair_id, side, at, text."""
    schema = StructType([rows.schema["pair_id"], StructField("old_key", StringType()), StructField("new_key", StringType()), StructField("similarity", DoubleType())])

    def match(pair: pa.Table) -> pa.Table:
        sides = {"old": [], "new": []}
        for side, *row in zip(*(pair.column(c).to_pylist() for c in ("side", "ordinal", "node_key", "text"))):
            sides[side].append(row)
        for listed in sides.values():
            listed.sort(key=lambda row: (row[0] is not None, row[0], row[1]))  # nulls first, as Spark sorts
        found = [list(c) for c in zip(*_greedy(sides["old"], sides["new"], threshold))] or [[], [], []]
        types = (pa.string(), pa.string(), pa.float64())
        return pa.table([pair.column("pair_id").slice(0, len(found[0])), *map(pa.array, found, types)], names=schema.names)

    return rows.select("pair_id", "side", "at.ordinal", "at.node_key", "text").groupBy("pair_id").applyInArrow(match, schema)


def match_renumbered(removed: DataFrame, added: DataFrame, threshold: float = 0.9) -> DataFrame:
    """V5. pair_id, old_key, new_key, similarity: per pair, removed keys in old
    order each take the unused new key of highest similarity (at least the
    threshold; the earlier one on a tie). Order is by (ordinal, node_key); a
    key comes once on each side of a pair; null texts count as empty.

    removed, added: pair_id, node_key, ordinal, text. A pair of up to IN_TASK is
    matched in one task. A larger pair's rows are never gathered there: texts
    meet by shared character pieces, equal texts that are alike to no other are
    matched by their ranks, the rest by rounds of joins; of texts that are alike
    but not all equal, each old one is listed with each new one.
    """
    if not 0 < threshold <= 1:
        raise ValueError(f"a threshold above 0, up to 1, is needed: {threshold}")
    at = F.struct("ordinal", "node_key")
    rows = [df.select("pair_id", F.lit(side).alias("side"), at.alias("at"), F.coalesce("text", F.lit("")).alias("text")) for side, df in (("old", removed), ("new", added))]
    rows = rows[0].union(rows[1])
    load = {side: F.sum(F.when(F.col("side") == side, F.length("text") + 1000)) for side in ("old", "new")}
    pairs = rows.groupBy("pair_id").agg(load["old"].cast("double").alias("old"), load["new"].cast("double").alias("new"), F.sum(F.length("text")).alias("size"))
    fits = (F.col("old") * F.col("new") <= IN_TASK) & (F.col("size") <= CHARACTERS_IN_TASK)
    pairs = checkpointed(pairs.where("old is not null and new is not null").select("pair_id", fits.alias("fits")))
    found = _matched_in_tasks(rows.join(pairs.where("fits"), "pair_id", "left_semi"), threshold)
    if pairs.where("not fits").isEmpty():
        return found
    large = pairs.where("not fits")
    return found.union(_matched_by_joins(*(df.join(large, "pair_id", "left_semi") for df in (removed, added)), threshold))


def _matched_by_joins(removed: DataFrame, added: DataFrame, threshold: float) -> DataFrame:
    at = F.struct("ordinal", "node_key")
    rows = [df.select("pair_id", "node_key", at.alias("at"), F.coalesce("text", F.lit("")).alias("text")) for df in (removed, added)]
    classes = [df.groupBy("pair_id", "text").agg(F.min("at").alias("first")).select("pair_id", "text", F.col("first.node_key").alias("class")) for df in rows]
    classes = [checkpointed(df) for df in classes]
    members = [checkpointed(df.join(c, ["pair_id", "text"]).select("pair_id", "class", "node_key", "at")) for df, c in zip(rows, classes)]
    equal = classes[0].withColumnRenamed("class", "old_class").join(classes[1].withColumnRenamed("class", "new_class"), ["pair_id", "text"]).select("pair_id", "old_class", "new_class", F.lit(1.0).alias("similarity"))
    alike = equal if threshold == 1 else equal.union(similar_classes(*classes, threshold))
    alike = checkpointed(alike)
    # A class that is alike to one other, which is alike to no third, is by itself.
    n = {side: alike.groupBy("pair_id", f"{side}_class").agg(F.count("*").alias(f"{side}_n")) for side in ("old", "new")}
    alike = alike.join(n["old"], ["pair_id", "old_class"]).join(n["new"], ["pair_id", "new_class"])
    alone = (F.col("old_n") == 1) & (F.col("new_n") == 1)
    in_class = Window.partitionBy("pair_id", "class").orderBy("at")
    ranked = [checkpointed(df.withColumn("rank", F.row_number().over(in_class))) for df in members]
    olds, news = (df.select("pair_id", F.col("class").alias(f"{s}_class"), F.col("node_key").alias(f"{s}_key"), F.col("at").alias(f"{s}_at"), F.col("rank").alias(f"{s}_rank")) for s, df in zip(("old", "new"), ranked))
    by_rank = alike.where(alone).join(olds, ["pair_id", "old_class"]).withColumn("new_rank", F.col("old_rank")).join(news, ["pair_id", "new_class", "new_rank"])
    rest = alike.where(~alone).join(olds, ["pair_id", "old_class"]).join(news, ["pair_id", "new_class"])
    rest = rest.select("pair_id", "old_class", F.col("old_rank").alias("rank"), "old_key", "old_at", "new_key", "new_at", "similarity")
    columns = ["pair_id", "old_key", "new_key", "similarity"]
    return by_rank.select(*columns).union(_settle(rest).select(*columns))
