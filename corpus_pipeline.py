"""A training corpus in five stages, each written as Parquet and read again.

Language ID → SimHash near-dedup → decontamination → PII surrogates →
SentencePiece ids. A stage takes (spark, docs, sf_dir), works on all that its
predecessor kept and, but for the last, returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.llm import decontamination, language_id, pieces, pii, simhash
from lexlake.llm.common import if_small, row_key, stored
from lexlake.llm.queries import PIECE_BPE, PIECE_END, PII_KEY

#: A document is rejected as undetermined, or if its language's share is below this.
LEAST_LANGUAGE_SCORE = 0.5
#: Near-duplicates: five-word shingles, 1024 bits. A similarity of 0.8 differs in
#: 155 bits on average (standard deviation 11), in 192 (12) at worst, for sets of
#: 4 and 5 shingles; of the first 128 bits in 19 (4) or 24 (4), unrelated texts in
#: 64 (6). So the radius only finds candidates; the shingle sets decide.
SHINGLE, LANES, RADIUS, COARSE, LIKENESS = 5, 16, 240, 42, 0.8


def _free(docs: DataFrame, *names: str) -> list[str]:
    """Column names that the caller's columns leave free."""
    return [next(n for k in range(len(docs.columns) + 1) if (n := f"__{name}{k or ''}") not in docs.columns) for name in names]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a determined language; null and letterless texts go.
    Repeated rows share their fate; an empty table stays empty."""
    lang, score = _free(docs, "lang", "score")
    found = language_id.predict_language(docs, language_id.fit(docs), pred_col=lang, score_col=score)
    known = (F.col(lang) != language_id.UNDETERMINED) & (F.col(score) >= LEAST_LANGUAGE_SCORE)
    return found.where(known).select(*docs.columns)


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """With a row's key and the hash of its text under these names."""
    return docs.withColumns({key: row_key("doc_id", "text"), text: F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the smallest id. Equal rows count once.
    Texts without a word are one group; an empty table stays empty."""
    key, text = _free(docs, "key", "text")
    found = simhash.near_duplicates(docs, SHINGLE, RADIUS, LANES, LIKENESS, COARSE)
    gone = stored(found.where("key <> component").select(F.col("key").alias(key), F.col("text_hash").alias(text)).distinct())
    kept = _named(docs, key, text).join(if_small(gone), [key, text], "left_anti")
    return kept.dropDuplicates([key, text]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, told apart by id (null or not) and
    text, so repeated rows go or stay together. Null and empty texts hold no item;
    without a benchmark or documents all stay."""
    key, text, own = _free(docs, "id", "text", "own")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = stored(decontamination.of_texts(docs, benchmark).select(F.col("doc_id").alias(key), F.col("text_hash").alias(text)).distinct())
    named = docs.withColumn(own, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    gone = F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(own) == F.col(text))
    return named.join(if_small(found), gone, "left_anti").select(*docs.columns)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, their entities replaced; n_chars is counted again.
    Null texts stay null, with n_chars null; equal texts are replaced alike."""
    (count,) = _free(docs, "n_entities")
    found = pii.replace_pii(docs, PII_KEY, count_col=count)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (end id last), n_tokens and the text decoded from the ids, of
    each row. Null texts are empty: the end id alone."""
    encoded = pieces.encode_pieces(docs.select("doc_id", "text"), PIECE_BPE, end_id=PIECE_END)
    return encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded")


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii_surrogates", replace_pii),
    ("sentencepiece", encode_pieces),
]

#: SQL has no models, simhashes or tokenizers: tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents, each but the last written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
