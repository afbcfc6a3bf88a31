"""The queries of this subpackage: thin, over whole tables."""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.llm import decontamination, fingerprints, language_id, license_scan, phrases, pieces, pii, runs, sharding, signature_join, simhash, succession, token_counts, token_files
from lexlake.shared import shared_dir

N_SHARDS = 16
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
PIECE_END, BYTE_END = 2, 2
PII_KEY = "surrogates-1"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(documents(spark, sf_dir), N_SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    lex = spark.sparkContext.broadcast(fingerprints.lexicon(docs))

    def make():
        return fingerprints.fingerprinter(lex.value)

    def pair(of, doc_id, text, own, after, after_own):
        cut = len(text) // 2
        edited = text[: len(text) - cut] + after[:cut]
        of_edited = of(edited)
        digest = hashlib.sha256(edited.encode()).hexdigest()
        return doc_id, len(text), digest, own, of_edited, fingerprints.likeness(own, of_edited), fingerprints.likeness(own, after_own)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return succession.with_next(docs, pair, schema, "doc_id", "text", make)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode_pieces(documents(spark, sf_dir).select("doc_id", "text"), PIECE_BPE, end_id=PIECE_END)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.predict_language(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = license_scan.scan_licences(docs, license_scan.licence_idf(docs))
    base = F.filter("places", lambda p: p["base"])
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    starts = F.transform(base, lambda p: p["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        "score",
    )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_token_blocks(documents(spark, sf_dir), path, BYTE_BPE, BYTE_END)

    def digests(keys, starts, ends, ids):
        raw, bounds = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B"), [0, *ends]
        crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1], bounds[1:])]
        counts = [b - a for a, b in zip(bounds[:-1], bounds[1:])]
        return pa.record_batch([pa.array(c, pa.int64()) for c in (keys, starts, counts, crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return token_files.map_documents(spark, path, digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_token_counts(documents(spark, sf_dir), BYTE_BPE)


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(documents(spark, sf_dir).select("doc_id", "text"), PII_KEY)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), shingle=3, radius=2)
    return found.select(
        simhash.from_key("key").alias("doc_id"), simhash.hex_digits().alias("fingerprint"), simhash.from_key("component").alias("component_id")
    )


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the documents the words from one on become periodic."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[ \t\n\x0B\f\r]+", -1), lambda w: w != "")
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    a = F.pmod(g, n).cast("int")
    p = (F.floor((n - F.col("a")) / (F.pmod(F.col("g"), F.lit(8)) + 3)) + 1).cast("int")
    planted = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when((F.col("h") % 10 == 0) & F.col("text").isNotNull(), words)).withColumn("g", g)
    planted = planted.withColumn("a", F.when(n > 0, a)).withColumn("p", p)
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p")))
    edited = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(F.col("w"), at(i).cast("int"))), " ")
    return planted.select("doc_id", F.when(F.col("a").isNotNull(), edited).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.collapse_runs(_with_planted_runs(documents(spark, sf_dir)))
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("best", F.when(F.size("runs") > 0, longest))
    length, period = -F.col("best.l"), F.col("best.period")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signature_join.jaccard_classes(documents(spark, sf_dir), shingle=4, percent=85)
    return found.select(simhash.from_key("key").alias("doc_id"), "n_shingles", simhash.from_key("component").alias("component_id"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(documents(spark, sf_dir), top=2000, least=30, percent=80)


def _phrase_sql() -> str:
    """Counts all phrases of one to four words, scores every cut, then ranks."""
    capital, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    windows = " UNION ALL ".join(
        f"SELECT lang, {k} AS k, array_to_string(w[i:i + {k - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(generate_series(1, len(w) - {k - 1})) AS i FROM words WHERE len(w) >= {k})" for k in range(1, 5)
    )
    cuts = " UNION ALL ".join(
        f"SELECT lang, phrase, f AS a, {i} AS cut, array_to_string(string_split(phrase, ' ')[1:{i}], ' ') AS x, array_to_string(string_split(phrase, ' ')[{i + 1}:], ' ') AS y FROM often WHERE k = {k}" for k in range(2, 5) for i in range(1, k)
    )
    parts = " UNION ALL ".join(
        f"SELECT lang, f, array_to_string(string_split(phrase, ' ')[{i}:{i + k - 1}], ' ') AS phrase FROM often WHERE k = {longer}" for longer in (3, 4) for k in range(2, longer) for i in range(1, longer - k + 2)
    )
    return f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{capital}', '{small}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
  words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
  every AS (SELECT lang, k, phrase, count(*) AS f FROM ({windows}) GROUP BY 1, 2, 3),
  total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM every WHERE k = 1 GROUP BY 1),
  often AS (SELECT * FROM every WHERE f >= 30),
  cuts AS (SELECT c.lang, c.phrase, c.a, c.cut, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (l.f + r.f) AS BIGINT) AS score FROM ({cuts}) c JOIN often l ON l.lang = c.lang AND l.phrase = c.x JOIN often r ON r.lang = c.lang AND r.phrase = c.y),
  best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS p FROM cuts),
  held AS (SELECT lang, phrase, max(f) AS most FROM ({parts}) GROUP BY 1, 2),
  kept AS (SELECT b.* FROM best b LEFT JOIN held h USING (lang, phrase) WHERE p = 1 AND (h.most IS NULL OR 100 * h.most < 80 * b.a)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
  SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_fingerprints": op2_fingerprints,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_decontamination": op4_decontamination,
    "op5_language_id": op5_language_id,
    "op6_license_scan": op6_license_scan,
    "op7_token_files": op7_token_files,
    "op8_token_counts": op8_token_counts,
    "op9_pii_surrogates": op9_pii_surrogates,
    "op10_simhash": op10_simhash,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_phrases": op13_phrases,
}

#: The engine of the SQL check has no CRC-32, XXH64, tokenizers or models, so
#: the other queries are tested against brute force instead (tests/llm).
ORACLES: dict[str, str] = {"op13_phrases": _phrase_sql()}
