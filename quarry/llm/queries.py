"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import alignment, brown_lm, conversations, jpeg, mixing, packing, quality, sharding, simhash, suffixes, token_files, toxicity, warc
from quarry.llm.storage import materialize
from quarry.session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.deduplicate_pages(spark, _table(spark, sf_dir, "pages"))


def op6_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_files.encode_and_read_back(spark, docs, public_tokenizers.path("word_bpe_49k.json"), 1, True)


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (
  SELECT page_id, octet_length(encode(payload)) AS payload_bytes,
         array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha1(payload), 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT + 1, 1) FOR k IN range(0, 32)], '') AS payload_digest
  FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM m
"""


def op3_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score_documents(_table(spark, sf_dir, "documents"))


def op10_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media_features(materialize(jpeg.encode_media(_table(spark, sf_dir, "documents")), "media"))


def op4_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy v1 decides; the strict one, and what v1 would keep without a rule, come from the same stored ledger."""
    led = materialize(quality.ledger(_table(spark, sf_dir, "documents")), "quality-ledger")
    base_failed, strict = quality.fails(F.col("fail_bits"), quality.BASE), ~quality.fails(F.col("fail_bits"), quality.POLICIES["strict"])
    decided = quality.apply_policy(led, quality.V1).withColumns({"base_failed": base_failed, "kept_strict": strict, "only_rule": quality.only_rule(F.col("fail_bits"), quality.V1)})
    regained = quality.ablation(led, quality.V1).select(F.col("rule").alias("only_rule"), F.col("n_failed_alone").alias("regained"))
    # One row for each rule of the policy.
    return decided.join(F.broadcast(regained), "only_rule", "left").select(
        "doc_id", *quality.MEASUREMENTS, "base_failed", "kept", "fail_bits", "kept_strict", "only_rule", "regained"
    )


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, text, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS words,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM documents),
pos AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS s FROM pos),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS j FROM rep, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id)),
b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN word_chars < 3 * n_words THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 10 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 30 * greatest(n_lines, 1) THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 7) = 0 AS kept, fail_bits, fail_bits = 0 AS kept_strict,
       CASE fail_bits & 7 WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_windows' WHEN 4 THEN 'many_symbols' END AS only_rule,
       CASE WHEN fail_bits & 7 IN (1, 2, 4) THEN count(*) OVER (PARTITION BY fail_bits & 7) END AS regained
FROM b
"""

def op5_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle_documents(_table(spark, sf_dir, "documents"), 24)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len([x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''])::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT] AS w, 3 * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / sum(w) OVER (ORDER BY cap::DOUBLE / w, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, least(cap::DOUBLE, w * (SELECT max(level) FROM l)) AS target FROM l),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
c AS (
  SELECT d.doc_id, d.size, f.source_size, f.target, f.whole, CASE WHEN f.source_size > 0 THEN f.target - f.whole * f.source_size ELSE 0 END AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target,
       (size * least(3, whole + CASE WHEN upto <= rest OR (upto - size <= rest AND upto - rest < rest - (upto - size)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""

def op8_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(_table(spark, sf_dir, "conversations"))


def op12_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents"))


def op13_lockstep_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align_documents(_table(spark, sf_dir, "documents"), *paths)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity_lexicon": op1_toxicity_lexicon,
    "op2_warc_revisits": op2_warc_revisits,
    "op3_bm25_packing": op3_bm25_packing,
    "op4_quality_ledger": op4_quality_ledger,
    "op5_hypergeometric_shards": op5_hypergeometric_shards,
    "op6_token_frames": op6_token_frames,
    "op7_mix_sources": op7_mix_sources,
    "op8_simhash_variants": op8_simhash_variants,
    "op9_brown_lm": op9_brown_lm,
    "op10_jpeg_media": op10_jpeg_media,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_suffix_repeats": op12_suffix_repeats,
    "op13_lockstep_alignment": op13_lockstep_alignment,
}
ORACLES: dict[str, str] = {"op2_warc_revisits": OP2_SQL, "op4_quality_ledger": OP4_SQL, "op7_mix_sources": OP7_SQL}
