"""The opN queries: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import jaccard as _jaccard
from tessella.llm import lines as _lines
from tessella.llm import mix as _mix
from tessella.llm import quality as _quality
from tessella.llm import quotes as _quotes
from tessella.llm import signs as _signs
from tessella.llm import suffixes as _suffixes
from tessella.llm import tokens as _tokens
from tessella.llm import toxicity as _toxicity
from tessella.llm import webp as _webp
from tessella.llm.common import held_out, table


def op1_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = _quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = _quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= _quality.THRESHOLD).cast("int").alias("predicted"))


def op2_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _quotes.conversations(table(spark, sf_dir, "conversations"))
    return found.withColumn("body_sha256", F.sha2(F.coalesce("body", F.lit("")).cast("binary"), 256)).drop("body")


def op3_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _webp.media_columns(table(spark, sf_dir, "documents")).drop("media")


def op4_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _lines.remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), min_chars=_lines.EVERY_LINE)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op5_shingle_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op7_sign_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signs.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = _toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = _toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    docs = table(spark, sf_dir, "documents")
    return _tokens.round_trip(docs, public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = _mix.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES = {
    "op1_quality_ranking": op1_quality_ranking,
    "op2_quote_threads": op2_quote_threads,
    "op3_lossless_webp": op3_lossless_webp,
    "op4_line_spread": op4_line_spread,
    "op5_shingle_jaccard": op5_shingle_jaccard,
    "op6_suffix_family": op6_suffix_family,
    "op7_sign_hashing": op7_sign_hashing,
    "op8_toxicity_nnpu": op8_toxicity_nnpu,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_source_mix": op10_source_mix,
}

ORACLE_SQL = {
    "op2_quote_threads": _quotes.BODY_ORACLE,
    "op4_line_spread": "WITH ld_docs AS (SELECT doc_id, text, source FROM documents), " + _lines.ORACLE_CTES + "SELECT doc_id, n_lines, n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM ld_kept",
    "op5_shingle_jaccard": _jaccard.ORACLE,
    "op7_sign_hashing": _signs.ORACLE,
    "op10_source_mix": "WITH mx_docs AS (SELECT * FROM documents), " + _mix.MIX_CTES + "SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken FROM mx_mixed",
}
