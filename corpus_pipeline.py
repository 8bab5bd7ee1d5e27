"""A pipeline over documents: each stage works on all that the one before kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import jaccard, lines, mix, tokens, toxicity
from tessella.llm.common import staged, table, text_key
from tessella.storage import drop_stored, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5. Null and empty texts get the score of a text without words, which is
    low. Repeated rows share their score; an empty table gives no rows."""
    # the model learns from the corpus as given; the scores are those of what came in
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, into="tx_score").filter("tx_score < 0.5").select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that occur on many sites; n_chars follows. A null text stays null, and so does its
    n_chars; an empty table gives no rows."""
    return lines.remove_boilerplate(docs, min_chars=lines.EVERY_LINE).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the least id (null last, then by text). Of rows that are
    equal in id and text one stays. Documents without words are in no group, and all of them stay. An empty table gives
    no rows."""
    worded = docs.filter(mix.words("text") > 0).withColumn("nk", F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", text_key("text").alias("t")))
    rows = jaccard.near_duplicates(worded, doc_id="nk")
    kept = staged(rows.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("nk")).distinct())
    chosen = worded.join(kept.hint("merge"), "nk", "left_semi").dropDuplicates(["nk"])
    return chosen.select(*COLUMNS).unionByName(docs.filter(mix.words("text") == 0).select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Null and empty texts are taken as often as is certain; an empty table
    gives no rows."""
    return mix.repeated(mix.mix(docs), COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the hashes of the ids and of the text decoded from them, a row per document and copy. A null
    text is an empty one; an empty table gives no rows."""
    import public_tokenizers as public

    return tokens.round_trip(docs, public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_boilerplate),
    ("ngram_jaccard", one_of_each_group),
    ("source_mix", mix_sources),
    ("byte_bpe", tokenise),
]

#: Learning, the similarity join and tokenising are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to documents. What a stage wrote goes when the next one has been written."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    before = None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{i}-{name}")
            drop_stored(before)
            before = docs
    return docs
