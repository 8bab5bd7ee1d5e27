"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.storage import drop_stored as drop_staged
from tessella.storage import shared_folder, stored
from tessella.storage import sized_join as guarded_join

__all__ = ["ARROW_BYTES", "WORD", "drop_staged", "guarded_join", "held_out", "modest_batches", "shared_folder", "staged", "table", "text_key"]

#: A word: bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows handed to a Python worker at once; rows may hold very long texts.
ARROW_BYTES = 4 << 20


def modest_batches(df: DataFrame) -> DataFrame:
    """df, after its session's Arrow batches were limited to ARROW_BYTES (unless a lower limit is set)."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(conf.get(key, "67108864b")).rstrip("bB")) > ARROW_BYTES:
        conf.set(key, f"{ARROW_BYTES}b")
    return df


def staged(df: DataFrame) -> DataFrame:
    """df, written in the shared folder and read back."""
    return stored(df, "staged")


def text_key(col: Column | str) -> Column:
    """128-bit key of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")))


def held_out(doc_id: Column | str) -> Column:
    """The fold that no model learns from: crc32 of the id's text modulo 5 is 0."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")), F.lit(5)) == 0
