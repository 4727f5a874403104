"""From raw documents to packed training sequences, stage by stage; every stage is written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm import exact_dedup, langid, minhash, mixing, packing
from vellumine.llm.common import ROW_KEY, Staged, crc_mod, keep_ids, with_row_key
from vellumine.llm.queries import MIXTURE, tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without any language: null, empty and letterless texts, and those that share no n-gram with the best profile.

    Rows with a null doc_id take no part in learning but are judged like any other; repeated rows all stay or all go. Where
    no document names a language all go. An empty table gives none; columns of any other name pass through.
    """
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(True))
    profiles = langid.learn(spark, docs.where(~held_out))
    keyed = with_row_key(docs)
    found = langid.identify(keyed, profiles, key=ROW_KEY)
    gone = found.where((F.col("lang_pred") == langid.UNKNOWN) | (F.col("score") <= 0)).select(ROW_KEY).distinct()
    return keep_ids(keyed, ROW_KEY, Staged(spark, "language").write(gone, "gone")).drop(ROW_KEY)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: that of the smallest doc_id, null ids only where there is no other.

    Null texts equal empty ones. Of repeated rows one stays; an empty table gives none; further columns pass through.
    """
    return exact_dedup.drop_copies(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8) stays: that of the smallest doc_id, null ids last.

    Null and empty texts are near to nothing and stay. An empty table gives none; further columns pass through.
    """
    return minhash.keep_first(spark, docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the words by the tree's weights; one epoch, so that no copy comes back.

    Null languages and sources are leaves of their own; null and empty texts weigh nothing. Rows that repeat both doc_id and
    text are taken or left together. An empty table gives none; further columns pass through.
    """
    return mixing.keep_mixed(spark, docs, weights=MIXTURE, epochs=1)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, in sequences of 1024 tokens.

    A null text is one end token, a null source a queue of its own, repeated rows are packed as they come, an empty table
    gives no piece; columns other than doc_id, text and source are not read.
    """
    return packing.pack(spark, docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("language", language), ("exact dedup", exact), ("near dedup", near), ("mixture", mixture), ("packing", pack)]

#: Language profiles, the seeded order and the tokenizer have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    staged = Staged(spark, "pipeline")
    for name, stage in STAGES:
        docs = staged.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
