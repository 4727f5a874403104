"""Token counts through a digest cache.

A text's count is stored under (digest of its content, digest of the tokenizer file and library). Texts are joined to
the stored counts; only one text of each digest that is missing is encoded; the new counts are appended to the cache.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Counter
from .common import Staged, bounded_batches, keep_ids

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
_SPACES = "[\\x20\\x09-\\x0D]+"


def tokenizer_digest(path: str) -> str:
    """Names the tokenizer's version: its file's bytes and the library's version."""
    import tokenizers

    return hashlib.sha256(open(path, "rb").read() + tokenizers.__version__.encode()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def open_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """digest and n_tokens that the cache at ``path`` holds for a tokenizer; rows that two writers stored count once.

    Only that tokenizer's folder is read; a cache that is not there yet is empty.
    """
    if not _exists(spark, f"{path}/tokenizer={version}"):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    stored = spark.read.schema("digest binary, n_tokens long").parquet(f"{path}/tokenizer={version}")
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def compact_cache(spark: SparkSession, path: str, version: str, files: int = 8) -> None:
    """Rewrite a tokenizer's folder as ``files`` files without repeats. No other writer may append meanwhile.

    The new folder is complete before the old one goes; a run that ends in between leaves the new one beside it.
    """
    own, made = f"{path}/tokenizer={version}", f"{path}/_compacted-{version}"
    open_cache(spark, path, version).repartition(files, "digest").write.mode("overwrite").parquet(made)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(at(own), True)
    fs.rename(at(made), at(own))


def count_tokens(spark: SparkSession, docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: its key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null texts count as empty (0 bytes, 0 tokens); a null key stays null; repeated rows each give a row; extra columns
    are not read. Without ``cache_path`` the cache is new and lives with the staged tables.
    """
    bounded_batches(spark)
    staged = Staged(spark, "token-counts")
    cache_path = cache_path or staged.path("cache")
    version = tokenizer_digest(tokenizer_path)
    content = F.coalesce(F.col(text), F.lit(""))
    # White space only parts words for such files, so texts that differ in it alone share an entry.
    normal = F.regexp_replace(content, _SPACES, " ") if Counter(tokenizer_path).by_word else content
    keyed = docs.select(F.col(key).alias("id"), F.octet_length(content).cast("long").alias("n_bytes"), F.unhex(F.sha2(normal, 256)).alias("digest"), content.alias("content"))
    keyed = keyed.withColumn("row_key", F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("-")).cast("binary"), F.lit(b"\x1f"), "digest")))

    rows = staged.write(keyed.select("id", "n_bytes", "digest", "row_key"), "rows")
    stored = open_cache(spark, cache_path, version)
    first = rows.groupBy("digest").agg(F.min("row_key").alias("first_key")).join(stored.select("digest"), "digest", "left_anti")
    known = rows.join(first, (rows["row_key"] == first["first_key"]) & (rows["digest"] == first["digest"]), "left_anti").select("row_key")
    known = staged.write(known.distinct(), "known")
    misses = keep_ids(keyed.select("row_key", "digest", "content"), "row_key", known)

    def encode(batches):
        import pyarrow as pa

        counter = Counter(tokenizer_path)
        for batch in batches:
            n = counter.counts(batch.column("content").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(n), pa.string()), batch.column("digest").cast(pa.binary()), pa.array(n, pa.int64())], names=["tokenizer", "digest", "n_tokens"])

    misses.select("digest", "content").mapInArrow(encode, CACHE_SCHEMA).write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    counts = open_cache(spark, cache_path, version)
    return rows.join(counts, "digest", "left").select(F.col("id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
