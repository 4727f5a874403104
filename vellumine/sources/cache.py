"""A content-addressed cache of what is read of regions or files, as Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cached(rows: DataFrame, content: str, version: str, path: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with the columns that ``compute`` gives for each distinct content.

    ``compute`` takes (digest, content) and returns digest and its columns. Results are kept below ``path`` by the digest of
    ``version`` and content; only digests that are not there are computed, once each, and appended. Null content is empty.
    """
    spark = rows.sparkSession
    digest = F.sha2(F.concat(F.lit(version + "\x1f").cast("binary"), F.coalesce(F.col(content).cast("binary"), F.lit(b""))), 256)
    keyed = rows.withColumn("__digest", digest)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    missing = keyed.select(F.col("__digest").alias("digest"), F.col(content).alias("content")).dropDuplicates(["digest"])
    if there:
        missing = missing.join(spark.read.parquet(path).select("digest"), "digest", "left_anti")
    compute(missing).write.mode("append").parquet(path)
    stored = spark.read.parquet(path).dropDuplicates(["digest"])
    return keyed.join(stored, keyed["__digest"] == stored["digest"], "left").drop("__digest", "digest")
