"""Python functions over columns, with Arrow batches as transport."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


#: Arrow batches handed to Python hold at most so many bytes and rows, whatever the texts' length.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 1024


def bounded_batches(spark: SparkSession | None = None) -> None:
    """Keep the session's Arrow batches small in bytes; user settings that are smaller still stay."""
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        have = spark.conf.get(key).rstrip("b")
        if not have.isdigit() or not 0 < int(have) <= most:
            spark.conf.set(key, str(most))


def arrow_udf(run, schema: str):
    """``run`` as a function of Columns that gives ``schema``."""

    def call(*columns) -> Column:
        bounded_batches()
        return F.udf(run, schema, useArrow=True)(*columns)

    return call
