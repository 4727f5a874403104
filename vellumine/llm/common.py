"""Shared plumbing: the folder all executors see, staged tables, Arrow row loops, keep/drop joins."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Arrow batches handed to Python hold at most so many bytes and rows, whatever the texts' length.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 1024
#: A set of ids is broadcast only after it has been counted and found no larger than this (32 bytes each).
BROADCAST_IDS = 500_000

_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; where that is unset, one of our own in local mode and an error on a cluster."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
            if checkpoint.isDefined():
                base = checkpoint.get()
            elif spark.sparkContext.master.startswith("local["):
                base = "file://" + tempfile.mkdtemp(prefix="vellumine-")
            else:
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"{base.rstrip('/')}/vellumine-{uuid.uuid4().hex}"
        _roots[app] = root
        atexit.register(_remove, spark, root)
    return _roots[app]


def _remove(spark: SparkSession, path: str) -> None:
    jsc = spark.sparkContext._jsc
    if jsc is None:
        return
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)


class Staged:
    """Tables written to the shared folder, so that no lineage is recomputed and lost executors cost only their tasks."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:8]}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_path = path
        return out

    def write_observed(self, df: DataFrame, name: str, *aggregates) -> tuple[DataFrame, tuple]:
        """The staged table and the values of ``aggregates`` over it, taken while it is written."""
        seen = Observation()
        out = self.write(df.observe(seen, *(a.alias(f"a{i}") for i, a in enumerate(aggregates))), name)
        return out, tuple(seen.get[f"a{i}"] for i in range(len(aggregates)))

    def drop(self, df: DataFrame) -> None:
        """Delete a staged table that no later plan reads."""
        _remove(self.spark, df._staged_path)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in bytes; user settings that are smaller still stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        have = spark.conf.get(key).rstrip("b")
        if not have.isdigit() or not 0 < int(have) <= most:
            spark.conf.set(key, str(most))


def arrow_rows(make: Callable[[], Callable[[list, list[list]], Iterable[tuple]]], schema: str | T.StructType, flush: int = 2000):
    """A mapInArrow function: ``make()`` runs once a task and returns ``row(values) -> iterable of output tuples``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*(_values(c) for c in batch.columns)):
                out.extend(step(*row))
                if len(out) >= flush:
                    yield _batch(out, arrow)
                    out = []
        if out:
            yield _batch(out, arrow)

    return run


def _values(column: pa.Array) -> list:
    return column.to_pylist()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def keep_ids(docs: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``key`` is in the one column of ``dropped``.

    The ids are broadcast when a count shows at most BROADCAST_IDS of them; beyond that both sides are shuffled.
    """
    gone = dropped.select(F.col(dropped.columns[0]).alias("__gone"))
    if gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[key] == gone["__gone"], "left_anti")


def semi_ids(docs: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``docs`` with only the rows whose ``key`` is in the one column of ``wanted``; broadcast as in ``keep_ids``."""
    ids = wanted.select(F.col(wanted.columns[0]).alias("__wanted"))
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[key] == ids["__wanted"], "left_semi")


def crc_mod(column, n: int):
    """crc32(id as text) mod n, the fold of a row."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


ROW_KEY = "__row_key"


def row_key(key: str = "doc_id", text: str = "text"):
    """128 bits of id and text, which tell rows apart where ids repeat or are null; null and empty differ."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return F.md5(F.concat(part(key), F.lit("\x1f"), part(text)))


def with_row_key(docs: DataFrame) -> DataFrame:
    """``docs`` and the key of doc_id and text."""
    return docs.withColumn(ROW_KEY, row_key())
