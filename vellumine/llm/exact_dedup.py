"""Exact dedup over an extendible-hash index on shared files.

Texts are equal when identical after each run of ASCII white space is made one space. The index is a table on the
shared folder: one record per row, with the text only for the first of equal texts within a task's window. A directory
over the leading bits of the records' 64-bit keys is doubled until no bucket is overfull; buckets that are overfull at
the directory's greatest depth are split on further bits of their own. Owner tasks take whole buckets, walk their records in key order, chain records of one key and compare the texts' bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_KEY, Staged, bounded_batches, keep_ids, with_row_key

#: Leading key bits that the directory may use; its histogram, at most 2**20 rows, is read by the driver. Beyond them a
#: bucket has sub-buckets by its next bits, which executors work out.
MAX_DEPTH = 20
#: Text bytes that one owner task is meant to take, and buckets per owner, so that tasks come out even.
OWNER_BYTES = 48 << 20
BUCKETS_PER_OWNER = 32
#: Text bytes that a task remembers to fold equal texts before the shuffle.
LOCAL_BYTES = 24 << 20

_RECORD = "rid long, id {id}, carry string, sha string, key long, rep long, bytes long, text string"
#: Only runs that the normalisation changes.
_RUNS = "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+"


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), _RUNS, " ")


def directory(sizes: dict[int, int], capacity: int, depth: int = MAX_DEPTH) -> tuple[int, list[int]]:
    """Global depth g and the bucket of each of the 2**g leading-bit patterns, for bytes by ``depth``-bit prefix.

    Starts with one bucket; an overfull bucket is split on its next bit, and the directory is doubled when that bucket
    already uses all g bits. A bucket whose records share ``depth`` bits is left as it is: splitting cannot relieve it.
    """
    prefix, filled = [0] * ((1 << depth) + 1), [0] * ((1 << depth) + 1)
    for p in range(1 << depth):
        prefix[p + 1] = prefix[p] + sizes.get(p, 0)
        filled[p + 1] = filled[p] + (p in sizes)
    buckets, waiting, deepest = [], [(0, 0)], 0
    while waiting:
        bits, local = waiting.pop()
        low, high = bits << (depth - local), (bits + 1) << (depth - local)
        if prefix[high] - prefix[low] > capacity and filled[high] - filled[low] > 1:
            waiting += [(bits << 1 | 1, local + 1), (bits << 1, local + 1)]
            deepest = max(deepest, local + 1)
        else:
            buckets.append((bits, local))
    entries = [0] * (1 << deepest)
    for number, (bits, local) in enumerate(buckets):
        low = bits << (deepest - local)
        entries[low : low + (1 << (deepest - local))] = [number] * (1 << (deepest - local))
    return deepest, entries


def index_records(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: str | None = None) -> DataFrame:
    """The index's records. ``rep`` is the rid of the first equal text that the task remembers; texts stay on those."""
    id_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("id"), (F.col(carry) if carry else F.lit(None)).cast("string").alias("carry"), normalised(text).alias("text"))
    rows = rows.select("rid", "id", "carry", F.sha2("text", 256).alias("sha"), F.xxhash64("text").alias("key"), "text")

    def fold(batches):
        import pyarrow as pa

        known: dict[int, list[tuple[str, int]]] = {}
        held = 0
        for batch in batches:
            reps, sizes, texts = [], [], []
            for rid, key, text in zip(batch.column("rid").to_pylist(), batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                chain = known.setdefault(key, [])
                rep = next((r for t, r in chain if t == text), None)
                if rep is None:
                    rep = rid
                    chain.append((text, rid))
                    held += len(text)
                    texts.append(text)
                    sizes.append(len(text))
                else:
                    texts.append(None)
                    sizes.append(0)
                reps.append(rep)
                if held > LOCAL_BYTES:
                    known, held = {}, 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("id"), batch.column("carry"), batch.column("sha"), batch.column("key"), pa.array(reps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(texts, pa.string())],
                names=["rid", "id", "carry", "sha", "key", "rep", "bytes", "text"],
            )

    return rows.mapInArrow(fold, _RECORD.format(id=id_type))


def _chains(batches):
    """Owner's side: rows come in (bucket, key) order; gives each record's rid and that of the first equal text."""
    import pyarrow as pa

    current, chain = None, []
    for batch in batches:
        firsts = []
        rids = batch.column("rid").to_pylist()
        for rid, key, text in zip(rids, batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            if key != current:
                current, chain = key, []
            first = next((r for t, r in chain if t == text), None)
            if first is None:
                first = rid
                chain.append((text, rid))
            firsts.append(first)
        yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(firsts, pa.int64())], names=["rep", "first"])


def exact_groups(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", carry: str | None = None) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256, and the string column ``carry`` if named.

    Null texts count as empty and equal each other. Of equal texts the smallest key stays (null keys only when there is
    no other; of repeated keys one row). A group of any size reaches an owner as one record per task that met it. An
    empty table gives no row; extra columns are not read.
    """
    bounded_batches(spark)
    staged = Staged(spark, "exact-dedup")
    records = staged.write(index_records(docs, key, text, carry), "records")
    texts = records.where(F.col("text").isNotNull())
    distinct = staged.write(texts.groupBy("key").agg(F.max("bytes").alias("bytes")), "sizes")  # copies of a hot text do not split its bucket
    total = distinct.agg(F.sum(F.col("bytes") + 64)).first()[0] or 0
    owners = max(1, -(-total // OWNER_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    capacity = max(1 << 12, total // (owners * BUCKETS_PER_OWNER))
    depth = min(MAX_DEPTH, (total // capacity).bit_length() + 2)
    prefix = F.shiftrightunsigned(F.col("key"), 64 - depth).cast("int")
    sizes = {r["prefix"]: r["bytes"] for r in distinct.groupBy(prefix.alias("prefix")).agg(F.sum(F.col("bytes") + 64).alias("bytes")).collect()}
    used, entries = directory(sizes, capacity, depth)
    full = lambda slot: max(0, (sizes.get(slot, 0) - 1) // capacity).bit_length() if used == MAX_DEPTH else 0
    table = spark.createDataFrame([(slot, bucket, full(slot)) for slot, bucket in enumerate(entries)], "slot int, bucket int, more int")
    slot = F.shiftrightunsigned(F.col("key"), 64 - used).cast("int") if used else F.lit(0)
    within = F.when(F.col("more") > 0, F.expr(f"shiftrightunsigned(shiftleft(key, {used}), 64 - more)")).otherwise(F.lit(0).cast("long"))
    owned = texts.select("rid", "key", "text", slot.alias("slot")).join(F.broadcast(table), "slot").select("bucket", within.alias("within"), "key", "rid", "text")
    first = owned.repartition(owners, "bucket", "within").sortWithinPartitions("bucket", "within", "key", "rid").select("rid", "key", "text").mapInArrow(_chains, "rep long, first long")

    members = staged.write(records.select("rid", "id", "carry", "sha", "rep").join(first, "rep").select("rid", "id", "carry", "sha", "first"), "members")
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "rid")).alias("best")
    # Written before it is joined, so that a group that holds a large part of all rows can be split.
    groups = staged.write(members.groupBy("first").agg(best, F.count(F.lit(1)).alias("group_size")), "groups")
    return members.join(groups, "first").select(
        F.col("id").alias(key), F.col("best.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), F.col("sha").alias("text_sha256"), *([F.col("carry").alias(carry)] if carry else [])
    )


def drop_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns stay."""
    keyed = with_row_key(docs)
    groups = Staged(spark, "copies").write(exact_groups(spark, keyed, carry=ROW_KEY).select(ROW_KEY, "kept"), "kept")
    by_row = Staged(spark, "copies").write(groups.groupBy(ROW_KEY).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "by-row")
    left = keep_ids(keyed, ROW_KEY, by_row.where(~F.col("kept")).select(ROW_KEY))
    # Rows that agree in doc_id and text cannot be told apart by key; one of them stays.
    if by_row.where("kept AND n > 1").limit(1).count():
        left = left.dropDuplicates([ROW_KEY, "doc_id", "text"])
    return left.drop(ROW_KEY)
