"""Near-duplicate detection by min-max hashing.

Under each permutation of the shingles' hashes both the smallest and the largest value are kept, so half the hash
evaluations give a signature of the same length. Bands of six values put documents in common buckets; links found
there are confirmed on the full shingle sets. Documents of equal sets are one class and are compared once.

Buckets are worked through as ``graph.linked`` says.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_KEY, Staged, bounded_batches, keep_ids, row_key, semi_ids, with_row_key
from .graph import blocks_of, linked, neighbourhoods

#: 24 bands of six minima and 24 of the same permutations' maxima: a pair at similarity 0.8 is missed once in 2 million.
BANDS = 48
ROWS = 6
#: Rows and shingles of a block when what the hubs leave open is settled.
BLOCK_ROWS = 512
BLOCK_SHINGLES = 500_000
#: Blocks of an area that is settled as a whole; a larger one is settled bucket by bucket.
AREA_BLOCKS = 16
_MEMO = 150_000
_U64 = np.uint64


def permutations(bands: int, rows: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    n = bands // 2 * rows
    factor = rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)
    return factor, rng.integers(0, 1 << 32, n, dtype=np.uint32), rng.integers(0, 1 << 63, (rows, bands), dtype=np.uint64) | _U64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(31))) * _U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U64(29))) * _U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U64(32))


class Shingler:
    """Distinct hashes of the k-word shingles of lower-cased (A-Z) text; words are runs of anything but ASCII white space."""

    def __init__(self, k: int):
        import xxhash

        digest = xxhash.xxh3_64_intdigest

        class Memo(dict):
            def __missing__(memo, word):
                if len(memo) >= _MEMO:
                    memo.clear()
                memo[word] = h = digest(word)
                return h

        self.k, self.memo = k, Memo()

    def hashes(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, _U64)
        h = np.fromiter(map(self.memo.__getitem__, words), dtype=_U64, count=len(words))
        k = min(self.k, len(h))
        out = h[: len(h) - k + 1].copy()
        for i in range(1, k):
            out = _mix(out) + h[i : len(h) - k + 1 + i]
        return np.unique(_mix(out + _U64(k)))


class Banding:
    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        self.factor, self.shift, self.weights = permutations(bands, rows)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """One bucket key per band, from minima for the first half and maxima for the second."""
        x = (hashes >> _U64(32)).astype(np.uint32)
        low, high = np.empty(len(self.factor), np.uint32), np.empty(len(self.factor), np.uint32)
        step = max(1, 65536 // max(1, len(x)))
        for at in range(0, len(self.factor), step):
            y = x[None, :] * self.factor[at : at + step, None] + self.shift[at : at + step, None]
            y.min(axis=1, out=low[at : at + step])
            y.max(axis=1, out=high[at : at + step])
        half = self.bands // 2
        values = np.concatenate((low.reshape(half, self.rows), high.reshape(half, self.rows))).astype(_U64)
        mixed = (values.T * self.weights).sum(0, dtype=_U64)
        return _mix(mixed + np.arange(1, self.bands + 1, dtype=_U64)).view(np.int64)


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """rid, id, row_key (of id and text), n_shingles, digest of the set, one key per band (none for an empty set)."""
    id_type = docs.schema["id"].dataType.simpleString()
    rows_in = docs.select(F.monotonically_increasing_id().alias("rid"), "id", row_key("id").alias("row_key"), "text")

    def run(batches):
        import pyarrow as pa
        import xxhash

        shingler, banding = Shingler(shingle), Banding(bands, rows)
        for batch in batches:
            n, digests, keys = [], [], []
            for text in batch.column("text").to_pylist():
                h = shingler.hashes(text)
                n.append(len(h))
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                keys.append(banding.keys(h) if len(h) else np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("rid", "id", "row_key")), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))],
                names=["rid", "id", "row_key", "n", "digest", "keys"],
            )

    return rows_in.mapInArrow(run, f"rid long, id {id_type}, row_key string, n long, digest binary, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """digest and shingle hashes of the rows whose row_key is wanted."""
    rows = semi_ids(docs.select(row_key("id").alias("row_key"), "text"), "row_key", wanted)

    def run(batches):
        import pyarrow as pa
        import xxhash

        shingler = Shingler(shingle)
        for batch in batches:
            sets = [shingler.hashes(t) for t in batch.column("text").to_pylist()]
            if not sets:
                continue
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=["digest", "hashes"]
            )

    return rows.select("text").mapInArrow(run, "digest binary, hashes array<long>")


def near_groups(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, carry: str | None = None, root: str | None = None) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id (smallest key reachable by links), kept.

    Rows are linked when 100 |A and B| >= percent |A or B| for their sets of ``shingle``-word shingles; a text of fewer
    words is one shingle; null and empty texts have no shingle and are linked with nothing. Keys may repeat: each row
    is compared by its own text. A null key never names a component; a component of null keys only has a null id and
    its rows are kept. An empty table gives no row; extra columns are not read. ``carry`` names a column for the digest of
    key and text, as in ``common.with_row_key``, and ``root`` one for a number of the component, null without shingles.
    """
    bounded_batches(spark)
    staged = Staged(spark, "minhash")
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    rows_of = staged.write(signatures(docs, shingle, bands, rows), "signatures")
    classes = staged.write(
        rows_of.where("n > 0").groupBy("digest").agg(F.min(F.struct("rid", "row_key")).alias("one"), F.min("id").alias("first_id"), F.first("n").alias("n"), F.first("keys").alias("keys")).select("digest", F.col("one.rid").alias("cid"), F.col("one.row_key").alias("row_key"), "first_id", "n", "keys"),
        "classes",
    )
    in_bands = classes.select("cid", "n", F.explode("keys").alias("bucket"))
    shared = staged.write(in_bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket"), "shared")
    members = staged.write(in_bands.join(shared, "bucket"), "members")
    fits = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent
    parts = linked(staged, members, lambda pairs: _confirmed(staged, docs, classes, pairs, shingle, percent), lambda rows: _settled(staged, docs, classes, rows, shingle, percent), fits)

    # What is joined by set or by component is written first: the empty set or one group may hold a third of all rows.
    rooted = classes.select("cid", "digest", "first_id").join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    rooted = staged.write(rooted, "rooted")
    named = staged.write(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "named")
    by_digest = staged.write(rooted.join(named, "root").select("digest", "component_id", "root"), "by-set")
    out = rows_of.select("id", "row_key", "n", "digest").join(by_digest, "digest", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"), *([F.col("row_key").alias(carry)] if carry else []), *([F.col("root").alias(root)] if root else []))


def _fetched(staged: Staged, docs: DataFrame, classes: DataFrame, cids: DataFrame, shingle: int) -> DataFrame:
    """cid and shingle hashes of the wanted classes, from one text of each."""
    used = classes.select("cid", "digest", "row_key").join(cids, "cid", "left_semi")
    sets = _sets(docs, used.select("row_key"), shingle).join(used.select("cid", "digest"), "digest")
    return staged.write(sets.groupBy("cid").agg(F.first("hashes").alias("hashes")), "sets")


def _confirmed(staged: Staged, docs: DataFrame, classes: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The (x, y) pairs of classes whose full sets are similar enough."""
    sets = _fetched(staged, docs, classes, pairs.select(F.explode(F.array("x", "y")).alias("cid")).distinct(), shingle)
    left, right = (sets.select(F.col("cid").alias(c), F.col("hashes").alias(f"h_{c}")) for c in "xy")
    both = pairs.join(right, "y").join(left, "x")
    common = F.size(F.array_intersect("h_x", "h_y"))
    union = F.size("h_x") + F.size("h_y") - common
    return both.where(common.cast("long") * 100 >= union.cast("long") * percent).select("x", "y")


def _settled(staged: Staged, docs: DataFrame, classes: DataFrame, open_rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links that join further components among the members of open buckets.

    Buckets that hang together by common members are an area. An area of few blocks is settled as a whole, so that a set
    travels once; a larger one bucket by bucket, so that the work follows the buckets and not the area's square. Groups are
    cut into blocks of bounded size; every two blocks of a group meet in one task, which counts common shingles by matrix
    products and gives no more links than it takes to join what they join.
    """
    rows = staged.write(neighbourhoods(staged, open_rows), "areas")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    size = lambda df, group: df.groupBy(F.col(group).alias("group")).agg(blocks, F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("group", "blocks")
    each = rows.select("area", "cid", "n", "root").distinct()
    areas = staged.write(size(each, "area"), "area-sizes")
    small, large = areas.where(F.col("blocks") <= AREA_BLOCKS), areas.where(F.col("blocks") > AREA_BLOCKS).select(F.col("group").alias("area"))
    wide = staged.write(rows.join(large, "area", "left_semi").select("bucket", "cid", "n", "root"), "wide")
    by_area = blocks_of(each.withColumnRenamed("area", "group"), small, ["group"]).select("cid", "root", F.lit(0).alias("kind"), "group", "block", "low", "high")
    by_bucket = blocks_of(wide.withColumnRenamed("bucket", "group"), staged.write(size(wide, "bucket"), "bucket-sizes"), ["group"]).select("cid", "root", F.lit(1).alias("kind"), "group", "block", "low", "high")
    met = staged.write(by_area.union(by_bucket), "met")
    sets = _fetched(staged, docs, classes, met.select("cid").distinct(), shingle)
    return met.join(sets, "cid").groupBy("kind", "group", "low", "high").applyInArrow(_joining(percent), "x long, y long").distinct()


def _joining(percent: int):
    def run(table):
        import pyarrow as pa

        cid, root, block = (table.column(c).to_numpy() for c in ("cid", "root", "block"))
        lists = table.column("hashes").combine_chunks()
        found = joining_links(cid, root, block, np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(), percent)
        return pa.table({"x": pa.array([f[0] for f in found], pa.int64()), "y": pa.array([f[1] for f in found], pa.int64())})

    return run


def joining_links(cid: np.ndarray, root: np.ndarray, block: np.ndarray, sizes: np.ndarray, flat: np.ndarray, percent: int, columns: int = 4096) -> list[tuple[int, int]]:
    """Links between sets of different roots, as few as join the same roots.

    With two blocks only pairs across them count; pairs within a block meet where it is alone. Sets are given one
    after another in ``flat``.
    """
    owner = np.repeat(np.arange(len(cid)), sizes)
    _, term, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[term] > 1
    owner, term = owner[shared], np.unique(term[shared], return_inverse=True)[1]
    two = block.min() != block.max() if len(block) else False
    left, right = (np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())) if two else (np.arange(len(cid)),) * 2
    place = np.full((2, len(cid)), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    common = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(term, kind="stable")
    owner, term = owner[order], term[order]
    width = int(term[-1]) + 1 if len(term) else 0
    for at in range(0, width, columns):
        a, b = np.searchsorted(term, (at, at + columns))
        mats = []
        for side, n in ((0, len(left)), (1, len(right))):
            m = np.zeros((n, min(columns, width - at)), np.float32)
            row = place[side, owner[a:b]]
            m[row[row >= 0], term[a:b][row >= 0] - at] = 1
            mats.append(m)
        common += mats[0] @ mats[1].T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    ok = (common * 100 >= union * percent) & (root[left][:, None] != root[right][None, :])
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(ok)):
        a, b = find(int(root[left[i]])), find(int(root[right[j]]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(cid[left[i]]), int(cid[right[j]])))
    return out


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, by (doc_id is null, doc_id, row key); all columns stay.

    Rows without shingles all stay. Of rows of a group that repeat both doc_id and text any one stays.
    """
    keyed, staged = with_row_key(docs), Staged(spark, "near")
    groups = staged.write(near_groups(spark, docs, carry=ROW_KEY, root="root").where("root IS NOT NULL").select("doc_id", ROW_KEY, "root"), "groups")
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW_KEY)).alias("first")).select(f"first.{ROW_KEY}")
    gone = staged.write(groups.join(first, ROW_KEY, "left_anti").select(ROW_KEY).distinct(), "gone")
    left = keep_ids(keyed, ROW_KEY, gone)
    again = staged.write(groups.groupBy(ROW_KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(ROW_KEY), "again")
    if not again.isEmpty():
        left = keep_ids(left, ROW_KEY, again).unionByName(semi_ids(left, ROW_KEY, again).dropDuplicates([ROW_KEY]))
    return left.drop(ROW_KEY)
