"""Near-duplicate vectors by lattice hashing.

Unit vectors are projected at random to a few 8-dimensional blocks, and each block is decoded to the nearest point of
the E8 lattice; the blocks' points together are a cell. In each of several tables a vector lives in its own cell and
asks the likeliest neighbouring ones. Vectors of which one asks for the other's cell are candidates; cosine in double
precision decides. Each is first compared with its cell's hub. What is then still apart is compared only where its
angle to the hub allows a link, inside tasks, by blocks of vectors.

Links are counted within components by blocks of vectors, and without comparison among those so close to the
component's centre that any two of them must be linked.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Staged, bounded_batches
from .graph import blocks_of, components

TABLES = 24
PROBES = 4
#: Up to how many vectors, blocks of a cell and scale of their projections: one setting for any number, so that whether a
#: pair is found never depends on what else is in the table. At cosine 0.95 the recall of a pair is 0.998 or more, and two
#: random vectors meet with probability 1e-5 in 64 dimensions.
SIZES = ((math.inf, 3, 1.5),)
#: Vectors of a block when links are counted, and when what the hubs leave apart is settled.
BLOCK = 512


def _d8(x: np.ndarray) -> np.ndarray:
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(1) % 2)
    off = x[odd] - near[odd]
    worst = np.abs(off).argmax(1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] < 0, -1, 1)
    return near


def e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: the nearer of the nearest in D8 and in D8 shifted by one half."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i):
            for s in (-1, 1):
                for t in (-1, 1):
                    v = np.zeros(8)
                    v[i], v[j] = s, t
                    out.append(v)
    for bits in range(256):
        v = np.array([0.5 if bits >> k & 1 else -0.5 for k in range(8)])
        if (v < 0).sum() % 2 == 0:
            out.append(v)
    return np.array(out)


class Lattice:
    """Cell keys of unit vectors: the own cell and ``probes`` neighbours in each table."""

    def __init__(self, dim: int, tables: int = TABLES, blocks: int = SIZES[0][1], probes: int = PROBES, scale: float = SIZES[0][2], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.tables, self.blocks, self.probes = tables, blocks, probes
        self.maps = rng.normal(0, scale / math.sqrt(8), (tables, blocks, dim, 8)) if dim else None
        self.weights = rng.integers(1, 1 << 62, (tables, blocks, 8), dtype=np.int64) | 1
        self.salt = rng.integers(1, 1 << 62, tables, dtype=np.int64)
        self.near = _shortest()

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """tables x (1 + probes) keys for each row."""
        out = np.empty((len(unit), self.tables, 1 + self.probes), dtype=np.int64)
        for t in range(self.tables):
            key = np.full(len(unit), self.salt[t], dtype=np.int64)
            moves, costs = [], []
            for b in range(self.blocks):
                x = unit @ self.maps[t, b]
                point = e8(x)
                key += (np.rint(2 * point).astype(np.int64) * self.weights[t, b]).sum(1)
                gain = (x - point) @ self.near.T  # the neighbour's distance is that of the cell + 2 - 2 gain
                top = np.argpartition(-gain, self.probes - 1, axis=1)[:, : self.probes]
                costs.append(np.take_along_axis(gain, top, 1))
                moves.append((np.rint(2 * self.near).astype(np.int64) * self.weights[t, b]).sum(1)[top])
            best = np.argpartition(-np.concatenate(costs, 1), self.probes - 1, axis=1)[:, : self.probes]
            out[:, t, 0] = key
            out[:, t, 1:] = key[:, None] + np.take_along_axis(np.concatenate(moves, 1), best, 1)
        return out.reshape(len(unit), -1)


def units(column, dim: int) -> np.ndarray:
    """Rows of an Arrow list column, in double precision, at length 1."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _dims(column) -> np.ndarray:
    return np.diff(column.offsets.to_numpy())


def near_vectors(spark: SparkSession, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95) -> DataFrame:
    """One row per row of ``vectors``: key, n_links, component_id (smallest key reachable), kept.

    Links join vectors of one length with cosine >= ``least``. Null, empty and zero vectors and those with null or
    non-finite components are linked with nothing and are their own component. Keys may repeat: every row is a vector
    of its own; a null key never names a component of others. An empty table gives no row; extra columns are not read.
    """
    bounded_batches(spark)
    staged = Staged(spark, "lattice")
    v = F.col(vector).cast("array<double>")
    bad = v.isNull() | (F.size(v) < 1) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0)
    rows = staged.write(vectors.select(F.monotonically_increasing_id().alias("cid"), F.col(key).alias("id"), F.when(~bad, v).alias("v")), "vectors")
    good = rows.where(F.col("v").isNotNull()).select("cid", F.size("v").alias("dim"), "v")

    parts = _components(staged, good, None, least)
    roots = staged.write(parts.union(parts.select(F.col("root").alias("node"), "root").distinct()), "roots")
    inside = staged.write(good.join(roots, F.col("cid") == F.col("node")).select("cid", "root", "v"), "inside")
    counts = _count_links(staged, inside, least)
    ids = staged.write(rows.select("cid", "id").join(roots, F.col("cid") == F.col("node"), "left").select("cid", "id", "root"), "ids")
    named = staged.write(ids.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("component_id")), "named")
    placed = staged.write(ids.join(named, "root", "left"), "placed")
    out = placed.join(staged.write(counts, "counts"), "cid", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))


def _components(staged: Staged, good: DataFrame, n: int | None, least: float) -> DataFrame:
    """(node, root) of the components of all links found among the vectors ``good``: cid, dim, v; ``n``, how many they are, is not read."""
    ((_, blocks, scale),) = SIZES

    def hash_all(batches):
        import pyarrow as pa

        made: dict[int, Lattice] = {}
        for batch in batches:
            dims = _dims(batch.column("v"))
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                lattice = made.setdefault(dim, Lattice(dim, blocks=blocks, scale=scale))
                cells = lattice.cells(units(own.column("v"), dim)) + dim
                lives = np.tile(np.arange(1 + lattice.probes) == 0, len(cells) * lattice.tables)
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), pa.array(np.repeat(own.column("cid").to_numpy(), cells.shape[1])), pa.array(lives)], names=["bucket", "cid", "lives"])

    cells = staged.write(good.select("cid", "v").mapInArrow(hash_all, "bucket long, cid long, lives boolean"), "cells")
    # A cell counts where somebody lives and another is or asks; its hub is the first to live there.
    met = cells.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min(F.when(F.col("lives"), F.col("cid"))).alias("head")).where("m > 1 AND head IS NOT NULL")
    met = staged.write(met.select("bucket", "head"), "met")
    members = staged.write(cells.join(met, "bucket"), "members")
    pairs = staged.write(members.where("cid <> head").select(F.col("head").alias("x"), F.col("cid").alias("y")).distinct(), "stars")
    stars = staged.write(_cosines(good, pairs), "cosines")
    parts = components(staged, staged.write(stars.where(F.col("cosine") >= least).select("x", "y"), "linked"))

    # Two vectors can only be linked if their angles to the hub differ by no more than a link's angle: members are dealt
    # to rings of that width around the hub, and only neighbouring rings of different components meet.
    width = math.acos(min(1.0, least)) + 1e-9
    ring = F.floor(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce("cosine", F.lit(1.0))))) / width).cast("int")
    seen = members.join(stars, (F.col("head") == F.col("x")) & (F.col("cid") == F.col("y")), "left").where("cosine IS NOT NULL OR cid = head")
    placed = seen.select("bucket", "cid", "lives", ring.alias("ring")).join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    placed = staged.write(placed, "placed")
    gaps = placed.select("bucket", F.explode(F.array("ring", F.col("ring") - 1)).alias("gap"), "lives", "root").groupBy("bucket", "gap")
    gaps = gaps.agg(F.min("root").alias("a"), F.max("root").alias("b"), F.max("lives").alias("lives"), F.count(F.lit(1)).alias("m")).where("a < b AND lives")
    gaps = staged.write(gaps.select("bucket", "gap", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "gaps")
    apart = placed.withColumn("gap", F.explode(F.array("ring", F.col("ring") - 1)))
    dealt = blocks_of(apart, gaps, ["bucket", "gap"])
    dealt = dealt.join(good.select("cid", "v"), "cid").select("bucket", "gap", "low", "high", "block", "cid", "root", "lives", "v")
    more = dealt.groupBy("bucket", "gap", "low", "high").applyInArrow(_joining(least), "x long, y long")
    return components(staged, parts.toDF("x", "y").union(staged.write(more.distinct(), "joined")))


def _cosines(good: DataFrame, pairs: DataFrame) -> DataFrame:
    """x, y and cosine of the (x, y) pairs of vectors of one length."""
    left, right = (good.select(F.col("cid").alias(c), F.col("v").alias(f"v_{c}")) for c in "xy")

    def measure(batches):
        import pyarrow as pa

        for batch in batches:
            dx, dy = _dims(batch.column("v_x")), _dims(batch.column("v_y"))
            for dim in np.unique(dx[dx == dy]).tolist():
                own = batch.filter(pa.array((dx == dim) & (dy == dim)))
                cosine = np.einsum("ij,ij->i", units(own.column("v_x"), dim), units(own.column("v_y"), dim))
                yield pa.RecordBatch.from_arrays([own.column("x"), own.column("y"), pa.array(cosine)], names=["x", "y", "cosine"])

    return pairs.join(right, "y").join(left, "x").select("x", "y", "v_x", "v_y").mapInArrow(measure, "x long, y long, cosine double")


def _joining(least: float):
    """Links between vectors of different components in two blocks of a cell, as few as join the same components."""

    def run(table):
        import pyarrow as pa

        out: list[tuple[int, int]] = []
        dims, column = _dims(table.column("v").combine_chunks()), table.column("v").combine_chunks()
        cid, root, lives, block = (table.column(c).to_numpy() for c in ("cid", "root", "lives", "block"))
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            unit = units(column.take(pa.array(at)), dim)
            two = block[at].min() != block[at].max()
            left, right = (np.flatnonzero(block[at] == block[at].min()), np.flatnonzero(block[at] == block[at].max())) if two else (np.arange(len(at)),) * 2
            ok = (unit[left] @ unit[right].T >= least) & (root[at[left]][:, None] != root[at[right]][None, :]) & (lives[at[left]][:, None] | lives[at[right]][None, :])
            for i, j in zip(*np.nonzero(ok)):
                x, y = int(at[left[i]]), int(at[right[j]])
                a, b = find(int(root[x])), find(int(root[y]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((int(cid[x]), int(cid[y])))
        return pa.table({"x": pa.array([o[0] for o in out], pa.int64()), "y": pa.array([o[1] for o in out], pa.int64())})

    return run


def _count_links(staged: Staged, inside: DataFrame, least: float) -> DataFrame:
    """(cid, n_links) for the vectors of components: cid, root, v."""
    half = math.cos(math.acos(least) / 2) + 1e-9 if least > 0 else 2.0

    def sums(batches):
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            roots, dims = batch.column("root").to_numpy(), _dims(batch.column("v"))
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                mine = roots[dims == dim]
                names, at = np.unique(mine, return_inverse=True)
                part = np.zeros((len(names), dim))
                np.add.at(part, at, units(own.column("v"), dim))
                for name, row in zip(names.tolist(), part):
                    total[name] = total[name] + row if name in total else row
                if len(total) > 20_000:
                    yield _named(total)
                    total = {}
        if total:
            yield _named(total)

    def _named(total):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["root", "part"])

    # One partial sum per task and component, then added up coordinate by coordinate.
    parts = inside.select("root", "v").mapInArrow(sums, "root long, part array<double>")
    centre = parts.select("root", F.posexplode("part").alias("i", "x")).groupBy("root", "i").agg(F.sum("x").alias("x"))
    centre = staged.write(centre.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre")), "centres")

    def near_centre(batches):
        import pyarrow as pa

        for batch in batches:
            dims = _dims(batch.column("v"))
            close = np.zeros(len(dims), bool)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                own = batch.take(pa.array(at))
                c = own.column("centre").flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
                size = np.sqrt((c * c).sum(1))
                close[at] = np.einsum("ij,ij->i", units(own.column("v"), dim), c) >= half * np.where(size > 0, size, np.inf)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cid", "root", "v")), pa.array(close)], names=["cid", "root", "v", "close"])

    marked = staged.write(inside.join(centre, "root").select("cid", "root", "v", "centre").mapInArrow(near_centre, "cid long, root long, v array<double>, close boolean"), "marked")
    per_root = marked.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.count_if("close").alias("n_close"))
    per_root = per_root.select("root", "n_close", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("size") - F.col("n_close")) / BLOCK).cast("int").alias("open_blocks"))
    sized = staged.write(marked.join(staged.write(per_root, "sizes"), "root"), "sized")
    # Every block of vectors away from the centre meets every block of the component.
    pick = lambda n: F.pmod(F.xxhash64("cid"), n).cast("int")
    members = sized.where("open_blocks > 0").select("root", "cid", "v", "close", pick(F.col("blocks")).alias("m"), F.explode(F.sequence(F.lit(0), F.col("open_blocks") - 1)).alias("o"), F.lit(False).alias("asks"))
    asking = sized.where(~F.col("close")).select("root", "cid", "v", "close", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("m"), pick(F.col("open_blocks")).alias("o"), F.lit(True).alias("asks"))

    def compare(pdf):
        import pandas as pd

        ask, own = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        if ask.empty or own.empty:
            return pd.DataFrame({"cid": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})
        x, y = (np.stack(p["v"].to_numpy()).astype(np.float64) for p in (ask, own))
        x, y = (a / np.abs(a).max(1, keepdims=True) for a in (x, y))
        x, y = (a / np.sqrt((a * a).sum(1, keepdims=True)) for a in (x, y))
        hit = (x @ y.T >= least) & (ask["cid"].to_numpy()[:, None] != own["cid"].to_numpy()[None, :])
        close = own["close"].to_numpy(dtype=bool)
        return pd.DataFrame({"cid": np.concatenate((ask["cid"], own["cid"][close])), "n": np.concatenate((hit.sum(1), hit.sum(0)[close]))})

    asked = members.union(asking.select(*members.columns)).groupBy("root", "m", "o").applyInPandas(compare, "cid long, n long")
    sure = sized.where("close").select("cid", (F.col("n_close") - 1).alias("n"))
    return sure.union(asked).groupBy("cid").agg(F.sum("n").alias("n_links"))
