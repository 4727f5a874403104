"""Connected components of a link table by alternating large-star and small-star steps, all on executors.

A key may hold a large part of all rows. So every aggregate by key is written before it is joined back: both sides of such
a join are then plain shuffles, whose oversized partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged


def components(staged: Staged, links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (two long columns) but the roots themselves; root is the smallest node.

    Each step works on distinct (node, smaller node) rows, is written to the shared folder and replaces the last; the
    number of steps grows with the logarithm of the longest chain. Loops and repeated links are harmless; no link gives
    no row.
    """
    a, b = links.columns[:2]
    stamp = (F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    now, seen = staged.write_observed(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links", *stamp)
    while seen[0]:
        # Large star: who points at a node that itself has a smaller neighbour points at that neighbour's smallest instead.
        lower = staged.write(now.groupBy("u").agg(F.min("v").alias("m")), "lower")
        large = staged.write(now.join(lower.withColumnRenamed("u", "w"), F.col("v") == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct(), "large")
        # Small star: a node and its smaller neighbours all point at the smallest of them.
        least = staged.write(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        after, then = staged.write_observed(small, "links", *stamp)
        for old in (now, lower, large, least):
            staged.drop(old)
        now, same, seen = after, then == seen, then
        if same:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def hubs(staged: Staged, members: DataFrame) -> DataFrame:
    """(head, head_n, bucket): of each bucket the member that shares the most bucket places with others."""
    sizes = staged.write(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")), "sizes")
    shares = staged.write(members.join(sizes, "bucket").groupBy("cid").agg(F.sum("m").alias("shares")), "shares")
    best = members.join(shares, "cid").groupBy("bucket").agg(F.max(F.struct("shares", (-F.col("cid")).alias("less"), "n")).alias("top"))
    return staged.write(best.select("bucket", (-F.col("top.less")).alias("head"), F.col("top.n").alias("head_n")), "heads")


def linked(staged: Staged, members: DataFrame, confirm, settle, fits) -> DataFrame:
    """(node, root) of the components of all confirmed links between members of a common bucket.

    ``members`` has bucket, cid and n for buckets of two or more; ``confirm`` turns a table of (x, y) pairs into the true
    ones; ``fits(n, n)`` is a condition that every link meets. No list of all pairs of a bucket is made: each member is
    first compared with its bucket's hub, and only members that are then still in different components are compared
    with each other, which no link escapes: ``settle`` does that from the rows (bucket, cid, n, root) of such buckets.
    """
    heads = hubs(staged, members)
    stars = members.join(heads, "bucket").where((F.col("cid") != F.col("head")) & fits(F.col("n"), F.col("head_n")))
    stars = staged.write(stars.select(F.col("head").alias("x"), F.col("cid").alias("y")).distinct(), "stars")
    parts = components(staged, staged.write(confirm(stars), "confirmed"))
    placed = members.join(parts.withColumnRenamed("node", "cid"), "cid", "left").select("bucket", "cid", "n", F.coalesce("root", "cid").alias("root"))
    placed = staged.write(placed, "placed")
    mixed = staged.write(placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket"), "mixed")
    open_rows = staged.write(placed.join(mixed, "bucket"), "open")
    return components(staged, parts.toDF("x", "y").union(staged.write(settle(open_rows), "settled")))


def blocks_of(rows: DataFrame, sizes: DataFrame, group: list[str]) -> DataFrame:
    """``rows`` dealt to blocks of their group, each row once for every other block of it: adds block, low and high.

    ``sizes`` gives the number of ``blocks`` of each group. Every two blocks of a group meet under one (group, low, high).
    """
    dealt = rows.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "blocks")


def neighbourhoods(staged: Staged, open_rows: DataFrame) -> DataFrame:
    """(bucket, cid, n, root, area): rows of buckets that hang together by common members get one area."""
    heads = staged.write(open_rows.groupBy("bucket").agg(F.min("cid").alias("head")), "area-heads")
    areas = components(staged, staged.write(open_rows.join(heads, "bucket").select("cid", "head").distinct(), "area-links"))
    return open_rows.join(areas.toDF("cid", "area"), "cid", "left").withColumn("area", F.coalesce("area", "cid"))
