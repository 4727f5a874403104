"""Mixing sources to target weights by hierarchical budgeting.

A tree of domains, their languages and the languages' sources carries weights. A token budget is handed down by the
weights; what a leaf cannot supply within its epochs goes to its siblings first, then to its language's siblings, then
to the other domains. Each leaf gives whole epochs and, of its last one, the documents that come first in that epoch's
seeded order, as far as the budget reaches.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_KEY, Staged, crc_mod, keep_ids, with_row_key
from .leaves import attach, hand_down, prefix

#: Leaves of the tree that the driver handles; where there are more, executors hand the budget down.
MAX_LEAVES = 100_000
LEVELS = ("domain", "lang", "source")


def water_fill(budget: int, supply: Mapping, weights: Mapping) -> dict:
    """Share ``budget`` by weight with nobody above their supply; what is left over goes to those still short of theirs.

    Whole tokens by largest remainder, ties by name. Names without weight get something only when all others are full.
    """
    out = dict.fromkeys(supply, 0)
    budget = min(budget, sum(supply.values()))
    for group in ([n for n in supply if weights.get(n, 1.0) > 0], [n for n in supply if weights.get(n, 1.0) <= 0]):
        live = sorted(n for n in group if supply[n] > 0)
        share = {n: max(weights.get(n, 1.0), 0) or 1.0 for n in live}
        while live and budget > 0:
            total = sum(share[n] for n in live)
            full = [n for n in live if budget * share[n] / total >= supply[n] - out[n]]
            if not full:
                ideal = {n: budget * share[n] / total for n in live}
                for n in live:
                    out[n] += int(ideal[n])
                left = budget - sum(int(v) for v in ideal.values())
                for n in sorted(live, key=lambda n: (int(ideal[n]) - ideal[n], n)):
                    give = min(1, left, supply[n] - out[n])
                    out[n] += give
                    left -= give
                budget = left
                if left:
                    continue
                break
            for n in full:
                give = min(supply[n] - out[n], budget)
                out[n] += give
                budget -= give
            live = [n for n in live if n not in full]
    return out


def budgets(budget: int, supply: Mapping[tuple, int], weights: Mapping[tuple, float]) -> dict[tuple, int]:
    """Tokens of each leaf (a tuple of one name per level); ``weights`` are by tuples of any length, 1 where absent.

    A node's supply is that of its leaves, so a shortage below is known above and moves no further than it must.
    """

    def hand_down(path: tuple, tokens: int, leaves: dict[tuple, int]) -> dict[tuple, int]:
        if len(path) == len(next(iter(leaves))):
            return {path: tokens}
        below: dict[tuple, dict] = {}
        for leaf, n in leaves.items():
            below.setdefault(leaf[: len(path) + 1], {})[leaf] = n
        parts = water_fill(tokens, {p: sum(x.values()) for p, x in below.items()}, {p: weights.get(p, 1.0) for p in below})
        return {leaf: n for p, x in below.items() for leaf, n in hand_down(p, parts[p], x).items()}

    return hand_down((), budget, dict(supply)) if supply else {}


def words(text: str = "text") -> Column:
    """Words between ASCII white space, the default measure of tokens."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def _tokens(budget: float, all_tokens: int) -> int:
    return int(budget * all_tokens) if budget <= 1 else int(budget)


def mix(spark: SparkSession, docs: DataFrame, budget: float = 0.8, weights: Mapping[tuple, float] | None = None, epochs: int = 2, seed: int = 1, domain: Column | None = None, tokens: Column | None = None, carry: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, domain, lang, source, n_tokens, copies (epochs that take it), leaf_budget,
    and the column ``carry`` if named.

    ``budget`` is a share of all tokens up to 1, or a number of tokens beyond. A leaf supplies at most ``epochs`` times
    its tokens. In each epoch a leaf's documents are ordered by a seeded hash of (epoch, doc_id, text), ties by doc_id;
    the last epoch takes the longest prefix that its budget covers, so a leaf stays below it by less than one document.
    Null domains, languages and sources are leaves of their own, written as null; null texts have no token and come
    with their place in the order; repeated rows lie side by side and are taken or left one by one. An empty table
    gives no row. The same holds for any number of leaves; above MAX_LEAVES weights count in whole millionths and the
    last single tokens of a budget may lie with other siblings.
    """
    staged = Staged(spark, "mixing")
    leaf = [F.coalesce(c.cast("string"), F.lit("\x00")) for c in (crc_mod("source", 4) if domain is None else domain, F.col("lang"), F.col("source"))]
    count = words() if tokens is None else tokens
    kept = ["doc_id", *([carry] if carry else [])]
    rows = docs.select(*kept, *(c.alias(n) for c, n in zip(leaf, LEVELS)), count.cast("long").alias("n_tokens"), F.xxhash64("text").alias("text_hash"))
    rows = staged.write(rows.withColumn("rid", F.monotonically_increasing_id()), "rows")
    keys = list(LEVELS)
    found = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("n")).limit(MAX_LEAVES + 1).collect()
    few = len(found) <= MAX_LEAVES
    if few:
        have = {tuple(r[c] for c in LEVELS): r["n"] for r in found}
        share = budgets(_tokens(budget, sum(have.values())), {k: n * epochs for k, n in have.items()}, weights or {})
        plan = [(*k, share[k], share[k] // n if n else epochs, share[k] % n if n else 0) for k, n in have.items()]
        table = spark.createDataFrame(plan, "domain string, lang string, source string, leaf_budget long, whole long, rest long")
    else:
        leaves = staged.write(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("own")).withColumn("supply", F.col("own") * epochs), "leaves")
        total = _tokens(budget, leaves.agg(F.sum("own")).first()[0])
        shared = hand_down(staged, leaves, LEVELS, weights or {}, total)
        parts = [F.expr(f"CASE WHEN own > 0 THEN {e} ELSE {z} END").cast("long").alias(c) for c, e, z in (("whole", "share DIV own", epochs), ("rest", "share % own", 0))]
        table = staged.write(shared.select(*LEVELS, F.col("share").alias("leaf_budget"), *parts), "plan")

    order = F.xxhash64(F.lit(seed), "whole", "doc_id", "text_hash")
    placed = attach(staged, rows, table, keys, few).withColumn("order", order).withColumnRenamed("n_tokens", "n")
    out = prefix(staged, placed, keys, ["doc_id", "rid"], few).withColumnRenamed("n", "n_tokens")
    named = [F.when(F.col(c) != "\x00", F.col(c)).alias(c) for c in LEVELS]
    return out.select("doc_id", *named, "n_tokens", (F.col("whole") + F.col("extra")).alias("copies"), "leaf_budget", *kept[1:])


def keep_mixed(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """``docs`` with the documents that the mixture takes, each once per epoch that takes it; all columns stay.

    Rows that agree in doc_id and text share the largest of their copies.
    """
    keyed = with_row_key(docs)
    taken = mix(spark, keyed, carry=ROW_KEY, **how).groupBy(ROW_KEY).agg(F.max("copies").alias("copies"))
    taken = Staged(spark, "mixed").write(taken, "copies")
    left = keep_ids(keyed, ROW_KEY, taken.where("copies = 0").select(ROW_KEY))
    again = taken.where("copies > 1").select(F.col(ROW_KEY).alias("__again"), F.explode(F.sequence(F.lit(2), "copies"))).select("__again")
    if again.limit(1).count():
        left = left.unionByName(keyed.join(again, keyed[ROW_KEY] == again["__again"]).select(*keyed.columns))
    return left.drop(ROW_KEY)
