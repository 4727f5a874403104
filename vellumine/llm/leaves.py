"""Budgets and prefixes of any number of groups of any size, found on executors by narrowing histograms.

A group's threshold lies in one cell of a histogram of a few thousand cells; the next round looks into that cell only.
So no task ever holds more of a group than its histogram, or the rows of one narrow cell.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Staged

#: Rows of one cell that one task may put in order.
EDGE_ROWS = 20_000
#: Cells of a histogram of supplies; those of an order follow from its 12 bits a round.
CELLS = 4096
#: Right shifts of (order, last tie) in each round: first the 64 bits of the order, then those of a repeated row's place.
SHIFTS = [(s, 63) for s in (52, 40, 28, 16, 4)] + [(4, s) for s in (51, 39, 27, 15, 3)]
#: Weights are whole multiples of a millionth, so that their sums do not depend on the order of adding.
UNIT = 1_000_000


def attach(staged: Staged, rows: DataFrame, table: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """``rows`` left joined with ``table``, which has one row per key.

    Where ``few``, the table is broadcast. Else the keys that hold over a thousandth of the rows, so at most a thousand,
    are broadcast, and the others are joined by a shuffle without hot keys.
    """
    if few:
        return rows.join(F.broadcast(table), keys, "left")
    counts = staged.write(rows.groupBy(*keys).agg(F.count("*").alias("__rows")), "key-counts")
    total = counts.agg(F.sum("__rows")).first()[0] or 0
    hot = F.broadcast(staged.write(counts.where(F.col("__rows") > total / 1000).select(*keys, F.lit(True).alias("__hot")), "hot-keys"))
    marked = rows.join(hot, keys, "left")
    above = marked.where("__hot").drop("__hot").join(F.broadcast(table.join(hot, keys, "left_semi")), keys, "left")
    return above.unionByName(marked.where("__hot IS NULL").drop("__hot").join(table, keys, "left"))


def prefix(staged: Staged, rows: DataFrame, keys: list[str], ties: list[str], few: bool) -> DataFrame:
    """``rows`` with ``extra``: 1 for a group's longest prefix whose sum of ``n`` stays within the group's ``rest``, else 0.

    The prefix follows the unsigned 64 bits of ``order``, then ``ties``, the last of which is a place of its own for each
    row, not below zero. Where a group's repeated rows, all of one order, exceed a cell, only their places order them.
    """

    def cell(step: int):
        first, second = SHIFTS[step]
        return F.struct(F.shiftrightunsigned("order", first).alias("a"), F.shiftright(ties[-1], second).alias("b"))

    step, state = 0, None
    while True:
        open_rows = rows.where("rest > 0").select(*keys, "order", ties[-1], "n", "rest")
        if state is None:
            open_rows = open_rows.withColumn("before", F.lit(0).cast("long"))
        else:
            open_rows = attach(staged, open_rows, state.select(*keys, "last", "before"), keys, few).where(cell(step - 1) == F.col("last"))
        cells = open_rows.groupBy(*keys, cell(step).alias("cell")).agg(F.sum("n").alias("n"), F.count("*").alias("many"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        upto = F.col("before") + F.sum("n").over(Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
        past = cells.withColumn("upto", upto).where("upto > rest")
        # The cell in which the rest ends: all before it are taken, none after it.
        ends = past.groupBy(*keys).agg(F.min("cell").alias("last"), F.min_by(F.struct((F.col("upto") - F.col("n")).alias("before"), "many"), "cell").alias("at"))
        state = staged.write(ends.select(*keys, "last", "at.before", "at.many"), "ends")
        most = state.agg(F.max("many")).first()[0]
        if most is None or most <= EDGE_ROWS or step + 1 == len(SHIFTS):
            break
        step += 1

    placed = attach(staged, rows, state.select(*keys, "last", "before"), keys, few).withColumn("cell", cell(step))
    by = ["order", *ties] if SHIFTS[step][1] == 63 else [ties[-1]]
    run = F.sum("n").over(Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    edge = placed.where("cell = last").withColumn("extra", (F.col("before") + run <= F.col("rest")).cast("long"))
    whole = placed.where("last IS NULL OR cell <> last").withColumn("extra", ((F.col("rest") > 0) & F.coalesce(F.col("cell") < F.col("last"), F.lit(True))).cast("long"))
    columns = [*rows.columns, "extra"]
    return whole.select(*columns).union(edge.select(*columns))


def _level(staged: Staged, nodes: DataFrame, parent: list[str]) -> DataFrame:
    """``nodes`` (parent, zero, name, supply, units, budget of the parent) with ``share``, their part of the budget.

    As ``mixing.water_fill`` shares, but the tokens that whole shares leave over go one each to nodes in a hashed order.
    """
    keys = [*parent, "zero"]
    live = nodes.where("supply > 0").withColumn("ratio", F.col("supply") / F.col("units"))
    groups = live.groupBy(*keys).agg(F.sum("supply").alias("has"), F.min("ratio").alias("lo"), F.max("ratio").alias("hi"), F.first("budget").alias("budget"))
    # Names without weight get what those with weight cannot use.
    others = F.coalesce(F.lag("has").over(Window.partitionBy(*parent).orderBy("zero")), F.lit(0))
    due = F.least(F.greatest(F.col("budget") - others, F.lit(0)), "has")
    state = staged.write(groups.select(*keys, due.alias("due"), "lo", "hi", *(F.lit(0).cast("long").alias(c) for c in ("full", "open", "units"))), "groups")
    # In each round: supplies of the nodes that are full (``full``), units of those that are not (``open``), and the range of ratios still undecided.
    while True:
        inside = attach(staged, live.select(*keys, "supply", F.col("units").alias("u"), "ratio"), state.drop("units"), keys, False).where("ratio BETWEEN lo AND hi")
        where = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("ratio") - F.col("lo")) / (F.col("hi") - F.col("lo")) * CELLS)).otherwise(0).cast("int")
        cells = inside.groupBy(*keys, where.alias("cell")).agg(F.sum("supply").alias("supply"), F.sum("u").alias("u"), F.min("ratio").alias("lo"), F.max("ratio").alias("hi"), *(F.first(c).alias(c) for c in ("due", "full", "open")))
        ordered = Window.partitionBy(*keys).orderBy("cell")
        upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
        every = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        cells = cells.select("*", F.sum("supply").over(upto).alias("given"), (F.sum("u").over(every) - F.sum("u").over(upto)).alias("after"), F.lead("cell").over(ordered).isNull().alias("ends"))
        reached = cells.where(F.col("ends") | (F.col("full") + F.col("given") + F.col("hi") * (F.col("open") + F.col("after")) >= F.col("due")))
        found = F.struct("due", "lo", "hi", (F.col("full") + F.col("given") - F.col("supply")).alias("full"), (F.col("open") + F.col("after")).alias("open"), F.col("u").alias("units"))
        state = staged.write(reached.groupBy(*keys).agg(F.min_by(found, "cell").alias("at")).select(*keys, "at.*"), "groups")
        if not state.where("lo < hi").limit(1).count():
            break
    levels = state.select(*keys, "due", "lo", "full", (F.col("open") + F.col("units")).alias("parts"))
    part = F.expr("(CAST(due - full AS DECIMAL(19,0)) * CAST(units AS DECIMAL(18,0))) DIV CAST(parts AS DECIMAL(19,0))")
    share = F.when(F.col("ratio") < F.col("lo"), F.col("supply")).otherwise(F.least("supply", part)).cast("long")
    shared = staged.write(attach(staged, live, levels, keys, False).withColumn("share", share).select(*live.columns, "due", "share", F.monotonically_increasing_id().alias("seat")), "shares")
    left = staged.write(shared.groupBy(*keys).agg((F.first("due") - F.sum("share")).alias("rest")), "left")
    more = attach(staged, shared.where("share < supply"), left, keys, False).withColumn("n", F.lit(1).cast("long")).withColumn("order", F.xxhash64(F.lit("left over"), "path"))
    extra = prefix(staged, more, keys, ["path", "seat"], False).where("extra = 1").select("seat", "extra")
    out = shared.join(extra, "seat", "left").withColumn("share", F.col("share") + F.coalesce("extra", F.lit(0)))
    return out.select(*nodes.columns, "share").unionByName(nodes.where("supply = 0").withColumn("share", F.lit(0).cast("long")))


def hand_down(staged: Staged, leaves: DataFrame, levels: tuple[str, ...], weights: Mapping[tuple, float], total: int) -> DataFrame:
    """``leaves`` (one column per level, supply) with ``share``, handed down as ``mixing.budgets`` does on the driver.

    Shares differ from the driver's by the places of single left over tokens only; they never exceed the supplies, and
    their sum is ``total`` or all supplies.
    """
    spark = staged.spark
    above = None
    for depth in range(1, len(levels) + 1):
        names = list(levels[:depth])
        nodes = leaves.groupBy(*names).agg(F.sum("supply").alias("supply"))
        given = [(*path, float(w)) for path, w in weights.items() if len(path) == depth]
        table = spark.createDataFrame(given, ", ".join([*(f"{n} string" for n in names), "weight double"]))
        weight = F.coalesce("weight", F.lit(1.0))
        units = F.when(weight > 0, F.greatest(F.round(weight * UNIT), F.lit(1))).otherwise(UNIT).cast("long")
        nodes = nodes.join(table, names, "left").select(F.lit(0).alias("root"), *names, "supply", (weight <= 0).alias("zero"), units.alias("units"), F.concat_ws("\x01", *names).alias("path"))
        nodes = staged.write(nodes, "nodes")
        if above is None:
            nodes = nodes.withColumn("budget", F.lit(total).cast("long"))
        else:
            nodes = attach(staged, nodes, above, names[:-1], False)
        shared = _level(staged, staged.write(nodes, "budgeted"), ["root", *names[:-1]])
        above = staged.write(shared.select(*names, F.col("share").alias("budget")), "handed")
    return attach(staged, leaves, above.withColumnRenamed("budget", "share"), list(levels), False)
