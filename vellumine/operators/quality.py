"""Text quality per unit, page and document, and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def longest_run(tokens: Column) -> Column:
    """Length of the longest run of equal neighbours in an array."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a, t):
        run = F.when(a["last"].eqNullSafe(t), a["run"] + 1).otherwise(1)
        return F.struct(t.alias("last"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(tokens, start, step, lambda a: a["best"])


def spaced_runs(tokens: Column) -> Column:
    """Maximal runs of four or more neighbours that are one letter or digit each."""
    marks = F.concat(F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(r"^[\p{L}\p{N}]$"), "x").otherwise(".")), ""), F.lit("."))
    return F.regexp_count(marks, F.lit("x{4,}"))


def rate(text: Column) -> Column:
    """Quality of one unit between 0 and 1.

    Empty is 1. A replacement character, a token five times in a row, or 20 characters of which half are neither
    letters, digits nor spaces give 0. From three letter-spaced runs on, each costs a tenth.
    """
    c = F.coalesce(text, F.lit(""))
    tokens = F.filter(F.split(c, r"\s+"), lambda t: t != "")
    soup = F.regexp_count(c, F.lit(r"[^\p{L}\p{N}\s]")) / F.greatest(F.length(c), F.lit(1))
    runs = spaced_runs(tokens)
    return (
        F.when(c == "", 1.0)
        .when(c.contains("\ufffd"), 0.0)
        .when(longest_run(tokens) >= 5, 0.0)
        .when((F.length(c) >= 20) & (soup >= 0.5), 0.0)
        .when(runs >= 3, F.greatest(F.lit(0.0), 1 - 0.1 * runs))
        .otherwise(1.0)
    )


def unit_score(text: Column) -> Column:
    """Quality of a unit where a blank one counts as 0."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", 0.0).otherwise(rate(text))


def tenth(scores: Column) -> Column:
    """Tenth percentile (linear) of an array of scores; null for an empty one."""
    ordered = F.array_sort(scores)
    at = (F.size(ordered) - 1) * 0.1
    low = F.floor(at).cast("int")
    under = F.get(ordered, low)
    return under + (at - low) * (F.get(ordered, F.least(low + 1, F.size(ordered) - 1)) - under)


def tenth_percentile(units: DataFrame, *by: str, text: str = "text") -> DataFrame:
    """Tenth percentile (linear) and number of units per group; blank units count as 0."""
    return units.select(*by, unit_score(F.col(text)).alias("score")).groupBy(*by).agg(F.round(F.percentile("score", 0.1), 6).alias("quality"), F.count(F.lit(1)).alias("n_units"))
