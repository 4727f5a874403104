"""Paragraphs and sentences in reading order, and windows over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_sentences(text: Column) -> Column:
    """Trimmed sentences: cut at white space after ``.``, ``!`` or ``?``; empty pieces go."""
    pieces = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])\s+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(pieces, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def sentence_array(text: Column) -> Column:
    """Sentences in reading order as structs of paragraph_id (every line counts, blank ones too) and text."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.flatten(F.transform(lines, lambda line, i: F.transform(split_sentences(line), lambda s: F.struct((i + 1).cast("long").alias("paragraph_id"), s.alias("text")))))


def emit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per sentence: key, paragraph_id, text_id (running), text.

    Lines and sentences are exploded in place, so the running id needs no shuffle beyond the array that holds them.
    """
    rows = docs.select(key, F.posexplode(sentence_array(F.col(text))).alias("at", "s"))
    return rows.select(key, "s.paragraph_id", (F.col("at") + 1).cast("long").alias("text_id"), F.col("s.text").alias("text"))


def anchored(docs: DataFrame, hit, stop, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document the first sentence that meets ``hit`` with up to two followers of its paragraph: key, text_id, statement.

    A follower that meets ``stop`` ends the excerpt; both are functions of a Column. All happens inside the row.
    """
    rows = docs.select(key, sentence_array(F.col(text)).alias("s"))
    rows = rows.withColumn("at", F.array_position(F.transform("s", lambda x: hit(x["text"])), True)).where("at > 0")
    one, two, three = (F.get("s", (F.col("at") + i).cast("int")) for i in (-1, 0, 1))
    follows = lambda x: F.coalesce((x["paragraph_id"] == one["paragraph_id"]) & ~stop(x["text"]), F.lit(False))
    more = F.concat_ws(" ", one["text"], F.when(follows(two), two["text"]), F.when(follows(two) & follows(three), three["text"]))
    return rows.select(key, F.col("at").cast("long").alias("text_id"), more.alias("statement"))


def heading_parents(headings: DataFrame, key: str, order: str, level: str) -> DataFrame:
    """Each heading's parent: the last earlier one of a lower level since none as low or lower came between.

    The running stack is kept per level: for every level the last heading seen, and the deepest of the lower levels
    whose last heading is the latest.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.coalesce(F.last(F.when(F.col(level) == n, F.col(order)), True).over(w), F.lit(-1)) for n in range(1, 7)]
    rows = headings.select("*", *(c.alias(f"__l{n}") for n, c in enumerate(last, 1)))
    parent = F.greatest(*(F.when(F.col(level) > n, F.col(f"__l{n}")).otherwise(-1) for n in range(1, 7)))
    return rows.withColumn("parent_id", F.when(parent >= 0, parent)).drop(*(f"__l{n}" for n in range(1, 7)))
