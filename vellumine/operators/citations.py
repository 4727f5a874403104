"""In-text citations and mentions resolved to references and floats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NUMERIC = r"\[(\d{1,3}(?:\s*[-–,;]\s*\d{1,3})*)\]"
SPREAD = 15
#: References of one form that a row carries at once, and references that are sent to every executor; more are joined by a shuffle.
BLOCK, BROADCAST_REFS = 1000, 2_000_000


def numeric_mentions(sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per cited number: key, text_id, marker, number; ranges are expanded, upwards whichever way printed."""
    rows = sentences.where(F.col("text").contains("[")).select(key, "text_id", F.posexplode(F.regexp_extract_all("text", F.lit(NUMERIC), F.lit(1))).alias("marker", "inside"))
    parts = F.transform(F.split("inside", r"\s*[,;]\s*"), lambda p: F.transform(F.split(p, r"\s*[-–]\s*"), lambda x: x.cast("int")))
    numbers = F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(F.array_min(p), F.array_max(p)))))
    return rows.select(key, "text_id", F.col("marker").cast("long").alias("marker"), F.explode(numbers).alias("number"))


def link_numeric(mentions: DataFrame, sizes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Mentions with their target and the reason where rejected: a number outside 1..n of the paper's list rejects its whole marker."""
    per = mentions.groupBy(key, "text_id", "marker").agg(F.min("number").alias("low"), F.max("number").alias("high"), F.count(F.lit(1)).alias("k"))
    judged = mentions.join(per, [key, "text_id", "marker"]).join(sizes, key, "left").na.fill(0, ["n_refs"])
    reason = F.when((F.col("low") < 1) | (F.col("high") > F.col("n_refs")), "numeric_interval_guard").when((F.col("k") == 2) & (F.col("high") - F.col("low") >= SPREAD), "numeric_interval_guard")
    return judged.select(key, "text_id", "marker", "number", F.when(reason.isNull(), F.col("number")).alias("target_id"), reason.alias("reason"))


def link_author_year(cites: DataFrame, refs: DataFrame) -> DataFrame:
    """Author-year citations to references: equi-join on paper, year and first family; the best by further families, then
    fewer authors; equal bests are kept as ambiguous with half the confidence.

    Citations and references are compared by their distinct forms in a paper. Only the best forms are written out to all
    references that have them, ``BLOCK`` at a time, over many tasks: the rows are as many as the equal bests are.

    ``cites``: paper_id, cite_id, year, families (array); ``refs``: paper_id, bib_id, year, families (array).
    """
    spark = cites.sparkSession
    lead = F.lower(F.get("families", F.lit(0)))
    form = ["paper_id", "year", "families"]
    sizes = refs.groupBy(*form).agg(F.count(F.lit(1)).alias("n")).withColumn("lead", lead).withColumnRenamed("families", "theirs")
    hits = F.size(F.array_intersect("families", "theirs"))
    scored = cites.select(*form).distinct().withColumn("lead", lead).join(sizes, ["paper_id", "year", "lead"]).withColumn("score", F.struct(hits.alias("hits"), (-F.size("theirs")).alias("fewer")))
    best = scored.withColumn("top", F.max("score").over(Window.partitionBy(*form))).where("score = top").withColumn("slots", F.ceil(F.col("n") / BLOCK))
    w = Window.partitionBy("paper_id", "cite_id")
    c = cites.select("cite_id", *form).join(best.groupBy(*form).agg(F.max("score").alias("score"), F.sum("n").alias("n")), form)
    c = c.withColumn("top", F.max("score").over(w)).where("score = top").withColumn("ties", F.sum("n").over(w))
    asked = c.select("cite_id", "ties", *form).join(best.select(*form, "theirs", F.explode(F.sequence(F.lit(1), "slots")).alias("slot")), form).drop("families")
    slot = (F.pmod(F.xxhash64("bib_id"), F.ceil(F.col("n") / BLOCK)) + 1).alias("slot")
    theirs = ["paper_id", "year", "theirs"]
    listed = refs.select("paper_id", "year", F.col("families").alias("theirs"), "bib_id").join(sizes.drop("lead"), theirs).groupBy(*theirs, slot).agg(F.collect_list(F.struct("bib_id")).alias("ids"))
    if refs.limit(BROADCAST_REFS + 1).count() <= BROADCAST_REFS:
        listed = F.broadcast(listed)
    # So few bytes lead to so many rows that their number of partitions is stated.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    best = asked.repartition(parts, "cite_id", "slot").join(listed, [*theirs, "slot"]).select("paper_id", "cite_id", "ties", F.inline("ids"))
    return best.select("paper_id", "cite_id", "bib_id", F.when(F.col("ties") == 1, 0.95).otherwise(0.5).alias("confidence"), F.when(F.col("ties") > 1, "ambiguous_same_surname_year").alias("reason"))


def link_floats(mentions: DataFrame, floats: DataFrame) -> DataFrame:
    """Float mentions (paper_id, mention_id, kind, label) to floats (paper_id, float_id, kind, label, page).

    Where any float of the kind in a paper has a label only labels decide, ``2a`` falling back to ``2``; otherwise the
    nth float by page answers to the number. A mention without a target keeps its row.
    """
    w = Window.partitionBy("paper_id", "kind")
    ranked = floats.withColumn("labelled", F.count("label").over(w) > 0).withColumn("place", F.row_number().over(w.orderBy("page", "float_id")))
    by_label = ranked.where("labelled").groupBy("paper_id", "kind", F.lower("label").alias("label")).agg(F.min("float_id").alias("exact"))
    by_place = ranked.where("NOT labelled").select("paper_id", "kind", F.col("place").cast("string").alias("label"), F.col("float_id").alias("nth"))
    m = mentions.withColumn("label", F.lower("label"))
    plain = by_label.select("paper_id", "kind", F.col("label").alias("stem"), F.col("exact").alias("base"))
    out = m.join(by_label, ["paper_id", "kind", "label"], "left").join(by_place, ["paper_id", "kind", "label"], "left")
    out = out.withColumn("stem", F.regexp_replace("label", "[a-z]$", "")).join(plain, ["paper_id", "kind", "stem"], "left")
    tier = F.when(F.col("exact").isNotNull() | F.col("base").isNotNull(), "label").when(F.col("nth").isNotNull(), "position")
    return out.select("paper_id", "mention_id", F.coalesce("exact", "base", "nth").alias("target_id"), tier.alias("tier"))


def as_of_page(sentences: DataFrame, spans: DataFrame) -> DataFrame:
    """Page of each sentence: that of the last span that starts at or before it (an as-of join by one union and window)."""
    s = sentences.select("paper_id", F.col("start").alias("at"), F.lit(1).alias("side"), "text_id", F.lit(None).cast("long").alias("page"))
    p = spans.select("paper_id", F.col("start").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("text_id"), F.col("page").cast("long").alias("page"))
    w = Window.partitionBy("paper_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    return s.union(p).withColumn("page", F.last("page", True).over(w)).where("side = 1").select("paper_id", "text_id", "page")
