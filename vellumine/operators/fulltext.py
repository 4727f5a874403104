"""Operators over whole texts: references, links, citations, mentions, statistics, statements and front matter as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import citation_text, front_text, links, names, reference_text, statements
from ..functions.arrow import arrow_udf

find_links = arrow_udf(links.find_links, links.LINK)
split_names = arrow_udf(names.split_names, names.NAME)
families = arrow_udf(names.families, "array<string>")
parse_reference = arrow_udf(reference_text.parse, reference_text.FIELDS)
segments = arrow_udf(reference_text.segments, "array<struct<text:string,strategy:string>>")
split_merged = arrow_udf(reference_text.split_merged, "array<string>")
affiliation = arrow_udf(front_text.affiliation, front_text.AFFILIATION)
funding = arrow_udf(front_text.funding, front_text.FUNDING)
contacts = arrow_udf(front_text.contacts, front_text.CONTACTS)
title_parts = arrow_udf(front_text.title_parts, front_text.TITLE)
salvage_json = arrow_udf(front_text.salvage_json, "string")
is_publisher_note = arrow_udf(front_text.is_publisher_note, "boolean")
citations = arrow_udf(citation_text.citations, citation_text.CITATION)
strip_superscripts = arrow_udf(citation_text.strip_superscripts, citation_text.STRIPPED)
mentions = arrow_udf(citation_text.mentions, citation_text.MENTION)
statistics_in = arrow_udf(citation_text.statistics_in, citation_text.STATISTIC)
scan_statements = arrow_udf(statements.scan, statements.STATEMENT)


def exploded(docs: DataFrame, key: str, found, name: str = "x") -> DataFrame:
    """``key``, the place in the array from 1 as ``n``, and the members' fields; rows without a member give none."""
    return docs.select(key, F.posexplode(found).alias("at", name)).select(key, (F.col("at") + 1).cast("long").alias("n"), f"{name}.*")


def reference_sections(sentences: DataFrame, sections: DataFrame) -> DataFrame:
    """paper_id and the text of its reference list (T16): rows of the sections typed ``references``; where a paper has none,
    of those headed like one; from the last such section on only, up to a publisher's closing note.

    ``sentences``: paper_id, section_id, text_id, text; ``sections``: paper_id, section_id, section_type, header.
    """
    from ..functions.text import is_references_heading

    typed = F.col("section_type") == "references"
    tier = F.when(typed, 0).when(is_references_heading(F.col("header")), 1)
    lists = sections.select("paper_id", "section_id", tier.alias("tier")).where("tier IS NOT NULL")
    best = lists.groupBy("paper_id").agg(F.min(F.struct("tier", (-F.col("section_id")).alias("less"))).alias("b")).select("paper_id", (-F.col("b.less")).alias("section_id"))
    rows = sentences.join(best, ["paper_id", "section_id"], "left_semi")
    ends = rows.where(F.lower(F.trim("text")).rlike(r"^(publisher['’]?s? note|springer nature remains neutral|reprints and permissions)")).groupBy("paper_id").agg(F.min("text_id").alias("end"))
    rows = rows.join(ends, "paper_id", "left").where("end IS NULL OR text_id < end")
    lines = rows.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("text_id", "text"))).alias("s"))
    return lines.select("paper_id", F.array_join(F.transform("s", lambda x: x["text"]), "\n").alias("text"))


def reference_entries(lists: DataFrame) -> DataFrame:
    """Entries of each list (T17): paper_id, n, text, strategy; run-together entries are parted, what is none is dropped."""
    from ..functions.text import is_non_reference

    cut = lists.select("paper_id", F.posexplode(segments("text")).alias("at", "s"))
    parted = cut.select("paper_id", "at", "s.strategy", F.posexplode(split_merged("s.text", F.col("s.strategy") == "numbered")).alias("part", "text"))
    kept = parted.where(~is_non_reference(F.col("text")))
    place = F.struct("at", "part", "strategy", "text")
    rows = kept.groupBy("paper_id").agg(F.array_sort(F.collect_list(place)).alias("e")).select("paper_id", F.posexplode("e").alias("n", "x"))
    return rows.select("paper_id", (F.col("n") + 1).cast("long").alias("n"), "x.text", "x.strategy")


def list_quality(entries: DataFrame) -> DataFrame:
    """paper_id, n_entries, typical_length (median, A15) and quality (share of well-formed characters, A16)."""
    well = arrow_udf(lambda t, numbered: reference_text.segmentation_quality([t], numbered) or 0.0, "double")
    rows = entries.select("paper_id", F.length("text").alias("length"), (well("text", F.col("strategy") == "numbered") > 0).alias("good"))
    share = F.sum(F.when(F.col("good"), F.col("length")).otherwise(0)) / F.sum("length")
    return rows.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_entries"), F.median("length").alias("typical_length"), F.round(share, 6).alias("quality"))


def accepted_citations(found: DataFrame, sizes: DataFrame, least: int = 3) -> DataFrame:
    """Candidates (paper_id, text_id, style, numbers, reason) judged over their paper (T5): every candidate stays with its reason.

    A number outside the list rejects its marker; a bracketed pair 15 or more apart does, unless the style recurs in ``least``
    sentences; a superscript needs all its numbers in the list; round markers need ``least`` sentences and listed numbers.
    """
    rows = found.join(sizes, "paper_id", "left").withColumn("n_refs", F.coalesce("n_refs", F.lit(0)))
    low, high = F.array_min("numbers"), F.array_max("numbers")
    wide = (F.size("numbers") == 2) & (high - low >= 15)
    first = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.size("numbers") == 0, None).when((low < 1) | (high > F.col("n_refs")), F.when(F.col("style") == "superscript", "math_superscript").otherwise("unknown_bib_id"))
    rows = rows.withColumn("first", first)
    plain = rows.where(F.col("first").isNull() & ~wide).groupBy("paper_id", "style").agg(F.countDistinct("text_id").alias("sentences"))
    rows = rows.join(plain, ["paper_id", "style"], "left").withColumn("recurs", F.coalesce(F.col("sentences") >= least, F.lit(False)))
    reason = F.when(F.col("first").isNotNull(), F.col("first")).when(wide & ~F.col("recurs"), "numeric_interval_guard").when((F.col("style") == "round") & (~F.col("recurs") | (F.col("n_refs") < least)), "style_does_not_recur")
    return rows.withColumn("reason", reason).drop("first", "sentences", "recurs", "n_refs")
