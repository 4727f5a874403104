"""Section typing, study scopes and order rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import heading_key

#: Common names of section types; the longest that a heading holds wins.
ALIASES = (
    ("abstract", "abstract"), ("summary", "abstract"), ("introduction", "introduction"), ("background", "introduction"), ("methods", "methods"), ("method", "methods"), ("materials and methods", "methods"),
    ("participants", "methods"), ("procedure", "methods"), ("results", "results"), ("findings", "results"), ("results and discussion", "results"), ("discussion", "discussion"), ("general discussion", "discussion"),
    ("conclusion", "conclusion"), ("conclusions", "conclusion"), ("references", "references"), ("bibliography", "references"), ("works cited", "references"), ("appendix", "appendix"),
    ("acknowledgments", "acknowledgements"), ("acknowledgements", "acknowledgements"), ("funding", "funding"), ("data availability", "data_availability"), ("conflict of interest", "coi"),
)
TRUSTED = 0.6


def type_sections(sections: DataFrame, aliases: tuple = ALIASES) -> DataFrame:
    """paper_id, section_id, section_type, score, trusted: exact alias 1, the longest alias within word borders 0.95.

    A partial hit is trusted when the type's aliases cover three fifths of the heading. The alias table is fixed and small, so
    it stands in the expression and no row moves.
    """
    # The heading's key is a column of its own that each alias asks for; within a lambda it was worked out anew for every alias.
    keyed = sections.select("paper_id", "section_id", heading_key(F.col("header")).alias("h"))
    keyed = keyed.withColumn("padded", F.concat(F.lit(" "), F.regexp_replace("h", "[^a-z]+", " "), F.lit(" ")))
    entry = lambda a, t: F.when(F.col("padded").contains(f" {a} "), F.struct(F.lit(len(a)).alias("n"), F.lit(a).alias("alias"), F.lit(t).alias("type")))
    out = keyed.select("paper_id", "section_id", "h", F.greatest(*(entry(a, t) for a, t in aliases)).alias("b"))
    exact = F.col("h") == F.col("b.alias")
    return out.select(
        "paper_id", "section_id", F.coalesce("b.type", F.lit("unknown")).alias("section_type"), F.when(exact, 1.0).when(F.col("b").isNotNull(), 0.95).otherwise(0.0).alias("score"),
        F.coalesce(exact | (F.col("b.n") / F.length("h") >= TRUSTED), F.lit(False)).alias("trusted"),
    )


def study_scopes(sections: DataFrame) -> DataFrame:
    """Scope of each section: a marker (Study 2, Experiment 1b) opens one when its number changes; a general discussion closes it."""
    number = F.regexp_extract(F.lower("header"), r"^(?:study|experiment)\s+(\d+)", 1)
    mark = F.when(number != "", number.cast("int")).when(F.lower("header").contains("general discussion"), 0)
    w = Window.partitionBy("paper_id").orderBy("section_id").rowsBetween(Window.unboundedPreceding, 0)
    return sections.select("paper_id", "section_id", F.coalesce(F.last(mark, True).over(w), F.lit(0)).cast("long").alias("scope"))


def unique_types(sections: DataFrame, types: tuple[str, ...] = ("abstract", "references")) -> DataFrame:
    """Types that may occur once: the most trusted section keeps it, the earliest of equals; the others become unknown."""
    order = Window.partitionBy("paper_id", "section_type").orderBy(F.desc("trust"), "section_id")
    place = F.row_number().over(order)
    return sections.withColumn("place", place).select("paper_id", "section_id", F.when(F.col("section_type").isin(*types) & (F.col("place") > 1), "unknown").otherwise(F.col("section_type")).alias("section_type"))


def section_text(sentences: DataFrame) -> DataFrame:
    """Sentences of a section joined in reading order."""
    rows = sentences.groupBy("paper_id", "section_id").agg(F.array_sort(F.collect_list(F.struct("text_id", "text"))).alias("s"))
    return rows.select("paper_id", "section_id", F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("text"))


def running_headers(regions: DataFrame, pages: int = 2) -> DataFrame:
    """Texts that recur on ``pages`` or more pages of a paper once digits are masked."""
    mask = F.regexp_replace(F.lower(F.trim("text")), "[0-9]+", "#")
    return regions.groupBy("paper_id", mask.alias("mask")).agg(F.countDistinct("page").alias("n_pages")).where(F.col("n_pages") >= pages)


#: Lines with an address or identifier are no running heads, nor are those of fewer letters.
LOCATOR = r"(?i)10\.\d{4,9}/|https?://|www\.|\bdoi\s*:|\barxiv\b|\bisbn\b"
LEAST_LETTERS = 6


def furniture_key(text: Column) -> Column:
    """Whole text in lower case with white space collapsed and digits masked, or null where it cannot be a running head."""
    key = F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), r"[\s\p{Z}]+", " ")), r"\p{Nd}+", "#")
    return F.when(~text.rlike(LOCATOR) & (F.length(F.regexp_replace(key, r"\P{L}+", "")) >= LEAST_LETTERS), key)


def furniture(regions: DataFrame, pages: int = 2) -> DataFrame:
    """Running heads: keys of whole texts that recur on ``pages`` or more pages of a paper."""
    keyed = regions.select("paper_id", "page", furniture_key(F.col("text")).alias("mask")).where("mask IS NOT NULL")
    return keyed.groupBy("paper_id", "mask").agg(F.countDistinct("page").alias("n_pages")).where(F.col("n_pages") >= pages)


def group_lines(chars: DataFrame, gap: float = 0.5) -> DataFrame:
    """Line number of each character: a new line starts where y jumps by more than ``gap`` heights."""
    w = Window.partitionBy("page_id").orderBy("y", "x", "char_id")
    jump = F.coalesce(F.col("y") - F.lag("y").over(w) > gap * F.col("height"), F.lit(False)).cast("long")
    return chars.withColumn("jump", jump).withColumn("line", F.sum("jump").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("jump")
