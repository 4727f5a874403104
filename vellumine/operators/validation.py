"""Integrity checks over the linked tables; each gives (code, paper_id, n) rows and all are united."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_AUTHORS = 64
MAX_REPEATS = 2


def _issue(code: str, rows: DataFrame, n: Column | str = "n") -> DataFrame:
    return rows.select(F.lit(code).alias("code"), "paper_id", (F.col(n) if isinstance(n, str) else n).cast("long").alias("n"))


def duplicate_keys(rows: DataFrame, key: str, code: str = "DUPLICATE_ID") -> DataFrame:
    """Surplus rows of repeated ids."""
    many = rows.groupBy("paper_id", key).agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    return _issue(code, many.groupBy("paper_id").agg(F.sum(F.col("k") - 1).alias("n")))


def dangling(rows: DataFrame, ref: str, target: DataFrame, key: str, code: str = "DANGLING_REF") -> DataFrame:
    """References to rows that are not there; null references never dangle."""
    have = target.select("paper_id", F.col(key).alias(ref)).distinct()
    lost = rows.where(F.col(ref).isNotNull()).join(have, ["paper_id", ref], "left_anti")
    return _issue(code, lost.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n")))


def author_outliers(authors: DataFrame, name: str = "name") -> DataFrame:
    """Papers with too many authors, or with one name more than twice."""
    per = authors.groupBy("paper_id", name).agg(F.count(F.lit(1)).alias("k")).groupBy("paper_id").agg(F.sum("k").alias("n"), F.max("k").alias("most"))
    return _issue("AUTHOR_OUTLIER", per.where((F.col("n") > MAX_AUTHORS) | (F.col("most") > MAX_REPEATS)))


def blank_share(rows: DataFrame, column: str, share: float = 0.5, code: str = "CAPTION_MISSING") -> DataFrame:
    blank = F.col(column).isNull() | (F.trim(column) == "")
    per = rows.groupBy("paper_id").agg(F.count_if(blank).alias("n"), F.count(F.lit(1)).alias("all"))
    return _issue(code, per.where(F.col("n") / F.col("all") > share))


def low_coverage(bibs: DataFrame, xrefs: DataFrame, least: float = 0.2, references: int = 10) -> DataFrame:
    """Papers of ``references`` or more of which less than ``least`` are cited; n counts the uncited."""
    cited = bibs.join(xrefs.select("paper_id", F.col("target_id").alias("bib_id")).distinct(), ["paper_id", "bib_id"], "left_semi")
    per = bibs.groupBy("paper_id").agg(F.countDistinct("bib_id").alias("all")).join(cited.groupBy("paper_id").agg(F.countDistinct("bib_id").alias("got")), "paper_id", "left").na.fill(0, ["got"])
    per = per.where((F.col("all") >= references) & (F.col("got") / F.col("all") < least))
    return _issue("XREF_LOW_COVERAGE", per, F.col("all") - F.col("got"))


def count_mismatch(rows: DataFrame, bibs: DataFrame, ratio: float = 1.3, least: int = 5) -> DataFrame:
    """Papers whose reference rows outnumber their parsed references."""
    a = rows.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"))
    b = bibs.groupBy("paper_id").agg(F.count(F.lit(1)).alias("k"))
    both = a.join(b, "paper_id", "left").na.fill(0, ["k"])
    return _issue("REF_COUNT_MISMATCH", both.where((F.col("n") >= least) & (F.col("n") > ratio * F.col("k"))))


def outside(rows: DataFrame, bad: Column, share: float = 0.1, code: str = "BBOX_SPACE") -> DataFrame:
    per = rows.groupBy("paper_id").agg(F.count_if(bad).alias("n"), F.count(F.lit(1)).alias("all"))
    return _issue(code, per.where(F.col("n") / F.col("all") > share))


def flagged(rows: DataFrame, bad: Column, code: str) -> DataFrame:
    """Row-wise checks (placeholders, blank names, malformed links, generic titles): how many rows of a paper fail."""
    return _issue(code, rows.where(bad).groupBy("paper_id").agg(F.count(F.lit(1)).alias("n")))


def all_issues(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


PLACEHOLDERS = ("n/a", "na", "none", "null", "tbd", "todo", "unknown", "lorem ipsum", "title", "-", "?")
GENERIC_TITLES = ("abstract", "article", "introduction", "manuscript", "original article", "research article", "review", "supplementary material", "title page", "untitled")


def _low(column: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))))


def placeholders(rows: DataFrame, *columns: str) -> DataFrame:
    """VAL_PLACEHOLDER: values that stand for none."""
    bad = [_low(c).isin(*PLACEHOLDERS) for c in columns]
    return _issue("VAL_PLACEHOLDER", rows.select("paper_id", sum((b.cast("int") for b in bad), F.lit(0)).alias("k")).groupBy("paper_id").agg(F.sum("k").alias("n")).where("n > 0"))


def blank_authors(authors: DataFrame) -> DataFrame:
    """AUTHOR_BLANK: authors without a family, given or literal name."""
    return flagged(authors, (_low("name") == ""), "AUTHOR_BLANK")


def empty_equations(equations: DataFrame) -> DataFrame:
    """EMPTY_EQ: equations without text."""
    return flagged(equations, _low("text") == "", "EMPTY_EQ")


def malformed_urls(urls: DataFrame) -> DataFrame:
    """URL_MALFORMED: addresses without scheme and host, or with blanks or unbalanced closing parentheses."""
    c = F.coalesce("url", F.lit(""))
    return flagged(urls, ~c.rlike(r"^https?://[^\s/.]+(\.[^\s/.]+)+(/\S*)?$") | (c.endswith(")") & (F.length(F.replace(c, F.lit("("), F.lit(""))) > F.length(F.replace(c, F.lit(")"), F.lit(""))))), "URL_MALFORMED")


def generic_titles(papers: DataFrame) -> DataFrame:
    """TITLE_GENERIC: titles that name no paper."""
    return flagged(papers, _low("title").isin("", *GENERIC_TITLES), "TITLE_GENERIC")


def uncomposed(rows: DataFrame, column: str = "text") -> DataFrame:
    """UNICODE_CANONICAL: texts that are not in the composed normal form."""
    from ..functions.unicode import nfc

    return flagged(rows, F.coalesce(nfc(column) != F.col(column), F.lit(False)), "UNICODE_CANONICAL")


def abstract_issues(papers: DataFrame, texts: DataFrame, longest: int = 2500, share: float = 0.2) -> DataFrame:
    """ABSTRACT_MISSING: papers with prose but no abstract. ABSTRACT_SUSPECT: an abstract that is longer than ``longest``, more than
    ``share`` of the prose outside the references, or not in the paper's text. ``texts``: paper_id, text_id, text, section_type."""
    prose = texts.where("coalesce(section_type, '') <> 'references'").groupBy("paper_id").agg(F.sum(F.length("text")).alias("size"), F.array_sort(F.collect_list(F.struct("text_id", "text"))).alias("s"))
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    rows = papers.select("paper_id", F.trim(F.coalesce("abstract", F.lit(""))).alias("a")).join(prose, "paper_id", "left")
    held = plain(F.array_join(F.transform("s", lambda x: x["text"]), " ")).contains(plain(F.col("a")))
    missing = rows.where((F.col("a") == "") & (F.coalesce("size", F.lit(0)) > 0)).withColumn("n", F.lit(1))
    suspect = rows.where((F.col("a") != "") & ((F.length("a") > longest) | F.coalesce(F.length("a") > share * F.col("size"), F.lit(True)) | ~F.coalesce(held, F.lit(False)))).withColumn("n", F.length("a"))
    return _issue("ABSTRACT_MISSING", missing).unionByName(_issue("ABSTRACT_SUSPECT", suspect))


def appendix_nesting(sections: DataFrame) -> DataFrame:
    """APPENDIX_NESTING: appendices that hang below a section that is none."""
    p = sections.select("paper_id", F.col("section_id").alias("parent_id"), F.col("section_type").alias("above"))
    rows = sections.where("section_type = 'appendix' AND parent_id IS NOT NULL").join(p, ["paper_id", "parent_id"])
    return flagged(rows, F.coalesce("above", F.lit("")) != "appendix", "APPENDIX_NESTING")


def panel_captions(figures: DataFrame) -> DataFrame:
    """PANEL_CAPTION: captions that are a panel's letter alone."""
    return flagged(figures, _low("caption").rlike(r"^\(?[a-h]\)?[.:]?$"), "PANEL_CAPTION")


def zero_xrefs(bibs: DataFrame, xrefs: DataFrame) -> DataFrame:
    """XREF_ZERO: papers with references of which no mention links to one."""
    linked = xrefs.where("target_id IS NOT NULL").select("paper_id").distinct()
    return _issue("XREF_ZERO", bibs.groupBy("paper_id").agg(F.countDistinct("bib_id").alias("n")).join(linked, "paper_id", "left_anti"))


def orphan_statements(papers: DataFrame, texts: DataFrame) -> DataFrame:
    """STATEMENT_ORPHAN: statements whose text stands nowhere in the paper."""
    plain = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")
    whole = texts.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("text_id", "text"))), lambda x: x["text"]), " ").alias("all"))
    rows = papers.where(F.trim(F.coalesce("statement", F.lit(""))) != "").join(whole, "paper_id", "left")
    return flagged(rows, ~plain(F.col("all")).contains(plain(F.col("statement"))), "STATEMENT_ORPHAN")


#: Foreign keys of the export tables: table, column, target table, target key; xrefs point at a table by their type.
EDGES = (
    ("text", "section_id", "section", "section_id"), ("section", "parent_id", "section", "section_id"), ("bib", "text_id", "text", "text_id"), ("xref", "text_id", "text", "text_id"), ("figure", "text_id", "text", "text_id"), ("table", "text_id", "text", "text_id"),
    ("eq", "text_id", "text", "text_id"), ("url", "text_id", "text", "text_id"), ("footnote", "text_id", "text", "text_id"), ("author_affiliation", "author_id", "author", "author_id"), ("author_affiliation", "affiliation_id", "affiliation", "affiliation_id"), ("bib_match", "bib_id", "bib", "bib_id"),
)
XREF_TARGETS = {"bib": ("bib", "bib_id"), "figure": ("figure", "figure_id"), "table": ("table", "table_id"), "foot": ("footnote", "footnote_id")}


def dangling_everywhere(tables: dict[str, DataFrame]) -> DataFrame:
    """DANGLING_REF over all edges of the tables that are there: paper_id and the number of lost references of all edges."""
    lost = []
    for table, column, target, key in EDGES:
        if table in tables and target in tables and column in tables[table].columns:
            lost.append(dangling(tables[table].select("paper_id", column), column, tables[target], key))
    for kind, (target, key) in XREF_TARGETS.items():
        if "xref" in tables and target in tables:
            lost.append(dangling(tables["xref"].where(F.col("type") == kind).select("paper_id", "target_id"), "target_id", tables[target], key))
    return reduce(DataFrame.unionByName, lost).groupBy("code", "paper_id").agg(F.sum("n").alias("n"))
