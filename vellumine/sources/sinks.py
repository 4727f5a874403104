"""Corpus tables as Parquet, reference lists as CSL-JSON, BibTeX and RIS, and the schema as JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CSL_TYPES = {"journal-article": ("article-journal", "article", "JOUR"), "book": ("book", "book", "BOOK"), "proceedings-article": ("paper-conference", "inproceedings", "CPAPER"), "dissertation": ("thesis", "phdthesis", "THES"), "report": ("report", "techreport", "RPRT")}
#: Characters that BibTeX reads as commands; the backslash is written last, so that what the others bring stays.
_ESCAPES = (("\\", "\x01"), ("{", "\\{"), ("}", "\\}"), ("&", "\\&"), ("%", "\\%"), ("$", "\\$"), ("#", "\\#"), ("_", "\\_"), ("~", "\\textasciitilde{}"), ("^", "\\textasciicircum{}"), ("\x01", "\\textbackslash{}"))
#: Tables of an export and the columns that name their rows.
EXPORT_TABLES = {
    "paper": "paper_id", "author": "author_id", "affiliation": "affiliation_id", "author_affiliation": None, "funding": "funding_id", "text": "text_id", "section": "section_id", "url": "url_id", "bib": "bib_id", "xref": "xref_id", "figure": "figure_id",
    "table": "table_id", "footnote": "footnote_id", "eq": "eq_id", "metadata_match": "match_id", "affiliation_match": "match_id", "funding_match": "match_id", "bib_match": "match_id", "bib_check": "bib_id",
}


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at, at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def recover(spark: SparkSession, path: str) -> None:
    """Finish or undo a write of tables that was cut off: of two whole states the newer one is put in place."""
    at, fs = _files(spark, path)
    new, old = at(f"{path}.__new"), at(f"{path}.__old")
    if not fs.exists(at(path)):
        if fs.exists(new) and fs.exists(at(f"{path}.__new/_COMPLETE")):
            fs.rename(new, at(path))
        elif fs.exists(old):
            fs.rename(old, at(path))
    fs.delete(new, True)
    fs.delete(old, True)


def write_tables(tables: dict[str, DataFrame], path: str, key: str = "paper_id") -> None:
    """The folder ``path`` with exactly these tables; a paper_id twice in ``paper`` is an error, empty tables keep their columns.

    All tables are complete in a folder beside it before that is renamed into place. Where a crash falls between the two
    renames, ``recover``, which every write calls first, puts the new state in place; at no time is a whole state lost.
    """
    if "paper" in tables:
        twice = tables["paper"].groupBy(key).count().where("count > 1").limit(5).collect()
        if twice:
            raise ValueError(f"duplicate {key}: {[r[0] for r in twice]}")
    spark = next(iter(tables.values())).sparkSession
    path = path.rstrip("/")
    recover(spark, path)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}.__new/{name}")
    at, fs = _files(spark, path)
    fs.create(at(f"{path}.__new/_COMPLETE"), True).close()
    if fs.exists(at(path)):
        fs.rename(at(path), at(f"{path}.__old"))
    fs.rename(at(f"{path}.__new"), at(path))
    fs.delete(at(f"{path}.__old"), True)


#: Values that a column may hold in an export; others are written as null.
VOCABULARY = {
    "section_type": ("abstract", "introduction", "methods", "results", "discussion", "conclusion", "references", "appendix", "acknowledgements", "funding", "data_availability", "coi", "unknown"),
    "bib_type": ("journal_article", "book", "book_chapter", "conference_paper", "report", "preprint", "dataset", "software", "thesis", "other"),
}


def export_json(papers: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """paper_id and one JSON document per paper with its rows of every table in the order of their ids, which are renumbered from 1.

    Fields keep the order of their columns and nulls are written; values outside VOCABULARY become null; a paper without
    rows of a table has an empty list.
    """
    out, nested = papers, []
    for name, df in tables.items():
        key = EXPORT_TABLES.get(name) or df.columns[1]
        place = F.row_number().over(Window.partitionBy("paper_id").orderBy(key)).cast("long")
        fields = [F.when(F.col(c).isin(*VOCABULARY[c]), F.col(c)).alias(c) if c in VOCABULARY else (F.col("__place").alias(c) if c == key else F.col(c)) for c in df.columns if c != "paper_id"]
        rows = df.withColumn("__place", place).select("paper_id", "__place", F.struct(*fields).alias("row"))
        rows = rows.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__place", "row"))), lambda x: x["row"]).alias(name))
        nested.append(F.coalesce(F.col(name), F.array().cast(rows.schema[name].dataType)).alias(name))
        out = out.join(rows, "paper_id", "left")
    return out.select("paper_id", F.to_json(F.struct(*papers.columns, *nested), {"ignoreNullFields": "false"}).alias("json"))


def _kind(column: str, place: int, other: str) -> Column:
    out = F.lit(other)
    for name, kinds in CSL_TYPES.items():
        out = F.when(F.col(column) == name, kinds[place]).otherwise(out)
    return out


def cite_keys(bibs: DataFrame) -> DataFrame:
    """Unique keys per paper: first family and year, with a, b, ... where they meet."""
    base = F.concat(F.coalesce(F.regexp_replace(F.lower(F.get("authors", F.lit(0))["family"]), "[^a-z]", ""), F.lit("anon")), F.coalesce(F.col("year").cast("string"), F.lit("nd")))
    w = Window.partitionBy("paper_id", "base")
    rows = bibs.withColumn("base", base).withColumn("n", F.row_number().over(w.orderBy("bib_id"))).withColumn("k", F.count(F.lit(1)).over(w))
    letters = F.concat(F.when(F.col("n") > 26, F.char(F.lit(96) + F.floor((F.col("n") - 1) / 26))).otherwise(""), F.char(F.lit(97) + (F.col("n") - 1) % 26))
    return rows.withColumn("cite_key", F.when(F.col("k") > 1, F.concat("base", letters)).otherwise(F.col("base"))).drop("base", "n", "k")


def to_csl(bibs: DataFrame) -> DataFrame:
    """paper_id, bib_id, csl: one JSON object per reference; absent fields are left out."""
    names = F.transform("authors", lambda a: F.struct(a["family"].alias("family"), a["given"].alias("given")))
    issued = F.when(F.col("year").isNotNull(), F.struct(F.array(F.array("year")).alias("date-parts")))
    page = F.when(F.col("first_page").isNotNull(), F.concat_ws("-", "first_page", "last_page"))
    item = F.struct(F.col("cite_key").alias("id"), _kind("bib_type", 0, "document").alias("type"), "title", names.alias("author"), issued.alias("issued"), F.col("container").alias("container-title"), "volume", page.alias("page"), F.col("doi").alias("DOI"))
    return cite_keys(bibs).select("paper_id", "bib_id", F.to_json(item).alias("csl"))


def _tex(c: Column) -> Column:
    for plain, written in _ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(written))
    return c


def to_bibtex(bibs: DataFrame) -> DataFrame:
    names = F.array_join(F.transform("authors", lambda a: F.concat_ws(", ", a["family"], a["given"])), " and ")
    pages = F.when(F.col("first_page").isNotNull(), F.concat_ws("--", "first_page", "last_page"))
    fields = (("author", F.when(F.size("authors") > 0, _tex(names))), ("title", _tex(F.col("title"))), ("year", F.col("year").cast("string")), ("journal", _tex(F.col("container"))), ("volume", F.col("volume")), ("pages", pages), ("doi", F.col("doi")))
    lines = F.array_compact(F.array(*[F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"  {n} = {{"), v, F.lit("}"))) for n, v in fields]))
    return cite_keys(bibs).select("paper_id", "bib_id", F.concat(F.lit("@"), _kind("bib_type", 1, "misc"), F.lit("{"), "cite_key", F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}")).alias("bibtex"))


def to_ris(bibs: DataFrame) -> DataFrame:
    """RIS entries with CRLF line ends."""
    one = lambda tag, v: F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{tag}  - "), v))
    authors = F.transform("authors", lambda a: F.concat(F.lit("AU  - "), F.concat_ws(", ", a["family"], a["given"])))
    rest = F.array_compact(F.array(one("TI", F.col("title")), one("PY", F.col("year").cast("string")), one("JO", F.col("container")), one("VL", F.col("volume")), one("SP", F.col("first_page")), one("EP", F.col("last_page")), one("DO", F.col("doi"))))
    lines = F.concat(F.array(F.concat(F.lit("TY  - "), _kind("bib_type", 2, "GEN"))), F.coalesce(authors, F.array().cast("array<string>")), rest, F.array(F.lit("ER  - ")))
    return bibs.select("paper_id", "bib_id", F.concat(F.array_join(lines, "\r\n"), F.lit("\r\n")).alias("ris"))


def schema_artifact(tables: dict[str, DataFrame], strict: bool = True) -> str:
    """JSON Schema of an export with these tables, keys sorted.

    The strict variant, for writers, wants every column and no other; the reader's lets columns be absent and allows new ones.
    """
    plain = {"string": "string", "long": "integer", "integer": "integer", "short": "integer", "double": "number", "float": "number", "boolean": "boolean", "date": "string", "timestamp": "string", "binary": "string"}

    def of(kind) -> dict:
        if isinstance(kind, dict) and kind["type"] == "array":
            return {"type": ["array", "null"], "items": of(kind["elementType"])}
        if isinstance(kind, dict) and kind["type"] == "struct":
            return {"type": ["object", "null"], **members(kind["fields"])}
        return {"type": [plain.get(kind, "string") if isinstance(kind, str) else "object", "null"]}

    def members(fields: list[dict]) -> dict:
        return {"properties": {f["name"]: of(f["type"]) for f in fields}, "additionalProperties": not strict, **({"required": sorted(f["name"] for f in fields)} if strict else {})}

    parts = {name: {"type": "array", "items": {"type": "object", **members(json.loads(df.schema.json())["fields"])}} for name, df in tables.items()}
    return json.dumps({"$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "properties": parts, "additionalProperties": not strict, **({"required": sorted(parts)} if strict else {})}, sort_keys=True)
