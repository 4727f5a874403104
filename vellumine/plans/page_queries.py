"""Queries over the web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions import text as T
from ..operators import quality, references
from ..sources import html, sinks
from .fixtures import made


def _pages(spark, sf_dir):
    return html.read_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def page_report(spark, sf_dir):
    """Title, structure, links and the tenth percentile of text quality per page; pages are parsed once."""
    rows = _pages(spark, sf_dir)
    value = quality.tenth(F.transform("blocks", lambda b: quality.rate(b["text"])))
    return rows.select("page_id", "title", "lang", F.size("blocks").alias("n_blocks"), F.size(F.filter("blocks", lambda b: b["kind"] == "heading")).alias("n_headings"), F.size("links").alias("n_links"), F.round(value, 6).alias("quality"))


def page_titles(spark, sf_dir):
    """S7 on regular expressions alone, for pages whose heads are plain."""
    c = F.col("html")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract(c, r"<html[^>]*lang=\"([^\"]*)\"", 1).alias("lang"), F.md5(F.regexp_extract(c, r"(?s)<title>(.*?)</title>", 1)).alias("title_md5"), F.size(F.regexp_extract_all(c, F.lit(r"<a [^>]*href=\"([^\"]*)\""), F.lit(1))).cast("long").alias("n_anchors"))


def page_urls(spark, sf_dir):
    """Page addresses without query and fragment, their host and depth."""
    u = F.regexp_replace("url", r"[?#].*$", "")
    rest = F.regexp_replace(u, r"^https?://[^/]+/?", "")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.clean_url(u).alias("url"), F.lower(F.regexp_extract(u, r"^https?://([^/]+)", 1)).alias("host"), F.size(F.filter(F.split(rest, "/"), lambda s: s != "")).cast("long").alias("depth"))


def page_blocks(spark, sf_dir):
    """One row per block."""
    rows = _pages(spark, sf_dir).select("page_id", F.posexplode("blocks").alias("block_id", "b"))
    return rows.select("page_id", "block_id", "b.kind", "b.level", "b.parent", F.md5("b.text").alias("text_md5"))


def name_similarity(spark, sf_dir):
    """Jaro-Winkler of part names and their neighbours, each distinct pair once."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    pairs = p.join(q, "p_partkey")
    scored = pairs.select("p_name", "other").distinct().withColumn("similarity", F.round(fuzzy.jaro_winkler("p_name", "other"), 6))
    return pairs.join(scored, ["p_name", "other"]).select("p_partkey", "similarity")


def registry_match(spark, sf_dir):
    """Part names as printed titles against all parts as registry works."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    bibs = p.select(F.col("p_partkey").alias("bib_id"), F.concat_ws(" ", "p_name", F.lit("a study of"), "p_type").alias("title"), (2000 + F.col("p_size") % 9).alias("year"))
    works = p.select(F.col("p_partkey").alias("work_id"), F.concat_ws(" ", F.lit("A Study of"), "p_type", "p_name").alias("title"), F.lit(2004).alias("year"))
    return references.match_registry(bibs, works)


def _bibs(spark, sf_dir):
    b = made(spark, sf_dir, "bib")
    return b.select("paper_id", "bib_id", F.lit("journal-article").alias("bib_type"), F.concat(F.lit("Title & part "), "bib_id").alias("title"), F.array(F.struct(F.concat(F.lit("Fam"), F.char(F.lit(97) + F.col("bib_id") % 5)).alias("family"), F.lit("A.").alias("given"))).alias("authors"), "year", "container", "volume", "first_page", F.lit(None).cast("string").alias("last_page"), "doi")


def reference_bibtex(spark, sf_dir):
    return sinks.to_bibtex(_bibs(spark, sf_dir))


def reference_ris(spark, sf_dir):
    return sinks.to_ris(_bibs(spark, sf_dir))


def reference_csl(spark, sf_dir):
    return sinks.to_csl(_bibs(spark, sf_dir))


QUERIES = {f.__name__: f for f in (page_report, page_titles, page_urls, page_blocks, name_similarity, registry_match, reference_bibtex, reference_ris, reference_csl)}

ORACLES = {
    "page_titles": """SELECT page_id, regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS lang, md5(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title_md5, len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS n_anchors FROM pages""",
    "page_urls": """
        WITH u AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages)
        SELECT page_id, regexp_replace(u, '[.,;:!?]+$', '') AS url, lower(regexp_extract(u, '^https?://([^/]+)', 1)) AS host, len(list_filter(string_split(regexp_replace(u, '^https?://[^/]+/?', ''), '/'), lambda s: s <> '')) AS depth FROM u""",
    "name_similarity": "SELECT a.p_partkey, round(jaro_winkler_similarity(a.p_name, b.p_name), 6) AS similarity FROM part a JOIN part b ON b.p_partkey - 1 = a.p_partkey",
    "reference_ris": """
        SELECT o_custkey AS paper_id, o_orderkey AS bib_id, array_to_string(list_filter(['TY  - JOUR', 'AU  - Fam' || chr((97 + o_orderkey % 5)::INT) || ', A.', 'TI  - Title & part ' || o_orderkey, CASE WHEN o_orderkey % 6 <> 0 THEN 'PY  - ' || year(o_orderdate) END,
            CASE WHEN o_orderkey % 2 <> 0 THEN 'JO  - Journal ' || (o_orderkey % 20) END, CASE WHEN o_orderkey % 3 <> 0 THEN 'VL  - ' || (o_orderkey % 50) END, CASE WHEN o_orderkey % 4 <> 0 THEN 'SP  - ' || (o_orderkey % 900) END,
            CASE WHEN o_orderkey % 5 <> 0 THEN 'DO  - 10.1000/W' || (o_orderkey % 997) END, 'ER  - '], lambda x: x IS NOT NULL), chr(13) || chr(10)) || chr(13) || chr(10) AS ris FROM orders""",
}
