"""Queries over files made from whole documents, ledgers, exports, metrics and scanned readings."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from ..functions import scan_text, unicode
from ..functions import text as T
from ..functions.arrow import arrow_udf
from ..operators import front, fulltext, ledger, metrics
from ..sources import html, papers, sinks
from . import document_queries
from .fixtures import made, sql
from .printed import ADJECTIVES, NOUNS, pick


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _file(doc_id: int, lines: list[str]) -> bytes:
    """A document of these lines as JATS, web page, DOCX or ePub, by its number."""
    escape = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    title, kind = f"Document {doc_id}", doc_id % 4
    body = "".join(f"<p>{escape(x)}</p>" for x in lines)
    if kind == 0:
        return f'<?xml version="1.0" encoding="UTF-8"?><article><body><sec><title>{title}</title>{body}</sec></body></article>'.encode()
    if kind == 1:
        return f"<!DOCTYPE html><html><body><h1>{title}</h1>{body}</body></html>".encode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        # Members carry a fixed date, so that a file made again has the same bytes and with them the same id.
        put = lambda name, text: z.writestr(zipfile.ZipInfo(name), text)
        if kind == 2:
            runs = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in lines)
            put("word/document.xml", f'<w:document xmlns:w="{_WORD}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>{title}</w:t></w:r></w:p>{runs}</w:body></w:document>')
        else:
            put("mimetype", "application/epub+zip")
            put("META-INF/container.xml", '<container><rootfiles><rootfile full-path="b/c.opf"/></rootfiles></container>')
            put("b/c.opf", '<package><manifest><item id="x" href="x.html"/></manifest><spine><itemref idref="x"/></spine></package>')
            put("b/x.html", f"<html><body><h1>{title}</h1>{body}</body></html>")
    return out.getvalue()


#: Characters that XML cannot hold, and blanks of any kind.
_BAD = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def _files(spark, sf_dir):
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), _BAD, ""), "\n", -1)
    content = arrow_udf(_file, "binary")("doc_id", lines)
    name = F.concat(F.lit("in/"), F.col("doc_id") % 7, F.lit("/doc"), (F.floor(F.col("doc_id") / 2) * 2).cast("long"), F.lit("."), F.when(F.col("doc_id") % 4 == 0, "xml").when(F.col("doc_id") % 4 == 1, "html").when(F.col("doc_id") % 4 == 2, "docx").otherwise("epub"))
    return _read(spark, sf_dir, "documents").select("doc_id", name.alias("path"), content.alias("content"))


def paper_files(spark, sf_dir):
    """Every document as a file of one of four kinds, read back to blocks."""
    rows = papers.read_papers(_files(spark, sf_dir), "doc_id")
    text = F.array_join(F.transform("blocks", lambda b: b["text"]), "\n")
    return rows.select("doc_id", "kind", "title", F.size("blocks").cast("long").alias("n_blocks"), F.md5(text).alias("text_md5"), "problem")


def paper_names(spark, sf_dir):
    """Unique ids of files whose stems, and partly contents, meet."""
    c = _read(spark, sf_dir, "customer").select("c_custkey", F.expr("'d' || (c_custkey % 3) || '/' || CASE WHEN c_custkey % 4 = 0 THEN 'Paper' ELSE 'paper' END || (c_custkey % 60) || '_' || c_custkey % 2 || '.v1.xml'").alias("name"), F.expr("'content ' || (c_custkey % 120)").cast("binary").alias("content"))
    files = c.withColumn("path", F.concat("name", F.lit("#"), "c_custkey"))
    named = files.select(F.concat(F.regexp_replace("path", r"^(d\d)/(.*)#(\d+)$", "$1/$3/$2")).alias("path"), "content", "c_custkey")
    return papers.paper_ids(named).select("c_custkey", "paper_id", "sha256")


LINE = "CASE WHEN event_id % 17 = 0 THEN '{\"paper_id\": \"p' WHEN event_id % 19 = 0 THEN '' WHEN event_id % 23 = 0 THEN '{\"status\":\"ok\"}' ELSE '{\"paper_id\":\"p' || user_id || '\",\"status\":\"' || CASE event_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'failed' ELSE 'started' END || '\",\"n_refs\":' || (event_id % 40) || ',\"warnings\":{\"count\":1,\"codes\":{\"A\":1}}}' END"


def ledger_lines(spark, sf_dir):
    """JSON lines with broken ones among them."""
    rows, bad = ledger.read_lines(_read(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), F.expr(LINE).alias("value")))
    good = rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("n_refs").alias("refs"))
    return good.unionByName(bad.select(F.lit("malformed").alias("status"), F.col("malformed").alias("n"), F.lit(None).cast("long").alias("refs")))


def ledger_failures(spark, sf_dir):
    """A5: failures by code and stage."""
    return ledger.failures(made(spark, sf_dir, "log").withColumn("failed_stage", F.when(F.col("line_no") % 5 > 0, F.concat(F.lit("stage"), F.col("line_no") % 5))))


def ledger_providers(spark, sf_dir):
    """Usage by label, provider and model with all totals."""
    return ledger.usage(made(spark, sf_dir, "log").withColumn("provider", F.concat(F.lit("p"), F.col("key") % 3)), "label", "provider", "model")


def field_sources(spark, sf_dir):
    """Where each field of a paper came from."""
    e = _read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS paper_id", "'field' || (l_partkey % 5) AS field", "'rule' || l_suppkey % 7 AS source", "(l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey AS line_no")
    p = ledger.provenance(e)
    return p.select("paper_id", F.array_join(F.transform(F.map_entries("sources"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias("sources"))


def paper_json(spark, sf_dir):
    """Papers with their sections and references as one JSON document each."""
    s = made(spark, sf_dir, "section").select("paper_id", "section_id", "header", "section_type")
    b = made(spark, sf_dir, "bib").select("paper_id", "bib_id", "volume", "year", F.when(F.col("bib_id") % 3 == 0, "book").otherwise("scroll").alias("bib_type"))
    p = s.select("paper_id").distinct().withColumn("schema_version", F.lit("1.0"))
    return sinks.export_json(p, {"section": s, "bib": b}).select("paper_id", F.md5("json").alias("json_md5"))


def reference_types(spark, sf_dir):
    """Types of other vocabularies."""
    return _read(spark, sf_dir, "part").select("p_partkey", T.bib_type(F.expr(pick("p_partkey", ["Article", " inbook", "posted-content", "scroll", "", "phdthesis", "edited-book", "proceedings"]))).alias("bib_type"))


def diff_paths(spark, sf_dir):
    """Export differences by path."""
    return metrics.by_path(document_queries.export_diff(spark, sf_dir), "o_orderkey")


def name_sets(spark, sf_dir):
    """F1 of name sets."""
    p = _read(spark, sf_dir, "part")
    return metrics.set_f1(p.select((F.col("p_partkey") % 40).alias("id"), F.when(F.col("p_partkey") % 3 == 0, "gold").otherwise("pred").alias("side"), F.col("p_name").alias("item")))


def name_matches(spark, sf_dir):
    """Names matched one to one by likeness; every second predicted name has a letter doubled."""
    c = _read(spark, sf_dir, "customer").select((F.col("c_custkey") % 50).alias("id"), F.concat(F.lit("Person "), "c_custkey").alias("item"), F.col("c_custkey"))
    return metrics.fuzzy_f1(c.select("id", F.lit("gold").alias("side"), "item").union(c.where("c_custkey % 3 > 0").select("id", F.lit("pred"), F.when(F.col("c_custkey") % 2 == 0, F.concat("item", F.lit("x"))).otherwise(F.col("item")))))


def extraction_scores(spark, sf_dir):
    """Title, DOI, edit and overlap scores of made predictions against the benchmark's passages."""
    b = _read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("gold"), F.when(F.col("item_id") % 4 == 0, None).when(F.col("item_id") % 4 == 1, F.upper("text")).when(F.col("item_id") % 4 == 2, F.substring("text", 1, 60)).otherwise(F.concat("text", F.lit(" and more"))).alias("pred"))
    doi = F.when(F.col("item_id") % 3 > 0, F.concat(F.lit("10.5555/B"), "item_id"))
    return b.select("item_id", metrics.title_soft(F.col("gold"), F.col("pred")).alias("title_soft"), metrics.doi_match(doi, F.concat(F.lit("https://doi.org/10.5555/b"), F.col("item_id") + F.col("item_id") % 2)).alias("doi_match"), F.round(metrics.edit_similarity(F.col("gold"), F.col("pred")), 6).alias("ned"), F.round(metrics.rouge_l("gold", "pred"), 6).alias("rouge_l"), metrics.presence(F.col("gold"), F.col("pred")).alias("presence"))


def table_cells(spark, sf_dir):
    """Tables of made pages, with spans, as matrices of cells."""
    page = F.expr("'<html><body><table><tr><td rowspan=2>a' || p_partkey || '<td colspan=2>b<tr><td>' || p_size || '<td>d<br>e<tr hidden><td>no<tr><td>x' || (p_size % 3) || '</table></body></html>'")
    # A small file is one task; its pages are dealt out before they are made.
    parts = _read(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    rows = html.read_pages(parts.select("p_partkey", page.alias("html")), "p_partkey").select("p_partkey", F.posexplode(F.col("tables")[0]).alias("r", "cells"))
    return rows.select("p_partkey", F.col("r").cast("long").alias("r"), F.posexplode("cells").alias("c", "cell")).select("p_partkey", "r", F.col("c").cast("long").alias("c"), "cell")


def token_tables(spark, sf_dir):
    """Tables in the token language decoded."""
    t = F.expr("'<ched>A<lcel><nl><fcel>' || p_partkey || '<fcel>x' || p_size || '<nl><ucel><ecel>' || CASE WHEN p_partkey % 3 > 0 THEN '<nl>' ELSE '' END")
    g = _read(spark, sf_dir, "part").select("p_partkey", arrow_udf(scan_text.otsl, scan_text.GRID)(t).alias("g"))
    return g.select("p_partkey", F.array_join(F.transform("g.rows", lambda r: F.array_join(r, "|")), "/").alias("cells"), "g.complete", F.md5("g.html").alias("html_md5"))


def merged_readings(spark, sf_dir):
    """Turns of a conversation as a page's regions, tidied and put together."""
    c = _read(spark, sf_dir, "conversations").select("conv_id", "turn", arrow_udf(scan_text.tidy_reading, "string")("text").alias("text"))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("r"))
    merged = arrow_udf(scan_text.merged_regions, scan_text.REGIONS)(F.transform("r", lambda x: F.lit("text")), F.transform("r", lambda x: x["text"]))
    return rows.select("conv_id", F.size(merged).cast("long").alias("n_regions"), F.aggregate(merged, F.lit(0), lambda a, x: a + x["parts"]).cast("long").alias("n_parts"))


def front_records(spark, sf_dir):
    """Front matter and abstracts of papers whose first blocks are made in front of each document's own lines."""
    b = _paper_blocks(spark, sf_dir)
    f = front.front_matter(b)
    a = front.abstract_spans(b).withColumnRenamed("rule", "abstract_rule")
    return f.join(a, "paper_id", "left").select("paper_id", "title", "authors", "rule", "first_id", "last_id", "abstract_rule")


def _paper_blocks(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    block = lambda i, kind, text: F.struct(F.lit(i).cast("long").alias("block_id"), F.lit(1).cast("long").alias("page"), F.lit(kind).alias("kind"), F.expr(text).alias("text"))
    fixed = F.array(block(1, "text", "'Research Article'"), block(2, "heading", f"'The ' || {pick('doc_id', ADJECTIVES)} || ' life of ' || {pick('doc_id * 3', NOUNS)}"), block(3, "text", "CASE WHEN doc_id % 3 = 0 THEN 'Ada Alder1, Ben Birch2' ELSE 'Some address, nowhere 12' END"), block(4, "heading", "CASE WHEN doc_id % 2 = 0 THEN 'Abstract' ELSE 'Overview' END"), block(5, "text", "repeat('word ', 45)"), block(6, "heading", "'1 Introduction'"))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x, i: F.struct((i + 7).cast("long").alias("block_id"), F.lit(2).cast("long").alias("page"), F.lit("text").alias("kind"), x.alias("text")))
    return d.select(F.col("doc_id").alias("paper_id"), F.explode(F.concat(fixed, lines)).alias("b")).select("paper_id", "b.*")


def paper_types(spark, sf_dir):
    """Types and fields named by printed labels."""
    text = F.expr(pick("p_partkey", ["A systematic review of sleep", "Study Protocol", "letter to the editor", "Empirical work in psychology", "Clinical health and law", "nothing of note", "Earth science and physics"]))
    return _read(spark, sf_dir, "part").select("p_partkey", front.canonical_label(text, front.TYPES).alias("type"), front.canonical_label(text, front.FIELDS).alias("field"))


def corpus_gates(spark, sf_dir):
    """Letters and words known from other texts, over all documents."""
    return front.text_gates(_read(spark, sf_dir, "documents"))


def glyph_tables(spark, sf_dir):
    """Characters put together to cells."""
    return front.glyph_cells(made(spark, sf_dir, "char"))


def tagged_statements(spark, sf_dir):
    """T35, 2.11: a registered model over whole documents; its rule stands in for weights."""
    return front.apply_model(_read(spark, sf_dir, "documents"), "statement_tagger").groupBy("field").agg(F.count(F.lit(1)).alias("n"))


TITLE = f"'The ' || {pick('p_partkey', ADJECTIVES)} || ' life' || CASE p_partkey % 3 WHEN 0 THEN ': a study of ' WHEN 1 THEN ' – notes on ' ELSE ' of ' END || {pick('p_partkey * 3', NOUNS)} || CASE p_partkey % 4 WHEN 0 THEN ' *' WHEN 1 THEN '†' ELSE '' END"
HEADED = f"CASE p_partkey % 4 WHEN 0 THEN '**' || (1 + p_partkey % 5) || '.2' || 'Methods** .' WHEN 1 THEN 'R E S U L T S' WHEN 2 THEN 'Accepted manuscript: Tides' ELSE (1 + p_partkey % 5) || '.  Kelp  and moss:' END"
BROKEN = "CASE p_partkey % 4 WHEN 0 THEN '{\"b\": ' || p_partkey || ', \"a\": [1, 2' WHEN 1 THEN 'Sure: {\"a\":\"x' || p_partkey || '\"} done' WHEN 2 THEN '{\"k\": [{\"v\": ' || p_partkey || '}, {\"v\": \"cut' ELSE 'none' END"
NOTE = pick("p_partkey", ["Publisher’s note Springer stays", "© 2020 Somebody", "Received: 12 May 2020", "Kelp grows", "Open access funding", "Openness"])


def title_tools(spark, sf_dir):
    """Titles taken apart, headings mended, JSON salvaged and publishers' notes told."""
    p = _read(spark, sf_dir, "part").select("p_partkey", fulltext.title_parts(F.expr(TITLE)).alias("t"), unicode.heading(F.expr(HEADED)).alias("heading"), fulltext.salvage_json(F.expr(BROKEN)).alias("json"), fulltext.is_publisher_note(F.expr(NOTE)).alias("is_note"))
    return p.select("p_partkey", "t.title", "t.subtitle", "t.marks", "heading", "json", "is_note")


def reference_texts(spark, sf_dir):
    """References with their printed text, which stands in sections of that type only."""
    text = made(spark, sf_dir, "numbered").select("paper_id", F.col("section_id"), F.col("section_id").alias("text_id"), F.col("header").alias("text"), "section_type")
    sections = text.select("paper_id", "section_id", "section_type").where("section_type = 'references'")
    bibs = made(spark, sf_dir, "numbered").select("paper_id", F.col("section_id").alias("bib_id"), (F.col("section_id") + 40).alias("text_id"))
    return bibs.join(text.join(sections, ["paper_id", "section_id"], "left_semi").select("paper_id", "text_id", F.col("text").alias("raw")), ["paper_id", "text_id"], "left").select("paper_id", "bib_id", "raw")


QUERIES = {
    f.__name__: f
    for f in (
        paper_files, paper_names, ledger_lines, ledger_failures, ledger_providers, field_sources, paper_json, reference_types, diff_paths, name_sets, name_matches, extraction_scores, table_cells, token_tables, merged_readings, front_records,
        paper_types, corpus_gates, glyph_tables, tagged_statements, title_tools, reference_texts,
    )
}

_LETTERS = r"regexp_replace(coalesce(text, ''), '[\s\x0B\p{Z}]+', '', 'g')"
_STEM = "CASE WHEN c_custkey % 4 = 0 THEN 'Paper' ELSE 'paper' END || (c_custkey % 60) || '_' || c_custkey % 2 || '.v1'"

ORACLES = {
    "paper_files": r"""
        WITH l AS (SELECT doc_id, generate_subscripts(string_split(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), chr(10)), 1) AS i, unnest(string_split(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), chr(10))) AS t FROM documents),
        c AS (SELECT doc_id, i, trim(regexp_replace(t, '[\s\x{85}\p{Z}]+', ' ', 'g')) AS t FROM l), b AS (SELECT doc_id, 0 AS i, 'Document ' || doc_id AS t FROM documents UNION ALL SELECT * FROM c WHERE t <> '')
        SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'jats' WHEN 1 THEN 'html' WHEN 2 THEN 'docx' ELSE 'epub' END AS kind, 'Document ' || doc_id AS title, count(*) AS n_blocks, md5(string_agg(t, chr(10) ORDER BY i)) AS text_md5, NULL::VARCHAR AS problem FROM b GROUP BY doc_id""",
    "paper_names": f"""
        WITH f AS (SELECT c_custkey, 'd' || (c_custkey % 3) || '/' || c_custkey || '/' AS path, {_STEM} AS stem, sha256('content ' || (c_custkey % 120)) AS sha256 FROM customer),
        b AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY lower(stem)) > 1 THEN stem || '-' || sha256[1:8] ELSE stem END AS base FROM f),
        n AS (SELECT *, row_number() OVER (PARTITION BY lower(base) ORDER BY path || stem || '.xml') AS k FROM b)
        SELECT c_custkey, CASE WHEN k > 1 THEN base || '.' || k ELSE base END AS paper_id, sha256 FROM n""",
    "ledger_lines": """
        WITH e AS (SELECT *, event_id % 17 = 0 OR (event_id % 19 <> 0 AND event_id % 23 = 0) AS bad, event_id % 17 <> 0 AND event_id % 19 = 0 AS blank FROM events)
        SELECT CASE event_id % 3 WHEN 0 THEN 'ok' ELSE 'failed' END AS status, count(*) AS n, sum(event_id % 40)::BIGINT AS refs FROM e WHERE NOT bad AND NOT blank AND event_id % 3 <> 2 GROUP BY 1 UNION ALL SELECT 'malformed', count(*), NULL FROM e WHERE bad""",
    "ledger_failures": f"""
        WITH {sql('log')}, x AS (SELECT 'code' AS kind, code AS name FROM log WHERE status = 'failed' UNION ALL SELECT 'stage', CASE WHEN line_no % 5 > 0 THEN 'stage' || (line_no % 5) ELSE 'unknown' END FROM log WHERE status = 'failed'), c AS (SELECT kind, name, count(*) AS n FROM x GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, name) AS place FROM c""",
    "ledger_providers": f"WITH {sql('log')}, l AS (SELECT *, 'p' || (key % 3) AS provider FROM log) SELECT label, provider, model, count(*) AS calls, sum(tokens)::BIGINT AS tokens, grouping(label, provider, model) AS level FROM l GROUP BY ROLLUP (label, provider, model)",
    "field_sources": """
        WITH e AS (SELECT l_orderkey AS paper_id, 'field' || (l_partkey % 5) AS field, arg_max('rule' || l_suppkey % 7, (l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey) AS source FROM lineitem GROUP BY ALL) SELECT paper_id, string_agg(field || '=' || source, ';' ORDER BY field) AS sources FROM e GROUP BY 1""",
    "paper_json": f"""
        WITH {sql('section', 'bib')}, s AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY section_id) AS k FROM section), b AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY bib_id) AS k FROM bib),
        sj AS (SELECT paper_id, list({{'section_id': k, 'header': header, 'section_type': section_type}} ORDER BY k) AS section FROM s GROUP BY 1), bj AS (SELECT paper_id, list({{'bib_id': k, 'volume': volume, 'year': year, 'bib_type': CASE WHEN bib_id % 3 = 0 THEN 'book' END}} ORDER BY k) AS bib FROM b GROUP BY 1)
        SELECT paper_id, md5(to_json({{'paper_id': paper_id, 'schema_version': '1.0', 'section': section, 'bib': coalesce(bib, [])}})::VARCHAR) AS json_md5 FROM sj LEFT JOIN bj USING (paper_id)""",
    "reference_types": f"SELECT p_partkey, {pick('p_partkey', ['journal_article', 'book_chapter', 'preprint', 'other', 'other', 'thesis', 'book', 'conference_paper'])} AS bib_type FROM part",
    "name_sets": """
        WITH c AS (SELECT p_partkey % 40 AS id, lower(p_name) AS item, max((p_partkey % 3 = 0)::INT) AS g, max((p_partkey % 3 <> 0)::INT) AS p FROM part GROUP BY ALL)
        SELECT id, CASE WHEN sum(g) > 0 THEN round(2 * sum(g * p) / (sum(g) + sum(p)), 6) END AS f1 FROM c GROUP BY 1""",
    "table_cells": """
        WITH c AS (SELECT p_partkey, unnest([0, 0, 0, 1, 1, 1, 2, 2, 2]) AS r, unnest([0, 1, 2, 0, 1, 2, 0, 1, 2]) AS c, unnest(['a' || p_partkey, 'b', 'b', 'a' || p_partkey, p_size::VARCHAR, 'd e', 'x' || (p_size % 3), '', '']) AS cell FROM part) SELECT * FROM c""",
    "token_tables": """
        WITH t AS (SELECT p_partkey, p_partkey::VARCHAR AS k, 'x' || p_size AS s FROM part) SELECT p_partkey, 'A|A/' || k || '|' || s || '/' || k || '|' AS cells, p_partkey % 3 > 0 AS complete,
            md5('<table><tr><th colspan="2">A</th></tr><tr><td rowspan="2">' || k || '</td><td>' || s || '</td></tr><tr><td></td></tr></table>') AS html_md5 FROM t""",
    "front_records": f"""
        SELECT doc_id AS paper_id, 'The ' || {pick('doc_id', ADJECTIVES)} || ' life of ' || {pick('doc_id * 3', NOUNS)} AS title, CASE WHEN doc_id % 3 = 0 THEN 'Ada Alder, Ben Birch' END AS authors, CASE WHEN doc_id % 3 = 0 THEN 'title_over_people' ELSE 'only_heading' END AS rule,
            5 AS first_id, 5 AS last_id, CASE WHEN doc_id % 2 = 0 THEN 'heading' ELSE 'before_introduction' END AS abstract_rule FROM documents""",
    "paper_types": f"SELECT p_partkey, {pick('p_partkey', ['review', 'protocol', 'commentary', 'empirical', '', '', ''])} AS type, {pick('p_partkey', ['', '', '', 'social sciences', 'medical and health sciences', '', 'natural sciences'])} AS field FROM part".replace("THEN ''", "THEN NULL"),
    "corpus_gates": rf"""
        WITH w AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}]+')) AS word FROM documents) WHERE len(word) > 1 GROUP BY ALL),
        k AS (SELECT doc_id, sum(CASE WHEN texts > 1 THEN n ELSE 0 END) / sum(n) AS known FROM w JOIN (SELECT word, count(*) AS texts FROM w GROUP BY 1) USING (word) GROUP BY 1),
        l AS (SELECT doc_id, CASE WHEN len({_LETTERS}) > 0 THEN len(regexp_replace({_LETTERS}, '\P{{L}}+', '', 'g')) / len({_LETTERS}) ELSE 0.0 END AS letters FROM documents)
        SELECT doc_id, round(letters, 6) AS letters, round(known, 6) AS known, coalesce(round(letters, 6) >= 0.5 AND known >= 0.3, false) AS passes FROM l LEFT JOIN k USING (doc_id)""",
    "glyph_tables": f"""
        WITH {sql('char')}, j AS (SELECT *, coalesce(y - lag(y) OVER w > 0.5 * height, false)::INT AS jump FROM char WINDOW w AS (PARTITION BY page_id ORDER BY y, x, char_id)), l AS (SELECT *, sum(jump) OVER (PARTITION BY page_id ORDER BY y, x, char_id ROWS UNBOUNDED PRECEDING)::BIGINT AS line FROM j),
        m AS (SELECT page_id, median(height) AS usual FROM char GROUP BY 1), a AS (SELECT *, coalesce(x - lag(x) OVER (PARTITION BY page_id, line ORDER BY x, char_id) > 1.5 * usual, false)::INT AS apart FROM l JOIN m USING (page_id)),
        c AS (SELECT *, sum(apart) OVER (PARTITION BY page_id, line ORDER BY x, char_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cell FROM a) SELECT page_id, line, cell, count(*) AS n FROM c GROUP BY ALL""",
    "title_tools": f"""
        WITH p AS (SELECT p_partkey, 'The ' || {pick('p_partkey', ADJECTIVES)} || ' life' AS head, {pick('p_partkey * 3', NOUNS)} AS noun, p_partkey % 3 AS a, p_partkey % 4 AS b FROM part)
        SELECT p_partkey, CASE WHEN a < 2 THEN head ELSE head || ' of ' || noun END AS title, CASE a WHEN 0 THEN 'a study of ' || noun WHEN 1 THEN 'notes on ' || noun END AS subtitle, CASE b WHEN 0 THEN '*' WHEN 1 THEN '†' END AS marks,
            CASE b WHEN 0 THEN (1 + p_partkey % 5) || '.2 Methods' WHEN 1 THEN 'RESULTS' WHEN 2 THEN 'Tides' ELSE (1 + p_partkey % 5) || ' Kelp and moss' END AS heading,
            CASE b WHEN 0 THEN '{{"a":[1],"b":' || p_partkey || '}}' WHEN 1 THEN '{{"a":"x' || p_partkey || '"}}' WHEN 2 THEN '{{"k":[{{"v":' || p_partkey || '}},{{}}]}}' END AS json, p_partkey % 6 IN (0, 1, 2, 4) AS is_note FROM p""",
    "reference_texts": f"WITH {sql('numbered')} SELECT b.paper_id, b.section_id AS bib_id, t.header AS raw FROM numbered b LEFT JOIN numbered t ON t.paper_id = b.paper_id AND t.section_id = b.section_id + 40 AND t.section_type = 'references'",
    "name_matches": """
        WITH c AS (SELECT c_custkey % 50 AS id, count(*) AS g, sum((c_custkey % 3 > 0)::INT) AS p FROM customer GROUP BY 1) SELECT id, round(2 * p / (g + p), 6) AS f1 FROM c""",
}
ORACLES["diff_paths"] = f"SELECT path, count(DISTINCT o_orderkey) AS papers, count(*) AS n FROM ({document_queries.ORACLES['export_diff']}) GROUP BY 1"
