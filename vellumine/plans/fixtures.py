"""Linked tables made from the driver's star tables by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "bib": ("orders", (
        "o_orderkey AS bib_id", "o_custkey AS paper_id", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE '10.1000/W' || (o_orderkey % 997) END AS doi",
        "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '' || (o_orderkey % 50) END AS volume", "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '' || (o_orderkey % 900) END AS first_page",
        "CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'Journal ' || (o_orderkey % 20) END AS container", "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS BIGINT) END AS year",
        "CASE WHEN o_orderkey % 7 = 0 THEN 'a' END AS year_suffix", "'Author (2001). Title. Journal, ' || (o_orderkey % 50) || ', ' || ((o_orderkey * 7) % 900) || '-12.' AS raw",
    )),
    "bib_match": ("lineitem", (
        "l_orderkey AS bib_id", "l_orderkey * 1000000000 + l_partkey * 10000 + l_suppkey * 10 + l_linenumber AS match_id", "CASE l_linenumber % 4 WHEN 0 THEN 'openalex' WHEN 1 THEN 'crossref' WHEN 2 THEN 'pubmed' ELSE 'elsewhere' END AS service",
        "CASE WHEN l_linenumber % 2 = 0 THEN (1 - l_discount) * 100 ELSE 1 - l_discount END AS score", "CASE WHEN l_partkey % 3 = 0 THEN '10.1000/w' || (l_orderkey % 997) ELSE '10.1000/z' || l_partkey END AS doi",
        "CASE WHEN l_partkey % 4 = 0 THEN '' || (l_orderkey % 50) || '(1)' WHEN l_partkey % 4 = 1 THEN '' || (l_orderkey % 50) WHEN l_partkey % 4 = 2 THEN '' || l_suppkey END AS volume",
        "CASE WHEN l_suppkey % 2 = 0 THEN '' || ((l_orderkey * 7) % 900) ELSE '' || (l_partkey % 900) END AS first_page", "CASE WHEN l_partkey % 5 = 0 THEN '' ELSE 'Journal ' || (l_partkey % 20) END AS container", "CAST(year(l_shipdate) AS BIGINT) AS year",
    )),
    "xref": ("lineitem", ("l_orderkey % 1500 AS paper_id", "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey END AS target_id", "l_linenumber AS n")),
    "author": ("customer", ("c_custkey % 200 AS paper_id", "c_custkey AS author_id", "'Name ' || (c_custkey % 333) AS name", "c_mktsegment || '; ' || c_nationkey AS affiliation")),
    "figure": ("part", ("p_partkey % 300 AS paper_id", "p_partkey % 1900 AS figure_id", "CASE WHEN p_size % 3 <> 0 THEN ' ' ELSE p_name END AS caption", "p_size AS x")),
    "log": ("events", (
        "user_id AS paper_id", "event_id AS line_no", "ts AS happened", "CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'signup' THEN 'started' WHEN 'view' THEN 'ok' ELSE 'failed' END AS status", "event_type AS code",
        "value AS duration_s", "event_id % 37 AS n_refs", "event_id % 23 % 19 AS n_matched", "event_type AS label", "'m' || (user_id % 4) AS model", "event_id % 1000 AS tokens", "user_id AS key",
    )),
    "marked": ("orders", ("o_custkey AS doc_id", "o_orderkey AS text_id", "CASE o_orderkey % 4 WHEN 0 THEN 'as in [' || (1 + o_orderkey % 12) || '-' || (3 + o_orderkey % 12) || ']' WHEN 1 THEN 'see [' || (o_orderkey % 20) || ', ' || (16 + o_orderkey % 20) || '] and [2]' WHEN 2 THEN 'both [9–4; 2]' ELSE 'none (3)' END AS text")),
    "listed": ("supplier", ("s_suppkey % 10 AS paper_id", "s_suppkey AS bib_id", "2000 + s_suppkey % 3 AS year", "split('Fam' || (s_suppkey % 4) || ',Co' || (s_suppkey % 3) || CASE WHEN s_suppkey % 2 = 0 THEN ',Third' ELSE '' END, ',') AS families")),
    "cited": ("part", ("p_partkey % 10 AS paper_id", "p_partkey AS cite_id", "2000 + p_partkey % 3 AS year", "split('Fam' || (p_partkey % 5) || ',Co' || (p_partkey % 3), ',') AS families")),
    "float": ("supplier", ("s_suppkey % 20 AS paper_id", "s_suppkey AS float_id", "CASE WHEN s_suppkey % 3 = 0 THEN 'table' ELSE 'figure' END AS kind", "CASE WHEN s_suppkey % 20 < 10 THEN '' || (1 + s_suppkey % 7) END AS label", "s_suppkey % 13 AS page")),
    "mention": ("part", ("p_partkey % 20 AS paper_id", "p_partkey AS mention_id", "CASE WHEN p_partkey % 4 = 0 THEN 'table' ELSE 'figure' END AS kind", "'' || (1 + p_partkey % 5) || CASE WHEN p_partkey % 6 = 0 THEN 'A' ELSE '' END AS label")),
    "section": ("part", ("p_partkey % 50 AS paper_id", "p_partkey AS section_id", "1 + p_size % 4 AS level", """CASE p_partkey % 12 WHEN 0 THEN '1. Introduction' WHEN 1 THEN '2. Materials and Methods' WHEN 2 THEN 'Study ' || (1 + p_partkey % 3) WHEN 3 THEN 'Results of the first analysis' WHEN 4 THEN 'A B S T R A C T'
        WHEN 5 THEN 'Experiment 2b' WHEN 6 THEN 'General Discussion' WHEN 7 THEN 'References' WHEN 8 THEN 'Resultsless words' WHEN 9 THEN 'Funding' WHEN 10 THEN 'Summary' ELSE p_name END AS header""", "p_size % 8 AS trust", "CASE p_partkey % 3 WHEN 0 THEN 'abstract' WHEN 1 THEN 'references' ELSE 'methods' END AS section_type")),
    "page_start": ("supplier", ("s_suppkey % 20 AS paper_id", "s_suppkey * 7 AS start", "s_suppkey AS page")),
    "sentence_start": ("part", ("p_partkey % 20 AS paper_id", "p_partkey AS text_id", "p_partkey % 700 AS start")),
    "reading": ("orders", ("o_custkey AS paper_id", "o_orderkey AS region_id", "o_orderpriority || ' ' || o_orderkey AS first", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority || ' ' || o_orderkey ELSE o_orderpriority || o_custkey END AS second")),
    "char": ("lineitem", ("l_orderkey % 500 AS page_id", "l_orderkey * 1000 + l_partkey * 7 + l_linenumber AS char_id", "l_partkey % 100 AS x", "l_quantity AS y", "3.0 + l_linenumber AS height")),
    "numbered": ("part", ("p_partkey % 40 AS paper_id", "p_partkey AS section_id", "CASE p_partkey % 6 WHEN 0 THEN (1 + p_size % 3) || ' Alpha' WHEN 1 THEN (1 + p_size % 3) || '.' || (1 + p_partkey % 2) || ' Beta' WHEN 2 THEN (1 + p_size % 3) || '.' || (1 + p_partkey % 2) || '.' || (1 + p_size % 2) || ' Gamma' WHEN 3 THEN 'Delta 4.1' WHEN 4 THEN (1 + p_size % 3) || '. Epsilon' ELSE 'A.' || (1 + p_size % 3) || ' Zeta' END AS header",
        "CASE p_partkey % 7 WHEN 0 THEN 'abstract' WHEN 1 THEN 'methods' WHEN 2 THEN 'results' WHEN 3 THEN 'references' WHEN 4 THEN 'appendix' WHEN 5 THEN 'discussion' ELSE 'unknown' END AS section_type", "CASE WHEN p_partkey % 3 = 0 AND p_partkey > 40 THEN p_partkey - 40 END AS parent_id")),
    "region": ("part", ("p_partkey % 60 AS paper_id", "p_partkey AS region_id", "p_partkey % 120 AS page", "CASE WHEN p_size % 4 = 0 THEN 'caption' WHEN p_size % 9 = 1 THEN 'title' ELSE 'text' END AS kind", "p_name || CASE WHEN p_size % 3 = 0 THEN '.' ELSE '' END AS text", "CASE WHEN p_size % 5 = 0 THEN NULL ELSE (1 + p_size % 4) || CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'B' END END AS label", "p_partkey AS figure_id")),
    "box": ("lineitem", ("l_orderkey % 400 AS page_id", "l_orderkey * 10 + l_linenumber AS box_id", "l_quantity % 7 AS score", "l_partkey % 60 AS x0", "l_suppkey % 50 AS y0", "l_partkey % 60 + 20 + l_linenumber AS x1", "l_suppkey % 50 + 15 AS y1")),
    "rect": ("supplier", ("s_suppkey AS link_id", "s_suppkey % 500 AS page_id", "s_suppkey % 70 AS x0", "s_suppkey % 30 AS y0", "s_suppkey % 70 + 25 AS x1", "s_suppkey % 30 + 12 AS y1")),
    "span": ("lineitem", ("l_orderkey AS key", "l_partkey % 90 AS start", "l_partkey % 90 + 3 + l_linenumber AS stop", "l_linenumber % 3 AS priority", "l_linenumber AS n")),
    "fontrun": ("lineitem", ("l_orderkey % 300 AS page_id", "8 + l_linenumber AS size", "400 + 100 * (l_partkey % 4) AS weight", "CAST(l_quantity AS BIGINT) AS n")),
    "pagestat": ("part", ("p_partkey % 50 AS paper_id", "p_partkey AS page", "CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_size * 25 END AS n_chars", "p_partkey % 3 AS n_figures", "CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_partkey % 2 END AS n_tables", "p_size % 9 AS n_entries")),
    "doi_candidate": ("lineitem", ("l_orderkey % 700 AS paper_id", "CASE l_partkey % 6 WHEN 0 THEN 'https://doi.org/10.5555/K' || (l_orderkey % 3) WHEN 1 THEN '10.5555/k' || (l_orderkey % 3) || '.' WHEN 2 THEN 'none' ELSE '10.5555/m' || (l_partkey % 5) END AS doi", "CASE l_linenumber % 5 WHEN 0 THEN 'metadata' WHEN 1 THEN 'body' WHEN 2 THEN 'front' WHEN 3 THEN 'running_head' ELSE 'elsewhere' END AS tier")),
    "dash_bib": ("orders", ("o_custkey AS paper_id", "o_orderkey AS bib_id", "CASE o_orderkey % 4 WHEN 0 THEN 'Alder, A.' WHEN 1 THEN '———' WHEN 2 THEN '—. ' ELSE 'Birch, B. ' || o_orderkey END AS authors")),
    "note_cite": ("orders", ("o_custkey % 50 AS paper_id", "o_orderkey AS note_id", "'A life of ' || (o_orderkey % 9) || ' kelp and moss, ' || (o_orderkey % 2) AS title", "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Alder' ELSE 'Birch' END AS family", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 2000 + o_orderkey % 3 END AS year", "o_orderkey % 6 AS filled")),
    "listed_cite": ("supplier", ("s_suppkey % 50 AS paper_id", "'A Life of ' || (s_suppkey % 9) || ' Kelp and Moss' AS title", "CASE s_suppkey % 3 WHEN 0 THEN 'ALDER' WHEN 1 THEN 'Cedar' END AS family", "2000 + s_suppkey % 3 AS year")),
    "expected": ("customer", ("c_custkey AS paper_id",)),
    "gold_paper": ("customer", ("c_custkey AS paper_id", "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE '10.5555/P' || c_custkey END AS doi", "'Paper' || c_custkey AS file")),
    "prediction": ("customer", ("CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'https://doi.org/10.5555/p' || c_custkey END AS doi", "CASE WHEN c_custkey % 5 = 0 THEN 'other' ELSE 'paper' || c_custkey END AS file", "CAST(c_custkey % 10 AS DOUBLE) / 10 AS title_score", "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(1 AS DOUBLE) END AS doi_score")),
    "fields": ("part", ("p_partkey AS paper_id", "CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN ' ' END AS metadata", "CASE WHEN p_size % 4 = 0 THEN p_type END AS front", "CASE WHEN p_size % 5 <> 0 THEN p_brand END AS first_heading")),
    "valued": ("part", ("p_partkey % 80 AS paper_id", "p_partkey AS row_id", "CASE p_size % 8 WHEN 0 THEN 'N/A' WHEN 1 THEN 'todo' WHEN 2 THEN ' Article ' WHEN 3 THEN '' ELSE p_name END AS title", "CASE p_size % 6 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE p_name END AS name", "CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN 'é' WHEN 2 THEN 'é' ELSE 'x = 1' END AS text",
        "CASE p_size % 7 WHEN 0 THEN 'http://a.example/x' WHEN 1 THEN 'a.example' WHEN 2 THEN 'https://a b.example' WHEN 3 THEN 'https://a.example/x)' WHEN 4 THEN 'https://a.example/x(1)' ELSE 'https://a' END AS url", "CASE p_size % 6 WHEN 0 THEN '(b)' WHEN 1 THEN 'A.' ELSE p_name END AS caption")),
    "abstracted": ("part", ("p_partkey AS paper_id", "CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN p_name WHEN 2 THEN 'words that stand nowhere' ELSE p_name || p_name END AS abstract", "CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'not in the text' END AS statement")),
    "paper_text": ("lineitem", ("l_partkey AS paper_id", "l_orderkey * 10 + l_linenumber AS text_id", "CASE WHEN l_linenumber = 1 THEN 'one two three four five six' WHEN l_linenumber = 7 THEN 'refs' ELSE 'and more, much more of it' END AS text", "CASE WHEN l_linenumber = 7 THEN 'references' WHEN l_linenumber = 2 THEN NULL ELSE 'body' END AS section_type")),
}


def made(spark, sf_dir: str, name: str):
    table, exprs = TABLES[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*exprs)


def sql(*names: str) -> str:
    """The named tables as members of a WITH list."""
    return ", ".join(f"{n} AS (SELECT {', '.join(TABLES[n][1])} FROM {TABLES[n][0]})" for n in names)
