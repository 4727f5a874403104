"""Queries of the whole-text operators; made sentences are set behind every document's own text, so that both are read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import unicode
from ..operators import fulltext, sentences
from .printed import NAME_STYLES, STYLES, base, pick, styled


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark, sf_dir, table, query):
    """A query of printed.py over one table, which it names as ``{t}``."""
    name = f"vellumine_{table}"
    _read(spark, sf_dir, table).createOrReplaceTempView(name)
    return spark.sql(query.replace("{t}", name))


PRINTED = f"SELECT k, {styled(STYLES)} AS raw FROM {base('{t}', 'o_orderkey')} AS r"
NAMES = f"SELECT k, {styled(NAME_STYLES)} AS printed FROM {base('{t}', 'c_custkey')} AS r"
LISTS = f"SELECT paper_id, k, {styled(STYLES[:2])} AS raw FROM {base('{t}', 'o_orderkey', ', o_custkey % 500 AS paper_id')} AS r"


def parsed_references(spark, sf_dir):
    """Printed references of six styles read into fields."""
    r = _sql(spark, sf_dir, "orders", PRINTED).withColumn("p", fulltext.parse_reference("raw"))
    who = F.array_join(F.transform("p.authors", lambda a: a["family"]), ";")
    return r.select("k", who.alias("families"), F.col("p.year").cast("long").alias("year"), "p.title", "p.container", "p.volume", "p.issue", "p.first_page", "p.last_page", "p.bib_type")


def name_lists(spark, sf_dir):
    """Printed author lists of seven styles taken apart."""
    n = _sql(spark, sf_dir, "customer", NAMES).withColumn("n", fulltext.split_names("printed"))
    return n.select("k", F.array_join(F.transform("n", lambda a: F.concat_ws("|", a["family"], a["given"])), ";").alias("names"), F.array_join(fulltext.families("printed"), ";").alias("families"))


def _lists(spark, sf_dir):
    rows = _sql(spark, sf_dir, "orders", LISTS).groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("k", "raw"))).alias("r"))
    # Every second list is numbered; lines are wrapped behind the title.
    entry = lambda x, i: F.concat(F.when(F.col("paper_id") % 2 == 0, F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "))).otherwise(""), F.regexp_replace(x["raw"], " life of ", " life\nof "))
    return rows.select("paper_id", F.array_join(F.transform("r", entry), "\n").alias("text"))


def reference_entries(spark, sf_dir):
    """Entries of whole lists, numbered or not."""
    return fulltext.reference_entries(_lists(spark, sf_dir)).select("paper_id", "n", "strategy", F.md5("text").alias("text_md5"))


def reference_list_quality(spark, sf_dir):
    """A15, A16."""
    return fulltext.list_quality(fulltext.reference_entries(_lists(spark, sf_dir)))


def _with_made(spark, sf_dir, made):
    """doc_id and whole text with a made sentence on a last line of its own."""
    return _read(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.expr(made)).alias("text"))


LINKS = "'See (https://osf.example.org/a(' || doc_id || ')). and http://a.example/' || doc_id || 'http://b.example/x, osf.io/k' || doc_id || ' or 10.5555/m.' || doc_id || '. End www.'"
CITED = f"'Then ' || {pick('doc_id', ['Alder and Birch', 'Alder, Birch and Cedar', 'van Dorn'])} || ' (' || (1990 + doc_id % 30) || 'a) said [' || (1 + doc_id % 9) || ', ' || (11 + doc_id % 5) || '–' || (13 + doc_id % 5) || '] that it grows.^{{' || (2 + doc_id % 7) || '}} Others differ (see Fenn et al., 2004; Grove & Hazel, 2005b).'".replace("{{", "{").replace("}}", "}")
MENTIONED = "'See Figs. ' || (1 + doc_id % 5) || 'a and ' || (7 + doc_id % 3) || '–' || (9 + doc_id % 3) || ', Table S' || (1 + doc_id % 4) || ', Eq. (' || (1 + doc_id % 8) || ') and Section ' || (1 + doc_id % 6) || '.2.'"
MEASURED = "'It held, t(' || (10 + doc_id % 50) || ') = −' || (1 + doc_id % 4) || '.5, p < .0' || (1 + doc_id % 5) || ', d = 0,' || (10 + doc_id % 80) || ', 95% CI [.1, .' || (2 + doc_id % 7) || '] and N = 1,' || (100 + doc_id % 900) || '.'"
STATED = f"'This work was supported by the ' || {pick('doc_id', ['Tide Trust', 'Moss Foundation', 'Kelp Research Council'])} || ' (grant no. AB-' || (1000 + doc_id) || '). The authors declare no competing interests. The data are openly available at site ' || doc_id || '.'"


def document_links(spark, sf_dir):
    """Addresses and DOIs of whole texts."""
    d = _with_made(spark, sf_dir, LINKS)
    return fulltext.exploded(d, "doc_id", fulltext.find_links("text")).select("doc_id", "n", "url", "kind")


def citation_markers(spark, sf_dir):
    """T5: candidates of all styles in whole texts."""
    found = fulltext.exploded(_with_made(spark, sf_dir, CITED), "doc_id", fulltext.citations("text"))
    return found.select("doc_id", "style", F.array_join(F.transform("numbers", lambda x: x.cast("string")), ",").alias("numbers"), F.array_join("families", ";").alias("families"), F.col("year").cast("long").alias("year"), "suffix", "reason")


def superscripts_stripped(spark, sf_dir):
    """Text without citation superscripts, and where they stood."""
    s = _with_made(spark, sf_dir, CITED).select("doc_id", fulltext.strip_superscripts("text").alias("s"))
    return s.select("doc_id", F.md5("s.text").alias("text_md5"), F.size("s.anchors").cast("long").alias("n"), F.col("s.anchors")[0]["at"].cast("long").alias("at"))


def citation_verdicts(spark, sf_dir):
    """T5 over a paper's list: documents of one source are a paper whose list has ten entries."""
    d = _with_made(spark, sf_dir, CITED)
    found = fulltext.exploded(d, "doc_id", fulltext.citations("text")).where("size(numbers) > 0").select((F.col("doc_id") % 50).alias("paper_id"), F.col("doc_id").alias("text_id"), "n", "style", "numbers", "reason")
    sizes = found.select("paper_id").distinct().withColumn("n_refs", F.lit(13))
    return fulltext.accepted_citations(found, sizes).select("paper_id", "text_id", "style", "reason")


def float_mentions(spark, sf_dir):
    """Mentions of figures, tables, equations and sections in whole texts."""
    return fulltext.exploded(_with_made(spark, sf_dir, MENTIONED), "doc_id", fulltext.mentions("text")).select("doc_id", "n", "kind", "label")


def printed_statistics(spark, sf_dir):
    """Statistics of whole texts, line by line."""
    lines = _with_made(spark, sf_dir, MEASURED).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    rows = lines.where(F.col("text").rlike(r"[$=<>~≤≥≈≠\[(]")).select("doc_id", "line", F.posexplode(fulltext.statistics_in("text")).alias("n", "s"))
    return rows.select("doc_id", F.col("line").cast("long").alias("line"), F.col("n").cast("long").alias("n"), "s.name", "s.df", "s.comparator", "s.value", "s.low", "s.high", F.col("s.group").cast("long").alias("grp"))


def integrity_statements(spark, sf_dir):
    """Statements of whole documents, sentence by sentence."""
    rows = _with_made(spark, sf_dir, STATED).select("doc_id", sentences.sentence_array(F.col("text")).alias("s"))
    typed = F.transform("s", lambda x: F.struct(x["text"].alias("text"), F.lit(1).cast("long").alias("section"), x["paragraph_id"].alias("paragraph"), F.lit(None).cast("string").alias("section_type")))
    return fulltext.exploded(rows, "doc_id", fulltext.scan_statements(typed)).select("doc_id", "field", "text", "rule")


def funding_awards(spark, sf_dir):
    """Funders and awards of the made statements."""
    return fulltext.exploded(_read(spark, sf_dir, "documents").select("doc_id", F.expr(STATED).alias("text")), "doc_id", fulltext.funding("text")).select("doc_id", "n", "funder", "award")


AFFILIATED = f"{pick('c_custkey', ['Department of Botany, University of Kelp', 'Faculty of Law, Moss University', 'Tide Institute for Reading (TIR, East)', 'Fern College'])} || ', ' || {pick('c_custkey * 3', ['Tideham', '10115 Bonn', 'Port Reed', 'Oslo'])} || {pick('c_custkey * 5', [', Germany', ', The Netherlands', '', ', United Kingdom', ', USA'])}"


def affiliation_parts(spark, sf_dir):
    """Printed affiliations taken apart."""
    c = _read(spark, sf_dir, "customer").select("c_custkey", fulltext.affiliation(F.expr(AFFILIATED)).alias("a"))
    return c.select("c_custkey", "a.department", "a.institution", "a.city", "a.country")


CONTACT = f"'By {{g1}} {{f1}} and {{g2}} {{f2}}'"


def author_contacts(spark, sf_dir):
    """Addresses of a front page given to its authors."""
    front = f"SELECT k, g1 || ' ' || f1 AS a1, g2 || ' ' || f2 AS a2, g1 || ' ' || f1 || ' 0000-0002-1825-0' || (100 + k % 900) || ', ' || g2 || ' ' || f2 || '. Correspondence: ' || lower(g2) || '.x@site.example, office' || k || '@site.example' AS text FROM {base('{t}', 'c_custkey')} AS r WHERE f1 <> f2 AND g1 <> g2"
    c = _sql(spark, sf_dir, "customer", front)
    return fulltext.exploded(c, "k", fulltext.contacts("text", F.array("a1", "a2"))).select("k", "n", "author", "email", "orcid", "corresponding")


def unicode_forms(spark, sf_dir):
    """P6, P32, 2.9: normal form, folding and squashed keys of whole texts."""
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(unicode.nfc("text")).alias("nfc"), F.md5(unicode.squash("text")).alias("squashed"), F.md5(unicode.casefold("text")).alias("casefold"))


def cleaned_text(spark, sf_dir):
    """The repairs and both phases of cleaning over whole texts."""
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(unicode.repair("text")).alias("repaired"), F.md5(unicode.clean_early("text")).alias("early"), F.md5(unicode.clean_late("text")).alias("late"), F.md5(unicode.unwrap_latex("text")).alias("unwrapped"))


QUERIES = {
    f.__name__: f
    for f in (
        parsed_references, name_lists, reference_entries, reference_list_quality, document_links, citation_markers, superscripts_stripped, citation_verdicts, float_mentions, printed_statistics, integrity_statements, funding_awards,
        affiliation_parts, author_contacts, unicode_forms, cleaned_text,
    )
}


def _of(query: str, table: str) -> str:
    return query.replace("{t}", table)


_LISTED = f"l AS (SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY k) AS n, raw FROM ({_of(LISTS, 'orders')})), e AS (SELECT paper_id, n, CASE WHEN paper_id % 2 = 0 AND count(*) OVER (PARTITION BY paper_id) > 1 THEN '[' || n || '] ' ELSE CASE WHEN paper_id % 2 = 0 THEN '[1] ' ELSE '' END END || raw AS text, CASE WHEN paper_id % 2 = 0 AND count(*) OVER (PARTITION BY paper_id) > 1 THEN 'numbered' ELSE 'votes' END AS strategy FROM l)"
_DOC = "SELECT doc_id, {n} AS n, {columns} FROM documents"

ORACLES = {
    "parsed_references": f"SELECT k, f1 || ';' || f2 AS families, year, title, journal AS container, volume::VARCHAR AS volume, issue::VARCHAR AS issue, first::VARCHAR AS first_page, last::VARCHAR AS last_page, 'journal-article' AS bib_type FROM {base('orders', 'o_orderkey')}",
    "name_lists": f"""
        SELECT k, CASE k % 7 WHEN 0 THEN f1 || '|' || i1 || '.;' || f2 || '|' || i2 || '.' WHEN 1 THEN f1 || '|' || i1 || ';' || f2 || '|' || i2 WHEN 2 THEN f1 || '|' || g1 || ';' || f2 || '|' || g2 WHEN 3 THEN f1 || '|' || g1 || ';van ' || f2 || '|' || g2
            WHEN 4 THEN f1 || '|' || i1 || '.;' || f2 || '|' || i2 || '.' WHEN 5 THEN f1 || '|' || g1 || ' ' || i2 || '.;' || f2 || '|' || g2 ELSE f1 || '|' || i1 || '.;' || f2 || '|' || i2 || '.' END AS names,
            f1 || ';' || CASE WHEN k % 7 = 3 THEN 'van ' ELSE '' END || f2 AS families FROM {base('customer', 'c_custkey')}""",
    "reference_entries": f"WITH {_LISTED} SELECT paper_id, n, strategy, md5(text) AS text_md5 FROM e",
    "reference_list_quality": f"WITH {_LISTED} SELECT paper_id, count(*) AS n_entries, median(len(text)) AS typical_length, 1.0::DOUBLE AS quality FROM e GROUP BY 1",
    "document_links": f"""
        SELECT doc_id, n, url, kind FROM (SELECT doc_id, unnest(range(1, 6)) AS n, unnest(['https://osf.example.org/a(' || doc_id || ')', 'http://a.example/' || doc_id, 'http://b.example/x', 'osf.io/k' || doc_id, 'https://doi.org/10.5555/m.' || doc_id]) AS url,
            unnest(['scheme', 'scheme', 'scheme', 'host', 'doi']) AS kind FROM documents)""",
    "citation_markers": r"""
        WITH m AS (SELECT doc_id, unnest(['narrative', 'bracket', 'superscript', 'author_year', 'author_year']) AS style,
            unnest(['', (1 + doc_id % 9) || ',' || array_to_string(range(11 + doc_id % 5, 14 + doc_id % 5), ','), (2 + doc_id % 7)::VARCHAR, '', '']) AS numbers,
            unnest([CASE doc_id % 3 WHEN 0 THEN 'Alder;Birch' WHEN 1 THEN 'Alder;Birch;Cedar' ELSE 'van Dorn' END, '', '', 'Fenn;et al.', 'Grove;Hazel']) AS families,
            unnest([1990 + doc_id % 30, NULL, NULL, 2004, 2005]) AS year, unnest(['a', NULL, NULL, NULL, 'b']) AS suffix, NULL::VARCHAR AS reason FROM documents),
        own AS (SELECT doc_id, unnest(regexp_extract_all(text, '.?\(\d{1,3}\)')) AS found FROM documents)
        SELECT * FROM m UNION ALL SELECT doc_id, 'round', regexp_extract(found, '\d+')::INT::VARCHAR, '', NULL, NULL, CASE WHEN regexp_matches(found, '^[\w)]') THEN 'non_citation_bracket' END FROM own""".replace("\\\\", "\\"),
    "superscripts_stripped": f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') || chr(10) || {CITED} AS t FROM documents)
        SELECT doc_id, md5(regexp_replace(t, '\\^\\{{\\d+\\}} Others', ' Others')) AS text_md5, 1 AS n, position('.^{{' IN t) AS at FROM t""",
    "citation_verdicts": r"""
        WITH m AS (SELECT doc_id % 50 AS paper_id, doc_id AS text_id, unnest(['bracket', 'superscript']) AS style, unnest([greatest(13 + doc_id % 5, 1 + doc_id % 9), 2 + doc_id % 7]) AS high, NULL::VARCHAR AS given FROM documents
            UNION ALL SELECT doc_id % 50, doc_id, 'round', regexp_extract(found, '\d+')::INT, CASE WHEN regexp_matches(found, '^[\w)]') THEN 'non_citation_bracket' END FROM (SELECT doc_id, unnest(regexp_extract_all(text, '.?\(\d{1,3}\)')) AS found FROM documents)),
        j AS (SELECT *, coalesce(given, CASE WHEN high > 13 OR high < 1 THEN CASE WHEN style = 'superscript' THEN 'math_superscript' ELSE 'unknown_bib_id' END END) AS one FROM m),
        r AS (SELECT *, (SELECT count(DISTINCT text_id) FROM j i WHERE i.paper_id = j.paper_id AND i.style = j.style AND i.one IS NULL) >= 3 AS recurs FROM j)
        SELECT paper_id, text_id, style, CASE WHEN one IS NOT NULL THEN one WHEN style = 'round' AND NOT recurs THEN 'style_does_not_recur' END AS reason FROM r""".replace("\\\\", "\\"),
    "float_mentions": """
        SELECT doc_id, unnest(range(1, 8)) AS n, unnest(['figure', 'figure', 'figure', 'figure', 'table', 'equation', 'section']) AS kind,
            unnest([(1 + doc_id % 5) || 'a', (7 + doc_id % 3)::VARCHAR, (8 + doc_id % 3)::VARCHAR, (9 + doc_id % 3)::VARCHAR, 'S' || (1 + doc_id % 4), (1 + doc_id % 8)::VARCHAR, (1 + doc_id % 6) || '.2']) AS label FROM documents""",
    "printed_statistics": """
        SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, 5)) AS n, unnest(['t', 'p', 'd', '95% CI', 'N']) AS name, unnest([(10 + doc_id % 50)::VARCHAR, NULL, NULL, NULL, NULL]) AS df, unnest(['=', '<', '=', '=', '=']) AS comparator,
            unnest(['-' || (1 + doc_id % 4) || '.5', '0.0' || (1 + doc_id % 5), '0.' || (10 + doc_id % 80), NULL, '1' || (100 + doc_id % 900)]) AS value, unnest([NULL, NULL, NULL, '0.1', NULL]) AS low,
            unnest([NULL, NULL, NULL, '0.' || (2 + doc_id % 7), NULL]) AS high, 0 AS grp FROM documents""",
    "integrity_statements": """
        WITH f AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Tide Trust' WHEN 1 THEN 'Moss Foundation' ELSE 'Kelp Research Council' END AS funder FROM documents)
        SELECT doc_id, 'funding' AS field, 'This work was supported by the ' || funder || ' (grant no.' || ' AB-' || (1000 + doc_id) || ').' AS text, 'anchor' AS rule FROM f
        UNION ALL SELECT doc_id, 'coi', 'The authors declare no competing interests.', 'anchor' FROM f UNION ALL SELECT doc_id, 'data', 'The data are openly available at site ' || doc_id || '.', 'anchor' FROM f""",
    "funding_awards": "SELECT doc_id, 1 AS n, CASE doc_id % 3 WHEN 0 THEN 'Tide Trust' WHEN 1 THEN 'Moss Foundation' ELSE 'Kelp Research Council' END AS funder, 'AB-' || (1000 + doc_id) AS award FROM documents",
    "affiliation_parts": """
        SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Department of Botany' WHEN 1 THEN 'Faculty of Law' END AS department, CASE c_custkey % 4 WHEN 0 THEN 'University of Kelp' WHEN 1 THEN 'Moss University' WHEN 2 THEN 'Tide Institute for Reading (TIR, East)' ELSE 'Fern College' END AS institution,
            CASE c_custkey * 3 % 4 WHEN 0 THEN 'Tideham' WHEN 1 THEN 'Bonn' WHEN 2 THEN 'Port Reed' ELSE 'Oslo' END AS city, CASE c_custkey * 5 % 5 WHEN 0 THEN 'Germany' WHEN 1 THEN 'The Netherlands' WHEN 3 THEN 'United Kingdom' WHEN 4 THEN 'USA' END AS country FROM customer""",
    "author_contacts": f"""
        SELECT k, unnest([1, 2]) AS n, unnest([g1 || ' ' || f1, g2 || ' ' || f2]) AS author, unnest([NULL, lower(g2) || '.x@site.example']) AS email, unnest(['https://orcid.org/0000-0002-1825-0' || (100 + k % 900), NULL]) AS orcid, unnest([false, true]) AS corresponding
        FROM {base('customer', 'c_custkey')} WHERE f1 <> f2 AND g1 <> g2""",
}
