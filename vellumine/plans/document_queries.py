"""Queries over citations, sections, readings, metrics and web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import citations, metrics, sections, sentences
from .fixtures import made, sql
from .kernel_queries import SENTENCES


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numeric_citations(spark, sf_dir):
    """Bracketed numbers expanded and linked."""
    m = made(spark, sf_dir, "marked")
    return citations.link_numeric(citations.numeric_mentions(m), m.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_refs")))


def author_year(spark, sf_dir):
    return citations.link_author_year(made(spark, sf_dir, "cited"), made(spark, sf_dir, "listed"))


def float_links(spark, sf_dir):
    return citations.link_floats(made(spark, sf_dir, "mention"), made(spark, sf_dir, "float"))


def sentence_pages(spark, sf_dir):
    """As-of join."""
    return citations.as_of_page(made(spark, sf_dir, "sentence_start"), made(spark, sf_dir, "page_start"))


def section_types(spark, sf_dir):
    return sections.type_sections(made(spark, sf_dir, "section"))


def section_scopes(spark, sf_dir):
    return sections.study_scopes(made(spark, sf_dir, "section"))


def section_unique(spark, sf_dir):
    return sections.unique_types(made(spark, sf_dir, "section"))


def section_parents(spark, sf_dir):
    """The heading stack as windows."""
    return sentences.heading_parents(made(spark, sf_dir, "section"), "paper_id", "section_id", "level").select("paper_id", "section_id", "parent_id")


def running_headers(spark, sf_dir):
    """Whole turns, masked, that recur on two or more turns; ``running_lines`` has A14's further rules."""
    c = _read(spark, sf_dir, "conversations").select((F.col("conv_id") % 10).alias("paper_id"), F.col("turn").alias("page"), "text")
    return sections.running_headers(c)


def running_lines(spark, sf_dir):
    """A14 over conversations: whole lines that recur on two or more turns."""
    c = _read(spark, sf_dir, "conversations").select((F.col("conv_id") % 10).alias("paper_id"), F.col("turn").alias("page"), F.explode(F.split("text", "\n")).alias("text"))
    return sections.furniture(c)


def conversation_text(spark, sf_dir):
    """Ordered join of a group's texts."""
    c = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("paper_id"), F.col("role").alias("section_id"), F.col("turn").alias("text_id"), "text")
    return sections.section_text(c).withColumn("text", F.md5("text"))


def char_lines(spark, sf_dir):
    return sections.group_lines(made(spark, sf_dir, "char")).groupBy("page_id", "line").agg(F.count(F.lit(1)).alias("n"))


def reading_consensus(spark, sf_dir):
    return metrics.consensus(made(spark, sf_dir, "reading"))


def passage_scores(spark, sf_dir):
    """Each benchmark passage against the document of the same number."""
    return metrics.token_scores(_passages(spark, sf_dir))


def passage_shingles(spark, sf_dir):
    return metrics.shingle_recall(_passages(spark, sf_dir))


def passage_containment(spark, sf_dir):
    """A17 over all documents: which of them hold half or more of a benchmark passage's shingles."""
    return metrics.containment(_read(spark, sf_dir, "benchmark"), _read(spark, sf_dir, "documents"))


def _passages(spark, sf_dir):
    b, d = _read(spark, sf_dir, "benchmark"), _read(spark, sf_dir, "documents")
    return b.join(d, b["item_id"] == d["doc_id"]).select(F.col("item_id").alias("id"), b["text"].alias("gold"), d["text"].alias("pred"))


def label_pass_rates(spark, sf_dir):
    """Floors over labels by source."""
    rows = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id", "left").select("source", F.col("quality").cast("double").alias("quality"), (1 - F.col("toxic")).cast("double").alias("clean"))
    return metrics.pass_rate(rows, {"quality": 0.5, "clean": 0.5}, "source").join(metrics.by_type(rows, "source", "quality", "clean"), "source")


def name_f1(spark, sf_dir):
    """Multiset F1 of part names between two halves."""
    p = _read(spark, sf_dir, "part")
    return metrics.list_f1(p.select((F.col("p_partkey") % 40).alias("id"), F.when(F.col("p_partkey") % 3 == 0, "gold").otherwise("pred").alias("side"), F.col("p_name").alias("item")))


def export_diff(spark, sf_dir):
    """Two states of the orders table."""
    a = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").where("o_orderkey % 11 <> 0")
    b = _read(spark, sf_dir, "orders").where("o_orderkey % 13 <> 0").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus", "CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 0.00001 WHEN o_orderkey % 17 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice")
    return metrics.diff(a, b, "o_orderkey", "o_orderstatus", "o_totalprice").select("o_orderkey", "path", "kind")


def duplicate_sentences(spark, sf_dir):
    """Recurring lines of a document, by equal hashes of the lower-cased line; not J19's fuzzy match."""
    s = sentences.emit(_read(spark, sf_dir, "documents"))
    return s.groupBy("doc_id", F.md5(F.lower("text")).alias("line")).agg(F.count(F.lit(1)).alias("n"), F.min("text_id").alias("first_id")).where("n > 1")


QUERIES = {
    f.__name__: f
    for f in (
        numeric_citations, author_year, float_links, sentence_pages, section_types, section_scopes, section_unique, section_parents, running_headers, running_lines, conversation_text, char_lines, reading_consensus,
        passage_scores, passage_shingles, passage_containment, label_pass_rates, name_f1, export_diff, duplicate_sentences,
    )
}

_TOK = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
_PASSAGES = f"p AS (SELECT item_id AS id, {_TOK.format('b.text')} AS g, {_TOK.format('d.text')} AS p FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)"
_GRAMS = "list_distinct(list_transform(range(1, greatest(len({0}) - 4, 1) + 1), lambda i: array_to_string({0}[i:i + 4], ' ')))"
_H = r"regexp_replace(regexp_replace(lower(header), '[0-9.]+', '', 'g'), '^\s+|\s+$', '', 'g')"

ORACLES = {
    "numeric_citations": f"""
        WITH {sql('marked')}, a AS (SELECT doc_id, text_id, unnest(regexp_extract_all(text, '{citations.NUMERIC}', 1)) AS inside, generate_subscripts(regexp_extract_all(text, '{citations.NUMERIC}', 1), 1) - 1 AS marker FROM marked),
        b AS (SELECT doc_id, text_id, marker, list_transform(regexp_split_to_array(unnest(regexp_split_to_array(inside, '\\s*[,;]\\s*')), '\\s*[-–]\\s*'), lambda x: x::INT) AS p FROM a),
        c AS (SELECT DISTINCT doc_id, text_id, marker, unnest(generate_series(list_min(p), list_max(p))) AS number FROM b),
        n AS (SELECT doc_id, count(*) AS n_refs FROM marked GROUP BY 1), g AS (SELECT *, min(number) OVER w AS lo, max(number) OVER w AS hi, count(*) OVER w AS k FROM c WINDOW w AS (PARTITION BY doc_id, text_id, marker)),
        r AS (SELECT g.*, lo < 1 OR hi > n_refs OR (k = 2 AND hi - lo >= 15) AS bad FROM g JOIN n USING (doc_id))
        SELECT doc_id, text_id, marker, number, CASE WHEN NOT bad THEN number END AS target_id, CASE WHEN bad THEN 'numeric_interval_guard' END AS reason FROM r""",
    "author_year": f"""
        WITH {sql('cited', 'listed')}, p AS (SELECT c.paper_id, cite_id, bib_id, len(list_intersect(list_distinct(c.families), r.families)) AS hits, len(r.families) AS n FROM cited c JOIN listed r ON r.paper_id = c.paper_id AND r.year = c.year AND lower(r.families[1]) = lower(c.families[1])),
        q AS (SELECT *, rank() OVER (PARTITION BY paper_id, cite_id ORDER BY hits DESC, n) AS k FROM p), t AS (SELECT *, count(*) OVER (PARTITION BY paper_id, cite_id) AS ties FROM q WHERE k = 1)
        SELECT paper_id, cite_id, bib_id, CASE WHEN ties = 1 THEN 0.95 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN ties > 1 THEN 'ambiguous_same_surname_year' END AS reason FROM t""",
    "float_links": f"""
        WITH {sql('float', 'mention')}, r AS (SELECT *, count(label) OVER (PARTITION BY paper_id, kind) > 0 AS l, row_number() OVER (PARTITION BY paper_id, kind ORDER BY page, float_id) AS k FROM float),
        m AS (SELECT m.*, (SELECT min(float_id) FROM r WHERE l AND r.paper_id = m.paper_id AND r.kind = m.kind AND lower(r.label) = lower(m.label)) AS a,
            (SELECT min(float_id) FROM r WHERE l AND r.paper_id = m.paper_id AND r.kind = m.kind AND lower(r.label) = regexp_replace(lower(m.label), '[a-z]$', '')) AS b,
            (SELECT min(float_id) FROM r WHERE NOT l AND r.paper_id = m.paper_id AND r.kind = m.kind AND k::VARCHAR = lower(m.label)) AS c FROM mention m)
        SELECT paper_id, mention_id, coalesce(a, b, c) AS target_id, CASE WHEN coalesce(a, b) IS NOT NULL THEN 'label' WHEN c IS NOT NULL THEN 'position' END AS tier FROM m""",
    "sentence_pages": f"WITH {sql('sentence_start', 'page_start')} SELECT s.paper_id, text_id, page FROM sentence_start s ASOF LEFT JOIN page_start p ON p.paper_id = s.paper_id AND s.start >= p.start",
    "section_types": f"""
        WITH {sql('section')}, k AS (SELECT paper_id, section_id, CASE WHEN regexp_matches({_H}, '^\\S(\\s+\\S)+$') THEN regexp_replace({_H}, '\\s+', '', 'g') ELSE {_H} END AS h FROM section),
        al(alias, type) AS (VALUES {', '.join(str(a) for a in sections.ALIASES)}),
        b AS (SELECT paper_id, section_id, h, arg_max(alias, (len(alias), alias)) AS alias, arg_max(type, (len(alias), alias)) AS type FROM k LEFT JOIN al ON contains(' ' || regexp_replace(h, '[^a-z]+', ' ', 'g') || ' ', ' ' || alias || ' ') GROUP BY ALL)
        SELECT paper_id, section_id, coalesce(type, 'unknown') AS section_type, CASE WHEN h = alias THEN 1.0 WHEN alias IS NOT NULL THEN 0.95 ELSE 0.0 END::DOUBLE AS score, coalesce(h = alias OR len(alias) / len(h) >= 0.6, false) AS trusted FROM b""",
    "section_scopes": f"""
        WITH {sql('section')}, m AS (SELECT *, CASE WHEN regexp_matches(lower(header), '^(?:study|experiment)\\s+\\d+') THEN regexp_extract(lower(header), '^(?:study|experiment)\\s+(\\d+)', 1)::INT WHEN contains(lower(header), 'general discussion') THEN 0 END AS mark FROM section)
        SELECT paper_id, section_id, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY section_id), 0)::BIGINT AS scope FROM m""",
    "section_unique": f"WITH {sql('section')}, r AS (SELECT *, row_number() OVER (PARTITION BY paper_id, section_type ORDER BY trust DESC, section_id) AS k FROM section) SELECT paper_id, section_id, CASE WHEN section_type IN ('abstract', 'references') AND k > 1 THEN 'unknown' ELSE section_type END AS section_type FROM r",
    "section_parents": f"WITH {sql('section')} SELECT a.paper_id, a.section_id, max(b.section_id) AS parent_id FROM section a LEFT JOIN section b ON b.paper_id = a.paper_id AND b.section_id < a.section_id AND b.level < a.level GROUP BY ALL",
    "running_headers": "SELECT conv_id % 10 AS paper_id, regexp_replace(lower(trim(text)), '[0-9]+', '#', 'g') AS mask, count(DISTINCT turn) AS n_pages FROM conversations GROUP BY ALL HAVING count(DISTINCT turn) >= 2",
    "running_lines": r"""
        WITH l AS (SELECT conv_id % 10 AS paper_id, turn, unnest(string_split(text, chr(10))) AS t FROM conversations),
        k AS (SELECT paper_id, turn, t, regexp_replace(trim(regexp_replace(lower(t), '[\s\p{Z}]+', ' ', 'g')), '\p{Nd}+', '#', 'g') AS mask FROM l)
        SELECT paper_id, mask, count(DISTINCT turn) AS n_pages FROM k
        WHERE NOT regexp_matches(t, '(?i)10\.\d{4,9}/|https?://|www\.|\bdoi\s*:|\barxiv\b|\bisbn\b') AND len(regexp_replace(mask, '\P{L}+', '', 'g')) >= 6
        GROUP BY ALL HAVING count(DISTINCT turn) >= 2""",
    "conversation_text": "SELECT conv_id AS paper_id, role AS section_id, md5(string_agg(text, ' ' ORDER BY turn)) AS text FROM conversations GROUP BY ALL",
    "char_lines": f"WITH {sql('char')}, j AS (SELECT *, coalesce(y - lag(y) OVER w > 0.5 * height, false)::INT AS jump FROM char WINDOW w AS (PARTITION BY page_id ORDER BY y, x, char_id)), l AS (SELECT page_id, sum(jump) OVER (PARTITION BY page_id ORDER BY y, x, char_id ROWS UNBOUNDED PRECEDING)::BIGINT AS line FROM j) SELECT page_id, line, count(*) AS n FROM l GROUP BY ALL",
    "reading_consensus": f"""
        WITH {sql('reading')}, s AS (SELECT paper_id, region_id, round(1 - (1 - levenshtein(first, second) / greatest(len(first), len(second))), 6) AS score FROM reading),
        r AS (SELECT *, count(*) OVER (PARTITION BY paper_id) AS n, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, region_id) AS k FROM s)
        SELECT paper_id, region_id, score, score >= 0.15 AS flagged, score >= 0.15 AND k <= greatest(1, ceil(0.07 * n)) AS escalated FROM r""",
    "passage_scores": f"""
        WITH {_PASSAGES}, g AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest(g) AS t FROM p) GROUP BY ALL), q AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest(p) AS t FROM p) GROUP BY ALL)
        SELECT id, round(sum(least(coalesce(g.n, 0), coalesce(q.n, 0))) / sum(g.n), 6) AS recall, round(sum(least(coalesce(g.n, 0), coalesce(q.n, 0))) / sum(q.n), 6) AS precision FROM g FULL JOIN q USING (id, t) GROUP BY id""",
    "passage_shingles": f"WITH {_PASSAGES} SELECT id, CASE WHEN len(g) >= 5 THEN round(len(list_intersect({_GRAMS.format('g')}, {_GRAMS.format('p')})) / len({_GRAMS.format('g')}), 6) END AS shingle_recall FROM p",
    "passage_containment": f"""
        WITH b AS (SELECT item_id, {_TOK.format("coalesce(text, '')")} AS t FROM benchmark), d AS (SELECT doc_id, {_TOK.format("coalesce(text, '')")} AS t FROM documents),
        g AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' '))) AS s FROM b WHERE len(t) >= 5), h AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' '))) AS s FROM d WHERE len(t) >= 5),
        n AS (SELECT item_id, count(*) AS n FROM g GROUP BY 1) SELECT item_id, doc_id, round(count(*) / any_value(n), 6) AS share FROM g JOIN h USING (s) JOIN n USING (item_id) GROUP BY 1, 2 HAVING round(count(*) / any_value(n), 6) >= 0.5""",
    "label_pass_rates": """
        SELECT source, round(avg((coalesce(quality >= 0.5, true) AND coalesce(1 - toxic >= 0.5, true))::INT), 6) AS pass_rate, count(*) AS n, round(avg(quality), 6) AS quality_mean, round(median(quality), 6) AS quality_median, count(quality) AS quality_n,
            round(avg(1 - toxic), 6) AS clean_mean, round(median(1 - toxic), 6) AS clean_median, count(toxic) AS clean_n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
    "name_f1": """
        WITH c AS (SELECT p_partkey % 40 AS id, lower(p_name) AS item, count(*) FILTER (p_partkey % 3 = 0) AS g, count(*) FILTER (p_partkey % 3 <> 0) AS p FROM part GROUP BY ALL)
        SELECT id, CASE WHEN sum(g) > 0 THEN round(2 * sum(least(g, p)) / (sum(g) + sum(p)), 6) END AS f1 FROM c GROUP BY 1""",
    "export_diff": """
        WITH a AS (SELECT o_orderkey, o_orderstatus AS s, o_totalprice AS t FROM orders WHERE o_orderkey % 11 <> 0),
        b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 0.00001 WHEN o_orderkey % 17 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS t FROM orders WHERE o_orderkey % 13 <> 0)
        SELECT o_orderkey, 'o_orderstatus' AS path, 'value' AS kind FROM a JOIN b USING (o_orderkey) WHERE a.s <> b.s UNION ALL SELECT o_orderkey, 'o_totalprice', 'value' FROM a JOIN b USING (o_orderkey) WHERE abs(a.t - b.t) > 1e-4
        UNION ALL SELECT o_orderkey, '', 'only_a' FROM a ANTI JOIN b USING (o_orderkey) UNION ALL SELECT o_orderkey, '', 'only_b' FROM b ANTI JOIN a USING (o_orderkey)""",
    "duplicate_sentences": f"WITH {SENTENCES} SELECT doc_id, md5(lower(text)) AS line, count(*) AS n, min(text_id) AS first_id FROM sentence GROUP BY ALL HAVING count(*) > 1",
}
