"""Queries over sections, regions, spans, identity and export checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import check, structure, validation
from .fixtures import made, sql
from .printed import base, pick


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def section_numbers(spark, sf_dir):
    return structure.numbered_parents(made(spark, sf_dir, "numbered"))


def section_sanity(spark, sf_dir):
    return structure.sane_sections(made(spark, sf_dir, "numbered"))


def carried_paragraphs(spark, sf_dir):
    """W11 over conversations: a turn is a page."""
    c = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("block_id"), F.col("turn").alias("page"), F.regexp_replace(F.coalesce("text", F.lit("")), "[.!?]$", "").alias("text"))
    return structure.carried_over(c).withColumn("text", F.md5("text"))


def caption_continued(spark, sf_dir):
    return structure.caption_continuations(made(spark, sf_dir, "region"))


def span_places(spark, sf_dir):
    """How often a token came before in its document."""
    words = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), F.posexplode(F.split(F.lower(F.coalesce("text", F.lit(""))), " ")).alias("start", "key"))
    return structure.nth_spans(words).groupBy("text_id").agg(F.max("nth").alias("most"), F.count_if(F.col("nth") == 1).alias("distinct_words"))


def renumbered_rows(spark, sf_dir):
    """Sections renumbered, and their parents with them."""
    n = made(spark, sf_dir, "numbered")
    ids = structure.renumbered(n, "section_id", "section_id")
    return structure.remapped(ids.select("paper_id", "section_id", "new_id", "parent_id"), "parent_id", ids.select("paper_id", F.col("section_id"), "new_id"), "section_id")


def outline_links(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    outline = p.select((F.col("p_partkey") % 30).alias("paper_id"), F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("title"), (F.col("p_partkey") % 9).alias("page"))
    headings = p.select((F.col("p_partkey") % 30).alias("paper_id"), F.col("p_partkey").alias("section_id"), F.concat("p_name", F.lit("s")).alias("header"), ((F.col("p_partkey") + F.col("p_size") % 3) % 9).alias("page"))
    return structure.outline_headings(outline, headings)


def link_characters(spark, sf_dir):
    return structure.covered_counts(made(spark, sf_dir, "rect"), made(spark, sf_dir, "char"))


def spans_left(spark, sf_dir):
    return structure.free_spans(made(spark, sf_dir, "span"))


def figure_panels(spark, sf_dir):
    return structure.merged_panels(made(spark, sf_dir, "region").select("paper_id", "figure_id", (F.col("page") % 3).alias("page"), "label"))


def article_regions(spark, sf_dir):
    return structure.own_regions(made(spark, sf_dir, "region")).select("paper_id", "region_id")


def page_kinds(spark, sf_dir):
    """Classes and how many pages of a paper have them."""
    return structure.page_classes(made(spark, sf_dir, "pagestat")).groupBy("paper_id", "class").agg(F.count(F.lit(1)).alias("n"))


def font_medians(spark, sf_dir):
    return structure.weighted_medians(made(spark, sf_dir, "fontrun"))


def boxes_kept(spark, sf_dir):
    return structure.kept_boxes(made(spark, sf_dir, "box")).select("page_id", "box_id")


def rows_page(spark, sf_dir):
    """2.6c: the third page of orders by price; a page by design."""
    return structure.paged(_read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 50, 100)


def first_seen(spark, sf_dir):
    return structure.ordered_distinct(_read(spark, sf_dir, "events"), "event_type", "event_id")


def merged_candidates(spark, sf_dir):
    """2.7b: candidates of two tiers."""
    li = _read(spark, sf_dir, "lineitem")
    tier = lambda cond, c: li.where(cond).select(F.col("l_orderkey").alias("text_id"), (F.col("l_partkey") % 40).alias("bib_id"), F.lit(c).alias("confidence"))
    return structure.candidate_union(tier("l_linenumber < 3", 0.95), tier("l_linenumber >= 2", 0.5))


def field_decisions(spark, sf_dir):
    return structure.decided(made(spark, sf_dir, "fields"), "paper_id", "title", ("metadata", "front", "first_heading"))


def caption_floats(spark, sf_dir):
    """Captions of made pages assigned to floats; the tests hold the assignment against all assignments."""
    p = _read(spark, sf_dir, "part")
    one = lambda shift, number: p.select((F.col("p_partkey") % 200).alias("paper_id"), F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 == 0, "table").otherwise("figure").alias("kind"), (F.col("p_size") % 6).alias("page"), number.alias("number"), ((F.col("p_partkey") % 5) * 100).cast("double").alias("x0"), ((F.col("p_partkey") % 7) * 110 + shift).cast("double").alias("y0"), ((F.col("p_partkey") % 5) * 100 + 300).cast("double").alias("x1"), ((F.col("p_partkey") % 7) * 110 + shift + 80).cast("double").alias("y1"))
    return structure.captions_to_floats(one(90, F.when(F.col("p_size") % 4 > 0, F.col("p_partkey") % 9)), one(0, F.when(F.col("p_size") % 5 > 0, F.col("p_partkey") % 9)))


def dash_authors(spark, sf_dir):
    return check.carried_authors(made(spark, sf_dir, "dash_bib")).select("bib_id", "authors_read")


def paper_dois(spark, sf_dir):
    return check.own_doi(made(spark, sf_dir, "doi_candidate"))


def organisation_ids(spark, sf_dir):
    """Printed nation names looked up."""
    n = _read(spark, sf_dir, "nation")
    names = _read(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.when(F.col("s_suppkey") % 3 == 0, F.lower("n_name")).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit(" "), "n_name", F.lit("."))).otherwise(F.concat("n_name", F.lit(" land"))).alias("name"))
    return check.organisations(names, n.select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("org_id")))


def gold_predictions(spark, sf_dir):
    return check.evaluated(made(spark, sf_dir, "expected"), made(spark, sf_dir, "gold_paper"), made(spark, sf_dir, "prediction"), ("title_score", "doi_score"))


def footnotes_kept(spark, sf_dir):
    return check.footnote_repeats(made(spark, sf_dir, "note_cite"), made(spark, sf_dir, "listed_cite"))


CHECKED = f"SELECT k, title, f1, f2, year, journal, volume, issue, first, last FROM {base('{t}', 'o_orderkey')} AS r"
#: What is altered in the record of a reference, by its key modulo their number, and the status that follows.
ALTERED = ("nothing", "year by two back", "year by two on", "first author", "title", "volume", "volume and container", "issue", "doi", "no record", "unknown doi", "unchecked")
STATUS = ("matched", "fields_disagree", "matched", "fields_disagree", "fields_disagree", "matched", "fields_disagree", "matched", "fields_disagree", "not_found", "doi_unregistered", "unchecked")


def reference_checks(spark, sf_dir):
    """References held against records that differ from them in known ways."""
    from .text_queries import _sql

    r = _sql(spark, sf_dir, "orders", CHECKED)
    case = F.col("k") % len(ALTERED)
    text = lambda c: F.col(c).cast("string")
    doi = F.concat(F.lit("10.5555/r"), F.col("k"))
    bibs = r.select(F.col("k").alias("bib_id"), "title", F.array("f1", "f2").alias("families"), F.col("year").cast("long").alias("year"), doi.alias("doi"), F.col("journal").alias("container"), *(text(c).alias(n) for c, n in (("volume", "volume"), ("issue", "issue"), ("first", "first_page"), ("last", "last_page"))), F.lit("journal-article").alias("bib_type"), F.lit("").alias("raw"), F.lit(False).alias("et_al"))
    on = lambda n, changed, same: F.when(case == n, changed).otherwise(same)
    has = case < 9
    records = r.where(case < 11).select(
        F.col("k").alias("bib_id"), F.when(has, on(4, F.lit("Quite another work"), F.col("title"))).alias("rec_title"), F.when(has, F.array(on(3, F.lit("Zyx"), F.col("f1")), "f2")).alias("rec_families"),
        F.when(has, F.col("year") + F.when(case == 1, -2).when(case == 2, 2).otherwise(0)).cast("long").alias("rec_year"), F.when(has, on(8, F.lit("10.5555/other"), doi)).alias("rec_doi"), F.when(has, on(6, F.lit("Zeitschrift"), F.col("journal"))).alias("rec_container"),
        F.when(has, F.when(case.isin(5, 6), F.lit("999")).otherwise(text("volume"))).alias("rec_volume"), F.when(has, on(7, F.lit("99"), text("issue"))).alias("rec_issue"), F.when(has, text("first")).alias("rec_first_page"), F.when(has, text("last")).alias("rec_last_page"),
        F.when(case == 10, "doi_404").otherwise("found").alias("outcome"), F.when(case == 10, "none").alias("agency"),
    )
    return check.check(bibs, records).select("bib_id", "status", F.array_join("notes", ",").alias("notes"))


def matched_references(spark, sf_dir):
    """Predicted references matched one to one to gold ones of a paper of up to twenty; every third lacks its DOI, every fifth its title's end."""
    from .text_queries import _sql

    r = _sql(spark, sf_dir, "orders", f"SELECT k, title, f1, year, journal FROM {base('{t}', 'o_orderkey')} AS r").withColumn("title", F.concat("title", F.lit(" number "), "k"))
    side = lambda doi, title: r.select((F.col("k") - F.col("k") % 20).alias("id"), F.col("k").alias("ref"), doi.alias("doi"), title.alias("title"), F.col("f1").alias("family"), F.col("year"), F.concat_ws(" ", "f1", "title").alias("raw"))
    doi = F.concat(F.lit("10.5555/r"), F.col("k"))
    return check.matched_references(side(doi, F.col("title")), side(F.when(F.col("k") % 3 > 0, doi), F.when(F.col("k") % 5 > 0, F.col("title"))))


def export_checks(spark, sf_dir):
    """The checks that look at values, texts and nesting."""
    v, n, p, t = (made(spark, sf_dir, x) for x in ("valued", "numbered", "abstracted", "paper_text"))
    return validation.all_issues(
        validation.placeholders(v, "title", "name"), validation.blank_authors(v), validation.empty_equations(v), validation.malformed_urls(v), validation.generic_titles(v), validation.uncomposed(v), validation.panel_captions(v),
        validation.appendix_nesting(n), validation.abstract_issues(p, t), validation.orphan_statements(p, t), validation.zero_xrefs(made(spark, sf_dir, "bib"), made(spark, sf_dir, "xref")),
    )


def lost_references(spark, sf_dir):
    """Dangling references over all edges of the tables that there are."""
    n = made(spark, sf_dir, "numbered")
    text = n.select("paper_id", F.col("section_id").alias("text_id"), (F.col("section_id") + 80).alias("section_id"))
    x = made(spark, sf_dir, "xref").select("paper_id", (F.col("target_id") * 3).alias("text_id"), "target_id", F.when(F.col("n") % 2 == 0, "bib").otherwise("figure").alias("type"))
    return validation.dangling_everywhere({"section": n, "text": text, "xref": x, "bib": made(spark, sf_dir, "bib"), "figure": made(spark, sf_dir, "figure")})


QUERIES = {
    f.__name__: f
    for f in (
        section_numbers, section_sanity, carried_paragraphs, caption_continued, span_places, renumbered_rows, outline_links, link_characters, spans_left, figure_panels, article_regions, page_kinds, font_medians, boxes_kept, rows_page,
        first_seen, merged_candidates, field_decisions, caption_floats, dash_authors, paper_dois, organisation_ids, gold_predictions, footnotes_kept, reference_checks, matched_references, export_checks, lost_references,
    )
}

_DOI = r"regexp_replace(lower(doi), '^https?://doi\.org/|\.$', '', 'g')"
_LOST = "SELECT x.paper_id FROM {} x WHERE x.{} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {} y WHERE y.paper_id = x.paper_id AND y.{} = x.{})"
_PLAIN = r"regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]', '', 'g')"

ORACLES = {
    "section_numbers": f"""
        WITH {sql('numbered')}, r AS (SELECT paper_id, section_id, nullif(regexp_extract(header, '^\\s*((?:[A-Z]|\\d+)(?:\\.\\d+)*)\\.?(?:\\s|$)', 1), '') AS number FROM numbered), s AS (SELECT paper_id, section_id, CASE WHEN regexp_matches(number, '\\d') THEN number END AS number FROM r)
        SELECT s.paper_id, s.section_id, s.number, (SELECT arg_max(p.section_id, (len(p.number), p.section_id)) FROM s p WHERE p.paper_id = s.paper_id AND p.section_id < s.section_id AND starts_with(s.number, p.number || '.')) AS parent_id FROM s""",
    "section_sanity": f"""
        WITH {sql('numbered')}, w AS (SELECT *, coalesce(sum((section_type IN ('methods', 'results'))::INT) OVER (PARTITION BY paper_id ORDER BY section_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
            coalesce(sum((section_type IN ('introduction', 'methods', 'results', 'discussion'))::INT) OVER (PARTITION BY paper_id ORDER BY section_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS after,
            row_number() OVER (PARTITION BY paper_id ORDER BY section_id) AS place, count(*) OVER (PARTITION BY paper_id) AS size FROM numbered)
        SELECT paper_id, section_id, CASE WHEN (section_type = 'abstract' AND before > 0) OR (section_type = 'references' AND place * 2 <= size AND after > 0) THEN 'unknown' ELSE section_type END AS section_type FROM w""",
    "carried_paragraphs": r"""
        WITH c AS (SELECT conv_id AS paper_id, turn, regexp_replace(coalesce(text, ''), '[.!?]$', '') AS t FROM conversations),
        s AS (SELECT *, coalesce(turn > lag(turn) OVER w AND NOT regexp_matches(rtrim(lag(t) OVER w), '[.!?:;]$') AND regexp_matches(ltrim(t), '^\p{Ll}'), false) AS carried FROM c WINDOW w AS (PARTITION BY paper_id ORDER BY turn)),
        g AS (SELECT *, sum((NOT carried)::INT) OVER (PARTITION BY paper_id ORDER BY turn) AS g FROM s)
        SELECT paper_id, min(turn) AS first_id, count(*) AS n_parts, md5(replace(regexp_replace(string_agg(trim(t), chr(1) ORDER BY turn), '(\p{Ll})-\x01(\p{Ll})', '\1\2', 'g'), chr(1), ' ')) AS text FROM g GROUP BY paper_id, g""",
    "caption_continued": f"""
        WITH {sql('region')}, w AS (SELECT paper_id, region_id, kind, lag(kind) OVER v AS k1, lag(kind, 2) OVER v AS k2, lag(region_id) OVER v AS r1, lag(region_id, 2) OVER v AS r2, NOT regexp_matches(rtrim(lag(text) OVER v), '[.!?]$') AS o1, NOT regexp_matches(rtrim(lag(text, 2) OVER v), '[.!?]$') AS o2
            FROM region WINDOW v AS (PARTITION BY paper_id, page ORDER BY region_id))
        SELECT paper_id, region_id, CASE WHEN k1 = 'caption' AND o1 THEN r1 ELSE r2 END AS caption_id FROM w WHERE kind = 'text' AND ((k1 = 'caption' AND o1) OR (k2 = 'caption' AND k1 = 'text' AND o1 AND o2))""",
    "span_places": "WITH w AS (SELECT doc_id, unnest(string_split(lower(coalesce(text, '')), ' ')) AS k FROM documents) SELECT doc_id AS text_id, max(n) AS most, count(*) AS distinct_words FROM (SELECT doc_id, k, count(*) AS n FROM w GROUP BY ALL) GROUP BY 1",
    "renumbered_rows": f"WITH {sql('numbered')}, n AS (SELECT *, dense_rank() OVER (PARTITION BY paper_id ORDER BY section_id) AS new_id FROM numbered) SELECT a.paper_id, a.section_id, a.new_id, b.new_id AS parent_id FROM n a LEFT JOIN n b ON b.paper_id = a.paper_id AND b.section_id = a.parent_id",
    "outline_links": """
        WITH r AS (SELECT o.p_partkey % 30 AS paper_id, o.p_partkey AS entry_id, h.p_partkey AS section_id, round(1 - levenshtein(lower(trim(o.p_name)), lower(trim(h.p_name || 's'))) / greatest(len(trim(o.p_name)), len(trim(h.p_name)) + 1), 6) AS similarity
            FROM part o JOIN part h ON o.p_partkey % 30 = h.p_partkey % 30 AND abs(o.p_partkey % 9 - (h.p_partkey + h.p_size % 3) % 9) <= 1)
        SELECT paper_id, entry_id, arg_max(section_id, (similarity, -section_id)) AS section_id, max(similarity) AS similarity FROM r WHERE similarity >= 0.8 GROUP BY ALL""",
    "link_characters": f"WITH {sql('rect', 'char')} SELECT link_id, count(*) AS n FROM rect r JOIN char c ON c.page_id = r.page_id AND c.x BETWEEN x0 AND x1 AND c.y BETWEEN y0 AND y1 GROUP BY 1",
    "spans_left": f'WITH {sql("span")} SELECT * FROM span a WHERE NOT EXISTS (SELECT 1 FROM span b WHERE b.key = a.key AND b.priority < a.priority AND b.start < a.stop AND a.start < b.stop)',
    "figure_panels": f"""
        WITH {sql('region')}, g AS (SELECT paper_id, figure_id, coalesce(regexp_extract(label, '^\\d+') || '/' || page % 3, '#' || figure_id) AS g FROM region) SELECT paper_id, figure_id, min(figure_id) OVER (PARTITION BY paper_id, g) AS merged_id FROM g""",
    "article_regions": f"WITH {sql('region')}, t AS (SELECT *, sum((kind = 'title')::INT) OVER (PARTITION BY paper_id ORDER BY region_id) AS n, sum((kind = 'title')::INT) OVER (PARTITION BY paper_id) AS total FROM region) SELECT paper_id, region_id FROM t WHERE n = 1 OR total = 0",
    "page_kinds": f"""
        WITH {sql('pagestat')} SELECT paper_id, CASE WHEN n_chars + n_figures + n_tables = 0 THEN 'blank' WHEN n_entries >= 5 THEN 'references' WHEN n_figures > 0 AND n_chars < 400 THEN 'figure' WHEN n_tables > 0 AND n_chars < 800 THEN 'table' ELSE 'text' END AS class, count(*) AS n FROM pagestat GROUP BY ALL""",
    "font_medians": f"""
        WITH {sql('fontrun')}, e AS (SELECT page_id, size, unnest(range(n)) FROM fontrun), w AS (SELECT page_id, weight, sum(n) AS n FROM fontrun GROUP BY ALL)
        SELECT page_id, size, weight FROM (SELECT page_id, quantile_disc(size, 0.5) AS size FROM e GROUP BY 1) JOIN (SELECT page_id, arg_max(weight, (n, -weight)) AS weight FROM w GROUP BY 1) USING (page_id)""",
    "boxes_kept": f"""
        WITH {sql('box')} SELECT page_id, box_id FROM box a WHERE NOT EXISTS (SELECT 1 FROM box b WHERE b.page_id = a.page_id AND (b.score > a.score OR (b.score = a.score AND b.box_id < a.box_id))
            AND greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) * 1.5 >= 0.5 * ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0)))""",
    "rows_page": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100",
    "first_seen": "SELECT event_type, min(event_id) AS first FROM events GROUP BY 1",
    "merged_candidates": """
        SELECT text_id, bib_id, CASE WHEN min(tier) = 0 THEN 0.95 ELSE 0.5 END::DOUBLE AS confidence, min(tier) AS tier FROM (SELECT l_orderkey AS text_id, l_partkey % 40 AS bib_id, 0::BIGINT AS tier FROM lineitem WHERE l_linenumber < 3
            UNION ALL SELECT l_orderkey, l_partkey % 40, 1 FROM lineitem WHERE l_linenumber >= 2) GROUP BY ALL""",
    "field_decisions": f"""
        WITH {sql('fields')}, f AS (SELECT paper_id, CASE WHEN trim(metadata) <> '' THEN metadata END AS a, CASE WHEN trim(front) <> '' THEN front END AS b, CASE WHEN trim(first_heading) <> '' THEN first_heading END AS c FROM fields)
        SELECT paper_id, coalesce(a, b, c) AS title, CASE WHEN a IS NOT NULL THEN 'metadata' WHEN b IS NOT NULL THEN 'front' WHEN c IS NOT NULL THEN 'first_heading' END AS rule FROM f""",
    "dash_authors": f"""
        WITH {sql('dash_bib')}, d AS (SELECT *, regexp_matches(authors, '^\\s*[—–_-]{{2,}}[\\s.,]*$') AS dash FROM dash_bib)
        SELECT bib_id, CASE WHEN dash THEN last_value(CASE WHEN NOT dash THEN authors END IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY bib_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) ELSE authors END AS authors_read FROM d""",
    "paper_dois": f"""
        WITH {sql('doi_candidate')}, c AS (SELECT paper_id, {_DOI} AS doi, CASE tier WHEN 'body' THEN 0 WHEN 'running_head' THEN 1 WHEN 'front' THEN 2 WHEN 'metadata' THEN 3 ELSE -1 END AS r FROM doi_candidate WHERE doi <> 'none'),
        p AS (SELECT paper_id, doi, max(r) AS r, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT *, rank() OVER (PARTITION BY paper_id ORDER BY r DESC) AS k FROM p)
        SELECT paper_id, CASE WHEN count(*) = 1 AND max(r) >= 2 THEN min(doi) END AS doi, CASE WHEN count(*) > 1 THEN 'VAL_DOI_AMBIGUOUS' END AS warning, max(n) AS n_printed FROM t WHERE k = 1 GROUP BY 1""",
    "organisation_ids": """
        SELECT DISTINCT CASE s_suppkey % 3 WHEN 0 THEN lower(n_name) WHEN 1 THEN ' ' || n_name || '.' ELSE n_name || ' land' END AS name, CASE WHEN s_suppkey % 3 < 2 THEN n_nationkey END::BIGINT AS org_id FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
    "gold_predictions": f"""
        WITH {sql('gold_paper', 'prediction')}, p AS (SELECT regexp_replace(lower(doi), '^https://doi.org/', '') AS d, file AS f, title_score, doi_score FROM prediction),
        j AS (SELECT paper_id, 0 AS t, f, title_score, doi_score FROM gold_paper g JOIN p ON lower(g.doi) = d UNION ALL SELECT paper_id, 1, f, title_score, doi_score FROM gold_paper g JOIN p ON lower(g.file) = f),
        b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY t, f, title_score) = 1)
        SELECT g.paper_id, b.t IS NOT NULL AS found, CASE WHEN b.t IS NULL THEN 0.0 ELSE title_score END AS title_score, CASE WHEN b.t IS NULL THEN 0.0 ELSE doi_score END AS doi_score FROM gold_paper g LEFT JOIN b USING (paper_id)""",
    "footnotes_kept": f"""
        WITH {sql('note_cite', 'listed_cite')}, n AS (SELECT *, array_to_string(string_split(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}} ]', '', 'g'), ' ')[1:6], ' ') AS k FROM note_cite),
        b AS (SELECT *, array_to_string(string_split(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}} ]', '', 'g'), ' ')[1:6], ' ') AS k FROM listed_cite),
        r AS (SELECT *, row_number() OVER (PARTITION BY paper_id, k, lower(coalesce(family, '')), coalesce(year, 0) ORDER BY filled DESC, note_id) AS place FROM n)
        SELECT note_id, place = 1 AND NOT EXISTS (SELECT 1 FROM b WHERE b.paper_id = r.paper_id AND b.k = r.k AND (r.family IS NULL OR b.family IS NULL OR lower(r.family) = lower(b.family)) AND (r.year IS NULL OR b.year IS NULL OR r.year = b.year)) AS kept FROM r""",
    "reference_checks": f"""
        SELECT k AS bib_id, {pick('k', list(STATUS))} AS status, {pick('k', ['', 'year:major', 'year:minor', 'author:major', 'title:major', 'volume:minor', 'container:minor,volume:minor', 'issue:minor', 'doi:major', '', '', ''])} AS notes FROM (SELECT o_orderkey AS k FROM orders)""",
    "matched_references": "SELECT k - k % 20 AS id, k AS gold, k AS pred, CASE WHEN k % 3 > 0 THEN 1.0 WHEN k % 5 > 0 THEN 0.9 ELSE 0.7 END::DOUBLE AS score FROM (SELECT o_orderkey AS k FROM orders)",
    "export_checks": f"""
        WITH {sql('valued', 'numbered', 'abstracted', 'paper_text', 'bib', 'xref')},
        x AS (SELECT paper_id, lower(trim(coalesce(title, ''))) AS t, lower(trim(coalesce(name, ''))) AS n, trim(text) AS e, text, url, lower(trim(caption)) AS c FROM valued),
        prose AS (SELECT paper_id, sum(len(text)) AS size, string_agg(text, ' ' ORDER BY text_id) AS s FROM paper_text WHERE coalesce(section_type, '') <> 'references' GROUP BY 1), whole AS (SELECT paper_id, string_agg(text, ' ' ORDER BY text_id) AS s FROM paper_text GROUP BY 1),
        a AS (SELECT paper_id, trim(abstract) AS a, coalesce(size, 0) AS size, {_PLAIN.format('s')} AS s FROM abstracted LEFT JOIN prose USING (paper_id))
        SELECT 'VAL_PLACEHOLDER' AS code, paper_id, sum((t IN ('n/a', 'todo'))::INT)::BIGINT AS n FROM x GROUP BY 2 HAVING sum((t IN ('n/a', 'todo'))::INT) > 0
        UNION ALL SELECT 'AUTHOR_BLANK', paper_id, count(*) FROM x WHERE n = '' GROUP BY 2 UNION ALL SELECT 'EMPTY_EQ', paper_id, count(*) FROM x WHERE e = '' GROUP BY 2
        UNION ALL SELECT 'URL_MALFORMED', paper_id, count(*) FROM x WHERE url IN ('a.example', 'https://a b.example', 'https://a.example/x)', 'https://a') GROUP BY 2
        UNION ALL SELECT 'TITLE_GENERIC', paper_id, count(*) FROM x WHERE t IN ('', 'article') GROUP BY 2 UNION ALL SELECT 'UNICODE_CANONICAL', paper_id, count(*) FROM x WHERE nfc_normalize(text) <> text GROUP BY 2
        UNION ALL SELECT 'PANEL_CAPTION', paper_id, count(*) FROM x WHERE regexp_matches(c, '^\\(?[a-h]\\)?[.:]?$') GROUP BY 2
        UNION ALL SELECT 'APPENDIX_NESTING', s.paper_id, count(*) FROM numbered s JOIN numbered p ON p.paper_id = s.paper_id AND p.section_id = s.parent_id WHERE s.section_type = 'appendix' AND p.section_type <> 'appendix' GROUP BY 2
        UNION ALL SELECT 'ABSTRACT_MISSING', paper_id, 1 FROM a WHERE a = '' AND size > 0 UNION ALL SELECT 'ABSTRACT_SUSPECT', paper_id, len(a) FROM a WHERE a <> '' AND (len(a) > 2500 OR size = 0 OR len(a) > 0.2 * size OR NOT contains(s, {_PLAIN.format('a')}))
        UNION ALL SELECT 'STATEMENT_ORPHAN', p.paper_id, count(*) FROM abstracted p LEFT JOIN whole w USING (paper_id) WHERE trim(coalesce(statement, '')) <> '' AND NOT contains({_PLAIN.format('w.s')}, {_PLAIN.format('statement')}) GROUP BY 2
        UNION ALL SELECT 'XREF_ZERO', paper_id, count(DISTINCT bib_id) FROM bib b WHERE NOT EXISTS (SELECT 1 FROM xref x WHERE x.paper_id = b.paper_id AND x.target_id IS NOT NULL) GROUP BY 2""",
    "lost_references": f"""
        WITH {sql('numbered', 'xref', 'bib', 'figure')}, txt AS (SELECT paper_id, section_id AS text_id, section_id + 80 AS section_id FROM numbered), x AS (SELECT paper_id, target_id * 3 AS text_id, target_id, CASE WHEN n % 2 = 0 THEN 'bib' ELSE 'figure' END AS type FROM xref),
        xb AS (SELECT * FROM x WHERE type = 'bib'), xf AS (SELECT * FROM x WHERE type = 'figure'),
        l AS ({_LOST.format('txt', 'section_id', 'numbered', 'section_id', 'section_id')} UNION ALL {_LOST.format('numbered', 'parent_id', 'numbered', 'section_id', 'parent_id')} UNION ALL {_LOST.format('x', 'text_id', 'txt', 'text_id', 'text_id')}
            UNION ALL {_LOST.format('xb', 'target_id', 'bib', 'bib_id', 'target_id')} UNION ALL {_LOST.format('xf', 'target_id', 'figure', 'figure_id', 'target_id')})
        SELECT 'DANGLING_REF' AS code, paper_id, count(*) AS n FROM l GROUP BY 2""",
}
