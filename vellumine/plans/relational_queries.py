"""Queries over linked tables: reference matching, validation and the batch ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger, references, validation
from .fixtures import made, sql


def bib_best_match(spark, sf_dir):
    """Left join of references to the match to trust."""
    best = references.best_match(made(spark, sf_dir, "bib_match")).select("bib_id", "match_id", "service")
    return made(spark, sf_dir, "bib").select("bib_id").join(best, "bib_id", "left")


def bib_consolidate_fill(spark, sf_dir):
    return _flat(references.consolidate(made(spark, sf_dir, "bib"), made(spark, sf_dir, "bib_match")))


def bib_consolidate_replace(spark, sf_dir):
    return _flat(references.consolidate(made(spark, sf_dir, "bib"), made(spark, sf_dir, "bib_match"), "replace"))


def _flat(df):
    return df.withColumn("taken", F.array_join("taken", ","))


def bib_verify(spark, sf_dir):
    return references.verify(made(spark, sf_dir, "bib"), made(spark, sf_dir, "bib_match"))


def verify_tally(spark, sf_dir):
    """Outcomes by field."""
    return bib_verify(spark, sf_dir).groupBy("field", "outcome").agg(F.count(F.lit(1)).alias("n"))


def validation_issues(spark, sf_dir):
    """Seven of the 19 checks of T24 (J3, A8-A13), some in part, and blank captions, united; README lists the others."""
    bib, xref, author, figure = (made(spark, sf_dir, n) for n in ("bib", "xref", "author", "figure"))
    return validation.all_issues(
        validation.duplicate_keys(figure, "figure_id"),
        validation.dangling(xref.withColumnRenamed("target_id", "bib_id"), "bib_id", bib, "bib_id"),
        validation.author_outliers(author),
        validation.blank_share(figure, "caption"),
        validation.low_coverage(bib, xref),
        validation.count_mismatch(xref.select("paper_id"), bib),
        validation.outside(figure, F.col("x") > 45),
        validation.flagged(figure, F.trim("caption") == "", "FIGURE_BLANK"),
    )


def ledger_latest(spark, sf_dir):
    return ledger.latest(made(spark, sf_dir, "log"))


def ledger_attempts(spark, sf_dir):
    return ledger.attempts(made(spark, sf_dir, "log"))


def ledger_plan(spark, sf_dir):
    return ledger.unsettled(made(spark, sf_dir, "log"), F.col("status") == "failed")


def ledger_trailing(spark, sf_dir):
    """Failures in a row at the end of each paper's log."""
    return ledger.trailing_run(made(spark, sf_dir, "log"), F.col("status") == "failed")


def ledger_report(spark, sf_dir):
    return ledger.report(made(spark, sf_dir, "log"))


def ledger_top_codes(spark, sf_dir):
    return ledger.top_codes(made(spark, sf_dir, "log"), 3)


def ledger_usage(spark, sf_dir):
    return ledger.usage(made(spark, sf_dir, "log"))


def rate_limit(spark, sf_dir):
    """More than two requests of a user within an hour."""
    return ledger.sliding_excess(made(spark, sf_dir, "log"), 3600, 2).select("key", "line_no", "in_window")


def job_retention(spark, sf_dir):
    """2.10: what every user's store of jobs keeps after the last event: ten days, forty jobs, 1,500 bytes; errors never finish."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    finished = F.when(F.col("event_type") != "error", F.col("ts"))
    jobs = events.select(F.col("user_id").alias("store"), F.col("event_id").alias("job_id"), finished.alias("finished"), F.floor("value").cast("long").alias("size"))
    now = events.agg(F.unix_micros(F.max("ts").cast("timestamp"))).first()[0]
    return ledger.retained(jobs, F.timestamp_micros(F.lit(now).cast("long")), 10 * 86400, 40, 1500).select("store", "job_id", "size")


def affiliations(spark, sf_dir):
    """Distinct affiliations of a paper with their authors."""
    rows = made(spark, sf_dir, "author").select("paper_id", "author_id", F.explode(F.split("affiliation", "; ")).alias("affiliation"))
    return rows.groupBy("paper_id", F.lower("affiliation").alias("affiliation")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("author_id")), lambda x: x.cast("string")), ",").alias("author_ids"))


QUERIES = {
    f.__name__: f
    for f in (bib_best_match, bib_consolidate_fill, bib_consolidate_replace, bib_verify, verify_tally, validation_issues, ledger_latest, ledger_attempts, ledger_plan, ledger_trailing, ledger_report, ledger_top_codes, ledger_usage, rate_limit, job_retention, affiliations)
}

_RANK = "CASE service WHEN 'crossref' THEN 0 WHEN 'datacite' THEN 1 WHEN 'pubmed' THEN 2 WHEN 'openalex' THEN 3 ELSE 4 END"
_UNIT = "coalesce(CASE WHEN score > 1 THEN score / 100 ELSE score END, 0.0)"
_BEST = f"best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bib_id ORDER BY {_RANK}, {_UNIT} DESC, match_id) AS k FROM bib_match WHERE {_UNIT} >= 0.9) WHERE k = 1)"


def _consolidated(mode: str) -> str:
    fields = references.FIELDS
    offered = ", ".join(
        f"arg_min(m.{f}, ({_RANK}, match_id)) FILTER (m.{f} IS NOT NULL AND m.{f}::VARCHAR <> '') AS any_{f}, arg_min(m.{f}, ({_RANK}, match_id)) FILTER (m.{f} IS NOT NULL AND m.{f}::VARCHAR <> '' AND lower(m.doi) = lower(b.doi)) AS own_{f}" for f in fields
    )
    value = lambda f: f"CASE WHEN b.{f} IS NULL OR b.{f}::VARCHAR = '' THEN any_{f}" + (f" ELSE own_{f}" if mode == "replace" else "") + " END"
    changed = lambda f: f"({value(f)} IS NOT NULL AND {value(f)} IS DISTINCT FROM b.{f})"
    news = ", ".join(f"CASE WHEN {changed(f)} THEN {value(f)} ELSE b.{f} END AS {f}" for f in fields)
    taken = "[" + ", ".join([f"CASE WHEN {changed(f)} THEN '{f}' END" for f in fields] + [f"CASE WHEN {changed('year')} AND year_suffix IS NOT NULL THEN 'year_suffix' END"]) + "]"
    return f"""WITH {sql("bib", "bib_match")}, o AS (SELECT m.bib_id, {offered} FROM bib_match m JOIN bib b ON b.bib_id = m.bib_id GROUP BY m.bib_id)
        SELECT b.bib_id, {news}, CASE WHEN NOT {changed('year')} THEN year_suffix END AS year_suffix, array_to_string(list_filter({taken}, lambda x: x IS NOT NULL), ',') AS taken
        FROM bib b LEFT JOIN o ON o.bib_id = b.bib_id"""


def _key(x: str) -> str:
    return f"coalesce(nullif(regexp_replace(lower(regexp_replace({x}::VARCHAR, '\\s+', '', 'g')), '^0+', ''), ''), CASE WHEN {x} IS NOT NULL THEN '0' END)"


def _verified(f: str, other: str) -> str:
    p, r = f"b.{f}", f"trim(m.{f})"
    same = f"({_key(p)} = {_key(r)} OR (regexp_extract({r}, '^([0-9A-Za-z]+)', 1) <> '' AND {_key(f'regexp_extract({r}, $$^([0-9A-Za-z]+)$$, 1)')} = {_key(p)}))"
    claimed = f"(coalesce({_key('b.' + other)} = {_key(r)}, false) OR coalesce({_key('b.year')} = {_key(r)}, false))"
    usable = f"(list_contains(regexp_split_to_array(lower(b.raw), '[^0-9a-z]+'), lower({r})) AND NOT {claimed})"
    has = f"({p} IS NOT NULL AND {p} <> '')"
    outcome = f"CASE WHEN {has} AND {same} THEN 'agree' WHEN {usable} AND {has} THEN 'corrected' WHEN {usable} THEN 'filled' WHEN {has} THEN 'disagree' END"
    return f"SELECT b.bib_id, '{f}' AS field, {outcome} AS outcome, CASE WHEN {outcome} IN ('filled', 'corrected') THEN {r} END AS value FROM bib b JOIN best m ON m.bib_id = b.bib_id WHERE {r} <> '' AND {outcome} IS NOT NULL"


_VERIFY = f"WITH {sql('bib', 'bib_match')}, {_BEST}, v AS ({_verified('volume', 'first_page')} UNION ALL {_verified('first_page', 'volume')})"

ORACLES = {
    "bib_best_match": f"WITH {sql('bib', 'bib_match')}, {_BEST} SELECT bib.bib_id, match_id, service FROM bib LEFT JOIN best ON best.bib_id = bib.bib_id",
    "bib_consolidate_fill": _consolidated("fill"),
    "bib_consolidate_replace": _consolidated("replace"),
    "bib_verify": f"{_VERIFY} SELECT * FROM v",
    "verify_tally": f"{_VERIFY} SELECT field, outcome, count(*) AS n FROM v GROUP BY ALL",
    "validation_issues": f"""
        WITH {sql('bib', 'xref', 'author', 'figure')},
        dup AS (SELECT paper_id, sum(k - 1) AS n FROM (SELECT paper_id, figure_id, count(*) AS k FROM figure GROUP BY ALL HAVING count(*) > 1) GROUP BY 1),
        lost AS (SELECT paper_id, count(*) AS n FROM xref x WHERE target_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bib b WHERE b.paper_id = x.paper_id AND b.bib_id = x.target_id) GROUP BY 1),
        au AS (SELECT paper_id, sum(k) AS n FROM (SELECT paper_id, name, count(*) AS k FROM author GROUP BY ALL) GROUP BY 1 HAVING sum(k) > 64 OR max(k) > 2),
        cap AS (SELECT paper_id, count(*) FILTER (caption IS NULL OR trim(caption) = '') AS n FROM figure GROUP BY 1 HAVING n / count(*) > 0.5),
        cov AS (SELECT paper_id, count(DISTINCT bib_id) AS a, count(DISTINCT CASE WHEN EXISTS (SELECT 1 FROM xref x WHERE x.paper_id = b.paper_id AND x.target_id = b.bib_id) THEN bib_id END) AS g FROM bib b GROUP BY 1),
        cnt AS (SELECT x.paper_id, x.n FROM (SELECT paper_id, count(*) AS n FROM xref GROUP BY 1) x LEFT JOIN (SELECT paper_id, count(*) AS k FROM bib GROUP BY 1) b USING (paper_id) WHERE x.n >= 5 AND x.n > 1.3 * coalesce(k, 0)),
        box AS (SELECT paper_id, count(*) FILTER (x > 45) AS n FROM figure GROUP BY 1 HAVING n / count(*) > 0.1),
        fig AS (SELECT paper_id, count(*) AS n FROM figure WHERE trim(caption) = '' GROUP BY 1)
        SELECT 'DUPLICATE_ID' AS code, paper_id, n::BIGINT AS n FROM dup UNION ALL SELECT 'DANGLING_REF', paper_id, n FROM lost UNION ALL SELECT 'AUTHOR_OUTLIER', paper_id, n::BIGINT FROM au
        UNION ALL SELECT 'CAPTION_MISSING', paper_id, n FROM cap UNION ALL SELECT 'XREF_LOW_COVERAGE', paper_id, a - g FROM cov WHERE a >= 10 AND g / a < 0.2 UNION ALL SELECT 'REF_COUNT_MISMATCH', paper_id, n FROM cnt
        UNION ALL SELECT 'BBOX_SPACE', paper_id, n FROM box UNION ALL SELECT 'FIGURE_BLANK', paper_id, n FROM fig""",
    "ledger_latest": f"WITH {sql('log')} SELECT paper_id, arg_max(status, line_no) AS status, max(line_no) AS line_no FROM log WHERE status <> 'started' GROUP BY 1",
    "ledger_attempts": f"WITH {sql('log')}, p AS (SELECT *, lag(status) OVER (PARTITION BY paper_id ORDER BY line_no) AS before FROM log) SELECT paper_id, count(*) FILTER (status = 'started' OR before IS DISTINCT FROM 'started') AS attempts FROM p GROUP BY 1",
    "ledger_plan": f"""
        WITH {sql('log')}, p AS (SELECT *, lead(status) OVER w AS after, sum((status = 'ok')::INT) OVER (PARTITION BY paper_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS oks FROM log WINDOW w AS (PARTITION BY paper_id ORDER BY line_no)),
        u AS (SELECT paper_id, count(*) FILTER (coalesce(oks, 0) = 0 AND status <> 'ok' AND (status = 'failed' OR (status = 'started' AND (after IS NULL OR after = 'started')))) AS unsettled, arg_max(status, line_no) FILTER (status <> 'started') AS last FROM p GROUP BY 1)
        SELECT paper_id, unsettled, coalesce(last, '') <> 'ok' AND unsettled < 3 AS runs_again FROM u""",
    "ledger_trailing": f"WITH {sql('log')}, p AS (SELECT paper_id, sum((status <> 'failed')::INT) OVER (PARTITION BY paper_id ORDER BY line_no DESC) AS misses FROM log) SELECT paper_id, count(*) FILTER (misses = 0) AS run FROM p GROUP BY 1",
    "ledger_report": f"""
        WITH {sql('log')}, l AS (SELECT * FROM log WHERE status <> 'started' QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY line_no DESC) = 1),
        p AS (SELECT count(*) AS papers, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS failed, sum(n_refs) FILTER (status = 'ok') AS refs, sum(n_matched) FILTER (status = 'ok') AS matched FROM l),
        r AS (SELECT count(*) AS attempts, (epoch_us(max(happened)) - epoch_us(min(happened))) / 3.6e9 AS hours, quantile_cont(duration_s, 0.5) FILTER (status = 'ok') AS p50, quantile_cont(duration_s, 0.9) FILTER (status = 'ok') AS p90,
            max(duration_s) FILTER (status = 'ok') AS longest, avg(duration_s) FILTER (status = 'ok') AS mean FROM log)
        SELECT papers, ok, failed, attempts, round(hours, 3) AS hours, round(ok / hours, 2) AS per_hour, round(p50, 3) AS p50, round(p90, 3) AS p90, round(longest, 3) AS longest, round(mean, 3) AS mean, refs::BIGINT AS refs, matched::BIGINT AS matched, round(matched / refs, 4) AS match_rate FROM p, r""",
    "ledger_top_codes": f"WITH {sql('log')} SELECT code, count(*) AS n FROM log GROUP BY 1 ORDER BY n DESC, code LIMIT 3",
    "ledger_usage": f"WITH {sql('log')} SELECT label, model, count(*) AS calls, sum(tokens)::BIGINT AS tokens, grouping(label, model) AS level FROM log GROUP BY ROLLUP (label, model)",
    "rate_limit": f"WITH {sql('log')}, w AS (SELECT key, line_no, count(*) OVER (PARTITION BY key ORDER BY happened RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM log) SELECT * FROM w WHERE in_window > 2",
    "job_retention": """
        WITH j AS (SELECT user_id AS store, event_id AS job_id, CASE WHEN event_type <> 'error' THEN ts END AS finished, floor(value)::BIGINT AS size FROM events),
        r AS (
            SELECT *, row_number() OVER w AS place, sum(coalesce(size, 0)) OVER w AS held FROM j
            WHERE finished >= (SELECT max(ts) FROM events) - INTERVAL 240 HOURS
            WINDOW w AS (PARTITION BY store ORDER BY finished DESC, job_id DESC ROWS UNBOUNDED PRECEDING))
        SELECT store, job_id, size FROM r WHERE place <= 40 AND (place = 1 OR held <= 1500)
        UNION ALL SELECT store, job_id, size FROM j WHERE finished IS NULL
    """,
    "affiliations": f"WITH {sql('author')}, a AS (SELECT DISTINCT paper_id, author_id, lower(unnest(string_split(affiliation, '; '))) AS affiliation FROM author) SELECT paper_id, affiliation, string_agg(author_id::VARCHAR, ',' ORDER BY author_id) AS author_ids FROM a GROUP BY ALL",
}
