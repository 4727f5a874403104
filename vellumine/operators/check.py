"""Reference checks against records, organisations against a registry, a paper's own DOI, and predictions against gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fuzzy, unicode
from ..functions.text import doi_key, normalize_doi
from .metrics import greedy_match

MAJOR_TITLE, MINOR_TITLE, LONG_TITLE = 70.0, 92.0, 20
MOST_AUTHORS = 6


def carried_authors(bibs: DataFrame) -> DataFrame:
    """Entries whose authors are a dash take those of the last entry of their list that has names (W7): adds ``authors_read``."""
    dash = F.col("authors").rlike(r"^\s*[—–_-]{2,}[\s.,]*$")
    w = Window.partitionBy("paper_id").orderBy("bib_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(~dash & (F.trim("authors") != ""), F.col("authors")), True).over(w)
    return bibs.withColumn("authors_read", F.when(F.coalesce(dash, F.lit(False)), before).otherwise(F.col("authors")))


def _same(a: Column, b: Column) -> Column:
    plain = lambda c: F.regexp_replace(F.lower(F.trim(c.cast("string"))), "^0+(?=.)", "")
    return plain(a) == plain(b)


def check(bibs: DataFrame, records: DataFrame) -> DataFrame:
    """bib_id, status, notes (T23): each reference held against its record.

    Notes are ``field:severity``. Another DOI, a title below 70, an absent first author and a year more than one apart (two later
    is minor, as are books) are major; titles below 92, further authors, containers and locators minor. One major note, or two
    different minor ones (the issue never counts, both pages count once), give ``fields_disagree``, none ``matched``. Without a
    record the look-up's outcome tells: ``doi_unregistered`` for an unknown DOI of no agency, else ``not_found`` or ``unchecked``.

    ``bibs``: bib_id, title, families (array), year, doi, container, volume, issue, first_page, last_page, bib_type, raw, et_al;
    ``records``: bib_id and the same as rec_*, with outcome and agency. Of several records the smallest DOI counts.
    """
    order = Window.partitionBy("bib_id").orderBy(F.col("rec_title").isNull(), "rec_doi", "rec_title")
    one = records.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    rows = bibs.join(one, "bib_id", "left")
    squashed = unicode.squash
    rows = rows.withColumn("t", squashed(F.coalesce("title", F.lit("")))).withColumn("r", squashed(F.coalesce("rec_title", F.lit("")))).withColumn("whole", squashed(F.coalesce("raw", F.lit(""))))
    same_doi = doi_key(F.col("doi")) == doi_key(F.col("rec_doi"))
    identified = F.coalesce(same_doi, F.lit(False)) | F.coalesce(_same(F.col("volume"), F.col("rec_volume")) & _same(F.col("first_page"), F.col("rec_first_page")), F.lit(False))
    contained = (F.col("r") != "") & F.col("whole").contains(F.col("r")) & ((F.length("r") >= LONG_TITLE) | identified)
    main = lambda c: F.split(F.coalesce(c, F.lit("")), r"[:?–—]")[0]
    score = lambda a, b: F.greatest(fuzzy.ratio(F.lower(a), F.lower(b)), fuzzy.token_sort_ratio(a, b))
    rows = rows.withColumn("title_score", F.when(contained, 100.0).otherwise(F.greatest(score(F.coalesce("title", F.lit("")), F.coalesce("rec_title", F.lit(""))), score(main(F.col("title")), main(F.col("rec_title"))))))
    first, rec_first = F.lower(F.get("families", F.lit(0))), F.lower(F.get("rec_families", F.lit(0)))
    known = F.transform(F.coalesce("families", F.array().cast("array<string>")), F.lower)
    rows = rows.withColumn("first_like", fuzzy.ratio(first, rec_first))
    others = F.slice(F.transform(F.coalesce("rec_families", F.array().cast("array<string>")), F.lower), 2, MOST_AUTHORS - 1)
    missing = F.exists(others, lambda f: ~F.array_contains(known, f))
    body = F.coalesce(F.get("rec_families", F.lit(0)).rlike(r"(?i)\b(organi[sz]ation|association|committee|group|university|institute|ministry|council)\b"), F.lit(False))
    gap = F.col("rec_year") - F.col("year")
    has = lambda a, b: F.col(a).isNotNull() & (F.col(a).cast("string") != "") & F.col(b).isNotNull() & (F.col(b).cast("string") != "")
    squeezed = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    journal = squeezed(F.col("container"))
    initials = lambda c: F.array_join(F.transform(F.filter(F.split(F.lower(c), "[^a-z]+"), lambda w: ~w.isin("", "of", "the", "and", "for", "in", "de")), lambda w: F.substring(w, 1, 1)), "")
    abbreviated = (squeezed(F.col("rec_container")).startswith(journal)) | (journal == initials(F.col("rec_container"))) | (initials(F.col("container")) == initials(F.col("rec_container")))
    note = lambda field, severity, when: F.when(F.coalesce(when, F.lit(False)), F.lit(f"{field}:{severity}"))
    named = has("title", "rec_title")
    notes = F.array_compact(
        F.array(
            note("doi", "major", has("doi", "rec_doi") & ~same_doi),
            note("title", "major", named & (F.col("title_score") < MAJOR_TITLE)),
            note("title", "minor", named & F.col("title_score").between(MAJOR_TITLE, MINOR_TITLE) & (F.col("title_score") < MINOR_TITLE)),
            note("author", "major", rec_first.isNotNull() & first.isNotNull() & ~F.array_contains(known, rec_first) & (F.col("first_like") < 80) & ~body),
            note("author", "minor", rec_first.isNotNull() & first.isNotNull() & ((~F.array_contains(known, rec_first) & ((F.col("first_like") >= 80) | body)) | (F.array_contains(known, rec_first) & missing & ~F.coalesce(F.col("et_al") & (F.size("rec_families") > 2), F.lit(False))))),
            note("year", "major", (F.abs(gap) > 1) & (gap != 2) & (F.coalesce("bib_type", F.lit("")) != "book")),
            note("year", "minor", (F.abs(gap) > 1) & ((gap == 2) | (F.coalesce("bib_type", F.lit("")) == "book"))),
            note("container", "minor", has("container", "rec_container") & ~abbreviated),
            *(note(f, "minor", has(f, f"rec_{f}") & ~_same(F.col(f), F.col(f"rec_{f}"))) for f in ("volume", "issue", "first_page", "last_page")),
        )
    )
    counted = F.size(F.array_distinct(F.transform(F.filter("notes", lambda n: n.endswith("minor") & ~n.startswith("issue")), lambda n: F.when(n.contains("_page"), "pages").otherwise(n))))
    status = F.when(F.exists("notes", lambda n: n.endswith("major")) | (counted >= 2), "fields_disagree").otherwise("matched")
    unmatched = F.when((F.col("outcome") == "doi_404") & (F.coalesce("agency", F.lit("none")) == "none"), "doi_unregistered").when(F.col("outcome").isNull(), "unchecked").otherwise("not_found")
    out = rows.withColumn("notes", F.when(F.col("rec_title").isNotNull(), notes).otherwise(F.array().cast("array<string>")))
    return out.select("bib_id", F.when(F.col("rec_title").isNotNull(), status).otherwise(unmatched).alias("status"), "notes")


def organisations(names: DataFrame, registry: DataFrame) -> DataFrame:
    """name, org_id (J12): one look-up per distinct name, by the folded name; of equal registry names the smallest id."""
    known = registry.select(unicode.squash("name").alias("key"), "org_id").where("key <> ''").groupBy("key").agg(F.min("org_id").alias("org_id"))
    asked = names.select("name").where("name IS NOT NULL").distinct().withColumn("key", unicode.squash("name"))
    return asked.join(known, "key", "left").select("name", "org_id")


TIERS = ("body", "running_head", "front", "metadata")


def own_doi(candidates: DataFrame) -> DataFrame:
    """paper_id, doi, warning (T12, W16, A28): the DOI of the highest tier, if that tier has one alone and is one that names a paper
    (front, metadata); a tie abstains with a warning. ``candidates``: paper_id, doi, tier; DOIs are normalised, repeats counted once."""
    rank = F.coalesce(*(F.when(F.col("tier") == t, i) for i, t in enumerate(TIERS)), F.lit(-1))
    rows = candidates.select("paper_id", F.lower(normalize_doi(F.col("doi"))).alias("doi"), rank.alias("rank")).where("doi IS NOT NULL")
    per = rows.groupBy("paper_id", "doi").agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("paper_id").orderBy(F.desc("rank"))
    top = per.withColumn("place", F.rank().over(w)).where("place = 1").groupBy("paper_id").agg(F.count(F.lit(1)).alias("k"), F.min("doi").alias("doi"), F.max("rank").alias("rank"), F.max("n").alias("n"))
    one = (F.col("k") == 1) & (F.col("rank") >= TIERS.index("front"))
    return top.select("paper_id", F.when(one, F.col("doi")).alias("doi"), F.when(F.col("k") > 1, "VAL_DOI_AMBIGUOUS").alias("warning"), F.col("n").alias("n_printed"))


def printed_citation(papers: DataFrame, lines: DataFrame) -> DataFrame:
    """paper_id, line_id, agrees_by (T33): the line that cites the paper itself, told by a cue and the paper's DOI, else its title,
    else its first author; the first such line. ``papers``: paper_id, doi, title, family; ``lines``: paper_id, line_id, text."""
    cue = F.lower("text").rlike(r"^\s*(cite this (article|paper) as|how to cite|to cite this|citation:|suggested citation|recommended citation|please cite)")
    rows = lines.where(cue).join(papers, "paper_id")
    key = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")
    within = lambda c: (key(F.col(c)) != "") & key(F.col("text")).contains(key(F.col(c)))
    by = F.when(within("doi"), "doi").when(within("title"), "title").when(within("family"), "author")
    found = rows.withColumn("agrees_by", by).where("agrees_by IS NOT NULL")
    best = found.groupBy("paper_id").agg(F.min(F.struct("line_id", "agrees_by")).alias("b"))
    return best.select("paper_id", "b.line_id", "b.agrees_by")


def evaluated(expected: DataFrame, gold: DataFrame, predictions: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """paper_id and metrics (J14): predictions joined to gold papers by normalised DOI, else by file name; every expected paper has a
    row, and one without a prediction scores 0. ``gold``: paper_id, doi, file; ``predictions``: doi, file and the metrics."""
    g = expected.select("paper_id").distinct().join(gold, "paper_id", "left").select("paper_id", doi_key(F.col("doi")).alias("g_doi"), F.lower("file").alias("g_file"))
    p = predictions.select(doi_key(F.col("doi")).alias("p_doi"), F.lower("file").alias("p_file"), *metrics)
    by_doi = g.join(p.where("p_doi IS NOT NULL"), F.col("g_doi") == F.col("p_doi")).select("paper_id", F.lit(0).alias("tier"), "p_file", *metrics)
    by_file = g.join(p, F.col("g_file") == F.col("p_file")).select("paper_id", F.lit(1).alias("tier"), "p_file", *metrics)
    best = by_doi.unionByName(by_file).groupBy("paper_id").agg(F.min(F.struct("tier", "p_file", *metrics)).alias("b")).select("paper_id", F.lit(True).alias("found"), *(F.col(f"b.{m}").alias(m) for m in metrics))
    out = expected.select("paper_id").distinct().join(best, "paper_id", "left")
    return out.select("paper_id", F.col("found").isNotNull().alias("found"), *(F.when(F.col("found").isNull(), 0.0).otherwise(F.col(m)).alias(m) for m in metrics))


def reference_pairs(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """id, gold, pred, score (J13) of the pairs of a paper's references that agree: 1.0 by DOI, 0.9 by a title of ratio 85, 0.7 by first
    surname and year, 0.6 where the one's title stands in the other's raw text. Candidates share a DOI, a word of five letters or
    a surname with the year; both have id, ref, doi, title, family, year, raw."""
    words = lambda: F.array_distinct(F.filter(F.split(F.lower(F.coalesce("title", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= 5))
    keys = F.array_compact(F.array_union(F.transform(words(), lambda t: F.concat(F.lit("w"), t)), F.array(F.concat(F.lit("d"), doi_key(F.col("doi"))), F.concat_ws("|", F.lit("y"), F.lower("family"), F.col("year").cast("string")))))
    side = lambda df, name: df.withColumn("keys", keys).select("id", F.explode("keys").alias("key"), F.col("keys").alias(f"{name}_keys"), *(F.col(c).alias(f"{name}_{c}") for c in ("ref", "doi", "title", "family", "year", "raw")))
    # A pair that shares several keys counts at the smallest of them.
    both = side(gold, "g").join(side(predicted, "p"), ["id", "key"]).where(F.col("key") == F.array_min(F.array_intersect("g_keys", "p_keys")))
    near = fuzzy.ratio(F.lower("g_title"), F.lower("p_title"))
    held = F.coalesce((F.length("g_title") >= LONG_TITLE) & F.lower("p_raw").contains(F.lower("g_title")), F.lit(False))
    score = F.when(doi_key(F.col("g_doi")) == doi_key(F.col("p_doi")), 1.0).when(near >= 85, 0.9).when((F.lower("g_family") == F.lower("p_family")) & (F.col("g_year") == F.col("p_year")), 0.7).when(held, 0.6).otherwise(0.0)
    return both.select("id", F.col("g_ref").alias("gold"), F.col("p_ref").alias("pred"), score.alias("score")).where("score > 0")


def matched_references(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """id, gold, pred, score (J13): ``greedy_match`` of all ``reference_pairs``. Pairs by DOI come first there, so the others are
    formed only of references that those leave; sides as in ``reference_pairs``."""
    by_doi = lambda df, name: df.select("id", F.col("ref").alias(name), doi_key(F.col("doi")).alias("key"))
    first = greedy_match(by_doi(gold, "gold").join(by_doi(predicted, "pred"), ["id", "key"]).select("id", "gold", "pred", F.lit(1.0).alias("score")))
    left = lambda df, name: df.join(first.select("id", F.col(name).alias("ref")), ["id", "ref"], "left_anti")
    return first.unionByName(greedy_match(reference_pairs(left(gold, "gold"), left(predicted, "pred"))))


def footnote_repeats(notes: DataFrame, listed: DataFrame) -> DataFrame:
    """note_id, kept (J19): citations from footnotes that a list does not hold; of those that repeat each other the fullest, then first.

    Two agree if their titles' first six words do, no author contradicts and the years do not differ. Both: paper_id, title, family,
    year; notes also note_id and filled (number of fields read).
    """
    key = lambda: F.array_join(F.slice(F.split(F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), r"[^\p{L}\p{N} ]", ""), r"\s+"), 1, 6), " ")
    n, b = notes.withColumn("key", key()), listed.withColumn("key", key()).select("paper_id", "key", F.lower("family").alias("b_family"), F.col("year").alias("b_year"))
    agrees = (F.col("family").isNull() | F.col("b_family").isNull() | (F.lower("family") == F.col("b_family"))) & (F.col("year").isNull() | F.col("b_year").isNull() | (F.col("year") == F.col("b_year")))
    known = n.where("key <> ''").join(b, ["paper_id", "key"]).where(agrees).select("note_id").distinct().withColumn("known", F.lit(True))
    w = Window.partitionBy("paper_id", "key", F.lower(F.coalesce("family", F.lit(""))), F.coalesce("year", F.lit(0))).orderBy(F.desc("filled"), "note_id")
    rows = n.withColumn("place", F.when(F.col("key") != "", F.row_number().over(w)).otherwise(1)).join(known, "note_id", "left")
    return rows.select("note_id", (F.col("known").isNull() & (F.col("place") == 1)).alias("kept"))
