"""Reference records against registry matches: choosing, consolidating, verifying and looking up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERVICES = ("crossref", "datacite", "pubmed", "openalex")
FIELDS = ("doi", "volume", "first_page", "container", "year")
VERIFIED = ("volume", "first_page")


def service_rank(service: Column) -> Column:
    """Place in the order of precedence; unknown services come last."""
    rank = F.lit(len(SERVICES))
    for i, name in reversed(list(enumerate(SERVICES))):
        rank = F.when(service == name, i).otherwise(rank)
    return rank


def unit_score(score: Column) -> Column:
    """Match score between 0 and 1; older records scored to 100."""
    return F.coalesce(F.when(score > 1, score / 100).otherwise(score), F.lit(0.0))


def best_match(matches: DataFrame, least: float = 0.9, key: str = "bib_id") -> DataFrame:
    """The match of each reference to trust: confident ones by service, then score, then match_id."""
    order = Window.partitionBy(key).orderBy(service_rank(F.col("service")), F.desc(unit_score(F.col("score"))), "match_id")
    return matches.where(unit_score(F.col("score")) >= least).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def consolidate(bibs: DataFrame, matches: DataFrame, mode: str = "fill") -> DataFrame:
    """References with empty fields filled from their matches by service, and the receipt of fields taken.

    ``replace`` also overwrites fields from matches that carry the reference's own DOI. Taking the year drops the year
    suffix. One pass over the matches: per reference and field the first non-empty value by rank is aggregated.
    """
    if mode not in ("fill", "replace"):
        raise ValueError(mode)
    order = F.struct(service_rank(F.col("m.service")), F.col("m.match_id"))
    same = F.lower(F.col("m.doi")) == F.lower(F.col("b.doi"))
    b, m = bibs.alias("b"), matches.alias("m")
    joined = m.join(b.select("bib_id", "doi"), "bib_id")
    first = [F.min_by(F.col(f"m.{f}"), F.when(F.col(f"m.{f}").isNotNull() & (F.col(f"m.{f}").cast("string") != ""), order)).alias(f"any_{f}") for f in FIELDS]
    own = [F.min_by(F.col(f"m.{f}"), F.when(same & F.col(f"m.{f}").isNotNull() & (F.col(f"m.{f}").cast("string") != ""), order)).alias(f"own_{f}") for f in FIELDS]
    offered = joined.groupBy("bib_id").agg(*first, *own)
    out = bibs.join(offered, "bib_id", "left")
    taken = []
    for f in FIELDS:
        empty = F.col(f).isNull() | (F.col(f).cast("string") == "")
        value = F.when(empty, F.col(f"any_{f}"))
        if mode == "replace":
            value = F.when(empty, F.col(f"any_{f}")).otherwise(F.col(f"own_{f}"))
        changed = value.isNotNull() & ~value.eqNullSafe(F.col(f))
        taken.append(F.when(changed, F.lit(f)))
        out = out.withColumn(f"new_{f}", F.when(changed, value).otherwise(F.col(f)))
    out = out.withColumn("taken", F.array_compact(F.array(*taken)))
    suffix = F.when(~F.array_contains("taken", "year"), F.col("year_suffix"))
    out = out.withColumn("taken", F.when(F.array_contains("taken", "year") & F.col("year_suffix").isNotNull(), F.concat("taken", F.array(F.lit("year_suffix")))).otherwise(F.col("taken")))
    return out.select("bib_id", *(F.col(f"new_{f}").alias(f) for f in FIELDS), suffix.alias("year_suffix"), "taken")


def plain_key(value: Column) -> Column:
    """Comparison key of a locator: no white space, lower case, no leading zeros."""
    c = F.regexp_replace(F.lower(F.regexp_replace(value.cast("string"), r"\s+", "")), "^0+", "")
    return F.when(c == "", "0").otherwise(c)


def printed_in(raw: Column, value: Column) -> Column:
    """Whether ``value`` stands in ``raw`` as a whole token."""
    tokens = F.split(F.lower(F.coalesce(raw, F.lit(""))), "[^0-9a-z]+")
    return F.array_contains(tokens, F.lower(value))


def verify(bibs: DataFrame, matches: DataFrame, raw: str = "raw") -> DataFrame:
    """(bib_id, field, outcome, value): agree, filled, corrected or disagree for each locator that the record gives."""
    b, m = bibs.alias("b"), best_match(matches).alias("m")
    rows = b.join(m, F.col("b.bib_id") == F.col("m.bib_id"))
    parts = []
    for f in VERIFIED:
        parsed, record = F.col(f"b.{f}").cast("string"), F.trim(F.col(f"m.{f}").cast("string"))
        lead = F.regexp_extract(record, r"^([0-9A-Za-z]+)", 1)
        ends = F.split(parsed, r"\s*[-‐‑‒–—]\s*")
        same = (plain_key(parsed) == plain_key(record)) | ((lead != "") & (plain_key(lead) == plain_key(parsed))) | ((F.size(ends) == 2) & F.exists(ends, lambda e: (e != "") & (plain_key(e) == plain_key(record))))
        others = [F.col(f"b.{o}") for o in (*VERIFIED, "year") if o != f]
        claimed = F.lit(False)
        for o in others:
            claimed = claimed | F.coalesce(plain_key(o) == plain_key(record), F.lit(False))
        has = parsed.isNotNull() & (parsed != "")
        usable = printed_in(F.col(f"b.{raw}"), record) & ~claimed
        outcome = F.when(has & same, "agree").when(usable & has, "corrected").when(usable, "filled").when(has, "disagree")
        parts.append(F.when(record != "", F.struct(F.lit(f).alias("field"), outcome.alias("outcome"), F.when(outcome.isin("filled", "corrected"), record).alias("value"))))
    out = rows.select(F.col("b.bib_id"), F.explode(F.array_compact(F.array(*parts))).alias("o"))
    return out.select("bib_id", "o.field", "o.outcome", "o.value").where("outcome IS NOT NULL")


#: Columns that either side of the look-up may lack.
OPTIONAL = {"doi": "string", "families": "array<string>", "volume": "string", "first_page": "string", "container": "string"}
LEAST_CONTAINER = 85.0


def similar_keys(left: DataFrame, right: DataFrame, least: float = 80.0) -> DataFrame:
    """(left_key, right_key, ratio) of all pairs of distinct keys whose indel ratio is ``least`` or more; none is missed.

    Strings of S characters together and d insertions and deletions apart keep S / 2 - 1.5 d - 1 bigrams in common, and
    d is at most (1 - r) S. So they share one of each string's rarest bigrams, its size less the bound for the shortest
    partner that the ratio allows; strings too short for a bound all meet under an empty bigram.
    """
    from ..functions import fuzzy

    r = least / 100
    size = F.length("key")
    need = F.greatest(F.lit(0), F.ceil((size + F.ceil(size * (r / (2 - r)) - 1e-9)) * (1.5 * r - 1) - 1 - 1e-9))
    keys = left.select("key", F.lit(True).alias("is_left")).union(right.select("key", F.lit(False))).distinct()
    once = keys.select("key").distinct()
    grams = once.select("key", F.explode(fuzzy.numbered_bigrams("key")).alias("gram"))
    rare = Window.partitionBy("key").orderBy("n", "gram")
    heads = grams.join(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram").withColumn("place", F.row_number().over(rare))
    heads = heads.where(F.col("place") <= size - F.greatest(need, F.lit(1))).select("key", "gram").union(once.where(need < 1).select("key", F.lit("")))
    heads = heads.join(keys, "key")
    side = lambda flag, name: heads.where(F.col("is_left") == flag).select("gram", F.col("key").alias(name))
    a, b = F.length("left_key"), F.length("right_key")
    pairs = side(True, "left_key").join(side(False, "right_key"), "gram").where(200 * F.least(a, b) >= least * (a + b)).select("left_key", "right_key").distinct()
    return pairs.withColumn("ratio", fuzzy.ratio("left_key", "right_key")).where(F.col("ratio") >= least)


def _record(rows: DataFrame, key: str) -> DataFrame:
    from ..functions import fuzzy
    from ..functions.text import normalize_doi

    for name, kind in OPTIONAL.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    names = F.filter(F.transform(F.coalesce("families", F.array().cast("array<string>")), lambda f: F.lower(F.trim(f))), lambda f: F.length(f) > 1)
    plain = lambda c: F.when(F.trim(c) != "", F.lower(F.trim(c)))
    return rows.select(
        F.col(key).alias("id"), fuzzy.sorted_key("title").alias("key"), F.col("year").cast("long").alias("year"), F.lower(normalize_doi(F.col("doi"))).alias("doi"), F.array_sort(F.array_distinct(names)).alias("names"),
        F.get(names, F.lit(0)).alias("first"), plain("volume").alias("volume"), plain("first_page").alias("page"), plain("container").alias("container"),
    )


def match_registry(bibs: DataFrame, works: DataFrame, least: float = 80.0) -> DataFrame:
    """(bib_id, work_id, score): the best work of each reference, by score and then work_id.

    A reference with a DOI only matches works of that DOI, with 100, unless the years are more than 1 apart. One with a
    title is compared to all titles: the token-sorted ratio, halved if the years are more than 2 apart and times 0.7 if
    both name authors and share no surname. One without either needs the same first surname and volume, years at most 1
    apart, first pages that do not differ, and containers of ratio 85, or one first page where a container is missing.
    Works that cannot be told apart are compared once, and so are references.
    """
    from ..functions.fuzzy import token_sort_ratio

    b, w = _record(bibs, "bib_id"), _record(works, "work_id")
    gap = F.abs(F.col("b.year") - F.col("w.year"))
    profile = lambda *cols: w.groupBy(*cols).agg(F.min("id").alias("work_id")).alias("w")

    by_doi = b.where("doi IS NOT NULL").alias("b").join(profile("doi", "year").where("doi IS NOT NULL"), F.col("b.doi") == F.col("w.doi"))
    by_doi = by_doi.where(F.coalesce(gap <= 1, F.lit(True))).select(F.col("b.id").alias("bib_id"), F.lit(100.0).alias("score"), "work_id")

    titled, known = b.where("doi IS NULL AND key <> ''"), w.where("key <> ''")
    pairs = similar_keys(titled, known, least)
    asked = titled.select("key", "year", "names").distinct().alias("b")
    scored = asked.join(pairs, F.col("b.key") == F.col("left_key")).join(profile("key", "year", "names"), F.col("right_key") == F.col("w.key"))
    strangers = (F.size("b.names") > 0) & (F.size("w.names") > 0) & ~F.arrays_overlap("b.names", "w.names")
    score = F.col("ratio") * F.when(gap > 2, 0.5).otherwise(1.0) * F.when(strangers, 0.7).otherwise(1.0)
    best = scored.withColumn("score", score).where(F.col("score") >= least).groupBy("b.key", "b.year", "b.names").agg(F.min(F.struct((-F.col("score")).alias("less"), "work_id")).alias("best")).alias("a")
    same = (F.col("t.key") == F.col("a.key")) & F.col("t.year").eqNullSafe(F.col("a.year")) & (F.col("t.names") == F.col("a.names"))
    by_title = titled.alias("t").join(best, same).select(F.col("t.id").alias("bib_id"), (-F.col("best.less")).alias("score"), "best.work_id")

    bare = b.where("doi IS NULL AND key = ''").alias("b")
    prints = bare.join(profile("first", "volume", "year", "page", "container"), (F.col("b.first") == F.col("w.first")) & (F.col("b.volume") == F.col("w.volume")) & (gap <= 1))
    prints = prints.where(F.coalesce(F.col("b.page") == F.col("w.page"), F.lit(True)))
    both = F.col("b.container").isNotNull() & F.col("w.container").isNotNull()
    likeness = F.when(both, token_sort_ratio("b.container", "w.container")).when(F.col("b.page").isNotNull() & F.col("w.page").isNotNull(), LEAST_CONTAINER)
    by_print = prints.withColumn("score", likeness).where(F.col("score") >= LEAST_CONTAINER).select(F.col("b.id").alias("bib_id"), "score", "work_id")

    found = by_doi.unionByName(by_title).unionByName(by_print).groupBy("bib_id").agg(F.min(F.struct((-F.col("score")).alias("less"), "work_id")).alias("best"))
    return found.select("bib_id", "best.work_id", F.round(-F.col("best.less"), 6).alias("score"))
