"""Assignments against all assignments, and operators on nulls, ties, repeats and empty tables."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from vellumine.operators import check, citations, front, fulltext, ledger, metrics, references, sections, sentences, structure, validation


def test_assignment_against_all_assignments():
    rng = random.Random(1)
    for _ in range(200):
        edges = [(a, b, round(rng.uniform(-1, 5), 2)) for a in range(rng.randint(1, 3)) for b in range(rng.randint(1, 3)) if rng.random() < 0.8]
        totals = sorted((sum(e[2] for e in some) for k in range(len(edges) + 1) for some in itertools.combinations(edges, k) if len({e[0] for e in some}) == k == len({e[1] for e in some})), reverse=True)
        assert structure._heaviest(edges)[0] == pytest.approx(totals[0]) if edges else True
        for a, b in structure.assign(edges):
            rest = [e for e in edges if e[:2] != (a, b)]
            without = max(sum(e[2] for e in some) for k in range(len(rest) + 1) for some in itertools.combinations(rest, k) if len({e[0] for e in some}) == k == len({e[1] for e in some}))
            assert totals[0] - without >= structure.EDGE["margin"] - 1e-9
    assert structure.assign([(1, 1, 2.0), (1, 2, 2.1)]) == [] and structure.assign([(1, 1, 2.0), (2, 1, 3.0)]) == [(2, 1)]


def test_captions(spark):
    box = "paper_id long, id long, kind string, page long, number long, x0 double, y0 double, x1 double, y1 double"
    captions = spark.createDataFrame([(1, 10, "figure", 1, 2, 0.0, 300.0, 100.0, 320.0), (1, 11, "figure", 2, None, 0.0, 0.0, 100.0, 20.0), (1, 12, "table", 9, 1, 0.0, 0.0, 1.0, 1.0), (None, 13, "figure", 1, 1, 0.0, 0.0, 1.0, 1.0)], box)
    floats = spark.createDataFrame([(1, 20, "figure", 1, 1, 0.0, 100.0, 100.0, 280.0), (1, 21, "figure", 1, 2, 0.0, 330.0, 100.0, 400.0), (1, 22, "figure", 2, None, 0.0, 30.0, 100.0, 90.0)], box)
    got = structure.captions_to_floats(captions, floats).select("caption_id", "float_id").collect()
    assert sorted(map(tuple, got)) == [(10, 21), (11, 22)]
    assert structure.captions_to_floats(captions.where("false"), floats).count() == 0


def test_metrics(spark):
    value = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    lit = lambda x: F.lit(x).cast("string")
    for a, b, want in [("The Tide!", "the tide", 1.0), ("the tide of kelp beds", "the tide of kelp", 1.0), ("the tide of kelp", "the tide of", 0.0), ("the tide of kelp", "the", 0.0), (None, "x", None), ("x", None, 0.0)]:
        assert value(metrics.title_soft(lit(a), lit(b))) == want
    assert value(metrics.doi_match(lit("10.5555/A"), lit("https://doi.org/10.5555/a"))) == 1.0 and value(metrics.doi_match(lit(""), lit("x"))) is None
    rng = random.Random(2)
    for _ in range(50):
        a, b = (" ".join(rng.choice("xyz") for _ in range(rng.randint(1, 9))) for _ in "ab")
        table = [[0] * (len(b.split()) + 1) for _ in range(len(a.split()) + 1)]
        for i, x in enumerate(a.split()):
            for j, y in enumerate(b.split()):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert metrics.rouge_l_value(a, b) == 2 * table[-1][-1] / (len(a.split()) + len(b.split()))
    assert metrics.rouge_l_value(None, "x") is None and metrics.rouge_l_value("x " * 1001, "x") is None
    rows = spark.createDataFrame([(1, "gold", "Ada Alder"), (1, "pred", "Ada Aldar"), (1, "gold", "Ben"), (1, "gold", None), (2, "pred", "x")], "id long, side string, item string")
    assert {r["id"]: r["f1"] for r in metrics.fuzzy_f1(rows).collect()} == {1: 0.5, 2: None}
    assert {r["id"]: r["f1"] for r in metrics.set_f1(rows.where("item IS NOT NULL")).collect()} == {1: 0.0, 2: None}


def test_checks(spark):
    bib = "bib_id long, title string, families array<string>, year long, doi string, container string, volume string, issue string, first_page string, last_page string, bib_type string, raw string, et_al boolean"
    rec = "bib_id long, rec_title string, rec_families array<string>, rec_year long, rec_doi string, rec_container string, rec_volume string, rec_issue string, rec_first_page string, rec_last_page string, outcome string, agency string"
    bibs = spark.createDataFrame(
        [
            (1, "Tides of kelp", ["Alder"], 2001, None, "J Kelp", "2", None, "07", None, None, None, None), (2, None, None, None, None, None, None, None, None, None, None, None, None), (3, "Tides", ["Alder"], 1990, None, None, None, None, None, None, "book", "Tides", None),
            (4, "Tides of the kelp: a study", ["Alder", "Birch"], 2001, None, None, None, None, None, None, None, None, True),
        ], bib)
    records = spark.createDataFrame(
        [
            (1, "Tides of Kelp", ["ALDER"], 2001, None, "Journal of Kelp", "2", None, "7", None, "found", None), (1, "Tides of Kelp", ["ALDER"], 2001, None, "Journal of Kelp", "2", None, "7", None, "found", None), (3, "Tides", ["Alder"], 1999, None, None, None, None, None, None, "found", None),
            (4, "Tides of the kelp", ["Alder", "Cedar", "Dorn"], 2001, None, None, None, None, None, None, "found", None),
        ], rec)
    got = {r["bib_id"]: (r["status"], r["notes"]) for r in check.check(bibs, records).collect()}
    assert got == {1: ("matched", []), 2: ("unchecked", []), 3: ("matched", ["year:minor"]), 4: ("matched", [])}
    assert check.check(bibs.where("false"), records).count() == 0


def test_identity_and_citation(spark):
    dois = spark.createDataFrame([(1, "10.5555/A.", "front"), (1, "10.5555/a", "front"), (1, "10.5555/b", "body"), (2, "10.5555/a", "body"), (3, "10.5555/a", "metadata"), (3, "10.5555/b", "metadata"), (4, None, "front"), (5, "x", None)], "paper_id long, doi string, tier string")
    got = {r["paper_id"]: (r["doi"], r["warning"], r["n_printed"]) for r in check.own_doi(dois).collect()}
    assert got == {1: ("10.5555/a", None, 2), 2: (None, None, 1), 3: (None, "VAL_DOI_AMBIGUOUS", 1)}
    papers = spark.createDataFrame([(1, "10.5555/a", "Tides of kelp", "Alder"), (2, None, "Moss", None), (3, None, None, "Elm")], "paper_id long, doi string, title string, family string")
    lines = spark.createDataFrame([(1, 1, "Alder, Tides of Kelp."), (1, 2, "Cite this article as: Alder (2001) Tides of Kelp."), (2, 1, "How to cite: other"), (3, 4, "Citation: Elm A. X."), (3, 5, None)], "paper_id long, line_id long, text string")
    assert sorted(tuple(r) for r in check.printed_citation(papers, lines).collect()) == [(1, 2, "title"), (3, 4, "author")]


def test_lists_are_located(spark):
    s = spark.createDataFrame([(1, 1, "unknown", "References"), (1, 2, "references", "Works"), (1, 3, "references", "More"), (2, 1, "body", "Literatur"), (3, 1, "body", None)], "paper_id long, section_id long, section_type string, header string")
    t = spark.createDataFrame([(1, 1, 1, "no"), (1, 2, 2, "no"), (1, 3, 3, "yes"), (1, 3, 4, "too"), (1, 3, 5, "Publisher's note x"), (1, 3, 6, "off"), (2, 1, 9, "German"), (3, 1, 1, None)], "paper_id long, section_id long, text_id long, text string")
    assert {r["paper_id"]: r["text"] for r in fulltext.reference_sections(t, s).collect()} == {1: "yes\ntoo", 2: "German"}
    assert fulltext.reference_entries(fulltext.reference_sections(t, s).where("false")).count() == 0


def test_front_matter_abstains(spark):
    b = spark.createDataFrame([(1, 1, 1, "heading", "One good long title"), (1, 2, 1, "heading", "Another good long title"), (2, 1, 1, "text", None), (3, 1, 1, "heading", "The only good title"), (3, 2, 1, "heading", "The only good title")], "paper_id long, block_id long, page long, kind string, text string")
    assert {r["paper_id"]: (r["title"], r["rule"]) for r in front.front_matter(b).collect()} == {1: (None, "abstain"), 3: ("The only good title", "only_heading")}
    assert front.abstract_spans(b).count() == 0
    with pytest.raises(KeyError):
        front.apply_model(b, "nothing")


def test_operators_on_nulls_repeats_and_empty_tables(spark):
    """Each takes a table of nulls and repeats, and an empty one, and gives the rows stated here."""
    n = None
    bib = spark.createDataFrame([(1, 1, n, n, n, n, n, n, n), (1, 1, n, n, n, n, n, n, n), (n, n, n, n, n, n, n, n, n)], "bib_id long, paper_id long, doi string, volume string, first_page string, container string, year long, year_suffix string, raw string")
    match = spark.createDataFrame([(1, 1, n, n, n, n, n, n, n), (1, 2, "crossref", 95.0, "10.5555/a", "3", "7", "J", 2001), (n, n, n, n, n, n, n, n, n)], "bib_id long, match_id long, service string, score double, doi string, volume string, first_page string, container string, year long")
    cites = spark.createDataFrame([(1, 1, 2001, ["Alder"]), (1, 2, n, n), (n, n, n, [])], "paper_id long, cite_id long, year long, families array<string>")
    listed = spark.createDataFrame([(1, 5, 2001, ["Alder"]), (1, 6, 2001, ["alder"]), (n, n, n, n)], "paper_id long, bib_id long, year long, families array<string>")
    floats = spark.createDataFrame([(1, 1, "figure", "2", 1), (1, 1, "figure", "2", 1), (n, n, n, n, n)], "paper_id long, float_id long, kind string, label string, page long")
    said = spark.createDataFrame([(1, 1, "figure", "2B"), (1, 2, "figure", n), (n, n, n, n)], "paper_id long, mention_id long, kind string, label string")
    log = spark.createDataFrame([(1, 1, "failed", "E", n, n, n, n, n), (1, 1, "failed", "E", n, n, n, n, n), (n, n, n, n, n, n, n, n, n)], "paper_id long, line_no long, status string, code string, happened timestamp, duration_s double, n_refs long, n_matched long, key long")
    head = spark.createDataFrame([(1, 1, n, n, 1, n), (1, 1, n, n, 1, n), (n, n, "Methods", "methods", n, n)], "paper_id long, section_id long, header string, section_type string, level int, trust int")
    pairs = spark.createDataFrame([(1, n, n), (2, "", "a b"), (3, "a b c d e", "a b c d e")], "id long, gold string, pred string")
    cases = {
        "best_match": (references.best_match, (match,), 1), "consolidate": (references.consolidate, (bib, match), 3), "verify": (references.verify, (bib, match), 0), "author_year": (citations.link_author_year, (cites, listed), 1), "floats": (citations.link_floats, (said, floats), 3),
        "latest": (ledger.latest, (log,), 1), "attempts": (ledger.attempts, (log,), 2), "unsettled": (lambda x: ledger.unsettled(x, F.col("status") == "failed"), (log,), 2), "top": (ledger.top_codes, (log,), 2), "failures": (ledger.failures, (log.withColumn("failed_stage", F.lit(n).cast("string")),), 2),
        "types": (sections.type_sections, (head,), 3), "scopes": (sections.study_scopes, (head,), 3), "unique": (sections.unique_types, (head,), 3), "numbers": (structure.numbered_parents, (head,), 3), "sane": (structure.sane_sections, (head,), 3),
        "parents": (lambda x: sentences.heading_parents(x, "paper_id", "section_id", "level"), (head,), 3), "scores": (metrics.token_scores, (pairs,), 2), "shingles": (metrics.shingle_recall, (pairs,), 3), "duplicates": (lambda x: validation.duplicate_keys(x, "section_id"), (head,), 1),
        "dangling": (lambda a, b: validation.dangling(a, "bib_id", b, "bib_id"), (bib, listed), 1), "coverage": (validation.low_coverage, (bib, said.select("paper_id", F.col("mention_id").alias("target_id"))), 0), "zero": (validation.zero_xrefs, (bib, said.select("paper_id", F.lit(n).cast("long").alias("target_id"))), 2),
        "panels": (structure.merged_panels, (floats.withColumnRenamed("float_id", "figure_id"),), 3), "placeholders": (lambda x: validation.placeholders(x, "header"), (head,), 0), "urls": (lambda x: validation.malformed_urls(x.withColumn("url", F.col("header"))), (head,), 2),
    }
    counts = {name: (run(*tables).count(), run(*(t.where("false") for t in tables)).count()) for name, (run, tables, _) in cases.items()}
    assert counts == {name: (rows, 0) for name, (_, _, rows) in cases.items()}
    assert ledger.report(log.where("false").withColumn("model", F.lit("m"))).count() == 1


def test_references_matched_like_greedy_over_all_pairs(spark):
    rng = random.Random(5)
    row = lambda i: (rng.choice([1, 2, None]), i, rng.choice([None, "10.5555/a", "10.5555/b", "https://doi.org/10.5555/A"]), rng.choice([None, "Tides of kelp and moss", "Tides of kelp and mosses", "Winter birds of winter"]), rng.choice([None, "Alder", "Birch"]), rng.choice([None, 2001, 2002]), "raw: tides of kelp and moss")
    side = lambda at: spark.createDataFrame([row(at + i) for i in range(25)], "id long, ref long, doi string, title string, family string, year long, raw string").repartition(3)
    gold, pred = side(0), side(100)
    want, taken = [], set()
    pairs = check.reference_pairs(gold, pred).collect()
    assert len(pairs) == len({(p["id"], p["gold"], p["pred"]) for p in pairs}) > 60
    for p in sorted(pairs, key=lambda p: (p["id"], -p["score"], p["gold"], p["pred"])):
        if not {(p["id"], p["gold"]), (p["id"], p["pred"])} & taken:
            taken |= {(p["id"], p["gold"]), (p["id"], p["pred"])}
            want.append(tuple(p))
    assert sorted(map(tuple, check.matched_references(gold, pred).collect())) == sorted(want)
    plan = metrics.greedy_match(check.reference_pairs(gold, pred))._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan


def test_outlines_with_repeated_titles(spark):
    n, began = 60_000, time.monotonic()
    outline = spark.range(n).selectExpr("1L AS paper_id", "id AS entry_id", "IF(id = 7, 'Quite another', 'Tides of kelp ' || id % 3) AS title", "id % 2 AS page")
    headings = spark.range(n).selectExpr("1L AS paper_id", "id AS section_id", "'tides of  kelp ' || id % 3 AS header", "id % 4 AS page")
    got = {r["entry_id"]: (r["section_id"], r["similarity"]) for r in structure.outline_headings(outline, headings).collect()}
    assert len(got) == n - 1 and got[0] == (0, 0.9375) and got[1] == (1, 0.9375) and got[8] == (5, 0.9375)
    assert time.monotonic() - began < 60  # pairs of all entries and headings took minutes


def test_numbered_parents_of_long_papers(spark):
    n, began = 300_000, time.monotonic()
    rows = spark.range(n).selectExpr("1L AS paper_id", "id AS section_id", "CASE id % 3 WHEN 0 THEN '1 One' WHEN 1 THEN '1.1 Two' ELSE '1.1.2.1 Three' END AS header")
    got = structure.numbered_parents(rows).where("section_id % 3 > 0").agg(F.count(F.lit(1)), F.count_if(F.col("parent_id") == F.col("section_id") - 1)).first()
    assert tuple(got) == (n * 2 // 3, n * 2 // 3)
    assert time.monotonic() - began < 60  # every heading met all others of its paper that have its prefix
    few = spark.createDataFrame([(1, 1, "1 A"), (1, 1, "1.1 B"), (1, 2, "1.1 C"), (1, 2, "1.1.1 D"), (None, 1, "2 E"), (None, 2, "2.1 F")], "paper_id long, section_id long, header string")
    assert {(r["paper_id"], r["section_id"], r["number"]): r["parent_id"] for r in structure.numbered_parents(few).collect()} == {(1, 1, "1"): None, (1, 1, "1.1"): None, (1, 2, "1.1"): 1, (1, 2, "1.1.1"): 1, (None, 1, "2"): None, (None, 2, "2.1"): None}


@pytest.mark.parametrize("block, most", [(3, 0), (1000, 10**6)])
def test_author_year_against_all_pairs(spark, monkeypatch, block, most):
    monkeypatch.setattr(citations, "BLOCK", block)
    monkeypatch.setattr(citations, "BROADCAST_REFS", most)
    rng = random.Random(7)
    names = lambda: rng.choice([None, [], ["Alder"], ["alder", "Birch"], ["Alder", "Birch"], ["Birch", "Cedar"], ["Alder", None]])
    row = lambda i: (rng.choice([1, 2, None]), i, rng.choice([2001, 2002, None]), names())
    cites, refs = [row(i % 70) for i in range(80)], [row(i) for i in range(60)]
    lead = lambda f: f[0].lower() if f else None
    found = {}
    for p, c, y, f in cites:
        for q, b, z, g in refs:
            if None not in (p, y, lead(f)) and (p, y, lead(f)) == (q, z, lead(g)):
                found.setdefault((p, c), []).append(((len(set(f) & set(g)), -len(g)), b))
    want = [(*k, b, 0.95 if n == 1 else 0.5) for k, v in found.items() for n in [sum(s == max(v)[0] for s, _ in v)] for s, b in v if s == max(v)[0]]
    table = lambda rows, name: spark.createDataFrame(rows, f"paper_id long, {name} long, year long, families array<string>")
    got = citations.link_author_year(table(cites, "cite_id"), table(refs, "bib_id"))
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(want)
    assert citations.link_author_year(table(cites, "cite_id").where("false"), table(refs, "bib_id")).count() == 0


def test_author_year_compares_forms(spark):
    cites = spark.range(30_000).selectExpr("1L AS paper_id", "id AS cite_id", "2001L AS year", "IF(id % 100 = 0, array('Alder', 'Birch', 'Z' || id % 300), array('Alder')) AS families")
    refs = spark.range(30_000).selectExpr("1L AS paper_id", "id AS bib_id", "2001L AS year", "IF(id < 2, array('Alder'), array('Alder', 'Birch')) AS families")
    began = time.monotonic()
    assert citations.link_author_year(cites, refs).where("cite_id % 100 > 0").count() == 29_700 * 2
    assert time.monotonic() - began < 60  # 900,000,000 pairs went through a window


def test_assignment_of_many_and_alike():
    rng, began = random.Random(4), time.monotonic()
    assert len(structure.assign([(a, b, round(rng.uniform(0, 6), 2)) for a in range(200) for b in range(200)])) < 200
    for _ in range(200):
        shapes = [[rng.choice([None, 0.5, 1.0, 1.25, 2.0]) for _ in range(3)] for _ in range(2)]
        lefts, rights = ({i: rng.randint(1, 2) for i in range(k)} for k in (2, 3))
        edges = [(a, b, shapes[a][b]) for a in lefts for b in rights if shapes[a][b]]
        each = [((a, i), (b, j), s) for a, b, s in edges for i in range(lefts[a]) for j in range(rights[b])]
        assert [((a, 0), (b, 0)) for a, b in structure.assign(edges, lefts=lefts, rights=rights)] == structure.assign(each)
    assert time.monotonic() - began < 60  # solved anew without each pair


def test_captions_of_one_place(spark):
    box = "paper_id long, id long, kind string, page long, number long, x0 double, y0 double, x1 double, y1 double"
    at = lambda i, page, number, y: (1, i, "figure", page, number, 0.0, y, 100.0, y + 20.0)
    captions = spark.createDataFrame([at(1, 1, 1, 300.0), at(2, 1, 1, 300.0), at(3, 9, 4, 300.0), at(3, 9, 4, 300.0)], box)
    floats = spark.createDataFrame([at(11, 1, 1, 270.0), at(12, 1, 2, 100.0), at(13, 9, 4, 270.0)], box)
    assert [tuple(r) for r in structure.captions_to_floats(captions, floats).select("caption_id", "float_id").collect()] == [(3, 13)]


@pytest.mark.parametrize("block, close", [(3, 0.97), (2048, 0.9)])
def test_names_matched_like_greedy_over_all_pairs(spark, monkeypatch, block, close):
    from vellumine.functions.fuzzy import jaro_winkler_value

    monkeypatch.setattr(metrics, "BLOCK", block)
    monkeypatch.setattr(metrics, "CLOSE", close)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abc d") for _ in range(rng.randint(1, 7)))
    rows = [(rng.choice([1, 2, 3]), rng.choice(["gold", "pred"]), rng.choice([None, "", word(), word(), word().upper()])) for _ in range(150)] + [(9, "gold", "xbcdefghij"), (9, "pred", "Abcdefghij"), (4, "pred", "x")]
    want = {}
    for k in {r[0] for r in rows}:
        names = [sorted(x[2].lower() for x in rows if x[0] == k and x[1] == s and x[2] is not None) for s in ("gold", "pred")]
        pairs = sorted((-s, i, j) for i, a in enumerate(names[0]) for j, b in enumerate(names[1]) if (s := jaro_winkler_value(a, b)) >= 0.85)
        golds, preds = set(), set()
        for _, i, j in pairs:
            if i not in golds and j not in preds:
                golds.add(i)
                preds.add(j)
        n = [sum(x[0] == k and x[1] == s for x in rows) for s in ("gold", "pred")]
        want[k] = round(2 * len(golds) / sum(n), 6) if n[0] else None
    got = metrics.fuzzy_f1(spark.createDataFrame(rows, "id long, side string, item string"))
    assert {r["id"]: r["f1"] for r in got.collect()} == pytest.approx(want) and want[9] == 1.0


def test_names_of_large_keys(spark):
    n, began = 12_000, time.monotonic()
    names = spark.range(n).selectExpr("1L AS id", "'Person ' || id AS item", "id AS no")
    rows = names.selectExpr("id", "'gold' AS side", "item").union(names.selectExpr("id", "'pred'", "IF(no % 2 = 0, item || 'x', item)"))
    assert [tuple(r) for r in metrics.fuzzy_f1(rows).collect()] == [(1, 1.0)]
    assert time.monotonic() - began < 100  # 144,000,000 pairs were compared in Python


def test_sanity_of_long_papers(spark):
    n, began = 200_000, time.monotonic()
    rows = spark.range(n).selectExpr("1L AS paper_id", "id AS section_id", "CASE WHEN id = 5 THEN 'references' WHEN id = 9 THEN 'abstract' WHEN id % 7 = 0 THEN NULL ELSE 'methods' END AS section_type")
    assert {r["section_id"] for r in structure.sane_sections(rows).where("section_type = 'unknown'").collect()} == {5, 9}
    assert time.monotonic() - began < 60  # what comes after was summed anew for every section
    few = spark.createDataFrame([(1, 1, "references"), (1, 2, "results"), (1, 3, None), (1, 4, None), (2, 1, "references"), (2, 2, None), (2, 3, None)], "paper_id long, section_id long, section_type string")
    assert [r["section_type"] for r in structure.sane_sections(few).orderBy("paper_id", "section_id").collect()] == ["unknown", "results", None, None, "references", None, None]


def test_characters_of_equal_places(spark):
    n, began = 40_000, time.monotonic()
    links = spark.range(n).selectExpr("id AS link_id", "1L AS page_id", "id % 3 AS x0", "0L AS y0", "IF(id = 0, NULL, 9L) AS x1", "9L AS y1").repartition(4)
    chars = spark.range(n).selectExpr("id AS char_id", "1L AS page_id", "id % 10 AS x", "5.0D AS y")
    got = structure.covered_counts(links, chars).groupBy("n").count().collect()
    assert {r["n"]: r["count"] for r in got} == {n: 13_333, n * 9 // 10: 13_333, n * 8 // 10: 13_333}
    assert time.monotonic() - began < 60  # each link met each character of its page
    few = links.where("link_id < 9").union(links.where("link_id = 4")), chars.where("char_id < 20")
    assert sorted(map(tuple, structure.covered_counts(*few).collect())) == sorted(map(tuple, structure.covered_chars(*few).groupBy("link_id").count().collect()))


def test_heading_keys_are_worked_out_once(spark):
    head = spark.createDataFrame([(1, 1, "2. Materials and Methods"), (1, 2, "A B S T R A C T"), (1, 3, "Summary of results"), (1, 4, None)], "paper_id long, section_id long, header string")
    typed = sections.type_sections(head)
    assert [(r["section_type"], r["score"]) for r in typed.orderBy("section_id").collect()] == [("methods", 1.0), ("abstract", 1.0), ("abstract", 0.95), ("unknown", 0.0)]
    assert "lambdafunction" not in typed._jdf.queryExecution().optimizedPlan().toString()


def test_gates_count_words_once(spark):
    texts = [(1, "kelp and moss 1 2"), (1, "kelp own"), (2, "moss Own2 alone"), (None, "alone tides"), (3, None), (4, "x - 1")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r["doc_id"], r["letters"]): (r["known"], r["passes"]) for r in front.text_gates(docs).collect()}
    assert {k[0] for k in got} == {1, 2, 3, 4, None} and len(got) == 6
    # Text 1: kelp, and, moss, kelp, own; only moss and own are in text 2. Text 2: alone is in the text without a key.
    assert {v for k, v in got.items() if k[0] == 1} == {(0.4, True)} and got[2, 0.923077] == (1.0, True)
    assert all(not v[1] and v[0] is None for k, v in got.items() if k[0] in (3, 4, None))
    assert front.text_gates(docs)._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert front.text_gates(docs.where("false")).count() == 0
