import random

from vellumine.functions import fuzzy
from vellumine.operators import references
from vellumine.plans import registry

BIB = "{0} long, title string, year long, doi string, families array<string>, volume string, first_page string, container string"


def brute(bibs, works, least=80.0):
    out = {}
    for i, title, year, doi, families, volume, page, container in bibs:
        found = []
        for j, t, y, d, fam, vol, first, cont in works:
            gap = None if year is None or y is None else abs(year - y)
            if doi:
                score = 100.0 if d == doi and (gap or 0) <= 1 else 0.0
            elif fuzzy.sorted_tokens(title):
                known = fuzzy.sorted_tokens(t)
                score = fuzzy.indel_ratio(fuzzy.sorted_tokens(title), known) if known else 0.0
                score *= (0.5 if (gap or 0) > 2 else 1.0) * (0.7 if families and fam and not set(families) & set(fam) else 1.0)
            else:
                ok = families and fam and families[0] == fam[0] and volume and volume == vol and gap is not None and gap <= 1 and (not page or not first or page == first)
                score = 0.0 if not ok else fuzzy.indel_ratio(*map(fuzzy.sorted_tokens, (container, cont))) if container and cont else 85.0 if page and first else 0.0
                score = score if score >= 85 else 0.0
            if score >= least:
                found.append((-score, j))
        if found:
            out[i] = (min(found)[1], round(-min(found)[0], 6))
    return out


def altered(rng, title):
    for _ in range(rng.randint(0, 5)):
        at = rng.randrange(len(title) + 1)
        title = rng.choice([title[:at] + title[at + 1 :], title[:at] + rng.choice("aeo- ") + title[at:], title[:at] + "x" + title[at + 1 :]])
    return title


def test_registry_against_brute_force(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    titles = [" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(60)] + ["ab", "a", "abcd", "", None, "Étude à part"]
    row = lambda i, title: (i, title, rng.choice([None, 2000, 2001, 2004]), rng.choice([None] * 6 + ["10.1000/a", "10.1000/b"]), rng.choice([None, ["smith"], ["jones", "smith"], ["brown"]]), rng.choice([None, "1", "1", "2"]), rng.choice([None, "7", "9"]), rng.choice([None, "annals of words", "annals of word", "other"]))
    works = [row(i, t) for i, t in enumerate(titles * 2)] + [row(1000 + i, None) for i in range(40)]
    bibs = [row(i, rng.choice([altered(rng, t), t.upper(), "-".join(t.split())]) if t else t) for i, t in enumerate(titles * 16)] + [row(5000 + i, "") for i in range(60)]
    got = references.match_registry(spark.createDataFrame(bibs, BIB.format("bib_id")), spark.createDataFrame(works, BIB.format("work_id"))).collect()
    want = brute(bibs, works)
    assert {r["bib_id"]: (r["work_id"], r["score"]) for r in got} == want and len(got) == len(want)
    kinds = [b for b in bibs if b[0] in want]
    assert any(b[3] for b in kinds) and any(not b[1] and not b[3] for b in kinds) and sum(w[1] < 100 for w in want.values()) > 50


def test_typo_in_the_longest_word(spark):
    b = spark.createDataFrame([(1, "Measurment of tides", 2000), (2, "Self-regulation in class", 2000)], "bib_id long, title string, year long")
    w = spark.createDataFrame([(7, "Measurement of tides", 2001), (8, "Selfregulation in class", 2000)], "work_id long, title string, year long")
    assert {r["bib_id"]: r["work_id"] for r in references.match_registry(b, w).collect()} == {1: 7, 2: 8}


def test_doi_without_case(spark):
    b = spark.createDataFrame([(1, "x", 2000, "https://doi.org/10.1000/ABC"), (2, "x", 2003, "10.1000/abc")], "bib_id long, title string, year long, doi string")
    w = spark.createDataFrame([(7, "other words", 2001, "10.1000/abC")], "work_id long, title string, year long, doi string")
    assert [tuple(r) for r in references.match_registry(b, w).collect()] == [(1, 7, 100.0)]


def test_registry_holds_all_parts(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").collect()
    bibs = [(p["p_partkey"], f"{p['p_name']} a study of {p['p_type']}", 2000 + p["p_size"] % 9, *[None] * 5) for p in parts]
    works = [(p["p_partkey"], f"A Study of {p['p_type']} {p['p_name']}", 2004, *[None] * 5) for p in parts]
    got = registry.QUERIES["registry_match"](spark, sf_dir).collect()
    assert {r["bib_id"]: (r["work_id"], r["score"]) for r in got} == brute(bibs, works)
