"""Whole-text kernels on printed forms and awkward ones."""

import time

import pytest

from vellumine.functions import citation_text, front_text, links, names, reference_text, scan_text, statements, unicode


def who(text):
    return [(n["family"], n["given"], n["literal"]) for n in names.split_names(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Alder, A. B., & Birch, C.", [("Alder", "A. B.", None), ("Birch", "C.", None)]),
        ("Alder AB, van Birch C", [("Alder", "AB", None), ("van Birch", "C", None)]),
        ("Alder, Ada, and Ben Birch", [("Alder", "Ada", None), ("Birch", "Ben", None)]),
        ("Alder, Ada B., Ben Birch, and Cleo Cedar", [("Alder", "Ada B.", None), ("Birch", "Ben", None), ("Cedar", "Cleo", None)]),
        ("A. Alder and B. de la Birch", [("Alder", "A.", None), ("de la Birch", "B.", None)]),
        ("Alder, A.; Birch, Ben; et al.", [("Alder", "A.", None), ("Birch", "Ben", None)]),
        ("Alder, J.-P., Jr., & Birch, B.", [("Alder", "J.-P. Jr.", None), ("Birch", "B.", None)]),
        ("Alder, A. (Eds.)", [("Alder", "A.", None)]),
        ("World Kelp Organization", [(None, None, "World Kelp Organization")]),
        ("a lower case thing", [(None, None, "a lower case thing")]),
        ("", []), (None, []), (" ; , ", []),
    ],
)
def test_names(text, want):
    assert who(text) == want


def test_families():
    assert names.families("Alder, A., & Birch, B.") == ["Alder", "Birch"] and names.families("the Kelp Organization") == ["Kelp"] and names.families(None) == []


def test_references_of_other_kinds():
    book = reference_text.parse("Alder, A. (1999). Tides [Map]. New York: Wiley.")
    assert (book["title"], book["publisher"], book["bib_type"], book["repairs"]) == ("Tides", "Wiley", "book", ["medium_in_title"])
    web = reference_text.parse("Kelp Organization. (2020). Report. https://who.example/x")
    assert (web["authors"][0]["literal"], web["url"], web["bib_type"]) == ("Kelp Organization", "https://who.example/x", "web-page")
    page = reference_text.parse("[3] Alder, A. (2001a). T one. J Kelp, 2(1), 1267–89. doi:10.5555/ABC.")
    assert (page["label"], page["year_suffix"], page["first_page"], page["last_page"], page["doi"]) == ("3", "a", "1267", "1289", "10.5555/abc")
    for blank in ("", None, "   "):
        assert not any(v for k, v in reference_text.parse(blank).items() if k != "bib_type")


def test_segments_lose_nothing():
    votes = "Alder, A. (2001). A title that\nruns on. J Kelp, 1, 2-3.\nBirch, B., & Cedar, C. (2002). Other\nthings. Wiley."
    got = reference_text.segments(votes)
    assert [g["text"] for g in got] == ["Alder, A. (2001). A title that runs on. J Kelp, 1, 2-3.", "Birch, B., & Cedar, C. (2002). Other things. Wiley."]
    assert " ".join(g["text"] for g in got).split() == votes.split()
    marked = reference_text.segments("lead\n[1] One. x\nmore\n[2] Two. y\n2001. z\n[7] odd")
    assert [(g["text"], g["strategy"]) for g in marked] == [("lead", "lead"), ("[1] One. x more", "numbered"), ("[2] Two. y 2001. z [7] odd", "numbered")]
    assert reference_text.segments(None) == reference_text.segments("") == []


def test_lists_of_more_than_999_entries():
    entry = "Alder, A. ({}). A title of a work. J Kelp, 1, 2-3."
    for mark in ("[{}] ", "{}. "):
        lines = [mark.format(n) + entry.format(1990 + n % 30) for n in range(1, 2104)]
        got = reference_text.segments("\n".join([*lines, "1998. What runs on."]))
        assert [g["text"] for g in got] == [*lines[:-1], lines[-1] + " 1998. What runs on."] and {g["strategy"] for g in got} == {"numbered"}
        assert reference_text.segmentation_quality(lines, True) == 1.0
    assert reference_text.split_merged("[1000] Alder, A. One. [1001] Birch, B. Two, [1999] Three.", True) == ["[1000] Alder, A. One.", "[1001] Birch, B. Two, [1999] Three."]
    assert reference_text.parse("[1000] Alder, A. (2001). T one. J Kelp, 2(1), 7-9.")["label"] == "1000"
    assert [g["text"] for g in reference_text.segments("9" * 5000 + ". x")] == ["9" * 5000 + ". x"]


def test_merged_references():
    paren = "Alder, A. B. (1999). First. Wiley. Birch, C. (2003). Second. Sage."
    assert reference_text.split_merged(paren) == ["Alder, A. B. (1999). First. Wiley.", "Birch, C. (2003). Second. Sage."]
    assert reference_text.split_merged(paren, numbered=True) == [paren]
    assert reference_text.split_merged("[1] One. 2001. [2] Two. 2002.") == ["[1] One. 2001.", "[2] Two. 2002."]
    assert reference_text.split_merged("Alder, A., 1999. First. Wiley. Birch, C., 2003. Second.") == ["Alder, A., 1999. First. Wiley.", "Birch, C., 2003. Second."]
    assert reference_text.split_merged(None) == [""] and reference_text.typical_length([]) is None and reference_text.segmentation_quality([]) is None


def test_links():
    found = links.find_links("see (https://osf.io/ab(1)). and http://a.bhttp://c.d/e, osf.io/xy1 10.5555/abc. mail a@x.com/foo http://r.org/?u=http://z.org www. end")
    assert [(x["url"], x["kind"]) for x in found] == [("https://osf.io/ab(1)", "scheme"), ("http://a.b", "scheme"), ("http://c.d/e", "scheme"), ("osf.io/xy1", "host"), ("https://doi.org/10.5555/abc", "doi"), ("http://r.org/?u=http://z.org", "scheme")]
    assert [x["kind"] for x in links.find_links("osf.io/x https://a.b", bare=False)] == ["scheme"]
    assert links.find_links(None) == links.find_links("") == []


def test_citations():
    text = "As Alder and Birch (2001, 2003a) say [3-5, 9], kelp grows.^{2,3} (see Dorn, 2004; Elm & Fenn, 2005a, b) 95% CI [1, 2], x^2 word.⁴⁻⁶ f(7)"
    got = [(c["style"], c["numbers"] or (c["families"], c["year"], c["suffix"]), c["reason"]) for c in citation_text.citations(text)]
    assert got == [
        ("narrative", (["Alder", "Birch"], 2001, None), None), ("narrative", (["Alder", "Birch"], 2003, "a"), None), ("bracket", [3, 4, 5, 9], None), ("superscript", [2, 3], None), ("author_year", (["Dorn"], 2004, None), None),
        ("author_year", (["Elm", "Fenn"], 2005, "a"), None), ("author_year", (["Elm", "Fenn"], 2005, "b"), None), ("bracket", [1, 2], "statistic_context"), ("superscript", [2], "math_superscript"), ("superscript", [4, 5, 6], None), ("round", [7], "non_citation_bracket"),
    ]
    assert citation_text.strip_superscripts("Kelp.^{1,2} Moss<sup>9</sup> x^2", 5) == {"text": "Kelp. Moss<sup>9</sup> x^2", "anchors": [{"at": 5, "numbers": [1, 2]}]}
    assert citation_text.citations(None) == [] and citation_text.strip_superscripts(None)["text"] == ""


def test_mentions():
    got = [(m["kind"], m["label"]) for m in citation_text.mentions("Figs. 1a, 2 and 4–6, Table S1, Eq. (3), Sections 2.1 and 3, Appendix B, table a, Figure 9-7, Equations 5-2, Fig. 1-99")]
    assert got == [("figure", "1a"), ("figure", "2"), ("figure", "4"), ("figure", "5"), ("figure", "6"), ("table", "S1"), ("equation", "3"), ("section", "2.1"), ("section", "3"), ("supplement", "B"), ("figure", "9"), ("figure", "7"), ("figure", "1"), ("figure", "99")]


def test_statistics():
    got = [(s["name"], s["df"], s["comparator"], s["value"] or (s["low"], s["high"]), s["group"]) for s in citation_text.statistics_in("t(28) = 3.42, p < .001, d = 0,65, 95% CI [.1, .2], and (F(1, 30) = 4.1; p = 2.3 × 10−5), N = 1,234, M = 3–5, R² ≥ .5")]
    assert got == [
        ("t", "28", "=", "3.42", 0), ("p", None, "<", "0.001", 0), ("d", None, "=", "0.65", 0), ("95% CI", None, "=", ("0.1", "0.2"), 0), ("F", "1, 30", "=", "4.1", 1), ("p", None, "=", "2.3e-5", 1), ("N", None, "=", "1234", 2), ("M", None, "=", ("3", "5"), 2), ("R²", None, ">=", "0.5", 2),
    ]
    assert citation_text.statistics_in(None) == citation_text.statistics_in("no number = at all") == []


def test_funding_and_affiliations():
    pairs = lambda t: [(f["funder"], f["award"]) for f in front_text.funding(t)]
    assert pairs("Supported by the National Kelp Foundation (NKF) under grant no. BCS-12 and by the Moss Research Council.") == [("National Kelp Foundation", "BCS-12"), ("Moss Research Council", None)]
    assert pairs("Funded by grant 12345 from the Tide Trust and grants AB-1, AB-22 from the Kelp Commission.") == [("Tide Trust", "12345"), ("Kelp Commission", "AB-1"), ("Kelp Commission", "AB-22")]
    assert pairs("grant 99X") == [(None, "99X")] and pairs("") == pairs(None) == pairs("We thank all.") == []
    a = front_text.affiliation("1 Department of Botany, University of Kelp, 1012 AB Tideham, The Netherlands")
    assert a == {"department": "Department of Botany", "institution": "University of Kelp", "city": "Tideham", "region": None, "country": "The Netherlands"}
    assert front_text.affiliation("ACME")["institution"] == "ACME" and front_text.affiliation(" ") is None and front_text.affiliation(None) is None


def test_contacts_and_titles():
    got = front_text.contacts("Ada Alder, Ben Birch. Corresponding: a.alder@x.org; b@y.org 0000-0001-2345-6789", ["Ada Alder", "Ben Birch", None])
    assert [(c["author"], c["email"], c["orcid"], c["corresponding"]) for c in got] == [("Ada Alder", "a.alder@x.org", None, True), ("Ben Birch", "b@y.org", "https://orcid.org/0000-0001-2345-6789", False)]
    assert front_text.contacts(None, None) == []
    assert front_text.title_parts("Is kelp blue? A study at 12:30 *†") == {"title": "Is kelp blue?", "subtitle": "A study at 12:30", "marks": "*†"}
    assert front_text.title_parts(None) == {"title": None, "subtitle": None, "marks": None}
    assert front_text.salvage_json('```json\n{"b": [1, 2, {"c": "x"}], "a": "unfin') == '{"b":[1,2,{"c":"x"}]}' and front_text.salvage_json("none") is front_text.salvage_json(None) is None


def test_statements():
    rows = lambda *x: [{"text": t, "section": 1, "paragraph": p, "section_type": k} for t, p, k in x]
    got = statements.scan(rows(("Kelp grows.", 1, None), ("This was supported by the Tide Trust.", 2, None), ("It had no role.", 2, None), ("The authors declare no conflict of interest.", 2, None), ("supported by words only", 3, None), ("Data are openly available at x.", 4, "references")))
    assert [(s["field"], s["text"]) for s in got] == [("funding", "This was supported by the Tide Trust. It had no role."), ("coi", "The authors declare no conflict of interest.")]
    assert statements.scan(rows(("Funding", 1, None), ("None was received.", 1, None)))[0]["rule"] == "label" and statements.scan(rows(("Funding", 1, None), ("Else", 2, None))) == []
    assert statements.scan(rows(("Ethics", 1, "ethics"), ("It was approved.", 1, "ethics")))[0]["source"] == "section" and statements.scan(None) == []


def test_cleaning():
    assert unicode.unwrap_value(r"\textbf{a \emph{b} {c}} costs $5 and $x_1$ \% {k}") == "a b c costs $5 and x_1 % {k}"
    assert unicode.repair_value("co-\noperate ﬁn at https://x.org/\nabc 10.5555/\nxyz\n next") == "cooperate fin at https://x.org/abc 10.5555/xyz next"
    assert unicode.clean_late_value("A&amp;B **bold** see https://x.org/*a*_b name†,2^{1}") == "A&B bold see https://x.org/*a*_b name,2"
    assert unicode.heading_value("**2.1Methods** .") == "2.1 Methods" and unicode.heading_value("R E S U L T S") == "RESULTS" and unicode.heading_value("Draft") == "Draft"
    assert unicode.squash_value("Straße Œuvre ﬁ") == "strasseoeuvrefi"


def test_token_tables_and_regions():
    assert scan_text.otsl("<ched>A<lcel><nl><fcel>1<fcel>2<nl>") == {"rows": [["A", "A"], ["1", "2"]], "complete": True, "html": '<table><tr><th colspan="2">A</th></tr><tr><td>1</td><td>2</td></tr></table>'}
    assert not scan_text.otsl("<fcel>1<fcel>2<nl><fcel>3")["complete"] and scan_text.otsl("text") is scan_text.otsl(None) is None
    assert scan_text.tidy_reading("```\n• a\n• a\nb\n```") == "- a\nb" and scan_text.tidy_reading(None) is None
    got = scan_text.merged_regions(["formula", "formula_number", "text", "text", "text"], ["x = 1", "(3)", "It is bro-", "ken here.", "New"])
    assert [(r["text"], r["parts"]) for r in got] == [("x = 1 (3)", 2), ("It is broken here.", 2), ("New", 1)] and scan_text.merged_regions(None, None) == []


@pytest.mark.parametrize("unit", ["Aa, ", "( ", "[1, ", "a@", "10.5555/x ", "Alder, A., ", "Fig. 1, ", " ", "p = .", "grant 1a, ", "The Kelp ", "http://a.b/"])
def test_long_runs_take_no_long(unit):
    text = unit * (60_000 // len(unit))
    began = time.time()
    for run in (links.find_links, citation_text.citations, citation_text.mentions, citation_text.statistics_in, front_text.funding, front_text.affiliation, names.split_names, reference_text.segments, reference_text.parse, unicode.repair_value, unicode.clean_late_value, front_text.title_parts):
        run(text)
        assert time.time() - began < 20, run.__name__


def test_mentions_are_not_read_from_addresses():
    labels = lambda t: [(m["kind"], m["label"]) for m in citation_text.mentions(t)]
    assert labels("er figa.20@mail9.example.com and fig.2@mail.example, see Fig. 3, b.4@mail.example") == [("figure", "3")]
    assert labels("figa.20 taba1 Figs3 Fig. S2 Tab. A.4 fig.7") == [("figure", "3"), ("figure", "S2"), ("table", "A.4"), ("figure", "7")]


def test_quality_of_numbered_lists_of_any_length(spark):
    from vellumine.operators import fulltext

    lines = [f"{n}. Alder, A. ({1990 + n % 30}). A title of a work. J Kelp, 1, 2-3." for n in range(1, 1103)]
    got = fulltext.list_quality(fulltext.reference_entries(spark.createDataFrame([(1, "\n".join(lines))], "paper_id long, text string"))).collect()
    assert [(r["n_entries"], r["quality"]) for r in got] == [(1102, 1.0)]


def test_arrow_batches_are_bounded(spark):
    from pyspark.sql import functions as F

    from vellumine.functions import arrow, fuzzy
    from vellumine.operators import fulltext
    from vellumine.sources import html

    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.createDataFrame([(1, "see https://a.example/x")], "page_id long, html string")
    for use in (lambda: fulltext.find_links("html"), lambda: unicode.nfc("html"), lambda: fuzzy.ratio("html", "html"), lambda: html.read_pages(docs)):
        for key in keys:
            spark.conf.unset(key)
        use()
        assert [spark.conf.get(k) for k in keys] == [str(arrow.BATCH_ROWS), str(arrow.BATCH_BYTES)]
    spark.conf.set(keys[0], "100")
    assert docs.select(F.size(fulltext.find_links("html")).alias("n")).first()["n"] == 1 and spark.conf.get(keys[0]) == "100"
    spark.conf.unset(keys[0])
    for plain in ("{a} } $x$ {", "a {b"):
        assert unicode.unwrap_value(plain) == plain.replace("$", "")
    assert unicode.unwrap_value(r"{\emph{a {b} c}} \% {") == "{a b c} % {".replace("{a", "{a")


def test_dates_are_read_where_four_digits_are(spark):
    from vellumine.functions import dates
    from vellumine.functions import text as T

    printed = ["2020-05-01", "12 May 2020", "٢٠٢٠", "no 123", "x 12345 y", "Published 1 May 2019, 2 June 2020", None, "", " 1999 ", "𝟐𝟎𝟐𝟎-05", "May 20"]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(printed)], "i long, printed string")
    got = rows.select("i", T.iso_date(rows["printed"]).alias("iso"))
    assert [r["iso"] for r in got.orderBy("i").collect()] == [dates.iso_date_value(p) for p in printed]
    assert "RLIKE" in got._jdf.queryExecution().optimizedPlan().toString()


def test_roles_are_not_lost_by_their_stems(spark):
    import random
    import re

    from vellumine.functions import text as T

    def printed(pattern):
        """One of the texts that a pattern of plain alternatives finds."""
        pattern = re.sub(r"\[\\s–—-\]\+", lambda _: rng.choice(["-", " ", " – "]), pattern).replace("\\b", "").replace("\\w*", "ed").replace("\\s+", " ")
        while m := re.search(r"\(\?:([^()]*)\)(\??)", pattern):
            pattern = pattern[: m.start()] + rng.choice(m[1].split("|") + [""] * bool(m[2])) + pattern[m.end() :]
        return re.sub(r"\[(\w+)\]", lambda m: rng.choice(m[1]), pattern).replace("s?", "s")

    rng = random.Random(8)
    made = []
    for slug, words in T.CREDIT:
        depth, parts, at = 0, [], 0
        for i, c in enumerate(words + "|"):
            depth += (c == "(") - (c == ")")
            if c == "|" and not depth:
                parts.append(words[at:i])
                at = i + 1
        for part in parts:
            for _ in range(30):
                t = printed(part)
                assert re.search(words, t), (slug, part, t)
                made.append((slug, f"They {t} it"))
    got = spark.createDataFrame(made, "slug string, printed string")
    got = got.select("slug", "printed", T.credit_roles(got["printed"]).alias("roles")).collect()
    assert [(r["slug"], r["printed"]) for r in got if r["slug"] not in r["roles"]] == []
    assert all(r["roles"] == [s for s, w in T.CREDIT if re.search(w, r["printed"].lower())] for r in got)
    assert set(T.STEMS) == {s for s, _ in T.CREDIT}
