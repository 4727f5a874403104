from pathlib import Path

README = (Path(__file__).resolve().parent.parent / "README.md").read_text()


def test_absent_survey_items_are_listed():
    part = README.split("## Not covered yet")[1].split("## Corpus operators")[0]
    ids = "T23 J12 J14 J18 J19 W3 W11 W12 W13 A21 A27 VAL_PLACEHOLDER AUTHOR_BLANK EMPTY_EQ URL_MALFORMED TITLE_GENERIC UNICODE_CANONICAL ABSTRACT_MISSING ABSTRACT_SUSPECT APPENDIX_NESTING PANEL_CAPTION XREF_ZERO STATEMENT_ORPHAN"
    assert [i for i in ids.split() if i not in part] == []


def test_arbitrary_pairs_are_named():
    assert "The pairs of `passage_scores` and `passage_shingles` are arbitrary" in README
