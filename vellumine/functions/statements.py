"""Statements of funding, conflicts of interest, ethics and data among a paper's sentences."""

from __future__ import annotations

import re

FIELDS = ("funding", "coi", "ethics", "data")
STATEMENT = "array<struct<field:string,text:string,first:int,last:int,source:string,rule:string>>"
#: What opens a statement of each field in running text.
ANCHORS = {
    "funding": re.compile(r"\b(?:funded by|financial(?:ly)? support(?:ed)?|supported (?:in part )?by|funding (?:for|from|was|:)|grant (?:from|no|number)|received no (?:specific |external )?(?:grant|funding)|no (?:external |specific )?funding)", re.IGNORECASE),
    "coi": re.compile(r"\b(?:conflicts? of interests?|competing (?:financial )?interests?|declaration of interest|(?:potential )?conflicts? to (?:declare|disclose))\b", re.IGNORECASE),
    "ethics": re.compile(r"\b(?:ethic(?:s|al) (?:approval|committee|review|board|statement)|institutional review board|IRB\b|(?:declaration|principles) of helsinki|informed consent|approved by the .{0,60}(?:committee|board))", re.IGNORECASE),
    "data": re.compile(r"\b(?:data (?:and materials? |that support .{0,40})?(?:are|is|can be|will be) .{0,30}(?:available|accessed|found|obtained)|data availability|openly available|available (?:on|upon) (?:reasonable )?request|deposited (?:in|at|on))", re.IGNORECASE),
}
#: A statement declares something: one of these stands in it.
DECLARES = re.compile(r"\b(?:was|were|is|are|has|have|had|declares?|received|supported|funded|approved|obtained|gave|provided|none|no|not)\b", re.IGNORECASE)
_FUNDER_HINT = re.compile(r"\b(?:(?i:grants?|awards?|foundation|council|agency|ministry|institutes?|fund|trust|society|university|programme|program|commission|fellowship|scholarship)|[A-Z]{3,})\b")
_LABELS = {
    "funding": re.compile(r"^\W*(?:funding|financial support)(?: statement| information)?\W*$", re.IGNORECASE), "coi": re.compile(r"^\W*(?:conflicts? of interests?|competing interests?|declaration of interests?)(?: statement)?\W*$", re.IGNORECASE),
    "ethics": re.compile(r"^\W*ethic(?:s|al approval)(?: statement)?\W*$", re.IGNORECASE), "data": re.compile(r"^\W*data (?:and materials? )?availability(?: statement)?\W*$", re.IGNORECASE),
}
_BOUNDARY = re.compile(r"^(?:©|copyright\b|publisher['’]?s? note|references?$|received:?\s)", re.IGNORECASE)
#: Section types that a field's statement is headed by.
SECTIONS = {"funding": "funding", "coi": "coi", "ethics": "ethics", "data": "data_availability"}


def _qualifies(field: str, text: str, after: str = "") -> bool:
    if _LABELS[field].match(text):
        return bool(after) and bool(DECLARES.search(after))
    m = ANCHORS[field].search(text)
    if not m:
        return False
    if field == "funding" and "supported" in m[0].lower() and not _FUNDER_HINT.search(text[m.end() :]):
        return False
    return bool(DECLARES.search(text))


def scan(sentences: list[dict] | None) -> list[dict]:
    """At most one statement per field from sentences (text, section, paragraph, section_type) in reading order.

    A section that is headed by the field gives its whole text; else the first sentence outside the references that
    qualifies, with up to two that follow it in its paragraph and neither qualify for another field nor bound the matter.
    """
    rows = sentences or []
    out = []
    for field in FIELDS:
        own = [i for i, s in enumerate(rows) if s["section_type"] == SECTIONS[field] and (s["text"] or "").strip()]
        if own and any(DECLARES.search(rows[i]["text"]) for i in own):
            section = [i for i in own if rows[i]["section"] == rows[own[0]]["section"]]
            out.append({"field": field, "text": " ".join(rows[i]["text"] for i in section), "first": section[0], "last": section[-1], "source": "section", "rule": "headed_section"})
            continue
        for i, s in enumerate(rows):
            text = s["text"] or ""
            after = rows[i + 1]["text"] or "" if i + 1 < len(rows) and _same(s, rows[i + 1]) else ""
            if s["section_type"] == "references" or not _qualifies(field, text, after):
                continue
            last = i
            for j in range(i + 1, min(i + 3, len(rows))):
                follows = rows[j]["text"] or ""
                if not _same(s, rows[j]) or _BOUNDARY.match(follows) or any(_qualifies(f, follows) for f in FIELDS if f != field):
                    break
                last = j
            out.append({"field": field, "text": " ".join(r["text"] or "" for r in rows[i : last + 1]), "first": i, "last": last, "source": "scan", "rule": "label" if _LABELS[field].match(text) else "anchor"})
            break
    return out


def _same(a: dict, b: dict) -> bool:
    return a["section"] == b["section"] and a["paragraph"] == b["paragraph"]
