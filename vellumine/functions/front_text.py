"""Front matter in text: affiliations, funding, contacts, the paper's own DOI and citation, titles and notes."""

from __future__ import annotations

import json
import re

from .links import Taken

#: Countries whose names end affiliations oftenest, from the list of United Nations members, with common short forms.
COUNTRIES = frozenset(
    "argentina australia austria belgium brazil canada chile china colombia croatia czechia denmark egypt england estonia finland france germany ghana greece hungary iceland india indonesia iran ireland israel italy japan kenya "
    "latvia lithuania luxembourg malaysia mexico morocco netherlands nigeria norway pakistan peru philippines poland portugal romania russia scotland serbia singapore slovakia slovenia spain sweden switzerland taiwan thailand tunisia "
    "turkey uganda ukraine uk usa vietnam wales".split()
) | {"costa rica", "czech republic", "hong kong", "new zealand", "north macedonia", "saudi arabia", "south africa", "south korea", "sri lanka", "the netherlands", "united arab emirates", "united kingdom", "united states", "united states of america"}
_INSTITUTION = re.compile(r"\b(?:universit\w*|institut\w*|college|academy|hospital|clinic|school of|polytechnic\w*|eth|centre|center|laborator\w*|foundation|council|agency|museum)\b", re.IGNORECASE)
_UNIVERSITY = re.compile(r"\b(?:universit\w*|college|polytechnic\w*|academy)\b", re.IGNORECASE)
_UNIT = re.compile(r"\b(?:department|dept|division|faculty|school|section|unit|chair|group|laborator\w*|centre|center)\b", re.IGNORECASE)
AFFILIATION = "struct<department:string,institution:string,city:string,region:string,country:string>"
FUNDING = "array<struct<funder:string,award:string>>"


def _outside(text: str, marks: str = ",;") -> list[str]:
    """Pieces between marks that stand in no bracket."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([") - (c in ")]" and depth > 0)
        if c in marks and not depth:
            out.append(text[at:i])
            at = i + 1
    return [p.strip() for p in (*out, text[at:]) if p.strip()]


def affiliation(text: str | None) -> dict | None:
    """Department, institution, city, region and country of a printed affiliation; null for a null or blank one.

    The country is the last piece that is one; the institution the last piece named like a university, else like any
    institution, else the first; the city the first piece behind it without digits; what stands before is the department.
    """
    pieces = _outside(re.sub(r"^[\s\d*†‡§,]+|\.$", "", (text or "").strip()))
    if not pieces:
        return None
    out = dict.fromkeys(("department", "institution", "city", "region", "country"))
    if len(pieces) > 1 and pieces[-1].strip(". ").lower() in COUNTRIES:
        out["country"] = pieces.pop().strip(". ")
    places = [i for i, p in enumerate(pieces) if _UNIVERSITY.search(p)] or [i for i, p in enumerate(pieces) if _INSTITUTION.search(p) and not _UNIT.match(p)] or [0]
    at = places[-1]
    out["institution"], out["department"] = pieces[at], ", ".join(pieces[:at]) or None
    rest = [p for p in (re.sub(r"^(?:[A-Z]{1,2}-)?\d[\d-]*\s*(?:[A-Z]{2}\s)?|(?:\s+|^)(?:[A-Z]{1,2})?\d[\w -]*$", "", p).strip() for p in pieces[at + 1 :]) if p]
    plain = [p for p in rest if not _UNIT.search(p)]
    out["city"], out["region"] = (plain[0] if plain else None), (plain[1] if len(plain) > 1 else None)
    return out


_AWARD = re.compile(r"\b(?:(?:grants?|awards?|projects?|contracts?)\s*(?:agreements?\s*)?(?:nos?\.?|numbers?|ids?|#)?\s*:?\s*)((?=[\w/.-]*\d)[\w][\w/.-]*\w)((?:\s*(?:,|and|&)\s*(?=[\w/.-]*\d)[\w][\w/.-]*\w)*)|\(((?=[\w/.-]*\d)[A-Z0-9][\w/.-]{3,}\w)\)", re.IGNORECASE)
_CAP = r"[A-ZÀ-Þ][\w'’&.-]*"
_FUNDER = re.compile(rf"\b(?:the\s+)?((?:{_CAP}\s+){{0,10}}(?:{_CAP})(?:\s+(?:of|for|de|der|and|für|on)\s+(?:the\s+)?{_CAP}(?:\s+{_CAP}){{0,6}}){{0,4}})")
_BODY = re.compile(r"\b(?:foundation|council|agency|ministry|institutes?|fund|commission|trust|academy|society|union|department|programme|program|stiftung|forschungsgemeinschaft|fonds|association|endowment|office)\b", re.IGNORECASE)
_ACRONYM = re.compile(r"^[A-Z]{2,}(?:-[A-Z]+)?$")
_STOP_FUNDER = frozenset("this these we our grant grants award awards no nos project projects contract funding support the author authors work research study".split())


def award_target(award: tuple[int, int], funders: list[tuple[int, int]], text: str) -> int | None:
    """The funder that an award belongs to: one right behind it with only from, by or of between, else the nearest before, else the next."""
    behind = next((i for i, (a, _) in enumerate(funders) if a >= award[1]), None)
    if behind is not None and re.fullmatch(r"\)?\s*(?:from|by|of)\s+(?:the\s+)?", text[award[1] : funders[behind][0]]):
        return behind
    before = [i for i, (_, b) in enumerate(funders) if b <= award[0]]
    return before[-1] if before else behind


def funding(text: str | None) -> list[dict]:
    """(funder, award) pairs of a funding statement in the order of the funders; a funder without an award has null, and so
    an award without a funder. Null and empty statements have none."""
    text = text or ""
    awards, taken = [], Taken()
    for m in _AWARD.finditer(text):
        first = m[1] or m[3]
        for v in [first, *re.findall(r"[\w][\w/.-]*\w", re.sub(r"\band\b", " ", m[2] or ""))]:
            awards.append((m.start(), m.end(), v))
        taken.take(m.start(), m.end())
    funders = []
    for m in _FUNDER.finditer(text):
        name = re.sub(r"\s*\($", "", m[1]).strip(" .,")
        words = name.split()
        while words and words[0].lower() in _STOP_FUNDER:
            words.pop(0)
        name = " ".join(words)
        if name and (_BODY.search(name) or _ACRONYM.match(name)) and taken.take(m.start(1), m.end(1)):
            if funders and _ACRONYM.match(name) and re.fullmatch(r"\s*\(", text[funders[-1][1] : m.start(1)]):
                continue  # the short form of the name before
            funders.append((m.start(1), m.end(1), name))
    spans = [(a, b) for a, b, _ in funders]
    by: dict[int | None, list[str]] = {}
    for a, b, v in awards:
        by.setdefault(award_target((a, b), spans, text), []).append(v)
    out = [{"funder": name, "award": v} for i, (_, _, name) in enumerate(funders) for v in by.get(i, [None])]
    return out + [{"funder": None, "award": v} for v in by.get(None, [])]


_EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ORCID = re.compile(r"(?<!\d)\d{4}-\d{4}-\d{4}-\d{3}[\dX](?!\d)")
CONTACTS = "array<struct<author:string,email:string,orcid:string,corresponding:boolean>>"


def _fits(email: str, author: str) -> int:
    """How well an address' local part fits a name: family and initial 3, family 2, given name or initials 1, nothing 0."""
    local = re.sub(r"[^a-z]", "", email.split("@")[0].lower())
    words = [re.sub(r"[^a-z]", "", w.lower()) for w in author.split()]
    words = [w for w in words if w]
    if not words or not local:
        return 0
    family, given = words[-1], words[:-1]
    if len(family) > 2 and family in local:
        return 3 if any(g and (g[0] + family in local or family + g[0] in local or len(g) > 2 and g in local) for g in given) else 2
    return 1 if any(len(g) > 2 and g in local for g in given) or local == "".join(w[0] for w in words) else 0


def contacts(text: str | None, authors: list[str] | None) -> list[dict]:
    """Addresses and ORCIDs of a front page given to its authors, one row for each author that got any.

    An address goes to the author whose name fits it best, a tie to the author printed nearest before it; one that fits
    nobody goes to the nearest before it. An ORCID goes to the nearest before it. ``corresponding`` is told by the word near
    the address. Null texts and authors give no row.
    """
    text, authors = text or "", [a for a in authors or [] if a]
    places = {a: [m.start() for m in re.finditer(re.escape(a), text)] for a in authors}

    def nearest(at: int, among: list[str]) -> str | None:
        known = [(at - max((p for p in places[a] if p <= at), default=-(10**9)), i, a) for i, a in enumerate(among)]
        return min(known)[2] if known else None

    got: dict[str, dict] = {}
    last = 0
    for m in _EMAIL.finditer(text):
        best = max((_fits(m[0], a) for a in authors), default=0)
        author = nearest(m.start(), [a for a in authors if _fits(m[0], a) == best])
        if author:
            near = text[max(last, m.start() - 120) : m.start()].lower()
            last = m.end()
            row = got.setdefault(author, {"author": author, "email": None, "orcid": None, "corresponding": False})
            row["email"] = row["email"] or m[0].rstrip(".").lower()
            row["corresponding"] |= "correspond" in near
    for m in _ORCID.finditer(text):
        if author := nearest(m.start(), authors):
            row = got.setdefault(author, {"author": author, "email": None, "orcid": None, "corresponding": False})
            row["orcid"] = row["orcid"] or "https://orcid.org/" + m[0]
    return [got[a] for a in authors if a in got]


_NOTE = re.compile(r"^(?:publisher['’]?s? note|open access\b|©|copyright\b|springer nature remains neutral|this article is (?:licensed|distributed)|received:?\s+\d|reprints and permissions)", re.IGNORECASE)


def is_publisher_note(text: str | None) -> bool:
    """Whether a line opens the publisher's closing matter, which ends a reference list."""
    return bool(_NOTE.match((text or "").strip()))


TITLE = "struct<title:string,subtitle:string,marks:string>"


def title_parts(text: str | None) -> dict:
    """A title without footnote marks, its subtitle behind a colon or dash, and the marks; null for a blank one.

    A colon within a ratio or time parts nothing, nor does one with fewer than two words before it.
    """
    t = " ".join((text or "").split())
    m = re.search(r"[\s*†‡§¶#]*[*†‡§¶#][\s*†‡§¶#]*$", t)
    marks = m[0].strip() if m else None
    t = t[: m.start()] if m else t
    cut = next((m for m in re.finditer(r"(?<!\d):\s+|\s+[–—]\s+|\?\s+(?=[A-ZÀ-Þ])", t) if len(t[: m.start()].split()) >= 2), None)
    main, sub = (t[: cut.start()] + ("?" if cut[0].startswith("?") else ""), t[cut.end() :]) if cut else (t, None)
    return {"title": main.strip() or None, "subtitle": sub.strip() if sub else None, "marks": marks}


def salvage_json(text: str | None) -> str | None:
    """Canonical JSON of a value that may be cut off, fenced or surrounded by prose; null where none can be recovered.

    Of a value that is cut off all complete members stay.
    """
    t = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text or "")
    at = min((i for i in (t.find("{"), t.find("[")) if i >= 0), default=-1)
    if at < 0:
        return None
    decoder = json.JSONDecoder()
    try:
        return canonical(decoder.raw_decode(t[at:])[0])
    except ValueError:
        pass
    stack, text_open, escaped, safe = [], False, False, []
    for i, c in enumerate(t[at:]):
        if text_open:
            text_open = escaped or c != '"'
            escaped = c == "\\" and not escaped
        elif c == '"':
            text_open = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
            safe.append((i + 1, tuple(stack)))
        elif c in "}]" and stack:
            stack.pop()
            safe.append((i + 1, tuple(stack)))
        elif c == ",":
            safe.append((i, tuple(stack)))
    for end, closers in reversed(safe[-64:]):
        try:
            return canonical(json.loads(t[at : at + end] + "".join(reversed(closers))))
        except ValueError:
            continue
    return None


def canonical(value) -> str:
    """JSON with sorted keys, no blanks and plain characters."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
