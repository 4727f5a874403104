"""Printed author lists taken apart into names."""

from __future__ import annotations

import re

#: Words that belong to the family name that follows them.
PARTICLES = frozenset("af al bin da dal de del della den der des di do dos du el la las le lo los ten ter van von vom zu zum zur y".split())
SUFFIXES = frozenset("jr sr ii iii iv".split())
#: Words that show that a printed name is an organisation's.
BODIES = re.compile(r"\b(?:organi[sz]ation|university|institut\w*|association|committee|group|society|department|ministry|council|agency|consortium|collaboration|foundation|team|commission)\b", re.IGNORECASE)
NAME = "array<struct<family:string,given:string,literal:string>>"
_LETTER = r"[^\W\d_]"
_INITIALS = re.compile(rf"(?:{_LETTER}\.[\s-]?)+|(?:[A-ZÀ-Þ][\s-]?){{1,4}}")
_ENDS = re.compile(r"[\s,;]*(?:\bet\.?\s+al\b\.?|…|\.\.\.)[\s.]*$", re.IGNORECASE)
_EDITORS = re.compile(r"\s*\((?:eds?|hrsg)\.?\)\s*$|,?\s*\beds?\.\s*$", re.IGNORECASE)


def is_initials(piece: str) -> bool:
    """Capital initials, dotted or not, four at most without dots."""
    words = piece.split()
    piece = " ".join(words[:-1] if len(words) > 1 and words[-1].strip(".").lower() in SUFFIXES - {"v"} else words)
    return bool(piece) and bool(_INITIALS.fullmatch(piece)) and piece == piece.upper()


def _name(family: str, given: str = "") -> dict:
    return {"family": family.strip(), "given": given.strip() or None, "literal": None}


def _literal(text: str) -> list[dict]:
    return [{"family": None, "given": None, "literal": text.strip()}]


def _given_first(piece: str) -> dict | None:
    """``Jane van Dyk`` or ``J. B. Dyk III``: the family starts at the first particle, else it is the last word."""
    words = piece.split() if not BODIES.search(piece) else []
    tail = [words.pop()] if len(words) > 2 and words[-1].strip(".").lower() in SUFFIXES else []
    if len(words) < 2:
        return None
    at = next((i for i, w in enumerate(words) if i and w.lower() in PARTICLES), len(words) - 1)
    if not all(w[0].isupper() or w.lower() in PARTICLES for w in words):
        return None
    return _name(" ".join(words[at:]), " ".join([*words[:at], *tail]))


def _family_initials(piece: str) -> dict | None:
    """``Dyk JB`` as in Vancouver lists: undotted capitals close the piece."""
    words = piece.split()
    if len(words) < 2 or not re.fullmatch(r"[A-ZÀ-Þ]{1,3}", words[-1]) or is_initials(words[0]) and len(words) == 2 and len(words[0]) < 3:
        return None
    return _name(" ".join(words[:-1]), words[-1])


def _with_suffixes(pieces: list[str]) -> list[str]:
    """Pieces that are a suffix alone join the piece before them."""
    out: list[str] = []
    for p in pieces:
        if out and p.strip(". ").lower() in SUFFIXES:
            out[-1] += " " + p
        else:
            out.append(p)
    return out


def _inverted(pieces: list[str], given) -> list[dict] | None:
    """``Dyk, J. B.`` pairs; ``given`` tells whether a piece can be the second of a pair."""
    if len(pieces) % 2 or not pieces:
        return None
    pairs = list(zip(pieces[::2], pieces[1::2]))
    if not all(given(g) and not is_initials(f) for f, g in pairs):
        return None
    return [_name(f, g) for f, g in pairs]


def split_names(text: str | None) -> list[dict]:
    """Names of a printed list, in order.

    Understood are lists with semicolons, inverted names with initials or full given names, undotted initials after the
    family, and names in natural order, also where only the first name is inverted. Anything else is one literal; null
    and empty texts have no name. An ``et al.`` and a mark of editors at the end are dropped.
    """
    t = _EDITORS.sub("", _ENDS.sub("", " ".join((text or "").split()))).strip(" ,;")
    if not t:
        return []
    if ";" in t:
        out = []
        for part in filter(None, (p.strip(" ,&") for p in t.split(";"))):
            got = split_names(re.sub(r"^and\s+", "", part))
            if len(got) != 1:
                return _literal(t)
            out += got
        return out
    joined = re.search(r"(?:,\s*)?(?:&|\band\b|\bund\b)\s", t) is not None
    pieces = [p.strip() for p in re.sub(r"\s*,?\s*(?:&|\b(?:and|und)\b)\s+", ", ", t).split(",")]
    pieces = _with_suffixes([p for p in pieces if p])
    families = [_family_initials(p) for p in pieces]
    if all(families):
        return families
    got = _inverted(pieces, is_initials)
    if got:
        return got
    word = lambda p: len(p.split()) <= 3 and p[0].isupper() and not is_initials(p)
    if len(pieces) == 2 and not joined and word(pieces[0]) and (word(pieces[1]) or is_initials(pieces[1])) and len(pieces[1].split()) <= 2 and len(pieces[0].split()) <= 2:
        return [_name(*pieces)]
    natural = [_given_first(p) for p in pieces]
    if all(natural):
        return natural
    if len(pieces) > 2 and joined and word(pieces[0]) and all(natural[2:]):
        return [_name(pieces[0], pieces[1]), *natural[2:]]
    return _literal(t)


def families(text: str | None) -> list[str]:
    """Family names of a printed list; of a literal its first capitalised word."""
    out = []
    for n in split_names(text):
        word = n["family"] or next((w.strip(".,") for w in n["literal"].split() if w[:1].isupper()), None)
        if word:
            out.append(word)
    return out
