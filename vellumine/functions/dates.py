"""Printed dates as ISO dates, at the precision at which they are printed."""

from __future__ import annotations

import calendar
import re

FIRST_YEAR, LAST_YEAR = 1800, 2099
_PIECE = re.compile(r"(?P<number>\d+)(?:st|nd|rd|th)?|(?P<word>[^\W\d_]+)\.?|(?P<mark>[-/,])|(?P<other>\S)")
_NAMES = [n.lower() for n in calendar.month_name]
#: Layouts in order of precedence: Y, M and D are numbers, N a month's name, other signs themselves.
LAYOUTS = ("Y-M-D", "Y-M", "Y/M/D", "DNY", "DN,Y", "NDY", "ND,Y", "YND", "Y,ND", "Y,N", "NY", "N,Y")


def _month(word: str) -> int | None:
    """A month by its English name or the first three letters or more of it; ``sept`` is one."""
    w = word.lower()
    return next((i for i, n in enumerate(_NAMES) if i and len(w) >= 3 and n.startswith(w)), None)


def _pieces(text: str) -> list[tuple[str, str, int]]:
    """(kind, value, place): numbers as Y where they can be a year, else as n; month names as N; marks; anything else as x."""
    out = []
    for m in _PIECE.finditer(text):
        if m["number"]:
            n = m["number"]
            out.append(("Y" if len(n) == 4 and FIRST_YEAR <= int(n) <= LAST_YEAR else "n" if len(n) <= 2 else "x", n, m.start()))
        elif m["word"] and (k := _month(m["word"])):
            out.append(("N", str(k), m.start()))
        else:
            out.append((m["mark"] or "x", m[0], m.start()))
    return out


def _built(values: dict[str, int]) -> str | None:
    year, month, day = values["Y"], values.get("M") or values.get("N"), values.get("D")
    if month is None or not 1 <= month <= 12:
        return None
    short = f"{year:04d}-{month:02d}"
    return f"{short}-{day:02d}" if day and day <= calendar.monthrange(year, month)[1] else short


def printed_dates(text: str) -> list[tuple[int, str]]:
    """(place, ISO value) of all dates in order of place; of overlapping readings that of the earlier layout counts.

    An impossible month drops a date, an impossible day leaves its month.
    """
    pieces = _pieces(text)
    kinds = "".join(k for k, _, _ in pieces)
    taken, found = [False] * len(pieces), []
    for layout in LAYOUTS:
        shape = layout.replace("M", "n").replace("D", "n")
        at = kinds.find(shape)
        while at >= 0:
            end = at + len(shape)
            follows = kinds[end : end + 2]
            longer = layout == "Y-M" and follows[:1] == "-"
            if not any(taken[at:end]) and not longer:
                taken[at:end] = [True] * len(shape)
                value = _built({f: int(v) for f, (_, v, _) in zip(layout, pieces[at:end]) if f.isalpha()})
                if value:
                    found.append((pieces[at][2], value))
            at = kinds.find(shape, at + 1)
    return sorted(found)


def iso_date_value(text: str | None) -> str | None:
    """The one date that a printed string holds; of several the first after a word with ``publish``, else none.

    A bare year counts only where it is the whole string.
    """
    text = text or ""
    if re.fullmatch(r"\d{4}", text.strip()) and FIRST_YEAR <= int(text) <= LAST_YEAR:
        return text.strip()
    found = printed_dates(text)
    if len({v for _, v in found}) > 1:
        cue = re.search("publish", text, re.IGNORECASE)
        found = [f for f in found if cue and f[0] > cue.start()][:1]
    return found[0][1] if found else None
