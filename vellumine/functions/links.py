"""Addresses and DOIs in running text."""

from __future__ import annotations

import bisect
import re

LINK = "array<struct<start:int,end:int,url:string,kind:string>>"
_SCHEMED = re.compile(r"(?:https?://|www\.)[^\s<>\"'\]},;@]+", re.IGNORECASE)
#: Top-level domains of hosts that are taken for addresses without a scheme, if a path follows.
DOMAINS = "com org net edu gov io ac co eu int info de fr es uk nl ch at it"
_HOST = re.compile(rf"(?<![\w@./-])(?:[a-z0-9][a-z0-9-]*\.)+(?:{'|'.join(DOMAINS.split())})/[^\s<>\"'\]}},;@]*[a-z0-9][^\s<>\"'\]}},;@]*", re.IGNORECASE)
_DOI = re.compile(r"(?<![\w/.])10\.\d{4,9}/[^\s<>\"'\]},;]+", re.IGNORECASE)


def trimmed(url: str) -> str:
    """Without closing marks, and without closing parentheses that have no partner."""
    while url and (url[-1] in ".,;:!?" or url[-1] == ")" and url.count(")") > url.count("(")):
        url = url[:-1]
    return url


def _unglued(found: str, start: int):
    """Addresses run together are parted at each further scheme that no slash or equals sign leads in."""
    cuts = [0, *(m.start() for m in re.finditer(r"https?://", found, re.IGNORECASE) if m.start() and found[m.start() - 1] not in "/="), len(found)]
    for a, b in zip(cuts, cuts[1:]):
        yield start + a, found[a:b]


def find_links(text: str | None, bare: bool = True) -> list[dict]:
    """Addresses in order of their place: with a scheme or ``www.``, then (if ``bare``) known hosts with a path, and DOIs.

    Where readings overlap the earlier kind counts. A DOI gets its resolver's address. Null and empty texts have none.
    """
    text, out, taken = text or "", [], Taken()

    def add(start: int, url: str, kind: str, lead: str = "") -> None:
        url = trimmed(url)
        if re.sub(r"^(?:https?://|www\.)", "", url, flags=re.IGNORECASE) and taken.take(start, start + len(url)):
            out.append({"start": start, "end": start + len(url), "url": lead + url, "kind": kind})

    for m in _SCHEMED.finditer(text):
        for start, url in _unglued(m[0], m.start()):
            add(start, url, "scheme")
    for pattern, kind, lead in ((_HOST, "host", ""), (_DOI, "doi", "https://doi.org/")) if bare else ():
        for m in pattern.finditer(text):
            add(m.start(), m[0], kind, lead)
    return sorted(out, key=lambda x: x["start"])


class Taken:
    """Intervals that are taken; an interval that overlaps one of them cannot be."""

    def __init__(self):
        self.spans: list[tuple[int, int]] = []

    def take(self, a: int, b: int) -> bool:
        i = bisect.bisect_left(self.spans, (a, a))
        if i < len(self.spans) and self.spans[i][0] < b or i and self.spans[i - 1][1] > a:
            return False
        self.spans.insert(i, (a, b))
        return True
