"""Reference lists: their lines put together to entries, and entries read into fields, by rules."""

from __future__ import annotations

import re
import statistics

from .names import split_names

FIELDS = (
    "label string, authors array<struct<family:string,given:string,literal:string>>, year int, year_suffix string, title string, container string, "
    "volume string, issue string, first_page string, last_page string, publisher string, doi string, url string, bib_type string, repairs array<string>"
)
YEAR = r"(?:1[89]\d{2}|20[0-3]\d)"
_LABEL = re.compile(r"^\s*(?:\[(\d{1,9})\]|\((\d{1,3})\)(?=\s+\D)|(\d{1,3})\.(?=\s))\s*")
_DOI = re.compile(r"(?:https?://(?:dx\.)?doi\.org/|doi:?\s*)?(10\.\d{4,9}/\S+)", re.IGNORECASE)
_URL = re.compile(r"(?:Retrieved from\s+|Available (?:at|from):?\s+)?(https?://\S+|www\.\S+)", re.IGNORECASE)
_PAREN_YEAR = re.compile(rf"\(({YEAR})([a-z])?(?:,[^)]*)?\)")
_NO_YEAR = re.compile(r"\((?:n\.\s?d\.|in press|forthcoming)\)", re.IGNORECASE)
_PAGES = r"([A-Za-z]?\d{1,6})(?:\s*[-‐‑–—]+\s*([A-Za-z]?\d{1,6}))?"
#: Where a journal's numbers stand behind its name, in the usual printed orders.
_NUMBERS = (
    re.compile(rf"(?P<year>{YEAR})\s*;\s*(?P<volume>\d{{1,4}})\s*(?:\((?P<issue>[^)]{{1,9}})\))?\s*:\s*{_PAGES}"),
    re.compile(rf"(?:vol\.\s*)?(?P<volume>\d{{1,4}}),\s*no\.\s*(?P<issue>[\w/-]{{1,9}})\s*\((?P<year>{YEAR})\)\s*:\s*{_PAGES}", re.IGNORECASE),
    re.compile(rf"vol\.\s*(?P<volume>\d{{1,4}}),\s*no\.\s*(?P<issue>[\w/-]{{1,9}}),\s*(?P<year>{YEAR}),\s*pp?\.\s*{_PAGES}", re.IGNORECASE),
    re.compile(rf"vol\.\s*(?P<volume>\d{{1,4}})(?:,\s*no\.\s*(?P<issue>[\w/-]{{1,9}}))?,\s*pp?\.\s*{_PAGES}(?:,\s*(?P<year>{YEAR}))?", re.IGNORECASE),
    re.compile(rf"(?P<volume>\d{{1,4}})\s*\((?P<year>{YEAR})\),?\s*(?:pp?\.\s*)?{_PAGES}"),
    re.compile(rf"(?<![\d.])(?P<volume>\d{{1,4}})\s*\((?P<issue>[^)]{{1,9}})\)\s*[,:]\s*(?:pp?\.\s*)?{_PAGES}"),
    re.compile(rf",\s*(?:vol\.\s*)?(?P<volume>\d{{1,4}})\s*[,:]\s*(?:pp?\.\s*)?{_PAGES}"),
)
_QUOTED = re.compile(r"[\"“]([^\"”]{3,400}?)[.,?!]?[\"”]")
#: Publishers' cities and names follow a book's title as ``City: Name``, or stand alone at the end.
_UNDOTTED = re.compile(r"(?:[A-ZÀ-Þ][\w'’-]+(?:\s[\w'’-]+)?\s[A-Z]{1,3}(?:,\s|(?=\.\s))){1,200}(?:et al)?\.\s")
_PLACE = re.compile(r"^(?:[A-ZÀ-Þ][\w .'-]{1,40}(?:,\s*[A-Z]{2})?:\s*)?([A-ZÀ-Þ][^.:;]{2,60})$")


def _tidy(text: str) -> str | None:
    return text.strip(" ,.;:") or None


def parse(raw: str | None) -> dict:
    """Fields of one printed reference. What cannot be told is null; a null or empty reference has no field.

    Read are author-year entries with the year in parentheses or after the authors, entries with the year before the
    volume, and entries with a quoted title. The DOI and address are taken first, then the numbers, so that their digits
    are never read as anything else.
    """
    out: dict = {k: None for k in "label year year_suffix title container volume issue first_page last_page publisher doi url bib_type".split()}
    out["authors"], out["repairs"] = [], []
    text = " ".join((raw or "").split())
    if m := _LABEL.match(text):
        out["label"] = next(g for g in m.groups() if g)
        text = text[m.end() :]
    if m := _DOI.search(text):
        out["doi"] = m[1].rstrip(".,;)").lower()
        text = (text[: m.start()] + text[m.end() :]).strip()
    if m := _URL.search(text):
        out["url"] = m[1].rstrip(".,;")
        text = (text[: m.start()] + text[m.end() :]).strip()
    year = _PAREN_YEAR.search(text)
    numbers = next((m for p in _NUMBERS if (m := p.search(text, year.end() if year and year.start() < 0.5 * len(text) else 0))), None)
    head, tail = text, ""
    if numbers:
        got = numbers.groupdict()
        out["volume"], out["issue"] = got["volume"], got.get("issue")
        named = set(numbers.re.groupindex.values())
        out["first_page"], out["last_page"] = (numbers[g] for g in range(1, numbers.re.groups + 1) if g not in named)
        out["last_page"] = _whole_last(out["first_page"], out["last_page"])
        if got.get("year"):
            out["year"] = int(got["year"])
        head, tail = text[: numbers.start()], text[numbers.end() :]
    if year and year.end() <= len(head) and (not numbers or year.start() < numbers.start()):
        out["year"], out["year_suffix"] = int(year[1]), year[2]
        _author_year(out, head[: year.start()], head[year.end() :])
    elif m := _NO_YEAR.search(head):
        _author_year(out, head[: m.start()], head[m.end() :])
    elif m := _QUOTED.search(head):
        out["authors"], out["title"] = split_names(head[: m.start()].strip(" .,")), m[1]
        out["container"] = _tidy(re.sub(r"^\s*(?:In|in)[: ]\s*", "", head[m.end() :]))
    elif (m := re.search(rf"[,.]\s({YEAR})([a-z])?\.\s", head)) and not out["year"]:
        out["year"], out["year_suffix"] = int(m[1]), m[2]
        _author_year(out, head[: m.start() + 1], head[m.end() :])
    elif m := _UNDOTTED.match(head):
        parts = _sentences(head[m.end() :])
        out["authors"], out["title"], out["container"] = split_names(m[0].strip(" .")), _tidy(parts[0]) if parts else None, _tidy(". ".join(parts[1:]))
    else:
        parts = _sentences(head)
        if len(parts) > 1:
            out["authors"], out["title"] = split_names(parts[0]), _tidy(parts[1])
            out["container"] = _tidy(". ".join(parts[2:])) if len(parts) > 2 else None
        else:
            out["title"] = _tidy(head)
    if not out["year"] and (found := re.findall(rf"(?<![\d-]){YEAR}(?![\d-])", head + " " + tail)):
        out["year"] = int(found[-1])
    repair(out)
    return out


_ABBREVIATED = re.compile(r"(?:(?:^|[\s.])[A-ZÀ-Þ]|\bet al|\bVol|\bNo|\bSt|\bDr)$")


def _sentences(text: str) -> list[str]:
    """Pieces between full stops; the stop of an initial or of a short abbreviation ends none."""
    text, out, at = text.strip(), [], 0
    for m in re.finditer(r"[.?!]\s+(?=[\"“A-ZÀ-Þ\d])", text):
        if not _ABBREVIATED.search(text[max(0, m.start() - 6) : m.start()]):
            out.append(text[at : m.start()])
            at = m.end()
    return [p for p in (*out, text[at:]) if p.strip()]


def _author_year(out: dict, before: str, after: str) -> None:
    out["authors"] = split_names(before.strip(" .,") + ("." if re.search(r"\b[A-Z]\.\s*,?$", before.strip()) else ""))
    after = after.strip(" .,:")
    if m := _QUOTED.match(after):
        out["title"], rest = m[1], after[m.end() :]
    else:
        parts = _sentences(after)
        out["title"], rest = (_tidy(parts[0]) if parts else None), ". ".join(parts[1:])
    rest = re.sub(r"^\s*In[: ]\s*", "", rest.strip(" .,"))
    if out["volume"] is None and (m := _PLACE.match(rest)):
        out["publisher"] = m[1].strip()
    else:
        out["container"] = _tidy(rest)


def _whole_last(first: str | None, last: str | None) -> str | None:
    """An abbreviated last page takes the leading characters of the first."""
    if first and last and last.isdigit() and first[-len(last) :].isdigit() and len(last) < len(first):
        return first[: len(first) - len(last)] + last
    return last


def repair(out: dict) -> None:
    """Mend fields that a rule shows to be wrong, and name the rules that fired in ``repairs``."""

    def fired(rule: str) -> None:
        out["repairs"].append(rule)

    if out["container"] and (m := re.search(r"[, ]+(?:vol(?:ume)?\.?)\s*(\d{1,4})$", out["container"], re.IGNORECASE)) and not out["volume"]:
        out["volume"], out["container"] = m[1], _tidy(out["container"][: m.start()])
        fired("volume_in_container")
    if out["title"] and (m := re.search(r"\s*\[([A-Za-z ]{3,30})\]$", out["title"])):
        out["title"] = out["title"][: m.start()].strip()
        fired("medium_in_title")
    if out["first_page"] and out["last_page"] and out["first_page"].isdigit() and out["last_page"].isdigit() and int(out["last_page"]) < int(out["first_page"]):
        out["last_page"] = None
        fired("reversed_pages")
    if not out["title"] and out["container"]:
        out["title"], out["container"] = out["container"], None
        fired("title_from_container")
    if out["doi"] and out["url"] and out["doi"] in out["url"].lower():
        out["url"] = None
        fired("url_is_doi")
    kept = [a for a in out["authors"] if a["family"] or a["literal"]]
    if len(kept) < len(out["authors"]):
        out["authors"] = kept
        fired("empty_author")
    out["bib_type"] = "journal-article" if out["volume"] or out["container"] and out["first_page"] else "book" if out["publisher"] else "web-page" if out["url"] and not out["doi"] else "other"


# --- lists -------------------------------------------------------------------------------------------------------------

_ONSET = re.compile(rf"^(?:[A-ZÀ-Þ][\w'’-]+(?:\s[A-ZÀ-Þ][\w'’-]+){{0,2}},?\s+(?:[A-ZÀ-Þ]\.[\s-]?)+|[A-ZÀ-Þ][\w'’-]+\s[A-Z]{{1,3}}[,.]|[A-ZÀ-Þ][\w'’-]+,\s[A-ZÀ-Þ][a-zà-ÿ]+|[A-ZÀ-Þ][^.()]{{3,80}}\.?\s\({YEAR}[a-z]?\))")
_DASH = re.compile(r"^[—–-]{2,}\s*[.,]?\s")
_MARKED = re.compile(r"^\s*(?:\[(\d{1,9})\]|(\d{1,9})\.)\s+(?=\S)")
#: Evidence that a line starts an entry, and the sum from which it does.
VOTES = {"onset": 0.45, "dash": 0.7, "after_entry": 0.2, "after_open": -0.2, "open_authors": -5.0, "lower": -0.7, "mark": -0.6, "date": -0.8, "gap": 0.35, "hanging": -0.4}
START = 0.35


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def line_votes(lines: list[str]) -> list[float]:
    """How much speaks for each line being an entry's first: its own shape, the line before, blank lines and its indent."""
    filled = [x for x in lines if x.strip()]
    margin = min((_indent(x) for x in filled), default=0)
    hanging = any(_indent(x) > margin for x in filled) and sum(_indent(x) == margin for x in filled) >= 2
    out, before, gap = [], "", False
    for line in lines:
        t = line.strip()
        if not t:
            out.append(0.0)
            gap = True
            continue
        v = 0.0
        if _ONSET.match(t):
            v += VOTES["onset"]
        if _DASH.match(t):
            v += VOTES["dash"]
        if t[0].islower():
            v += VOTES["lower"]
        elif not t[0].isalnum() and not _DASH.match(t) and t[0] not in "[(\"“":
            v += VOTES["mark"]
        if re.match(rf"\(?{YEAR}[a-z]?\)?[.,;:]", t):
            v += VOTES["date"]
        if before:
            if re.search(r"(?:\.|10\.\d{4,9}/\S+|\d[-–]\d+\.?)$", before):
                v += VOTES["after_entry"]
            if re.search(r"(?:,|&|\band|-|:)$", before):
                v += VOTES["after_open"]
            if re.search(r"(?:,|&|\band)$", before) and re.search(r"[A-Z]\.,?\s*(?:&|and)?$|^[^()\d]*$", before):
                v += VOTES["open_authors"]
        else:
            v += VOTES["gap"]
        if gap:
            v += VOTES["gap"]
        if hanging and _indent(line) > margin:
            v += VOTES["hanging"]
        out.append(v)
        before, gap = t, False
    return out


def segments(text: str | None) -> list[dict]:
    """Entries of a list's text with the strategy that parted them: printed numbers that rise by one, else line votes.

    Numbers above 999 count only where they go on from the one before; elsewhere they are years or pages.
    No character but line ends is lost: what stands before the first start is an entry of its own.
    """
    lines = (text or "").split("\n")
    marks = [(i, int(next(g for g in m.groups() if g))) for i, x in enumerate(lines) if (m := _MARKED.match(x))]
    run, expected = [], None
    for i, n in marks:
        if expected is None and n <= 2 or n == expected:
            run.append(i)
            expected = n + 1
    if len(run) >= 2 and len(run) * 2 > len(marks) - sum(n > 999 for _, n in marks) + max(expected - 1000, 0):
        starts, strategy = run, "numbered"
    else:
        starts, strategy = [i for i, v in enumerate(line_votes(lines)) if v >= START and lines[i].strip()], "votes"
    edges = [i for i in dict.fromkeys([0, *starts])] + [len(lines)]
    out, known = [], set(starts)
    for a, b in zip(edges, edges[1:]):
        entry = _joined(lines[a:b])
        if entry:
            out.append({"text": entry, "strategy": strategy if a in known else "lead"})
    return out


def _joined(lines: list[str]) -> str:
    out = ""
    for line in (x.strip() for x in lines if x.strip()):
        if re.search(r"[a-zà-ÿ]-$", out) and line[0].islower():
            out = out[:-1] + line
        elif re.search(r"(?:https?://\S*|10\.\d{4,9}/\S*)[-/_]$", out):
            out += line
        else:
            out += (" " if out else "") + line
    return out


def split_merged(segment: str | None, numbered: bool = False) -> list[str]:
    """Entries that were run together: at printed numbers, else where names lead to a year in parentheses, else to a bare year.

    ``numbered`` says that the list is numbered by a strict majority; only numbers part it then, those above 999 where they
    follow the segment's own. Nothing is lost.
    """
    text = segment or ""
    own = _MARKED.match(text) if numbered else None
    following = rf"|{int(own[1]) + 1}" if own and own[1] and int(own[1]) >= 999 else ""
    initial = r"(?:[A-ZÀ-Þ]\.[\s-]?)+"
    names = rf"[A-ZÀ-Þ][\w'’-]+,\s{initial}(?:,?\s*(?:&|and)?\s*[A-ZÀ-Þ][\w'’-]+,\s{initial})*"
    onsets = [rf"(?<=\S)\s+(?=\[(?:\d{{1,3}}{following})\]\s+[A-ZÀ-Þ])"]
    if not numbered:
        onsets += [rf"(?<=[.)\]])\s+(?={names}\s*\({YEAR}[a-z]?\))", rf"(?<=[.)\]])\s+(?={names}\s*,?\s(?:19\d{{2}}|20[0-3]\d)[a-z]?[.,])"]
    for onset in onsets:
        parts = re.split(onset, text)
        if len(parts) > 1:
            return parts
    return [text]


def numbered_by_majority(entries: list[str]) -> bool:
    return sum(bool(_LABEL.match(e)) for e in entries) * 2 > len(entries)


def typical_length(entries: list[str]) -> float | None:
    """Median length of the entries."""
    return float(statistics.median(map(len, entries))) if entries else None


def segmentation_quality(entries: list[str], numbered: bool = False) -> float | None:
    """Share of the characters in entries that have one year and start like an entry; null without entries.

    ``numbered`` says that the entries were parted at printed numbers, which then are labels of any length.
    """
    total, label = sum(map(len, entries)), _MARKED if numbered else _LABEL
    good = sum(len(e) for e in entries if (_ONSET.match(t := label.sub("", e)) or _DASH.match(e)) and re.search(YEAR, e) and len(split_merged(t)) == 1)
    return good / total if total else None
