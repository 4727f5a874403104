"""In-text citations, mentions of floats and statistics, found in sentences."""

from __future__ import annotations

import re

from .links import Taken

YEAR = r"(?:1[6-9]\d{2}|20\d{2})"
CITATION = "array<struct<start:int,end:int,style:string,numbers:array<int>,families:array<string>,year:int,suffix:string,reason:string>>"
_NUMS = r"\d{1,3}(?:\s*[-–,;]\s*\d{1,3}){0,60}"
_BRACKET = re.compile(rf"\[({_NUMS})\]")
_SUPER = re.compile(rf"(?<=[\w.,;:)\]”\"’'])(?:\^\{{\s*({_NUMS})\s*\}}|\^({_NUMS})(?![\d}}])|<sup>\s*({_NUMS})\s*</sup>|([⁰¹²³⁴-⁹]+(?:[⁻,][⁰¹²³⁴-⁹]+)*))")
_PLAIN = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻", "0123456789-")
_ROUND = re.compile(rf"\((?:refs?\.?\s*)?({_NUMS})\)")
#: What stands right before a bracket that counts or measures instead of citing.
_NO_CITATION = re.compile(r"(?:\b(?:CI|interval|range|IQR|eq\.?|equation|step|item|p|n|df|[tFrz])\s*[=:]?\s*|[=<>≤≥±]\s*)$", re.IGNORECASE)
_FAMILY = r"(?:(?:van|von|de|der|den|di|da|la|le|el|ter|ten)\s+){0,3}[A-ZÀ-Þ][\w'’-]+"
_NARRATIVE = re.compile(rf"({_FAMILY}(?:,\s{_FAMILY}){{0,8}}(?:,?\s(?:and|&|und)\s{_FAMILY})?)(?:\s(et\s+al\.?))?(?:['’]s)?\s\(({YEAR})([a-z])?((?:,\s*(?:{YEAR}[a-z]?|[a-z]\b))*)(?:,\s*pp?\.\s*[\d–-]+)?\)")
_PAREN = re.compile(rf"\(((?:[^()]|\([^()]*\)){{0,400}}?\b{YEAR}[a-z]?(?:[^()]){{0,400}})\)")
_ONE = re.compile(rf"({_FAMILY}(?:,\s{_FAMILY}){{0,8}}(?:,?\s(?:and|&|und)\s{_FAMILY})?)(?:,?\s(et\s+al\.?))?,?\s({YEAR})([a-z])?((?:,\s*(?:{YEAR}[a-z]?|[a-z]\b))*)")
_LEADS = frozenset("see also in the and for as by but from since during until cf eg compare e.g. table figure section chapter study experiment january february march april may june july august september october november december".split())


def expanded(inside: str) -> list[int]:
    """Numbers of a printed list; ranges are written out upwards whichever way they are printed, each number once."""
    out: dict[int, None] = {}
    for part in re.split(r"\s*[,;]\s*", inside.strip()):
        ends = [int(x) for x in re.split(r"\s*[-–]\s*", part) if x]
        for n in range(min(ends), max(ends) + 1) if ends else ():
            out[n] = None
    return list(out)


def _families(names: str) -> list[str]:
    parts = [p.strip() for p in re.split(r",\s*(?:and|&|und)?\s*|\s+(?:and|&|und)\s+", names)]
    return [p for p in parts if p]


def citations(text: str | None) -> list[dict]:
    """All candidates in order, each with its style and, where something speaks against it, the reason.

    Styles: bracket, superscript, round, narrative and author_year; several years behind one name give one row each.
    Null and empty texts have none.
    """
    text, out, taken = text or "", [], Taken()

    def add(a: int, b: int, style: str, numbers=(), families=(), year=None, suffix=None, reason=None) -> None:
        out.append({"start": a, "end": b, "style": style, "numbers": list(numbers), "families": list(families), "year": year, "suffix": suffix, "reason": reason})

    for m in _BRACKET.finditer(text):
        if taken.take(*m.span()):
            before = text[max(0, m.start() - 24) : m.start()]
            add(*m.span(), "bracket", expanded(m[1]), reason="statistic_context" if _NO_CITATION.search(before) else None)
    for m in _SUPER.finditer(text):
        if taken.take(*m.span()):
            before = text[max(0, m.start() - 3) : m.start()]
            inside = next(g for g in m.groups() if g).translate(_PLAIN)
            math = re.search(r"(?:^|[^A-Za-z])[A-Za-zχηωR]$|\d$|\)$", before) is not None and not re.search(r"[.,;:]$", before)
            add(*m.span(), "superscript", expanded(inside), reason="math_superscript" if math else None)
    for m in _ROUND.finditer(text):
        if taken.take(*m.span()):
            before = text[max(0, m.start() - 24) : m.start()]
            bad = _NO_CITATION.search(before) or re.search(r"[\w)]$", before)
            add(*m.span(), "round", expanded(m[1]), reason="non_citation_bracket" if bad else None)

    def dated(a: int, b: int, style: str, names: str, et_al, year: str, suffix, more: str) -> None:
        families = [f for f in _families(names)]
        while families and families[0].lower() in _LEADS:
            families.pop(0)
        if not families:
            return
        families = [*families, "et al."] if et_al else families
        add(a, b, style, families=families, year=int(year), suffix=suffix)
        for y, s in re.findall(rf"({YEAR})?([a-z])?(?:,|$)", more.replace(" ", "")):
            if y or s:
                year = y or year
                add(a, b, style, families=families, year=int(year), suffix=s or None)

    for m in _NARRATIVE.finditer(text):
        if taken.take(*m.span()):
            dated(m.start(), m.end(), "narrative", m[1], m[2], m[3], m[4], m[5])
    for m in _PAREN.finditer(text):
        if taken.take(*m.span()):
            at = m.start(1)
            for part in re.split(r"(;)", m[1]):
                for one in [x] if (x := _ONE.search(part)) else []:
                    dated(at + one.start(), at + one.end(), "author_year", one[1], one[2], one[3], one[4], one[5])
                at += len(part)
    return sorted(out, key=lambda c: (c["start"], c["end"], c["year"] or 0, c["suffix"] or ""))


STRIPPED = "struct<text:string,anchors:array<struct<at:int,numbers:array<int>>>>"


def strip_superscripts(text: str | None, most: int | None = None) -> dict:
    """The text without superscript citations, and where each stood in what is left.

    ``most`` is the highest number that the list has; a superscript with another number, or one that is mathematics, stays.
    """
    text, out, anchors, at, length = text or "", [], [], 0, 0
    for c in citations(text):
        if c["style"] != "superscript" or c["reason"] or most is not None and not all(1 <= n <= most for n in c["numbers"]):
            continue
        out.append(text[at : c["start"]])
        length += c["start"] - at
        anchors.append({"at": length, "numbers": c["numbers"]})
        at = c["end"]
    return {"text": "".join(out) + text[at:], "anchors": anchors}


MENTION = "array<struct<start:int,end:int,kind:string,label:string>>"
#: Longest range of labels that is written out; of a longer one only the ends are mentioned.
RANGE = 64
#: A label does not start within an e-mail address.
_LABEL = r"(?![\w.%+-]{0,64}@[\w-])(?:(?:S\s?|[A-Z]\.?)?\d{1,3}(?:\.\d{1,3})*[a-z]?(?![\w%])|[IVX]{1,6}(?![\w])|(?-i:[A-Z])(?![\w'’.-]))"
_LIST = rf"(?:{_LABEL})(?:\s*(?:,|;|&|and|to|-|–|—|,\s*and)\s*(?:{_LABEL})){{0,60}}"
_KINDS = (
    ("figure", r"(?:supplementary\s+|extended\s+data\s+)?fig(?:ure)?s?\.?"), ("table", r"(?:supplementary\s+)?tab(?:le)?s?\.?"), ("equation", r"eq(?:uation)?s?\.?"), ("section", r"sections?|sect\.|§+"), ("supplement", r"(?:supplementary\s+(?:material|information|file|note)|appendix|appendices)"),
)
#: The word does not run on in lower case.
_MENTIONS = tuple((kind, re.compile(rf"(?<![\w@-])({word})(?-i:(?![a-zß-ÿ]))\s*\(?({_LIST})\)?", re.IGNORECASE)) for kind, word in _KINDS)


def _label_list(kind: str, inside: str) -> list[str]:
    parts = re.split(rf"\s*(,\s*and|,|;|&|\band\b|\bto\b|-|–|—)\s*", inside.strip(), flags=re.IGNORECASE)
    out = [parts[0].replace(" ", "")]
    for joint, label in zip(parts[1::2], parts[2::2]):
        label = label.replace(" ", "")
        a, b = re.fullmatch(r"(\D*)(\d+)", out[-1]), re.fullmatch(r"(\D*)(\d+)", label)
        if joint in ("-", "–", "—", "to") and a and b and (not b[1] or a[1] == b[1]):
            lo, hi = int(a[2]), int(b[2])
            if lo > hi and kind in ("equation", "section"):
                return []
            if lo < hi <= lo + RANGE:
                out += [f"{a[1]}{n}" for n in range(lo + 1, hi)]
            label = a[1] + b[2]
        out.append(label)
    return out


def mentions(text: str | None) -> list[dict]:
    """Mentions of figures, tables, equations, sections and supplements with one row per label; null and empty texts have none.

    Lists and ranges are taken apart; a reversed range keeps both ends for floats and is dropped for equations and sections.
    A single letter is a label only behind a capitalised word.
    """
    text, out, taken = text or "", [], Taken()
    for kind, pattern in _MENTIONS:
        for m in pattern.finditer(text):
            if re.fullmatch(r"[A-Za-z]|[IVXivx]+", m[2]) and not m[1][0].isupper() or m[1].isupper() and kind == "equation":
                continue
            if taken.take(*m.span()):
                out += [{"start": m.start(), "end": m.end(), "kind": kind, "label": x} for x in _label_list(kind, m[2])]
    return sorted(out, key=lambda m: m["start"])


STATISTIC = "array<struct<start:int,end:int,group:int,name:string,df:string,comparator:string,value:string,low:string,high:string>>"
_MINUS = str.maketrans("−–", "--")
_NUMBER = r"[-−–+]?\s?(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+[.·,]\d+|\d+|[.·]\d+)(?:\s?[×x]\s?10\s?\^?\{?\s?[-−–]?\d+\}?|[eE][-+−]?\d+)?%?"
#: Names of statistics as they are usually printed; the longer of two that fit counts.
NAMES = "adj. R2,adj. R²,Cohen's d,Cronbach's α,partial η2,partial η²,Hedges' g,AIC,BIC,CFI,CI,HR,ICC,IQR,Mdn,OR,RMSEA,RR,SD,SE,SRMR,TLI,R2,R²,ηp2,ηp²,η2,η²,ω2,ω²,χ2,χ²,BF,df,α,β,η,κ,ρ,τ,φ,F,H,M,N,Q,U,V,W,Z,b,d,f,g,k,n,p,r,t,z".split(",")
_NAME = "|".join(re.escape(n) for n in sorted(NAMES, key=len, reverse=True))
_SIGNS = {"=": "=", "<": "<", ">": ">", "≤": "<=", "⩽": "<=", "<=": "<=", "≥": ">=", "⩾": ">=", ">=": ">=", "≈": "~", "~": "~", "∼": "~", "≠": "!=", "≪": "<<", "≫": ">>"}
_SIGN = "<=|>=|[=<>≤⩽≥⩾≈~∼≠≪≫]"
_COMPARED = re.compile(rf"(?<![\w-])({_NAME})(?:\s?\(([^()=<>]{{1,40}})\)|_\{{?([^\s{{}}]{{1,12}})\}}?)?\s*({_SIGN})\s*({_NUMBER})(?:\s*(?:to|[-–])\s*({_NUMBER}))?(?![\w])")
_INTERVAL = re.compile(rf"(?<![\w-])(\d{{2}}(?:[.,]\d)?\s?%\s?(?:CI|HDI|CrI))\s*[:=]?\s*[\[(]\s*({_NUMBER})\s*(?:,|;|to|–)\s*({_NUMBER})\s*[\])]")
_PRE = re.compile(r"[$=<>~≤≥⩽⩾≈≠≪≫\\\[(]")


def _plain_number(text: str | None) -> str | None:
    """A printed number with a point and a plain minus; a lone comma is a decimal one unless three digits follow a group of up to three."""
    if text is None:
        return None
    t = text.translate(_MINUS).replace(" ", "").replace("·", ".").rstrip("%")
    m = re.fullmatch(r"([-+]?)([\d.,]+)(?:[×x]10\^?\{?([-+]?\d+)\}?|[eE]([-+]?\d+))?", t)
    if not m:
        return t
    body = m[2]
    if re.fullmatch(r"\d{1,3}(?:,\d{3})+(?:\.\d+)?", body) and not body.startswith("0"):
        body = body.replace(",", "")
    body = body.replace(",", ".")
    power = m[3] or m[4]
    return m[1].replace("+", "") + ("0" + body if body.startswith(".") else body) + (f"e{int(power)}" if power else "")


def statistics_in(text: str | None) -> list[dict]:
    """Statistics of a sentence in order: name, degrees of freedom, comparator, value and, of intervals and ranges, their ends.

    Those of one pair of parentheses, or parted by nothing but commas, semicolons and blanks, share a group.
    """
    text = (text or "").replace("\n", " ")
    if not _PRE.search(text):
        return []
    out, taken = [], Taken()
    for m in _INTERVAL.finditer(text):
        if taken.take(*m.span()):
            out.append({"start": m.start(), "end": m.end(), "name": " ".join(m[1].split()), "df": None, "comparator": "=", "value": None, "low": _plain_number(m[2]), "high": _plain_number(m[3])})
    for m in _COMPARED.finditer(text):
        if taken.take(*m.span()):
            high = _plain_number(m[6])
            value = _plain_number(m[5])
            out.append({"start": m.start(), "end": m.end(), "name": m[1], "df": " ".join((m[2] or m[3] or "").split()) or None, "comparator": _SIGNS[m[4]], "value": None if high else value, "low": value if high else None, "high": high})
    out.sort(key=lambda x: x["start"])
    group, depth_of = -1, lambda a, b: text[a:b]
    for i, x in enumerate(out):
        between = depth_of(out[i - 1]["end"], x["start"]) if i else None
        same = between is not None and (re.fullmatch(r"[\s,;$]*(?:and\s+)?", between) or "(" not in between and ")" not in between and _inside(text, out[i - 1]["start"]) and _inside(text, x["start"]))
        group += not same
        x["group"] = group
    return out


def _inside(text: str, at: int) -> bool:
    """Whether a place stands between parentheses."""
    open_at = text.rfind("(", 0, at)
    return open_at > text.rfind(")", 0, at)
