"""Unicode normal forms and comparison keys that Spark lacks, as Arrow-batched functions, and repairs that need them."""

from __future__ import annotations

import html
import re
import unicodedata

from pyspark.sql import Column

from .arrow import arrow_udf

_LETTERS = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i"}


def _text(run):
    return arrow_udf(lambda s: None if s is None else run(s), "string")


def fold_value(s: str) -> str:
    """Case folded, compatibility forms and diacritics resolved, letters without a decomposition spelt out."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", s.casefold()) if not unicodedata.combining(c))
    return "".join(_LETTERS.get(c, c) for c in plain)


def squash_value(s: str) -> str:
    """Letters and digits alone of the folded text."""
    return "".join(c for c in fold_value(s) if c.isalnum())


_MASKED = re.compile(r"https?://\S+|www\.\S+|\b10\.\d{4,9}/\S+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+")


def outside_links(s: str, change) -> str:
    """``change`` applied to what is no address, DOI or mail address."""
    out, at = [], 0
    for m in _MASKED.finditer(s):
        out += [change(s[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, change(s[at:])])


_LIGATURES = str.maketrans({"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "\u00ad": "", "\x02": "", "\u200b": ""})


def repair_value(s: str) -> str:
    """Readings of scans mended, in this order: normal form, stray marks and ligatures, addresses and DOIs wrapped at a line
    end, words broken there, lines joined."""
    t = unicodedata.normalize("NFC", s).translate(_LIGATURES)
    t = re.sub(r"((?:https?://|www\.|\b10\.\d{4,9}/)\S*[-/_.=])\n\s*(?=[a-z0-9])", r"\1", t)
    t = re.sub(r"(\b10\.\d{4,9}/?)\n\s*(?=[\w/])", r"\1", t)
    t = re.sub(r"(?<=[a-zà-ÿ])-\n\s*(?=[a-zà-ÿ])", "", t)
    return re.sub(r"(?:(?<![ \t])[ \t]+)?\n[ \t]*", " ", t)


def unwrap_value(s: str) -> str:
    """LaTeX commands replaced by their arguments, however deeply nested, and mathematics by its content; a dollar sign before a digit is money."""
    t = re.sub(r"\$([^$0-9\n][^$\n]*)\$", r"\1", s)
    t = re.sub(r"\\begin\{[^{}]*\}|\\end\{[^{}]*\}", "", t)
    if "\\" not in t:
        return t
    out, i, depth = [], 0, []
    while i < len(t):
        m = re.compile(r"\\[a-zA-Z]+\*?\s*(?:\[[^\]]*\])?").match(t, i) if t[i] == "\\" else None
        if m:
            i = m.end()
            if i < len(t) and t[i] == "{":
                depth.append(True)
                i += 1
            continue
        if t[i] == "\\" and i + 1 < len(t):
            out.append(t[i + 1])
            i += 2
            continue
        if t[i] == "{" and depth:
            depth.append(True)
        elif t[i] == "}" and depth:
            depth.pop()
        else:
            out.append(t[i])
        i += 1
    return "".join(out)


def clean_early_value(s: str) -> str:
    """What may be changed before links are read: normal form, control characters, fences, addresses untouched."""
    t = unicodedata.normalize("NFC", html.unescape(s))
    t = re.sub(r"^```\w*\n?|\n?```$", "", t)
    return outside_links(t, lambda x: re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", x))


def clean_late_value(s: str) -> str:
    """What is changed once links are read: emphasis, LaTeX and affiliation marks go, blanks are collapsed, addresses stay."""
    t = outside_links(clean_early_value(s), lambda x: re.sub(r"\*{1,3}([^*\n]+)\*{1,3}", r"\1", unwrap_value(x)))
    t = outside_links(t, lambda x: re.sub(r"(?<=\w)[†‡§¶]+|\^\{?[\d,*†‡§¶ ]+\}?", "", x))
    return " ".join(t.split())


_WATERMARK = re.compile(r"^(?:accepted manuscript|author manuscript|preprint|draft|confidential|in press)\b[\s:.-]*", re.IGNORECASE)


def heading_value(s: str) -> str:
    """A heading fit for display: emphasis, watermark and trailing marks off, one blank behind its number, spaced letters joined."""
    t = " ".join(re.sub(r"[*_#]{1,3}", "", s).split())
    rest = _WATERMARK.sub("", t)
    t = rest or t
    t = re.sub(r"^(\d+(?:\.\d+)*)\.?\s*(?=[A-ZÀ-Þ])", r"\1 ", t)
    t = re.sub(r"\b(?:\w ){3,}\w\b", lambda m: m[0].replace(" ", ""), t)
    return t.rstrip(" .:;,")


nfc, nfkc = (_text(lambda s, form=form: unicodedata.normalize(form, s)) for form in ("NFC", "NFKC"))
casefold, unescape, fold, squash = _text(str.casefold), _text(html.unescape), _text(fold_value), _text(squash_value)
repair, unwrap_latex, clean_early, clean_late, heading = _text(repair_value), _text(unwrap_value), _text(clean_early_value), _text(clean_late_value), _text(heading_value)


def normalize(c: Column) -> Column:
    """Normal form, then the heading key of ``text.heading_key``."""
    from .text import heading_key

    return heading_key(nfc(c))
