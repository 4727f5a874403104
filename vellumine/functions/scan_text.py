"""Readings of scanned pages: table tokens, neighbouring rows that belong together, and lists."""

from __future__ import annotations

import re

GRID = "struct<rows:array<array<string>>,complete:boolean,html:string>"
_TOKEN = re.compile(r"<(fcel|ecel|lcel|ucel|xcel|nl|ched|rhed|srow)>")


def otsl(text: str | None) -> dict | None:
    """A table in the token language of table recognisers: rows with spans written out, whether every row is whole, and HTML.

    ``fcel``, ``ched``, ``rhed`` and ``srow`` open a cell with text, ``ecel`` an empty one; ``lcel`` continues the cell to its left,
    ``ucel`` the one above, ``xcel`` both. A last row that is cut short is padded and marks the table as not complete. Null
    for a text without tokens.
    """
    parts = _TOKEN.split(text or "")
    if len(parts) < 3:
        return None
    rows: list[list[tuple[str, str]]] = [[]]
    for kind, content in zip(parts[1::2], parts[2::2]):
        if kind == "nl":
            rows.append([])
        else:
            rows[-1].append((kind, " ".join(content.split())))
    ended = not rows[-1]
    rows = [r for r in rows if r]
    width = max(map(len, rows))
    complete = ended and all(len(r) == width for r in rows)
    rows = [r + [("ecel", "")] * (width - len(r)) for r in rows]
    grid = [[""] * width for _ in rows]
    origin = [[(i, j) for j in range(width)] for i in range(len(rows))]
    for i, row in enumerate(rows):
        for j, (kind, content) in enumerate(row):
            if kind in ("lcel", "xcel") and j:
                origin[i][j] = origin[i][j - 1]
            elif kind in ("ucel", "xcel") and i:
                origin[i][j] = origin[i - 1][j]
            grid[i][j] = content if origin[i][j] == (i, j) else grid[origin[i][j][0]][origin[i][j][1]]
    spans: dict[tuple[int, int], list[int]] = {}
    for i in range(len(rows)):
        for j in range(width):
            a, b = origin[i][j]
            high, wide = spans.setdefault((a, b), [1, 1])
            spans[a, b] = [max(high, i - a + 1), max(wide, j - b + 1)]
    escape = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    body = "".join(
        "<tr>"
        + "".join(
            f"<{tag}{f' rowspan="{spans[i, j][0]}"' if spans[i, j][0] > 1 else ''}{f' colspan="{spans[i, j][1]}"' if spans[i, j][1] > 1 else ''}>{escape(grid[i][j])}</{tag}>"
            for j in range(width)
            if origin[i][j] == (i, j)
            for tag in ["th" if rows[i][j][0] in ("ched", "rhed") else "td"]
        )
        + "</tr>"
        for i in range(len(rows))
    )
    return {"rows": grid, "complete": complete, "html": f"<table>{body}</table>"}


def tidy_reading(text: str | None) -> str | None:
    """A region's reading without fences, repeated lines and stray marks, its bullets as dashes; null stays null."""
    if text is None:
        return None
    t = re.sub(r"^```\w*\n?|\n?```$", "", text.strip())
    out: list[str] = []
    for line in t.split("\n"):
        line = re.sub(r"^\s*[•▪●◦‣·]\s*", "- ", line).rstrip()
        if not (out and line and line == out[-1]):
            out.append(line)
    return "\n".join(out).strip()


REGIONS = "array<struct<label:string,text:string,parts:int>>"


def merged_regions(labels: list[str] | None, texts: list[str] | None) -> list[dict]:
    """Neighbouring regions put together: an equation with the number beside it, and a text that runs on in lower case."""
    out: list[dict] = []
    for label, text in zip(labels or [], texts or []):
        text = (text or "").strip()
        last = out[-1] if out else None
        if last and last["label"] == "formula" and label == "formula_number" and re.fullmatch(r"\(?\w{1,4}(?:\.\w{1,3})?\)?", text):
            last["text"], last["parts"] = f"{last['text']} {text}", last["parts"] + 1
        elif last and label == last["label"] == "text" and text[:1].islower() and not re.search(r"[.!?:;]$", last["text"]):
            broken = re.search(r"[a-zà-ÿ]-$", last["text"])
            last["text"] = last["text"][:-1] + text if broken else f"{last['text']} {text}"
            last["parts"] += 1
        else:
            out.append({"label": label, "text": text, "parts": 1})
    return out
