"""JATS and TEI XML, DOCX and ePub files read to the same blocks as web pages; discovery, content sniffing and paper ids."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from xml.parsers import expat

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import html

#: Bytes that one member of a zipped document may unpack to, and bytes of a file of each kind; larger ones are refused with a problem.
MAX_MEMBER = 64 << 20
MAX_BYTES = {"html": 48 << 20, "jats": 48 << 20, "tei": 48 << 20, "docx": 128 << 20, "epub": 128 << 20, "pdf": 256 << 20}
SUPPORTED = ("pdf", "docx", "xml", "html", "htm", "epub")
#: Kinds that are known but never read, by their extension.
REFUSED = ("doc", "docm", "exe", "js", "odt", "rtf", "tex", "zip")
PAPER = "title string, doi string, blocks array<struct<kind:string,level:int,parent:int,text:string>>, problem string, authors array<string>, tables array<array<array<string>>>, printed array<string>, notes array<string>"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"


class Paper:
    """What is read of one file."""

    def __init__(self):
        self.title = self.doi = None
        self.authors, self.blocks, self.tables, self.references, self.notes = [], [], [], [], []
        self.open: list[tuple[int, int]] = []

    def heading(self, level: int, text: str) -> None:
        if text:
            while self.open and self.open[-1][0] >= level:
                self.open.pop()
            self.blocks.append(("heading", level, self.open[-1][1] if self.open else None, text))
            self.open.append((level, len(self.blocks) - 1))

    def block(self, kind: str, text: str) -> None:
        if text:
            self.blocks.append((kind, None, self.open[-1][1] if self.open else None, text))

    def row(self) -> tuple:
        title = self.title or next((b[3] for b in self.blocks if b[0] == "heading"), None)
        return title, self.doi, self.blocks, None, self.authors, self.tables, self.references, self.notes


def _local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _prolog(data: bytes) -> None:
    """Refuse entity definitions, which could expand without bound, wherever they stand before the root element."""

    class Begun(Exception):
        pass

    def begun(*_):
        raise Begun

    def defined(*_):
        raise ValueError("entity definitions are refused")

    parser = expat.ParserCreate()
    parser.EntityDeclHandler, parser.StartElementHandler = defined, begun
    try:
        parser.Parse(data, True)
    except (Begun, expat.ExpatError):
        pass


def _safe_xml(data: bytes) -> ET.Element:
    _prolog(data)
    return ET.fromstring(data)


# --- mathematics -------------------------------------------------------------------------------------------------------

_SCRIPTS = {"msup": "^", "msub": "_", "mfrac": "/", "munder": "_", "mover": "^"}


def flat_math(e: ET.Element) -> str:
    """Presentation MathML in a line: operators stand between blanks, scripts behind ^ and _, fractions as a/b, roots as √()."""
    name, parts = _local(e), [flat_math(x) for x in e if _local(x) != "annotation"]
    if name in ("mi", "mn", "mtext", "ms"):
        return " ".join((e.text or "").split())
    if name == "mo":
        t = (e.text or "").strip()
        return t if t in "()[]{}|," else f" {t} "
    group = lambda t: f"({t.strip()})" if " " in t.strip() else t.strip()
    if name in _SCRIPTS and len(parts) == 2:
        return group(parts[0]) + _SCRIPTS[name] + group(parts[1])
    if name == "msubsup" and len(parts) == 3:
        return f"{group(parts[0])}_{group(parts[1])}^{group(parts[2])}"
    if name == "msqrt":
        return "√(" + " ".join("".join(parts).split()) + ")"
    out = ""
    for p in parts:
        out += (" " if out and p and out[-1].isalnum() and p[0].isalnum() else "") + p
    return re.sub(r"\s+", " ", out)


def _flat(e: ET.Element, skip: tuple[str, ...] = ()) -> str:
    """Text of an element without the elements ``skip``; mathematics as ``flat_math`` gives it."""
    out: list[str] = []
    todo: list = [e]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif _local(x) == "math":
            out.append(" " + flat_math(x) + " ")
        elif x is e or _local(x) not in skip:
            out.append(x.text or "")
            for child in reversed(x):
                todo += [child.tail or "", child]
    return " ".join("".join(out).split())


# --- formats -----------------------------------------------------------------------------------------------------------


def _xml_matrix(table: ET.Element) -> list[list[str]]:
    """Cells of an XML table with their spans written out, through the reader of web tables."""

    def node(e: ET.Element) -> html.Node:
        n = html.Node(_local(e).lower(), {k.rsplit("}", 1)[-1].lower(): v for k, v in e.attrib.items()})
        n.items = [e.text or ""]
        for x in e:
            n.items += [node(x), x.tail or ""]
        return n

    return html.matrix(node(table))[0]


def _jats(data: bytes) -> Paper:
    root, out = _safe_xml(data), Paper()
    first = lambda name, ok=lambda e: True: next((_flat(e, ("fn", "xref")) for e in root.iter() if _local(e) == name and ok(e)), None)
    out.title = first("article-title") or None
    out.doi = first("article-id", lambda e: e.get("pub-id-type") == "doi")
    for c in (e for e in root.iter() if _local(e) == "contrib" and e.get("contrib-type", "author") == "author"):
        part = lambda n: next((_flat(x) for x in c.iter() if _local(x) == n), "")  # noqa: E731, B023
        name = f"{part('given-names')} {part('surname')}".strip() or part("collab")
        if name:
            out.authors.append(name)

    def section(e: ET.Element, level: int) -> None:
        for x in e:
            name = _local(x)
            if name == "title":
                out.heading(level, _flat(x))
            elif name in ("p", "disp-quote", "disp-formula"):
                for wrap in (w for w in x if _local(w) in ("table-wrap", "list")):
                    section([wrap], level)
                out.block("paragraph", _flat(x, ("table-wrap", "list", "fn")))
            elif name in ("sec", "abstract", "app", "ack", "app-group", "fn-group", "notes", "glossary"):
                section(x, level + (name != "app-group"))
            elif name == "list":
                for i in (i for i in x if _local(i) == "list-item"):
                    out.block("item", _flat(i))
            elif name == "table-wrap":
                out.block("caption", " ".join(filter(None, (_flat(c) for c in x if _local(c) in ("label", "caption")))))
                out.tables += [_xml_matrix(t) for t in x.iter() if _local(t) == "table"]
            elif name == "fig":
                out.block("caption", " ".join(filter(None, (_flat(c) for c in x if _local(c) in ("label", "caption")))))
            elif name == "fn":
                out.notes.append(_flat(x))
            elif name == "ref-list":
                out.references += [_flat(next((c for c in r if _local(c) in ("mixed-citation", "element-citation", "citation")), r)) for r in x.iter() if _local(r) == "ref"]

    for e in root.iter():
        if _local(e) in ("body", "back"):
            section(e, 0)
        elif _local(e) == "abstract":
            section(e, 1)
    out.notes += [_flat(e) for e in root.iter() if _local(e) == "fn" and not any(_flat(e) == n for n in out.notes)]
    return out


def _tei(data: bytes) -> Paper:
    """TEI as converters of scholarly documents write it: header title and authors, abstract, divisions and cited works."""
    root, out = _safe_xml(data), Paper()
    header = next((e for e in root.iter() if _local(e) == "teiHeader"), ET.Element("x"))
    out.title = next((_flat(e) for e in header.iter() if _local(e) == "title" and _flat(e)), None)
    out.doi = next((_flat(e) for e in header.iter() if _local(e) == "idno" and e.get("type", "").upper() == "DOI"), None)
    names = lambda e: [" ".join(_flat(x) for x in n if _local(x) in ("forename", "surname")) for n in e.iter() if _local(n) == "persName"]
    source = next((e for e in header.iter() if _local(e) == "sourceDesc"), header)
    out.authors = [n for n in dict.fromkeys(names(source)) if n]
    for a in (e for e in header.iter() if _local(e) == "abstract"):
        out.heading(1, "Abstract")
        for p in (p for p in a.iter() if _local(p) == "p"):
            out.block("paragraph", _flat(p))
    for body in (e for e in root.iter() if _local(e) == "body"):
        for x in body.iter():
            if _local(x) == "head":
                number = x.get("n", "").strip(".")
                out.heading(number.count(".") + 1 if number else 1, " ".join(filter(None, (number, _flat(x)))))
            elif _local(x) in ("p", "formula"):
                out.block("paragraph", _flat(x))
            elif _local(x) == "table":
                out.tables.append([[_flat(c) for c in r if _local(c) == "cell"] for r in x.iter() if _local(r) == "row"])
    for b in (e for e in root.iter() if _local(e) == "listBibl"):
        out.references += [next((_flat(n) for n in r.iter() if _local(n) == "note" and n.get("type") == "raw_reference"), _flat(r)) for r in b if _local(r) == "biblStruct"]
    return out


def _member(z: zipfile.ZipFile, name: str) -> bytes:
    if z.getinfo(name).file_size > MAX_MEMBER:
        raise ValueError(f"{name} is too large")
    return z.read(name)


def _run_text(e: ET.Element) -> str:
    """Text of a paragraph: runs, tabs and breaks, and the text of its formulas."""
    out = []
    for x in e.iter():
        if x.tag in (f"{_W}t", f"{_M}t"):
            out.append(x.text or "")
        elif x.tag in (f"{_W}tab", f"{_W}br"):
            out.append(" ")
    return " ".join("".join(out).split())


def _docx(data: bytes) -> Paper:
    z, out = zipfile.ZipFile(io.BytesIO(data)), Paper()
    body = _safe_xml(_member(z, "word/document.xml"))
    inside = {id(p) for t in body.iter(f"{_W}tbl") for p in t.iter(f"{_W}p")}
    nested = {id(t) for outer in body.iter(f"{_W}tbl") for t in outer.iter(f"{_W}tbl") if t is not outer}
    for e in body.iter():
        if e.tag == f"{_W}tbl" and id(e) not in nested:
            out.tables.append([[" ".join(filter(None, (_run_text(p) for p in c.iter(f"{_W}p")))) for c in r.findall(f"{_W}tc")] for r in e.findall(f"{_W}tr")])
        if e.tag != f"{_W}p" or id(e) in inside:
            continue
        text = _run_text(e)
        style = next((s.get(f"{_W}val", "") for s in e.iter(f"{_W}pStyle")), "")
        outline = next((int(o.get(f"{_W}val", 9)) + 1 for o in e.iter(f"{_W}outlineLvl")), None)
        level = outline or (int(m[1]) if (m := re.match(r"(?i)heading\s*(\d)", style)) else None)
        if style.lower() == "title" and text:
            out.title = out.title or text
        elif level and level <= 6:
            out.heading(level, text)
        else:
            out.block("caption" if style.lower() == "caption" else "item" if "list" in style.lower() else "paragraph", text)
    for part in ("word/footnotes.xml", "word/endnotes.xml"):
        if part in z.namelist():
            out.notes += [t for n in _safe_xml(_member(z, part)) if n.get(f"{_W}type") is None and (t := _run_text(n))]
    return out


def _epub(data: bytes) -> Paper:
    z, out = zipfile.ZipFile(io.BytesIO(data)), Paper()
    container = _safe_xml(_member(z, "META-INF/container.xml"))
    opf = next(e.get("full-path") for e in container.iter() if _local(e) == "rootfile")
    package = _safe_xml(_member(z, opf))
    base = opf.rsplit("/", 1)[0] + "/" if "/" in opf else ""
    items = {e.get("id"): e.get("href") for e in package.iter() if _local(e) == "item"}
    out.title = next((_flat(e) for e in package.iter() if _local(e) == "title"), None)
    out.authors = [_flat(e) for e in package.iter() if _local(e) == "creator" and _flat(e)]
    for ref in (e.get("idref") for e in package.iter() if _local(e) == "itemref"):
        if items.get(ref):
            page = html.parse(_member(z, base + items[ref].split("#")[0]).decode("utf-8", "replace"))
            shift = len(out.blocks)
            out.blocks += [(k, n, None if p is None else p + shift, t) for k, n, p, t in page[4]]
            out.tables += page[6]
    return out


def _web(data: bytes) -> Paper:
    out = Paper()
    out.title, _, out.doi, _, out.blocks, _, out.tables, _ = html.parse(data.decode("utf-8", "replace"))
    return out


READERS = {"html": _web, "jats": _jats, "tei": _tei, "docx": _docx, "epub": _epub}


def parse_jats(data: bytes) -> tuple:
    """A row of PAPER; raises what the XML parser raises."""
    return _jats(data).row()


def parse_any(kind: str | None, data: bytes | None) -> tuple:
    """A row of PAPER; a file that cannot be read, is too large or of no known kind gives its problem and nothing else."""
    data = data or b""
    try:
        if kind == "zip":
            zipfile.ZipFile(io.BytesIO(bytes(data)))
        if kind in READERS and len(data) <= MAX_BYTES[kind]:
            return READERS[kind](bytes(data)).row()
        problem = "too_large" if kind in READERS else "unsupported"
    except (ET.ParseError, ValueError, KeyError, StopIteration, RecursionError, zipfile.BadZipFile) as e:
        problem = type(e).__name__
    return None, None, [], problem, [], [], [], []


def sniff(content: Column) -> Column:
    """Kind of a file by its content: the first bytes, and for zipped documents the names in their directory at the end."""
    text = lambda c: F.decode(c, "ISO-8859-1")
    head, tail = F.lower(text(F.substring(content, 1, 2048))), text(F.substring(content, -65536, 65536))
    raw = F.hex(F.substring(content, 1, 4))
    return (
        F.when(raw == "25504446", "pdf")
        .when((raw == "504B0304") & (head.contains("application/epub+zip") | tail.contains("META-INF/container.xml")), "epub")
        .when((raw == "504B0304") & tail.contains("word/document.xml"), "docx")
        .when(raw == "504B0304", "zip")
        .when(head.contains("<tei") | head.contains("tei-c.org"), "tei")
        .when(head.contains("<article") & (head.contains("<?xml") | ~head.contains("<html")) | head.contains("jats"), "jats")
        .when(head.rlike(r"<!doctype html|<html"), "html")
        .otherwise("unknown")
    )


#: Ids that could be taken for ones with a piece of a hash get one of their own, so that no two rules give one id.
_SUFFIXED = r"-[0-9a-f]{8}(\.\d+)?$"


def paper_ids(files: DataFrame, recorded: DataFrame | None = None) -> DataFrame:
    """``files`` (path, content) with sha256 and a paper_id that is unique without regard to case.

    It is the stem; where stems meet, also with those of ``recorded`` (path, paper_id), it has the first eight digits of the hash
    behind it, and of equal stems with equal such digits those behind the first by path are numbered. Recorded ids stay.
    """
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]+$", "")
    rows = files.withColumn("sha256", F.sha2("content", 256)).withColumn("stem", F.when(stem == "", "file").otherwise(stem))
    taken = None
    if recorded is not None:
        rows = rows.join(recorded.select("path", F.col("paper_id").alias("kept")), "path", "left")
        taken = recorded.select(F.lower("paper_id").alias("id"), F.regexp_replace(F.lower("paper_id"), r"\.\d+$", "").alias("base"), F.coalesce(F.regexp_extract(F.lower("paper_id"), r"-[0-9a-f]{8}\.(\d+)$", 1).try_cast("int"), F.lit(1)).alias("n"))
        natural = taken.select(F.col("id").alias("low")).distinct().withColumn("met", F.lit(True))
        rows = rows.withColumn("low", F.lower("stem")).join(natural, "low", "left").drop("low")
    else:
        rows = rows.withColumn("kept", F.lit(None).cast("string")).withColumn("met", F.lit(None).cast("boolean"))
    many = F.count(F.when(F.col("kept").isNull(), 1)).over(Window.partitionBy(F.lower("stem"))) > 1
    base = F.when(many | F.col("met").isNotNull() | F.lower("stem").rlike(_SUFFIXED), F.concat_ws("-", "stem", F.substring("sha256", 1, 8))).otherwise(F.col("stem"))
    rows = rows.withColumn("base", F.when(F.col("kept").isNull(), base)).withColumn("low", F.lower("base"))
    if taken is not None:
        rows = rows.join(taken.groupBy(F.col("base").alias("low")).agg(F.max("n").alias("used")), "low", "left")
    else:
        rows = rows.withColumn("used", F.lit(None).cast("int"))
    place = F.row_number().over(Window.partitionBy("low").orderBy("path")) + F.coalesce("used", F.lit(0))
    made = F.when(place > 1, F.concat_ws(".", "base", place.cast("string"))).otherwise(F.col("base"))
    return rows.withColumn("paper_id", F.coalesce("kept", made)).drop("stem", "base", "low", "kept", "met", "used")


def _listed(rows: DataFrame) -> DataFrame:
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    problem = F.when(kind.isin(*REFUSED), "refused").when(~kind.isin(*SUPPORTED), "unsupported").when(F.col("bytes") == 0, "empty")
    return rows.withColumn("problem", problem).withColumn("supported", F.col("problem").isNull())


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Paths listed one a line, with their place; blank lines and comments go. What is no input has its problem beside it."""
    line = F.trim("value")
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("place"), line.alias("path"), F.lit(None).cast("long").alias("bytes"))
    return _listed(rows.where((F.col("path") != "") & ~F.col("path").startswith("#")))


def discover(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder at any depth: path, bytes, problem, supported; contents are not read. Spark lists no empty files."""
    return _listed(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes")))


def validated(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files to read, quarantined files with their problem) of path and content; sniffed kinds decide, not extensions."""
    kind = sniff(F.col("content"))
    size = F.octet_length("content")
    limit = F.create_map(*[x for k, v in MAX_BYTES.items() for x in (F.lit(k), F.lit(v))])[kind]
    problem = F.when(F.col("content").isNull() | (size == 0), "empty").when(~kind.isin(*READERS, "pdf"), "unsupported").when(size > limit, "too_large").when(kind == "pdf", "no_text_layer_reader")
    rows = files.withColumn("kind", kind).withColumn("problem", problem)
    return rows.where("problem IS NULL").drop("problem"), rows.where("problem IS NOT NULL").drop("content")


def read_papers(files: DataFrame, *keep: str) -> DataFrame:
    """paper_id, kind, sha256 and the parsed document of binary files (path, content), with their columns ``keep``."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    from ..functions.arrow import bounded_batches

    bounded_batches(files.sparkSession)
    rows = paper_ids(files).select("paper_id", "sha256", sniff(F.col("content")).alias("kind"), *keep, "content")
    kept = "".join(f"`{c}` {t}, " for c, t in rows.dtypes if c in keep)
    schema = _parse_datatype_string(f"paper_id string, sha256 string, kind string, {kept}{PAPER}")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            got = [parse_any(k, c) for k, c in zip(batch.column("kind").to_pylist(), batch.column("content").to_pylist())]
            blocks = [[dict(zip(("kind", "level", "parent", "text"), b)) for b in g[2]] for g in got]
            columns = [batch.column("paper_id"), batch.column("sha256"), batch.column("kind"), *map(batch.column, keep), *([g[i] for g in got] if i != 2 else blocks for i in range(8))]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, arrow)], names=[f.name for f in arrow])

    return rows.mapInArrow(run, schema)
