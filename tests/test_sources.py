import io
import zipfile

import pytest
from pyspark.sql import functions as F

from vellumine.operators import ledger
from vellumine.sources import html, papers, sinks
from vellumine.streaming import ledger_stream


def test_html_structure():
    page = "<html lang=en><head><title>T</title><meta name=citation_doi content='doi:10.1000/x'></head><body><nav>no</nav><h1>A</h1><p>x<b>y</b> z<p>k<h2>B</h2><table><tr><td rowspan=2>a<td>b<tr><td>c</table><div role=banner>no</div></body>"
    title, lang, doi, _, blocks, _, tables, refused = html.parse(page)
    assert (title, lang, doi, refused) == ("T", "en", "10.1000/x", 0)
    assert blocks == [("heading", 1, None, "A"), ("paragraph", None, 0, "xy z"), ("paragraph", None, 0, "k"), ("heading", 2, 0, "B")]
    assert tables == [[["a", "b"], ["a", "c"]]]
    assert html.parse(None)[4] == [] and html.parse("<p")[4] == []
    assert html.parse("<table><tr><td colspan=999999>x</table>")[7] == 1


def test_html_of_any_depth_and_size():
    assert [b[3] for b in html.parse("<div>" * 3000 + "<p>x" + "</div>" * 3000)[4]] == ["x"]
    assert [b[3] for b in html.parse("<b>" * 3000 + "x")[4]] == ["x"]
    assert html.parse("words </artic")[4] == [("paragraph", None, None, "words")] and html.parse("1 < 2")[4] == [("paragraph", None, None, "1 < 2")]
    wide = "<table>" + "<tr><td>a<td>b</tr>" * 150_000 + "</table>"
    tables, unspanned = html.parse(wide)[6:]
    assert unspanned == 1 and len(tables[0]) == 150_000 and tables[0][-1] == ["a", "b"]
    assert html.parse("<table><tr><td colspan=999999>x<td>y</table>")[6] == [[["x", "y"]]]


def test_html_tables():
    hidden = "<table><tr hidden><td>no<tr><td>a<td style='display: none'>no<td>b<br>c</tr></table><table aria-hidden=true><tr><td>no</table>"
    assert html.parse(hidden)[6] == [[["a", "b c"]]]
    nested = "<table><tr><td>out<table><tr><td>in</table><td>next</table>"
    assert html.parse(nested)[6] == [[["out in", "next"]]]
    # Spans against a brute-force walk of the cells.
    import random

    rng = random.Random(3)
    for _ in range(60):
        rows = [[(rng.randint(1, 3), rng.randint(1, 3), f"{r}.{k}") for k in range(rng.randint(0, 4))] for r in range(rng.randint(1, 5))]
        page = "<table>" + "".join("<tr>" + "".join(f"<td rowspan={h} colspan={w}>{t}</td>" for h, w, t in row) + "</tr>" for row in rows) + "</table>"
        grid = {}
        for r, row in enumerate(rows):
            for h, w, t in row:
                c = min(c for c in range(99) if (r, c) not in grid)
                grid.update({(i, j): t for i in range(r, min(r + h, len(rows))) for j in range(c, c + w)})
        width = max((c for _, c in grid), default=-1) + 1
        assert html.parse(page)[6] == [[[grid.get((r, c), "") for c in range(width)] for r in range(len(rows))]]


def _zip(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/").replace("_X", "."), data)
    return out.getvalue()


def test_papers(spark, tmp_path):
    jats = b'<?xml version="1.0"?><article><front><article-id pub-id-type="doi">10.1/x</article-id><article-title>J</article-title></front><body><sec><title>Intro</title><p>One.</p></sec></body></article>'
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx = _zip(word__document_Xxml=f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>H</w:t></w:r></w:p><w:p><w:r><w:t>P</w:t></w:r></w:p></w:body></w:document>')
    rows = [("a/one.xml", jats), ("b/ONE.docx", docx), ("c/two.html", b"<html><body><h1>W</h1><p>x</body></html>"), ("d/bad.docx", b"PK\x03\x04broken"), ("e/none.bin", b"")]
    files = spark.createDataFrame(rows, "path string, content binary")
    got = {r["paper_id"]: r for r in papers.read_papers(files).collect()}
    assert len(got) == 5 and sum(k.lower().startswith("one-") for k in got) == 2
    assert got["two"]["kind"] == "html" and [b["text"] for b in got["two"]["blocks"]] == ["W", "x"]
    assert got["bad"]["problem"] == "BadZipFile" and got["none"]["problem"] == "unsupported"
    one = next(r for k, r in got.items() if r["kind"] == "jats")
    assert one["doi"] == "10.1/x" and [b["text"] for b in one["blocks"]] == ["Intro", "One."]
    assert papers.parse_jats(b"<article/>")[2] == []
    assert papers.parse_any("jats", b'<!DOCTYPE a [<!ENTITY x "y">]><article/>')[3] == "ValueError"


def test_write_tables(spark, tmp_path):
    paper = spark.createDataFrame([("p", "t")], "paper_id string, title string")
    sinks.write_tables({"paper": paper, "eq": paper.where("false")}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/eq")).columns == ["paper_id", "title"]
    with pytest.raises(ValueError):
        sinks.write_tables({"paper": paper.union(paper)}, str(tmp_path / "out"))


def test_cite_keys_are_unique(spark):
    rows = [("p", i, [("Fam", "A.")], 2001) for i in range(30)]
    df = spark.createDataFrame(rows, "paper_id string, bib_id int, authors array<struct<family:string,given:string>>, year int")
    assert sinks.cite_keys(df).select("cite_key").distinct().count() == 30


def test_breaker_steps():
    state, seen = ("closed", 0, 0.0), []
    for at, ok in [(0, False)] * 5 + [(1, True), (40, True), (41, False)]:
        state = ledger_stream.step(state, at, ok)
        seen.append(state[0])
    assert seen == ["closed"] * 4 + ["open", "open", "closed", "closed"]


def test_failures_of_one_incident_count_once():
    state, seen = ("closed", 0, 0.0), []
    for at in (0, 1, 1.5, 3, 5.5, 8, 9, 10.5, 12):
        state = ledger_stream.step(state, float(at), False, within=ledger_stream.INCIDENT_SECONDS)
        seen.append(state[:2])
    assert seen == [("closed", 1)] * 3 + [("closed", 2), ("closed", 3), ("closed", 4), ("closed", 4), ("open", 5), ("open", 5)]
    assert ledger_stream.step(state, 40.5, False, within=2.0) == ("open", 1, 40.5) and ledger_stream.step(state, 40.5, True) == ("closed", 0, 10.5)


def swept(jobs, now, ttl, most, budget):
    """Evicts the oldest job of a store again and again."""
    alive = [j for j in jobs if j[2] is None or now - j[2] <= ttl]
    for store in {j[0] for j in jobs}:
        done = sorted((j for j in alive if j[0] == store and j[2] is not None), key=lambda j: (j[2], j[1]))
        while done and (len(done) > most or (budget > 0 and len(done) > 1 and sum(j[3] or 0 for j in done) > budget)):
            alive.remove(done.pop(0))
    return sorted((j[1] for j in alive), key=str)


@pytest.mark.parametrize("ttl, most, budget", [(50, 5, 40), (200, 3, 0), (200, 0, 10), (40, 100, 25), (200, 4, 1)])
def test_retention_against_eviction_one_by_one(spark, ttl, most, budget):
    import random

    rng = random.Random(ttl + most)
    jobs = [(rng.choice([None, 1, 2]), i, rng.choice([None, *range(90, 190, 7)]), rng.choice([None, 0, 9, 30])) for i in range(60)]
    schema = "store long, job_id long, finished double, size long"
    rows = spark.createDataFrame([(a, b, c and float(c), d) for a, b, c, d in jobs], schema).withColumn("finished", F.timestamp_seconds("finished"))
    now = F.timestamp_seconds(F.lit(190))
    assert sorted((r["job_id"] for r in ledger.retained(rows, now, ttl, most, budget).collect()), key=str) == swept(jobs, 190, ttl, most, budget)
    assert ledger.retained(rows.where("false"), now, ttl, most, budget).count() == 0


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(1, float(i), False) for i in range(5)] + [(1, 50.0, True), (2, 0.0, True)]
    spark.createDataFrame(rows, "key long, at double, ok boolean").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("key long, at double, ok boolean").parquet(src)
    q = ledger_stream.breaker(stream).writeStream.format("memory").queryName("breaker").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r["state"] for r in spark.sql("SELECT * FROM breaker ORDER BY at").collect()] == ["open", "closed"]
    log = str(tmp_path / "log")
    spark.createDataFrame([(1, 1, "failed"), (1, 2, "ok"), (2, 3, "started")], "paper_id long, line_no long, status string").write.parquet(log)
    q = ledger_stream.latest_verdicts(spark.readStream.schema("paper_id long, line_no long, status string").parquet(log)).writeStream.format("memory").queryName("verdicts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("SELECT paper_id, status, verdicts FROM verdicts").collect()] == [(1, "ok", 2)]


def test_running_plan_ends_as_the_plan_of_the_whole_log(spark, tmp_path):
    import random

    rng = random.Random(2)
    lines = [(rng.randint(1, 12), n, rng.choice(["started", "started", "failed", "ok", "skipped"])) for n in range(120)]
    schema, path = "paper_id long, line_no long, status string", str(tmp_path / "log")
    q = None
    for part in (lines[:50], lines[50:90], lines[90:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        q = q or ledger_stream.running_plan(spark.readStream.schema(schema).parquet(path)).writeStream.format("memory").queryName("plan").outputMode("update").start()
        q.processAllAvailable()
    q.stop()
    last = {r["paper_id"]: (r["unsettled"], r["runs_again"]) for r in spark.table("plan").collect()}
    whole = ledger.unsettled(spark.createDataFrame(lines, schema), F.col("status") == "failed").collect()
    assert last == {r["paper_id"]: (r["unsettled"], r["runs_again"]) for r in whole}


def test_jats_in_full():
    data = b"""<?xml version="1.0"?><!DOCTYPE article [<!ELEMENT x ANY>]><article xmlns:m="http://www.w3.org/1998/Math/MathML"><front><article-title>Tides<xref>1</xref></article-title>
    <contrib-group><contrib contrib-type="author"><name><surname>Alder</surname><given-names>Ada</given-names></name></contrib><contrib contrib-type="author"><collab>Kelp Group</collab></contrib></contrib-group></front>
    <body><sec><title>Intro</title><p>Let <m:math><m:msup><m:mi>x</m:mi><m:mn>2</m:mn></m:msup><m:mo>=</m:mo><m:mfrac><m:mi>a</m:mi><m:mi>b</m:mi></m:mfrac></m:math> hold.<list><list-item><p>one</p></list-item></list></p>
    <table-wrap><label>Table 1</label><caption><p>Cap</p></caption><table><tr><td rowspan="2">a</td><td>b</td></tr><tr><td>c</td></tr></table></table-wrap></sec></body>
    <back><fn-group><fn><p>Note</p></fn></fn-group><ref-list><ref><mixed-citation>Alder (2001).</mixed-citation></ref></ref-list></back></article>"""
    title, _, blocks, problem, authors, tables, refs, notes = papers.parse_any("jats", data)
    assert (title, problem, authors, tables, refs, notes) == ("Tides", None, ["Ada Alder", "Kelp Group"], [[["a", "b"], ["a", "c"]]], ["Alder (2001)."], ["Note"])
    assert [b[3] for b in blocks] == ["Intro", "one", "Let x^2 = a/b hold.", "Table 1 Cap"]


def test_entities_anywhere_before_the_root():
    padding = b"<!-- " + b"x" * 300_000 + b" -->"
    assert papers.parse_any("jats", b'<?xml version="1.0"?>' + padding + b'<!DOCTYPE a [<!ENTITY x "y">]><article/>')[3] == "ValueError"
    assert papers.parse_any("jats", b"<article>" + b"<sec>" * 20_000)[3] is not None and papers.parse_any("html", None)[2] == []


def test_tei_docx_and_epub_in_full():
    tei = b"""<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><titleStmt><title>Tides</title></titleStmt><sourceDesc><author><persName><forename>Ada</forename><surname>Alder</surname></persName></author><idno type="DOI">10.5555/a</idno></sourceDesc>
    <abstract><p>Short.</p></abstract></teiHeader><text><body><div><head n="1.">Intro</head><p>Text.</p><head n="1.1">Sub</head></div></body><back><listBibl><biblStruct><note type="raw_reference">Raw ref.</note></biblStruct></listBibl></back></text></TEI>"""
    title, doi, blocks, problem, authors, _, refs, _ = papers.parse_any("tei", tei)
    assert (title, doi, problem, authors, refs) == ("Tides", "10.5555/a", None, ["Ada Alder"], ["Raw ref."])
    assert [(b[0], b[1], b[3]) for b in blocks] == [("heading", 1, "Abstract"), ("paragraph", None, "Short."), ("heading", 1, "1. Intro".replace(".", "", 1)), ("paragraph", None, "Text."), ("heading", 2, "1.1 Sub")]
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
    body = '<w:p><w:r><w:t>A</w:t><w:tab/><w:t>b</w:t></w:r><m:oMath><m:r><m:t>=c</m:t></m:r></m:oMath></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    docx = _zip(word__document_Xxml=f"<w:document {w}><w:body>{body}</w:body></w:document>", word__footnotes_Xxml=f'<w:footnotes {w}><w:footnote w:type="separator"><w:p/></w:footnote><w:footnote><w:p><w:r><w:t>Note</w:t></w:r></w:p></w:footnote></w:footnotes>')
    _, _, blocks, problem, _, tables, _, notes = papers.parse_any("docx", docx)
    assert ([b[3] for b in blocks], problem, tables, notes) == (["A b=c"], None, [[["x"]]], ["Note"])


def test_discovery_and_quarantine(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, data in [("a.html", b"<html><p>x</html>"), ("deep/b.xml", b"<article/>"), ("deep/c.doc", b"x"), ("d.bin", b"x"), ("e.html", b"")]:
        (tmp_path / "in" / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: r["problem"] for r in papers.discover(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.html": None, "b.xml": None, "c.doc": "refused", "d.bin": "unsupported"}
    (tmp_path / "list").write_text(" a.html \n\n# no\nb.xml\nc.exe\n")
    assert [(r["path"], r["problem"]) for r in papers.read_manifest(spark, str(tmp_path / "list")).orderBy("place").collect()] == [("a.html", None), ("b.xml", None), ("c.exe", "refused")]
    files = spark.createDataFrame([("a", b"<html>"), ("b", b""), ("c", None), ("d", b"%PDF-1.7"), ("e", b"zz")], "path string, content binary")
    good, bad = papers.validated(files)
    assert [r["path"] for r in good.collect()] == ["a"] and {r["path"]: r["problem"] for r in bad.collect()} == {"b": "empty", "c": "empty", "d": "no_text_layer_reader", "e": "unsupported"}


def test_paper_ids_are_unique_and_recorded_ones_stay(spark):
    import hashlib

    h = hashlib.sha256(b"1").hexdigest()[:8]
    rows = [("x/a.xml", b"1"), ("y/A.html", b"1"), ("z/a.pdf", b"2"), (f"q/a-{h}.xml", b"3"), ("only.xml", b"4"), (".xml", b"5"), ("n/a.xml", b"1")]
    files = spark.createDataFrame(rows, "path string, content binary")
    ids = {r["path"]: r["paper_id"] for r in papers.paper_ids(files).collect()}
    assert len({v.lower() for v in ids.values()}) == len(rows) and ids["only.xml"] == "only"
    again = papers.paper_ids(files.union(spark.createDataFrame([("m/only.xml", b"4")], files.schema)), spark.createDataFrame(list(ids.items()), "path string, paper_id string"))
    later = {r["path"]: r["paper_id"] for r in again.collect()}
    assert {k: later[k] for k in ids} == ids and len({v.lower() for v in later.values()}) == len(later)


def test_tables_survive_a_crash_between_renames(spark, tmp_path):
    out = tmp_path / "out"
    frame = lambda v: spark.createDataFrame([("p", v)], "paper_id string, title string")
    sinks.write_tables({"paper": frame("one")}, str(out))
    out.rename(tmp_path / "out.__old")  # as if the second rename had not come
    sinks.recover(spark, str(out))
    assert spark.read.parquet(str(out / "paper")).first()["title"] == "one"
    sinks.write_tables({"paper": frame("two")}, str(out))
    assert spark.read.parquet(str(out / "paper")).first()["title"] == "two" and sorted(p.name for p in tmp_path.iterdir()) == ["out"]


def test_bibtex_escapes_and_schema(spark):
    got = spark.range(1).select(sinks._tex(F.lit("a{b}~^\\_"))).first()[0]
    assert got == "a\\{b\\}\\textasciitilde{}\\textasciicircum{}\\textbackslash{}\\_"
    import json

    df = spark.createDataFrame([(1, ["x"])], "a long, b array<string>")
    strict, loose = (json.loads(sinks.schema_artifact({"t": df}, s)) for s in (True, False))
    assert strict["required"] == ["t"] and not strict["additionalProperties"] and loose["additionalProperties"] and "required" not in loose


def test_cache_computes_each_content_once(spark, tmp_path):
    from vellumine.sources.cache import cached

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b")], "id long, text string")
    seen = []

    def compute(missing):
        seen.append(missing.count())
        return missing.select("digest", F.length("content").alias("n"))

    for _ in range(2):
        got = {r["id"]: r["n"] for r in cached(rows, "text", "v1", str(tmp_path / "c"), compute).collect()}
        assert got == {1: 1, 2: 1, 3: None, 4: 1}
    cached(rows, "text", "v2", str(tmp_path / "c"), compute).count()
    assert seen == [3, 0, 3]


def test_ledger_lines(spark, tmp_path):
    from vellumine.operators import ledger

    rows, bad = ledger.read_lines(spark.createDataFrame([(1, '{"paper_id":"p","status":"ok","warnings":{"count":1,"codes":{"A":1}}}'), (2, "{"), (3, ""), (4, '{"paper_id":"p","status":"started"}'), (5, None), (6, "[]")], "line_no long, value string"))
    assert [r["status"] for r in rows.collect()] == ["ok"] and bad.first()["malformed"] == 2
    ledger.append_lines(rows, str(tmp_path / "log"))
    assert ledger.read_lines(spark.read.text(str(tmp_path / "log")).select(F.lit(1).cast("long").alias("line_no"), "value"))[0].count() == 1


def test_made_files_are_the_same_at_any_time(spark, monkeypatch):
    from vellumine.plans import source_queries

    made = {}
    for year in (2001, 2002):
        monkeypatch.setattr(zipfile.time, "localtime", lambda *_: (year, 1, 1, 0, 0, 0, 0, 1, 0))
        made[year] = [source_queries._file(i, ["a", "b"]) for i in range(4)]
    assert made[2001] == made[2002]
    files = spark.createDataFrame([(f"a/{i}", made[2001][i], i) for i in range(4)], "path string, content binary, no long")
    assert [(r["no"], r["kind"], len(r["blocks"])) for r in papers.read_papers(files, "no").orderBy("no").collect()] == [(0, "jats", 3), (1, "html", 3), (2, "docx", 3), (3, "epub", 3)]


def test_made_pages_are_dealt_out(spark, sf_dir):
    from vellumine.plans import source_queries

    cells = source_queries.table_cells(spark, sf_dir)
    assert cells.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
