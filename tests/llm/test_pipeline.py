"""Each stage of the pipeline against a brute-force version, on the stage's own input."""

import re

import pytest
from test_operators import LONG, ROWS, brute_near, check_packed


def test_stages(spark, sf_dir):
    import corpus_pipeline

    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        rows = [tuple(r) for r in docs.select("doc_id", "text", "source", "lang").collect()]
        if name == "packing":
            check_packed(out.collect(), [(r[0], r[1]) for r in rows])
            break
        assert out.columns == docs.columns
        out = spark.createDataFrame(out.collect(), docs.schema)
        left = {r["doc_id"] for r in out.collect()}
        if name == "language":
            assert left == {r[0] for r in rows if any(c.isalpha() for c in r[1] or "")}
        elif name == "exact dedup":
            first = {}
            for r in sorted(rows):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), r[0])
            assert left == set(first.values())
        elif name == "near dedup":
            rows.sort()
            _, root = brute_near([r[:2] for r in rows], 5)
            assert left == {rows[i][0] for i in range(len(rows)) if root[i] == i}
        else:
            words = {r[0]: len((r[1] or "").split()) for r in rows}
            total, kept = sum(words.values()), sum(words[i] for i in left)
            assert left <= set(words) and 0.5 * total < kept <= 0.8 * total
        docs = out
        seen.append(name)
    assert seen == ["language", "exact dedup", "near dedup", "mixture"]


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_awkward_tables(spark, sf_dir, empty):
    """Nulls, empty and very long texts, repeated rows and ids, ties, clashing names, and no row at all."""
    import corpus_pipeline

    clash = "__row_key2 string, root string, copies string, domain string, rid long, place long"
    rows = [] if empty else [(*r, "k", "r", "c", "d", 1, 2) for r in [*(r[:4] for r in ROWS), (None, None, None, None), (20, LONG, "en", None), (21, "one", "de", "b")]]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {clash}")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        got = out.collect()
        if empty:
            assert got == []
        elif name == "packing":
            assert {p["doc_id"] for p in got} == {r["doc_id"] for r in docs.collect()}
            break
        else:
            texts = [r["text"] for r in got]
            assert out.columns == docs.columns and texts and all(any(c.isalpha() for c in t or "") for t in texts)
            if name in ("exact dedup", "near dedup"):
                flat = [re.sub(r"[\x20\x09-\x0D]+", " ", t) for t in texts]
                assert len(flat) == len(set(flat)) and "one" in flat and None in {r["doc_id"] for r in got}
        docs = spark.createDataFrame(got, docs.schema) if name != "packing" else docs


def test_run_on_awkward_documents(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(*r, *["x"] * 7)[:4] for r in ROWS], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert pieces and all(p["length"] > 0 for p in pieces)
