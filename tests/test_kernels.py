from pyspark.sql import functions as F

from vellumine.functions import fuzzy
from vellumine.functions import text as T
from vellumine.operators import quality, sentences


def value(spark, column, **made):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in made.items()]) if made else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_doi(spark):
    for printed, want in [("https://doi.org/10.5555/abc.", "10.5555/abc"), ("10.5555//kelp-1", "10.5555/kelp-1"), ("10.5555/kelp-", None), ("", None), (None, None)]:
        assert value(spark, T.normalize_doi(F.lit(printed).cast("string"))) == want


def test_clean_url(spark):
    for printed, want in [("http://a/b).", "http://a/b"), ("http://a/S(16)0-X", "http://a/S(16)0-X"), ("http://a/b(c).)", "http://a/b(c)"), ("http://a/", "http://a/"), ("...", "")]:
        assert value(spark, T.clean_url(F.lit(printed))) == want


def test_dates(spark):
    for printed, want in [("15 January 2026", "2026-01-15"), ("30 February 2020", "2020-02"), ("2020/13/01", None), (" 1999 ", "1999"), ("Sept. 2012", "2012-09"), ("soon", None), ("2021, May 4", "2021-05-04"), ("2021 May 4", "2021-05-04"), ("May, 2020", "2020-05"),
        ("Received 1 May 2020, accepted 2 May 2020", None), ("Received 1 May 2020; published online 3 June 2020; revised 9 July 2020", "2020-06-03"), ("2020-05-04 and 4 May 2020", "2020-05-04"), ("in 1999 or so", None), (None, None)]:
        assert value(spark, T.iso_date(F.lit(printed).cast("string"))) == want, printed


def test_quality(spark):
    for text, want in [("", 1.0), ("a�b", 0.0), ("x x x x x", 0.0), ("#$%^&*()#$%^&*()#$%^&*", 0.0), ("t i d e x and t i d e x and t i d e x", 0.7), ("plain prose", 1.0)]:
        assert abs(value(spark, quality.rate(F.lit(text))) - want) < 1e-9


def test_sentences_empty_and_null(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "A b. C!\n\nD?")], "doc_id long, text string")
    rows = [tuple(r) for r in sentences.emit(df).orderBy("doc_id", "text_id").collect()]
    assert rows == [(3, 1, 1, "A b."), (3, 1, 2, "C!"), (3, 3, 3, "D?")]


def test_indel_against_dynamic_programme():
    import random

    random.seed(1)
    for _ in range(200):
        a, b = ("".join(random.choice("abc") for _ in range(random.randint(0, 12))) for _ in "ab")
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert fuzzy.lcs_length(a, b) == t[-1][-1]
    assert fuzzy.indel_ratio("", "") == 100 and fuzzy.partial_indel("abc", "xxabcxx") == 100


def test_redact(spark):
    assert value(spark, T.redact(F.lit('mail a.b@c.org password="hunter22"'))) == "mail <mail> password=<secret>"
    assert value(spark, T.redact(F.lit("x-api-key: abcdefgh12 at https://me:pw12@host/p ghp_abcdefghijklmnop"))) == "x-api-key: <secret> at https://<secret>@host/p <secret>"


def test_patterns_are_linear_in_blanks_and_marks(spark):
    import time

    long = {"blanks": "x" + " " * 300_000 + "y", "marks": "x" + ")" * 300_000 + "y"}
    began = time.time()
    for text in long.values():
        df = spark.createDataFrame([(text,)], "t string")
        c = F.col("t")
        df.select(*(F.length(f(c)) for f in (T.normalize_doi, T.doi_key, T.clean_url, T.collapse_ws, T.heading_key, T.repair_ocr, T.redact)), T.is_non_reference(c)).collect()
    assert time.time() - began < 30


def test_licences(spark):
    for printed, spdx, url in [
        ("CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0", "by-nc-sa/4.0/"), ("https://creativecommons.org/licenses/by/4.0/ (CC BY-NC 3.0)", "CC-BY-4.0", "by/4.0/"),
        ("a Creative Commons Attribution-NonCommercial-NoDerivatives License", None, "by-nc-nd/"), ("Creative Commons Attribution ShareAlike License, version 2.5", "CC-BY-SA-2.5", "by-sa/2.5/"), ("CC BY", None, "by/"), ("MIT", None, None),
    ]:
        assert value(spark, T.license_spdx(F.lit(printed))) == spdx, printed
        assert value(spark, T.license_url(F.lit(printed))) == (url and "https://creativecommons.org/licenses/" + url), printed


def test_roles(spark):
    text = "Conceptualisation, Formal analysis; Writing – original draft; writing - review and editing; supervised students"
    assert value(spark, T.credit_roles(F.lit(text))) == ["conceptualization", "formal-analysis", "supervision", "writing-original-draft", "writing-review-editing"]
