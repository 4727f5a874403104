"""The corpus operators against brute force, exact round trips and held-out accuracy, on small and on awkward tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from vellumine.llm import embed_dedup, exact_dedup, langid, license_scan, minhash, mixing, packing, queries, secret_scan, token_counts, toxicity
from vellumine.llm.bpe import Counter

RNG = random.Random(4)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(300)]
LONG = " ".join(RNG.choice(WORDS) for _ in range(30_000))
#: Nulls in any column, empty and very long texts, repeated rows and ids, columns whose names clash with inner ones.
ROWS = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", None), (4, "one", "en", "a"), (5, "one", "en", "a"), (5, "one", "en", "a"), (6, "One ", "de", "b"),
    (7, "a  b\tc", None, "b"), (8, "a b c", "de", "b"), (9, LONG, "en", "a"), (10, LONG + " x", "en", "a"), (None, "no id here", "en", "a"), (11, "123 456 !!", "en", "c"),
    (12, 'password = "hunter22" and <|endoftext|> \x1c x y é漢字', "fr", "c"), (13, "Licensed under the Apache License, Version 2.0.\nthen more", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string, id string, rid long, cid long, key string, n long, kept string, bucket string, score string"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, "x", 7, 8, "k", 9, "no", "b", "s") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def nothing(awkward):
    return awkward.where("false")


def tuples(df, *order):
    return sorted((tuple(r) for r in df.select(*order).collect()), key=repr)


def shingles(text, k):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute_components(n, linked):
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if root[i] != root[j] and linked(i, j):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def brute_near(rows, k, percent=80):
    sets = [shingles(t, k) for _, t in rows]
    return [len(s) for s in sets], brute_components(len(rows), lambda i, j: bool(sets[i] and sets[j]) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]))


def near_texts():
    rng, out = random.Random(8), []
    for family in range(12):
        words = [rng.choice(WORDS) for _ in range(rng.choice([3, 12, 60, 200]))]
        for _ in range(rng.choice([1, 4, 25])):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            out.append(" ".join(copy))
    return list(enumerate(out, 1))


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_against_brute_force(spark, k):
    rows = near_texts()
    sizes, root = brute_near(rows, k)
    want = sorted((rows[i][0], sizes[i], min(rows[j][0] for j in range(len(rows)) if root[j] == root[i])) for i in range(len(rows)))
    got = minhash.near_groups(spark, spark.createDataFrame(rows, "doc_id long, text string"), shingle=k)
    assert tuples(got, "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_joining_links_join_what_all_pairs_join():
    rng = np.random.default_rng(2)
    for blocks in (1, 2):
        base = rng.choice(1000, 40, replace=False)
        sets = [np.unique(np.where(rng.random(40) < 0.07, rng.integers(1000, 2000, 40), base)) for _ in range(60)]
        block = np.arange(60) % blocks
        got = minhash.joining_links(np.arange(60), np.arange(60), block, np.array([len(s) for s in sets]), np.concatenate(sets), 80, columns=64)
        ok = lambda i, j: (blocks == 1 or block[i] != block[j]) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))
        assert all(ok(i, j) for i, j in got)
        assert brute_components(60, lambda i, j: (i, j) in got or (j, i) in got) == brute_components(60, ok)


def test_near_duplicates_awkward(spark, awkward, nothing):
    got = {r["doc_id"]: r for r in minhash.near_groups(spark, awkward, shingle=2).collect()}
    assert got[1]["n_shingles"] == got[3]["n_shingles"] == 0 and got[1]["kept"] and got[2]["kept"]
    assert [got[i]["component_id"] for i in (4, 5, 6, 7, 8, 9, 10)] == [4, 4, 4, 7, 7, 9, 9]
    assert got[None]["kept"] and got[None]["n_shingles"] == 2
    assert minhash.near_groups(spark, nothing).count() == 0
    assert minhash.keep_first(spark, awkward).columns == awkward.columns


def test_exact_dedup(spark, awkward, nothing):
    flat = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t, *_ in ROWS:
        groups.setdefault(flat(t), []).append(i)
    got = exact_dedup.exact_groups(spark, awkward)
    want = [(i, min((x for x in groups[flat(t)] if x is not None), default=None), len(groups[flat(t)]), hashlib.sha256(flat(t).encode()).hexdigest()) for i, t, *_ in ROWS]
    assert tuples(got, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(want, key=repr)
    assert got.where("kept").count() == len(groups)
    assert exact_dedup.exact_groups(spark, nothing).count() == 0
    left = exact_dedup.drop_copies(spark, awkward)
    assert left.columns == awkward.columns and left.count() == len(groups)


def test_directory_doubles_only_where_buckets_are_overfull():
    depth, entries = exact_dedup.directory({0: 10, 1: 10, 1 << 4: 1}, capacity=10, depth=6)
    assert len(entries) == 1 << depth and depth == 6
    assert entries[0] != entries[1] and len(set(entries)) == 7
    assert exact_dedup.directory({}, 10, 4) == (0, [0]) and exact_dedup.directory({3: 999}, 10, 4) == (0, [0])


def test_language_id(spark, sf_dir, awkward, nothing):
    got = queries.op4_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got) > 0
    profiles = langid.learn(spark, awkward)
    found = {r["doc_id"]: r for r in langid.identify(awkward, profiles).collect()}
    assert all((found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0) for i in (1, 2, 3, 11))
    assert all(0 <= r["score"] <= 1 for r in found.values()) and found[9]["lang_pred"] == "en"
    assert langid.identify(nothing, langid.learn(spark, nothing)).count() == 0
    assert langid.Profiles({}).predict("abc") == ("und", 0.0)


def test_language_distance_against_its_definition():
    profiles, size = {"x": [5, 3, 9], "y": [3, 5]}, 3
    p = langid.Profiles(profiles, size)
    text = "ab ab c"
    top = langid.ranked(langid.ngrams(text), size).tolist()
    profiles["x"][0] = top[1]
    p = langid.Profiles(profiles, size)
    apart = {k: sum(abs(v.index(c) - i) if c in v else size for i, c in enumerate(top)) for k, v in profiles.items()}
    best = min(sorted(apart), key=apart.get)
    assert p.predict(text) == (best, pytest.approx(1 - apart[best] / (size * len(top))))


def test_toxicity(spark, sf_dir, awkward, nothing):
    sf = sf_dir.replace("sf0.001", "sf0.1")  # the smaller tables hold out 6 toxic documents or fewer
    got = queries.op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    pos, neg = ([r["score"] for r in got if r["toxic"] == y] for y in (1, 0))
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert auc >= 0.9
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(4, 14)] + [(1, None, None)], "doc_id long, toxic int, text string")
    net = toxicity.learn(spark, awkward, labels)
    rows = toxicity.score(awkward, net).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert toxicity.score(nothing, toxicity.learn(spark, nothing, labels)).count() == 0


def test_convolution_against_its_definition():
    rng = np.random.default_rng(5)
    net = toxicity.train([(i % 2, False, "x", rng.integers(0, 1 << 30, 9).astype(np.int32)) for i in range(20)])
    ids = rng.integers(0, 1 << 30, 7).astype(np.int32)
    sums = net.tables[0][ids >> 15] + net.tables[1][ids & (toxicity.BUCKETS - 1)]
    want, at = [], 0
    for k, w in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            best = max(sum(sums[p + o, at + o * toxicity.FILTERS + f] for o in range(w)) for p in range(len(ids) - w + 1))
            want.append(max(0.0, best + net.bias[k * toxicity.FILTERS + f]))
        at += w * toxicity.FILTERS
    assert np.allclose(net.features(ids), want, atol=1e-5)


def test_secrets(spark, sf_dir, awkward, nothing):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = queries.op6_secret_scan(spark, sf_dir).collect()
    kinds = [("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24)]
    for r in rows:
        spans = [(m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, texts[r["doc_id"]]) if ok(m)]
        line = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[3] == k for s in spans) for k, *_ in kinds]
        assert set(filter(None, line.split(","))) <= set(r["spans"].split(","))
    crf = secret_scan.learn(spark, nothing)
    assert {r["doc_id"]: r["n_assign"] for r in secret_scan.digest_columns(secret_scan.scan(awkward, crf)).collect()}[12] == 1
    assert secret_scan.scan(nothing, crf).count() == 0
    tagger = secret_scan.Tagger(crf)
    text = "please use Authorization: Bearer ghp_" + "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0eF3hJ6" + " for now"
    assert any(text[a:b].startswith("ghp_") for a, b in tagger.spans(text))
    assert tagger.spans("") == [] and tagger.spans("nothing of note in these plain words") == []


def test_viterbi_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(3)
    for n in (1, 3, 5):
        em, trans = rng.normal(size=(n, 3)), rng.normal(size=(3, 3))
        score = lambda p: sum(em[i, t] for i, t in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:])) + trans[0, p[0]] + trans[p[-1], 0]  # noqa: E731, B023
        assert tuple(secret_scan.viterbi(em, trans, True, True)) == max(product(range(3), repeat=n), key=score)


def test_budgets_pass_shortages_to_siblings_first():
    supply = {("a", "x"): 10, ("a", "y"): 100, ("b", "z"): 100}
    got = mixing.budgets(100, supply, {("a",): 1, ("b",): 1})
    assert got == {("a", "x"): 10, ("a", "y"): 40, ("b", "z"): 50}
    assert mixing.budgets(1000, supply, {}) == supply and mixing.budgets(5, {}, {}) == {}
    assert sum(mixing.budgets(101, supply, {("b",): 0}).values()) == 101 and mixing.budgets(101, supply, {("b",): 0})["b", "z"] == 0


def test_mixing(spark, awkward, nothing):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 40))), rng.choice(["en", "de"]), rng.choice("abc")) for i in range(400)], "doc_id long, text string, lang string, source string")
    rows = mixing.mix(spark, docs, budget=0.5).collect()
    leaves = {}
    for r in rows:
        leaves.setdefault((r["domain"], r["lang"], r["source"]), []).append(r)
    for own in leaves.values():
        budget, used, longest = own[0]["leaf_budget"], sum(r["n_tokens"] * r["copies"] for r in own), max(r["n_tokens"] for r in own)
        assert budget - longest < used <= budget
    assert sum(own[0]["leaf_budget"] for own in leaves.values()) == int(0.5 * sum(r["n_tokens"] for r in rows))
    assert mixing.mix(spark, awkward).count() == len(ROWS) and mixing.mix(spark, nothing).count() == 0
    kept = mixing.keep_mixed(spark, awkward, budget=1.0, epochs=1)
    assert kept.columns == awkward.columns and kept.count() == len(ROWS)


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(8):
        centre = rng.normal(size=32)
        rows += [(centre + rng.normal(size=32) * s).tolist() for s in rng.choice([0.0, 0.05, 0.2, 0.3], rng.integers(1, 30))]
    rows += [None, [], [0.0] * 32, [float("nan")] + [1.0] * 31, [None] + [1.0] * 31, [float("inf")] * 32, [1.0], [2.0], [1e-300] * 32, [1e300] * 32]
    good = [v if v and None not in v and all(map(math.isfinite, v)) and any(v) else None for v in rows]
    unit = [None if v is None else (x := np.array(v) / np.abs(v).max()) / np.sqrt(x @ x) for v in good]
    linked = lambda i, j: unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95
    root = brute_components(len(rows), linked)
    want = [(i, sum(linked(i, j) for j in range(len(rows)) if j != i), root[i], root[i] == i) for i in range(len(rows))]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(rows)], "vec_id long, embedding array<double>, cid string")
    assert tuples(embed_dedup.near_vectors(spark, df), "vec_id", "n_links", "component_id", "kept") == sorted(want, key=repr)
    assert embed_dedup.near_vectors(spark, df.where("false")).count() == 0


def test_e8_points_are_nearest():
    x = np.random.default_rng(1).normal(size=(200, 8)) * 2
    p = embed_dedup.e8(x)
    assert np.all((2 * p) % 1 == 0) and np.all(p.sum(1) % 2 == 0)
    near = embed_dedup._shortest()
    assert len(near) == 240 and np.all(((x - p) ** 2).sum(1)[:, None] <= ((x[:, None] - p[:, None] - near) ** 2).sum(2) + 1e-9)


def test_token_counts(spark, awkward, nothing, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = [(i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in ROWS]
    cache = str(tmp_path / "cache")
    for _ in range(2):  # the second time every digest is stored
        got = token_counts.count_tokens(spark, awkward, path, cache)
        assert tuples(got, "doc_id", "n_bytes", "n_tokens") == sorted(want, key=repr)
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got.collect())
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count()
    assert token_counts.count_tokens(spark, nothing, path).count() == 0


def test_word_counts_of_odd_characters():
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    tok, counter = Tokenizer.from_file(path), Counter(path)
    odd = ["a\x1cb", "a\x1fb c", "x y", " a", "a\x85b", "é́", "<|endoftext|>x", "</w> <unk>", "​word​", "﻿a", "don't", "漢字 かな", "A\x00B", "🙂🙂", "\x0bq\x0c"]
    rng = random.Random(1)
    odd += ["".join(rng.choice(["a", "B", " ", "\t", "\x1d", "　", "1", ".", "é", "<|endoftext|>"]) for _ in range(20)) for _ in range(100)]
    assert counter.counts(odd) == [len(tok.encode(t, add_special_tokens=False).ids) for t in odd]


def check_packed(pieces, docs, window=1024):
    """Each id lies in one piece, pieces fill their sequences without gaps, and sequences are full or powers of two."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t in docs}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        part = np.array(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4")
        assert len(part) == p["length"] > 0 and zlib.crc32(part.tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(ids[p["doc_id"]])
        by_doc.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert set(by_doc) == set(ids)
    for runs, total in [*((by_doc[i], len(ids[i])) for i in ids), *((r, None) for r in by_sequence.values())]:
        at = 0
        for start, length in sorted(runs):
            assert start == at
            at += length
        assert at == total if total is not None else at <= window and at & (at - 1) == 0


def test_packing(spark, awkward, nothing):
    docs = awkward.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    path = queries.tokenizer("byte_bpe_50k.json")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check_packed(packing.pack(spark, docs, path).collect(), rows)
    check_packed(packing.pack(spark, docs, path, weights={"a": 0.7, "b": 0.3}).collect(), rows)
    assert packing.pack(spark, awkward, path).selectExpr("sum(length)").first()[0] > 0
    assert packing.pack(spark, nothing, path).count() == 0


def test_windows_hold_target_shares():
    totals = {"a": 64_000, "b": 32_000, "c": 16_000}
    s = packing.Schedule(totals, 1024, 64)
    seen = {}
    for name, n in totals.items():
        _, length, tape = s.runs(name, 0, n)
        for w, k in zip((tape // 1024).tolist(), length.tolist()):
            seen.setdefault(w, {}).setdefault(name, []).append(k)
    full = [w for w in seen if w < sum(totals.values()) // 1024 - 1]
    for name, n in totals.items():
        share = n / sum(totals.values()) * 1024
        # A queue is less than a quantum behind after a round, and a round ends less than a quantum a queue before its window.
        assert all(abs(sum(seen[w].get(name, [])) - share) < 64 * len(totals) for w in full)


def test_license_scan(awkward, nothing):
    scanner = license_scan.Scanner()
    rng = random.Random(2)
    for name, text in license_scan.TEMPLATES:
        words = text.split()
        words[rng.randrange(len(words))] = "altered"
        page = f"some words\n{' '.join(words)}\n\n{text}\nthe end."
        found = {(a, b): (score, lic) for score, lic, a, b in scanner.matches(page)}
        want = license_scan.brute(page)
        assert found.keys() == want.keys() and all(found[k][0] == want[k][0] for k in want)
    rows = {r["doc_id"]: r for r in license_scan.scan(awkward).collect()}
    assert rows[13]["license"] == "Apache-2.0" and rows[13]["dice"] == 1 and rows[1]["license"] is None and rows[9]["n_segments"] == 0
    assert license_scan.scan(nothing).count() == 0


def test_license_in_any_run_of_words():
    scanner = license_scan.Scanner()
    by = "This work is licensed under a Creative\nCommons Attribution 4.0 International License."
    gpl = next(text for name, text in license_scan.TEMPLATES if name == "GPL-2.0")
    pages = {
        f"We thank all readers of the draft. {by} No other rights are given": ("CC-BY-4.0", 1.0),
        f"As the header says: {gpl} So much for that; now to other things.": ("GPL-2.0", 1.0),
        "The code of this paper is released under the MIT License.": ("MIT", 1.0),
        "Both (Licensed under CC BY 4.0; released under the\n\nMIT License) hold, of the of the of the MIT License of the": ("CC-BY-4.0", 1.0),
    }
    for page, want in pages.items():
        assert scanner.best(page)[:2] == want
        found = {(a, b): (score, lic) for score, lic, a, b in scanner.matches(page)}
        assert found == license_scan.brute(page)
    assert scanner.best(page)[4:] == (2, ["CC-BY-4.0", "MIT"])
    # Random runs of few words, so that bigrams repeat and runs of several templates meet.
    rng, small = random.Random(3), (("x", "a b c a d"), ("y", "b c a"), ("z", "a b c a d e f a b"), ("none", "a"))
    scanner = license_scan.Scanner(small)
    for _ in range(300):
        page = " ".join(rng.choice("aabbccddefg") for _ in range(rng.randint(0, 30)))
        assert {(a, b): (score, lic) for score, lic, a, b in scanner.matches(page)} == license_scan.brute(page, small)


def test_field_spans_that_reach_beyond_the_patterns():
    text = 'password="Tr0ub4dor&3xyz"'
    base, value = secret_scan.base_spans(text), (text.index("Tr0"), len(text) - 1)
    assert base == [(0, "assign", text.index("&"))]
    assert secret_scan.beside(base, [value]) == [(value[0], "crf", value[1])]
    assert secret_scan.beside(base, [(value[0], text.index("&"))]) == [] and secret_scan.beside([], [(3, 5)]) == [(3, "crf", 5)]
    assert secret_scan.beside([(0, "assign", 4), (4, "hex", 9)], [(2, 9), (2, 10)]) == [(2, "crf", 10)]
    assert secret_scan.beside([(3, "hex", 6)], [(1, 6)]) == [(1, "crf", 6)]


def test_near_dedup_keeps_one_row_of_each_group(spark):
    words = [" ".join(WORDS[i : i + 60]) for i in (0, 60, 120, 180)]
    rows = [(None, words[0]), (None, words[0] + " end"), (7, words[1]), (7, words[1] + " end"), (None, words[2]), (3, words[2] + " end"), (9, words[2] + " stop"), (4, words[3]), (4, words[3]), (None, ""), (None, ""), (8, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, root string")
    got = minhash.keep_first(spark, docs)
    assert got.columns == docs.columns
    left = sorted(((r["doc_id"], (r["text"] or "")[:9]) for r in got.collect()), key=repr)
    want = [(None, words[0]), (7, words[1]), (3, words[2]), (4, words[3]), (None, ""), (None, ""), (8, "")]
    assert left == sorted(((i, t[:9]) for i, t in want), key=repr)


def test_identifier_tags_and_whole_texts():
    scanner = license_scan.Scanner()
    for name in license_scan.TAGGED:
        assert scanner.best(f"# SPDX-License-Identifier: {name}\n")[0] == name
    for other in ("EUPL-1.2", "EPL-1.0", "MPL-1.1", "Apache-1.1", "BSD-4-Clause", "LGPL-2.0-or-later", "X11"):
        assert scanner.best(f"# SPDX-License-Identifier: {other}\n")[0] is None
    whole = {text: name for name, text in license_scan.TEMPLATES}
    assert all(scanner.best(f"Copyright 2020 somebody. {text}\nmore words")[0] == name for text, name in whole.items())


def test_license_scan_on_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    short = [r for r in docs.collect() if len((r["text"] or "").split()) <= 60]
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    assert len(short) >= 15 and len(got) == docs.count()
    for r in short:
        found = license_scan.brute(r["text"])
        assert got[r["doc_id"]]["n_segments"] == len(found)
        assert got[r["doc_id"]]["dice"] == max((f[0] for f in found.values()), default=0.0)


def test_spans_are_linear_in_the_text():
    import time

    text = " ".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(100_000))
    began = time.time()
    base = secret_scan.base_spans(text)
    assert len(base) == 100_000 and len(secret_scan.windows(text)) == secret_scan.TEXT_WINDOWS
    assert len(secret_scan.beside(base, [(a + 1, b + 3) for a, _, b in base])) == 100_000
    license_scan.Scanner().best("x" + " " * 1_000_000 + "license " * 100_000)
    assert time.time() - began < 20


def test_windows_and_beside_against_every_pair():
    rng = random.Random(7)
    for _ in range(300):
        base = sorted((a, "hex", a + rng.randint(1, 6)) for a in (rng.randrange(40) for _ in range(rng.randint(0, 6))))
        found = [(a, a + rng.randint(1, 9)) for a in (rng.randrange(40) for _ in range(3))]
        want = [(a, "crf", b) for a, b in found if not all(any(s <= i < e for s, _, e in base) for i in range(a, b))]
        assert secret_scan.beside(base, found) == want
    text = 'a password = "hunter22x" b ' + "0123456789abcdef" * 2 + " c api_key:abcdefgh;d"
    spans, where = secret_scan.base_spans(text), [m.span() for m in re.finditer(r"\S+", text)]
    hit = [any(max(a, s) < min(b, e) and (k != "assign" or b >= e) for s, k, e in spans) for a, b in where]
    got = secret_scan.windows(text, most=99)
    assert len(got) == sum(hit) and got[0][1][: len(where)] == [secret_scan.B if h else secret_scan.O for h in hit][: len(got[0][1])]


def test_recall_of_the_lattices():
    rng = np.random.default_rng(12)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (b * a).sum(1, keepdims=True) * a
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    for _, blocks, scale in embed_dedup.SIZES:
        lattice = embed_dedup.Lattice(64, blocks=blocks, scale=scale)
        x, y = (lattice.cells(v).reshape(len(v), lattice.tables, -1) for v in (a, b))
        found = (x[:, :, :1] == y).any((1, 2)) | (y[:, :, :1] == x).any((1, 2))
        assert found.mean() >= 0.95


def test_links_do_not_depend_on_the_number_of_rows(spark):
    rng = np.random.default_rng(21)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (b * a).sum(1, keepdims=True) * a
    b = 0.9501 * a + math.sqrt(1 - 0.9501**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(np.concatenate((a, b)).tolist())], "vec_id long, embedding array<double>")
    more = spark.range(4000, 204_001).selectExpr("id AS vec_id", "CAST(NULL AS array<double>) AS embedding")
    few, many = (tuples(embed_dedup.near_vectors(spark, v).where("vec_id < 4000"), "vec_id", "n_links", "component_id") for v in (df, df.union(more)))
    assert few == many and sum(n for _, n, _ in few) >= 2 * 2000 * 0.99


@pytest.mark.parametrize("n", [1, 2_000_000])
def test_settling_within_cells(spark, n):
    """Rings, gaps and blocks join what all pairs join where hubs leave vectors apart: points along arcs."""
    rng = np.random.default_rng(n)
    x, y = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
    angles = np.concatenate([np.linspace(0, 1.2, 40), rng.uniform(0, 3, 60)])
    rows = [(i, (math.cos(t) * x + math.sin(t) * y + rng.normal(size=64) * 0.004).tolist()) for i, t in enumerate(angles)]
    unit = [np.array(v) / np.linalg.norm(v) for _, v in rows]
    df = spark.createDataFrame(rows, "cid long, v array<double>").selectExpr("cid", "size(v) AS dim", "v")
    from vellumine.llm.common import Staged

    parts = {r["node"]: r["root"] for r in embed_dedup._components(Staged(spark, "arcs"), df, n, 0.95).collect()}
    assert [parts.get(i, i) for i in range(len(rows))] == brute_components(len(rows), lambda i, j: unit[i] @ unit[j] >= 0.95)


def test_large_areas_are_settled_bucket_by_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash, "AREA_BLOCKS", 0)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 3)
    rng, out = random.Random(3), []
    for _ in range(6):
        words = [rng.choice(WORDS) for _ in range(60)]
        for _ in range(12):
            copy = list(words)
            for _ in range(rng.randint(0, 9)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            out.append(" ".join(copy))
    rows = list(enumerate(out, 1))
    _, root = brute_near(rows, 2)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_groups(spark, spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()}
    assert got == {rows[i][0]: rows[root[i]][0] for i in range(len(rows))}


def test_buckets_deeper_than_the_directory(spark, monkeypatch):
    for name, value in (("MAX_DEPTH", 2), ("OWNER_BYTES", 1 << 14), ("BUCKETS_PER_OWNER", 4)):
        monkeypatch.setattr(exact_dedup, name, value)
    rng = random.Random(5)
    texts = [" ".join(rng.choices(WORDS, k=40)) for _ in range(300)]
    rows = [(i, texts[i % 300 if i < 500 else 7]) for i in range(900)]
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    got = exact_dedup.exact_groups(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["keep_id"] for r in got} == {i: first[t] for i, t in rows}


def test_packing_of_more_sources_than_queues(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_QUEUES", 8)
    rows = [(i, " ".join(random.Random(i).choices(WORDS, k=i % 50)), f"host{i % 40}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for weights in (None, {"host1": 0.5, "host2": 0.5}):
        pieces = packing.pack(spark, docs, queries.tokenizer("byte_bpe_50k.json"), weights=weights).collect()
        check_packed(pieces, [r[:2] for r in rows])
        assert {p["source"] for p in pieces} == {r[2] for r in rows}


def test_training_on_very_long_labelled_texts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_DOCUMENT", 250)
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 2000)
    rows = [(i, ("vile " if i % 2 else "calm ") * (1000 if i == 0 else 20), "en") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    net = toxicity.learn(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels)
    hasher = toxicity.Hasher()
    assert net.trained and net.score(hasher.ids("vile vile vile")) > net.score(hasher.ids("calm calm calm"))


def test_training_takes_every_labelled_row(spark):
    # More documents than the old sample's 2,000 and 4,000, and one above its 1 MiB; each has one word a language.
    rows = [(i, "vile" if i < 5000 else "calm", "en") for i in range(11_000)] + [(11_000, "calm " * 300_000, "en"), (11_001, "one two", "de"), (11_002, None, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (docs["doc_id"] < 5000).cast("int").alias("toxic"))
    net, hasher = toxicity.learn(spark, docs.repartition(1), labels), toxicity.Hasher()
    vile, calm, one, two = (int(hasher.ids(w)[0]) >> 15 for w in ("vile", "calm", "one", "two"))
    share = np.exp(net.words_by_lang.astype(np.float64))
    assert net.langs == ["de", "en"]
    assert share[[vile, calm, one], 1] * (toxicity.BUCKETS + 5000 + 306_000) == pytest.approx([5001, 306_001, 1], rel=1e-4)
    assert share[[one, two, vile], 0] * (toxicity.BUCKETS + 2) == pytest.approx([2, 2, 1], rel=1e-4)
    assert net.score(hasher.ids("vile")) >= 0.5 > net.score(hasher.ids("calm"))
    # The same rows in another order and other partitions give the same network, to the last bit.
    again = toxicity.learn(spark, docs.repartition(5).sortWithinPartitions("doc_id", ascending=False), labels)
    for a, b in ((net.tables[0], again.tables[0]), (net.tables[1], again.tables[1]), (net.out, again.out), (net.cut, again.cut), (net.words_by_lang, again.words_by_lang)):
        assert np.array_equal(a, b)


def test_gradient_against_differences():
    rng = np.random.default_rng(3)
    rows = [(0, i % 2, "x", rng.integers(0, 1 << 30, n).astype(np.int32)) for i, n in enumerate((1, 2, 5, 40, 0, 9))]
    p = toxicity.start(np.zeros((2, 2, toxicity.BUCKETS)), np.array([3, 3]), 1)
    p.bias[:] = 0.5
    weight = [1 / 6, 1 / 6]

    def loss(flat):
        net, total = toxicity.Parameters(flat.astype(np.float64)).network(np.zeros((toxicity.BUCKETS, 0)), []), 0.0
        for _, label, _, ids in rows:
            total += weight[label] * math.log1p(math.exp(-net.logit(ids) if label else net.logit(ids)))
        return total

    ((_, got),) = toxicity._gradient(rows, p.flat, weight)
    got = got * toxicity.GRAIN
    moved = np.flatnonzero(got)
    for i in [*moved[:: max(1, len(moved) // 60)], *range(len(p.flat) - 45, len(p.flat))]:
        step = np.zeros_like(p.flat)
        step[i] = 1e-3
        assert got[i] == pytest.approx((loss(p.flat + step) - loss(p.flat - step)) / 2e-3, abs=2e-3)


def test_filters_in_several_turns(monkeypatch):
    rng = np.random.default_rng(6)
    net = toxicity.train([(i % 2, False, "x", rng.integers(0, 1 << 30, 9).astype(np.int32)) for i in range(20)])
    for n in (1, 3, 4, 5, 8, 57):
        ids = rng.integers(0, 1 << 30, n).astype(np.int32)
        whole, read = net.maxima(ids), net.language(ids)
        monkeypatch.setattr(toxicity, "TRAIN_DOCUMENT", 4)
        assert all(np.array_equal(a, b) for a, b in zip(net.maxima(ids), whole)) and net.language(ids) == read
        monkeypatch.undo()


def test_threshold_has_the_best_f1():
    rng = np.random.default_rng(8)
    z = np.round(rng.normal(0, 2, 400), 1)
    y = (z + rng.normal(0, 1.5, 400) > 1).astype(int)
    found = toxicity.Counter((0, math.floor(a * toxicity.CELLS), int(b)) for a, b in zip(z, y))
    f1 = lambda cut: 2 * ((z >= cut) & (y == 1)).sum() / ((z >= cut).sum() + y.sum())
    assert f1(toxicity._best_cut(found)) == max(f1(c) for c in z)


def test_cache_is_compacted(spark, awkward, tmp_path):
    path, cache = queries.tokenizer("word_bpe_49k.json"), str(tmp_path / "cache")
    version = token_counts.tokenizer_digest(path)
    first = tuples(token_counts.count_tokens(spark, awkward, path, cache), "doc_id", "n_tokens")
    token_counts.compact_cache(spark, cache, version, 1)
    assert len(list((tmp_path / "cache" / f"tokenizer={version}").glob("*.parquet"))) == 1
    assert tuples(token_counts.count_tokens(spark, awkward, path, cache), "doc_id", "n_tokens") == first


@pytest.mark.parametrize("epochs", [1, 2])
def test_mixing_takes_the_documents_that_brute_force_takes(spark, epochs):
    from pyspark.sql import functions as F

    rng = random.Random(epochs)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 40))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    weights = {("0",): 3.0, ("0", "en"): 2.0, ("1", "de"): 0.0}
    got = mixing.mix(spark, docs, budget=0.6, weights=weights, epochs=epochs, domain=F.col("doc_id") % 2).collect()
    words = {i: len(t.split()) for i, t, *_ in rows}
    leaf = {i: (str(i % 2), lang, source) for i, _, lang, source in rows}
    supply = {}
    for i, n in words.items():
        supply[leaf[i]] = supply.get(leaf[i], 0) + n
    key = lambda path: tuple("\x00" if x is None else x for x in path)
    share = mixing.budgets(int(0.6 * sum(words.values())), {key(k): n * epochs for k, n in supply.items()}, weights)
    # The seeded order of a leaf's last epoch, document by document.
    want = {}
    for path, n in supply.items():
        whole, left = (share[key(path)] // n, share[key(path)] % n) if n else (epochs, 0)
        own = [i for i in words if leaf[i] == path]
        order = spark.createDataFrame([(i, whole, rows[i][1]) for i in own], "doc_id long, whole long, text string").select("doc_id", F.xxhash64(F.lit(1), "whole", "doc_id", F.xxhash64("text")).alias("o")).collect()
        run = 0
        for i in sorted(own, key=lambda i: ({r["doc_id"]: r["o"] for r in order}[i] & (1 << 64) - 1, i)):
            run += words[i]
            want[i] = whole + (0 < left and run <= left)
    assert {r["doc_id"]: r["copies"] for r in got} == want


@pytest.mark.parametrize("weights, budget", [({}, 0.05), ({("0",): 3.0, ("1", "de"): 0.0, ("0", "en", "host1"): 9.5, ("0", "en", "host2"): 0.0}, 0.6)])
def test_more_leaves_than_the_driver_handles(spark, monkeypatch, weights, budget):
    from vellumine.llm.common import Staged
    from vellumine.llm.leaves import hand_down

    rng = random.Random(3)
    supply = {(str(i % 2), rng.choice(["en", "de"]), f"host{i}"): int(rng.paretovariate(0.6)) % 5000 for i in range(300)}
    total = int(budget * sum(supply.values()))
    want = mixing.budgets(total, supply, weights)
    monkeypatch.setattr("vellumine.llm.leaves.CELLS", 4)
    monkeypatch.setattr("vellumine.llm.leaves.EDGE_ROWS", 2)
    leaves = spark.createDataFrame([(*k, n) for k, n in supply.items()], "domain string, lang string, source string, supply long")
    staged = Staged(spark, "test")
    got = {tuple(r)[:3]: r["share"] for r in hand_down(staged, staged.write(leaves, "leaves"), mixing.LEVELS, weights, total).collect()}
    assert set(got) == set(want) and sum(got.values()) == total
    assert all(0 <= got[k] <= supply[k] and abs(got[k] - want[k]) <= 2 for k in want)


def test_mixing_above_the_leaves_of_the_driver(spark, awkward, nothing, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_LEAVES", 2)
    assert mixing.mix(spark, awkward).count() == len(ROWS) and mixing.mix(spark, nothing).count() == 0
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 40))), rng.choice(["en", "de", None]), rng.choice("abc")) for i in range(300)], "doc_id long, text string, lang string, source string")
    rows = mixing.mix(spark, docs, budget=0.5, weights=queries.MIXTURE).collect()
    leaves = {}
    for r in rows:
        leaves.setdefault((r["domain"], r["lang"], r["source"]), []).append(r)
    assert len(rows) == 300 and sum(own[0]["leaf_budget"] for own in leaves.values()) == int(0.5 * sum(r["n_tokens"] for r in rows))
    for own in leaves.values():
        budget, used = own[0]["leaf_budget"], sum(r["n_tokens"] * r["copies"] for r in own)
        assert budget - max(r["n_tokens"] for r in own) < used <= budget


def test_a_leaf_of_repeated_rows_is_cut_cell_by_cell(spark, monkeypatch):
    rows = [(7, "same words here", "en", "a")] * 200 + [(i, "a b c d", "en", "a") for i in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    taken = []
    for most in (20_000, 3):
        monkeypatch.setattr("vellumine.llm.leaves.EDGE_ROWS", most)
        got = mixing.mix(spark, docs, budget=0.5, epochs=1).collect()
        taken.append(sorted((r["doc_id"], r["n_tokens"], r["copies"]) for r in got))
        used, budget = sum(r["n_tokens"] * r["copies"] for r in got), got[0]["leaf_budget"]
        assert len(got) == 240 and budget - 4 < used <= budget
    assert taken[0] == taken[1]
