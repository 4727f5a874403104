"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans to theirs.

Every word is tagged secret-begin, inside or outside from its own shape, its neighbours and features of the file, and
the best tag sequence is decoded by Viterbi. Where a word's outside score leads by more than any two transitions can
make up, it is outside on the best path whatever its neighbours are; the chain is decoded between such words only.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_HEX_MAP = bytes(120 if c in b"0123456789abcdef" else 32 for c in range(256))
_HEX_RUN = b"x" * 24
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")
#: Documents that training looks through, expected: they are drawn by a hash of the text.
TRAIN_ROWS = 20_000
#: Windows of real text that training takes at most: around base spans, and from elsewhere; and at most from one text.
TRAIN_WINDOWS = 200
TEXT_WINDOWS = 3
O, B, I = 0, 1, 2
_MEMO = 500_000
_STRIP = "\"'`()[]{}<>,;.!?*#%&$"
_KEY_WORDS = frozenset("password passwd pwd passphrase secret secrets token key keys apikey api_key api access auth authorization bearer credential credentials private begin end rsa cookie session signature webhook dsn".split())
_LINK_WORDS = frozenset("is = : := are was set to with use".split())
_PREFIX = re.compile(r"ghp_|gho_|github_pat_|glpat-|sk_live_|sk-|pk_live_|xox[abp]-|AIza|eyJ|AKIA|ASIA|SG\.|ya29\.|-----BEGIN|hf_|npm_")
_NUMBER = re.compile(r"[-+]?[\d.,:/%-]+")
_URL = re.compile(r"https?://|www\.")
_CREDENTIAL_URL = re.compile(r"[a-z][a-z0-9+.-]*://[^/\s:@]+:[^/\s@]+@")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points of the fixed patterns, by start, then kind."""
    raw = text.encode("utf-8", "surrogatepass")
    out = []
    lower = raw.lower()
    if any(w in lower for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _HEX_RUN in raw.translate(_HEX_MAP):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, KINDS[k], b) for a, k, b in sorted(out)]


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def value_part(word: str) -> tuple[str, str, int]:
    """(key, value, where the value starts) of ``key=value``; otherwise an empty key and the word without its quotes."""
    begin, end = len(word) - len(word.lstrip(_STRIP)), len(word.rstrip(_STRIP))
    core = word[begin:end]
    if _CREDENTIAL_URL.match(core):
        return "", core, begin
    m = re.match(r"([A-Za-z][\w.-]{1,40})[\"']?[:=][\"']?(?=\S)", core)
    if m and not core.startswith(("http:", "https:")):
        return m[1].lower(), core[m.end() :], begin + m.end()
    return "", core, begin


def _bucket(x: float, steps: tuple) -> int:
    return sum(x >= s for s in steps)


def _plain(word: str) -> str | None:
    """The signature of an ordinary word, which most are."""
    core = word.strip(_STRIP)
    if core.isalpha() and len(core) < 24:
        low = core.lower()
        if low in _KEY_WORDS:
            return f"key:{low}:{word[-1] in ':='}"
        if low in _LINK_WORDS:
            return "link"
        if core == low or core[1:] == low[1:] or core.isupper():
            return f"plain:{len(core) // 8}"
    elif not core:
        return "link" if word in _LINK_WORDS else "marks"
    return None


def shape(word: str) -> tuple[str, ...]:
    """A word's features; words of equal features share all scores."""
    plain = _plain(word)
    if plain:
        return (plain,)
    key, value, _ = value_part(word)
    n = max(1, len(value))
    classes = [("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "." if c in "+/_=-." else "o") for c in value]
    found = Counter(classes)
    digits, odd = found["0"] / n, found["o"] / n
    turns = sum(x != y for x, y in zip(classes, classes[1:])) / n
    bits = -sum(v / n * math.log2(v / n) for v in Counter(value).values())
    out = [
        f"len:{_bucket(n, (6, 10, 14, 18, 24, 32, 48, 80))}",
        "set:" + "".join(c for c in "aA0.o" if found[c]),
        f"digits:{_bucket(digits, (0.01, 0.15, 0.35, 0.6, 0.99))}",
        f"turns:{_bucket(turns, (0.05, 0.2, 0.35, 0.5))}",
        f"bits:{_bucket(bits, (2, 2.8, 3.2, 3.6, 4, 4.5))}",
        f"odd:{_bucket(odd, (0.01, 0.2, 0.5))}",
    ]
    if _PREFIX.match(value):
        out.append("known")
    if key:
        out.append("keyed:" + str(any(w in key for w in ("pass", "pwd", "secret", "token", "key", "auth", "cred"))))
    if _NUMBER.fullmatch(value):
        out.append("number")
    if _CREDENTIAL_URL.match(value):
        out.append("credential-url")
    elif _URL.match(value):
        out.append("url")
    if "@" in value and "." in value:
        out.append("mail")
    if re.fullmatch(r"[0-9a-fA-F]+", value):
        out.append("hex")
    if n >= 16 and re.fullmatch(r"[A-Za-z0-9+/_-]+=*", value) and found["a"] and found["A"] and found["0"]:
        out.append("base64")
    if value.count("/") >= 2:
        out.append("path")
    return tuple(out)


def file_features(words: list[str]) -> tuple[str, ...]:
    n = max(1, len(words))
    marks = sum(map(words.count, ("=", "{", "}", ";")))
    return (f"file-size:{_bucket(n, (20, 200, 2000))}", f"file-code:{_bucket(marks / n, (0.01, 0.05))}")


class Crf:
    """Scores of features for a word's own tag and its neighbours', and of tag pairs."""

    def __init__(self):
        self.w: dict[str, np.ndarray] = {}
        self.trans = np.zeros((3, 3))

    def emissions(self, words: list[str], file: tuple[str, ...]) -> list[list[str]]:
        shapes = [shape(w) for w in words]
        feats = []
        for i, s in enumerate(shapes):
            f = ["self " + x for x in s] + ["bias", *file]
            for d, j in (("prev", i - 1), ("prev2", i - 2), ("next", i + 1)):
                f += [f"{d} {x}" for x in (shapes[j] if 0 <= j < len(shapes) else ("edge",))]
            feats.append(f)
        return feats

    def train(self, data: list[tuple[list[str], list[int]]], epochs: int = 5, rate: float = 0.15, seed: int = 5) -> None:
        """Stochastic gradient ascent on the log-likelihood (forward-backward), AdaGrad steps, a little decay."""
        rng = random.Random(seed)
        made = [(self.emissions(w, file_features(w)), y) for w, y in data if w]
        self.w = {k: np.zeros(3) for f, _ in made for x in f for k in x}
        grown = {k: np.full(3, 1e-2) for k in self.w}
        grown_t = np.full((3, 3), 1e-2)
        for _ in range(epochs):
            rng.shuffle(made)
            for feats, y in made:
                em = np.array([sum(self.w[k] for k in f) for f in feats])
                node, pair = self._marginals(em)
                for f, p, tag in zip(feats, node, y):
                    g = -p
                    g[tag] += 1
                    if np.abs(g).max() < 1e-3:
                        continue
                    for k in f:
                        step = g - 1e-3 * self.w[k]
                        grown[k] += step**2
                        self.w[k] += rate * step / np.sqrt(grown[k])
                gt = -pair - 1e-3 * self.trans
                for a, b in zip(y, y[1:]):
                    gt[a, b] += 1
                grown_t += gt**2
                self.trans += rate * gt / np.sqrt(grown_t)

    def _marginals(self, em: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(em)
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[0] = em[0]
        for i in range(1, n):
            s = alpha[i - 1][:, None] + self.trans
            m = s.max(0)
            alpha[i] = em[i] + m + np.log(np.exp(s - m).sum(0))
        for i in range(n - 2, -1, -1):
            s = self.trans + em[i + 1] + beta[i + 1]
            m = s.max(1)
            beta[i] = m + np.log(np.exp(s - m[:, None]).sum(1))
        top = alpha[-1].max()
        z = top + np.log(np.exp(alpha[-1] - top).sum())
        pair = np.zeros((3, 3))
        for i in range(1, n):
            pair += np.exp(alpha[i - 1][:, None] + self.trans + em[i] + beta[i] - z)
        return np.exp(alpha + beta - z), pair


class Tagger:
    """Viterbi over whole texts with a trained field; scores of a word are kept by its features."""

    def __init__(self, crf: Crf, caution: float = 1.0):
        self.w, self.trans, self.caution = crf.w, crf.trans, caution
        self.sure = 2 * (crf.trans.max() - crf.trans.min()) + 1e-9
        self.rows: dict[tuple, int] = {}
        self.scores = [np.zeros((4, 3))]
        edge = [self._sum(d, ("edge",)) for d in ("prev", "prev2", "next")]
        self.edge = dict(zip(("prev", "prev2", "next"), edge))
        tagger = self

        class Memo(dict):
            def __missing__(memo, word):
                s = shape(word)
                row = tagger.rows.get(s)
                if row is None:
                    row = tagger.rows[s] = len(tagger.scores)
                    tagger.scores.append(np.stack([tagger._sum(d, s) for d in ("self", "prev", "prev2", "next")]))
                    tagger.table = None
                if len(memo) >= _MEMO:
                    memo.clear()
                memo[word] = row
                return row

        self.memo, self.table = Memo(), None

    def _sum(self, where: str, feats: tuple[str, ...]) -> np.ndarray:
        zero = np.zeros(3)
        return sum((self.w.get(f"{where} {x}", zero) for x in feats), zero)

    def emissions(self, words: list[str]) -> np.ndarray:
        rows = np.fromiter(map(self.memo.__getitem__, words), dtype=np.int64, count=len(words))
        if self.table is None:
            self.table = np.stack(self.scores)
        t = self.table
        em = t[rows, 0]
        em[1:] += t[rows[:-1], 1]
        em[:1] += self.edge["prev"]
        em[2:] += t[rows[:-2], 2]
        em[:2] += self.edge["prev2"]
        em[:-1] += t[rows[1:], 3]
        em[-1:] += self.edge["next"]
        zero = np.zeros(3)
        em += sum((self.w.get(f, zero) for f in ("bias", *file_features(words))), zero)
        em[:, O] += self.caution
        return em

    def tags(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words), np.int8)
        if not words:
            return out
        em = self.emissions(words)
        unsure = np.flatnonzero(em[:, O] - np.maximum(em[:, B], em[:, I]) <= self.sure)
        if len(unsure):
            for part in np.split(unsure, np.flatnonzero(np.diff(unsure) > 1) + 1):
                a, b = int(part[0]), int(part[-1]) + 1
                out[a:b] = viterbi(em[a:b], self.trans, a > 0, b < len(words))
        return out

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the tagged values, in code points."""
        words = text.split()
        tags = self.tags(words)
        if not tags.any():
            return []
        where = [m.span() for m in re.finditer(r"\S+", text)]
        if len(where) != len(words):  # \S and split() differ on a few control characters
            where, at = [], 0
            for w in words:
                at = text.index(w, at)
                where.append((at, at + len(w)))
                at += len(w)
        out: list[list[int]] = []
        for i in np.flatnonzero(tags):
            word, (a, _) = words[i], where[i]
            _, value, skip = value_part(word)
            if not value:
                continue
            span = [a + skip, a + skip + len(value)]
            if tags[i] == I and i and tags[i - 1] and out:
                out[-1][1] = span[1]
            else:
                out.append(span)
        return [(a, b) for a, b in out]


def viterbi(em: np.ndarray, trans: np.ndarray, left: bool, right: bool) -> list[int]:
    """Best tags between two outside words (``left``, ``right``) or the text's ends."""
    best = em[0] + (trans[O] if left else 0)
    back = []
    for e in em[1:]:
        s = best[:, None] + trans
        back.append(s.argmax(0))
        best = s.max(0) + e
    if right:
        best = best + trans[:, O]
    tag = int(best.argmax())
    out = [tag]
    for b in reversed(back):
        tag = int(b[tag])
        out.append(tag)
    return out[::-1]


def synthetic(filler: list[str], n: int = 400, seed: int = 9) -> list[tuple[list[str], list[int]]]:
    """Made-up sequences: secrets of many shapes in running text, and look-alikes that are none."""
    rng = random.Random(seed)
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    chars = lambda k, s=alnum: "".join(rng.choice(s) for _ in range(k))
    hexes = lambda k: chars(k, "0123456789abcdef")
    fill = lambda k: [rng.choice(filler) for _ in range(k)]

    def secret() -> tuple[list[str], list[int]]:
        kind = rng.randrange(14)
        word = rng.choice(["password", "passwd", "pwd", "secret", "token", "key", "credentials"])
        if kind == 0:
            return ["Authorization:", "Bearer", f"eyJ{chars(18)}.eyJ{chars(30)}.{chars(40)}"], [O, O, B]
        if kind == 1:
            return [rng.choice(["ghp_", "gho_", "glpat-", "hf_", "npm_"]) + chars(36)], [B]
        if kind == 2:
            return [rng.choice(["sk_live_", "pk_live_", "sk-"]) + chars(rng.randint(24, 40))], [B]
        if kind == 3:
            return ["AIza" + chars(35)], [B]
        if kind == 4:
            lines = [chars(64) for _ in range(rng.randint(2, 6))]
            return ["-----BEGIN", "PRIVATE", "KEY-----", *lines, "-----END", "PRIVATE", "KEY-----"], [O, O, O, B, *[I] * (len(lines) - 1), O, O, O]
        if kind == 5:
            return [word, rng.choice(["is", "=", ":", "was"]), chars(rng.randint(10, 20))], [O, O, B]
        if kind == 6:
            return [f"{word}:", chars(rng.randint(10, 24))], [O, B]
        if kind == 7:
            return ["secret", "access", "key", chars(40, alnum + "+/")], [O, O, O, B]
        if kind == 8:
            return [f"postgres://user:{chars(12)}@db.{rng.choice(filler).lower().strip('.,')}.net/main"], [B]
        if kind == 9:
            return [f"{word}={chars(rng.randint(8, 20))}"], [B]
        if kind == 10:
            return ["AKIA" + chars(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")], [B]
        if kind == 11:
            return [hexes(rng.choice([32, 40, 64]))], [B]
        if kind == 12:
            return [rng.choice(["xoxb-", "xoxp-"]) + chars(12, "0123456789") + "-" + chars(24)], [B]
        return [f'{word}', "=", f'"{chars(rng.randint(16, 40))}"'], [O, O, B]

    def harmless() -> list[str]:
        return rng.choice(
            [
                [f"https://www.{chars(8).lower()}.com/{chars(6).lower()}/{rng.randint(1, 999)}"], [f"{chars(6).lower()}.{chars(4).lower()}@mail.example.com"],
                [f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}"], [f"v{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}"],
                [f"+{rng.randint(1, 99)}-{rng.randint(100, 999)}-{rng.randint(1000, 9999)}"], [".".join(str(rng.randint(1, 254)) for _ in range(4))],
                [str(rng.randint(10**6, 10**15))], [rng.choice(filler) * 3], [rng.choice(filler).upper()], ["the", "token", "of"], ["a", "secret", "that"],
                ["key", "words"], [rng.choice(filler) + rng.choice(["***", "$$$", "###", "%%%", "&&&"])], ["!!"], ["|"], [f"/usr/{chars(5).lower()}/{chars(7).lower()}.txt"],
                [rng.choice(filler).capitalize() + rng.choice(filler).capitalize()], [f"{rng.choice(filler)}{rng.randint(1, 99)}"],
            ]
        )

    out = []
    for _ in range(n):
        words, tags = [], []
        for _ in range(rng.randint(1, 3)):
            w = fill(rng.randint(3, 12))
            words, tags = words + w, tags + [O] * len(w)
            if rng.random() < 0.5:
                w, t = secret()
            else:
                w = harmless()
                t = [O] * len(w)
            words, tags = words + w, tags + t
        w = fill(rng.randint(2, 8))
        out.append((words + w, tags + [O] * len(w)))
    return out


def windows(text: str, reach: int = 20, most: int = TEXT_WINDOWS) -> list[tuple[list[str], list[int]]]:
    """Words around the first base spans, tagged by them; one window without any from a text that has none."""
    spans = base_spans(text)
    where = [m.span() for m in re.finditer(r"\S+", text)]
    if not spans:
        at = len(where) // 2
        words = [text[a:b] for a, b in where[at : at + 2 * reach]]
        return [(words, [O] * len(words))] if words else []
    # Each span in the order of its start marks the words that it meets; an assignment only those up to its end.
    starts, hit = [a for a, _ in where], [False] * len(where)
    for s, k, e in spans:
        i = max(0, bisect.bisect_right(starts, s) - 1)
        while i < len(where) and starts[i] < e:
            if where[i][1] > s and (k != "assign" or where[i][1] >= e):
                hit[i] = True
            i += 1
    out = []
    for i in (i for i, h in enumerate(hit) if h):
        lo, hi = max(0, i - reach), i + reach
        out.append(([text[a:b] for a, b in where[lo:hi]], [B if h else O for h in hit[lo:hi]]))
        if len(out) == most:
            break
    return out


def learn(spark: SparkSession, docs: DataFrame, most: int = TRAIN_WINDOWS, text: str = "text") -> Crf:
    """Train on made-up sequences and on at most ``most`` windows of ``docs`` with base spans and as many without.

    The windows come from about TRAIN_ROWS documents, in the order of a hash of their texts; one pass over the table.
    """
    bounded_batches(spark)
    n = docs.count()
    order = F.xxhash64(text)
    part = min(1.0, TRAIN_ROWS / n) if n else 1.0
    drawn = docs.where(F.col(text).isNotNull() & (F.pmod(order, F.lit(1_000_003)) < part * 1_000_003)).select(order.alias("place"), F.col(text))

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(k, B in tags, words, tags) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for words, tags in windows(t)]
            if rows:
                place, held, words, tags = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(held), pa.array(words, pa.list_(pa.string())), pa.array(tags, pa.list_(pa.int32()))], names=["place", "held", "words", "tags"])

    rank = F.row_number().over(Window.partitionBy("held").orderBy("place", "words"))
    got = drawn.mapInArrow(cut, "place long, held boolean, words array<string>, tags array<int>").withColumn("rank", rank).where(F.col("rank") <= most).collect()
    data = [(list(r["words"]), list(r["tags"])) for r in sorted(got, key=lambda r: (not r["held"], r["rank"]))]
    plain = sorted({w for words, tags in data for w, t in zip(words, tags) if t == O and w.isalpha()})
    filler = plain or "some words that say nothing of note and run on in lines".split()
    crf = Crf()
    crf.train(data + synthetic(filler))
    return crf


def beside(base: list[tuple[int, str, int]], found: list[tuple[int, int]]) -> list[tuple[int, str, int]]:
    """The field's spans, whole, of which the fixed patterns' spans (by start) leave any character uncovered."""
    starts, ends = [], []  # the base spans' union, as intervals that do not touch
    for s, _, e in base:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    out = []
    for a, b in found:
        i = bisect.bisect_right(starts, a) - 1
        if i < 0 or ends[i] < b:
            out.append((a, "crf", b))
    return out


def scan(docs: DataFrame, crf: Crf, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and spans (array of kind, start, end in code points, end exclusive, by start, then kind) of each whole text.

    Spans of the fixed patterns always stay; the field adds those that reach beyond them, as in ``beside``. Null and empty texts have
    no span; repeated rows each give a row; an empty table none; columns other than key and text are not read.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(crf)  # a few thousand features
    id_type = docs.schema[key].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        tagger = Tagger(sent.value)
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                t = t or ""
                spans = base_spans(t)
                added = beside(spans, tagger.spans(t))
                spans = sorted(spans + added, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))
                out.append([{"kind": k, "start": a, "end": b} for a, k, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, span)], names=["id", "spans"])

    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {id_type}, spans array<struct<kind:string,start:long,end:long>>").withColumnRenamed("id", key)


def digest_columns(scanned: DataFrame) -> DataFrame:
    """The counts, digest and joined spans of ``scan``'s rows."""
    line = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"] != "crf")
    return scanned.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), count("crf"))


def brute_digest(text: str | None) -> str:
    return hashlib.sha256(joined(base_spans(text or "")).encode()).hexdigest()
