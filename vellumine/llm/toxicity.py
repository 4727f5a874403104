"""Toxicity by a convolutional text classifier in numpy.

Words are hashed twice into two embedding tables, so that two words share a vector only when both hashes collide.
Filters of several widths slide over the whole text; their maxima over all positions feed a logistic unit. Since a
filter is linear before the maximum, its tables are multiplied out once and a position costs a few look-ups. The
threshold is calibrated per language, which is itself read off the words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Staged, bounded_batches

BUCKETS = 1 << 15
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 6
#: Words of a text whose filters are held at once; longer texts, in training as in scoring, take several turns.
TRAIN_DOCUMENT = 1 << 16
#: Bytes of a row group of staged words, so that readers hold few texts at once.
TRAIN_BYTES = 4 << 20
#: The fitted documents are dealt to so many parts; each step of training takes the gradient of one part, in turn.
FOLDS = 8
STEPS = 24
#: The part that gives the thresholds: a quarter of the training rows.
CALIBRATION = FOLDS
#: Gradients are added up as whole multiples of this, so that neither order nor partitions change a sum.
GRAIN = 2.0**-44
#: Cells of a logit, at whose edges thresholds lie.
CELLS = 1024
#: Numbers of a row when vectors are added up by Spark.
LANES = 8
_WORD = re.compile(r"\w+")
_MEMO = 200_000


class Hasher:
    """Bucket pairs of words, remembered up to a bound."""

    def __init__(self):
        import xxhash

        digest, memo = xxhash.xxh3_64_intdigest, {}

        class Memo(dict):
            def __missing__(memo, word):
                h = digest(word)
                if len(memo) >= _MEMO:
                    memo.clear()
                memo[word] = pair = (h & (BUCKETS - 1)) << 15 | (h >> 40) & (BUCKETS - 1)
                return pair

        self.memo = Memo()

    def ids(self, text: str) -> np.ndarray:
        if len(text) > TRAIN_DOCUMENT * 16:  # without a list of all its words
            return np.fromiter((self.memo[m[0]] for m in _WORD.finditer(text.lower())), dtype=np.int32)
        words = _WORD.findall(text.lower())
        return np.fromiter(map(self.memo.__getitem__, words), dtype=np.int32, count=len(words))


def _columns() -> list[tuple[int, int, int]]:
    """(width, position in the filter, first column) of the multiplied-out tables."""
    out, at = [], 0
    for w in WIDTHS:
        for o in range(w):
            out.append((w, o, at))
            at += FILTERS
    return out


#: Of each column its filter, its position in it and its filter's width.
_FILTER = np.array([k * FILTERS + f for k, w in enumerate(WIDTHS) for _ in range(w) for f in range(FILTERS)])
_PLACE = np.array([o for _, o, _ in _columns() for _ in range(FILTERS)])
_WIDTH = np.repeat(WIDTHS, FILTERS)


@dataclass
class Network:
    tables: tuple[np.ndarray, np.ndarray]  # per hash: BUCKETS x (filters' columns)
    bias: np.ndarray  # per filter, by width
    out: np.ndarray
    out_bias: float
    words_by_lang: np.ndarray  # BUCKETS x languages: log-probabilities
    langs: list[str]
    cut: np.ndarray  # per language and, last, for texts without words
    trained: bool = True

    def maxima(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's value at its best position, after the bias and 0 at least, and the first such position."""
        best, at = np.full(len(self.bias), -np.inf, np.float32), np.zeros(len(self.bias), np.int64)
        for start in range(0, len(ids), TRAIN_DOCUMENT):
            part = ids[start : start + TRAIN_DOCUMENT + max(WIDTHS) - 1]
            sums = self.tables[0][part >> 15]
            sums += self.tables[1][part & (BUCKETS - 1)]
            for k, w in enumerate(WIDTHS):
                n = min(len(part) - w + 1, TRAIN_DOCUMENT)
                if n < 1:
                    continue
                cols = [at for width, _, at in _columns() if width == w]
                total = sums[:n, cols[0] : cols[0] + FILTERS]
                for o in range(1, w):
                    total = total + sums[o : n + o, cols[o] : cols[o] + FILTERS]
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                first = total.argmax(0)
                top = total[first, np.arange(FILTERS)]
                at[own] = np.where(top > best[own], start + first, at[own])
                best[own] = np.maximum(best[own], top)
        return np.maximum(best + self.bias, 0), at

    def features(self, ids: np.ndarray) -> np.ndarray:
        return self.maxima(ids)[0]

    def logit(self, ids: np.ndarray) -> float:
        return float(self.features(ids) @ self.out + self.out_bias)

    def language(self, ids: np.ndarray) -> int:
        """The likeliest language's number; the last threshold's where there is no word."""
        if not len(ids) or not self.langs:
            return len(self.langs)
        total = sum(self.words_by_lang[ids[i : i + TRAIN_DOCUMENT] >> 15].sum(0, dtype=np.float64) for i in range(0, len(ids), TRAIN_DOCUMENT))
        return int(total.argmax())

    def score(self, ids: np.ndarray) -> float:
        if not self.trained:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.logit(ids) - self.cut[self.language(ids)], -30, 30))))


@dataclass
class Parameters:
    """What is learned, as views of one vector."""

    flat: np.ndarray

    def __post_init__(self):
        sizes = (2 * BUCKETS * DIM, len(_FILTER) * 2 * DIM, len(WIDTHS) * FILTERS, len(WIDTHS) * FILTERS, 1)
        ends = np.cumsum(sizes)
        words, filters, self.bias, self.out, self.out_bias = (self.flat[e - n : e] for n, e in zip(sizes, ends))
        self.words, self.filters = words.reshape(2, BUCKETS, DIM), filters.reshape(len(_FILTER), 2 * DIM)

    @staticmethod
    def zeros(dtype) -> Parameters:
        most = 2 * BUCKETS * DIM + len(_FILTER) * 2 * DIM + 2 * len(WIDTHS) * FILTERS + 1
        return Parameters(np.zeros(-(-most // LANES) * LANES, dtype))

    def network(self, by_lang: np.ndarray, langs: list[str]) -> Network:
        words, filters = self.words.astype(np.float32), self.filters.astype(np.float32)
        tables = tuple(e @ filters[:, k * DIM : (k + 1) * DIM].T for k, e in enumerate(words))
        return Network(tables, self.bias.astype(np.float32), self.out.astype(np.float32), float(np.float32(self.out_bias[0])), by_lang, langs, np.zeros(len(langs) + 1))


def start(seen: np.ndarray, totals: np.ndarray, seed: int) -> Parameters:
    """Random words and filters, but for the first coordinates and filters: how much oftener toxic documents hold the bucket, shrunk where it is rare."""
    rng = np.random.default_rng(seed)
    p = Parameters.zeros(np.float64)
    p.words[:] = rng.normal(0, 0.05, p.words.shape)
    p.filters[:] = rng.normal(0, 0.3, p.filters.shape)
    p.out[:] = rng.normal(0, 0.3, p.out.shape)
    p.out_bias[:] = -1.0
    for k in range(2):
        odds = np.log((seen[k, 1] + 0.5) / (totals[1] + 1)) - np.log((seen[k, 0] + 0.5) / (totals[0] + 1))
        n = seen[k].sum(0)
        p.words[k, :, 0] = np.clip(odds * n / (n + 20), -2, 2)
    for _, place, at in _columns():
        if place == 0:
            p.filters[at, [0, DIM]] = 1.0
    p.bias[::FILTERS] = -1.0
    p.out[::FILTERS] = 1.0
    return p


def descend(p: Parameters, gradient, steps: int, rate: float = 0.05, floor: float = 1e-4) -> Parameters:
    """Adam with a falling rate; ``gradient(i, p)`` is that of step i. What few documents move, by less than ``floor``, moves little."""
    first, second = np.zeros_like(p.flat), np.zeros_like(p.flat)
    for i in range(steps):
        g = gradient(i, p) * GRAIN
        first = 0.8 * first + 0.2 * g
        second = 0.9 * second + 0.1 * g * g
        p.flat -= rate * (1 - i / steps) * first / (1 - 0.8 ** (i + 1)) / (np.sqrt(second / (1 - 0.9 ** (i + 1))) + floor)
    return p


def _count(rows, fit: set[int], numbers: dict[str, int]):
    """Of (part, label, lang, ids) rows: the documents of the parts ``fit`` by hash, label and bucket, then each language's words."""
    seen, spoken = np.zeros((2, 2, BUCKETS), np.int64), {}
    for part, label, lang, ids in rows:
        if part in fit:
            for k, h in enumerate((ids >> 15, ids & (BUCKETS - 1))):
                seen[k, label, np.unique(h)] += 1
        if lang is not None:
            if lang not in spoken and len(spoken) >= 64:
                yield from _spoken(spoken, numbers)
                spoken = {}
            spoken.setdefault(lang, np.zeros(BUCKETS, np.int64))
            spoken[lang] += np.bincount(ids >> 15, minlength=BUCKETS)
    yield 0, seen
    yield from _spoken(spoken, numbers)


def _spoken(spoken: dict[str, np.ndarray], numbers: dict[str, int]):
    for lang, n in spoken.items():
        yield (4 + numbers[lang]) * BUCKETS, n


def _gradient(rows, flat: np.ndarray, weight: list[float]):
    """The loss's gradient over (part, label, lang, ids) rows, each rounded to whole GRAINs."""
    p, total = Parameters(flat), Parameters.zeros(np.int64)
    net = p.network(np.zeros((BUCKETS, 0)), [])
    grains = lambda x: np.rint(np.asarray(x, np.float64) / GRAIN).astype(np.int64)
    for _, label, _, ids in rows:
        feats, at = net.maxima(ids)
        z = float(feats @ net.out) + net.out_bias
        d = (1 / (1 + math.exp(-min(max(z, -30.0), 30.0))) - label) * weight[label]
        df = d * net.out * (feats > 0)
        total.out += grains(d * feats)
        total.out_bias += grains(d)
        total.bias += grains(df)
        use = np.flatnonzero((df[_FILTER] != 0) & (_WIDTH[_FILTER] <= len(ids)))
        if not len(use):
            continue
        word = ids[at[_FILTER[use]] + _PLACE[use]]
        h1, h2, by = word >> 15, word & (BUCKETS - 1), df[_FILTER[use], None]
        total.filters[use] += grains(by * np.concatenate((p.words[0, h1], p.words[1, h2]), axis=1))
        back = grains(by * p.filters[use])
        np.add.at(total.words[0], h1, back[:, :DIM])
        np.add.at(total.words[1], h2, back[:, DIM:])
    yield 0, total.flat


def _logits(rows, net: Network) -> Counter:
    """How many of (part, label, lang, ids) rows have (language read, cell of the logit, label)."""
    return Counter((net.language(ids), math.floor(net.logit(ids) * CELLS), label) for _, label, _, ids in rows)


class Held:
    """Training rows (part, label, lang, ids) in memory."""

    def __init__(self, rows: list[tuple[int, int, str | None, np.ndarray]]):
        self.rows = rows

    def sizes(self) -> Counter:
        return Counter(r[:3] for r in self.rows)

    def summed(self, work, parts: set[int], length: int, *sent) -> np.ndarray:
        total = np.zeros(length, np.int64)
        for at, v in work((r for r in self.rows if r[0] in parts), *sent):
            total[at : at + v.size] += v.ravel()
        return total

    def logits(self, parts: set[int], net: Network) -> Counter:
        return _logits((r for r in self.rows if r[0] in parts), net)


class Spread:
    """Training rows in a table (part, label, lang, ids), read on executors; only sums come back."""

    def __init__(self, table: DataFrame):
        self.table = table

    def sizes(self) -> Counter:
        got = self.table.groupBy("part", "label", "lang").agg(F.count(F.lit(1)).alias("n")).collect()
        return Counter({(r["part"], r["label"], r["lang"]): r["n"] for r in got})

    def _run(self, parts: set[int], work, sent: tuple, schema: str, keys: list[str]):
        sent = self.table.sparkSession.sparkContext.broadcast(sent)

        def rows(batches):
            for batch in batches:
                *rest, ids = (batch.column(c).to_pylist() for c in ("part", "label", "lang", "ids"))
                yield from zip(*rest, (np.frombuffer(i, np.int32) for i in ids))

        made = self.table.where(F.col("part").isin(*parts)).mapInArrow(lambda batches: work(rows(batches), *sent.value), schema)
        got = made.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in made.columns if c not in keys)).toArrow()
        sent.destroy()
        return got

    def summed(self, work, parts: set[int], length: int, *sent) -> np.ndarray:
        names = ["lane_row", *(f"v{k}" for k in range(LANES))]

        def lanes(rows, *sent):
            import pyarrow as pa

            for at, v in work(rows, *sent):
                v = v.reshape(-1, LANES)
                own = np.flatnonzero(v.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(own + at // LANES), *(pa.array(v[own, k]) for k in range(LANES))], names=names)

        got = self._run(parts, lanes, sent, ", ".join(f"{n} long" for n in names), ["lane_row"])
        total = np.zeros((length // LANES, LANES), np.int64)
        total[got["lane_row"].to_numpy()] = np.stack([got[n].to_numpy() for n in names[1:]], axis=1)
        return total.ravel()

    def logits(self, parts: set[int], net: Network) -> Counter:
        names = ["read", "cell", "label", "n"]

        def cells(rows, net):
            import pyarrow as pa

            found = _logits(rows, net)
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in found], pa.int64()) for i in range(3)), pa.array(list(found.values()), pa.int64())], names=names)

        got = self._run(parts, cells, (net,), ", ".join(f"{n} long" for n in names), names[:3])
        *keys, n = (got[c].to_pylist() for c in names)
        return Counter(dict(zip(zip(*keys), n)))


def fit(rows: Held | Spread, seed: int = 7, steps: int = STEPS) -> Network:
    """The network and thresholds of all ``rows``, whatever their order and partitions.

    Every part but CALIBRATION is fitted, and that one gives the thresholds; where either lacks a label, all parts do both.
    Without both labels the network scores 0 everywhere.
    """
    sizes, every = rows.sizes(), set(range(FOLDS + 1))
    count = lambda parts: [sum(n for (part, label, _), n in sizes.items() if part in parts and label == y) for y in (0, 1)]
    fitted, folds, judged = every - {CALIBRATION}, [{k} for k in range(FOLDS)], {CALIBRATION}
    if not all(count(fitted)) or not all(count(judged)):
        fitted, folds, judged = every, [every], every
    langs = sorted({lang for _, _, lang in sizes if lang is not None})
    counts = rows.summed(_count, every, (4 + len(langs)) * BUCKETS, fitted, {lang: k for k, lang in enumerate(langs)})
    spoken = 1.0 + counts[4 * BUCKETS :].reshape(len(langs), BUCKETS).T
    by_lang = np.log(spoken / spoken.sum(0)).astype(np.float32)
    totals = np.array(count(fitted))
    p = start(counts[: 4 * BUCKETS].reshape(2, 2, BUCKETS), totals, seed)
    if not totals.all():
        net = p.network(by_lang, langs)
        net.trained = False
        return net
    weight = (len(folds) / (2 * totals)).tolist()
    descend(p, lambda i, p: rows.summed(_gradient, folds[i % len(folds)], p.flat.size, p.flat.astype(np.float32), weight), steps)
    net = p.network(by_lang, langs)
    calibrate(net, rows.logits(judged, net))
    return net


def train(rows: list[tuple[int, bool, str | None, np.ndarray]], seed: int = 7, steps: int = STEPS) -> Network:
    """Fit on (label, for calibration, lang, ids) rows in memory."""
    return fit(Held([(CALIBRATION if judged else i % FOLDS, label, lang, ids) for i, (label, judged, lang, ids) in enumerate(rows)]), seed, steps)


def calibrate(net: Network, found: Counter, least: int = 30) -> None:
    """Per language the edge between cells of the logit that separates its labels with the best F1; the overall one where a class is scarce.

    ``found`` counts documents by (language read, cell, label).
    """
    net.cut[:] = _best_cut(found)
    for k in range(len(net.langs)):
        own = Counter({key: n for key, n in found.items() if key[0] == k})
        if all(sum(n for key, n in own.items() if key[2] == y) >= least for y in (0, 1)):
            net.cut[k] = _best_cut(own)


def _best_cut(found: Counter) -> float:
    by_cell: dict[int, list[int]] = {}
    for (_, cell, label), n in found.items():
        by_cell.setdefault(cell, [0, 0])[label] += n
    cells = np.array(sorted(by_cell, reverse=True))
    n = np.array([by_cell[c] for c in cells.tolist()]).reshape(-1, 2)
    if not n.sum(0).all():
        return 0.0
    f1 = 2 * n[:, 1].cumsum() / (n.sum(1).cumsum() + n[:, 1].sum())
    k = int(f1.argmax())
    return float(cells[k] if k + 1 == len(cells) else (cells[k] + cells[k + 1] + 1) / 2) / CELLS


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Network:
    """Train on all rows of ``docs`` (doc_id, text, lang) that ``labels`` (doc_id, toxic) covers; null labels and texts are left out.

    Of labels that repeat an id the larger counts. Each text's words are hashed once and staged; then executors add up
    counts, gradients and logits, and the driver holds sums alone: their size does not grow with the rows.
    Without documents of both labels the network scores 0 everywhere.
    """
    bounded_batches(spark)
    staged = Staged(spark, "toxicity")
    named = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    named = staged.write(named, "labels")
    if named.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        named = F.broadcast(named)
    place = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_003))
    part = F.when(place % 4 == 0, CALIBRATION).otherwise(F.floor(place / 4) % FOLDS).cast("int")
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text", "lang").join(named, "doc_id").select(part.alias("part"), "label", "lang", "text")

    def hashed(batches):
        import pyarrow as pa

        hasher = Hasher()
        for batch in batches:
            ids = [hasher.ids(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "label", "lang")), pa.array(ids, pa.binary())], names=["part", "label", "lang", "ids"])

    path, schema = staged.path("words"), "label int, lang string, ids binary, part int"
    words = texts.mapInArrow(hashed, "part int, label int, lang string, ids binary")
    words.write.partitionBy("part").option("compression", "zstd").option("parquet.block.size", TRAIN_BYTES).parquet(path)
    return fit(Spread(spark.read.schema(schema).parquet(path)))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, score (0 to 1), predicted (score >= 0.5) for each row, from every word of the text.

    Null and empty texts get the score of a text without words; repeated rows each give a row; an empty table none;
    columns other than doc_id and text are not read.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(net)  # a fixed few MB
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        hasher, net = Hasher(), sent.value
        for batch in batches:
            s = np.array([net.score(hasher.ids(t or "")) for t in batch.column("text").to_pylist()], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, score double, predicted int")
