"""Language identification by rank-order profiles of character n-grams and the out-of-place distance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches

#: n-grams kept per language and per document.
PROFILE = 400
#: Training documents per language, expected: larger languages are thinned by a hash of the id.
TRAIN_ROWS = 3000
UNKNOWN = "und"

_LETTERS: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """A number from 1 for every letter's code point, 0 for anything else."""
    global _LETTERS
    if _LETTERS is None:
        letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
        _LETTERS = np.where(letter, np.cumsum(letter), 0).astype(np.int64)
    return _LETTERS


def ngrams(text: str) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams of a text's lower-cased words, each word padded by one blank on either side."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letters = letter_table()[points]
    seq = np.concatenate(([0], letters, [0]))
    seq = seq[np.concatenate(([True], (seq[1:] > 0) | (seq[:-1] > 0)))]
    a, b, c = seq[:-2], seq[1:-1], seq[2:]
    inside = b > 0
    pairs = (seq[:-1] << 18 | seq[1:]) | 2 << 54
    return np.concatenate((seq[seq > 0] | 1 << 54, pairs[(seq[:-1] > 0) | (seq[1:] > 0)], ((a << 36 | b << 18 | c) | 3 << 54)[inside]))


def ranked(codes: np.ndarray, top: int) -> np.ndarray:
    """The most frequent codes, ties by code."""
    values, counts = np.unique(codes, return_counts=True)
    if len(values) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        keep = counts >= least
        values, counts = values[keep], counts[keep]
    return values[np.lexsort((values, -counts))[:top]]


class Profiles:
    """Language profiles as one sorted vocabulary and a rank of each entry in each language."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.size = size
        self.langs = sorted(profiles)
        self.codes = np.array(sorted({c for p in profiles.values() for c in p}), dtype=np.int64)
        self.rank = np.full((len(self.codes) + 1, len(self.langs)), -1, dtype=np.int64)
        for k, lang in enumerate(self.langs):
            own = np.array(profiles[lang], dtype=np.int64)
            self.rank[np.searchsorted(self.codes, own), k] = np.arange(len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and 1 - distance / largest distance; ``und`` and 0 for a text without letters."""
        codes = ngrams(text) if text else ()
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        top = ranked(codes, self.size)
        at = np.searchsorted(self.codes, top)
        at[at == len(self.codes)] = 0 if len(self.codes) else 0
        ranks = self.rank[np.where(self.codes[at] == top, at, len(self.codes))]
        apart = np.abs(ranks - np.arange(len(top))[:, None])
        distance = np.where(ranks < 0, self.size, apart).sum(0)
        best = int(distance.argmin())
        return self.langs[best], float(1 - distance[best] / (self.size * len(top)))


def learn(spark: SparkSession, docs: DataFrame, profile: int = PROFILE, train_rows: int = TRAIN_ROWS) -> Profiles:
    """Profiles of every non-null ``lang`` of ``docs`` (doc_id, text, lang), from about ``train_rows`` documents each."""
    bounded_batches(spark)
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    totals = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return Profiles({}, profile)
    part = spark.createDataFrame([(k, min(1.0, train_rows / n)) for k, n in totals.items()], "lang string, part double")
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_003)) < F.col("part") * 1_000_003
    sample = docs.join(F.broadcast(part), "lang").where(drawn | F.col("doc_id").isNull()).select("lang", "text")

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by.setdefault(lang, []).append(ngrams(text))
            for lang, codes in by.items():
                values, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])

    counts = sample.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    best = counts.withColumn("place", place).where(F.col("place") <= profile).orderBy("lang", "place").collect()
    profiles: dict[str, list[int]] = {}
    for r in best:
        profiles.setdefault(r["lang"], []).append(r["code"])
    return Profiles(profiles, profile)


def identify(docs: DataFrame, profiles: Profiles, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score for each row; whole texts, whatever their length.

    A null text, an empty one and one without letters give ``und`` and 0; equal distances go to the language that sorts
    first; repeated rows each give a row; columns other than key and text are not read.
    """
    import pyarrow as pa

    bounded_batches(docs.sparkSession)
    id_type = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [profiles.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["id", "lang_pred", "score"])

    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {id_type}, lang_pred string, score double").withColumnRenamed("id", key)
