"""Evaluation metrics: token and shingle recall, edit similarity, list F1, greedy matching and pass rates."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import arrow_udf, bounded_batches


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def token_scores(pairs: DataFrame, key: str = "id") -> DataFrame:
    """Multiset unigram recall and precision of ``pred`` against ``gold``; null where the divisor is empty."""
    gold = pairs.select(key, F.explode(tokens(F.col("gold"))).alias("t")).groupBy(key, "t").agg(F.count(F.lit(1)).alias("g"))
    pred = pairs.select(key, F.explode(tokens(F.col("pred"))).alias("t")).groupBy(key, "t").agg(F.count(F.lit(1)).alias("p"))
    both = gold.join(pred, [key, "t"], "full").na.fill(0, ["g", "p"])
    sums = both.groupBy(key).agg(F.sum(F.least("g", "p")).alias("hit"), F.sum("g").alias("g"), F.sum("p").alias("p"))
    return sums.select(key, F.round(F.when(F.col("g") > 0, F.col("hit") / F.col("g")), 6).alias("recall"), F.round(F.when(F.col("p") > 0, F.col("hit") / F.col("p")), 6).alias("precision"))


def shingle_recall(pairs: DataFrame, n: int = 5, key: str = "id") -> DataFrame:
    """Share of the gold's distinct n-word shingles that the prediction holds; null for shorter golds."""
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - n, F.lit(0))), lambda i: F.array_join(F.slice(c, i + 1, n), " ")))
    rows = pairs.select(key, tokens(F.col("gold")).alias("g"), tokens(F.col("pred")).alias("p"))
    share = F.size(F.array_intersect(grams(F.col("g")), grams(F.col("p")))) / F.size(grams(F.col("g")))
    return rows.select(key, F.round(F.when(F.size("g") >= n, share), 6).alias("shingle_recall"))


#: Shingles of passages that are sent to every executor; more of them are joined by a shuffle.
BROADCAST_SHINGLES = 1_000_000


def containment(passages: DataFrame, docs: DataFrame, n: int = 5, least: float = 0.5, key: str = "item_id", doc: str = "doc_id") -> DataFrame:
    """key, doc, share of every passage and text that have ``least`` of the passage's distinct n-word shingles in common.

    Passages of fewer words have none. Shingles meet by their hashes over whole texts; only those of passages leave a text.
    """

    def shingles(rows: DataFrame, name: str) -> DataFrame:
        # The words are shifted against themselves and zipped: a lambda that held the whole array would work it out anew each time.
        words = rows.select(name, tokens(F.col("text")).alias("w")).where(F.size("w") >= n)
        shifted = F.arrays_zip(*(F.slice("w", i + 1, F.size("w") - n + 1).alias(f"w{i}") for i in range(n)))
        grams = words.select(name, shifted.alias("z")).select(name, F.transform("z", lambda x: F.xxhash64(F.concat_ws(" ", *(x[f"w{i}"] for i in range(n))))).alias("g"))
        return grams.select(name, F.explode(F.array_distinct("g")).alias("gram"))

    asked = shingles(passages.select(key, "text"), key)
    sizes = asked.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    if asked.limit(BROADCAST_SHINGLES + 1).count() <= BROADCAST_SHINGLES:
        asked = F.broadcast(asked)
    common = shingles(docs.select(doc, "text"), doc).join(asked, "gram").groupBy(key, doc).agg(F.count(F.lit(1)).alias("common"))
    share = F.round(F.col("common") / F.col("size"), 6)
    return common.join(sizes, key).select(key, doc, share.alias("share")).where(F.col("share") >= least)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length; null when either is missing, 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest))


def list_f1(rows: DataFrame, key: str = "id") -> DataFrame:
    """Multiset F1 of (key, side, item) rows, side ``gold`` or ``pred``; null without gold."""
    n = lambda s: F.count_if(F.col("side") == s)
    per = rows.groupBy(key, F.lower("item").alias("item")).agg(n("gold").alias("g"), n("pred").alias("p"))
    sums = per.groupBy(key).agg(F.sum(F.least("g", "p")).alias("hit"), F.sum("g").alias("g"), F.sum("p").alias("p"))
    return sums.select(key, F.round(F.when(F.col("g") > 0, 2 * F.col("hit") / (F.col("g") + F.col("p"))), 6).alias("f1"))


def greedy_match(pairs: DataFrame, key: str = "id") -> DataFrame:
    """One-to-one matching of (key, gold, pred, score) pairs, best scores first, ties by gold, then pred.

    Sequential within a key, so a key's pairs go to one task. They are sorted there by Spark and pass by: only the names that are
    taken are held, and any number of keys shares a task.
    """

    def run(batches):
        import pyarrow as pa

        at, used_gold, used_pred = object(), set(), set()
        for batch in batches:
            keep = []
            for k, gold, pred in zip(*(batch.column(c).to_pylist() for c in (key, "gold", "pred"))):
                if k != at:
                    at, used_gold, used_pred = k, set(), set()
                keep.append(new := gold not in used_gold and pred not in used_pred)
                if new:
                    used_gold.add(gold)
                    used_pred.add(pred)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return _best_first(pairs.where("score > 0"), key).mapInArrow(run, pairs.schema)


def _best_first(pairs: DataFrame, key: str) -> DataFrame:
    return pairs.repartition(key).sortWithinPartitions(key, F.desc("score"), F.asc_nulls_last("gold"), F.asc_nulls_last("pred"))


def by_type(scores: DataFrame, kind: str, *metrics: str) -> DataFrame:
    """Mean, median and number of each metric per type; nulls are left out, never taken as 0."""
    made = [x for m in metrics for x in (F.round(F.avg(m), 6).alias(f"{m}_mean"), F.round(F.median(m), 6).alias(f"{m}_median"), F.count(m).alias(f"{m}_n"))]
    return scores.groupBy(kind).agg(*made)


def pass_rate(scores: DataFrame, floors: dict[str, float], *by: str) -> DataFrame:
    """Share of rows that fall below no floor; a null metric never fails."""
    ok = F.lit(True)
    for metric, floor in floors.items():
        ok = ok & F.coalesce(F.col(metric) >= floor, F.lit(True))
    return scores.groupBy(*by).agg(F.round(F.avg(ok.cast("double")), 6).alias("pass_rate"), F.count(F.lit(1)).alias("n"))


def consensus(readings: DataFrame, threshold: float = 0.15, share: float = 0.07) -> DataFrame:
    """Regions whose two readings disagree, ranked; the worst ``share`` of a paper's compared regions (one at least) escalate."""
    norm = lambda c: F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"-\n", ""), r"\s+", " ")
    a, b = norm(F.col("first")), norm(F.col("second"))
    rows = readings.withColumn("score", F.round(1 - edit_similarity(a, b), 6))
    w = Window.partitionBy("paper_id")
    rows = rows.withColumn("compared", F.count(F.lit(1)).over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "region_id")))
    flagged = F.col("score") >= threshold
    return rows.select("paper_id", "region_id", "score", flagged.alias("flagged"), (flagged & (F.col("place") <= F.greatest(F.lit(1), F.ceil(share * F.col("compared"))))).alias("escalated"))


def diff(a: DataFrame, b: DataFrame, key: str, *columns: str, tolerance: float = 1e-4) -> DataFrame:
    """Differences of two exports as (key, path, left, right, kind); rows of one side only differ as a whole."""
    x, y = a.select(key, *(F.col(c).alias(f"a_{c}") for c in columns), F.lit(1).alias("in_a")), b.select(key, *(F.col(c).alias(f"b_{c}") for c in columns), F.lit(1).alias("in_b"))
    both = x.join(y, key, "full")
    types = dict(a.dtypes)
    found = []
    for c in columns:
        l, r = F.col(f"a_{c}"), F.col(f"b_{c}")
        differs = ~l.eqNullSafe(r)
        if types[c] in ("double", "float"):
            differs = differs & ~F.coalesce(F.abs(l - r) <= tolerance, F.lit(False))
        found.append(F.when(F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & differs, F.struct(F.lit(c).alias("path"), l.cast("string").alias("left"), r.cast("string").alias("right"), F.lit("value").alias("kind"))))
    alone = F.when(F.col("in_b").isNull(), "only_a").when(F.col("in_a").isNull(), "only_b")
    found.append(F.when(alone.isNotNull(), F.struct(F.lit("").alias("path"), F.lit(None).cast("string").alias("left"), F.lit(None).cast("string").alias("right"), alone.alias("kind"))))
    return both.select(key, F.explode(F.array_compact(F.array(*found))).alias("d")).select(key, "d.*")


def by_path(differences: DataFrame, key: str) -> DataFrame:
    """path, papers, n (A23): how many papers and places differ at each path."""
    return differences.groupBy("path").agg(F.countDistinct(key).alias("papers"), F.count(F.lit(1)).alias("n"))


def set_f1(rows: DataFrame, key: str = "id") -> DataFrame:
    """F1 of the sets of (key, side, item) rows; null without gold."""
    per = rows.groupBy(key, F.lower("item").alias("item")).agg(F.max((F.col("side") == "gold").cast("int")).alias("g"), F.max((F.col("side") == "pred").cast("int")).alias("p"))
    sums = per.groupBy(key).agg(F.sum(F.col("g") * F.col("p")).alias("hit"), F.sum("g").alias("g"), F.sum("p").alias("p"))
    return sums.select(key, F.round(F.when(F.col("g") > 0, 2 * F.col("hit") / (F.col("g") + F.col("p"))), 6).alias("f1"))


#: Names of a key and side that are held at once, and the likeness from which names are matched before others are compared.
BLOCK, CLOSE = 2048, 0.97


def fuzzy_f1(rows: DataFrame, least: float = 0.85, key: str = "id") -> DataFrame:
    """F1 of names matched one to one, the likest first by Jaro-Winkler from ``least`` on; null without gold.

    Equal names come first, then those from ``CLOSE`` on, then the others. Each step takes what is left of the one before, so it
    gives the matching over all pairs, but far fewer are compared. Repeats of a name are one name with a number.
    """
    sizes = rows.groupBy(key).agg(F.count_if(F.col("side") == "gold").alias("g"), F.count_if(F.col("side") == "pred").alias("p"))
    names = rows.where("item IS NOT NULL").groupBy(key, F.lower("item").alias("item")).agg(F.count_if(F.col("side") == "gold").alias("g"), F.count_if(F.col("side") == "pred").alias("p"))
    hits = names.select(key, F.least("g", "p").alias("n"))
    left = names.where("g <> p").select(key, F.when(F.col("g") > F.col("p"), "gold").otherwise("pred").alias("side"), "item", F.abs(F.col("g") - F.col("p")).alias("n"))
    steps = [t for t in (CLOSE, least) if t >= least]
    for t in dict.fromkeys(steps):
        taken = _greedy_copies(_alike(left, t, key), key)
        if t > least:
            # Read again for what is left; it is no more than the names that are matched.
            taken = taken.persist(StorageLevel.DISK_ONLY)
            gone = F.explode(F.array(F.struct(F.lit("gold").alias("side"), F.col("gold").alias("item")), F.struct(F.lit("pred").alias("side"), F.col("pred").alias("item"))))
            used = taken.select(key, gone.alias("x"), "n").groupBy(key, "x.side", "x.item").agg(F.sum("n").alias("used"))
            left = left.join(used, [key, "side", "item"], "left").withColumn("n", F.col("n") - F.coalesce("used", F.lit(0))).where("n > 0").drop("used")
        hits = hits.unionByName(taken.select(key, "n"))
    hits = hits.groupBy(key).agg(F.sum("n").alias("hit"))
    return sizes.join(hits, key, "left").select(key, F.round(F.when(F.col("g") > 0, 2 * F.coalesce("hit", F.lit(0)) / (F.col("g") + F.col("p"))), 6).alias("f1"))


def _alike(names: DataFrame, least: float, key: str) -> DataFrame:
    """key, gold, pred, their numbers and score of all pairs of a key's names (key, side, item, n) from ``least`` on.

    Names lie in blocks by length and letters, and pairs of blocks are dealt over many tasks. Jaro-Winkler is worked out where the
    letters that two names have in common allow the likeness.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    bounded_batches(names.sparkSession)
    letters = F.array_join(F.array_sort(F.split("item", "")), "")
    place = F.row_number().over(Window.partitionBy(key, "side").orderBy(F.length("item"), letters, "item"))
    placed = names.withColumn("block", F.floor((place - 1) / BLOCK))
    blocks = placed.groupBy(key, "side", "block").agg(F.collect_list("item").alias("items"), F.collect_list("n").alias("ns"), F.min(F.length("item")).alias("low"), F.max(F.length("item")).alias("high"))
    side = lambda s: blocks.where(F.col("side") == s).select(key, *(F.col(c).alias(f"{s}_{c}") for c in ("block", "items", "ns", "low", "high")))
    # All letters in common, the shorter length must still be this share of the longer one.
    share = 3 * _jaro_for(least) - 2 - 1e-9
    near = (F.col("gold_high") >= share * F.col("pred_low")) & (F.col("pred_high") >= share * F.col("gold_low"))
    parts = max(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * names.sparkSession.sparkContext.defaultParallelism)
    both = side("gold").join(side("pred"), key).where(near).repartition(parts, key, "gold_block", "pred_block").select(key, "gold_items", "gold_ns", "pred_items", "pred_ns")
    kind = names.schema[key].dataType.simpleString()
    schema = _parse_datatype_string(f"`{key}` {kind}, gold string, pred string, gold_n long, pred_n long, score double")
    arrow = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        out = []
        give = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
        for batch in batches:
            for k, golds, gold_ns, preds, pred_ns in zip(*(c.to_pylist() for c in batch.columns)):
                for i, j, score in alike_pairs(golds, preds, least):
                    out.append((k, golds[i], preds[j], gold_ns[i], pred_ns[j], score))
                    if len(out) == 10_000:
                        yield give()
                        out.clear()
        if out:
            yield give()

    return both.mapInArrow(run, schema)


def _jaro_for(least: float) -> float:
    """The Jaro similarity without which no Jaro-Winkler of ``least`` is possible."""
    return least if least <= 0.7 else max(0.7, (least - 0.4) / 0.6)


def alike_pairs(golds: list[str], preds: list[str], least: float):
    """Places and Jaro-Winkler of all pairs that have ``least``; pairs of names with too few letters in common are left out unseen."""
    import numpy as np

    from ..functions.fuzzy import jaro_winkler_value

    def bags(names):
        found: dict[str, list[int]] = {}
        for i, name in enumerate(names):
            found.setdefault("".join(sorted(name)), []).append(i)
        return list(found), list(found.values())

    (a, gold_at), (b, pred_at) = bags(golds), bags(preds)
    size = lambda x: np.array([len(w) for w in x], np.int32)
    common = np.zeros((len(a), len(b)), np.int32)
    for letter in {*"".join(a)} & {*"".join(b)}:
        x, y = (np.array([w.count(letter) for w in side], np.int32) for side in (a, b))
        rows, columns = np.flatnonzero(x), np.flatnonzero(y)
        common[np.ix_(rows, columns)] += np.minimum.outer(x[rows], y[columns])
    with np.errstate(divide="ignore", invalid="ignore"):
        most = (common / size(a)[:, None] + common / size(b)[None, :] + 1) / 3
    for x, y in zip(*np.nonzero((most >= _jaro_for(least) - 1e-9) & (common > 0))):
        for i in gold_at[x]:
            for j in pred_at[y]:
                score = jaro_winkler_value(golds[i], preds[j])
                if score >= least:
                    yield i, j, score


def _greedy_copies(pairs: DataFrame, key: str) -> DataFrame:
    """key, gold, pred, n: ``greedy_match`` where names stand for ``gold_n`` and ``pred_n`` equal ones."""

    def run(batches):
        import pyarrow as pa

        at, golds, preds = object(), {}, {}
        for batch in batches:
            taken = []
            for k, gold, pred, g, p in zip(*(batch.column(c).to_pylist() for c in (key, "gold", "pred", "gold_n", "pred_n"))):
                if k != at:
                    at, golds, preds = k, {}, {}
                taken.append(n := min(golds.get(gold, g), preds.get(pred, p)))
                if n:
                    golds[gold], preds[pred] = golds.get(gold, g) - n, preds.get(pred, p) - n
            n = pa.array(taken, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, "gold", "pred")), n], names=[key, "gold", "pred", "n"]).filter(pa.array([x > 0 for x in taken], pa.bool_()))

    return _best_first(pairs, key).mapInArrow(run, f"`{key}` {pairs.schema[key].dataType.simpleString()}, gold string, pred string, n long")


def plain_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def title_soft(gold: Column, pred: Column) -> Column:
    """1 if the titles are equal without punctuation, or one is the word-aligned start of the other with two words and 70 % of it, else 0.

    Null where gold has no title.
    """
    a, b = plain_title(gold), plain_title(pred)
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    starts = (short != "") & F.concat(long, F.lit(" ")).startswith(F.concat(short, F.lit(" "))) & (F.size(F.split(short, " ")) >= 2) & (F.length(short) >= 0.7 * F.length(long))
    return F.when(a != "", ((a == b) | starts).cast("double"))


def doi_match(gold: Column, pred: Column) -> Column:
    """1 if the DOIs agree, else 0; null where gold has none."""
    from ..functions.text import doi_key

    return F.when(F.coalesce(doi_key(gold), F.lit("")) != "", F.coalesce(doi_key(gold) == doi_key(pred), F.lit(False)).cast("double"))


#: Tokens beyond which texts are not compared word by word.
MAX_TOKENS = 1000


def rouge_l_value(gold: str | None, pred: str | None) -> float | None:
    """F-measure of the longest common subsequence of lower-case words; null without gold or beyond MAX_TOKENS."""
    a, b = (gold or "").lower().split(), (pred or "").lower().split()
    if not a or max(len(a), len(b)) > MAX_TOKENS:
        return None
    place: dict[str, int] = {}
    for i, w in enumerate(a):
        place[w] = place.get(w, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for w in b:
        hit = row & place.get(w, 0)
        row = (row + hit | row - hit) & full
    common = len(a) - row.bit_count()
    return 2 * common / (len(a) + len(b))


def rouge_l(gold, pred) -> Column:
    return arrow_udf(rouge_l_value, "double")(gold, pred)


def presence(gold: Column, pred: Column, least: int = 20, share: float = 0.5) -> Column:
    """Whether half of the gold's distinct words stand in the prediction; null for golds of fewer than ``least`` words."""
    g, p = F.array_distinct(tokens(gold)), F.array_distinct(tokens(pred))
    return F.when(F.size(tokens(gold)) >= least, (F.size(F.array_intersect(g, p)) >= share * F.size(g)).cast("double"))
