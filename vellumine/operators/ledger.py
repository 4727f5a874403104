"""Batch ledgers: the latest verdict, attempts, what to run again, and the report over an outcome log.

Rows are (paper_id, line_no, status, ...); ``started`` lines open an attempt, a verdict closes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STARTED = "started"
MAX_UNSETTLED = 3


def latest(log: DataFrame) -> DataFrame:
    """The last verdict of each paper; aggregated, so that no log is sorted."""
    verdicts = log.where(F.col("status") != STARTED)
    return verdicts.groupBy("paper_id").agg(F.max_by("status", "line_no").alias("status"), F.max("line_no").alias("line_no"))


def attempts(log: DataFrame) -> DataFrame:
    """Attempts per paper: every start, and every verdict that no start came right before."""
    w = Window.partitionBy("paper_id").orderBy("line_no")
    open_before = F.coalesce(F.lag("status").over(w) == STARTED, F.lit(False))
    counted = log.withColumn("counts", (F.col("status") == STARTED) | ~open_before)
    return counted.groupBy("paper_id").agg(F.count_if("counts").alias("attempts"))


def trailing_run(log: DataFrame, hit: Column) -> DataFrame:
    """How many of a paper's last rows in a row meet ``hit``."""
    last_miss = log.groupBy("paper_id").agg(F.max(F.when(~hit, F.col("line_no"))).alias("miss"))
    return log.join(last_miss, "paper_id").groupBy("paper_id").agg(F.count_if(F.col("miss").isNull() | (F.col("line_no") > F.col("miss"))).alias("run"))


def unsettled(log: DataFrame, failure: Column) -> DataFrame:
    """Failures and starts without a verdict since a paper's last ok, and whether it runs again by default."""
    w = Window.partitionBy("paper_id").orderBy("line_no")
    killed = (F.col("status") == STARTED) & F.coalesce(F.lead("status").over(w) == STARTED, F.lead("status").over(w).isNull())
    rows = log.withColumn("killed", killed)
    since = rows.groupBy("paper_id").agg(F.max(F.when(F.col("status") == "ok", F.col("line_no"))).alias("ok_line"))
    rows = rows.join(since, "paper_id").where(F.col("ok_line").isNull() | (F.col("line_no") > F.col("ok_line")))
    counted = rows.groupBy("paper_id").agg(F.count_if(failure | F.col("killed")).alias("unsettled"))
    out = log.select("paper_id").distinct().join(counted, "paper_id", "left").na.fill(0, ["unsettled"]).join(latest(log).select("paper_id", "status"), "paper_id", "left")
    runs = (F.coalesce(F.col("status"), F.lit("")) != "ok") & (F.col("unsettled") < MAX_UNSETTLED)
    return out.select("paper_id", "unsettled", runs.alias("runs_again"))


def report(log: DataFrame) -> DataFrame:
    """One row: papers by latest verdict, the window, throughput, latency percentiles of all ok attempts, token and match totals."""
    last = latest(log).join(log.select("paper_id", "line_no", "n_refs", "n_matched"), ["paper_id", "line_no"])
    papers = last.agg(
        F.count(F.lit(1)).alias("papers"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("failed"),
        F.sum(F.when(F.col("status") == "ok", F.col("n_refs"))).alias("refs"), F.sum(F.when(F.col("status") == "ok", F.col("n_matched"))).alias("matched"),
    )
    ok = F.col("status") == "ok"
    took = F.when(ok, F.col("duration_s"))
    runs = log.agg(
        F.count(F.lit(1)).alias("attempts"), ((F.unix_micros(F.max("happened").cast("timestamp")) - F.unix_micros(F.min("happened").cast("timestamp"))) / 3.6e9).alias("hours"),
        F.percentile(took, 0.5).alias("p50"), F.percentile(took, 0.9).alias("p90"), F.max(took).alias("longest"), F.avg(took).alias("mean"),
    )
    both = papers.crossJoin(runs)  # one row each
    rate = F.when(F.col("hours") > 0, F.col("ok") / F.col("hours"))
    return both.select(
        "papers", "ok", "failed", "attempts", F.round("hours", 3).alias("hours"), F.round(rate, 2).alias("per_hour"), *(F.round(c, 3).alias(c) for c in ("p50", "p90", "longest", "mean")), "refs", "matched", F.round(F.col("matched") / F.col("refs"), 4).alias("match_rate")
    )


LINE = (
    "paper_id string, status string, run_id string, started_at string, finished_at string, duration_s double, stage_times map<string,double>, llm_tokens long, n_refs long, n_matched long, "
    "warnings struct<count:long,codes:map<string,long>>, error_code string, failed_stage string, sha256 string, bytes long"
)


def read_lines(lines: DataFrame, hidden: bool = False) -> tuple[DataFrame, DataFrame]:
    """(ledger rows, one row with the number of malformed lines) of JSON lines: line_no, value.

    A malformed line, or one without a paper and status, is skipped and counted; blank lines are neither. ``started`` rows are
    left out unless ``hidden``.
    """
    parsed = lines.where(F.trim("value") != "").select("line_no", F.from_json("value", LINE + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    good = F.col("r").isNotNull() & F.col("r._bad").isNull() & F.col("r.paper_id").isNotNull() & F.col("r.status").isNotNull()
    rows = parsed.where(good).select("line_no", "r.*").drop("_bad")
    return (rows if hidden else rows.where(F.col("status") != STARTED)), parsed.agg(F.count_if(~F.coalesce(good, F.lit(False))).alias("malformed"))


def append_lines(rows: DataFrame, path: str) -> None:
    """Append ledger rows as JSON lines; a reader sees a batch of them as a whole or not at all."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("append").text(path)


def retained(jobs: DataFrame, now, ttl: float, most: int, budget: int) -> DataFrame:
    """The jobs (store, job_id, finished, size) that each store still keeps at ``now``.

    Finished jobs go after ``ttl`` seconds; of the others a store keeps the newest ``most``, ties by the larger job_id, and
    of these the newest whose sizes fit ``budget`` together (0: any), but its newest for size alone always. Unfinished jobs
    stay. A null size is none, a null store is a store. Tasks hold at most ``most`` rows of a store where that is below
    ``spark.sql.optimizer.windowGroupLimitThreshold``: the ranks are cut before the shuffle.
    """
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("finished").cast("timestamp"))
    newest = Window.partitionBy("store").orderBy(F.desc("finished"), F.desc("job_id"))
    ranked = jobs.where(age <= int(ttl * 1_000_000)).withColumn("__rank", F.row_number().over(newest)).where(F.col("__rank") <= most)
    held = F.sum(F.coalesce("size", F.lit(0))).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    kept = ranked.withColumn("__held", held).where((F.lit(budget) <= 0) | (F.col("__rank") == 1) | (F.col("__held") <= budget))
    return kept.drop("__rank", "__held").unionByName(jobs.where("finished IS NULL"))


def top_codes(log: DataFrame, n: int = 10) -> DataFrame:
    """The commonest codes, ties by name; a top-n report by design."""
    return log.groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "code").limit(n)


def failures(log: DataFrame) -> DataFrame:
    """Failures by code and by the stage that failed, commonest first by ``place``: kind, name, n, place."""
    rows = log.where(F.col("status") == "failed").select(F.explode(F.array(F.struct(F.lit("code").alias("kind"), F.coalesce("code", F.lit("unknown")).alias("name")), F.struct(F.lit("stage").alias("kind"), F.coalesce("failed_stage", F.lit("unknown")).alias("name")))).alias("x"))
    counts = rows.groupBy("x.kind", "x.name").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "name")).cast("long"))


def usage(log: DataFrame, *by: str) -> DataFrame:
    """Calls and tokens by the levels ``by`` (label and model unless given) with totals of each level; null names a total."""
    return log.rollup(*(by or ("label", "model"))).agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), F.grouping_id().cast("long").alias("level"))


def provenance(entries: DataFrame) -> DataFrame:
    """paper_id and its fields' sources as a map (A7): of several entries of a field the last by ``line_no`` counts."""
    last = entries.groupBy("paper_id", "field").agg(F.max_by("source", "line_no").alias("source"))
    return last.groupBy("paper_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "source")))).alias("sources"))


def sliding_excess(log: DataFrame, seconds: int, most: int) -> DataFrame:
    """Rows at which more than ``most`` requests of a key fall in the ``seconds`` up to and with them."""
    w = Window.partitionBy("key").orderBy(F.unix_micros(F.col("happened").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return log.withColumn("in_window", F.count(F.lit(1)).over(w)).where(F.col("in_window") > most)
