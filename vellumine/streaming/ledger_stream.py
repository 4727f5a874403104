"""The batch ledger and its guards as streams: running verdicts, request windows and a circuit breaker."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.operators.ledger import MAX_UNSETTLED, STARTED

THRESHOLD = 5
RESET_SECONDS = 30.0
INCIDENT_SECONDS = 2.0
PLAN = "paper_id long, status string, unsettled long, runs_again boolean"
STATES = "key long, at double, state string, failures int"


def latest_verdicts(log: DataFrame) -> DataFrame:
    """Running latest verdict and attempt count per paper; for update or complete mode."""
    return log.where(F.col("status") != STARTED).groupBy("paper_id").agg(F.max_by("status", "line_no").alias("status"), F.count(F.lit(1)).alias("verdicts"))


def running_plan(log: DataFrame, most: int = MAX_UNSETTLED) -> DataFrame:
    """Each paper's verdict, failures and killed attempts since its last ok, and whether it runs again, after every batch of lines.

    Over a stream of (paper_id long, line_no long, status string) in update mode, as ``ledger.unsettled`` over the whole log:
    a start is killed when another follows it, or nothing yet. Lines of a paper come in the order of ``line_no``, batch by batch.
    """
    import pandas as pd

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, settled, started = state.get if state.exists else (None, 0, False)
        lines = sorted((n, s) for rows in batches for n, s in zip(rows["line_no"], rows["status"]))
        for _, line in lines:
            if line == STARTED:
                settled, started = settled + started, True
                continue
            status, started = line, False
            settled = 0 if line == "ok" else settled + (line == "failed")
        state.update((status, int(settled), started))
        count = int(settled) + started
        yield pd.DataFrame([(key[0], status, count, status != "ok" and count < most)], columns=["paper_id", "status", "unsettled", "runs_again"])

    return log.groupBy("paper_id").applyInPandasWithState(run, PLAN, "status string, settled long, started boolean", "update", "NoTimeout")


def request_windows(log: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str = "10 minutes", most: int = 2) -> DataFrame:
    """Keys with more than ``most`` requests in a sliding window; rows later than ``late`` are dropped with their state."""
    return log.withWatermark("happened", late).groupBy(F.window("happened", width, step), "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)


def dedup_uploads(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first row of each fingerprint within the watermark."""
    return log.withWatermark("happened", late).dropDuplicatesWithinWatermark(["fingerprint"])


def step(state: tuple[str, int, float], at: float, ok: bool, threshold: int = THRESHOLD, reset: float = RESET_SECONDS, within: float = 0.0) -> tuple[str, int, float]:
    """One event of a breaker: closed opens after ``threshold`` failures in a row; after ``reset`` seconds one trial decides.

    The state is its name, the failures and the time of the last counted one. A failure up to ``within`` seconds after that
    belongs to the same incident and is not counted. A trial starts from no failures.
    """
    name, failures, last = state
    if name == "open" and at - last >= reset:
        name, failures = "half_open", 0
    if name == "open":
        return name, failures, last
    if ok:
        return "closed", 0, last
    if not failures or within <= 0 or at - last > within:
        failures, last = failures + 1, at
    return ("open" if name == "half_open" or failures >= threshold else "closed"), failures, last


def breaker(events: DataFrame, within: float = 0.0) -> DataFrame:
    """State changes of each key's breaker over a stream of (key long, at double, ok boolean).

    ``within`` merges failures of one incident, INCIDENT_SECONDS where requests run side by side.
    """
    import pandas as pd

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else ("closed", 0, 0.0)
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        out = []
        for at, ok in zip(rows["at"], rows["ok"]):
            then, now = now, step(now, float(at), bool(ok))
            if now[0] != then[0]:
                out.append((key[0], float(at), now[0], now[1]))
        state.update(now)
        yield pd.DataFrame(out, columns=["key", "at", "state", "failures"])

    return events.groupBy("key").applyInPandasWithState(run, STATES, "state string, failures int, last double", "append", "NoTimeout")
