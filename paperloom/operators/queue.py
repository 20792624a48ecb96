"""The durable queue as table operators: claim, heartbeat, reap, requeue, failure classes, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.identity import backoff_seconds

# Fixed values.
LEASE_SECONDS, HEARTBEAT_SECONDS = 90, 30
TRANSITIONS = {
    "queued": ("running", "cancelled"),
    "running": ("succeeded", "partial", "failed", "waiting_review", "retry_wait", "cancelled"),
    "retry_wait": ("queued", "cancelled"),
    "waiting_review": ("running", "cancelled"),
}


def legal(from_state: Column, to_state: Column) -> Column:
    out = F.lit(False)
    for a, targets in TRANSITIONS.items():
        out = out | ((from_state == a) & to_state.isin(*targets))
    return F.coalesce(out, F.lit(False))


def claim(jobs: DataFrame, workers: int, now: Column) -> DataFrame:
    """The oldest available queued jobs, one for each worker, with their new lease. The limit is the number of workers."""
    ready = jobs.filter((F.col("state") == "queued") & (F.col("available_at") <= now)).orderBy("available_at", "job_id").limit(workers)
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("available_at", "job_id"))
    return ready.withColumns({"worker": n, "state": F.lit("running"), "attempt": F.col("attempt") + 1, "lease_until": now + F.expr(f"INTERVAL {LEASE_SECONDS} SECONDS")})


def fenced(jobs: DataFrame, token: Column, now: Column) -> DataFrame:
    """Jobs whose holder's token is current and whose lease is alive."""
    return jobs.filter((F.col("lease_token") == token) & (F.col("lease_until") > now))


def reap(jobs: DataFrame, now: Column) -> DataFrame:
    """Expired leases fail at their last attempt, else wait for a retry."""
    expired = (F.col("state") == "running") & (F.col("lease_until") <= now)
    last = F.col("attempt") >= F.col("max_attempts")
    wait = F.timestamp_seconds(F.unix_seconds(now) + backoff_seconds(F.col("attempt")))
    return jobs.withColumns({
        "state": F.when(expired & last, "failed").when(expired, "retry_wait").otherwise(F.col("state")),
        "available_at": F.when(expired & ~last, wait).otherwise(F.col("available_at")),
    })


def requeue_due(jobs: DataFrame, now: Column) -> DataFrame:
    due = (F.col("state") == "retry_wait") & (F.col("available_at") <= now)
    return jobs.withColumn("state", F.when(due, "queued").otherwise(F.col("state")))


def after_failure(kind: Column, attempt: Column, retry_after: Column) -> tuple[Column, Column]:
    """(next state, delay in seconds) of a failure class; an unknown class fails."""
    again = ((kind == "transient") & (attempt < 5)) | ((kind == "parser_error") & (attempt < 2))
    state = F.when(again, "retry_wait").when(kind == "cancelled", "cancelled").when(kind.isin("schema_output", "validation_failed"), "running").otherwise("failed")
    delay = F.when(again, F.when(kind == "parser_error", 30).otherwise(F.coalesce(retry_after, backoff_seconds(attempt))))
    return state, delay.cast("long")


def events_after(log: DataFrame, job_id: str, cursor: int, batch: int = 100) -> DataFrame:
    """The next events of one job after the cursor, a batch at most; a cursor before the log's start fails."""
    rows = log.filter(F.col("job_id") == job_id)
    guard = rows.agg(F.min("seq").alias("first"))
    checked = rows.join(F.broadcast(guard)).filter((F.col("seq") > cursor) & F.assert_true(F.lit(cursor) >= F.col("first") - 1, "the cursor is older than the log").isNull())
    return checked.drop("first").orderBy("seq").limit(batch)


def sliding_failures(rows: DataFrame, key: str, ts: str, minutes: int = 15) -> DataFrame:
    """Adds failures of the key in the last minutes, this one included."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-(minutes * 60_000_000 - 1), 0)
    return rows.withColumn("failures", F.count("*").over(w))
