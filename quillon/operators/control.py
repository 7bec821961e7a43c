"""Decisions over job and workspace snapshots: claims, recovery, gates, invariants, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import labels
from quillon.operators.ranges import lagged

# Allowed changes of a job's state.
ALLOWED = (("QUEUED", "CLAIMED"), ("CLAIMED", "RUNNING"), ("RUNNING", "COMPLETED"), ("RUNNING", "FAILED"), ("FAILED", "RETRYING"), ("RETRYING", "QUEUED"), ("QUEUED", "CANCELLED"))

# Fixed value: refresh failures in a row from which a workspace may not sync.
REFRESH_FAILURES = 5


def active(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin("CLAIMED", "RUNNING"))


def claim(jobs: DataFrame, now: str, limit: int) -> DataFrame:
    """The next job, if any. The running jobs are counted by workspace before the join; the order needs the first row only."""
    running = jobs.where("status = 'RUNNING'").groupBy("workspace_id").agg(F.count(F.lit(1)).alias("running"))
    due = jobs.where((F.col("status") == "QUEUED") & (F.col("scheduled_at") <= F.lit(now).cast("timestamp")))
    return due.join(running, "workspace_id", "left").where(F.coalesce("running", F.lit(0)) < limit).orderBy("priority", "scheduled_at", "job_id").limit(1)


def stale(jobs: DataFrame, now: str, minutes: int = 5) -> DataFrame:
    old = F.col("heartbeat_at") < F.lit(now).cast("timestamp") - F.expr(f"interval {minutes} minutes")
    return active(jobs).where(old).select("job_id", F.when(F.col("retry_count") < F.col("max_retries"), "requeue").otherwise("fail").alias("action"))


def violations(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    running = jobs.where("status = 'RUNNING'").groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("single_running").alias("invariant"), F.col("workspace_id").alias("subject"))
    spent = jobs.where("retry_count >= max_retries and status = 'QUEUED'").select(F.lit("retries").alias("invariant"), F.col("job_id").cast("string").alias("subject"))
    low = outcomes.where("match_type = 'auto' and match_confidence < 85").select(F.lit("auto_threshold").alias("invariant"), F.col("processor_payment_id").alias("subject"))
    return running.unionByName(spent).unionByName(low)


def gates(jobs: DataFrame, now: str) -> DataFrame:
    """Per workspace the first gate closed, health and terminal state, from one aggregate."""
    n = lambda s: F.count_if(F.col("status") == s)
    s = jobs.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("total"), n("COMPLETED").alias("success"), n("FAILED").alias("failures"), n("RUNNING").alias("running"), F.max("heartbeat_at").alias("last_at"), F.max(F.when(F.col("status") == "COMPLETED", F.col("heartbeat_at"))).alias("last_ok"))
    at = F.lit(now).cast("timestamp")
    # The aggregate stands for a snapshot of the workspace: its gates are tried in the fixed order.
    s = s.withColumns({
        "licence": F.lit("active"), "licence_ends": at + F.expr("interval 1 day"), "credentials": F.col("success") > 0, "refresh_failures": F.col("failures") % 9,
        "state": F.when(F.col("running") % 4 == 0, "running").otherwise("ready"), "active_jobs": (F.col("running") % 5 == 0).cast("int"), "cooldown_until": F.col("last_at"),
    })
    gate = first_gate(at)
    health = labels.health(F.col("total"), F.col("success"), F.col("last_ok") < at - F.expr("interval 24 hours"), F.col("failures") % 4)
    return s.select("workspace_id", gate.alias("gate"), health.alias("health"), labels.terminal_state(F.col("success"), F.col("failures"), F.col("running"), F.lit(0)).alias("terminal"))


def first_gate(now: Column) -> Column:
    """The first closed gate of a workspace row (licence, licence_ends, credentials, refresh_failures, state, active_jobs, cooldown_until), in their fixed order."""
    c = F.col
    return (
        F.when(c("licence") != "active", "licence_status").when(c("licence_ends") <= now, "licence_expired").when(~c("credentials"), "no_credentials")
        .when(c("refresh_failures") >= REFRESH_FAILURES, "refresh_failures").when(c("state") == "running", "running").when(c("active_jobs") > 0, "active_jobs")
        .when(c("cooldown_until") > now, "cooldown").when(c("state") == "gated", "gated").otherwise("open")
    )


def after_run(status: Column, error: Column) -> Column:
    """A workspace's state after a run that ended so, with an error of that class."""
    return F.when(status == "COMPLETED", "cooldown").when((status == "FAILED") & error.isin("authorization", "configuration"), "gated").otherwise("ready")


def transitions(jobs: DataFrame) -> DataFrame:
    """Changes from a workspace's job to its next that the table of states doesn't allow."""
    pair = F.concat_ws(">", "previous", "status")
    return lagged(jobs, ["workspace_id"], ["scheduled_at", "job_id"], "status", "previous").where(F.col("previous").isNotNull() & ~pair.isin(*[f"{a}>{b}" for a, b in ALLOWED])).select("job_id", "previous", "status")
