"""Sessions go through their states in order: each attempt is judged against the last accepted state, and bookkeeping follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.longscan import RANGE, folded, positioned
from lectern.operators.relational import TRANSITIONS

STATES = ("created", "recording", "transcribed", "processing", "complete", "failed")


def _next_states(to_status: Column) -> Column:
    """For each state by number, the state after an attempt: the wanted one where the step is legal, else the same."""
    at = {name: k for k, name in enumerate(STATES)}

    def after(before: str) -> Column:
        allowed = [b for a, b in TRANSITIONS if a == before]
        out = F.lit(at[before])
        for b in allowed:
            out = F.when(to_status == b, at[b]).otherwise(out)
        return out.cast("int")

    return F.array(*(after(s) for s in STATES))


def apply_transitions(attempts: DataFrame, sessions: DataFrame, most: int = RANGE) -> DataFrame:
    """Every attempt (session, at, attempt, to_status, reason, stage) with its verdict: adds position, from_status, accepted, status.

    Attempts of a session are taken in order of ``at`` and ``attempt``; a rejected one changes nothing. ``sessions`` gives the
    status each session begins with (created where it has no row, or an unknown one). A session of very many attempts is folded
    in blocks, each for every state it could begin in, and the blocks are chained.
    """
    numbers = F.create_map(*(x for k, s in enumerate(STATES) for x in (F.lit(s), F.lit(k))))
    begins = sessions.select(F.col("session"), F.coalesce(F.element_at(numbers, F.col("status")), F.lit(0)).cast("int").alias("begin"))
    placed = positioned(attempts, "session", "at", "attempt", most=most).join(begins, "session", "left")
    walked = folded(placed, "session", len(STATES), _next_states(F.col("to_status")), F.coalesce("begin", F.lit(0)), most).drop("begin")
    names = F.array(*(F.lit(s) for s in STATES))
    after = F.get(_next_states(F.col("to_status")), F.col("state_before"))
    judged = walked.withColumn("from_status", F.get(names, F.col("state_before"))).withColumn("status", F.get(names, after))
    return judged.withColumn("accepted", after != F.col("state_before")).drop("state_before")


def session_state(judged: DataFrame, sessions: DataFrame, most: int = RANGE) -> DataFrame:
    """Sessions after all attempts: (session, status, failure_reason, failure_stage, retry_count, last_retry_at, notes_ready, n_accepted, n_rejected).

    A failure keeps its reason and stage and withdraws the notes; a retry (failed to processing) counts, keeps its time and
    clears the failure; completion clears it too.
    """
    ok = F.col("accepted")
    fails = ok & (F.col("status") == "failed")
    retry = ok & (F.col("from_status") == "failed") & (F.col("status") == "processing")
    clears = retry | (ok & (F.col("status") == "complete"))
    told = judged.groupBy("session").agg(
        F.max_by(F.when(ok, F.col("status")), F.when(ok, F.col("position"))).alias("last_status"),
        F.max(F.when(fails, F.col("position"))).alias("failed_at"),
        F.max(F.when(clears, F.col("position"))).alias("cleared_at"),
        F.max_by(F.when(fails, F.struct("reason", "stage")), F.when(fails, F.col("position"))).alias("failure"),
        F.count_if(retry).alias("retries"),
        F.max_by(F.when(retry, F.col("at")), F.when(retry, F.col("position"))).alias("retried_at"),
        F.count_if(ok).alias("n_accepted"),
        F.count_if(~ok).alias("n_rejected"),
    )
    both = sessions.join(told, "session", "left")
    newly = F.col("failed_at").isNotNull() & (F.col("cleared_at").isNull() | (F.col("failed_at") > F.col("cleared_at")))
    cleared = F.col("cleared_at").isNotNull()
    kept = lambda c, part: F.when(newly, F.col(f"failure.{part}")).when(~cleared, F.col(c)).alias(c)
    return both.select(
        "session",
        F.coalesce("last_status", "status").alias("status"),
        kept("failure_reason", "reason"),
        kept("failure_stage", "stage"),
        (F.coalesce("retry_count", F.lit(0)) + F.coalesce("retries", F.lit(0))).alias("retry_count"),
        F.coalesce("retried_at", "last_retry_at").alias("last_retry_at"),
        (F.coalesce("notes_ready", F.lit(False)) & F.col("failed_at").isNull()).alias("notes_ready"),
        F.coalesce("n_accepted", F.lit(0)).alias("n_accepted"),
        F.coalesce("n_rejected", F.lit(0)).alias("n_rejected"),
    )
