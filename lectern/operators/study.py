"""Study, votes and verdicts: progress, ensembles, agreement, combined detectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.multiset import f1


def progress(reviews: DataFrame, key: str, rating: Column, order: list[str], recent: int = 20) -> DataFrame:
    """(key, total, correct, accuracy, recent_correct): a rating of 3 or more is correct; recent are the last rows in order."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    ok = rating >= 3
    rows = reviews.select(key, ok.alias("ok"), (last <= recent).alias("recent"))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("correct"), F.avg(F.col("ok").cast("double")).alias("accuracy"), F.count_if(F.col("ok") & F.col("recent")).alias("recent_correct"))


def ensemble(votes: DataFrame, item: str) -> DataFrame:
    """Votes (item, prediction, confidence): more than half wins with its mean confidence, else mixed with a flag."""
    counts = votes.groupBy(item, "prediction").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("c"))
    best = counts.groupBy(item).agg(F.sum("n").alias("total"), F.max_by(F.struct("prediction", "n", "c"), F.struct("n", "prediction")).alias("b"))
    won = F.col("b.n") * 2 > F.col("total")
    return best.select(item, F.when(won, F.col("b.prediction")).otherwise("mixed").alias("final_type"), F.when(won, F.col("b.c")).otherwise(F.lit(0.0)).alias("confidence"), (~won).alias("review"))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two word multisets: 1 where both are empty, 0 where one is."""
    return f1(a, b)


def consensus(a: Column, b: Column, apart: float = 0.3) -> Column:
    """Two readings' confidence: the smaller one and a flag where they differ by ``apart``, else their mean."""
    differ = F.abs(a - b) >= apart
    return F.struct(F.when(differ, F.least(a, b)).otherwise((a + b) / 2).alias("confidence"), differ.alias("disagreement"))


def quality_status(snr: Column, clipping: Column) -> Column:
    """The worse of two severities, signal to noise and clipping."""
    s = F.when(snr < 10, 3).when(snr < 15, 2).when(snr < 20, 1).otherwise(0)
    c = F.when(clipping > 0.05, 3).when(clipping > 0.01, 2).otherwise(0)
    return F.element_at(F.array(*(F.lit(x) for x in ("normal", "degraded", "warning", "critical"))), F.greatest(s, c) + 1)


def verdict(agreement: Column, repeated: Column, silent_share: Column) -> Column:
    """Three detectors on their own: which fired first, and the greatest confidence; null signals never fire."""
    fired = F.filter(
        F.array(
            F.when(F.coalesce(agreement < 0.5, F.lit(False)), F.struct(F.lit("cross_model").alias("reason"), (1 - agreement).alias("c"))),
            F.when(F.coalesce(repeated, F.lit(False)), F.struct(F.lit("repetition").alias("reason"), F.lit(1.0).alias("c"))),
            F.when(F.coalesce(silent_share > 0.5, F.lit(False)), F.struct(F.lit("vad_contradiction").alias("reason"), silent_share.alias("c"))),
        ),
        lambda x: x.isNotNull(),
    )
    return F.struct(F.try_element_at(fired, F.lit(1))["reason"].alias("reason"), F.coalesce(F.array_max(F.transform(fired, lambda x: x["c"])), F.lit(0.0)).alias("confidence"))


def missing(cited: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Cited keys that are not known: with any of these a whole write is refused."""
    return cited.select(key).distinct().join(known.select(key), key, "left_anti")


def renumber(rows: DataFrame, parent: str, title: str, order: str) -> DataFrame:
    """Rows of one parent and title merged (descriptions joined by ``; `` in order) and numbered from 0 in each parent."""
    merged = rows.groupBy(parent, title).agg(F.min(order).alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "description"))), lambda x: x["description"]), "; ").alias("description"))
    return merged.withColumn("ordinal", F.row_number().over(Window.partitionBy(parent).orderBy("at")) - 1).drop("at")


def to_retry(rows: DataFrame, now: DataFrame, most: int = 3, idle: str = "45 minutes") -> DataFrame:
    """Sessions whose notes are to be tried again: (session, retry_count, last_retry_at) after the bookkeeping.

    Transcribed, without notes, tried fewer than ``most`` times, and idle since the last try (or the beginning) for
    ``idle``. ``now`` is one row.
    """
    idle_since = F.coalesce("last_retry_at", "created_at") <= F.col("now") - F.expr(f"INTERVAL {idle}")
    due = rows.join(F.broadcast(now)).where((F.col("status") == "transcribed") & ~F.col("notes_ready") & (F.col("retry_count") < most) & idle_since)
    return due.select("session", (F.col("retry_count") + 1).alias("retry_count"), F.col("now").alias("last_retry_at"))


def reconciled(rows: DataFrame, activity: DataFrame, now: DataFrame, idle: str = "15 minutes") -> DataFrame:
    """Recording sessions idle for too long: (session, status, failure_reason); with utterances they are transcribed, without failed.

    ``activity`` is (session, last_utterance_at); a session without any counts from its beginning. ``now`` is one row.
    """
    joined = rows.where("status = 'recording'").join(activity, "session", "left").join(F.broadcast(now))
    stale = joined.where(F.coalesce("last_utterance_at", "created_at") <= F.col("now") - F.expr(f"INTERVAL {idle}"))
    heard = F.col("last_utterance_at").isNotNull()
    return stale.select("session", F.when(heard, "transcribed").otherwise("failed").alias("status"), F.when(~heard, "no audio was received").alias("failure_reason"))


def popped(queue: DataFrame, key: str, now: DataFrame) -> DataFrame:
    """Of each queue the eligible job that has waited longest; ties take the smaller id. ``now`` is one row."""
    due = queue.join(F.broadcast(now)).where("eligible <= now")
    whole = F.struct(*queue.columns)
    return due.groupBy(key).agg(F.min_by(whole, F.struct("eligible", "event_id")).alias("job")).select("job.*")


def annotator_pairs(votes: DataFrame, item: str) -> DataFrame:
    """(first_annotator, second_annotator, n, same) over the items that both judged."""
    judged = votes.groupBy(item).agg(F.array_sort(F.collect_list(F.struct("annotator", "label"))).alias("v"))
    pairs = F.flatten(F.transform("v", lambda a: F.transform(F.filter("v", lambda b: b["annotator"] > a["annotator"]), lambda b: F.struct(a["annotator"].alias("first_annotator"), b["annotator"].alias("second_annotator"), (a["label"] == b["label"]).alias("same")))))
    return judged.select(F.explode(pairs).alias("p")).groupBy("p.first_annotator", "p.second_annotator").agg(F.count(F.lit(1)).alias("n"), F.count_if("p.same").alias("same"))


def agreement_summary(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, mean, least) of the agreements that are there; nulls are skipped, and all null gives null."""
    return rows.groupBy(key).agg(F.avg(value).alias("mean"), F.min(value).alias("least"))


def passed_cases(cases: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """(key, total, passed, pass_rate): a case passes if all of its checks hold; null fails."""
    ok = reduce(lambda a, b: a & b, (F.coalesce(c, F.lit(False)) for c in checks.values()))
    return cases.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("passed"), (F.count_if(ok) / F.count(F.lit(1))).alias("pass_rate"))


def strict_decisions(payload: Column, expected: Column) -> Column:
    """The decisions of a JSON array, or null where it does not parse, an item is malformed, or their seqs are not those expected."""
    items = F.from_json(payload, DECISIONS)
    fine = F.forall(items, valid_decision) & (F.array_sort(F.array_distinct(F.transform(items, lambda d: d["seq"]))) == F.array_sort(F.array_distinct(expected)))
    return F.when(fine, items)


def lenient_decisions(payload: Column, expected: Column) -> Column:
    """The valid decisions of a JSON array that were asked for, the first of each seq; null where it does not parse."""
    items = F.filter(F.from_json(payload, DECISIONS), lambda d: valid_decision(d) & F.array_contains(expected, d["seq"]))
    bound = F.array(F.struct(items.alias("v"), F.transform(items, lambda d: d["seq"]).alias("s")))  # evaluated once
    return F.element_at(F.transform(bound, lambda b: F.filter(b["v"], lambda d, i: F.array_position(b["s"], d["seq"]) == i + 1)), 1)


#: A decision on one utterance.
DECISIONS = "array<struct<seq:bigint,is_relevant:boolean,confidence:double>>"


def valid_decision(d: Column) -> Column:
    """Whether all fields are there and the confidence lies in [0, 1]."""
    return F.coalesce(d["seq"].isNotNull() & d["is_relevant"].isNotNull() & d["confidence"].between(0, 1), F.lit(False))
