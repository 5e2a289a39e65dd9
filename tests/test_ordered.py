"""Ordered work over keys that hold most rows, transitions and review logs, against plain loops."""

import itertools
from collections import defaultdict
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import longscan, sequence, states
from lectern.operators.relational import TRANSITIONS
from lectern.operators.replay import replayed

# ---- places, windows, sums and percentiles in blocks


def long_rows(seed=1):
    rng = np.random.default_rng(seed)
    return [(int(k), int(t), None if rng.random() < 0.1 else float(rng.integers(20))) for k, t in zip(rng.choice([1, 1, 1, 1, 2, 3], 400), rng.permutation(400), strict=True)] + [(None, 5, 1.0), (None, 3, 2.0)]


def test_places_and_halos_equal_one_window_a_key(spark):
    rows = long_rows()
    placed = longscan.positioned(spark.createDataFrame(rows, "key long, at long, x double"), "key", "at", most=37).cache()
    by = defaultdict(list)
    for k, t, x in sorted(rows, key=lambda r: r[1]):
        by[k].append((t, x))
    assert {(r["key"], r["at"]): r["position"] for r in placed.collect()} == {(k, t): i for k, own in by.items() for i, (t, _) in enumerate(own)}
    looked = longscan.looking(placed, "key", 3, 2, lambda w: {"before": F.collect_list("at").over(w.rowsBetween(-3, -1)), "after": F.lead("at", 2).over(w)}, length=11)
    for r in looked.collect():
        own = [t for t, _ in by[r["key"]]]
        i = r["position"]
        assert r["before"] == own[max(0, i - 3) : i] and r["after"] == (own[i + 2] if i + 2 < len(own) else None)
    sums = longscan.running_sum(placed, "key", F.coalesce("x", F.lit(0.0)), "upto", length=13)
    for r in sums.collect():
        assert r["upto"] == sum(x or 0 for _, x in by[r["key"]][: r["position"] + 1])
    shares = {r["key"]: r["percentile"] for r in longscan.percentile(placed, "key", "x", 0.3, most=29).collect()}
    assert shares == {k: pytest.approx(np.percentile([x for _, x in own if x is not None], 30)) for k, own in by.items()}
    with pytest.raises(ValueError):
        longscan.with_halo(placed, 12, 0, 11)


def test_no_task_of_a_long_key_holds_it_whole(spark):
    rows = spark.range(3000).select(F.lit(7).alias("key"), F.col("id").alias("at"))
    placed = longscan.positioned(rows, "key", "at", most=100)
    blocks = longscan.with_halo(placed, 5, 5, 100).groupBy("block").count().collect()
    assert len(blocks) == 31 and max(r["count"] for r in blocks) <= 110  # the last one holds halo rows alone


# ---- transitions


def plain_walk(attempts, begins):
    state = {s: dict(status=st, failure_reason=r, failure_stage=g, retry_count=n, last_retry_at=None, notes_ready=True, ok=0, bad=0) for s, st, r, g, n in begins}
    log = []
    for session, at, attempt, to, reason, stage in sorted(attempts, key=lambda a: a[1:3]):
        s = state[session]
        before = s["status"]
        ok = (before, to) in TRANSITIONS
        log.append((session, attempt, before, to if ok else before, ok))
        s["ok" if ok else "bad"] += 1
        if not ok:
            continue
        s["status"] = to
        if to == "failed":
            s |= dict(failure_reason=reason, failure_stage=stage, notes_ready=False)
        elif before == "failed" and to == "processing":
            s |= dict(failure_reason=None, failure_stage=None, retry_count=s["retry_count"] + 1, last_retry_at=at)
        elif to == "complete":
            s |= dict(failure_reason=None, failure_stage=None)
    return log, state


@pytest.mark.parametrize("most", [5, 100_000])
def test_transitions_are_judged_in_order(spark, most):
    rng = np.random.default_rng(9)
    wanted = ["recording", "transcribed", "processing", "complete", "failed", "unheard of"]
    attempts = [(int(rng.choice([1, 1, 1, 2, 3])), int(rng.integers(60)), i, wanted[int(rng.integers(6))], f"r{i}", f"s{i % 3}") for i in range(150)]
    begins = [(1, "created", None, None, 0), (2, "failed", "old", "asr", 2), (3, "processing", None, None, 1), (4, "complete", None, None, 0)]
    a = spark.createDataFrame(attempts, "session long, at long, attempt long, to_status string, reason string, stage string")
    b = spark.createDataFrame([(*r, None, True) for r in begins], "session long, status string, failure_reason string, failure_stage string, retry_count long, last_retry_at long, notes_ready boolean")
    judged = states.apply_transitions(a, b, most=most).cache()
    log, state = plain_walk(attempts, begins)
    assert {tuple(r) for r in judged.select("session", "attempt", "from_status", "status", "accepted").collect()} == set(log)
    for r in states.session_state(judged, b).collect():
        want = state[r["session"]]
        assert {c: r[c] for c in ("status", "failure_reason", "failure_stage", "retry_count", "last_retry_at", "notes_ready")} == {c: want[c] for c in ("status", "failure_reason", "failure_stage", "retry_count", "last_retry_at", "notes_ready")}
        assert (r["n_accepted"], r["n_rejected"]) == (want["ok"], want["bad"])


# ---- review logs

T0 = datetime(2024, 1, 1, tzinfo=UTC)


def test_a_log_goes_through_steps_reviews_and_lapses(spark):
    at = [timedelta(0), timedelta(minutes=1), timedelta(minutes=12), timedelta(days=3), timedelta(days=30), timedelta(days=30, minutes=10), timedelta(days=30, minutes=25), timedelta(days=31)]
    ratings = [1, 2, 3, 3, 1, 2, 3, 4]
    log = [(5, i, T0 + t, g) for i, (t, g) in enumerate(zip(at, ratings, strict=True))]
    odd = [(5, 90, None, 3), (None, 91, T0, 3), (5, 92, T0, 9), (5, 93, T0, None)]
    out = replayed(spark.createDataFrame(log + odd, "card long, review long, at timestamp, rating int")).orderBy("n").collect()
    assert [(r["n"], r["state"], r["step"]) for r in out] == [(1, 1, 0), (2, 1, 0), (3, 1, 1), (4, 2, None), (5, 3, 0), (6, 3, 0), (7, 2, None), (8, 2, None)]
    waits = [r["due"].replace(tzinfo=UTC) - r2[2] for r, r2 in zip(out, log, strict=True)]
    minutes = [w.total_seconds() / 60 for w in waits]
    assert minutes[:3] == [1, 5.5, 10] and minutes[4:6] == [10, 15] and all(m % 1440 == 0 and m >= 1440 for m in (minutes[3], *minutes[6:]))
    assert out[0]["stability"] == pytest.approx(0.212) and out[0]["recall"] == 0 and 1 <= out[0]["difficulty"] <= 10
    assert out[4]["stability"] < out[3]["stability"] < 1000 and 0 < out[4]["recall"] < 1


def test_a_log_does_not_depend_on_batches(spark):
    rng = np.random.default_rng(2)
    log = [(int(c), i, T0 + timedelta(minutes=int(m)), int(g)) for i, (c, m, g) in enumerate(zip(rng.choice([1, 1, 1, 2, 3, 4], 500), rng.integers(0, 200_000, 500), rng.integers(1, 5, 500), strict=True))]
    df = spark.createDataFrame(log, "card long, review long, at timestamp, rating int")
    whole = sorted(map(tuple, replayed(df).collect()), key=lambda r: r[1])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        small = sorted(map(tuple, replayed(df).collect()), key=lambda r: r[1])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert whole == small and len(whole) == 500
    for card, own in itertools.groupby(sorted(whole, key=lambda r: (r[0], r[2])), key=lambda r: r[0]):
        assert [r[2] for r in own] == list(range(1, sum(r[0] == card for r in log) + 1))


# ---- segments of a long session


def test_sequence_operators_on_long_sessions_equal_the_plain_ones(spark):
    rng = np.random.default_rng(3)
    rows = [(int(s), int(i), f"t{i}", rng.normal(size=3).tolist()) for i, s in enumerate(rng.choice([1, 1, 1, 2, 3], 260))]
    df = spark.createDataFrame(rows, "session long, seq long, text string, embedding array<double>")
    got = lambda out: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in out.collect())
    assert got(sequence.long_context_windows(df, 4, most=23).select("session", "seq", "context", "n_context")) == got(sequence.context_windows(df, 4).select("session", "seq", "context", "n_context"))
    assert got(sequence.long_segments(df, most=19).select(*SEGMENT)) == got(sequence.segments(df).select(*SEGMENT))
    assert got(sequence.long_batches(df.select("session", "seq"), 7, most=31)) == got(sequence.batches(df.select("session", "seq"), 7))
    spans = sequence.segments(df)
    assert got(sequence.long_members(df.select("session", "seq"), spans, width=17)) == got(sequence.members(df.select("session", "seq"), spans))


SEGMENT = ("session", "segment", "start_seq", "end_seq", "n", "boundary_score", "confidence")


def test_steps_composed_by_doubling_equal_a_plain_walk():
    rng = np.random.default_rng(2)
    step, first = rng.integers(0, 4, (300, 4)).astype(np.int32), rng.random(300) < 0.05
    begin = np.full(300, 3)
    want, now = [], 2
    for k in range(300):
        now = 3 if first[k] else now
        want.append(now)
        now = int(step[k][now])
    got, carried = [], 2
    for lo in range(0, 300, 70):
        own = slice(lo, lo + 70)
        before, carried = longscan._walked(step[own], begin[own], first[own], carried)
        got += before.tolist()
    assert got == want and carried == now


def test_sessions_are_not_folded_one_python_group_each(spark):
    rows = spark.createDataFrame([(i % 50, i, i, "recording", "r", "s") for i in range(500)], "session long, at long, attempt long, to_status string, reason string, stage string")
    begins = spark.createDataFrame([(i, "created") for i in range(50)], "session long, status string")
    plan = states.apply_transitions(rows, begins)._jdf.queryExecution().optimizedPlan().toString()
    walk = plan[: plan.index("Join")]  # what comes after the blocks of long keys
    assert "MapInArrow" in walk and "FlatMapGroupsInPandas" not in walk


# ---- alerts


def test_scores_at_the_threshold_are_summed_as_the_batch_form_and_sql_sum_them():
    from lectern.streaming.quality import fold

    rng, told = np.random.default_rng(5), []
    for _ in range(2000):  # five values of two decimals whose exact score is the threshold, 25
        cents = [int(x) for x in rng.integers(1, 4000, 4)]
        last, rest = divmod(37500 - sum(c * n for n, c in enumerate(cents, 1)), 5)
        if rest or last < 0:
            continue
        values = [c / 100 for c in (*cents, last)]
        plain = 0.0
        for n, v in enumerate(values, 1):
            plain = plain + v * n
        fired = fold([(0, 0.0, values[-1])], values[:-1], 4, None, 25.0, 30.0)[0]
        assert bool(fired) == (plain / 15 < 25.0)
        told.append((plain / 15 < 25.0, sum(v * n for n, v in enumerate(values, 1)) / 15 < 25.0))
    assert any(plain != corrected for plain, corrected in told)  # the case is there
