"""Ordered application of what happens: attempts to move a session on, and reviews of cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import api
from lectern.functions.memory import LONGEST, WEIGHTS
from lectern.operators import states
from lectern.operators.relational import TRANSITIONS
from lectern.operators.replay import replayed
from lectern.plans.registry import query
from lectern.sources.tables import table

_LEGAL = ", ".join(str(pair) for pair in TRANSITIONS)
# Each event is an attempt of its user's session; every fifth session begins failed.
_WALK = f"""WITH RECURSIVE a AS (
  SELECT user_id AS session, event_id AS attempt, ts AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, 'reason ' || event_id % 3 AS reason, 'stage ' || event_id % 4 AS stage,
    CASE event_type WHEN 'view' THEN 'recording' WHEN 'click' THEN 'transcribed' WHEN 'signup' THEN 'processing' WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'complete' ELSE 'processing' END ELSE 'failed' END AS wanted
  FROM events
), b AS (
  SELECT DISTINCT user_id AS session, CASE WHEN user_id % 5 = 0 THEN 'failed' ELSE 'created' END AS status, CASE WHEN user_id % 5 = 0 THEN 'at first' END AS reason, CAST(user_id % 2 AS BIGINT) AS retries FROM events
), w AS (
  SELECT session, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS attempt, CAST(NULL AS VARCHAR) AS from_status, status, false AS accepted, reason AS failure_reason, reason AS failure_stage, retries, CAST(NULL AS TIMESTAMP) AS retried_at, true AS notes_ready,
    CAST(0 AS BIGINT) AS n_accepted, CAST(0 AS BIGINT) AS n_rejected FROM b
  UNION ALL
  SELECT session, k, attempt, before, CASE WHEN ok THEN wanted ELSE before END, ok, CASE WHEN ok AND wanted = 'failed' THEN reason WHEN again OR (ok AND wanted = 'complete') THEN NULL ELSE failure_reason END,
    CASE WHEN ok AND wanted = 'failed' THEN stage WHEN again OR (ok AND wanted = 'complete') THEN NULL ELSE failure_stage END, retries + CAST(again AS BIGINT), CASE WHEN again THEN t ELSE retried_at END,
    notes_ready AND NOT (ok AND wanted = 'failed'), n_accepted + CAST(ok AS BIGINT), n_rejected + CAST(NOT ok AS BIGINT)
  FROM (SELECT a.*, w.status AS before, (w.status, a.wanted) IN ({_LEGAL}) AS ok, w.status = 'failed' AND a.wanted = 'processing' AS again, w.failure_reason, w.failure_stage, w.retries, w.retried_at, w.notes_ready, w.n_accepted, w.n_rejected
        FROM w JOIN a ON a.session = w.session AND a.k = w.k + 1)
)"""


def _attempts(spark, sf_dir):
    e, kind = table(spark, sf_dir, "events"), F.col("event_type")
    wanted = F.when(kind == "view", "recording").when(kind == "click", "transcribed").when(kind == "signup", "processing").when(kind == "purchase", F.when(F.col("event_id") % 3 == 0, "complete").otherwise("processing")).otherwise("failed")
    attempts = e.select(F.col("user_id").alias("session"), F.col("event_id").alias("attempt"), F.col("ts").alias("at"), wanted.alias("to_status"), F.concat(F.lit("reason "), F.col("event_id") % 3).alias("reason"), F.concat(F.lit("stage "), F.col("event_id") % 4).alias("stage"))
    failed = F.col("session") % 5 == 0
    reason = F.when(failed, "at first")
    begins = attempts.select("session").distinct().select(
        "session", F.when(failed, "failed").otherwise("created").alias("status"), reason.alias("failure_reason"), reason.alias("failure_stage"), (F.col("session") % 2).alias("retry_count"), F.lit(None).cast("timestamp_ntz").alias("last_retry_at"), F.lit(True).alias("notes_ready")
    )
    return attempts, begins


@query("r12_applied_transitions", f"{_WALK} SELECT session, attempt, CAST(k - 1 AS BIGINT) AS position, from_status, status, accepted FROM w WHERE k > 0")
def _(spark, sf_dir):
    """Every attempt judged against the last accepted state of its session."""
    return states.apply_transitions(*_attempts(spark, sf_dir)).select("session", "attempt", "position", "from_status", "status", "accepted")


@query("r12_session_state", f"{_WALK} SELECT session, status, failure_reason, failure_stage, retries AS retry_count, retried_at AS last_retry_at, notes_ready, n_accepted, n_rejected FROM w QUALIFY row_number() OVER (PARTITION BY session ORDER BY k DESC) = 1")
def _(spark, sf_dir):
    """Sessions after all attempts, with failure, retries and counts."""
    attempts, begins = _attempts(spark, sf_dir)
    return states.session_state(states.apply_transitions(attempts, begins), begins)


_W = WEIGHTS
_FACTOR = 0.9 ** (-1 / _W[20]) - 1
_DAYS = f"least({LONGEST}, greatest(1, round_even(s / {_FACTOR!r} * {0.9 ** (-1 / _W[20]) - 1!r}, 0)))"
# A review at a time: memory by days since the last one, then the step or the interval.
_REPLAY = f"""WITH RECURSIVE v AS (
  SELECT user_id AS card, event_id AS review, ts AS t, CAST(1 + (event_id * 7 + user_id) % 4 AS INT) AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events
), r AS (
  SELECT DISTINCT user_id AS card, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS review, CAST(NULL AS TIMESTAMP) AS t, 1 AS state, 0 AS step, CAST(NULL AS DOUBLE) AS s, CAST(NULL AS DOUBLE) AS d, CAST(0 AS DOUBLE) AS recall, CAST(NULL AS TIMESTAMP) AS due FROM events
  UNION ALL
  SELECT card, k, review, t, CASE WHEN leaves THEN 2 WHEN state = 2 AND g = 1 THEN 3 ELSE state END, CASE WHEN leaves THEN NULL WHEN state = 2 THEN CASE WHEN g = 1 THEN 0 END WHEN g = 1 THEN 0 WHEN g = 3 THEN step + 1 ELSE step END, s, d, recall,
    t + to_microseconds(CAST(CASE WHEN leaves OR (state = 2 AND g > 1) THEN {_DAYS} * 86400e6 WHEN state = 2 OR (state = 3 AND g = 1) THEN 600e6 WHEN state = 3 THEN 900e6 WHEN g = 1 THEN 60e6 WHEN g = 3 THEN 600e6 WHEN step = 0 THEN 330e6 ELSE 600e6 END AS BIGINT))
  FROM (
    SELECT card, k, review, t, g, state, step, recall, state <> 2 AND (g = 4 OR (g = 3 AND step + 1 >= CASE state WHEN 1 THEN 2 ELSE 1 END)) AS leaves,
      CASE WHEN s IS NULL THEN [{", ".join(map(str, _W[:4]))}][g] ELSE greatest(0.001, CASE
        WHEN days < 1 THEN s * CASE WHEN g >= 3 THEN greatest(1.0, exp({_W[17]} * (g - 3 + {_W[18]})) * pow(s, -{_W[19]})) ELSE exp({_W[17]} * (g - 3 + {_W[18]})) * pow(s, -{_W[19]}) END
        WHEN g = 1 THEN least({_W[11]} * pow(d, -{_W[12]}) * (pow(s + 1, {_W[13]}) - 1) * exp((1 - recall) * {_W[14]}), s / exp({_W[17] * _W[18]!r}))
        ELSE s * (1 + exp({_W[8]}) * (11 - d) * pow(s, -{_W[9]}) * (exp((1 - recall) * {_W[10]}) - 1) * CASE g WHEN 2 THEN {_W[15]} WHEN 4 THEN {_W[16]} ELSE 1.0 END) END) END AS s,
      least(10.0, greatest(1.0, CASE WHEN s IS NULL THEN {_W[4]} - exp({_W[5]} * (g - 1)) + 1 ELSE {_W[7]} * ({_W[4]} - exp({_W[5]} * 3) + 1) + {1 - _W[7]!r} * (d + (10 - d) * (-{_W[6]} * (g - 3)) / 9) END)) AS d
    FROM (SELECT v.*, r.state, r.step, r.s, r.d, days, CASE WHEN r.s IS NULL THEN 0 ELSE pow(1 + {_FACTOR!r} * days / r.s, -{_W[20]}) END AS recall
          FROM r JOIN v ON v.card = r.card AND v.k = r.k + 1, LATERAL (SELECT coalesce(floor((epoch_us(v.t) - epoch_us(r.t)) / 86400000000), 0) AS days)))
)"""


@query("f34_replayed_logs", f"{_REPLAY} SELECT card, review, k AS n, state, step, round(s, 6) AS stability, round(d, 6) AS difficulty, round(recall, 6) AS recall, due FROM r WHERE k > 0")
def _(spark, sf_dir):
    """The log of every card replayed: learning steps, reviews, lapses and relearning, with the state after each review."""
    rating = 1 + (F.col("event_id") * 7 + F.col("user_id")) % 4
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("card"), F.col("event_id").alias("review"), F.col("ts").alias("at"), rating.alias("rating"))
    out = replayed(log).withColumns({c: F.round(c, 6) for c in ("stability", "difficulty", "recall")})
    return out.withColumn("due", F.col("due").cast("timestamp_ntz"))


@query("q_review", f"{_REPLAY} SELECT card, review, k AS n, state, step, round(s, 6) AS stability, round(d, 6) AS difficulty, due FROM r WHERE k > 0 QUALIFY row_number() OVER (PARTITION BY card ORDER BY k DESC) = 1")
def _(spark, sf_dir):
    """Each card's last review on top of its log before: the state that it leaves."""
    rating = 1 + (F.col("event_id") * 7 + F.col("user_id")) % 4
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("card"), F.col("event_id").alias("review"), F.col("ts").alias("at"), rating.alias("rating"))
    newest = log.groupBy("card").agg(F.max_by("review", F.struct("at", "review")).alias("review"))
    out = api.review(log.join(newest, ["card", "review"], "left_anti"), log.join(newest, ["card", "review"], "left_semi")).drop("recall")
    return out.withColumns({c: F.round(c, 6) for c in ("stability", "difficulty")}).withColumn("due", F.col("due").cast("timestamp_ntz"))
