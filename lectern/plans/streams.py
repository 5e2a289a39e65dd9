"""The streaming operators over the given tables, as streams of files and in their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.plans.registry import query
from lectern.session import scratch
from lectern.sources.tables import table
from lectern.streaming.ingest import appended, complete_sessions, deduplicated, drained, finalised, streamed
from lectern.streaming.quality import alert_stream, alerts


@query("r1_dedup", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def _(spark, sf_dir):
    """The first event of each key, as a batch: each event once in a table that holds all of them twice."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    twice = events.unionByName(events)
    return twice.groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


# chunk 3 ends a session; some chunks are lost on the way
_CHUNKS = "c AS (SELECT conv_id AS session, turn AS sequence, turn = 3 AS final FROM conversations WHERE (conv_id + turn) % 11 <> 0)"


def _chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("(conv_id + turn) % 11 <> 0")
    return rows.select(F.col("conv_id").alias("session"), F.col("turn").alias("sequence"), (F.col("turn") == 3).alias("final"))


@query("r6_complete_sessions", f"WITH {_CHUNKS} SELECT session, count(DISTINCT sequence) AS n, coalesce(count(DISTINCT sequence) = max(CASE WHEN final THEN sequence END) + 1, false) AS ready FROM c GROUP BY session")
def _(spark, sf_dir):
    return complete_sessions(_chunks(spark, sf_dir))


@query("r6_finalised_stream", f"WITH {_CHUNKS} SELECT session, CAST(4 AS BIGINT) AS n FROM c WHERE sequence <= 3 GROUP BY session HAVING count(*) = 4")
def _(spark, sf_dir):
    """The same as a stream, file by file: a session comes out once, when its last gap is filled."""
    chunks = _chunks(spark, sf_dir).withColumn("received_at", F.timestamp_seconds(1_700_000_000 + F.col("sequence")))
    source = streamed(chunks, scratch(spark, "chunks"), "sequence")
    return appended(finalised(source), scratch(spark, "final"))


@query("r1_stream_dedup", "SELECT user_id, event_type, 1 AS times FROM events GROUP BY user_id, event_type")
def _(spark, sf_dir):
    """Events day by day as a stream, repeats of a key dropped within the horizon across days; a plain sink takes what comes out, so each key counts once."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    source = streamed(events.withColumn("day", F.date_format("ts", "MMdd").cast("int") % 7), scratch(spark, "events"), "day").drop("day")
    out = appended(deduplicated(source, "ts", ["user_id", "event_type"], "60 days"), scratch(spark, "deduped"))
    return out.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("int").alias("times"))


@query("r4_recovered_ingest", "SELECT conv_id, turn, length(text) AS n_chars FROM conversations")
def _(spark, sf_dir):
    """A stream of several batches into a table, and the whole stream again after a crash that lost its offsets: no chunk is there twice."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.char_length("text").cast("long").alias("n_chars"))
    source, sink = streamed(rows, scratch(spark, "turns"), "turn"), scratch(spark, "utterances")
    drained(source, sink, ["conv_id", "turn"])
    return drained(source, sink, ["conv_id", "turn"])


_ALERTS = """WITH RECURSIVE e AS (SELECT user_id AS session, event_id AS event, epoch_us(ts) / 1e6 AS pos, value, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events),
s AS (SELECT a.session, a.event, a.pos, a.k, sum(b.value * (b.k - greatest(a.k - 5, 0))) / sum(b.k - greatest(a.k - 5, 0)) AS score FROM e a JOIN e b ON a.session = b.session AND b.k BETWEEN a.k - 4 AND a.k GROUP BY ALL),
low AS (SELECT session, event, pos, score, row_number() OVER (PARTITION BY session ORDER BY k) AS i FROM s WHERE score < 25 AND k >= 3),
f AS (SELECT session, event, pos, score, i, true AS fires, pos AS fired FROM low WHERE i = 1
UNION ALL SELECT l.session, l.event, l.pos, l.score, l.i, l.pos - f.fired >= 30, CASE WHEN l.pos - f.fired >= 30 THEN l.pos ELSE f.fired END FROM f JOIN low l ON l.session = f.session AND l.i = f.i + 1)
SELECT session, event, round(pos, 6) AS at, round(score, 6) AS score FROM f WHERE fires"""


@query("r8_quality_alerts", _ALERTS)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("event"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at"), "value")
    return alerts(rows.withColumn("at", F.col("at") / 1e6), 25.0).withColumns({c: F.round(c, 6) for c in ("at", "score")})


@query("r7_alert_stream", _ALERTS)
def _(spark, sf_dir):
    """The alerts as a stream of several batches, with state by session carried from one to the next; what comes out is what is counted."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("event"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "value")
    day = rows.withColumn("day", F.floor((F.col("at") - 1704067200) / (86400 * 5)).cast("int"))  # of the tables' month; files come in order of days
    found = appended(alert_stream(streamed(day, scratch(spark, "values"), "day").drop("day"), 25.0, idle="60 days"), scratch(spark, "alerts"))
    return found.withColumns({c: F.round(c, 6) for c in ("at", "score")})


@query("r9_stale_sessions", "SELECT user_id, max(ts) AS last_ts, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 12 HOUR AS stale FROM events GROUP BY user_id")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now"))  # one row
    return e.groupBy("user_id").agg(F.max("ts").alias("last_ts")).join(F.broadcast(now)).select("user_id", "last_ts", (F.col("last_ts") < F.col("now") - F.expr("INTERVAL 12 HOURS")).alias("stale"))


@query("ext_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour")["start"].alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "ext_sessions",
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM s GROUP BY user_id, k",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("first_ts"), "n")
