"""Rolling quality and alerts with a cooldown, as a batch operator and as a stateful stream.

The score of a chunk is the mean of its session's last five values with linearly rising weights.
An alert fires where the score is below the threshold, from the third chunk on, unless the session
fired less than the cooldown ago. The cooldown depends on the alerts before, so it is a fold in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from lectern.streaming.ingest import Idle, with_state_store

WINDOW, LEAST, COOLDOWN_S = 5, 3, 30.0
ALERT = "session long, event long, at double, score double"


def rising(values: list[float]) -> float:
    """Sum with linearly rising weights, added plainly as the batch form does: Python's ``sum`` corrects its rounding since 3.12, and a score at the threshold then falls on the other side."""
    total = 0.0
    for n, value in enumerate(values, 1):
        total += value * n
    return total


def fold(rows: list[tuple[int, float, float]], recent: list[float], seen: int, fired: float | None, threshold: float, cooldown: float) -> tuple[list[tuple[int, float, float]], list[float], int, float | None]:
    """Alerts of (event, at, value) rows in order, and the state after them."""
    out = []
    for event, at, value in rows:
        recent = [*recent, value][-WINDOW:]
        seen += 1
        score = rising(recent) / (len(recent) * (len(recent) + 1) / 2)
        if seen >= LEAST and score < threshold and (fired is None or at - fired >= cooldown):
            fired = at
            out.append((event, at, score))
    return out, recent, seen, fired


def alerts(rows: DataFrame, threshold: float, cooldown: float = COOLDOWN_S) -> DataFrame:
    """Batch form over (session, event, at in seconds, value).

    Score and number of a chunk are window functions; only rows that could fire are folded, in order, batch by
    batch with one state for the session at hand, so no session is held whole.
    """
    order = [F.asc_nulls_last("at"), F.asc_nulls_last("event")]
    own = Window.partitionBy("session").orderBy(*order)
    last = F.collect_list(F.coalesce(F.col("value").cast("double"), F.lit(float("nan")))).over(own.rowsBetween(1 - WINDOW, 0))
    weighted = F.aggregate(F.transform("last", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    n = F.size("last")
    scored = rows.select("session", "event", "at", last.alias("last"), F.row_number().over(own).alias("seen"))
    low = scored.select("session", "event", "at", (weighted / (n * (n + 1) / 2)).alias("score"), "seen").where((F.col("score") < threshold) & (F.col("seen") >= LEAST)).drop("seen")

    def cooled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at_hand, fired = object(), None
        for pdf in batches:
            kept = []
            sessions = pdf["session"].astype(object).where(pdf["session"].notna(), None)
            for session, at in zip(sessions, pdf["at"], strict=True):
                if session != at_hand:
                    at_hand, fired = session, None
                kept.append(fired is None or at - fired >= cooldown)
                fired = at if kept[-1] else fired
            yield pdf[kept]

    return low.repartition("session").sortWithinPartitions("session", *order).mapInPandas(cooled, ALERT)


class Alerter(Idle):
    """The last values of a session in a list; how many there were, and when it last fired, in a value."""

    def __init__(self, threshold: float, cooldown: float, wait_ms: int):
        super().__init__(wait_ms)
        self.threshold, self.cooldown = threshold, cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.recent = handle.getListState("recent", "value double")
        self.past = handle.getValueState("past", "seen long, fired double")

    def clear(self) -> None:
        self.recent.clear()
        self.past.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows)).sort_values(["at", "event"])
        pdf = pdf[pdf["at"] * 1000 > timerValues.getCurrentWatermarkInMs()]
        if pdf.empty:  # all of them too late
            return
        seen, fired = self.past.get() if self.past.exists() else (0, None)
        recent = [v[0] for v in self.recent.get()] if self.recent.exists() else []
        out, recent, seen, fired = fold(list(zip(pdf.event, pdf["at"], pdf.value, strict=True)), recent, seen, fired, self.threshold, self.cooldown)
        self.recent.put([(float(v),) for v in recent])
        self.past.update((int(seen), None if fired is None else float(fired)))
        self.touched(int(pdf["at"].max() * 1000))
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["session", "event", "at", "score"])


def alert_stream(rows: DataFrame, threshold: float, cooldown: float = COOLDOWN_S, idle: str = "24 hours") -> DataFrame:
    """Streaming form: the state of a session is its last values, their count, and its last alert.

    ``at`` is event time: rows later than ``idle`` are dropped, and a timer ends a session's state ``idle`` after its last row.
    """
    with_state_store(rows.sparkSession)
    wait_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    timed = rows.withColumn("event_time", F.timestamp_millis((F.col("at") * 1000).cast("long"))).withWatermark("event_time", idle)
    return timed.groupBy("session").transformWithStateInPandas(Alerter(threshold, cooldown, wait_ms), ALERT, "append", "eventTime")
