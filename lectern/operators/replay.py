"""Review logs of cards replayed through the scheduler: learning steps in minutes, then intervals in days."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.memory import LONGEST, RETENTION, WEIGHTS

# Steps in minutes of a new card and of a lapsed one; the states' numbers.
LEARNING_STEPS, RELEARNING_STEPS = (1, 10), (10,)
LEARNING, REVIEW, RELEARNING = 1, 2, 3
_DAY = 86_400_000_000
_MINUTE = 60_000_000
_DECAY = -WEIGHTS[20]
_FACTOR = 0.9 ** (1 / _DECAY) - 1
_OUT = "card long, review long, n long, state int, step int, stability double, difficulty double, recall double, due timestamp"


class Cards:
    """The memory of many cards at once: a review of each at a time, in arrays."""

    def __init__(self, n: int):
        self.state, self.step = np.full(n, LEARNING, np.int32), np.zeros(n, np.int32)
        self.s, self.d = np.full(n, np.nan), np.full(n, np.nan)
        self.last = np.full(n, -1, np.int64)
        self.n = np.zeros(n, np.int64)

    def carry(self, other: Cards, at: int) -> None:
        """Card 0 goes on from another's card ``at``."""
        for name in ("state", "step", "s", "d", "last", "n"):
            getattr(self, name)[0] = getattr(other, name)[at]

    def review(self, at: np.ndarray, when: np.ndarray, rating: np.ndarray) -> tuple[np.ndarray, ...]:
        """One review of each of the cards ``at``: (n, state, step, stability, difficulty, recall before it, due)."""
        w = WEIGHTS
        s, d, state, step, g = self.s[at], self.d[at], self.state[at], self.step[at], rating.astype(np.float64)
        new = np.isnan(s)
        days = np.where(self.last[at] >= 0, (when - self.last[at]) // _DAY, 0)
        with np.errstate(invalid="ignore", divide="ignore"):
            recall = np.where(new, 0.0, (1 + _FACTOR * np.maximum(days, 0) / s) ** _DECAY)
            gain = np.exp(w[17] * (g - 3 + w[18])) * s ** -w[19]
            short = s * np.where(g >= 3, np.maximum(gain, 1.0), gain)
            grown = s * (1 + np.exp(w[8]) * (11 - d) * s ** -w[9] * (np.exp((1 - recall) * w[10]) - 1) * np.where(g == 2, w[15], 1.0) * np.where(g == 4, w[16], 1.0))
            lapsed = np.minimum(w[11] * d ** -w[12] * ((s + 1) ** w[13] - 1) * np.exp((1 - recall) * w[14]), s / np.exp(w[17] * w[18]))
            again = np.maximum(np.where(days < 1, short, np.where(g == 1, lapsed, grown)), 0.001)
            moved = d + (10 - d) * (-w[6] * (g - 3)) / 9
            turned = w[7] * (w[4] - np.exp(w[5] * 3) + 1) + (1 - w[7]) * moved
        s = np.where(new, np.array(w[:4])[rating - 1], again)
        d = np.clip(np.where(new, w[4] - np.exp(w[5] * (g - 1)) + 1, turned), 1.0, 10.0)
        interval = np.clip(np.round(s / _FACTOR * (RETENTION ** (1 / _DECAY) - 1)), 1, LONGEST) * _DAY
        for kind, steps in ((LEARNING, LEARNING_STEPS), (RELEARNING, RELEARNING_STEPS)):
            own = state == kind
            minutes = np.array([*steps, 0], np.float64)
            where = np.minimum(step, len(steps))
            hard = np.where(where == 0, steps[0] * 1.5 if len(steps) == 1 else (steps[0] + steps[1]) / 2, minutes[where])
            out = own & ((rating == 4) | ((rating == 3) & (step + 1 >= len(steps))) | ((rating > 1) & (step >= len(steps))))
            stays = own & ~out
            step = np.where(stays, np.where(rating == 1, 0, np.where(rating == 3, step + 1, step)), step).astype(np.int32)
            wait = np.where(rating == 1, steps[0], np.where(rating == 2, hard, minutes[np.minimum(step, len(steps))]))
            interval = np.where(stays, wait * _MINUTE, interval)
            step = np.where(out, -1, step).astype(np.int32)
            state = np.where(out, 9, state)  # moves on to review below, once both kinds are through
        fell = (state == REVIEW) & (rating == 1)
        interval = np.where(fell, RELEARNING_STEPS[0] * _MINUTE, interval)
        state = np.where(fell, RELEARNING, np.where(state == 9, REVIEW, state)).astype(np.int32)
        step = np.where(fell, 0, step).astype(np.int32)
        self.state[at], self.step[at], self.s[at], self.d[at], self.last[at] = state, step, s, d, when
        self.n[at] += 1
        return self.n[at], state, step, s, d, recall, when + interval.astype(np.int64)


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reviews sorted by card and time: the k-th review of all cards of a batch at once; the last card goes on in the next batch."""
    held, held_card = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        card, rating = np.asarray(batch.column("card")), np.asarray(batch.column("rating")).astype(np.int64)
        when = np.asarray(batch.column("at").cast(pa.int64()))
        first = np.flatnonzero(np.append(True, card[1:] != card[:-1]))
        owner = np.cumsum(np.append(False, card[1:] != card[:-1]))
        turn = np.arange(len(card)) - first[owner]
        cards = Cards(len(first))
        if held is not None and held_card == card[0]:
            cards.carry(held, len(held.n) - 1)
        out = [np.zeros(len(card), t) for t in (np.int64, np.int32, np.int32, float, float, float, np.int64)]
        order = np.argsort(turn, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(turn[order])) + 1):
            for column, values in zip(out, cards.review(owner[rows], when[rows], rating[rows]), strict=True):
                column[rows] = values
        held, held_card = cards, card[-1]
        step = pa.array(out[2], mask=out[2] < 0)
        yield pa.record_batch([batch.column("card"), batch.column("review"), pa.array(out[0]), pa.array(out[1]), step, *(pa.array(c) for c in out[3:6]), pa.array(out[6]).cast(pa.timestamp("us", "UTC"))], [f.split()[0] for f in _OUT.split(", ")])


def replayed(reviews: DataFrame) -> DataFrame:
    """A card's memory after each of its reviews (card, review, at, rating): (card, review, n, state, step, stability, difficulty, recall, due).

    A new card goes through ``LEARNING_STEPS``: again begins anew, hard waits between the steps, good goes on, easy ends them. Then it
    is due by its stability in days; a lapse leads through ``RELEARNING_STEPS``. Reviews less than a day apart take the
    short-term rule. ``step`` is null in review; ``recall`` is the chance of recall just before the review (0 for a new card). Reviews with a null card,
    time or rating, or one outside 1 to 4, are left out; ties of time go by ``review``. Cards are sorted, not gathered, so a log of any length streams through.
    """
    kept = reviews.select(F.col("card").cast("long").alias("card"), F.col("review").cast("long").alias("review"), F.col("at").cast("timestamp").alias("at"), F.col("rating").cast("int").alias("rating"))
    kept = kept.where("card IS NOT NULL AND at IS NOT NULL AND rating BETWEEN 1 AND 4")
    return kept.repartition("card").sortWithinPartitions("card", "at", "review").mapInArrow(_replay, _OUT)
