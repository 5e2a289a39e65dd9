"""Spaced repetition: the published FSRS-6 formulas of stability, difficulty and recall, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published default parameters, in order.
WEIGHTS = (
    0.212, 1.2931, 2.3065, 8.2956, 6.4133, 0.8334, 3.0194, 0.001, 1.8722, 0.1666, 0.796, 1.4835, 0.0614, 0.2629, 1.6483, 0.6014, 1.8729, 0.5425, 0.0912, 0.0658, 0.1542,
)
#: Recall at which a card is due, and the longest interval in days.
RETENTION, LONGEST = 0.9, 36500
_DECAY = -WEIGHTS[20]
_FACTOR = 0.9 ** (1 / _DECAY) - 1


def retrievability(stability: Column, days: Column) -> Column:
    """The chance of recall after some whole days; 0 for a card never reviewed."""
    return F.when(stability.isNull(), 0.0).otherwise(F.pow(1 + _FACTOR * F.greatest(days, F.lit(0)) / stability, F.lit(_DECAY)))


def _bounded(difficulty: Column) -> Column:
    return F.least(F.greatest(difficulty, F.lit(1.0)), F.lit(10.0))


def _first_difficulty(rating: Column) -> Column:
    return WEIGHTS[4] - F.exp(WEIGHTS[5] * (rating - 1)) + 1


def next_difficulty(difficulty: Column, rating: Column) -> Column:
    """Moves away from 10 the less the nearer it is, and back towards that of an easy first review."""
    moved = difficulty + (10 - difficulty) * (-WEIGHTS[6] * (rating - 3)) / 9
    return _bounded(WEIGHTS[7] * _first_difficulty(F.lit(4)) + (1 - WEIGHTS[7]) * moved)


def next_stability(stability: Column, difficulty: Column, recall: Column, rating: Column, same_day: Column) -> Column:
    """After a review: on the same day by the short-term rule, else grown by recall (2 to 4) or cut by a lapse (1)."""
    w = WEIGHTS
    gain = F.exp(w[17] * (rating - 3 + w[18])) * F.pow(stability, F.lit(-w[19]))
    short = stability * F.when(rating >= 3, F.greatest(gain, F.lit(1.0))).otherwise(gain)
    grown = stability * (1 + F.exp(F.lit(w[8])) * (11 - difficulty) * F.pow(stability, F.lit(-w[9])) * (F.exp((1 - recall) * w[10]) - 1) * F.when(rating == 2, w[15]).otherwise(1.0) * F.when(rating == 4, w[16]).otherwise(1.0))
    long_term = w[11] * F.pow(difficulty, F.lit(-w[12])) * (F.pow(stability + 1, F.lit(w[13])) - 1) * F.exp((1 - recall) * w[14])
    lapsed = F.least(long_term, stability / F.exp(F.lit(w[17] * w[18])))
    return F.greatest(F.when(same_day, short).when(rating == 1, lapsed).otherwise(grown), F.lit(0.001))


def next_interval(stability: Column) -> Column:
    """Whole days until recall falls to ``RETENTION``; 1 to ``LONGEST``."""
    days = F.round(stability / _FACTOR * (RETENTION ** (1 / _DECAY) - 1))
    return F.least(F.greatest(days, F.lit(1.0)), F.lit(float(LONGEST))).cast("long")


def reviewed(stability: Column, difficulty: Column, days: Column, rating: Column) -> Column:
    """Struct (stability, difficulty, recall, interval_days) after a review rated 1 to 4; null state means a first review."""
    first = stability.isNull()
    recall = retrievability(stability, days)
    starts = F.array(*(F.lit(w) for w in WEIGHTS[:4]))
    s = F.when(first, F.element_at(starts, rating.cast("int"))).otherwise(next_stability(stability, difficulty, recall, rating, days < 1))
    d = F.when(first, _bounded(_first_difficulty(rating))).otherwise(next_difficulty(difficulty, rating))
    return F.struct(s.alias("stability"), d.alias("difficulty"), recall.alias("recall"), next_interval(s).alias("interval_days"))
