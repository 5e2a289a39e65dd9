"""Small scalar rules: intervals, hashes, scores, cadences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of two intervals over their union; 0 where the union is empty."""
    both = overlap(a0, a1, b0, b1)
    union = (a1 - a0) + (b1 - b0) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def midpoint(a: Column, b: Column) -> Column:
    """Half way between two whole numbers, rounded down."""
    return F.floor((a + b) / 2)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit values."""
    return F.bit_count(a.bitwiseXOR(b))


def speaker_tag(index: Column) -> Column:
    """0 to 4 as SPK_A to SPK_E, else UNKNOWN."""
    return F.when(index.between(0, 4), F.concat(F.lit("SPK_"), F.chr(index + 65))).otherwise(F.lit("UNKNOWN"))


def confidence(average_log_probability: Column) -> Column:
    return F.least(F.greatest(F.exp(average_log_probability), F.lit(0.0)), F.lit(1.0))


def backoff_seconds(attempt: Column, base: int = 60) -> Column:
    return F.lit(base) * F.pow(F.lit(2), attempt)


def early_then_tens(n: Column) -> Column:
    """Recluster on even counts up to 5, then on every tenth."""
    return F.when(n <= 5, n % 2 == 0).otherwise(n % 10 == 0)


def early_then_fives(n: Column) -> Column:
    """Recluster on counts of 2 to 5, then five apart."""
    return F.when(n.between(2, 5), F.lit(True)).otherwise((n > 5) & ((n - 5) % 5 == 0))


def in_band(x: Column, low: float, high: float) -> Column:
    """Whether x lies in the band; null is outside, and so is all if the band is empty."""
    return F.coalesce(x.between(low, high), F.lit(False))


def weighted_geometric_mean(terms: Column, weights: dict[str, float]) -> Column:
    """Of the terms present in a map, by weight; any term of 0 or less gives 0."""
    names = F.array(*(F.lit(k) for k in weights))
    table = F.create_map(*(x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))))
    present = F.filter(names, lambda k: F.element_at(terms, k).isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda s, k: s + F.element_at(table, k))
    logs = F.aggregate(present, F.lit(0.0), lambda s, k: s + F.element_at(table, k) * F.ln(F.element_at(terms, k)))
    dead = F.exists(present, lambda k: F.element_at(terms, k) <= 0)
    return F.when(dead | (total == 0), F.lit(0.0)).otherwise(F.exp(logs / total))


def chunk_of(seq: Column) -> Column:
    """The chunk of a sequence number: thousands."""
    return F.floor(seq / 1000)


def composite(similarity: Column, alignment: Column) -> Column:
    """Half text similarity, half alignment."""
    return 0.5 * similarity + 0.5 * alignment


def overall_quality(snr: Column, clipping: Column, critical: float = 10.0, ceiling: float = 30.0, clipped: float = 0.05, digits: int = 4) -> Column:
    """0 to 1: signal to noise between critical and ceiling for 0.7, freedom from clipping for 0.3, rounded."""
    signal = F.least(F.greatest((snr - critical) / (ceiling - critical), F.lit(0.0)), F.lit(1.0))
    clean = 1 - F.least(clipping / max(clipped * 2, 1e-6), F.lit(1.0))
    return F.round(0.7 * signal + 0.3 * clean, digits)


def speech_ratio(regions: Column, duration_ms: Column) -> Column:
    """Summed length of the speech regions over the duration, 1 at most; overlaps count twice."""
    total = F.aggregate(regions, F.lit(0).cast("bigint"), lambda a, r: a + r["end_ms"] - r["start_ms"])
    return F.when(duration_ms > 0, F.least(total / duration_ms, F.lit(1.0))).otherwise(F.lit(0.0))


def rms_db(samples: Column) -> Column:
    """Root mean square of samples in [-1, 1] in dB of full scale: -120 for silence, minus infinity without samples."""
    mean = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x * x) / F.size(samples)
    return F.when(F.size(samples) == 0, float("-inf")).when(mean <= 0, -120.0).otherwise(10 * F.log10(mean))


def clipping_rate(samples: Column, peak: float = 0.999) -> Column:
    """Share of samples at or above full scale."""
    return F.when(F.size(samples) > 0, F.size(F.filter(samples, lambda x: F.abs(x) >= peak)) / F.size(samples)).otherwise(F.lit(0.0))
