"""Operators over ordered sequences: context windows, adaptive segmentation, pooling, cues.

A sequence is the rows of one session ordered by ``seq``. Windows partition by session, so a corpus is
split over as many tasks as it has sessions; the ``long_`` forms give the same rows where one session is too
long for a task: they cut it into blocks of places, with halo rows at the edges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.prefix import ahead, let, prefixed
from lectern.functions.vector import cosine
from lectern.operators.longscan import RANGE, looking, percentile, positioned, running_sum


def ordered(*keys: str):
    return Window.partitionBy(*keys).orderBy("seq")


def context_windows(rows: DataFrame, width: int) -> DataFrame:
    """Each row's text joined after those of the ``width - 1`` rows before it; a width of 0 or less is the row alone."""
    frame = ordered("session").rowsBetween(-(max(width, 1) - 1), 0)
    return rows.withColumn("context", F.array_join(F.collect_list("text").over(frame), " ")).withColumn("n_context", F.count(F.lit(1)).over(frame))


def adjacent_similarity(rows: DataFrame) -> DataFrame:
    """Cosine of each row's embedding with the next one's; null at the end of a session. Zero vectors are alike (1)."""
    following = F.lead("embedding").over(ordered("session"))
    return rows.withColumn("next_embedding", following).withColumn("similarity", F.when(F.col("next_embedding").isNotNull(), cosine(F.col("embedding"), F.col("next_embedding"), 1.0))).drop("next_embedding")


def segments(rows: DataFrame, percentile: float = 0.25) -> DataFrame:
    """Adaptive segmentation: (session, segment, start_seq, end_seq, n, boundary_score, confidence).

    A boundary lies after each row whose similarity to the next is below the session's percentile.
    ``boundary_score`` is 1 minus that similarity, ``confidence`` its distance from the threshold in
    standard deviations (0.5 without spread), both 1 for the last segment of a session. All steps share one
    shuffle by session; threshold and spread are an aggregate joined back, not a frame over the whole session.
    """
    scored = adjacent_similarity(rows.select("session", "seq", "embedding")).drop("embedding")
    limits = scored.groupBy("session").agg(F.percentile("similarity", F.lit(percentile)).alias("threshold"), F.stddev_pop("similarity").alias("spread"))
    scored = scored.join(limits, "session")
    cut = F.coalesce(F.col("similarity") < F.col("threshold"), F.lit(False))
    scored = scored.withColumn("cut", cut.cast("int")).withColumn("segment", F.sum("cut").over(ordered("session").rowsBetween(Window.unboundedPreceding, 0)) - F.col("cut"))
    return _segments_of(scored)


def _segments_of(scored: DataFrame) -> DataFrame:
    """Segments from rows with similarity, threshold, spread, cut and the number of their segment."""
    sure = F.when(F.col("spread") > 0, F.least(F.lit(1.0), F.abs(F.col("threshold") - F.col("at_cut")) / F.col("spread"))).otherwise(F.lit(0.5))
    grouped = scored.groupBy("session", "segment").agg(
        F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("cut") == 1, F.col("similarity"))).alias("at_cut"), F.first("threshold").alias("threshold"), F.first("spread").alias("spread")
    )
    last = F.col("at_cut").isNull()
    return grouped.select("session", "segment", "start_seq", "end_seq", "n", F.when(last, 1.0).otherwise(1 - F.col("at_cut")).alias("boundary_score"), F.when(last, 1.0).otherwise(sure).alias("confidence"))


def long_context_windows(rows: DataFrame, width: int, most: int = RANGE) -> DataFrame:
    """``context_windows`` for sessions of any length, and ``position`` besides."""
    back = max(width, 1) - 1
    placed = positioned(rows, "session", "seq", most=most)
    frame = lambda w: w.rowsBetween(-back, 0)
    return looking(placed, "session", back, 0, lambda w: {"context": F.array_join(F.collect_list("text").over(frame(w)), " "), "n_context": F.count(F.lit(1)).over(frame(w))}, max(most, back))


def long_batches(rows: DataFrame, size: int, most: int = RANGE) -> DataFrame:
    """``batches`` for sessions of any length."""
    return positioned(rows, "session", "seq", most=most).withColumn("batch", F.floor(F.col("position") / size)).drop("position")


def long_segments(rows: DataFrame, share: float = 0.25, most: int = RANGE) -> DataFrame:
    """``segments`` for sessions of any length: neighbours across blocks by halo rows, the threshold by places of sorted values, numbers by sums over blocks."""
    placed = positioned(rows.select("session", "seq", "embedding"), "session", "seq", most=most)
    scored = looking(placed, "session", 0, 1, lambda w: {"following": F.lead("embedding").over(w)}, most)
    scored = scored.withColumn("similarity", F.when(F.col("following").isNotNull(), cosine(F.col("embedding"), F.col("following"), 1.0))).drop("embedding", "following")
    limits = percentile(scored, "session", "similarity", share, most).withColumnRenamed("percentile", "threshold")
    limits = limits.join(scored.groupBy("session").agg(F.stddev_pop("similarity").alias("spread")), "session")
    scored = scored.join(limits, "session", "left")
    cut = F.coalesce(F.col("similarity") < F.col("threshold"), F.lit(False)).cast("int")
    numbered = running_sum(scored.withColumn("cut", cut), "session", F.col("cut"), "segment", most).withColumn("segment", F.col("segment") - F.col("cut"))
    return _segments_of(numbered)


def long_members(rows: DataFrame, spans: DataFrame, width: int = RANGE) -> DataFrame:
    """``members`` for sessions of any length: segments and rows meet in ranges of ``width`` numbers, each cut at its edges."""
    cut = F.explode(F.sequence(F.floor(F.col("start_seq") / width), F.floor(F.col("end_seq") / width)))
    marks = spans.select("session", cut.alias("range"), "segment", F.col("start_seq").alias("from_seq"), "end_seq")
    marks = marks.select("session", "range", F.greatest("from_seq", F.col("range") * width).alias("seq"), F.lit(0).alias("kind"), F.struct("segment", "end_seq").alias("span"))
    names = rows.columns
    both = rows.withColumn("range", F.floor(F.col("seq") / width)).withColumn("kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    carried = F.last("span", ignorenulls=True).over(Window.partitionBy("session", "range").orderBy("seq", "kind").rowsBetween(Window.unboundedPreceding, 0))
    held = both.withColumn("span", carried).where((F.col("kind") == 1) & (F.col("seq") <= F.col("span.end_seq")))
    return held.select(*names, F.col("span.segment").alias("segment"))


def members(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows with the segment whose range holds their seq.

    Segments don't overlap, so their starts are carried on over the rows in order: one pass of each session, no pairs.
    """
    names = rows.columns
    marks = spans.select("session", F.col("start_seq").alias("seq"), F.lit(0).alias("kind"), F.struct("segment", "end_seq").alias("span"))
    both = rows.withColumn("kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    carried = F.last("span", ignorenulls=True).over(Window.partitionBy("session").orderBy("seq", "kind").rowsBetween(Window.unboundedPreceding, 0))
    held = both.withColumn("span", carried).where((F.col("kind") == 1) & (F.col("seq") <= F.col("span.end_seq")))
    return held.select(*names, F.col("span.segment").alias("segment"))


def mean_pool(rows: DataFrame, *keys: str) -> DataFrame:
    """Element-wise mean of the embeddings of each group: (keys, n, centroid), one vector of sums for each group and task.

    Null vectors are left out; those of a group have one width.
    """
    return pooled(rows, Summarizer.mean, "centroid", *keys)


def pooled(rows: DataFrame, statistic: Callable[[Column], Column], name: str, *keys: str) -> DataFrame:
    """(keys, n, ``name``): a statistic of the vectors of each group, kept as one running vector for each group and task."""
    vectors = rows.where(F.col("embedding").isNotNull()).select(*keys, array_to_vector(F.col("embedding").cast("array<double>")).alias("vector"))
    found = vectors.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), statistic(F.col("vector")).alias("pooled"))
    return found.select(*keys, "n", vector_to_array("pooled").alias(name))


def cue_matches(rows: DataFrame, cues: dict[str, tuple[str, float]]) -> DataFrame:
    """(session, seq, cue, weight) of each cue that a row's text holds; the patterns are literals, not a join."""
    found = F.array(*(F.when(F.col("text").rlike("(?i)" + pattern), F.struct(F.lit(name).alias("cue"), F.lit(weight).alias("weight"))) for name, (pattern, weight) in cues.items()))
    return rows.select("session", "seq", F.explode(F.filter(found, lambda c: c.isNotNull())).alias("c")).select("session", "seq", "c.*")


def nearest_segment(cues: DataFrame, spans: DataFrame, most: int = 3) -> DataFrame:
    """Each cue with the segment that starts nearest to it, at most ``most`` away; ties take the earlier start.

    Cues meet starts in buckets of ``most + 1`` positions (their own and the two beside it), not all starts of a session.
    """
    place = F.floor(F.col("start_seq") / (most + 1))
    s = spans.select("session", "segment", "start_seq", place.alias("bucket"))
    own = F.floor(F.col("seq") / (most + 1))
    near = cues.withColumn("bucket", F.explode(F.array(own - 1, own, own + 1))).join(s, ["session", "bucket"]).drop("bucket").where(F.abs(F.col("seq") - F.col("start_seq")) <= most)
    rank = Window.partitionBy("session", "seq", "cue").orderBy(F.abs(F.col("seq") - F.col("start_seq")), "start_seq")
    return near.withColumn("rank", F.row_number().over(rank)).where("rank = 1").drop("rank")


def boosted(spans: DataFrame, cues: DataFrame, most: int = 3, gain: float = 0.2) -> DataFrame:
    """Segments with ``boundary_score`` raised by ``gain`` times the weights of the cues nearest to them; none is created."""
    sums = nearest_segment(cues, spans, most).groupBy("session", "segment").agg(F.sum("weight").alias("weight"))
    return spans.join(sums, ["session", "segment"], "left").withColumn("boosted_score", F.col("boundary_score") + gain * F.coalesce("weight", F.lit(0.0))).drop("weight")


def batches(rows: DataFrame, size: int) -> DataFrame:
    """Number the rows of each session in batches of ``size``."""
    return rows.withColumn("batch", F.floor((F.row_number().over(ordered("session")) - 1) / size))


def next_of_group(rows: DataFrame, group: str, order: str) -> DataFrame:
    """The next row of the same group in order; the last row's is the first (null in a group of one)."""
    w = Window.partitionBy(group).orderBy(order)
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follower = F.coalesce(F.lead(order).over(w), F.first(order).over(everything))
    return rows.withColumn("follower", F.when(F.count(F.lit(1)).over(everything) > 1, follower))


def clamp_words(words: Column) -> Column:
    """Word times made monotone: a start is at least the previous end, an end at least its start plus 1.

    A word that begins and ends as told needs max(end, start + 1); each word before it may push it on by one more, so an end
    less its place is a running maximum.
    """
    least = F.transform(words, lambda w, i: F.greatest(w["end_ms"], F.greatest(w["start_ms"], F.lit(0)) + 1).cast("bigint") - i)
    none = F.lit(-(2**62)).cast("bigint")
    most = lambda values: F.coalesce(F.array_max(values), none)

    def clamped(p: Column) -> Column:
        before = lambda i: ahead(p, i, most, lambda x, y: F.greatest(x, y))  # noqa: E731  the running maximum ahead of a word
        start = lambda w, i: F.greatest(w["start_ms"], F.lit(0), F.when(i > 0, before(i) + i - 1))
        end = lambda i: F.greatest(before(i), F.element_at(p["v"], i + 1)) + i
        return F.transform(words, lambda w, i: F.struct(w["word"].alias("word"), start(w, i).cast("bigint").alias("start_ms"), end(i).cast("bigint").alias("end_ms")))

    return let(prefixed(least, most, none), clamped)


def renumbered(rows: DataFrame, session: str, *order: str) -> DataFrame:
    """Rows of a session numbered anew from 0 in order: what chunks of a session numbered each for itself."""
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(session).orderBy(*order)) - 1)


def rising(rows: DataFrame, group: str, at: str, ordinal: str) -> DataFrame:
    """(group, n, valid): whether the ordinals of a group rise strictly in the order of ``at``."""
    before = F.lag(ordinal).over(Window.partitionBy(group).orderBy(at))
    marked = rows.select(group, F.coalesce(F.col(ordinal) > before, F.lit(True)).alias("ok"))
    return marked.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.bool_and("ok").alias("valid"))


def fixed_boundaries(sizes: DataFrame, window: int) -> DataFrame:
    """Baseline: of (session, n) a boundary every ``window`` positions: (session, at)."""
    starts = F.when(F.col("n") > window, F.sequence(F.lit(window).cast("long"), F.col("n") - 1, F.lit(window).cast("long")))
    return sizes.select("session", F.explode(starts).alias("at"))


def random_boundaries(sizes: DataFrame, many: int, seed: str = "42") -> DataFrame:
    """Baseline: of (session, n) ``many`` boundaries at positions 1 to n - 1, drawn by a hash of session, position and seed: (session, at)."""
    spots = sizes.where("n > 1").select("session", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") - 1)).alias("at"))
    drawn = F.md5(F.concat_ws("-", "session", "at", F.lit(seed)))
    rank = F.row_number().over(Window.partitionBy("session").orderBy(drawn))
    return spots.withColumn("rank", rank).where(F.col("rank") <= many).drop("rank")
