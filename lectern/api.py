"""Read methods of a course library over DataFrames: what its clients ask for, each as one query plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators.cluster import seeding_status
from lectern.operators.relational import page
from lectern.operators.replay import replayed
from lectern.operators.search import hybrid_search
from lectern.operators.textindex import TextIndex


def transcript(rows: DataFrame, offset: int = 0, limit: int = 50, include_filtered: bool = False, speaker: str | None = None, search: str | None = None) -> DataFrame:
    """A page of utterances in order with ``total``, the number of all that match; at most 200 rows.

    Rows judged irrelevant are left out unless asked for, unjudged ones stay; ``search`` is a substring in any case, in
    which % and _ are wildcards.
    """
    if not include_filtered:
        rows = rows.where(~F.col("is_relevant").eqNullSafe(False))
    if speaker is not None:
        rows = rows.where(F.col("speaker") == speaker)
    if search is not None:
        rows = rows.where(F.col("text").ilike(f"%{search}%"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))  # one row
    return page(rows, [F.col("session"), F.col("seq")], offset, limit).join(F.broadcast(total))


def session_notes(notes: DataFrame, session) -> DataFrame:
    return notes.where(F.col("session") == F.lit(session)).orderBy("ordinal")


def topic_notes(notes: DataFrame, topic) -> DataFrame:
    return notes.where(F.col("topic") == F.lit(topic)).orderBy("session", "ordinal")


def with_topics(found: DataFrame, items: DataFrame, topics: DataFrame) -> DataFrame:
    """Results with the topic and label of their items (source_type, id, topic); null where an item has no known topic."""
    known = items.where("topic IS NOT NULL").join(topics, "topic")
    return found.join(known, ["source_type", "id"], "left")


def _newest(sessions: DataFrame) -> Column:
    return F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("created_at"), F.desc("session")))


def dashboard(subjects: DataFrame, sessions: DataFrame, topics: DataFrame, recent: int = 5) -> DataFrame:
    """(subject, title, total_sessions, total_topics, recent): the true counts, and the newest sessions first."""
    ranked = sessions.withColumn("k", _newest(sessions))
    listed = F.array_sort(F.collect_list(F.when(F.col("k") <= recent, F.struct("k", "session"))))
    counted = ranked.groupBy("subject").agg(F.count(F.lit(1)).alias("total_sessions"), F.transform(listed, lambda x: x["session"]).alias("recent"))
    of_topics = topics.groupBy("subject").agg(F.count(F.lit(1)).alias("total_topics"))
    joined = subjects.join(counted, "subject", "left").join(of_topics, "subject", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("total_sessions", "total_topics")}
    return joined.withColumns(zero | {"recent": F.coalesce("recent", F.array().cast(counted.schema["recent"].dataType))})


def recent_compat(sessions: DataFrame, most: int = 50, recent: int = 5) -> DataFrame:
    """The last ``recent`` of the newest ``most`` sessions, that is their oldest, and a count that stops at ``most``."""
    kept = sessions.withColumn("k", _newest(sessions)).where(F.col("k") <= most)
    listed = kept.groupBy("subject").agg(F.count(F.lit(1)).alias("total_sessions"), F.array_sort(F.collect_list(F.struct("k", "session"))).alias("s"))
    last = F.slice("s", F.greatest(F.size("s") - recent + 1, F.lit(1)), recent)
    return listed.select("subject", "total_sessions", F.transform(last, lambda x: x["session"]).alias("recent"))


def study_status(subjects: DataFrame, sessions: DataFrame, cards: DataFrame) -> DataFrame:
    """(subject, session, status, flashcard_count): the newest session of each subject, null without any."""
    newest = sessions.groupBy("subject").agg(F.max_by(F.struct("session", "status"), F.struct("created_at", "session")).alias("s"))
    counted = cards.groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    joined = subjects.join(newest, "subject", "left").join(counted, "subject", "left")
    return joined.select("subject", "s.session", "s.status", F.coalesce("n", F.lit(0)).alias("flashcard_count"))


def flashcards(cards: DataFrame) -> DataFrame:
    return cards.orderBy("due_at", "card")


def overridden(rows: DataFrame, overrides: DataFrame, method: str = "operator_override") -> DataFrame:
    """Classifications (session, final_type, method) with overrides (session, override), which win; repeats of a session must agree, the greatest wins."""
    said = overrides.groupBy("session").agg(F.max("override").alias("override"))
    joined = rows.join(said, "session", "left")
    return joined.select("session", F.coalesce("override", "final_type").alias("final_type"), F.when(F.col("override").isNotNull(), F.lit(method)).otherwise(F.col("method")).alias("method"))


def search(index: TextIndex, vectors: dict[str, DataFrame], spark: SparkSession, text: str, subject: str | None = None, embedding: list[float] | None = None, limit: int = 20) -> DataFrame:
    """One search, within a subject where one is named: (source_type, id, lexical_rank, vector_rank, fused, rank). Without a vector it goes by words alone."""
    one = spark.range(1).select(F.col("id").alias("query"), F.lit(text).alias("text"), F.lit(embedding).cast("array<double>").alias("embedding"), *([F.lit(subject).alias("scope")] if subject is not None else []))
    return hybrid_search(index, vectors, one, limit).drop("query")


def coverage_summary(statuses: DataFrame) -> DataFrame:
    """(subject, total, covered, partial, uncovered, pct) from items (subject, status); pct is the share of covered ones."""
    n = lambda s: F.count_if(F.col("status") == s)
    found = statuses.groupBy("subject").agg(F.count(F.lit(1)).alias("total"), n("covered").alias("covered"), n("partial").alias("partial"), n("uncovered").alias("uncovered"))
    return found.withColumn("pct", F.round(100 * F.col("covered") / F.col("total"), 2))


def next_card(cards: DataFrame, now: Column) -> DataFrame:
    """(subject, card, due_at) of each subject: the card that has been due longest, else the one that is due next; ties take the smaller card."""
    order = F.struct((F.col("due_at") > now).alias("later"), "due_at", "card")
    return cards.groupBy("subject").agg(F.min(order).alias("c")).select("subject", "c.card", "c.due_at")


def review(log: DataFrame, new: DataFrame) -> DataFrame:
    """Cards after new reviews (card, review, at, rating) on top of their log: what ``replayed`` says of the last review of each."""
    touched = log.join(new.select("card").distinct(), "card", "left_semi")
    out = replayed(touched.unionByName(new))
    return out.groupBy("card").agg(F.max_by(F.struct(*(c for c in out.columns if c != "card")), "n").alias("s")).select("card", "s.*")


def cold_start_status(seeds: DataFrame, sessions: DataFrame) -> DataFrame:
    """(subject, seed_count, status, cadence) of subjects with their seeds (subject, replaced) and the number of their sessions (subject, sessions)."""
    return seeding_status(seeds.join(sessions, "subject", "full"), "subject", F.coalesce("sessions", F.lit(0)))


def sessions_by_subject(sessions: DataFrame, most: int = 50) -> DataFrame:
    """The newest ``most`` sessions of each subject, with ``k``, their place from 1."""
    return sessions.withColumn("k", _newest(sessions).cast("long")).where(F.col("k") <= most)
