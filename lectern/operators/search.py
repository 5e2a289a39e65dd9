"""Search and matching: products of vectors by blocks, rank fusion with the text index, nearest and overlap joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.scalar import iou, overlap
from lectern.operators.textindex import TextIndex, kept, lexical_top

#: Vectors of a side that goes to every task whole (their number is counted first), and rows that a task compares with them at once.
BLOCK, TILE = 1024, 8192


@dataclass
class Side:
    """Unit vectors with their ids, tags and former lengths."""

    ids: np.ndarray
    tags: np.ndarray
    units: np.ndarray
    lengths: np.ndarray


def _side(table: pa.Table | pa.RecordBatch, width: int | None = None) -> Side:
    """The rows of (id, tag, embedding) whose vectors have a length; null, ragged and zero ones are left out."""
    column = table.column("embedding")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(column.value_lengths().fill_null(0))
    if width is None:
        width = int(size.max()) if len(size) else 0
    own = np.flatnonzero(size == width) if width else np.zeros(0, np.int64)
    values = np.asarray(column.take(pa.array(own)).flatten().fill_null(np.nan), dtype=np.float64).reshape(len(own), width)
    length = np.sqrt((values * values).sum(axis=1))
    ok = np.isfinite(length) & (length > 0)
    whole = lambda c: np.asarray(table.column(c).fill_null(-1))[own[ok]]
    return Side(whole("id"), whole("tag"), values[ok] / length[ok, None], length[ok])


def _standard(df: DataFrame, tag: str | None) -> DataFrame:
    return df.select(F.col("id").cast("long").alias("id"), (F.col(tag).cast("long") if tag else F.lit(0).cast("long")).alias("tag"), F.col("embedding").cast("array<double>").alias("embedding"))


def compared(rows: DataFrame, fixed: DataFrame, work: Callable[[Side, Side], dict[str, np.ndarray]], schema: str, tag: str | None = None, block: int = BLOCK) -> DataFrame:
    """What ``work(some rows, some fixed vectors)`` says of every row and every fixed vector: columns of ``schema``.

    Both have (id, embedding), and a whole number ``tag`` where it is named. Up to ``block`` fixed vectors (counted, not
    assumed) go to every task and rows stay where they are; more are dealt to blocks, the rows to tiles, and each pair of
    a tile and a block is one task's group.
    """
    rows, fixed = _standard(rows, tag), _standard(fixed, tag)
    names = [f.split()[0] for f in schema.split(", ")]

    def out(found: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(found[c]) for c in names], names)

    few = fixed.limit(block + 1).toArrow()
    if few.num_rows <= block:
        sent = rows.sparkSession.sparkContext.broadcast(_side(few))  # at most `block` vectors

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, many = [], 0
            if not len(sent.value.ids):
                return
            for batch in batches:
                held.append(batch)
                many += batch.num_rows
                if many >= TILE:
                    yield out(work(_side(pa.Table.from_batches(held), sent.value.units.shape[1]), sent.value))
                    held, many = [], 0
            if many:
                yield out(work(_side(pa.Table.from_batches(held), sent.value.units.shape[1]), sent.value))

        return rows.mapInArrow(run, schema)
    tiles, blocks = max(1, -(-rows.count() // TILE)), -(-fixed.count() // block)
    place = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("long")
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    mine = rows.select(F.lit(0).alias("side"), "id", "tag", "embedding", place(tiles).alias("tile"), every(blocks).alias("block"))
    theirs = fixed.select(F.lit(1).alias("side"), "id", "tag", "embedding", every(tiles).alias("tile"), place(blocks).alias("block"))

    def meet(table: pa.Table) -> pa.Table:
        side = np.asarray(table.column("side"))
        b = _side(table.filter(pa.array(side == 1)))
        if not len(b.ids):
            return pa.Table.from_batches([], pa.schema([(c, pa.int64() if "long" in f else pa.float64()) for c, f in zip(names, schema.split(", "), strict=True)]))
        return pa.Table.from_batches([out(work(_side(table.filter(pa.array(side == 0)), b.units.shape[1]), b))])

    return mine.unionByName(theirs).groupBy("tile", "block").applyInArrow(meet, schema)


def knn(rows: DataFrame, queries: DataFrame, k: int, threshold: float = -2.0, skip_self: bool = True, other: str | None = None, block: int = BLOCK, same: str | None = None) -> DataFrame:
    """The k rows nearest to each query by cosine: (query, id, similarity, rank); ties take the smaller id.

    Exact: each task keeps k rows for each query of what it has seen, and these are ranked. A query's own row (same id)
    is left out unless ``skip_self`` is off, and so are vectors of length 0, similarities below ``threshold``, and rows
    that have the query's value in the whole-number column ``other``, or another one than the query in the column ``same``.
    """

    def best(a: Side, b: Side) -> dict[str, np.ndarray]:
        s = b.units @ a.units.T
        if skip_self:
            s[b.ids[:, None] == a.ids[None, :]] = -np.inf
        if other:
            s[b.tags[:, None] == a.tags[None, :]] = -np.inf
        if same:
            s[b.tags[:, None] != a.tags[None, :]] = -np.inf
        if s.shape[1] > 4 * k:  # the k best, ties by id: all rows as near as the k-th are kept for the sort
            edge = np.round(np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k], 9) - 1e-9
            i, j = np.nonzero(s >= edge[:, None])
        else:
            i, j = (x.ravel() for x in np.indices(s.shape))
        value = s[i, j]
        order = np.lexsort((a.ids[j], -np.round(value, 9), i))
        i, j, value = i[order], j[order], value[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        ok = (place < k) & np.isfinite(value) & (value >= threshold)
        return {"query": b.ids[i[ok]], "id": a.ids[j[ok]], "similarity": value[ok]}

    found = compared(rows, queries, best, "query long, id long, similarity double", other or same, block)
    rank = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 9)), "id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def best_topic(vectors: DataFrame, topics: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """Each vector with its best topic by cosine, or null below ``least``: (id, topic, similarity); ties take the smaller topic."""

    def best(a: Side, b: Side) -> dict[str, np.ndarray]:
        order = np.argsort(b.ids, kind="stable")
        s = np.round(a.units @ b.units[order].T, 12)
        at = s.argmax(axis=1) if len(a.ids) else np.zeros(0, np.int64)
        return {"id": a.ids, "topic": b.ids[order][at], "similarity": s[np.arange(len(at)), at]}

    ids = topics.select(F.col("topic").alias("id"), F.col("centroid").alias("embedding"))
    near = compared(vectors.select("id", "embedding"), ids, best, "id long, topic long, similarity double", block=block)
    near = near.groupBy("id").agg(F.max_by(F.struct("topic", "similarity"), F.struct("similarity", -F.col("topic"))).alias("b")).select("id", "b.topic", "b.similarity")
    return vectors.select("id").join(near.where(F.col("similarity") >= least), "id", "left")


def coverage(items: DataFrame, vectors: DataFrame, covered: float = 0.8, partial: float = 0.6, block: int = BLOCK) -> DataFrame:
    """(item, best, status, n_near) of each item: its best cosine to any vector, and how many vectors are ``partial`` near.

    Items have (id, embedding), vectors too; an item without a length, or without any vector, is uncovered at 0.
    """

    def near(a: Side, b: Side) -> dict[str, np.ndarray]:
        s = b.units @ a.units.T if len(a.ids) else np.zeros((len(b.ids), 1))
        return {"item": b.ids, "best": s.max(axis=1), "n_near": (s >= partial).sum(axis=1).astype(np.int64)}

    found = compared(vectors, items, near, "item long, best double, n_near long", block=block).groupBy("item").agg(F.max("best").alias("best"), F.sum("n_near").alias("n_near"))
    joined = items.select(F.col("id").cast("long").alias("item")).join(found, "item", "left")
    best = F.coalesce("best", F.lit(0.0))
    status = F.when(best >= covered, "covered").when(best >= partial, "partial").otherwise("uncovered")
    return joined.select("item", best.alias("best"), status.alias("status"), F.coalesce("n_near", F.lit(0)).alias("n_near"))


def fuse(lexical: DataFrame, vector: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two lists of (query, id, rank): (query, id, lexical_rank, vector_rank, fused)."""
    share = lambda r: F.coalesce(1 / (k + F.col(r)), F.lit(0.0))
    both = lexical.select("query", "id", F.col("rank").alias("lexical_rank")).join(vector.select("query", "id", F.col("rank").alias("vector_rank")), ["query", "id"], "full")
    return both.withColumn("fused", share("lexical_rank") + share("vector_rank"))


def hybrid_search(index: TextIndex, vectors: dict[str, DataFrame], queries: DataFrame, limit: int = 20, pool: int = 50, k: int = 60, block: int = BLOCK) -> DataFrame:
    """Hybrid search over several tables: (query, source_type, id, lexical_rank, vector_rank, fused, rank), ``limit`` for each query.

    The sources of the text index are the names of ``vectors``, tables of (id, embedding); ``queries`` has (query, text, embedding, and
    maybe scope). Lexical and vector candidates, ``pool`` of each, are fused source by source, then ranked together; ties go by source
    and id. A query without a vector is answered by its words alone, a row without one is found by its words alone. Where
    queries have a scope, vectors have one too, and only rows of the query's scope are found.
    """
    queries = kept(queries, "queries")  # what is asked of words and of both sources' vectors comes from it
    lexical = kept(lexical_top(index, queries, pool), "lexical")  # each source takes its part
    asked, found = queries.where("embedding IS NOT NULL"), None
    for name, rows in vectors.items():
        near = _near_in_scope(rows.where("embedding IS NOT NULL"), asked, pool, block)
        part = fuse(lexical.where(F.col("source") == name), near, k).withColumn("source_type", F.lit(name))
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("fused", 12)), "source_type", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit).select("query", "source_type", "id", "lexical_rank", "vector_rank", "fused", "rank")


def _near_in_scope(rows: DataFrame, queries: DataFrame, k: int, block: int) -> DataFrame:
    """The k rows nearest to each query, all of them or those of its scope, which is told by a hash of its name."""
    asked = queries.select(F.col("query").alias("id"), "embedding", *(["scope"] if "scope" in queries.columns else []))
    if "scope" not in queries.columns:
        return knn(rows.select("id", "embedding"), asked, k, skip_self=False, block=block)
    named = lambda df: df.withColumn("scope", F.xxhash64("scope"))
    return knn(named(rows.select("id", "embedding", "scope")), named(asked), k, skip_self=False, same="scope", block=block)


def reranked(found: DataFrame, score: Column | None, limit: int = 10) -> DataFrame:
    """The best ``limit`` rows of each query by a second score, first-stage order where there is none: adds rerank_score, reranked, position.

    A null score counts as 0; ``score=None`` (the scorer is down) keeps the first-stage order and says so in ``reranked``.
    """
    value = score if score is not None else F.lit(None).cast("double")
    best = F.desc(F.coalesce(F.round("rerank_score", 12), F.lit(0.0)))
    order = [best, "rank"] if score is not None else ["rank"]
    place = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    return found.withColumn("rerank_score", value).withColumn("reranked", F.lit(score is not None)).withColumn("position", place).where(F.col("position") <= limit)


def bucketed(df: DataFrame, low: Column, high: Column, width: int) -> DataFrame:
    """Rows once for each bucket that [low, high] touches, so that intervals meet by equality of (session, bucket)."""
    return df.withColumn("bucket", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))


def best_overlap(primary: DataFrame, secondary: DataFrame, least: float = 0.3, width: int = 60_000) -> DataFrame:
    """Each primary interval with the secondary interval of its session that it overlaps best (IoU of ``least`` or more).

    Intervals meet in time buckets of the session, so a long session is not compared with itself whole.
    """
    spread = lambda df: bucketed(df, F.col("start_ms"), F.col("end_ms"), width)
    other = spread(secondary).select("session", "bucket", F.col("seq").alias("other"), F.col("start_ms").alias("s2"), F.col("end_ms").alias("e2"))
    met = spread(primary.select("session", "seq", "start_ms", "end_ms")).join(other, ["session", "bucket"])
    met = met.withColumn("iou", iou(F.col("start_ms"), F.col("end_ms"), F.col("s2"), F.col("e2"))).where(F.col("iou") >= least)
    best = met.groupBy("session", "seq").agg(F.max_by(F.struct("other", "iou"), F.struct("iou", -F.col("other"))).alias("best"))
    return primary.join(best, ["session", "seq"], "left").select("session", "seq", F.col("best.other").alias("other"), F.col("best.iou").alias("iou"))


def covered_ms(rows: DataFrame, regions: DataFrame, margin: int = 0, width: int = 60_000) -> DataFrame:
    """How many milliseconds of each row's interval, widened by a margin, lie in regions of its session.

    Row and region meet in the buckets that both touch and are counted in the first of them.
    """
    low, high = F.col("start_ms") - margin, F.col("end_ms") + margin
    r = bucketed(regions, F.col("start_ms"), F.col("end_ms"), width).select("session", "bucket", F.col("start_ms").alias("s2"), F.col("end_ms").alias("e2"))
    met = bucketed(rows.select("session", "seq", "start_ms", "end_ms"), low, high, width).join(r, ["session", "bucket"])
    met = met.where(F.col("bucket") == F.floor(F.greatest(low, F.col("s2")) / width))
    sums = met.groupBy("session", "seq").agg(F.sum(overlap(low, high, F.col("s2"), F.col("e2"))).alias("ms"))
    return rows.select("session", "seq").join(sums, ["session", "seq"], "left").select("session", "seq", F.coalesce("ms", F.lit(0)).cast("long").alias("covered_ms"))


def at_point(points: DataFrame, intervals: DataFrame, value: str, width: int = 60_000) -> DataFrame:
    """Each point (session, seq, mid) with ``value`` of the earliest interval [start_ms, end_ms) of its session that holds it, or null."""
    spread = bucketed(intervals, F.col("start_ms"), F.col("end_ms"), width).select("session", "bucket", "start_ms", "end_ms", value)
    met = points.withColumn("bucket", F.floor(F.col("mid") / width)).join(spread, ["session", "bucket"]).where((F.col("mid") >= F.col("start_ms")) & (F.col("mid") < F.col("end_ms")))
    found = met.groupBy("session", "seq").agg(F.min_by(value, F.struct("start_ms", value)).alias(value))
    return points.join(found, ["session", "seq"], "left")


def nearest_window(points: DataFrame, windows: DataFrame, most: int = 300) -> DataFrame:
    """Each point (session, point, at) with the window (session, window, start, end) nearest in time, at most ``most`` away: adds window, delta.

    Inside a window the distance is 0, else that to its nearer end; ties take the earlier window. Windows, widened by
    ``most``, meet points in buckets.
    """
    spread = bucketed(windows, F.col("start") - most, F.col("end") + most, max(most, 1) * 2).select("session", "bucket", "window", "start", "end")
    met = points.withColumn("bucket", F.floor(F.col("at") / (max(most, 1) * 2))).join(spread, ["session", "bucket"])
    delta = F.greatest(F.col("start") - F.col("at"), F.col("at") - F.col("end"), F.lit(0))
    near = met.withColumn("delta", delta).where(F.col("delta") <= most)
    best = near.groupBy("session", "point").agg(F.min(F.struct("delta", "start", "window")).alias("b"))
    return points.join(best, ["session", "point"], "left").select(*points.columns, F.col("b.window").alias("window"), F.col("b.delta").alias("delta"))
