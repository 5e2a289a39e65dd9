"""An approximate vector index as a table: inverted lists of a coarse quantiser, residuals as product-quantised codes.

The quantisers are fitted in one task on a bounded sample; every row with a direction is indexed. A search
goes through the lists nearest to each query, compares codes by table look-ups, and computes exact similarities of
the best ``refine`` rows alone. Lists and queries meet in tiles of bounded size, however long a list is.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.vector import cosine
from lectern.operators.search import knn

#: Vectors that the quantisers are fitted on, at most; rows of a list, and queries, that meet in one tile, on average.
SAMPLE, TILE, BLOCK = 20_000, 8192, 1024
#: Rounds of each fit, and codewords of a subspace.
ROUNDS, WORDS = 12, 256


@dataclass(frozen=True)
class Quantiser:
    """Coarse centers (lists x width), and codewords of each residual subspace (subspaces x words x width / subspaces)."""

    centers: np.ndarray
    words: np.ndarray

    def nearest_lists(self, units: np.ndarray, n: int) -> np.ndarray:
        s = units @ self.centers.T - 0.5 * (self.centers**2).sum(axis=1)
        n = min(n, s.shape[1])
        return np.argsort(-s, axis=1, kind="stable")[:, :n]

    def codes(self, units: np.ndarray, at: np.ndarray) -> np.ndarray:
        parts = self._parts(units - self.centers[at])
        out = np.empty(parts.shape[:2], np.uint8)
        for m, words in enumerate(self.words):
            out[:, m] = (parts[:, m] @ words.T - 0.5 * (words**2).sum(axis=1)).argmax(axis=1)
        return out

    def products(self, units: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Approximate inner products of queries with the coded rows of one list."""
        tables = np.einsum("qmd,mwd->qmw", self._parts(units), self.words)
        own = units @ self.centers[at]
        return own[:, None] + sum(tables[:, m][:, codes[:, m]] for m in range(codes.shape[1]))

    def _parts(self, x: np.ndarray) -> np.ndarray:
        m, _, d = self.words.shape
        return np.pad(x, ((0, 0), (0, m * d - x.shape[1]))).reshape(len(x), m, d)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centers of Lloyd's rounds; an empty one takes the row that is worst served."""
    centers = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(ROUNDS):
        s = x @ centers.T - 0.5 * (centers**2).sum(axis=1)
        at = s.argmax(axis=1)
        count = np.bincount(at, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, at, x)
        centers = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centers)
        empty = np.flatnonzero(count == 0)
        centers[empty] = x[np.argsort(s.max(axis=1) - 0.5 * (x**2).sum(axis=1), kind="stable")[: len(empty)]]
    return centers


def fit(x: np.ndarray, lists: int, subspaces: int, seed: int = 1) -> Quantiser:
    rng = np.random.default_rng(seed)
    centers = _kmeans(x, lists, rng)
    rest = x - centers[(x @ centers.T - 0.5 * (centers**2).sum(axis=1)).argmax(axis=1)]
    d = -(-x.shape[1] // subspaces)
    parts = np.pad(rest, ((0, 0), (0, subspaces * d - x.shape[1]))).reshape(len(x), subspaces, d)
    words = [_kmeans(parts[:, m], WORDS, rng) for m in range(subspaces)]
    most = max(len(w) for w in words)
    return Quantiser(centers, np.stack([np.pad(w, ((0, most - len(w)), (0, 0)), mode="edge") for w in words]))


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows with a direction (of the width that most rows have), and their unit vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(column.value_lengths().fill_null(0))
    width = int(np.bincount(size).argmax()) if len(size) and size.max() else 0
    return _units_of(column, size, width)


def _units_of(column: pa.Array, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.flatnonzero(size == width) if width else np.zeros(0, np.int64)
    values = np.asarray(column.take(pa.array(own)).flatten().fill_null(np.nan), dtype=np.float64).reshape(len(own), width)
    length = np.sqrt((values**2).sum(axis=1))
    ok = np.isfinite(length) & (length > 0)
    return own[ok], values[ok] / length[ok, None]


@dataclass(frozen=True)
class VectorIndex:
    """A written index: the path of its rows (bucket, list, id, code, embedding), its quantiser and the rows of each list."""

    path: str
    quantiser: Quantiser
    sizes: np.ndarray
    buckets: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("list int, id long, code binary, embedding array<double>, bucket int").parquet(self.path)


def build_vector_index(rows: DataFrame, path: str, lists: int | None = None, subspaces: int = 16, buckets: int = 16, sample: int = SAMPLE) -> VectorIndex:
    """Index (id, embedding) at ``path``. ``lists`` is by default the square root of the number of rows.

    The quantisers are fitted on at most ``sample`` rows, those of the smallest hash of their id. Rows without a direction (null, zero,
    not finite, or of another width than the sample's) have no cosine and are not indexed. Files are by bucket of lists, sorted by list.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    lists = lists or max(1, round(rows.count() ** 0.5))
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample)

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        _, x = _units(pa.array(pdf["embedding"], pa.list_(pa.float64())))
        return pd.DataFrame({"model": [pickle.dumps(fit(x, lists, subspaces)) if len(x) else b""]})

    model = some.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(fitted, "model binary").first()
    if model is None or not model["model"]:
        raise ValueError("no row of the sample has a direction")
    quantiser: Quantiser = pickle.loads(bytes(model["model"]))
    sent = spark.sparkContext.broadcast(quantiser)  # lists x width and 256 x width numbers

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            own, units = _units_of(column, np.asarray(column.value_lengths().fill_null(0)), sent.value.centers.shape[1])
            at = sent.value.nearest_lists(units, 1)[:, 0] if len(own) else np.zeros(0, np.int64)
            codes = sent.value.codes(units, at)
            binary = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.record_batch([pa.array((at % buckets).astype(np.int32)), pa.array(at.astype(np.int32)), batch.column("id").take(pa.array(own)), binary, column.take(pa.array(own))], ["bucket", "list", "id", "code", "embedding"])

    coded = rows.mapInArrow(code, "bucket int, list int, id long, code binary, embedding array<double>")
    coded.repartitionByRange("bucket", "list", "id").sortWithinPartitions("bucket", "list", "id").write.partitionBy("bucket").parquet(path)
    counts = spark.read.parquet(path).groupBy("list").count().collect()  # a row for each list
    sizes = np.zeros(len(quantiser.centers), np.int64)
    for r in counts:
        sizes[r["list"]] = r["count"]
    return VectorIndex(path, quantiser, sizes, buckets)


def index_knn(index: VectorIndex, queries: DataFrame, k: int, probes: int = 16, refine: int = 20, skip_self: bool = True) -> DataFrame:
    """(query, id, similarity, rank): about the k rows nearest to each query (id, embedding) by cosine.

    Looks through the ``probes`` lists nearest to the query and computes the exact cosine of the ``refine * k`` rows that the codes
    put first. What it returns is exact for these rows; rows of other lists can be missed.
    """
    spark = queries.sparkSession
    sent = spark.sparkContext.broadcast((index.quantiser, index.sizes))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser, sizes = sent.value
        for batch in batches:
            column = batch.column("embedding")
            own, units = _units_of(column, np.asarray(column.value_lengths().fill_null(0)), quantiser.centers.shape[1])
            if not len(own):
                continue
            lists = quantiser.nearest_lists(units, probes)
            at, row = lists.ravel(), np.repeat(np.arange(len(own)), lists.shape[1])
            tiles = np.maximum(1, -(-sizes[at] // TILE))
            yield pa.record_batch([batch.column("id").take(pa.array(own[row])), pa.array(at.astype(np.int32)), pa.array(tiles), pa.array(list(units[row]), pa.list_(pa.float64()))], ["id", "list", "tiles", "embedding"])

    asked = queries.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    probed = asked.mapInArrow(probe, "id long, list int, tiles long, embedding array<double>")
    blocks = max(1, -(-queries.count() // BLOCK))
    place = lambda n: F.pmod(F.xxhash64("id"), n)
    theirs = probed.select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"), place(F.lit(blocks)).alias("block"), "id", "embedding", F.lit(None).cast("binary").alias("code"))
    wanted = probed.select("list", "tiles").distinct().select("list", "tiles", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    mine = index.rows(spark).select("list", "id", "code").join(wanted, "list").select("list", place(F.col("tiles")).alias("tile"), "block", "id", F.lit(None).cast("array<double>").alias("embedding"), "code")

    def meet(table: pa.Table) -> pa.Table:
        quantiser, _ = sent.value
        is_query = np.asarray(table.column("code").is_null())
        ids = np.asarray(table.column("id"))
        q, r = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        if not len(q) or not len(r):
            i, j, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            units = np.stack([np.asarray(v.values) for v in table.column("embedding").take(pa.array(q)).combine_chunks()])
            codes = np.frombuffer(b"".join(table.column("code").take(pa.array(r)).to_pylist()), np.uint8).reshape(len(r), -1)
            s = quantiser.products(units, int(table.column("list")[0].as_py()), codes)
            if skip_self:
                s[ids[q][:, None] == ids[r][None, :]] = -np.inf
            n = min(refine * k, s.shape[1])
            top = np.argpartition(-s, n - 1, axis=1)[:, :n]
            i, j = np.repeat(np.arange(len(q)), n), top.ravel()
            s = s[i, j]
        ok = np.isfinite(s)
        return pa.table({"query": ids[q][i[ok]], "list": np.full(ok.sum(), table.column("list")[0].as_py(), np.int32), "id": ids[r][j[ok]], "near": s[ok]})

    near = theirs.unionByName(mine).groupBy("list", "tile", "block").applyInArrow(meet, "query long, list int, id long, near double")
    first = near.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "id"))).where(F.col("n") <= refine * k).select("query", "list", "id")
    exact = first.join(index.rows(spark).select("list", "id", "embedding"), ["list", "id"]).join(asked.withColumnsRenamed({"id": "query", "embedding": "asked"}), "query")
    scored = exact.select("query", "id", cosine(F.col("embedding"), F.col("asked")).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 9)), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def recall(found: DataFrame, rows: DataFrame, queries: DataFrame, k: int, skip_self: bool = True) -> DataFrame:
    """One row (n_queries, n_exact, recall): the share of the exact k nearest rows that was found, by brute force."""
    exact = knn(rows, queries, k, skip_self=skip_self).select("query", "id")
    hit = exact.join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    return hit.agg(F.countDistinct("query").alias("n_queries"), F.count("*").alias("n_exact"), (F.count("hit") / F.count("*")).alias("recall"))
