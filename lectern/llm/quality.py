"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score is sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise part takes time
linear in the features by the identity  sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).
Features: words hashed to ``2**WORD_BITS`` buckets (log counts, unit norm), structure statistics and
the text's length, each one-hot in quantile bins. Source, language, id and labels are no features.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.labelled import fold_of, labelled_sample
from lectern.llm.spark import free_name
from lectern.llm.textstats import NAMES, structure
from lectern.llm.words import chunks

WORD_BITS = 13
BINS = 10
FACTORS = 8
#: Labelled rows that the machine is fitted on, at most, and their counted words in all (12 bytes each in the one task that fits).
FIT_ROWS, FIT_COUNTS = 20_000, 16_000_000


@dataclass
class Features:
    """Sparse rows: values ``x`` at columns ``j``, those of row i in ``first[i]:first[i+1]``."""

    j: np.ndarray
    x: np.ndarray
    first: np.ndarray


@dataclass
class Machine:
    """A fitted factorisation machine; ``edges`` are the quantile bins of the statistics."""

    edges: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, f: Features) -> np.ndarray:
        rows = len(f.first) - 1
        owner = np.repeat(np.arange(rows), np.diff(f.first))
        v = self.factors[f.j] * f.x[:, None]
        sums = np.stack([np.bincount(owner, v[:, k], rows) for k in range(v.shape[1])], axis=1)
        squares = np.bincount(owner, (v * v).sum(axis=1), rows)
        z = self.bias + np.bincount(owner, self.linear[f.j] * f.x, rows) + 0.5 * ((sums * sums).sum(axis=1) - squares)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def word_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Structure statistics, and (text, bucket, count) of the hashed words."""
    rows, words, h = structure(column)
    key = (words.owner() << WORD_BITS) | (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    return rows, key >> WORD_BITS, key & ((1 << WORD_BITS) - 1), count


def assemble(rows: np.ndarray, doc: np.ndarray, bucket: np.ndarray, count: np.ndarray, edges: np.ndarray) -> Features:
    """Feature rows from statistics and counted words."""
    n, d = rows.shape
    x = np.log1p(count)
    norm = np.sqrt(np.bincount(doc, x * x, n))
    x = x / np.maximum(norm[doc], 1e-9)
    bins = np.stack([np.searchsorted(edges[k], rows[:, k], side="right") for k in range(d)], axis=1)
    many = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(many + d)])
    j, values = np.empty(first[-1], np.int32), np.ones(first[-1])
    word = np.arange(len(doc)) + d * doc  # texts are in order
    j[word], values[word] = bucket, x
    j[(first[1:, None] - d + np.arange(d)).reshape(-1)] = ((1 << WORD_BITS) + np.arange(d) * BINS + bins).reshape(-1)
    return Features(j, values, first)


def fit_machine(rows: np.ndarray, doc: np.ndarray, bucket: np.ndarray, count: np.ndarray, label: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.08, decay: float = 1e-4, seed: int = 5) -> Machine:
    """AdaGrad on the logistic loss, classes weighted alike within a factor of 3."""
    edges = np.quantile(rows, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(rows) else np.zeros((rows.shape[1], BINS - 1))
    upto = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(rows)))])
    rng, width = np.random.default_rng(seed), (1 << WORD_BITS) + rows.shape[1] * BINS
    rate_one = label.mean() if len(label) else 0.5
    machine = Machine(edges, float(np.log((rate_one + 1e-3) / (1 - rate_one + 1e-3))), np.zeros(width), rng.normal(0, 0.01, (width, FACTORS)))
    if not len(label) or label.min() == label.max():
        return machine
    weight = np.where(label == 1, 1.0, min(3.0, rate_one / (1 - rate_one)) if rate_one > 0.5 else 1.0) * np.where(label == 0, 1.0, min(3.0, (1 - rate_one) / rate_one) if rate_one < 0.5 else 1.0)
    g_bias, g_linear, g_factors = 1e-8, np.full(width, 1e-8), np.full((width, FACTORS), 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            size = upto[own + 1] - upto[own]
            at = np.repeat(upto[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            part = assemble(rows[own], np.repeat(np.arange(len(own)), size), bucket[at], count[at], edges)  # a batch at a time: the sample stays as counts
            j, x, owner = part.j, part.x, np.repeat(np.arange(len(own)), np.diff(part.first))
            v = machine.factors[j]
            sums = np.stack([np.bincount(owner, v[:, k] * x, len(own)) for k in range(FACTORS)], axis=1)
            error = (machine.scores(part) - label[own]) * weight[own]
            step = error[owner] * x
            columns, where = np.unique(j, return_inverse=True)
            d_linear = np.bincount(where, step, len(columns)) / len(own) + decay * machine.linear[columns]
            d_v = step[:, None] * (sums[owner] - v * x[:, None])
            d_factors = np.stack([np.bincount(where, d_v[:, k], len(columns)) for k in range(FACTORS)], axis=1) / len(own) + decay * machine.factors[columns]
            d_bias = error.mean()
            g_bias += d_bias**2
            g_linear[columns] += d_linear**2
            g_factors[columns] += d_factors**2
            machine.bias -= rate * d_bias / np.sqrt(g_bias)
            machine.linear[columns] -= rate * d_linear / np.sqrt(g_linear[columns])
            machine.factors[columns] -= rate * d_factors / np.sqrt(g_factors[columns])
    return machine


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        rows, doc, bucket, count = word_counts(part.column("text"))
        upto = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
        listed = lambda x: pa.ListArray.from_arrays(pa.array(upto), pa.array(x.astype(np.int32)))
        stats = pa.FixedSizeListArray.from_arrays(pa.array(rows.reshape(-1)), rows.shape[1]).cast(pa.list_(pa.float64()))
        yield pa.record_batch([part.column("doc_id"), part.column("label"), stats, listed(bucket), listed(count)], ["doc_id", "label", "stats", "bucket", "count"])


def _fit_in_task(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """All feature rows, in order, to one row: the pickled machine. Rows beyond ``most`` counted words are not learned from."""
    seen, kept = 0, []
    for batch in batches:
        size = np.asarray(batch.column("bucket").value_lengths()).astype(np.int64)
        if not len(size):
            continue
        n = int(np.searchsorted(seen + np.cumsum(size), most, side="right"))
        flat = lambda c, n=n, batch=batch: np.asarray(batch.column(c).slice(0, n).flatten())
        kept.append((flat("stats").reshape(n, len(NAMES)), size[:n], flat("bucket"), flat("count"), np.asarray(batch.column("label").slice(0, n))))
        seen += int(size.sum())
        if n < len(size):
            break
    none = (np.zeros((0, len(NAMES))), *(np.zeros(0, np.int32) for _ in range(3)), np.zeros(0))
    rows, size, bucket, count, label = (np.concatenate(x) for x in zip(*(kept or [none]), strict=True))
    kept.clear()
    machine = fit_machine(rows, np.repeat(np.arange(len(rows), dtype=np.int32), size), bucket, count, label)
    yield pa.record_batch([pa.array([pickle.dumps(machine)], pa.binary())], ["machine"])


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = FIT_ROWS, folds: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text", most_counts: int = FIT_COUNTS) -> Machine:
    """Fit on up to ``most`` labelled rows outside the held-out fold (``crc32(id) mod folds == held_out``).

    Tasks compute the features, and one task fits the machine on the sample's word counts, in the order of the ids; the
    driver gets the machine alone. Texts are counted whole; of a sample of more than ``most_counts`` distinct words by
    text, the rows after that many are not learned from. Null texts count as empty, an id of several rows is left out.
    Without labels, or with one class only, the score is the (smoothed) share of that class, 0.5 of none at all.
    """
    sample = labelled_sample(docs, labels, label, most, folds, held_out, id_col, text_col)
    counted = sample.mapInArrow(_sample_features, "doc_id long, label double, stats array<double>, bucket array<int>, count array<int>")
    fitted = counted.repartition(1).sortWithinPartitions("doc_id").mapInArrow(lambda it: _fit_in_task(it, most_counts), "machine binary").collect()  # one row of fixed size
    return pickle.loads(fitted[0]["machine"]) if fitted else pickle.loads(next(_fit_in_task(iter(()), most_counts)).column("machine")[0].as_py())


def score_quality(docs: DataFrame, machine: Machine, text_col: str = "text") -> tuple[DataFrame, str]:
    """All columns of ``docs`` and a score from 0 to 1, and the score's name.

    Null and empty texts are scored by their (empty) statistics, texts of any length whole. Rows that
    repeat get the same score, so ties stay ties. An empty table gives an empty result. Extra columns
    pass through; the score's name avoids theirs.
    """
    out = free_name(docs, "score")
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text_col):
            rows, doc, bucket, count = word_counts(part.column(text_col))
            scores = sent.value.scores(assemble(rows, doc, bucket, count, sent.value.edges))
            yield pa.record_batch([*part.columns, pa.array(scores)], [*part.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])), out


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text_col: str = "text", **options) -> DataFrame:
    """The documents that score at least ``threshold``, with their columns.

    A score of exactly ``threshold`` stays. Null and empty texts are scored as ``score_quality`` says and
    may go; rows that repeat stay or go together; an empty table, or one without labels, gives what its
    (constant) score gives.
    """
    scored, out = score_quality(docs, fit_quality(docs, labels, text_col=text_col, **options), text_col)
    return scored.where(F.col(f"`{out}`") >= threshold).select(*(F.col(f"`{c}`") for c in docs.columns))


__all__ = ["Machine", "fit_quality", "fold_of", "quality_filter", "score_quality"]
