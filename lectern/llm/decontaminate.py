"""Benchmark decontamination by winnowing.

Of each ``window`` consecutive words, the k-gram with the smallest hash is a fingerprint. Two texts
that share a span of ``window`` words share the fingerprint of that span, so the join of training
and test fingerprints misses none; each hit is then extended to the whole window and verified by
two independent hashes of its words. Items shorter than a window are one window of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.spark import free_name, materialize
from lectern.llm.words import ALNUM_WORDS, Words, chunks, sliding_min, text_buffers, window_hashes, window_hashes_at

GRAM = 5
#: Windows of the benchmark up to which they go to every task (36 bytes each, and an item's name once); beyond it they are shuffled.
BROADCAST_WINDOWS = 1_000_000
_REPORT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _batch_words(batch: pa.RecordBatch) -> Words:
    data, offsets = text_buffers(batch.column("text"))
    return Words(data, offsets, ALNUM_WORDS, lower=True)


def _inside(words: Words, n: int, count: int) -> np.ndarray:
    """True for each of ``count`` window starts whose n words belong to one text."""
    owner = words.owner()
    return owner[:count] == owner[n - 1 : n - 1 + count]


def _fingerprints(h1: np.ndarray, window: int) -> np.ndarray:
    """For each window start, the smallest k-gram hash inside the window."""
    k = min(GRAM, window)
    return sliding_min(window_hashes(h1, k, 17), window - k + 1)


def _item_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Benchmark items to their windows: (item, n, print, h1, h2)."""
    for part in chunks(batches, "text"):
        words = _batch_words(part)
        a, b = words.hashes(1), words.hashes(2)
        size = np.diff(words.first)
        for n in np.unique(np.minimum(size, window)).tolist():
            if n == 0:
                continue
            h1, h2, prints = window_hashes(a, n, 19), window_hashes(b, n, 23), _fingerprints(a, n)
            ok = _inside(words, n, len(h1))
            owner = words.owner()[: len(h1)]
            ok &= (size[owner] >= window) if n == window else (size[owner] == n)
            at = np.flatnonzero(ok)
            yield pa.record_batch(
                [part.column("item").take(pa.array(owner[at])), pa.array(np.full(len(at), n)), pa.array(prints[at].astype("<i8")), pa.array(h1[at].astype("<i8")), pa.array(h2[at].astype("<i8"))],
                ["item", "n", "print", "h1", "h2"],
            )


_ITEM = "item string, n long, print long, h1 long, h2 long"


class _Index:
    """The benchmark's windows in sorted arrays."""

    def __init__(self, names: list[str], code: np.ndarray, n: np.ndarray, prints: np.ndarray, h1: np.ndarray, h2: np.ndarray):
        self.names, self.code, self.by_size = names, code, {}
        for size in np.unique(n).tolist():
            own = np.flatnonzero(n == size)
            own = own[np.argsort(h1[own], kind="stable")]
            self.by_size[size] = (np.unique(prints[own]), h1[own], h2[own], own)

    def hits(self, words: Words, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(word, item row, n) of each place where a benchmark window stands."""
        for n, (prints, h1, h2, own) in self.by_size.items():
            found = _fingerprints(a, n)
            if not len(found):
                continue
            near = np.searchsorted(prints, found)
            near[near == len(prints)] = 0
            at = np.flatnonzero((prints[near] == found) & _inside(words, n, len(found)))
            if not len(at):
                continue
            at1, at2 = window_hashes_at(a, at, n, 19), window_hashes_at(b, at, n, 23)
            lo, hi = np.searchsorted(h1, at1, "left"), np.searchsorted(h1, at1, "right")
            many = hi - lo
            where = np.repeat(np.arange(len(at)), many)
            row = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
            same = h2[row] == at2[where]
            yield at[where[same]], own[row[same]], n


def _report(sizes: np.ndarray, hit: np.ndarray, items: list[list[str]]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string()))], ["n_words", "n_hit", "items"])


def _covered(words: Words, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each text, how many of its words lie in [at, at + n) of some window."""
    step = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    total = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
    return np.diff(total[words.first])


def _scan(batches: Iterator[pa.RecordBatch], index: _Index, text_col: str, out: str) -> Iterator[pa.RecordBatch]:
    """Documents, with all their columns and their report."""
    for part in chunks(batches, text_col):
        data, offsets = text_buffers(part.column(text_col))
        words = Words(data, offsets, ALNUM_WORDS, lower=True)
        items: list[list[str]] = [[] for _ in range(part.num_rows)]
        at, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        a, b = words.hashes(1), words.hashes(2)
        owner = words.owner()
        for where, row, n in index.hits(words, a, b):
            at.append(where)
            size.append(np.full(len(where), n))
            pairs = np.unique(np.stack([owner[where], index.code[row]], axis=1), axis=0)
            for doc, code in pairs.tolist():
                items[doc].append(index.names[code])
        hit = _covered(words, np.concatenate(at), np.concatenate(size))
        report = _report(np.diff(words.first), hit, [sorted(set(x)) for x in items])
        yield pa.record_batch([*part.columns, report], [*part.schema.names, out])


def _prints(batches: Iterator[pa.RecordBatch], window: int, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """Documents to their distinct fingerprints, for windows of each size."""
    for part in chunks(batches, "text"):
        words = _batch_words(part)
        a, owner = words.hashes(1), words.owner()
        for n in sizes:
            found = _fingerprints(a, n)
            at = np.flatnonzero(_inside(words, n, len(found)))
            pairs = np.unique(np.rec.fromarrays([owner[at], found[at]], names="doc,print"))
            doc = pa.array(pairs["doc"])
            yield pa.record_batch([part.column("key_id").take(doc), part.column("key_hash").take(doc), pa.array(np.full(len(pairs), n)), pa.array(pairs["print"].astype("<i8"))], ["key_id", "key_hash", "n", "print"])


def _doc_windows(batches: Iterator[pa.RecordBatch], sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """Documents to all their windows."""
    for part in chunks(batches, "text", 1 << 20):
        words = _batch_words(part)
        a, b, owner = words.hashes(1), words.hashes(2), words.owner()
        for n in sizes:
            h1, h2 = window_hashes(a, n, 19), window_hashes(b, n, 23)
            at = np.flatnonzero(_inside(words, n, len(h1)))
            doc = owner[at]
            yield pa.record_batch(
                [part.column("key_id").take(pa.array(doc)), part.column("key_hash").take(pa.array(doc)), pa.array(at - words.first[doc]), pa.array(np.full(len(at), n)), pa.array(h1[at].astype("<i8")), pa.array(h2[at].astype("<i8"))],
                ["key_id", "key_hash", "at", "n", "h1", "h2"],
            )


def _fill(batches: Iterator[pa.RecordBatch], text_col: str, hits: str, out: str) -> Iterator[pa.RecordBatch]:
    """Documents and their joined hits to documents and their report."""
    for part in chunks(batches, text_col):
        data, offsets = text_buffers(part.column(text_col))
        words = Words(data, offsets, ALNUM_WORDS, lower=True)
        at, size, items = [], [], []
        for doc, found in enumerate(part.column(hits).to_pylist()):
            items.append(sorted(found["items"]) if found else [])
            for place in found["places"] if found else ():
                at.append(int(words.first[doc]) + place["at"])
                size.append(place["n"])
        report = _report(np.diff(words.first), _covered(words, np.array(at, np.int64), np.array(size, np.int64)), items)
        rest = [(c, x) for c, x in zip(part.schema.names, part.columns, strict=True) if c != hits]
        yield pa.record_batch([*(x for _, x in rest), report], [*(c for c, _ in rest), out])


def _shuffled(docs: DataFrame, items: DataFrame, text_col: str, out: str, window: int) -> DataFrame:
    """The report by joins on the fingerprints and then on the windows: for benchmarks of any size."""
    sizes = sorted(r["n"] for r in items.select("n").distinct().collect())
    id_name, hash_name, hits_name = (free_name(docs, c) for c in ("key_id", "key_hash", "hits"))
    keyed = docs.select("*", F.lit(0).cast("long").alias(id_name), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias(hash_name))
    texts = docs.select(F.lit(0).cast("long").alias("key_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key_hash"), F.col(text_col).alias("text"))
    prints = texts.mapInArrow(lambda it: _prints(it, window, sizes), "key_id long, key_hash long, n long, print long")
    near = prints.join(items.select("n", "print").distinct(), ["n", "print"], "left_semi").select("key_id", "key_hash").distinct()
    places = texts.dropDuplicates(["key_id", "key_hash"]).join(near, ["key_id", "key_hash"], "left_semi")
    places = places.mapInArrow(lambda it: _doc_windows(it, sizes), "key_id long, key_hash long, at long, n long, h1 long, h2 long")
    hits = places.join(items.select("n", "h1", "h2", "item").distinct(), ["n", "h1", "h2"])
    hits = hits.groupBy("key_id", "key_hash").agg(F.struct(F.collect_set(F.struct("at", "n")).alias("places"), F.collect_set("item").alias("items")).alias(hits_name))
    hits = hits.withColumnsRenamed({"key_id": id_name, "key_hash": hash_name})
    joined = keyed.join(hits, [id_name, hash_name], "left").select(*(F.col(f"`{c}`") for c in docs.columns), hits_name)
    return joined.mapInArrow(lambda it: _fill(it, text_col, hits_name, out), T.StructType([*docs.schema.fields, T.StructField(out, _REPORT)]))


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, broadcast_windows: int = BROADCAST_WINDOWS) -> tuple[DataFrame, str]:
    """All columns of ``docs`` and a struct (n_words, n_hit, items), and that struct's name.

    A word is hit if it lies in an occurrence of a window of some item. A benchmark of up to
    ``broadcast_windows`` distinct windows (counted, not assumed) goes to every task and the documents
    are not shuffled; a larger one is joined by shuffles on fingerprints and windows. Texts of any length
    are searched whole.

    Null texts have no words, on either side; an item without words has no window; a null item id
    is named ``null``. Items that repeat an id count as one; rows that repeat are reported each. An
    empty benchmark hits nothing. Extra columns pass through; the struct's name avoids theirs.
    """
    out = free_name(docs, "contamination")
    bench = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("text"))
    items = materialize(bench.mapInArrow(lambda it: _item_windows(it, window), _ITEM).distinct(), "item-windows")
    if items.count() > broadcast_windows:
        return _shuffled(docs, items, text_col, out, window), out
    table = items.toArrow()
    coded = table["item"].combine_chunks().dictionary_encode() if table.num_rows else pa.array([], pa.string()).dictionary_encode()
    order = sorted(range(len(coded.dictionary)), key=lambda k: coded.dictionary[k].as_py())
    names, codes = [coded.dictionary[k].as_py() for k in order], np.argsort(order)[np.asarray(coded.indices)] if len(coded) else np.zeros(0, np.int64)
    columns = [table[c].to_numpy().view(t) for c, t in (("n", "<i8"), ("print", "<u8"), ("h1", "<u8"), ("h2", "<u8"))]
    index = docs.sparkSession.sparkContext.broadcast(_Index(names, codes, *columns))
    return docs.mapInArrow(lambda it: _scan(it, index.value, text_col, out), T.StructType([*docs.schema.fields, T.StructField(out, _REPORT)])), out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with their columns; options as in ``contamination``.

    Null and empty texts stay, rows that repeat stay or go together, an empty table or benchmark changes nothing.
    """
    scanned, out = contamination(docs, benchmark, **options)
    return scanned.where(F.col(f"`{out}`.n_hit") == 0).select(*(F.col(f"`{c}`") for c in docs.columns))
