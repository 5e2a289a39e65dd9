"""Substring dedup by super-k-mer partitioning.

A window is ``window`` consecutive words. Its minimiser is the smallest hash among its word
trigrams, a function of the window's words alone. Runs of consecutive windows with one minimiser
(super-k-mers) travel as one packed string to the minimiser's bucket, where sorting counts the
windows. A bucket that outgrows memory hands its windows to a second shuffle by window hash, so
that no task ever holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.spark import materialize, row_key
from lectern.llm.words import BLANK_WORDS, Words, chunks, sliding_min, text_buffers, window_hashes

_U = np.uint64
GRAM = 3
#: Windows of one super-k-mer at most; longer runs of one minimiser are cut.
LONGEST = 128
#: Windows of one bucket that a task holds at once.
HELD = 3_000_000
#: Bytes of text for each bucket, and buckets that one task takes, at least.
BUCKET_BYTES, BUCKETS = 6 << 20, 4
_WINDOW = [("h1", "<u8"), ("h2", "<u8"), ("id", "<i8"), ("hash", "<i8"), ("at", "<i4")]


def _pack(batches: Iterator[pa.RecordBatch], window: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Documents to rows (bucket, packed): all super-k-mers of a chunk that go to one bucket, compressed together."""
    press = zstandard.ZstdCompressor(level=3)
    for part in chunks(batches, "text", 6 << 20):
        data, offsets = text_buffers(part.column("text"))
        words = Words(data, offsets, BLANK_WORDS)
        if len(words) < window:
            continue
        grams = window_hashes(words.hashes(1), GRAM, 7)
        least = sliding_min(grams, window - GRAM + 1)
        owner = words.owner()
        whole = owner[: len(least)] == owner[window - 1 : window - 1 + len(least)]
        at = np.flatnonzero(whole)
        if not len(at):
            continue
        new = np.ones(len(at), dtype=bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(least[at]) != 0) | (np.diff(owner[at]) != 0)
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(at)))
        if size.max() > LONGEST:  # cut long runs
            pieces = -(-size // LONGEST)
            step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head, size = np.repeat(head, pieces) + step * LONGEST, np.minimum(np.repeat(size, pieces) - step * LONGEST, LONGEST)
        first, doc = at[head], owner[at[head]]
        bucket = ((least[first] >> _U(20)) % _U(buckets)).astype(np.int64)
        lo, hi = words.start[first], words.end[first + size + window - 2]
        ids = part.column("key_id").to_numpy()[doc]
        hashes = part.column("key_hash").to_numpy()[doc]
        start = (first - words.first[doc]).astype("<i4")
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.diff(bucket[order])) + 1
        raw = words.data.tobytes()
        out_bucket, out_packed = [], []
        for group in np.split(order, cut):
            body = b"".join([raw[a:b] for a, b in zip(lo[group].tolist(), hi[group].tolist(), strict=True)])
            packed = np.array([len(group)], dtype="<i8").tobytes() + ids[group].astype("<i8").tobytes() + hashes[group].astype("<i8").tobytes()
            packed += start[group].tobytes() + (hi - lo)[group].astype("<i4").tobytes() + body
            out_bucket.append(int(bucket[group[0]]))
            out_packed.append(press.compress(packed))
            if len(out_bucket) >= 64:
                yield pa.record_batch([pa.array(out_bucket, pa.int64()), pa.array(out_packed, pa.binary())], ["bucket", "packed"])
                out_bucket, out_packed = [], []
        if out_bucket:
            yield pa.record_batch([pa.array(out_bucket, pa.int64()), pa.array(out_packed, pa.binary())], ["bucket", "packed"])


def _unpack(packed: bytes, window: int) -> np.ndarray:
    """All windows of a packed row: two independent hashes of the words, and where they stand."""
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    ids, hashes = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<i8", n, 8 + 8 * n)
    start, size = np.frombuffer(raw, "<i4", n, 8 + 16 * n), np.frombuffer(raw, "<i4", n, 8 + 20 * n)
    offsets = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    words = Words(np.frombuffer(raw, np.uint8, offset=8 + 24 * n), offsets, BLANK_WORDS)
    h1, h2 = window_hashes(words.hashes(1), window, 11), window_hashes(words.hashes(2), window, 13)
    owner = words.owner()
    at = np.flatnonzero(owner[: len(h1)] == owner[window - 1 : window - 1 + len(h1)])
    out = np.empty(len(at), dtype=_WINDOW)
    own = owner[at]
    out["h1"], out["h2"], out["id"], out["hash"] = h1[at], h2[at], ids[own], hashes[own]
    out["at"] = start[own] + (at - words.first[own])
    return out


def _later(w: np.ndarray) -> np.ndarray:
    """Of windows that occur more than once, all occurrences but the first."""
    order = np.argsort(w["h1"], kind="stable")
    h = w["h1"][order]
    same = h[1:] == h[:-1]
    again = np.zeros(len(h), dtype=bool)
    again[1:] |= same
    again[:-1] |= same
    w = w[order[again]]
    w = w[np.lexsort((w["at"], w["hash"], w["id"], w["h2"], w["h1"]))]
    if not len(w):
        return w
    new = np.ones(len(w), dtype=bool)
    new[1:] = (w["h1"][1:] != w["h1"][:-1]) | (w["h2"][1:] != w["h2"][:-1])
    first = w[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return w[(w["id"] != first["id"]) | (w["hash"] != first["hash"]) | (w["at"] != first["at"])]


def _spans(w: np.ndarray, window: int) -> pa.RecordBatch:
    """Rows (key_id, key_hash, spans): the words that the windows cover, as merged [from, to) pairs of int32."""
    w = w[np.lexsort((w["at"], w["hash"], w["id"]))]
    new = np.ones(len(w), dtype=bool)
    new[1:] = (w["id"][1:] != w["id"][:-1]) | (w["hash"][1:] != w["hash"][:-1])
    gap = new.copy()
    gap[1:] |= w["at"][1:] > w["at"][:-1] + window
    head = np.flatnonzero(gap)
    tail = np.append(head[1:], len(w)) - 1
    pairs = np.stack([w["at"][head], w["at"][tail] + window], axis=1).astype("<i4")
    doc = np.flatnonzero(new[head])
    spans = [pairs[a:b].tobytes() for a, b in zip(doc.tolist(), np.append(doc[1:], len(head)).tolist(), strict=True)]
    none = pa.nulls(len(doc), pa.int64())
    return pa.record_batch([pa.array(w["id"][head[doc]]), pa.array(w["hash"][head[doc]]), pa.array(spans, pa.binary()), none, none, none], _FOUND_NAMES)


_FOUND_NAMES = ["key_id", "key_hash", "spans", "h1", "h2", "at"]
_FOUND = "key_id long, key_hash long, spans binary, h1 long, h2 long, at long"


def _unsettled(w: np.ndarray, window: int) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(w), 100_000):
        x = w[a : a + 100_000]
        spans = np.stack([x["at"], x["at"] + window], axis=1).astype("<i4")
        yield pa.record_batch([pa.array(x["id"]), pa.array(x["hash"]), pa.array([s.tobytes() for s in spans], pa.binary()), pa.array(x["h1"].astype("<i8")), pa.array(x["h2"].astype("<i8")), pa.array(x["at"].astype("<i8"))], _FOUND_NAMES)


def _count(batches: Iterator[pa.RecordBatch], window: int, held: int) -> Iterator[pa.RecordBatch]:
    """Packed rows, sorted by bucket, to the spans of repeated windows; windows of overfull buckets come out unsettled."""
    now, kept, n, over = None, [], 0, False

    def close() -> Iterator[pa.RecordBatch]:
        w = _later(np.concatenate(kept)) if kept else np.empty(0, dtype=_WINDOW)
        if len(w):
            yield _spans(w, window)

    for batch in batches:
        for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed"), strict=True):
            if bucket != now:
                yield from close()
                now, kept, n, over = bucket, [], 0, False
            w = _unpack(packed.as_py(), window)
            n += len(w)
            if not over and n > held:
                over = True
                for x in kept:
                    yield from _unsettled(x, window)
                kept = []
            if over:
                yield from _unsettled(w, window)
            else:
                kept.append(w)
    yield from close()


def _merged(blobs: list[bytes], n: int) -> np.ndarray:
    """True for each of a document's n words that some span covers."""
    step = np.zeros(n + 1, dtype=np.int32)
    pairs = np.frombuffer(b"".join(blobs), dtype="<i4").reshape(-1, 2)
    np.add.at(step, pairs[:, 0], 1)
    np.add.at(step, pairs[:, 1], -1)
    return np.cumsum(step[:n]) > 0


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
            words = (text or "").encode().split()  # bytes split at \x20 and \x09-\x0D, and at nothing else
            n_words.append(len(words))
            if spans:
                gone = _merged(spans, len(words))
                n_removed.append(int(gone.sum()))
                words = [words[i] for i in np.flatnonzero(~gone).tolist()]
            else:
                n_removed.append(0)
            kept.append(b" ".join(words).decode())
        yield pa.record_batch([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def repeated_spans(docs: DataFrame, window: int = 20, buckets: int | None = None, held: int = HELD) -> DataFrame:
    """The word spans covered by windows that also start earlier: rows (key_id, key_hash, spans), several per document.

    ``docs`` has doc_id, text, key_id and key_hash. ``buckets`` defaults to one for each ``BUCKET_BYTES``
    of the measured text, and at least four for each shuffle partition; ``held`` bounds the windows of one bucket in a task's memory, beyond it they are
    settled by a shuffle on the window hash.
    """
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not buckets:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()["size"]
        buckets = max(BUCKETS * least, size // BUCKET_BYTES)
    parts = max(least, buckets // BUCKETS)
    packed = docs.select("key_id", "key_hash", "text").mapInArrow(lambda it: _pack(it, window, buckets), "bucket long, packed binary")
    found = packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _count(it, window, held), _FOUND)
    found = materialize(found, "repeated-spans")
    settled = found.where("h1 IS NULL").select("key_id", "key_hash", "spans")
    rest = found.where("h1 IS NOT NULL")
    place = F.struct("key_id", "key_hash", "at")
    firsts = rest.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    late = rest.join(firsts, ["h1", "h2"]).where(place != F.col("first")).select("key_id", "key_hash", "spans")
    return settled.unionByName(late)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, buckets: int | None = None, held: int = HELD) -> DataFrame:
    """Remove each word covered by a window of ``window`` words that also starts earlier in the corpus.

    Earlier: a smaller id, or the same document and an earlier start; windows are judged on the
    input. Returns (doc_id, n_words, n_removed, kept_text), a row for each input row.

    A null text has no words. A null id sorts last. Rows that repeat id and text are one document:
    each comes back with the same result. Rows that share an id with different texts are ordered by
    a hash of the text. Texts of any length are cut into windows whole. An empty table gives an empty
    result; other columns are ignored. Equality of windows is equality of two independent 64-bit hashes of their words.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *row_key(id_col, text_col))
    spans = repeated_spans(rows, window, buckets, held)
    spans = spans.groupBy("key_id", "key_hash").agg(F.collect_list("spans").alias("spans"))
    joined = rows.join(spans, ["key_id", "key_hash"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_strip, "doc_id long, n_words long, n_removed long, kept_text string")
