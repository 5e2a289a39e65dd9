"""MinHash near-dedup of multisets of word shingles by BagMinHash.

Each distinct shingle with count w owns Poisson processes over the discretised weights (0, 1], (1, 2],
(2, 4], (4, 8], ...: a point has a time, a slot of the signature and a weight, and counts where its
weight is at most w. The earliest point of each slot is the signature; two documents agree in a slot
with probability equal to their weighted Jaccard similarity. A process stops at the time by which
all slots are likely filled; documents with a slot left go on. Signatures are banded, candidates are
verified by the exact overlap of the multisets.

Texts that are equal form a class and are signed once. Classes are verified against one hub each at
first (the member of their buckets that shares most buckets), then across the components that
remain, so that groups of copies cost links in proportion to their size. What is left apart in a
bucket is settled exactly by a prefix join with a positional bound: two multisets of that similarity
share one of their rarest shingles early enough in both, so documents that have only common
passages in common never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.components import connected_components
from lectern.llm.spark import NULL_ID, free_name, materialize
from lectern.llm.words import ALNUM_WORDS, Words, chunks, mix, text_buffers, window_hashes_at

SHINGLE = 5
BANDS, ROWS = 40, 5
_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


def shingles(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count) of the distinct shingles, in order; a text of fewer than k words is one shingle."""
    data, offsets = text_buffers(column)
    words = Words(data, offsets, ALNUM_WORDS, lower=True)
    h, size = words.hashes(41), np.diff(words.first)
    owner = words.owner()
    at = np.arange(len(h))
    at = at[(at + k <= words.first[owner + 1])] if len(h) else at
    out, doc = [window_hashes_at(h, at, k, 43)], [owner[at]]
    for n in range(1, k):
        short = np.flatnonzero(size == n)
        out.append(window_hashes_at(h, words.first[short], n, 47 + n))
        doc.append(short)
    key, text = np.concatenate(out), np.concatenate(doc)
    order = np.lexsort((key, text))
    key, text = key[order], text[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    return text[head], key[head], np.diff(np.append(head, len(key)))


def _uniform(x: np.ndarray) -> np.ndarray:
    """From hashes to (0, 1]."""
    return ((x >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(text: np.ndarray, key: np.ndarray, count: np.ndarray, n: int, m: int) -> np.ndarray:
    """BagMinHash: for each of n texts and m slots, the time of the slot's earliest point (inf for empty texts)."""
    best = np.full(n * m, np.inf)
    weight = np.bincount(text, count, n)
    owner, seed, rate, low, most = [], [], [], [], []
    level, own = 0, np.arange(len(key))
    while len(own):
        floor = 0 if level == 0 else 1 << (level - 1)
        owner.append(text[own])
        seed.append(mix(key[own] ^ _U((level + 1) * 0x9E3779B97F4A7C15 % 2**64)))
        rate.append(np.full(len(own), float(max(1, floor)) * m))
        low.append(np.full(len(own), floor))
        most.append(count[own])
        level += 1
        own = own[count[own] > (1 << (level - 1))]
    if not owner:
        return best.reshape(n, m)
    owner, seed, rate, low, most = (np.concatenate(x) for x in (owner, seed, rate, low, most))
    state = mix(seed.astype(_U))  # of each process's next point
    time = -np.log(_uniform(state)) / rate
    reach, streams = 7.0, np.arange(len(owner))
    while len(streams):
        stop = reach / np.maximum(weight, 1e-9)
        live = streams[time[streams] <= stop[owner[streams]]]
        while len(live):
            spot = mix(state[live] ^ _U(0xA5A5A5A5A5A5A5A5))
            slot = ((spot >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
            height = low[live] + 1 + ((spot & _U(0xFFFFFFFF)) * np.maximum(low[live], 1).astype(_U) >> _U(32)).astype(np.int64)
            ok = height <= most[live]
            np.minimum.at(best, owner[live[ok]] * m + slot[ok], time[live[ok]])
            state[live] = mix(state[live] + _GOLD)
            time[live] -= np.log(_uniform(state[live])) / rate[live]
            live = live[time[live] <= stop[owner[live]]]
        unfilled = np.isinf(best.reshape(n, m)).any(axis=1)
        streams = streams[unfilled[owner[streams]]]
        reach *= 2
    return best.reshape(n, m)


def band_keys(best: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A bucket for each band of each signature; the band is part of the bucket."""
    bits = best.view(_U).reshape(len(best), bands, rows)
    h = np.zeros((len(best), bands), dtype=_U) + (np.arange(bands, dtype=_U) + _U(1)) * _GOLD
    for k in range(rows):
        h = mix((h ^ bits[:, :, k]) * _U(0xD6E8FEB86659FD93))
    return h


def _sign(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        text, key, count = shingles(part.column("text"))
        n = part.num_rows
        size = np.bincount(text, count, n).astype(np.int64)
        buckets = band_keys(signatures(text, key, count, n, bands * rows), bands, rows).astype("<i8")
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(buckets.reshape(-1)))
        yield pa.record_batch([part.column("id"), part.column("k1"), part.column("k2"), pa.array(size), lists], ["id", "k1", "k2", "size", "buckets"])


def overlap(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of texts: the size of the multisets' intersection and of their union."""
    n = len(a)
    (ta, ka, ca), (tb, kb, cb) = shingles(a), shingles(b)
    text, key, count = np.concatenate([ta, tb]), np.concatenate([ka, kb]), np.concatenate([ca, cb])
    order = np.lexsort((key, text))
    text, key, count = text[order], key[order], count[order]
    same = np.flatnonzero((text[1:] == text[:-1]) & (key[1:] == key[:-1]))
    both = np.bincount(text[same], np.minimum(count[same], count[same + 1]), n).astype(np.int64)
    return both, np.bincount(text, count, n).astype(np.int64) - both


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            both, union = overlap(part.column("text_a"), part.column("text_b"))
            ok = (union > 0) & (both >= threshold * union - 1e-9)
            yield pa.record_batch([part.column("a"), part.column("b"), pa.array(ok)], ["a", "b", "linked"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to rows (cid, token): a token is a shingle and the number of its copy."""
    for part in chunks(batches, "text", 1 << 20):
        text, key, count = shingles(part.column("text"))
        copy = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        token = mix(np.repeat(key, count) + copy.astype(_U) * _GOLD)
        yield pa.record_batch([part.column("cid").take(pa.array(np.repeat(text, count))), pa.array(token.astype("<i8"))], ["cid", "token"])


def _prefix_pairs(apart: DataFrame, texts: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different components that share one of their rarest tokens; misses no pair of the threshold.

    Tokens are ordered by how many of the documents hold them. A document of n tokens has at least
    ``threshold * n`` of them in common with a similar one, so its first n - ceil(threshold * n) + 1
    hold a common one; and where the first common token stands bounds what can follow.
    """
    tokens = texts.join(apart, "cid", "left_semi").mapInArrow(_tokens, "cid long, token long")
    held = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    place = F.row_number().over(Window.partitionBy("cid").orderBy("held", "token"))
    first = tokens.join(held, "token").withColumn("place", place).join(sizes, "cid")
    first = first.where((F.col("held") > 1) & (F.col("place") <= F.col("size") - F.ceil(threshold * F.col("size") - 1e-9) + 1)).select("cid", "token", "size", "place").join(apart, "cid")
    first = materialize(first, "prefixes")
    mixed = first.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    first = first.join(mixed, "token")
    other = first.select("token", F.col("cid").alias("other"), F.col("component").alias("theirs"), F.col("size").alias("size_b"), F.col("place").alias("place_b"))
    needed = threshold / (1 + threshold) * (F.col("size") + F.col("size_b")) - 1e-9
    reach = F.least(F.col("size") - F.col("place"), F.col("size_b") - F.col("place_b")) + 1
    return first.join(other, "token").where((F.col("component") < F.col("theirs")) & (reach >= needed)).select(F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b"))


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, linked) of distinct pairs of classes."""
    joined = pairs.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b")
    joined = joined.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a")
    return materialize(joined.select("a", "b", "text_a", "text_b").mapInArrow(lambda it: _verify(it, threshold), "a long, b long, linked boolean"), "verified")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Classes of near-duplicates: (doc_id, class_id, n_verified_links, kept, k1, k2), a row for each input row.

    Documents link where the multisets of their 5-word shingles (words of letters and digits, A-Z
    lower-cased) have a Jaccard similarity of at least ``threshold``; ``class_id`` is the smallest id
    reachable by links, ``kept`` marks one row of each class: that id's. ``n_verified_links`` counts
    those links of the row's text that were verified on the way to its class; links inside a class that
    no verification needed are not among them. k1 and k2 are hashes of the text.

    Null and empty texts, and texts without words, link with nothing. A text of fewer than five
    words is one shingle. Null ids sort last; a null id's class is named by the smallest id of the
    class, or null. Rows that repeat id and text are one document: all are kept or none. Empty
    tables give empty results; other columns are ignored. Texts of any length are shingled whole; rows
    that tie for the smallest id of a class are told apart by their text's hash. With 40 bands of 5 rows a pair at the
    threshold is missed with a probability of 1e-7.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text"))
    signed = materialize(source.mapInArrow(lambda it: _sign(it, bands, rows), "id long, k1 long, k2 long, size long, buckets array<long>"), "signed")
    classes = signed.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.first("size").alias("size"), F.first("buckets").alias("buckets"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    placed = classes.where("size > 0").select("cid", F.explode("buckets").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(placed.join(shared, "bucket"), "shared")
    score = members.groupBy("cid").agg(F.sum("n").alias("score"))
    members = materialize(members.select("bucket", "cid").join(score, "cid"), "members")
    rank = F.struct("score", (-F.col("cid")).alias("order"))

    needed = members.select("cid").distinct().join(classes.select("cid", "k1", "k2", "id"), "cid")
    texts = source.join(needed, ["k1", "k2", "id"]).select("cid", "text").dropDuplicates(["cid"])
    texts = materialize(texts, "texts")

    hubs = members.groupBy("bucket").agg(F.max(rank).alias("hub"))
    first = members.join(hubs, "bucket").groupBy("cid").agg((-F.max("hub")["order"]).alias("hub")).where("cid <> hub")
    first = first.select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b")).distinct()
    tested = _verified(first, texts, threshold)
    sizes = classes.select("cid", "size")
    found = connected_components(tested.where("linked"))
    for step in ("across", "rest"):
        state = members.join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        split = state.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
        state = state.join(split.select("bucket"), "bucket")
        if step == "across":
            heads = state.groupBy("bucket", "component").agg(F.max(rank).alias("r"))
            main = heads.groupBy("bucket").agg((-F.max("r")["order"]).alias("main"))
            pairs = heads.select("bucket", (-F.col("r.order")).alias("head")).join(main, "bucket").where("head <> main").select(F.least("main", "head").alias("a"), F.greatest("main", "head").alias("b"))
        else:
            apart = materialize(state.select("cid", "component").distinct(), "apart")
            pairs = _prefix_pairs(apart, texts, sizes, threshold)
        pairs = pairs.distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
        pairs = pairs.join(sizes.withColumnsRenamed({"cid": "a", "size": "size_a"}), "a").join(sizes.withColumnsRenamed({"cid": "b", "size": "size_b"}), "b")
        # of different sizes, a similarity of the threshold is out of reach
        pairs = pairs.where(F.least("size_a", "size_b") >= threshold * F.greatest("size_a", "size_b") - 1e-9).select("a", "b")
        more = _verified(pairs, texts, threshold)
        tested = tested.unionByName(more)
        if not more.where("linked").isEmpty():  # what is joined already goes on as stars
            stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
            found = connected_components(stars.unionByName(more.where("linked").select("a", "b")))
    links = materialize(tested.where("linked").select("a", "b"), "near-links")
    found = found.withColumnRenamed("node", "cid")
    counts = links.select("a").unionByName(links.select(F.col("b").alias("a"))).groupBy(F.col("a").alias("cid")).agg(F.count(F.lit(1)).alias("n_links"))
    named = classes.select("cid", "k1", "k2", "id").join(found, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min_by(F.struct("id", "cid"), F.struct("id", "k1", "k2")).alias("least"))
    named = named.join(least, "component").join(counts, "cid", "left")
    named = named.select("k1", "k2", F.col("least.id").alias("class_id"), (F.col("cid") == F.col("least.cid")).alias("leads"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    empty = F.col("size") == 0
    real = lambda c: F.when(c != NULL_ID, c)
    joined = signed.select("id", "k1", "k2", "size").join(named, ["k1", "k2"])
    return joined.select(
        real(F.col("id")).alias("doc_id"),
        real(F.when(empty, F.col("id")).otherwise(F.col("class_id"))).alias("class_id"),
        F.when(empty, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_verified_links"),
        (empty | (F.col("leads") & (F.col("id") == F.col("class_id")))).alias("kept"),
        "k1",
        "k2",
    )


def minhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that are kept, one of each class, with their columns; of rows that repeat id and text, one.

    Null, empty and wordless texts are classes of their own and stay, one row for each id; null ids sort last; an empty
    table gives an empty result.
    """
    kept = near_duplicates(docs, id_col, text_col, **options).where("kept").select("doc_id", "k1", "k2").distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = [F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), F.xxhash64(text), F.xxhash64(F.lit(1), text)]
    names = [free_name(docs, n) for n in ("key_id", "key_1", "key_2")]
    kept = kept.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias(names[0]), F.col("k1").alias(names[1]), F.col("k2").alias(names[2]))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(*columns, *(k.alias(n) for k, n in zip(keys, names, strict=True)))
    return keyed.join(kept, names, "left_semi").dropDuplicates(names).select(*columns)
