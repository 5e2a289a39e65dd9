"""Best-fit packing of token sequences, improved by swap-based local search.

Pieces are dealt to groups of bounded size by a hash, so each group sees the same mix of lengths;
a group is packed best-fit first and then improved: documents move, or are exchanged one for one or
two for one, between underfull bins wherever that raises the sum of squared fills, until bins empty.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.spark import materialize
from lectern.llm.tokens import Encoder
from lectern.llm.words import chunks, text_buffers

#: Pieces of one group: what a task holds at once.
GROUP = 8192
#: Bins in a row that could not be emptied, after which a group's search ends, and steps on one bin.
PATIENCE, STEPS = 24, 200
#: Roomiest bins that are tried for an exchange of two for one.
ROOMIEST = 64
#: A bin with this share of its capacity free goes into the next round, where the open bins of all groups meet.
OPEN = 1 / 32


def best_fit(size: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of piece numbers: the longest pieces first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_: list[int] = []  # room sizes that some bin has, ascending
    for i in np.argsort(-size, kind="stable").tolist():
        n = int(size[i])
        at = bisect.bisect_left(open_, n)
        if at < len(open_):
            room = open_[at]
            b = free[room].pop()
            if not free[room]:
                open_.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = room - n
        if left:
            if not free[left]:
                bisect.insort(open_, left)
            free[left].append(b)
    return bins


def local_search(size: np.ndarray, bins: list[list[int]], capacity: int, patience: int = PATIENCE) -> list[list[int]]:
    """Empty the least filled bins by moves and exchanges that raise the sum of squared fills.

    The search is a heuristic and ends at the least number of bins that could hold all, or once ``patience`` bins in a row
    resist ``STEPS`` steps each. All pieces are always packed; what ending early can cost is bins above that number: 1 to
    5 in 34000 on the tables here.
    """
    if len(bins) < 2:
        return bins
    bins = [list(b) for b in bins]
    fill = np.array([int(size[b].sum()) for b in bins])
    home = np.zeros(len(size), dtype=np.int64)
    for k, b in enumerate(bins):
        home[b] = k
    least = -(-int(size.sum()) // capacity)
    alive, failed, closed = len(bins), 0, np.zeros(len(bins), dtype=bool)
    while alive > least and failed < patience:
        rank = np.where(closed | (fill == 0), capacity + 1, fill)
        donor = int(rank.argmin())
        if rank[donor] > capacity:
            break

        def put(i: int, b: int) -> None:
            fill[home[i]] -= size[i]
            bins[home[i]].remove(i)
            bins[b].append(i)
            fill[b] += size[i]
            home[i] = b

        for _ in range(STEPS):
            if not bins[donor]:
                break
            room = capacity - fill
            room[donor] = -1
            room[(fill == 0)] = -1
            done = False
            for i in sorted(bins[donor], key=lambda i: -size[i]):  # move
                fits = np.flatnonzero(room >= size[i])
                if len(fits):
                    put(i, int(fits[room[fits].argmin()]))
                    done = True
                    break
            if done:
                continue
            slack = np.flatnonzero(room > 0)
            if not len(slack):
                break
            near = np.flatnonzero((room[home] > 0))
            best = (0, -1, -1, -1)
            for i in bins[donor]:  # one for one: the donor keeps the shorter piece
                gain = size[i] - size[near]
                ok = (gain > 0) & (gain <= room[home[near]])
                if ok.any():
                    value = np.where(ok, gain * (fill[home[near]] - fill[donor] + gain), -1)
                    k = int(value.argmax())
                    if value[k] > best[0]:
                        best = (int(value[k]), i, int(near[k]), -1)
            if best[1] < 0:  # two for one: two pieces of another bin come for one
                for b in slack[np.argsort(room[slack])[::-1][:64]].tolist():
                    own = bins[b]
                    for x in range(len(own)):
                        for y in range(x):
                            pair = int(size[own[x]] + size[own[y]])
                            for i in bins[donor]:
                                gain = int(size[i]) - pair
                                if 0 < gain <= room[b] and gain * (fill[b] - fill[donor] + gain) > best[0]:
                                    best = (int(gain * (fill[b] - fill[donor] + gain)), i, own[x], own[y])
            if best[1] < 0:
                break
            _, i, j, k = best
            b = int(home[j])
            for piece in (j, k):
                if piece >= 0:
                    put(piece, donor)
            put(i, b)
        if bins[donor]:
            closed[donor] = True
            failed += 1
        else:
            alive -= 1
            failed = 0
    return [b for b in bins if b]


def pack_lengths(size: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each piece its bin, and its place there."""
    bins = local_search(size, best_fit(size, capacity), capacity)
    home, at = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    for k, b in enumerate(bins):
        home[b] = k
        at[b] = np.cumsum(size[b]) - size[b]
    return home, at


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, capacity: int, end_id: int, with_ids: bool = False) -> Iterator[pa.RecordBatch]:
    encode = Encoder(tokenizer)
    for part in chunks(batches, "text", 8 << 20):
        ids, upto = encode(*text_buffers(part.column("text")))
        owner, number, start, length, crc, held = [], [], [], [], [], []
        tail = np.array([end_id], "<u4").tobytes()
        for doc in range(part.num_rows):
            body = ids[upto[doc] : upto[doc + 1]].tobytes() + tail
            n = len(body) // 4
            cut = n % capacity or capacity
            a, b, k = 0, min(cut, n), 0
            while a < n:
                owner.append(doc)
                number.append(k)
                start.append(a)
                length.append(b - a)
                crc.append(zlib.crc32(body[4 * a : 4 * b]))
                if with_ids:
                    held.append(np.frombuffer(body[4 * a : 4 * b], "<i4"))
                a, b, k = b, b + capacity, k + 1
        columns = [part.column("doc_id").take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int64()) for x in (number, start, length, crc))]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield pa.record_batch([*columns, pa.array(held, pa.list_(pa.int32()))] if with_ids else columns, [*names, "ids"] if with_ids else names)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """Pack all documents, each followed by ``end_id``, into sequences of at most ``capacity`` tokens.

    Only documents longer than a sequence are cut, into pieces of ``capacity`` tokens; their first
    piece takes the remainder. Returns a row per piece: (doc_id, piece, start, length, ids_crc32,
    sequence_id, offset), and ``ids``, the piece's tokens, if ``with_ids``. A null text is empty: one
    piece with ``end_id`` alone. Texts of any length are encoded whole. Rows that repeat, or share an id,
    are packed each; a null id stays null. Pieces of equal length are placed in the order of their rows.
    An empty table packs into nothing. Only lengths are shuffled, never texts. Other columns are ignored,
    also those named like the output's.

    Pieces are packed in groups of about ``group``; then the pieces of all groups' open bins meet in fewer
    groups, until one group holds them or a round saves no sequence.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, piece long, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    pieces = rows.mapInArrow(lambda it: _pieces(it, tokenizer, capacity, end_id, with_ids), schema)
    pieces = materialize(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    placed = _placed(pieces.select("uid", "length"), capacity, group)
    columns = [f.split()[0] for f in schema.split(", ")]
    return pieces.join(placed, "uid").select(*columns, "sequence_id", "offset")


def _placer(capacity: int, turn: int):
    """One group's packing: (uid, length, sequence_id, offset, room of the sequence)."""

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", ignore_index=True)
        size = pdf["length"].to_numpy()
        home, at = pack_lengths(size, capacity)
        room = capacity - np.bincount(home, size).astype(np.int64)[home]
        number = (((turn << 31) + key[0]) << 24) + home  # of its round and group; odd, as full pieces have even ones
        return pd.DataFrame({"uid": pdf["uid"], "length": size, "sequence_id": number * 2 + 1, "offset": at, "room": room})

    return place


def _placed(lengths: DataFrame, capacity: int, group: int) -> DataFrame:
    """(uid, sequence_id, offset) of pieces (uid, length); full ones are sequences of their own."""
    full = F.col("length") == capacity
    done = lengths.where(full).select("uid", (F.col("uid") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo, count, turn = lengths.where(~full), lengths.where(~full).count(), 0
    while True:
        groups = max(1, math.ceil(count / group))
        dealt = todo.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(groups)))
        packed = dealt.groupBy("part").applyInPandas(_placer(capacity, turn), "uid long, length long, sequence_id long, offset long, room long")
        if groups == 1:
            return done.unionByName(packed.select("uid", "sequence_id", "offset"))
        packed = materialize(packed, "packed")
        is_open = F.col("room") > capacity * OPEN
        now = packed.agg(F.count_if(is_open).alias("n"), F.count_distinct(F.when(is_open, F.col("sequence_id"))).alias("bins")).first()
        if not now["n"] or now["n"] >= count:  # nothing is closed any more
            return done.unionByName(packed.select("uid", "sequence_id", "offset"))
        done = done.unionByName(packed.where(~is_open).select("uid", "sequence_id", "offset"))
        todo, count, turn = packed.where(is_open).select("uid", "length"), now["n"], turn + 1
