"""Repeats and overlaps of word lists: the words of an Arrow batch are numbered once, and counted by sorting the numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _lengths(words: pa.ListArray) -> np.ndarray:
    return np.asarray(words.value_lengths().fill_null(0)).astype(np.int64)


def _numbers(*lists: pa.ListArray) -> tuple[list[np.ndarray], int]:
    """The words of each list column as whole numbers, alike for equal words, and how many there are."""
    flat = [x.flatten() for x in lists]
    coded = pa.concat_arrays(flat).dictionary_encode()
    return np.split(np.asarray(coded.indices).astype(np.int64), np.cumsum([len(f) for f in flat])[:-1]), max(1, len(coded.dictionary))


def repeated(words: pa.ListArray, n: int, least: int) -> pa.Array:
    """Whether some run of ``n`` words stands at least ``least`` times in a list; a null list has none."""
    size = _lengths(words)
    (code,), many = _numbers(words)
    row = np.repeat(np.arange(len(size)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(row))  # words from a place on
    at, gram, held = np.arange(len(row)), code, np.zeros(len(size), bool)
    for k in range(1, n + 1):
        if k > 1:  # a run stands as often as its beginning at most, so only the places of frequent ones go on
            on = left[at] >= k
            at, gram = at[on], gram[on]
            gram = gram * many + code[at + k - 1]
        _, gram = np.unique(gram, return_inverse=True)
        _, own, count = np.unique(row[at] * (len(row) + 1) + gram, return_inverse=True, return_counts=True)
        often = count[own] >= least
        at, gram = at[often], gram[often]
    held[row[at]] = True
    return pa.array(held)


def overlap_f1(a: pa.ListArray, b: pa.ListArray) -> pa.Array:
    """F1 of two word multisets: 1 where both are empty, 0 where one is, null where one is null."""
    codes, many = _numbers(a, b)
    keys, counts = zip(*(np.unique(np.repeat(np.arange(len(x)), _lengths(x)) * many + code, return_counts=True) for x, code in zip((a, b), codes, strict=True)), strict=True)
    both, i, j = np.intersect1d(*keys, assume_unique=True, return_indices=True)
    common = np.bincount(both // many, np.minimum(counts[0][i], counts[1][j]), len(a))
    total = _lengths(a) + _lengths(b)
    null = np.asarray(a.is_null()) | np.asarray(b.is_null())
    return pa.array(np.where(total == 0, 1.0, 2.0 * common / np.maximum(total, 1)), mask=null)


def has_repeats(words: Column, n: int, least: int) -> Column:
    return F.arrow_udf(lambda w: repeated(w, n, least), "boolean")(words)


def f1(a: Column, b: Column) -> Column:
    return F.arrow_udf(lambda x, y: overlap_f1(x, y), "double")(a, b)
