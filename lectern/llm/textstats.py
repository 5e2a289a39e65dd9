"""Structure statistics of texts, vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lectern.llm.words import BLANK_WORDS, Words, byte_table, text_buffers

_UPPER = byte_table(lambda b: 0x41 <= b <= 0x5A)
_LOWER = byte_table(lambda b: 0x61 <= b <= 0x7A or b >= 0x80)
_DIGIT = byte_table(lambda b: 0x30 <= b <= 0x39)
_MARK = byte_table(lambda b: chr(b) in "!?")
_STOP = byte_table(lambda b: chr(b) in ".,;:'\"()-")
_SYMBOL = byte_table(lambda b: 0x21 <= b <= 0x7E and not chr(b).isalnum() and chr(b) not in "!?.,;:'\"()-")
_LINE = byte_table(lambda b: b == 0x0A)

NAMES = (
    "log_words", "upper", "digit", "mark", "stop", "symbol", "line", "word_length", "repeat", "distinct", "odd_words", "short_words", "caps_words",
)


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs ``first[i]:first[i+1]``; empty runs sum to 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[first[1:]] - total[first[:-1]]


def structure(column: pa.Array) -> tuple[np.ndarray, Words, np.ndarray]:
    """A row of ``NAMES`` for each text; its blank-separated words (lower-cased A-Z); their hashes."""
    data, offsets = text_buffers(column)
    words = Words(data, offsets, BLANK_WORDS, lower=True)
    n_bytes = np.maximum(np.diff(offsets), 1)
    n_words = np.diff(words.first)
    many = np.maximum(n_words, 1)
    share = {name: per_text(table[data], offsets) for name, table in (("upper", _UPPER), ("lower", _LOWER), ("digit", _DIGIT), ("mark", _MARK), ("stop", _STOP), ("symbol", _SYMBOL), ("line", _LINE))}
    letters = np.maximum(share["upper"] + share["lower"], 1)
    h, owner = words.hashes(1), words.owner()
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    distinct = np.zeros(len(n_words), dtype=np.int64)
    if len(h):
        order = np.lexsort((h, owner))
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        distinct = np.bincount(owner[order][new], minlength=len(n_words))
    length = words.end - words.start
    odd = np.concatenate([[0], np.cumsum((_SYMBOL | _DIGIT)[words.data])])
    caps = np.concatenate([[0], np.cumsum(_UPPER[data])])
    odd_word = odd[words.end] > odd[words.start]
    caps_word = (caps[words.end] - caps[words.start]) * 2 > length
    rows = np.stack(
        [
            np.log1p(n_words),
            share["upper"] / letters,
            share["digit"] / n_bytes,
            share["mark"] / many,
            share["stop"] / many,
            share["symbol"] / many,
            share["line"] / many,
            per_text(length, words.first) / many,
            per_text(again, words.first) / many,
            distinct / many,
            per_text(odd_word, words.first) / many,
            per_text(length <= 2, words.first) / many,
            per_text(caps_word, words.first) / many,
        ],
        axis=1,
    )
    return rows, words, h
