"""Fill-in-the-middle: texts cut into prefix, middle and suffix, and put in another order between sentinels.

A cut is a byte position in the texts of a whole chunk. Which code point that is, and the other way
round, is told by a sparse index of the exceptions to "one byte, one character": the positions of the
multibyte characters and the bytes that each has in excess. Between two exceptions all is arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.words import BLANK_WORDS, Words, chunks, text_buffers

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: For each form: the order of (prefix, middle, suffix) in the output, and what stands before each piece.
FORMS = {"plain": ((0, 1, 2), ("", "", "")), "psm": ((0, 2, 1), (PREFIX, SUFFIX, MIDDLE)), "spm": ((2, 0, 1), (SUFFIX, PREFIX, MIDDLE))}


class Excess:
    """Positions of the multibyte characters in UTF-8 bytes, and the excess bytes up to each."""

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        self.upto = np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0))]).astype(np.int64)
        self.char_at = self.at - self.upto[:-1]

    def chars(self, cut: np.ndarray) -> np.ndarray:
        """Code points before each byte cut (at the beginning of a character)."""
        return cut - self.upto[np.searchsorted(self.at, cut)]

    def bytes(self, cut: np.ndarray) -> np.ndarray:
        """Bytes before each code point cut."""
        return cut + self.upto[np.searchsorted(self.char_at, cut)]


def _units(data: np.ndarray, offsets: np.ndarray, index: Excess, unit: str):
    """How many units each text has, and the byte at which its first k units end, as a function of k."""
    begin, stop = offsets[:-1], offsets[1:]
    if unit == "chars":
        chars = index.chars(offsets)
        return np.diff(chars), lambda k: index.bytes(chars[:-1] + k)
    words = Words(data, offsets, BLANK_WORDS)
    n_words, end = np.diff(words.first), np.append(words.end, 0)
    last = data[np.maximum(stop - 1, 0)] if len(data) else np.zeros(len(stop), np.uint8)
    blank_tail = (stop > begin) & ~BLANK_WORDS[last]
    at = lambda k: end[np.minimum(np.maximum(words.first[:-1] + k - 1, 0), len(end) - 1)]
    return n_words + blank_tail, lambda k: np.where(k == 0, begin, np.where(k > n_words, stop, at(k)))


def cut_texts(column: pa.Array, h: list[np.ndarray], fim_percent: int, spm_percent: int, unit: str) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of each text, by four unsigned hash values a text."""
    data, offsets = text_buffers(column)
    index = Excess(data)
    n, end_of = _units(data, offsets, index, unit)
    first, second = h[0] % (n + 1), h[1] % (n + 1)
    cuts = np.stack([offsets[:-1], end_of(np.minimum(first, second)), end_of(np.maximum(first, second))], axis=1)
    bounds = np.append(cuts.ravel(), offsets[-1]).astype(np.int64)
    # three neighbouring pieces of each text, over the bytes of all texts: nothing is copied here
    pieces = pa.LargeStringArray.from_buffers(3 * len(n), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
    marked = pc.match_substring_regex(column.fill_null(""), "<[PSM]>").to_numpy(zero_copy_only=False)
    plain = (np.diff(offsets) == 0) | marked | (h[2] % 100 >= fim_percent)
    form = np.where(plain, 0, np.where(h[3] % 100 < spm_percent, 2, 1))
    parts = []
    for k in range(3):
        order, sentinels = zip(*((o[k], s[k]) for o, s in FORMS.values()), strict=True)
        parts += [pa.array(sentinels, pa.large_string()).take(pa.array(form)), pieces.take(pa.array(3 * np.arange(len(n)) + np.array(order)[form]))]
    chars = index.chars(cuts)
    none = pa.array(plain)
    counts = [pc.if_else(none, None, pa.array(chars[:, k + 1] - chars[:, k], pa.int64())) for k in range(2)]
    output = pc.binary_join_element_wise(*parts, pa.scalar("", pa.large_string()))
    return [pa.array(n, pa.int64()), pa.array(list(FORMS)).take(pa.array(form)), *counts, output.cast(pa.string())]


def _hashes(id_col: str, seed: int) -> list[Column]:
    """The first four 8-digit groups of sha256 of "seed:id", as numbers; a null id is an empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80, unit: str = "tokens", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row; one pass over whole texts, no shuffle.

    A text of n units is cut after two of 0..n of them, drawn by a hash of the id. ``unit`` is "tokens"
    (a word with the blanks before it, or blanks at the end) or "chars" (code points). ``fim_percent`` of the
    texts are rearranged, ``spm_percent`` of these with the suffix first; the others stay plain, as do empty
    texts (a null text is empty) and texts that hold a sentinel, with null counts. Rows that repeat, or share
    an id, are each cut for themselves, at the places their id draws; a null id draws as an empty one and stays
    null. A text of any length is cut whole: a chunk holds about 2 MB of texts, or one longer text. Two equal draws
    give an empty middle. An empty table gives an empty result; extra columns are ignored, also those named like
    the output's.
    """
    if unit not in ("tokens", "chars"):
        raise ValueError("unit is tokens or chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            h = [part.column(f"h{k}").to_numpy() for k in range(1, 5)]
            yield pa.record_batch([part.column("doc_id"), *cut_texts(part.column("text"), h, fim_percent, spm_percent, unit)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *_hashes(id_col, seed))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str | Column, form: str | Column) -> Column:
    """The exact text, from an output and its form: the sentinels part it in its pieces, as no piece holds one."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    piece = F.split(output, "<[PSM]>")
    return F.when(form == "psm", F.concat(piece[1], piece[3], piece[2])).when(form == "spm", F.concat(piece[2], piece[3], piece[1])).otherwise(output)
