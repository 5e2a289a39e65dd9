"""Byte-level BPE over Arrow batches: distinct chunks of text are encoded once, the rest is gathered."""

from __future__ import annotations

import json
import re

import numpy as np

from lectern.llm.words import byte_table, span_hashes

#: Bytes that surely begin a character other than white space: a text may be cut before a blank that one of them follows.
_SOLID = byte_table(lambda b: 0x21 <= b <= 0x7E or 0xC3 <= b <= 0xDF)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use, by character."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    """Token ids of many texts at once, equal to those of the tokenizer file's library.

    The vocabulary's ids are its merge order, so a rank-based encoder over it gives the same ids;
    this is confirmed on ``PROBE`` when an encoder is made. Literals of the file's added tokens that stand
    in a text are cut out first and take those tokens' ids, as the library does by itself.
    """

    PROBE = "It's 42 degrees; l'été, übergroß —  naïve\n\n\ttest_case(x)  end "

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        vocabulary, added = stated["model"]["vocab"], stated.get("added_tokens", [])
        if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"added tokens of {path} take more than their own literal")
        self._added = {t["content"].encode(): t["id"] for t in added}
        self._literals = re.compile(b"|".join(map(re.escape, sorted(self._added, key=len, reverse=True)))) if added else None
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocabulary.items() if all(c in alphabet for c in token)}
        self._fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._length = np.zeros(max(*ranks.values(), *self._added.values()) + 1, np.int64)
        for token, i in ranks.items():
            self._length[i] = len(token)
        probe = self.PROBE + "".join(f"a {t['content']}{t['content']} b" for t in added)
        data = np.frombuffer(probe.encode(), np.uint8)
        if self(data, np.array([0, len(data)]))[0].tolist() != Tokenizer.from_file(path).encode(probe, add_special_tokens=False).ids:
            raise ValueError(f"the ranks of {path} do not give the ids of its tokenizer")

    def _joined(self, raw: bytes, start: np.ndarray, end: np.ndarray, between: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of chunks that stay apart when joined by ``between``: all ids, and where each chunk's begin and end."""
        text = between.join([raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        ids = np.array(self._fast.encode_ordinary(text.decode()), dtype="<u4")
        upto = np.concatenate([[0], np.cumsum(self._length[ids])])
        size = end - start
        begin = np.cumsum(size + len(between)) - size - len(between)
        return ids, np.searchsorted(upto, begin), np.searchsorted(upto, begin + size)

    def _encode(self, padded: np.ndarray, start: np.ndarray, end: np.ndarray, literals: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of each chunk: all ids, and where each chunk's begin and end among them; with ``literals``, some chunks are added tokens."""
        raw, solid = padded.tobytes(), _SOLID
        special = np.zeros(len(start), dtype=bool)
        if literals:
            special = np.array([raw[a:b] in self._added for a, b in zip(start.tolist(), end.tolist(), strict=True)], dtype=bool)
        words = ~special & (padded[start] == 0x20) & solid[padded[start + 1]] & (end - start > 1)
        lines = ~special & ~words & solid[padded[start]] & ((padded[end - 1] >= 0x21) & (padded[end - 1] <= 0x7E))
        flat, lo, hi, base = [], np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), 0
        for own, between in ((np.flatnonzero(words), b""), (np.flatnonzero(lines), b"\n")):
            if len(own):
                ids, a, b = self._joined(raw, start[own], end[own], between)
                lo[own], hi[own] = a + base, b + base
                flat.append(ids)
                base += len(ids)
        for i in np.flatnonzero(~words & ~lines).tolist():
            piece = raw[start[i] : end[i]]
            ids = np.array([self._added[piece]] if special[i] else self._fast.encode_ordinary(piece.decode()), dtype="<u4")
            lo[i], hi[i] = base, base + len(ids)
            flat.append(ids)
            base += len(ids)
        return np.concatenate(flat), lo, hi

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Where literals of added tokens stand: leftmost, the longest first, none across two texts."""
        raw = data.tobytes()
        if not self._literals or not self._literals.search(raw):
            return []
        places = np.array([m.start() for t in self._added for m in re.finditer(re.escape(t), raw)])
        texts = np.unique(np.searchsorted(offsets, places, side="right") - 1).tolist()
        return [(m.start(), m.end()) for i in texts for m in self._literals.finditer(raw, int(offsets[i]), int(offsets[i + 1]))]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets of each text's ids among them."""
        n, texts = len(data), len(offsets) - 1
        if not n:
            return np.zeros(0, "<u4"), np.zeros(texts + 1, np.int64)
        padded = np.zeros(n + 8, dtype=np.uint8)
        padded[:n] = data
        solid = _SOLID[padded]
        begins = np.zeros(n + 1, dtype=bool)
        last = np.zeros(n, dtype=bool)  # the last byte of a text
        ends = offsets[1:][offsets[1:] > offsets[:-1]]
        last[ends - 1] = True
        begins[:n] = (padded[:n] == 0x20) & solid[1 : n + 1] & ~last
        lines = np.flatnonzero((padded[1 : n] == 0x0A) & solid[: n - 1] & solid[2 : n + 1]) + 1
        lines = lines[~last[lines] & ~last[lines - 1]]
        begins[lines] = True
        begins[lines + 1] = True
        begins[offsets[:-1]] = True
        cuts = self._cuts(data, offsets)
        for a, b in cuts:
            begins[a + 1 : b] = False
            begins[[a, b]] = True
        start = np.flatnonzero(begins[:n])
        end = np.append(start[1:], n)
        key = span_hashes(padded, start, end, 3)
        _, sample, inverse = np.unique(key, return_index=True, return_inverse=True)
        flat, lo, hi = self._encode(padded, start[sample], end[sample], bool(cuts))
        base, many = lo[inverse], (hi - lo)[inverse]
        upto = np.concatenate([[0], np.cumsum(many)])
        ids = flat[np.arange(upto[-1]) - np.repeat(upto[:-1] - base, many)]
        return ids, upto[np.searchsorted(start, offsets)]
