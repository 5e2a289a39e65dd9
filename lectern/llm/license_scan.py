"""License scans by template matching over token automata.

A template is wording with markup: ``[words]`` is an optional region (they nest), ``{n}`` a
replaceable region of at most n words, ``a|b`` alternatives for one word; everything else is mandatory. Each
template compiles to a small automaton over words, and a text is accepted where its words spell
all mandatory wording exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base phrases and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Wording of public licences, in words of letters and digits, with markup; first what the BSD family shares.
_BSD_TERMS = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "[1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "[2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
)
_BSD_NAMES = "[3] neither the name of {12} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission "
_BSD_DISCLAIMER = (
    "this software is provided by {8} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall {10} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
TEMPLATES = {
    "mit-license": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall {8} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
    ),
    "bsd-2-clause": _BSD_TERMS + _BSD_DISCLAIMER,
    "bsd-3-clause": _BSD_TERMS + _BSD_NAMES + _BSD_DISCLAIMER,
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted [provided that the above copyright notice and this permission notice appear in all copies] "
        "the software is provided as is and {6} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {6} be liable for any special direct indirect or consequential damages "
        "or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
    ),
    "apache-2.0-notice": (
        "licensed under the apache license version 2 0 the license you may not use {4} except in compliance with the license you may obtain a copy of the license at http|https www apache org licenses license 2 0 "
        "[unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license]"
    ),
    "gpl-3.0-notice": (
        "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version "
        "[{4} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details]"
    ),
    "apache-2.0": "licensed under the apache license [version] 2 0 [the license]",
    "mit": "[released|licensed|distributed] under the [terms of the] mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this {8} and associated documentation files",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl-3.0": "licensed under the [terms of the] gnu general public license [as published by the free software foundation either] version 3 [of the license] [or [at your option] any later version]",
    "gpl-2.0": "licensed under the [terms of the] gnu general public license [as published by the free software foundation either] version 2 [of the license] [or [at your option] any later version]",
    "cc-by-nc-4.0": "licensed under [a|the] [creative commons] cc by nc 4 0 [international] [license]",
    "cc-by-sa-4.0": "licensed under [a|the] [creative commons] cc by sa 4 0 [international] [license]",
    "cc-by-4.0": "licensed under [a|the] [creative commons] cc by 4 0 [international] [license]",
    "mpl-2.0": "subject to the terms of the mozilla public license [v|version] 2 0",
    "proprietary": "copyright {12} all rights reserved",
}

_WORD = 0
_GAP = 1


class Automaton:
    """A token automaton: ``steps[s]`` lists (kind, words, next) and ``skips[s]`` the states reached without a word."""

    def __init__(self, template: str):
        self.steps: list[list[tuple[int, frozenset, int]]] = [[]]
        self.skips: list[list[int]] = [[]]
        tokens = re.findall(r"\[|\]|\{\d+\}|[^\s\[\]{}]+", template)
        end, rest = self._build(tokens, 0, 0)
        if rest != len(tokens):
            raise ValueError(f"unbalanced ] in template: {template}")
        self.final = end
        self.begin = self._closure({0})
        if self.final in self.begin:
            raise ValueError(f"template has no mandatory word: {template}")
        self.first = frozenset().union(*(words for s in self.begin for kind, words, _ in self.steps[s] if kind == _WORD))

    def _state(self) -> int:
        self.steps.append([])
        self.skips.append([])
        return len(self.steps) - 1

    def _build(self, tokens: list[str], i: int, at: int, inside: bool = False) -> tuple[int, int]:
        while i < len(tokens):
            token = tokens[i]
            if token == "[":
                end, i = self._build(tokens, i + 1, at, True)
                self.skips[at].append(end)
                at = end
            elif token == "]":
                if inside:
                    return at, i + 1
                return at, i
            elif token.startswith("{"):
                end = self._state()
                self.skips[at].append(end)
                for _ in range(int(token[1:-1])):
                    new = self._state()
                    self.steps[at].append((_GAP, frozenset(), new))
                    self.skips[new].append(end)
                    at = new
                at, i = end, i + 1
            else:
                new = self._state()
                self.steps[at].append((_WORD, frozenset(token.split("|")), new))
                at, i = new, i + 1
        if inside:
            raise ValueError("unbalanced [ in template")
        return at, i

    def _closure(self, states: set[int]) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def match(self, words: list[bytes], at: int) -> int | None:
        """The end of the longest match that begins at word ``at``, or None."""
        states, best = self.begin, None
        while states and at < len(words):
            word = words[at]
            states = self._closure({t for s in states for kind, some, t in self.steps[s] if kind == _GAP or word in some})
            at += 1
            if self.final in states:
                best = at
        return best


def _compiled(templates: Mapping[str, str]) -> dict[bytes, list[tuple[str, Automaton]]]:
    """Automata by the words they can begin with."""
    by_word: dict[bytes, list[tuple[str, Automaton]]] = {}
    for label, template in templates.items():
        automaton = Automaton(template)
        automaton.steps = [[(kind, frozenset(w.encode() for w in words), t) for kind, words, t in some] for some in automaton.steps]
        for word in automaton.first:
            by_word.setdefault(word.encode(), []).append((label, automaton))
    return by_word


#: Lower-cases A-Z and turns all that is no word into blanks.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _find(line: bytes, phrase: bytes) -> list[int]:
    """The word index of each place where the phrase's words stand consecutively."""
    found, seen, word, needle = [], 0, 0, b" " + phrase + b" "
    at = line.find(needle)
    while at >= 0:
        word += line.count(b" ", seen, at)
        seen = at
        found.append(word)
        at = line.find(needle, at + 1)
    return found


def scan_text(text: str | None, phrases: Mapping[bytes, str], automata: Mapping[bytes, list]) -> tuple:
    """One text's (n_words, places, base labels, labels, spans): places are (start, words) of base phrases."""
    words = (text or "").encode().translate(_TABLE).split()
    line = b" " + b" ".join(words) + b" "
    places, base = [], set()
    for phrase, label in phrases.items():
        for at in _find(line, phrase):
            places.append((at, phrase.count(b" ") + 1))
            base.add(label)
    labels, spans = set(base), []
    for first, some in automata.items():
        for at in _find(line, first) if (b" " + first + b" ") in line else ():
            for label, automaton in some:
                end = automaton.match(words, at)
                if end is not None:
                    labels.add(label)
                    spans.append((at, end, label))
    return len(words), places, sorted(base), sorted(labels), sorted(spans)


def _coverage(n_words: int, places: list, spans: list) -> float:
    """The share of the words inside licence wording."""
    covered, upto = 0, 0
    for a, b in sorted([(at, at + n) for at, n in places] + [(a, b) for a, b, _ in spans]):
        covered += max(0, b - max(a, upto))
        upto = max(upto, b)
    return covered / n_words if n_words else 0.0


_OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, spans array<struct<start:long,end:long,label:string>>, score double"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Mapping[str, str] = BASE_PHRASES, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """Base phrases and licence templates in each whole text; a row for each input row, no shuffle.

    ``score`` is the share of words inside licence wording. A null text is empty: no words, null
    first and last word, no labels, score 0. Rows that repeat, or share an id, are scanned each for
    itself; a null id stays null. Texts of any length are scanned whole; where templates match at one place all
    their labels count, each by its longest match. An empty table gives an empty result. Extra columns are ignored,
    also those named like the output's.
    """
    wanted = {phrase.encode(): label for phrase, label in phrases.items()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _compiled(templates)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = [scan_text(text.as_py(), wanted, automata) for text in part.column("text")]
                yield pa.record_batch(
                    [
                        part.column("doc_id"),
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([len(r[1]) for r in rows], pa.int64()),
                        pa.array([min((p[0] for p in r[1]), default=None) for r in rows], pa.int64()),
                        pa.array([max((p[0] for p in r[1]), default=None) for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.list_(pa.string())),
                        pa.array([r[3] for r in rows], pa.list_(pa.string())),
                        pa.array([[{"start": a, "end": b, "label": x} for a, b, x in r[4]] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))),
                        pa.array([_coverage(r[0], r[1], r[4]) for r in rows], pa.float64()),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "spans", "score"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, _OUT)
