"""A full-text index as a table: posting lists by term and block of documents, with positions.

A posting row holds, for one term and one block of documents of one scope, the ids, and each one's
positions of the term, as differences in as many bytes as they need. Each task writes the rows of its own
documents as a segment of the index, in files by a hash of the term, each block's in order: the build shuffles nothing, and a
search of few terms reads their files alone. Queries that ask the same are asked once. The postings of the asked terms are dealt out by block once for all queries (of a tile of them), the queries go
to every part of the blocks, and a part gives each query the best k of its documents.

Ranks weigh terms by how close together they stand (all terms asked), or by how often they occur (one term, or
alternatives).
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.stem import stem
from lectern.session import scratch

#: Documents and bytes of a block, at most (a longer document is a block of its own); queries and distinct terms up to which a search names its terms in its scan's filter.
BLOCK_DOCS, BLOCK_BYTES, NAMED_QUERIES, NAMED_TERMS = 4096, 1 << 24, 1000, 1000
#: Distinct queries of a tile, parts of the blocks that each tile meets, and asked terms up to which all tasks get their list.
TILE_ASKS, PARTS, SENT_TERMS = 32_768, 64, 100_000
#: Rows that the parts may return of a query and source in all; a search of more rows each has fewer parts, but ``LEAST_PARTS`` at least.
PART_ROWS, LEAST_PARTS = 1600, 24
# Fixed values of the rank: the weight of a word, the limit of the sum of 1 / n^2, and how nearness counts at a distance in words.
WEIGHT, LIMIT, REACH = 0.1, 1.64493406685, 100
NEAR = 1 / (1.005 + 0.05 * np.exp(np.arange(REACH + 1) / 1.5 - 2))
#: Logarithm of what a pair of words at each distance leaves of 1 - rank.
_LEFT = np.log1p(-WEIGHT * np.sqrt(NEAR))
_POSTINGS = "term string, source string, scope string, block long, ids binary, sizes binary, places binary, bucket int"
_WORD = r"[\p{L}\p{N}]+"
#: Which bytes of UTF-8 are in words; those of characters that ASCII lacks are looked at one by one.
_IN_WORDS = np.array([chr(b).isalnum() for b in range(128)] + [True] * 128)


def words_of(text: Column) -> Column:
    """Runs of letters and digits of any script, lower-cased; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_WORD), F.lit(0))


@lru_cache(maxsize=2)
def _stops() -> frozenset[str]:
    return frozenset(w for s in StopWordsRemover.loadDefaultStopWords("english") for w in s.split("'"))


def _term(word: str, language: str, stops: frozenset[str]) -> str | None:
    """What a word is indexed as: itself, or in English its stem, and nothing for a stop word."""
    if language == "simple":
        return word
    return None if word in stops else stem(word)


def packed(values: np.ndarray, rows: np.ndarray) -> pa.Array:
    """Whole numbers as bytes of seven bits each, a binary value for each run of them between ``rows``."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(7, 64, 7):
        size += values >= np.uint64(1 << k)
    stop = np.append(0, np.cumsum(size))
    out = np.zeros(stop[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        own = np.flatnonzero(size > k)
        out[stop[own] + k] = ((values[own] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(size[own] > k + 1, 128, 0).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(rows) - 1, [None, pa.py_buffer(stop[rows].astype(np.int32)), pa.py_buffer(out)])


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of ``packed``, and where each row's begin and end."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    upto = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[upto[0] : upto[-1]] if upto[-1] > upto[0] else np.zeros(0, np.uint8)
    stop = np.flatnonzero(data < 128) + 1
    start = np.append(0, stop[:-1])[: len(stop)]
    values = np.zeros(len(stop), np.uint64)
    for k in range(int((stop - start).max(initial=0))):
        own = np.flatnonzero(stop - start > k)
        values[own] |= (data[start[own] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return values, np.searchsorted(stop, upto - upto[0], side="right")


def _gaps(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences to the value before, the values themselves where ``first``."""
    values = values.astype(np.int64).view(np.uint64)
    return np.where(first, values, values - np.append(np.uint64(0), values[:-1])[: len(values)])


def _summed(gaps: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Undoes ``_gaps`` where each run of gaps, which aren't empty, begins with a value."""
    total = np.cumsum(gaps, dtype=np.uint64)
    begin = runs[:-1]
    return (total - np.repeat(total[begin] - gaps[begin], np.diff(runs))).view(np.int64)


def _words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, which are in lower case and not null, and where each text's begin and end among them."""
    text = text.cast(pa.string())
    upto = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8)[upto[0] : upto[-1]] if upto[-1] > upto[0] else np.zeros(0, np.uint8)
    upto = upto - upto[0]
    inside = _IN_WORDS[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
        char = np.zeros(len(lead), np.uint32)
        for k in range(4):
            own = size > k
            char[own] = char[own] << np.uint32(8) | data[lead[own] + k]
        distinct, which = np.unique(char, return_inverse=True)
        chars = pa.array([int(c).to_bytes(4, "big").lstrip(b"\0").decode() for c in distinct], pa.string())
        gap = ~np.asarray(pc.match_substring_regex(chars, f"^{_WORD}$"))[which]
        for k in range(4):
            inside[lead[gap & (size > k)] + k] = False
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    between = upto[(upto > 0) & (upto < len(data))]  # words end where their text does
    first[between], last[between - 1] = inside[between], inside[between - 1]
    start = np.flatnonzero(first)
    stop = np.append(0, np.cumsum(np.flatnonzero(last) + 1 - start)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(stop), pa.py_buffer(data[inside]))
    return words, np.searchsorted(start, upto)


def _post(batches: Iterator[pa.RecordBatch], language: str, stops: frozenset[str], block_docs: int) -> Iterator[pa.RecordBatch]:
    """(id, source, scope, text in lower case) to posting rows; a block is what one batch holds of up to ``block_docs`` documents and ``BLOCK_BYTES`` bytes."""
    block = TaskContext.get().partitionId() << 32
    for whole in batches:
        upto = np.append(0, np.cumsum(np.asarray(pc.binary_length(whole.column("text"))).astype(np.int64)))
        lo = 0
        while lo < whole.num_rows:
            hi = min(lo + block_docs, whole.num_rows, max(lo + 1, int(np.searchsorted(upto, upto[lo] + BLOCK_BYTES, side="right")) - 1))
            yield _posted(whole.slice(lo, hi - lo), block, language, stops)
            block, lo = block + 1, hi


def _posted(batch: pa.RecordBatch, block: int, language: str, stops: frozenset[str]) -> pa.RecordBatch:
    batch = batch.take(pc.sort_indices(batch.column("id")))
    words, upto = _words(batch.column("text"))
    coded = words.dictionary_encode()
    terms, code, size = coded.dictionary, np.asarray(coded.indices), np.diff(upto)
    if language != "simple":
        stems = pa.array([_term(w, language, stops) for w in terms.to_pylist()], pa.string()).dictionary_encode()
        terms, code = stems.dictionary, np.asarray(stems.indices.fill_null(-1))[code]
    sorted_ = pc.sort_indices(terms)
    order = np.full(len(terms) + 1, -1, np.int64)  # the last one is that of no term
    order[np.asarray(sorted_)] = np.arange(len(terms))
    terms, code = terms.take(sorted_), order[code]
    held_in = list(zip(batch.column("source").to_pylist(), batch.column("scope").to_pylist(), strict=True))
    groups = {p: k for k, p in enumerate(dict.fromkeys(held_in))}
    group = np.array([groups[p] for p in held_in], np.int64)
    doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
    own, bits = np.flatnonzero(code >= 0), len(code).bit_length()
    key = (code[own] * len(groups) + group[doc[own]]) << bits | own  # within a term of a scope, documents and places stay in order
    key.sort()
    own = key & ((1 << bits) - 1)
    key >>= bits
    doc = doc[own]
    place = own - upto[doc] + 1
    new_term = np.append(True, key[1:] != key[:-1]) if len(own) else np.zeros(0, bool)
    new_doc = new_term | np.append(True, doc[1:] != doc[:-1]) if len(own) else new_term
    term_at, doc_at = np.flatnonzero(new_term), np.flatnonzero(new_doc)
    of_term = np.searchsorted(doc_at, np.append(term_at, len(own))).astype(np.int32)  # the first document of each term
    own_id = np.asarray(batch.column("id"))[doc[doc_at]]
    ids, sizes = packed(_gaps(own_id, new_term[doc_at]), of_term), packed(np.diff(np.append(doc_at, len(own))), of_term)
    places = packed(_gaps(place, new_doc), np.append(term_at, len(own)))
    term = terms.take(pa.array(key[term_at] // max(1, len(groups))))
    at = pa.array(key[term_at] % max(1, len(groups)))
    source, scope = (pa.array([name[c] for name in groups], pa.string()).take(at) for c in range(2))
    return pa.record_batch([term, source, scope, pa.array(np.full(len(term_at), block, np.int64)), ids, sizes, places], ["term", "source", "scope", "block", "ids", "sizes", "places"])


@dataclass(frozen=True)
class TextIndex:
    """A written index: its path, its language and the number of files' buckets by term."""

    path: str
    language: str
    buckets: int

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_POSTINGS).parquet(self.path)


def build_text_index(docs: DataFrame, path: str, language: str = "simple", buckets: int = 16, block_docs: int = BLOCK_DOCS) -> TextIndex:
    """Index (id, scope, text), of several tables where there is a column ``source``, at ``path``; ``language`` is "simple" (words as they are) or "english" (stems, no stop words).

    Positions count all words from 1. Ids are distinct in a source; a null text has no words, and then no posting. A scope (a
    subject) may be null. A block is a run of up to ``block_docs`` documents as they are read, so the rows of a very common term are
    many, each of one block. Each task writes those of its own documents by bucket, in a bucket by block and term, and nothing is shuffled.
    """
    if language not in ("simple", "english"):
        raise ValueError("language is simple or english")
    stops = _stops() if language == "english" else frozenset()
    source = F.col("source") if "source" in docs.columns else F.lit("")
    texts = docs.select(F.col("id").cast("long").alias("id"), source.alias("source"), F.col("scope").cast("string").alias("scope"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    lists = texts.mapInArrow(lambda it: _post(it, language, stops, block_docs), _POSTINGS.removesuffix(", bucket int"))
    rows = lists.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    # a block's rows come in the order of their terms, and a sort by one number, which is stable, compares no strings
    # and these columns hardly repeat in a file, so that dictionaries of them cost time and are given up
    plain = {f"parquet.enable.dictionary#{c}": "false" for c in ("term", "ids", "places")}
    rows.sortWithinPartitions("bucket").write.partitionBy("bucket").options(compression="zstd", **plain).parquet(path)
    return TextIndex(path, language, buckets)


# ---- what is asked


def parse_query(text: str | None, language: str, stops: frozenset[str]) -> dict:
    """A web-style query as alternatives of clauses: words, "phrases in quotes", ``or`` between, ``-`` before what must not occur.

    {"any": [{"all": [clause], "none": [clause]}], "terms": distinct terms, "near": whether the rank is by nearness}; a clause is a list of [offset, term].
    """
    options: list[dict] = [{"all": [], "none": []}]
    for minus, phrase, bare in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', (text or "").lower()):
        if bare == "or" and not minus:
            options.append({"all": [], "none": []})
            continue
        bare, minus = (bare.lstrip("-"), minus or bare.startswith("-")) if bare else (bare, minus)
        words = re.findall(r"[^\W_]+", phrase or bare)
        clause = [[k, t] for k, w in enumerate(words) if (t := _term(w, language, stops)) is not None]
        clause = [[k - clause[0][0], t] for k, t in clause]
        if clause:
            options[-1]["none" if minus else "all"].append(clause)
    options = [o for o in options if o["all"]]
    terms = sorted({t for o in options for kind in ("all", "none") for c in o[kind] for _, t in c})
    return {"any": options, "terms": terms, "near": len(options) == 1 and len(terms) > 1}


def _asked(queries: DataFrame, language: str) -> DataFrame:
    """(query, scope, rule, terms): the rule as JSON."""
    stops = _stops() if language == "english" else frozenset()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rules = [parse_query(t, language, stops) for t in batch.column("text").to_pylist()]
            columns = [pa.array([json.dumps(r) for r in rules], pa.string()), pa.array([r["terms"] for r in rules], pa.list_(pa.string()))]
            yield pa.record_batch([batch.column("query"), batch.column("scope"), *columns], ["query", "scope", "rule", "terms"])

    scope = F.col("scope").cast("string") if "scope" in queries.columns else F.lit(None).cast("string")
    asked = queries.select(F.col("query").cast("long").alias("query"), scope.alias("scope"), F.col("text").cast("string").alias("text"))
    return asked.mapInArrow(run, "query long, scope string, rule string, terms array<string>")


# ---- what a document answers


def occurrence_rank(counts: list[int], n_terms: int) -> float:
    """Rank by how often the terms occur: each further occurrence counts less."""
    return sum(WEIGHT * float((1.0 / np.arange(1, n + 1, dtype=float) ** 2).sum()) / LIMIT for n in counts if n) / n_terms


class Block:
    """Places of terms in the documents of a block, in one row: a document's places are moved on by ``stride`` times its number."""

    def __init__(self, terms: list[str], ids: list[np.ndarray], sizes: list[np.ndarray], places: list[np.ndarray], wanted: np.ndarray, slack: int = REACH):
        self.ids = np.unique(wanted)
        self.stride = max(REACH, slack) + 1 + max((int(p.max()) for p in places if len(p)), default=0)
        self.places: dict[str, np.ndarray] = {}
        self.held: dict[str, np.ndarray] = {}
        self.counted: dict[str, np.ndarray] = {}
        for term, own, size, place in zip(terms, ids, sizes, places, strict=True):
            doc = np.searchsorted(self.ids, own)
            held = (doc < len(self.ids)) & (self.ids[np.minimum(doc, len(self.ids) - 1)] == own)
            spread = np.repeat(held, size)
            at = np.repeat(doc, size)[spread] * self.stride + place[spread]
            self.places[term] = np.sort(np.append(self.places[term], at)) if term in self.places else at

    def at(self, term: str) -> np.ndarray:
        return self.places.get(term, np.zeros(0, np.int64))

    def having(self, term: str) -> np.ndarray:
        """Which documents have a term."""
        if term not in self.held:
            self.held[term] = np.zeros(len(self.ids), bool)
            self.held[term][self.at(term) // self.stride] = True
        return self.held[term]

    def holding(self, clause: list) -> np.ndarray:
        """Which documents have the words of a clause where its offsets want them."""
        if len(clause) == 1:
            return self.having(clause[0][1])
        first, *others = sorted(clause, key=lambda c: len(self.at(c[1])))
        starts = self.at(first[1]) - first[0]
        for offset, term in others:
            own = self.at(term)
            place = np.searchsorted(own, starts + offset)
            starts = starts[(place < len(own)) & (own[np.minimum(place, len(own) - 1)] == starts + offset)] if len(own) else own
        held = np.zeros(len(self.ids), bool)
        held[starts // self.stride] = True
        return held

    def matching(self, rule: dict) -> np.ndarray:
        any_ = np.zeros(len(self.ids), bool)
        for option in rule["any"]:
            all_ = np.ones(len(self.ids), bool)
            for clause in option["all"]:
                all_ &= self.holding(clause)
            for clause in option["none"] if all_.any() else ():
                all_ &= ~self.holding(clause)
            any_ |= all_
        return any_

    def often(self, terms: list[str]) -> np.ndarray:
        """Rank by how often the terms occur: each further occurrence counts less."""
        total = np.zeros(len(self.ids))
        for term in terms:
            if term not in self.counted:
                n = np.bincount(self.at(term) // self.stride, minlength=len(self.ids))
                self.counted[term] = np.append(0.0, np.cumsum(1.0 / np.arange(1, n.max(initial=0) + 1, dtype=float) ** 2))[n]
            total += self.counted[term]
        return total * WEIGHT / LIMIT / len(terms)

    def near(self, terms: list[str], wanted: np.ndarray | None = None) -> np.ndarray:
        """Rank by how near the terms stand to one another: all pairs of places of two terms up to ``REACH`` words apart; of the ``wanted`` documents alone."""
        left = np.zeros(len(self.ids))
        for i, x in enumerate(terms):
            for y in terms[:i]:
                a, b = sorted((self.at(x), self.at(y)), key=len)
                a = a if wanted is None else a[wanted[a // self.stride]]
                lo, hi = np.searchsorted(b, a - REACH), np.searchsorted(b, a + REACH, side="right")
                for some in np.array_split(np.arange(len(a)), max(1, int((hi - lo).sum() >> 20))):  # a million pairs at once
                    n = (hi - lo)[some]
                    at = np.repeat(lo[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    own = np.repeat(a[some], n)
                    left += np.bincount(own // self.stride, _LEFT[np.abs(b[at] - own)], len(self.ids))
        return -np.expm1(left) + 0.0


class Asks:
    """The distinct queries of a tile, each alternative found by that term of it which fewest queries ask."""

    def __init__(self, table: pa.Table):
        self.ids, self.scopes = table.column("ask").to_pylist(), table.column("scope").to_pylist()
        self.rules = [json.loads(r) for r in table.column("rule").to_pylist()]
        self.slack = max((k for r in self.rules for o in r["any"] for c in (*o["all"], *o["none"]) for k, _ in c), default=0)
        needs = [(n, {t for c in o["all"] for _, t in c}) for n, r in enumerate(self.rules) for o in r["any"]]
        often = Counter(t for _, own in needs for t in own)
        self.by_term: dict[str, list[tuple[int, set[str]]]] = {}
        for n, own in needs:
            self.by_term.setdefault(min(own, key=lambda t: (often[t], t)), []).append((n, own))

    def of(self, terms: set[str]) -> list[int]:
        """The queries of which some alternative can be met by these terms."""
        return sorted({n for t in terms for n, own in self.by_term.get(t, ()) if own <= terms})


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows that are alike in ``names``, with their values there."""
    held, at_hand = [], None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
        lo = 0
        for hi in range(1, len(keys) + 1):
            if hi < len(keys) and keys[hi] == keys[lo]:
                continue
            if held and keys[lo] != at_hand:
                yield at_hand, pa.Table.from_batches(held)
                held = []
            at_hand = keys[lo]
            held.append(batch.slice(lo, hi - lo))
            lo = hi
    if held:
        yield at_hand, pa.Table.from_batches(held)


def _cut(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best, ties by id."""
    if len(ids) <= k:
        return ids, scores
    value = np.round(scores, 9)
    own = np.flatnonzero(value >= np.partition(value, len(value) - k)[len(value) - k])
    own = own[np.lexsort((ids[own], -value[own]))[:k]]
    return ids[own], scores[own]


def _answers(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Of each part the queries of a tile, then postings by block: (ask, source, id, score) of the best k of each query and source in the part."""
    asks, best = None, {}

    def told() -> Iterator[pa.RecordBatch]:
        if best:
            n = [len(ids) for ids, _ in best.values()]
            ask, source = (np.repeat(np.array([key[c] for key in best], kind), n) for c, kind in ((0, np.int64), (1, object)))
            ids, scores = (np.concatenate([x[c] for x in best.values()]) for c in range(2))
            yield pa.record_batch([pa.array(ask), pa.array(source, pa.string()), pa.array(ids), pa.array(scores)], ["ask", "source", "id", "score"])

    for (_, _, block, source), table in _runs(batches, ["tile", "part", "block", "in_source"]):
        if block is None:
            yield from told()
            asks, best = Asks(table), {}
            continue
        terms, scopes = table.column("term").to_pylist(), table.column("scope").to_pylist()
        (gaps, of_term), (sizes, _), (moved, _) = (unpacked(table.column(c)) for c in ("ids", "sizes", "places"))
        sizes = sizes.astype(np.int64)
        upto = np.append(0, np.cumsum(sizes))
        ids, places = _summed(gaps, of_term), _summed(moved, upto)
        cut = lambda x, at: np.split(x, at[1:-1])
        held = Block(terms, cut(ids, of_term), cut(sizes, of_term), cut(places, upto[of_term]), ids, asks.slack)
        inside: dict[str | None, np.ndarray] = {}
        for scope in set(scopes):
            of_scope = np.array([s == scope for s in scopes])
            inside[scope] = np.isin(held.ids, ids[np.repeat(of_scope, np.diff(of_term))])
        for n in asks.of(set(terms)):
            rule, scope = asks.rules[n], asks.scopes[n]
            if scope is not None and scope not in inside:
                continue
            wanted = held.matching(rule)
            wanted = wanted if scope is None else wanted & inside[scope]
            own = np.flatnonzero(wanted)
            if not len(own):
                continue
            score = (held.near(rule["terms"], wanted) if rule["near"] else held.often(rule["terms"]))[own]
            found, key = (held.ids[own], score), (asks.ids[n], source)
            if key in best:
                found = tuple(np.concatenate(x) for x in zip(best[key], found, strict=True))
            best[key] = _cut(*found, k)
    yield from told()


# ---- search


def lexical_top(index: TextIndex, queries: DataFrame, k: int) -> DataFrame:
    """(query, source, id, score, rank): of each source the best k documents for each query (query, text, and maybe scope); ties take the smaller id.

    A query without scope is asked of all scopes. Its alternatives need a term that must occur; a query of none, of
    stop words or of forbidden words alone finds nothing. Queries that ask the same of the same scope are one; a posting is
    sent once to each tile of queries that ask its term, and what comes back is k rows of a query for each part of the blocks at most.
    """
    spark = queries.sparkSession
    asked = _asked(queries, index.language).where(F.size("terms") > 0)
    asked = asked.withColumn("buckets", F.transform("terms", lambda t: F.pmod(F.xxhash64(t), F.lit(index.buckets)).cast("int")))
    postings, few = index.postings(spark), asked.limit(NAMED_QUERIES + 1).toArrow()
    named = set(few.column("terms").combine_chunks().flatten().to_pylist()) if few.num_rows <= NAMED_QUERIES else set()
    if few.num_rows <= NAMED_QUERIES and len(named) <= NAMED_TERMS:  # few terms: their files and rows alone are read; more are met by the join below, whole
        asked = spark.createDataFrame(few, schema=asked.schema)
        buckets = sorted(set(few.column("buckets").combine_chunks().flatten().to_pylist()))
        postings = postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(sorted(named)))
    else:
        asked = kept(asked, "asked")
    asks = asked.groupBy("scope", "rule").agg(F.first("terms").alias("terms")).withColumn("ask", F.monotonically_increasing_id())
    asks = kept(asks, "asks")
    tiles = max(1, -(-asks.count() // TILE_ASKS))
    asks = asks.withColumn("tile", F.pmod(F.xxhash64("ask"), F.lit(tiles)).cast("int"))
    terms = asks.select("tile", F.explode("terms").alias("term"), "scope").groupBy("tile", "term").agg(F.max(F.col("scope").isNull()).alias("anywhere"), F.collect_set("scope").alias("scopes"))
    terms = F.broadcast(terms) if terms.count() <= SENT_TERMS else terms
    met = postings.join(terms, "term").where(F.col("anywhere") | F.array_contains("scopes", F.col("scope")))
    parts = min(PARTS, max(LEAST_PARTS, PART_ROWS // max(1, k)))
    part = F.pmod(F.xxhash64("block", "source"), F.lit(parts)).cast("int").alias("part")
    met = met.select("tile", part, "block", F.col("source").alias("in_source"), "scope", "term", "ids", "sizes", "places")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    both = asks.select("tile", every, "scope", "ask", "rule").unionByName(met, allowMissingColumns=True)
    # queries have no block, and come first
    dealt = both.repartition(tiles * parts, "tile", "part").sortWithinPartitions("tile", "part", F.asc_nulls_first("block"), F.asc_nulls_first("in_source"))
    found = dealt.mapInArrow(lambda it: _answers(it, k), "ask long, source string, id long, score double")
    best = Window.partitionBy("ask", "source").orderBy(F.desc(F.round("score", 9)), "id")
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    own = asked.join(asks.select(F.col("scope").alias("in_scope"), F.col("rule").alias("same"), "ask"), (F.col("rule") == F.col("same")) & F.col("scope").eqNullSafe(F.col("in_scope")))
    return top.join(own.select("query", "ask"), "ask").select("query", "source", "id", "score", "rank")


def kept(df: DataFrame, name: str) -> DataFrame:
    """Written and read again, as it is needed more than once."""
    df.write.parquet(path := scratch(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)
