"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned from the labelled sample: words and word beginnings that toxic texts hold far
more often than others, weighted by how surely they do (a z score of the smoothed log odds). The
trees see densities of lexicon hits, their nearness to second-person words, and rates of capitals,
marks, symbols and obfuscated spellings. Training texts are scored by a lexicon learned from the
other half of the sample, so that the trees see hits as they occur in unseen texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.labelled import labelled_sample
from lectern.llm.spark import free_name, materialize
from lectern.llm.textstats import NAMES, per_text, structure
from lectern.llm.words import ALNUM_WORDS, Words, chunks, span_hashes, text_buffers

#: Labelled rows that lexicon, trees and calibration are fitted on, at most.
FIT_ROWS = 20_000
#: Lexicon entries at most, the surest first.
ENTRIES = 4096
#: Toxic texts with an entry, at least; standard errors below the log odds ratio at which its bound is; the bound, at least.
SUPPORT, ERRORS, SURE = 3, 1.64, 1.6
#: Bytes of the word beginnings that can be entries, besides whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Words between a hit and a second-person word, at most, to count as near.
NEAR = 5
TREES, DEPTH = 16, 3

# Second-person words of the languages served.
SECOND_PERSON = ("you", "your", "yours", "ur", "u", "tu", "te", "toi", "ton", "vous", "votre", "du", "dich", "dir", "dein", "ihr", "euch", "usted", "ustedes", "ti", "tus", "vosotros")

#: Letters that look-alikes stand for, then A-Z to a-z.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[0x41:0x5B] += 32
for _look, _letter in zip(b"@$0134571", b"asoieastl", strict=True):
    _PLAIN[_look] = _letter

FEATURES = ("top", "sum", "strong", "medium", "weak", "distinct", "density", "near_you", "longest_run", "obfuscated", "plain_gain", *NAMES)


def _entries(words: Words) -> Iterator[np.ndarray]:
    """Hashes of each word and of its beginnings; 0 where the word is shorter."""
    yield words.hashes(31)
    length = words.end - words.start
    for n in BEGINNINGS:
        h = span_hashes(words.data, words.start, np.minimum(words.start + n, words.end), 32 + n)
        h[length < n] = 0
        yield h


def _plain_words(column: pa.Array) -> Words:
    """Words after look-alikes have become letters."""
    data, offsets = text_buffers(column)
    return Words(_PLAIN[data], offsets, ALNUM_WORDS)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training texts to (entry, half, toxic texts, other texts)."""
    for part in chunks(batches, "text"):
        words = _plain_words(part.column("text"))
        owner = words.owner()
        label, half = np.asarray(part.column("label")).astype(np.int64), np.asarray(part.column("half")).astype(np.int64)
        pairs = [np.unique(np.rec.fromarrays([h[h != 0], owner[h != 0]], names="h,doc")) for h in _entries(words)]
        pairs = np.concatenate(pairs)
        key, inverse = np.unique(np.rec.fromarrays([pairs["h"], half[pairs["doc"]]], names="h,half"), return_inverse=True)
        bad = np.bincount(inverse, label[pairs["doc"]], len(key)).astype(np.int64)
        yield pa.record_batch([pa.array(key["h"].astype("<i8")), pa.array(key["half"]), pa.array(bad), pa.array(np.bincount(inverse, minlength=len(key)) - bad)], ["entry", "half", "bad", "good"])


class Lexicon:
    """Entries (hashes) in order, and their weights."""

    def __init__(self, entry: np.ndarray, weight: np.ndarray):
        order = np.argsort(entry)
        self.entry, self.weight = entry[order], weight[order]

    def weigh(self, h: np.ndarray) -> np.ndarray:
        if not len(self.entry):
            return np.zeros(len(h))
        at = np.searchsorted(self.entry, h)
        at[at == len(self.entry)] = 0
        return np.where((self.entry[at] == h) & (h != 0), self.weight[at], 0.0)


def features(column: pa.Array, lexicons: list[Lexicon], half: np.ndarray) -> np.ndarray:
    """A row of ``FEATURES`` for each text; text i is judged by ``lexicons[half[i]]``."""
    rows, _, _ = structure(column)
    words = _plain_words(column)
    owner, n = words.owner(), len(words.first) - 1
    many = np.maximum(np.diff(words.first), 1)
    z, whole = np.zeros(len(words)), None
    for h in _entries(words):
        whole = h if whole is None else whole
        for k, lexicon in enumerate(lexicons):
            z = np.maximum(z, np.where(half[owner] == k, lexicon.weigh(h), 0.0))
    hit = np.flatnonzero(z > 0)
    top = np.zeros(n)
    np.maximum.at(top, owner[hit], z[hit])
    kinds = np.unique(np.rec.fromarrays([owner[hit], whole[hit] if whole is not None else np.zeros(0, np.uint64)], names="doc,h"))
    second = np.array([int(x) for x in np.sort(_second_hashes())], dtype=np.uint64)
    you = np.flatnonzero(np.isin(whole, second)) if len(words) else np.zeros(0, np.int64)
    near = np.zeros(len(hit), dtype=bool)
    if len(you) and len(hit):
        after = np.minimum(np.searchsorted(you, hit), len(you) - 1)
        for other in (you[after], you[np.maximum(after - 1, 0)]):
            near |= (np.abs(other - hit) <= NEAR) & (owner[other] == owner[hit])
    raw, offsets = text_buffers(column)
    changed = (_PLAIN[raw] != raw) & ~((raw >= 0x41) & (raw <= 0x5A))
    seen = np.concatenate([[0], np.cumsum(changed)])
    spelled = seen[words.end] > seen[words.start]
    spelled &= (words.end - words.start) > (seen[words.end] - seen[words.start])
    longest = np.zeros(n)
    np.maximum.at(longest, owner, words.end - words.start)
    count = lambda mask: per_text(mask.astype(np.int64), words.first)
    strong, medium, weak = count(z >= 3.4), count((z >= 2.4) & (z < 3.4)), count((z > 0) & (z < 2.4))
    nearby = np.bincount(owner[hit[near]], minlength=n)
    return np.column_stack(
        [
            top, per_text(z, words.first), np.minimum(strong, 20), np.minimum(medium, 20), np.minimum(weak, 40), np.bincount(kinds["doc"], minlength=n),
            (strong + medium) / many, nearby / many, np.log1p(longest), count(spelled) / many, count(spelled & (z >= 2.4)), rows,
        ]
    )


def _listed(rows: np.ndarray) -> pa.Array:
    """A list of doubles for each row, without Python objects."""
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.reshape(-1)), rows.shape[1]).cast(pa.list_(pa.float64()))


def _second_hashes() -> np.ndarray:
    data, offsets = text_buffers(pa.array([" ".join(SECOND_PERSON)]))
    return Words(data, offsets, ALNUM_WORDS).hashes(31)


def _learned(votes: DataFrame, totals: dict[int, tuple[int, int]], halves: tuple[int, ...]) -> Lexicon:
    """The surest entries over the votes of some halves; at most ``ENTRIES`` reach the driver."""
    bad, good = (float(sum(totals.get(k, (0, 0))[i] for k in halves)) for i in (0, 1))
    found = votes.where(F.col("half").isin(*halves)).groupBy("entry").agg(F.sum("bad").alias("p"), F.sum("good").alias("n"))
    p, n = F.col("p") + 0.5, F.col("n") + 0.5
    odds = F.log(p / (bad - F.col("p") + 0.5)) - F.log(n / (good - F.col("n") + 0.5))
    found = found.where(F.col("p") >= SUPPORT).withColumn("weight", odds - ERRORS * F.sqrt(1 / p + 1 / n)).where(F.col("weight") >= SURE)
    rows = found.orderBy(F.desc("weight"), "entry").limit(ENTRIES).select("entry", "weight").toArrow()
    return Lexicon(np.asarray(rows["entry"]).astype("<i8").view("<u8"), np.asarray(rows["weight"]).astype(np.float64))


class Judge:
    """A fitted scorer: lexicon, trees and calibration; without both classes, a constant."""

    def __init__(self, lexicon: Lexicon, trees=None, steps=None, constant: float = 0.0):
        self.lexicon, self.trees, self.steps, self.constant = lexicon, trees, steps, constant


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = FIT_ROWS, folds: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text") -> Judge:
    """Fit on up to ``most`` labelled rows outside the held-out fold (``crc32(id) mod folds == held_out``).

    Half of the sample serves each lexicon; a quarter is kept from the trees for calibration.
    Without labels, or with one class only, the score is the (smoothed) share of label 1.
    """
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, label, most, folds, held_out, id_col, text_col)
    sample = materialize(sample.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")), "toxicity-sample")
    totals = {r["half"]: (int(r["bad"]), int(r["n"] - r["bad"])) for r in sample.groupBy("half").agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n")).collect()}
    bad, good = (sum(t[i] for t in totals.values()) for i in (0, 1))
    if not bad or not good:
        return Judge(Lexicon(np.zeros(0, np.uint64), np.zeros(0)), constant=(bad + 0.5) / (bad + good + 1.0))
    votes = materialize(sample.mapInArrow(_votes, "entry long, half long, bad long, good long").groupBy("entry", "half").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "toxicity-votes")
    crossed = spark.sparkContext.broadcast([_learned(votes, totals, (1,)), _learned(votes, totals, (0,))])  # at most ENTRIES each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            rows = features(part.column("text"), crossed.value, np.asarray(part.column("half")))
            yield pa.record_batch([part.column("doc_id"), part.column("label"), _listed(rows)], ["doc_id", "label", "row"])

    seen = materialize(sample.mapInArrow(run, "doc_id long, label double, row array<double>"), "toxicity-features")
    seen = seen.select("label", array_to_vector("row").alias("features"), F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(4)).alias("part"))
    train, rest = seen.where("part > 0"), seen.where("part = 0")
    if train.select("label").distinct().count() < 2 or rest.select("label").distinct().count() < 2:
        train, rest = seen, seen
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, minInstancesPerNode=2, cacheNodeIds=False).fit(train)
    probability = vector_to_array("probability")[1]
    judged = trees.transform(rest).select("label", probability.alias("raw"))
    steps = IsotonicRegression(featuresCol="raw", labelCol="label").fit(judged)
    return Judge(_learned(votes, totals, (0, 1)), trees, steps)


def score_toxicity(docs: DataFrame, judge: Judge, text_col: str = "text") -> tuple[DataFrame, str]:
    """All columns of ``docs``, a score from 0 to 1 and ``chance``, and the score's name.

    The score is the isotonic value; ``chance`` is the trees' own probability, which also orders rows that share a step.
    Null and empty texts are scored by their (empty) features, texts of any length whole. Rows that repeat get
    the same score, so ties stay ties. An empty table gives an empty result. Extra columns pass through; the
    names of added columns avoid theirs.
    """
    out, own = free_name(docs, "score"), free_name(docs, "chance")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if judge.trees is None:
        constant = F.lit(float(judge.constant))
        return docs.select(*columns, constant.alias(out), constant.alias(own)), out
    row = free_name(docs, "feature_row")
    sent = docs.sparkSession.sparkContext.broadcast(judge.lexicon)  # at most ENTRIES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text_col):
            rows = features(part.column(text_col), [sent.value], np.zeros(part.num_rows, np.int64))
            yield pa.record_batch([*part.columns, _listed(rows)], [*part.schema.names, row])

    seen = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(row, T.ArrayType(T.DoubleType()))]))
    vector, raw, odds, said, calibrated = (free_name(seen, c) for c in ("features", "raw_margin", "probability", "said", "calibrated"))
    trees = judge.trees.copy().setFeaturesCol(vector).setRawPredictionCol(raw).setProbabilityCol(odds).setPredictionCol(said)
    seen = trees.transform(seen.withColumn(vector, array_to_vector(row)))
    chance = free_name(seen, "chance")
    steps = judge.steps.copy().setFeaturesCol(chance).setPredictionCol(calibrated)
    seen = steps.transform(seen.withColumn(chance, vector_to_array(odds)[1]))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(calibrated)))
    return seen.select(*columns, score.alias(out), F.col(chance).alias(own)), out
