"""How five quality filters act on one another in each of their 120 orders.

What a filter order does to a document depends only on the set of filters that the document fails, so
each of the 32 sets is mapped to one wide integer: 600 fields, one for each step of each order, that
hold what happens there. Adding such integers counts all 600 steps at once; no field can run over into the
next, as a field is 64 bits wide and counts rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.spark import NULL_ID

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(ORDERS) * len(FILTERS)
_BITS = 64


def text_failures(text: Column) -> dict[str, Column]:
    """Which of the filters A to D a text fails."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    n_chars = F.char_length(text).cast("long")
    capitals = n_chars - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": n_words < 200, "B": n_distinct.cast("long") * 100 < n_words.cast("long") * 50, "C": capitals * 100 > n_chars * 3, "D": text.rlike(r"[#$%&*|]")}


def _packed(happens: Callable[[set, str, str], bool], mask: int) -> int:
    """The integer of a mask: field (order, step) is 1 where ``happens(failed, letter, letters before it)``."""
    failed = {f for k, f in enumerate(FILTERS) if mask >> k & 1}
    fields = [happens(failed, order[k], order[:k]) for order in ORDERS for k in range(len(FILTERS))]
    return sum(1 << (_BITS * at) for at, yes in enumerate(fields) if yes)


@cache
def packed_outcomes() -> dict[str, list[int]]:
    """For each outcome, the wide integer of each mask."""
    outcomes = {
        "kept": lambda failed, f, before: not failed & {f, *before},
        "removed": lambda failed, f, before: f in failed and not failed & set(before),
        "redundant": lambda failed, f, before: f in failed and bool(failed & set(before)),
        "unique_fails": lambda failed, f, before: failed == {f},
    }
    return {name: [_packed(happens, mask) for mask in range(1 << len(FILTERS))] for name, happens in outcomes.items()}


def unpack(wide: int) -> np.ndarray:
    """The 600 fields of a sum of wide integers."""
    return np.frombuffer(wide.to_bytes(STEPS * _BITS // 8, "little"), "<i8")


def _audit(key: tuple, masks: pd.DataFrame) -> pd.DataFrame:
    """All steps of all orders of one part, from its counts by mask (at most 32 rows)."""
    wide = packed_outcomes()
    total = lambda outcome, count: unpack(sum(int(n) * wide[outcome][m] for m, n in zip(masks["mask"], masks[count], strict=True)))
    out = pd.DataFrame({"part": key[0], "filter_order": np.repeat(ORDERS, len(FILTERS)), "step": np.tile(np.arange(1, len(FILTERS) + 1), len(ORDERS)).astype(np.int32)})
    for name in wide:
        out[name] = total(name, "n")
    out["good_lost"], out["toxic_lost"] = total("removed", "good"), total("removed", "toxic")
    letter = np.array([order[k] for order in ORDERS for k in range(len(FILTERS))])
    shares = {f: int(out["removed"].to_numpy()[letter == f].sum()) for f in FILTERS}
    out["shapley"] = [shares[f] for f in letter]
    return out


def _first_of_text(rows: DataFrame) -> DataFrame:
    """Rows counted by (part, mask), where E is failed by every row whose text a smaller id has too."""
    # rows that repeat are counted first, so that only one row stands for the smallest id of a text
    ids = rows.groupBy("id", "h1", "h2", "mask", "part").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    counts = ("n", "good", "toxic")
    texts = ids.groupBy("h1", "h2", "mask", "part").agg(F.min(F.struct("id", *counts)).alias("first"), *(F.sum(c).alias(c) for c in counts))
    smallest = F.min("first.id").over(Window.partitionBy("h1", "h2"))
    texts = texts.withColumn("is_first", F.col("first.id") == smallest)
    kept = [F.when(F.col("is_first"), F.col(f"first.{c}")).otherwise(0).alias(f"first_{c}") for c in counts]
    texts = texts.select("mask", "part", *counts, *kept)
    first = F.struct("mask", *(F.col(f"first_{c}").alias(c) for c in counts))
    later = F.struct((F.col("mask") + 16).alias("mask"), *((F.col(c) - F.col(f"first_{c}")).alias(c) for c in counts))
    both = texts.select("part", F.explode(F.array(first, later)).alias("r")).select("part", "r.*")
    return both.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in counts))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part.

    Texts are shuffled as two 64-bit hashes. Rows are counted by part and text, then by part and mask, each time before
    they are shuffled, so that one text or part that holds most rows is a few rows by then. A null text is
    empty, a null part an empty string. Every row counts, repeated ones too; of rows that share an id and a text
    none is a later copy of the other. A null id comes after all ids; several null ids do not precede each other. A document is good, or toxic, if any of its labels says 1; null labels say nothing. An empty
    table has no parts. Very long texts are taken whole; ties don't arise; extra columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    fails = text_failures(text)
    mask = sum((F.when(fails[f], 1 << k).otherwise(0) for k, f in enumerate(FILTERS[:4])), F.lit(0))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), mask.alias("mask"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("again"), text).alias("h2")
    )
    says = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0)))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(says(good_col).alias("good"), says(toxic_col).alias("toxic"))
    rows = rows.join(marks, "id", "left").fillna(0, ["good", "toxic"])
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return _first_of_text(rows).groupBy("part").applyInPandas(_audit, schema)
