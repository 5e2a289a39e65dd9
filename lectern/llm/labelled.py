"""The rows that a classifier learns from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, folds: int, held_out: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Up to ``most`` labelled texts outside the held-out fold: (doc_id, text, label 0.0 or 1.0).

    Which ones is decided by a hash of the id. Null labels and ids are left out, and ids of several
    rows; an id with several labels takes their majority, 1 on a tie.
    """
    kept = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("double").alias("label")).dropna()
    kept = kept.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    kept = kept.where(fold_of("doc_id", folds) != held_out).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # at most `most` rows are broadcast, here and below
    single = texts.select("doc_id").join(F.broadcast(kept), "doc_id").groupBy("doc_id", "label").count().where("count = 1").drop("count")
    return texts.join(F.broadcast(single), "doc_id")
