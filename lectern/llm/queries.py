"""The registered queries of this subpackage, each over its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import oracle


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.substring_dedup import substring_dedup

    kept = substring_dedup(_table(spark, sf_dir, "documents"), window=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.shards import kd_tree_shards

    dealt = kd_tree_shards(_table(spark, sf_dir, "documents"), n_shards=8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lectern.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.embedding_dedup import embedding_dedup

    return embedding_dedup(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.labelled import fold_of
    from lectern.llm.quality import fit_quality, score_quality

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = fit_quality(docs, _table(spark, sf_dir, "labels"), folds=5, held_out=0)
    scored, score = score_quality(docs, machine)
    return scored.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), F.col(score).alias("score"), (F.col(score) >= 0.3).cast("int").alias("predicted"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.decontaminate import contamination

    found, out = contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id",
        F.col(f"{out}.n_words").alias("n_words"),
        F.col(f"{out}.n_hit").alias("n_hit"),
        F.size(f"{out}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(f"{out}.items"), ","), 256).alias("items_sha256"),
        (F.col(f"{out}.n_hit") > 0).alias("contaminated"),
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.pii import BASE_KINDS, find_pii

    found = find_pii(_table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.license_scan import license_scan

    found = license_scan(_table(spark, sf_dir, "documents"))
    joined = {c: F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")}
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined["base_labels"], joined["labels"], "score")


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), threshold=0.8).select("doc_id", "class_id", "kept")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.labelled import fold_of
    from lectern.llm.toxicity import fit_toxicity, score_toxicity

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    judge = fit_toxicity(docs, _table(spark, sf_dir, "labels"), folds=4, held_out=2)
    scored, score = score_toxicity(docs, judge)
    return scored.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), F.col(score).alias("score"), (F.col(score) >= 0.3).cast("int").alias("predicted"), "chance")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.fim import fill_in_middle, restored

    cut = fill_in_middle(_table(spark, sf_dir, "documents"), seed=42, fim_percent=50, spm_percent=80)
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256")
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.chat import format_turns, read_back

    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    read = read_back(format_turns(given.union(told)))
    digests = F.sha2("turns_text", 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256")
    return read.select("conv_id", "n_turns", *digests, "formatted_chars", "n_examples", "example_chars")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.filter_audit import filter_audit

    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_sharding": op2_sharding,
    "op3_packing": op3_packing,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_quality": op5_quality,
    "op6_decontamination": op6_decontamination,
    "op7_pii": op7_pii,
    "op8_license_scan": op8_license_scan,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_chat_formatting": op12_chat_formatting,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL = oracle.ORACLE_SQL
