"""The corpus pipeline on tables without rows, without texts, and with columns of its own stages' names."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

pytest.importorskip("lectern.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from lectern.llm.embedding_dedup import embedding_dedup  # noqa: E402
from lectern.llm.spark import materialize  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
CLASHING = ("key_id", "key_1", "score", "spans", "component", "sequence_id", "chance")


def piped(spark, docs):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        docs = materialize(stage(spark, docs, str(DATA)), f"odd-{k}")
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    return docs


@pytest.mark.skipif(not DATA.is_dir(), reason="the tables are not here")
@pytest.mark.parametrize("kind", ["empty", "null", "clashing"])
def test_the_pipeline_takes_odd_tables(spark, kind):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    if kind == "empty":
        assert piped(spark, docs.limit(0)).count() == 0
    elif kind == "null":
        out = piped(spark, docs.limit(20).withColumn("text", F.lit(None).cast("string")))
        ids = {r["doc_id"] for r in out.collect()}
        assert ids <= {r["doc_id"] for r in docs.limit(20).collect()}
    else:
        plain = {tuple(r) for r in piped(spark, docs).select("doc_id", "piece", "length", "ids_crc32").collect()}
        clashing = piped(spark, docs.withColumns({c: F.lit(7) for c in CLASHING}))
        assert {tuple(r) for r in clashing.select("doc_id", "piece", "length", "ids_crc32").collect()} == plain and plain


def test_embeddings_with_columns_of_the_results_names(spark):
    rows = [(i, [1.0, 0.1 * (i % 3)]) for i in range(9)] + [(20, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    odd = df.withColumns({c: F.lit("x") for c in ("component_id", "n_links", "kept", "node", "component", "a", "b")})
    result = lambda d: sorted(map(tuple, embedding_dedup(d, threshold=0.9).select("vec_id", "n_links", "component_id", "kept").collect()))
    assert result(odd) == result(df)
