"""Readers of the given tables, and the ordered sequences derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Members of one derived session of embedded rows, and milliseconds of one utterance.
SESSION, UTTERANCE_MS = 50, 4000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as timed utterances: (session, seq, speaker, text, start_ms, end_ms)."""
    start = F.col("turn") * UTTERANCE_MS
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.col("role").alias("speaker"), "text", start.alias("start_ms"), (start + F.char_length("text") * 20).alias("end_ms")
    )


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded rows in sessions: (session, seq, embedding as doubles, topic)."""
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / SESSION).alias("session"), F.col("vec_id").alias("seq"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").alias("topic")
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as recorded sessions: (session, subject, status, notes_ready, retry_count, last_retry_at, created_at)."""
    key, at = F.col("o_orderkey"), F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        key.alias("session"),
        F.col("o_custkey").alias("subject"),
        F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "P", "transcribed").otherwise("recording").alias("status"),
        F.col("o_orderpriority").startswith("1").alias("notes_ready"),
        (key % 5).alias("retry_count"),
        F.when(key % 3 == 0, at + F.make_dt_interval((key % 7).cast("int"))).alias("last_retry_at"),
        at.alias("created_at"),
    )


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; the schema is stated, never inferred."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    """JSON lines, or with ``lines=False`` one JSON document per file."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_database(spark: SparkSession, url: str, name: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 8, **options: str) -> DataFrame:
    """A table of another database, by Spark's own JDBC source: filters and columns are pushed down to it.

    With a whole-number ``key`` it is read in ``parts`` ranges of low to high, each by a task; rows outside of these go to the first and the last one.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key is not None:
        reader = reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


def annotator_votes(wide: DataFrame, id_col: str) -> DataFrame:
    """Wide annotations (a column for each annotator) as long rows (id, annotator, label)."""
    return wide.unpivot([id_col], [c for c in wide.columns if c != id_col], "annotator", "label")


def read_texts(spark: SparkSession, pattern: str) -> DataFrame:
    """Whole files as (path, text)."""
    return spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def write_versioned(df: DataFrame, path: str, version: str) -> str:
    """JSON lines under ``path/version``; an existing version is an error, so versions never change."""
    target = f"{path}/{version}"
    df.write.mode("errorifexists").json(target)
    return target


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; an existing path is an error."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def markdown_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """A small table as one Markdown text in column ``report``, rows in order of the columns; nulls are empty cells."""
    row = F.concat(F.lit("| "), F.array_join(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), " | "), F.lit(" |"))
    head = f"| {' | '.join(columns)} |\n|{'-|' * len(columns)}\n"
    listed = df.select(F.struct(*columns).alias("at"), row.alias("row")).agg(F.array_sort(F.collect_list(F.struct("at", "row"))).alias("rows"))
    return listed.select(F.concat(F.lit(head), F.array_join(F.transform("rows", lambda r: r["row"]), "\n")).alias("report"))
