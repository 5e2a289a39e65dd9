"""Ordered work inside one key that may hold most rows: places by two levels, so that no window needs a whole key in one task.

Rows are dealt to ranges of (key, order) that one task can hold. Counts of the ranges, a few for each key, are
summed up by a small second pass, and a row's place is its place in its range plus what came before. Places in turn
cut a key into blocks of equal length, with halo rows where a window looks beyond an edge.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lectern.session import scratch

#: Rows of a range, and of a block of places, that one task holds.
RANGE = 500_000


def positioned(rows: DataFrame, key: str, *order: str, most: int = RANGE) -> DataFrame:
    """Rows with ``position``, from 0 in each key by ``order`` (which tells all rows of a key apart); written once in between.

    Rows that tie in all of ``order`` stay in one range, in any order; nulls come first.
    """
    spark = rows.sparkSession
    ranges = max(1, -(-rows.count() // most))
    dealt = rows.repartitionByRange(ranges, key, *order).withColumn("range", F.spark_partition_id())
    dealt.write.parquet(path := scratch(spark, "ranges"))
    dealt = spark.read.schema(dealt.schema).parquet(path)
    sizes = dealt.groupBy(key, "range").count()
    before = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(key).alias("key_of_range"), "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    placed = dealt.withColumn("place", F.row_number().over(Window.partitionBy(key, "range").orderBy(*order)) - 1)
    joined = placed.join(sizes.withColumnRenamed("range", "of_range"), (F.col("range") == F.col("of_range")) & F.col(key).eqNullSafe(F.col("key_of_range")))
    return joined.withColumn("position", F.col("before") + F.col("place")).drop("range", "place", "before", "of_range", "key_of_range")


def with_halo(rows: DataFrame, back: int, ahead: int, length: int) -> DataFrame:
    """Rows with ``block`` (position / length), and copies of those near an edge in the neighbouring block (``halo`` is true there)."""
    if max(back, ahead) > length:
        raise ValueError("a halo is not longer than a block")
    block, at = F.floor(F.col("position") / length), F.col("position") % length
    own = F.struct(block.alias("block"), F.lit(False).alias("halo"))
    later = F.when(at >= length - back, F.struct((block + 1).alias("block"), F.lit(True).alias("halo"))) if back else F.lit(None)
    earlier = F.when((at < ahead) & (block > 0), F.struct((block - 1).alias("block"), F.lit(True).alias("halo"))) if ahead else F.lit(None)
    copies = F.array_compact(F.array(own, *([later] if back else []), *([earlier] if ahead else [])))
    return rows.withColumn("copy", F.explode(copies)).select("*", "copy.block", "copy.halo").drop("copy")


def looking(rows: DataFrame, key: str, back: int, ahead: int, columns: Callable[[object], dict[str, Column]], length: int = RANGE) -> DataFrame:
    """Window columns over positioned rows that look at most ``back`` rows back and ``ahead`` ahead: ``columns(window)`` by name."""
    window = Window.partitionBy(key, "block").orderBy("position")
    return with_halo(rows, back, ahead, length).withColumns(columns(window)).where(~F.col("halo")).drop("block", "halo")


def running_sum(rows: DataFrame, key: str, value: Column, name: str, length: int = RANGE) -> DataFrame:
    """Positioned rows with the sum of ``value`` up to and including each row."""
    rows = rows.withColumns({"block": F.floor(F.col("position") / length), name: value})
    totals = rows.groupBy(key, "block").agg(F.sum(name).alias("total"))
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(key).alias("key_of_block"), F.col("block").alias("of_block"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    own = F.sum(name).over(Window.partitionBy(key, "block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    joined = rows.withColumn("own", own).join(totals, (F.col("block") == F.col("of_block")) & F.col(key).eqNullSafe(F.col("key_of_block")))
    return joined.withColumn(name, F.col("own") + F.col("before")).drop("block", "own", "before", "of_block", "key_of_block")


def percentile(rows: DataFrame, key: str, value: str, share: float, most: int = RANGE) -> DataFrame:
    """(key, percentile) of the values that aren't null, between neighbours by their distance: the rows at two places of the sorted values."""
    kept = rows.where(F.col(value).isNotNull()).select(key, value)
    placed = positioned(kept.withColumn("tie", F.monotonically_increasing_id()), key, value, "tie", most=most)
    sizes = kept.groupBy(key).agg(F.count("*").alias("n")).select(F.col(key).alias("key_of"), ((F.col("n") - 1) * share).alias("at"))
    met = placed.join(sizes, F.col(key).eqNullSafe(F.col("key_of"))).where((F.col("position") == F.floor("at")) | (F.col("position") == F.ceil("at")))
    ends = met.groupBy(key).agg(F.min_by(value, "position").alias("low"), F.max_by(value, "position").alias("high"), F.first("at").alias("at"))
    return ends.select(key, (F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))).alias("percentile"))


def _walked(step: np.ndarray, begin: np.ndarray, first: np.ndarray, carried: int) -> tuple[np.ndarray, int]:
    """The state before each row, and after the last one: ``step`` has each row's next state of every state; runs begin at ``first`` with ``begin``."""
    n = len(step)
    run = np.maximum.accumulate(np.where(first, np.arange(n), 0))  # the first row of each row's run that is here
    upto, reach = step.copy(), 1  # what the last rows of the run do to every state, up to and including each row
    deep = np.arange(n) - run
    while (own := np.flatnonzero(deep >= reach)).size:
        upto[own] = np.take_along_axis(upto[own], upto[own - reach], axis=1)
        reach *= 2
    at_first = np.where(first[run], begin[run], carried)
    after = upto[np.arange(n), at_first]
    return np.where(deep > 0, np.append(0, after[:-1]), at_first), int(after[-1])


def folded(rows: DataFrame, key: str, n_states: int, step: Column, start: Column, length: int = RANGE) -> DataFrame:
    """Positioned rows with ``state_before`` of a finite automaton that goes through each key's rows from ``start`` (a column of the key's rows).

    ``step`` is, for each row, the array of the next state of every state (from 0). A key of one block begins at its start. A longer
    key's blocks are first folded for every state they could begin in; those results, of which there are fewer than rows by ``length``, are
    chained; then each block goes on from the state it does begin in. Steps of a run are composed by doubling, batch by batch.
    """
    rows.write.parquet(path := scratch(rows.sparkSession, "placed"))  # places are looked at three times
    rows = rows.sparkSession.read.schema(rows.schema).parquet(path)
    rows = rows.withColumns({"block": F.floor(F.col("position") / length), "step": step, "start": start})
    names = [c for c in rows.columns if c not in ("block", "step", "start")]

    def summed(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        now = list(range(n_states))
        for nxt in pdf.sort_values("position")["step"]:
            now = [int(nxt[s]) for s in now]
        return pd.DataFrame({key: [key_[0]], "block": [key_[1]], "map": [now], "start": [pdf["start"].iloc[0]]})

    kind = rows.schema[key].dataType.simpleString()
    long = F.broadcast(rows.where(F.col("position") == length).select(F.col(key).alias("long_key")))  # at most one key in `length` rows
    several = rows.select(key, "block", "position", "step", "start").join(long, F.col(key).eqNullSafe(F.col("long_key"))).drop("long_key")
    maps = several.groupBy(key, "block").applyInPandas(summed, f"{key} {kind}, block long, map array<int>, start int")
    chained = maps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block", "map", "start"))).alias("blocks"))
    # a few entries for each key: one for each block
    begins = F.aggregate("blocks", F.struct(F.array().cast("array<struct<of_block:bigint,begins_at:int>>").alias("out"), F.get("blocks", F.lit(0))["start"].alias("at")), lambda acc, b: F.struct(F.concat(acc["out"], F.array(F.struct(b["block"].alias("of_block"), acc["at"].alias("begins_at")))).alias("out"), F.get(b["map"], acc["at"]).alias("at")), lambda acc: acc["out"])
    begins = F.broadcast(chained.select(F.col(key).alias("key_of_block"), F.explode(begins).alias("b")).select("key_of_block", "b.*"))
    met = rows.join(begins, (F.col("block") == F.col("of_block")) & F.col(key).eqNullSafe(F.col("key_of_block")), "left")
    met = met.withColumn("begins_at", F.coalesce("begins_at", "start")).select(*names, "block", "step", "begins_at")

    def gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            steps = np.asarray(batch.column("step").flatten()).reshape(-1, n_states)
            first = np.asarray(batch.column("position")) % length == 0
            before, now = _walked(steps, np.asarray(batch.column("begins_at")), first, now)
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(before.astype(np.int32))], [*names, "state_before"])

    schema = StructType([*(rows.schema[c] for c in names), StructField("state_before", IntegerType())])
    # positions of a key have no gaps, so that a run of a key's block begins where the position says so
    return met.repartition(key, "block").sortWithinPartitions(key, "block", "position").mapInArrow(gone, schema)
