"""Chunk ingest: duplicates dropped within a horizon, idempotent appends, finalisation of whole sessions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.functions.scalar import speech_ratio


#: The column of a sink's parts.
PART = "part_of_table"


def deduplicated(chunks: DataFrame, at: str, keys: list[str], horizon: str = "24 hours") -> DataFrame:
    """A stream without repeats of a key within the horizon; the state of older keys is dropped."""
    return chunks.withWatermark(at, horizon).dropDuplicatesWithinWatermark(keys)


#: Parts of a sink whose rows have no better one: a hash of their first key.
PARTS = 64


def append_new(path: str, keys: list[str], part: Column | None = None):
    """A ``foreachBatch`` sink that appends the rows whose keys the table at ``path`` lacks: a repeated batch changes nothing.

    The table is partitioned by ``part`` (a day or a session's group, told by the keys; by default a hash of the first key), and a
    batch looks only at the parts that it has rows of. Null keys are keys like others.
    """
    part = F.pmod(F.xxhash64(keys[0]), F.lit(PARTS)) if part is None else part
    part = F.coalesce(part.cast("string"), F.lit("none"))

    def write(batch: DataFrame, epoch: int) -> None:
        spark: SparkSession = batch.sparkSession
        rows = batch.dropDuplicates(keys).withColumn(PART, part)
        try:
            known = spark.read.parquet(path)
        except Exception as error:  # the table begins with its first batch
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
        else:
            touched = [r[PART] for r in rows.select(PART).distinct().collect()]  # parts, not rows
            known = known.withColumn(PART, F.col(PART).cast("string")).where(F.col(PART).isin(touched)).select(PART, *keys).toDF(*(f"known_{c}" for c in (PART, *keys)))
            same = [F.col(c).eqNullSafe(F.col(f"known_{c}")) for c in (PART, *keys)]
            rows = rows.join(known, reduce(lambda x, y: x & y, same), "left_anti")
        rows.write.mode("append").partitionBy(PART).parquet(path)

    return write


def complete_sessions(chunks: DataFrame) -> DataFrame:
    """(session, n, ready): ready where the final chunk is there and none before it is missing."""
    last = F.max(F.when(F.col("final"), F.col("sequence")))
    grouped = chunks.groupBy("session").agg(F.countDistinct("sequence").alias("n"), last.alias("last"))
    return grouped.select("session", "n", F.coalesce(F.col("n") == F.col("last") + 1, F.lit(False)).alias("ready"))


def preprocessed(chunks: DataFrame, least: float = 0.1) -> DataFrame:
    """(session, sequence, speech_ratio, has_speech, final) of chunks with their speech regions; stateless, batch or stream."""
    ratio = speech_ratio(F.col("regions"), F.col("duration_ms"))
    return chunks.select("session", "sequence", ratio.alias("speech_ratio"), (ratio > least).alias("has_speech"), "final")


def first_chunk_status(sessions: DataFrame, chunks: DataFrame, before: str = "created", after: str = "recording") -> DataFrame:
    """Sessions of status ``before`` that have a chunk take status ``after``; idempotent."""
    begun = chunks.select("session").distinct().withColumn("begun", F.lit(True))
    joined = sessions.join(begun, "session", "left")
    status = F.when((F.col("status") == before) & F.coalesce("begun", F.lit(False)), F.lit(after)).otherwise(F.col("status"))
    return joined.select(*(status.alias("status") if c == "status" else F.col(c) for c in sessions.columns))


FINAL = "session long, n long"


def merged(ranges: dict[int, int], sequences: list[int]) -> dict[int, int]:
    """Ranges (start to stop, exclusive) with more numbers in them; neighbours and overlaps become one."""
    out: list[list[int]] = []
    for start, stop in sorted([*ranges.items(), *((x, x + 1) for x in sequences)]):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return dict(map(tuple, out))


class Idle(StatefulProcessor):
    """State by session that ends ``wait_ms`` of event time after its last row; ``clear`` says what there is to end."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "at long")

    def touched(self, newest: int) -> None:
        """Move the session's timer on to its newest row."""
        before = self.newest.get()[0] if self.newest.exists() else None
        if before is not None and before >= newest:
            return
        if before is not None:
            self.handle.deleteTimer(before + self.wait_ms)
        self.newest.update((newest,))
        self.handle.registerTimer(newest + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.newest.clear()
        self.clear()
        return iter(())

    def clear(self) -> None:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Finaliser(Idle):
    """Ranges of the sequence numbers that a session has, in a map; its final one and whether it came out, in a value."""

    def __init__(self, at: str, wait_ms: int):
        super().__init__(wait_ms)
        self.at = at

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.ranges = handle.getMapState("ranges", "start long", "stop long")
        self.end = handle.getValueState("end", "last long, done boolean")

    def clear(self) -> None:
        self.ranges.clear()
        self.end.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark = timerValues.getCurrentWatermarkInMs()
        last, done = self.end.get() if self.end.exists() else (None, False)
        newest, sequences = None, []
        for pdf in rows:
            at = pdf[self.at].map(lambda t: int(t.timestamp() * 1000))
            pdf, at = pdf[at > watermark], at[at > watermark]
            if not pdf.empty:
                newest = max(newest or 0, int(at.max()))
                sequences += [int(x) for x in pdf["sequence"]]
                final = pdf.loc[pdf["final"].astype(bool), "sequence"]
                last = int(final.max()) if len(final) else last
        if newest is None:  # all of them too late
            return
        self.touched(newest)
        if done:
            return
        held = {int(k[0]): int(v[0]) for k, v in self.ranges.iterator()}
        now = merged(held, sequences)
        if last is not None and now.get(0, 0) > last:
            self.ranges.clear()
            self.end.update((last, True))
            yield pd.DataFrame({"session": [key[0]], "n": [last + 1]})
            return
        for start in held.keys() - now.keys():
            self.ranges.removeKey((start,))
        for start, stop in now.items():
            if held.get(start) != stop:
                self.ranges.updateValue((start,), (stop,))
        self.end.update((last, False))


def with_state_store(spark: SparkSession) -> None:
    """Streams with state of their own need the state store on disk; other queries are not touched by it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def finalised(chunks: DataFrame, at: str = "received_at", idle: str = "24 hours") -> DataFrame:
    """Stream of sessions (session, n) that are whole: the final chunk is there and none before it is missing; each comes once.

    The state of a session is the ranges of its sequence numbers, one where nothing is missing, and the final number. ``at`` is event
    time: chunks later than ``idle`` are dropped, and a timer ends the state ``idle`` after the session's last chunk.
    """
    with_state_store(chunks.sparkSession)
    wait_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return chunks.withWatermark(at, idle).groupBy("session").transformWithStateInPandas(Finaliser(at, wait_ms), FINAL, "append", "eventTime")


def streamed(rows: DataFrame, path: str, by: str | None = None) -> DataFrame:
    """A table as a stream of files; with ``by`` (of few values: days, chunk numbers) a file for each value, in their order, one a batch."""
    if not by:
        rows.write.parquet(path)
        return rows.sparkSession.readStream.schema(rows.schema).parquet(path)
    for r in rows.select(by).distinct().orderBy(by).collect():
        rows.where(F.col(by).eqNullSafe(F.lit(r[0]))).coalesce(1).write.mode("append").parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(stream: DataFrame, path: str, keys: list[str], part: Column | None = None, offsets: str | None = None) -> DataFrame:
    """The table at ``path`` after all that a stream holds now was appended to it, key by key once; ``offsets`` is where it goes on later."""
    return _run(stream, path, append_new(path, keys, part), offsets)


def appended(stream: DataFrame, path: str, offsets: str | None = None) -> DataFrame:
    """The table at ``path`` after all that a stream gives now was appended to it, as it is."""
    return _run(stream, path, lambda batch, _: batch.write.mode("append").parquet(path), offsets)


def _run(stream: DataFrame, path: str, write: Callable[[DataFrame, int], None], offsets: str | None) -> DataFrame:
    spark = stream.sparkSession
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", offsets or f"{path}-offsets-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path).select(*stream.columns) if _there(spark, path) else spark.createDataFrame([], stream.schema)


def _there(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return False
        raise
    return True
