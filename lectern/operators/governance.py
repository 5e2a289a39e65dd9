"""Guarded changes: validated upserts, append-only tables, corrections, cascades, reprocessing, ownership, versions."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators.relational import merge
from lectern.sources.versions import Versions


class NotFound(LookupError):
    """What was asked for does not exist, or is not the caller's: the two look alike."""


class Rejected(ValueError):
    """A whole write was refused; nothing was written."""


def require_owned(rows: DataFrame, key: str, value, owner_col: str, owner) -> DataFrame:
    """The rows of ``key == value`` if their owner asks; raises ``NotFound`` alike for missing and foreign ones."""
    own = rows.where((F.col(key) == F.lit(value)) & (F.col(owner_col) == F.lit(owner)))
    if own.isEmpty():
        raise NotFound(f"{key} {value} not found")
    return own


def start_verdicts(requests: DataFrame, sessions: DataFrame, key: str, wanted: str = "transcribed") -> DataFrame:
    """Durability gate for many requests (key): (key, verdict), "ok" where the session has the wanted status, else why not."""
    joined = requests.select(key).join(sessions.select(key, "status", F.lit(True).alias("known")), key, "left")
    verdict = F.when(F.col("known").isNull(), "not found").when(F.col("status").eqNullSafe(F.lit(wanted)), "ok").otherwise(F.concat(F.lit("has status "), F.coalesce("status", F.lit("none"))))
    return joined.select(key, verdict.alias("verdict"))


def require_status(sessions: DataFrame, key: str, value, wanted: str = "transcribed") -> DataFrame:
    """Durability gate: the session's row if it has the wanted status; else an error, before anything downstream starts."""
    asked = sessions.sparkSession.range(1).select(F.lit(value).alias(key))
    verdict = start_verdicts(asked, sessions, key, wanted).first()["verdict"]
    if verdict == "not found":
        raise NotFound(f"{key} {value} not found")
    if verdict != "ok":
        raise ValueError(f"{key} {value} {verdict}, expected {wanted}")
    return sessions.where(F.col(key) == F.lit(value))


def consented(rows: DataFrame, consent: Column, user_col: str, owner=None, require: bool = True) -> DataFrame:
    """Rows whose author agreed to training use; an ``owner`` gets all of its own rows and no others, agreed or not."""
    if owner is not None:
        return rows.where(F.col(user_col) == F.lit(owner))
    return rows.where(F.coalesce(consent, F.lit(False))) if require else rows


def allowed_columns(rows: DataFrame, allowed: list[str], private: tuple[str, ...] = ("user_id", "email")) -> DataFrame:
    """Only the allowed columns that exist, never a private one, in the table's order."""
    return rows.select(*(c for c in rows.columns if c in allowed and c not in private))


def version_of(versions: DataFrame, key: str, wanted: str | None = None) -> DataFrame:
    """Of (key, version, status, current, ordinal) the wanted version of each key (or its current one), else the last deployed one.

    Adds ``fallback``. A key with neither is left out; ``require_version`` raises for it.
    """
    target = F.lit(wanted) if wanted is not None else F.col("current")
    exact = F.coalesce(F.col("version") == target, F.lit(False))
    usable = versions.where(exact | (F.col("status") == "deployed")).withColumn("exact", exact)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("exact"), F.desc("ordinal")))
    return usable.withColumn("rank", rank).where("rank = 1").select(key, "version", "status", (~F.col("exact")).alias("fallback"))


def require_version(versions: DataFrame, key: str, value, wanted: str | None = None) -> DataFrame:
    found = version_of(versions.where(F.col(key) == F.lit(value)), key, wanted)
    if found.isEmpty():
        raise NotFound(f"no version of {value} can be used")
    return found


def persist_sections(sections: DataFrame, provenance: DataFrame, known: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("session", "topic", "ordinal")) -> tuple[DataFrame, DataFrame]:
    """Idempotent upsert of sections and their sources; raises ``Rejected`` before any write if one cites what is unknown.

    ``new`` has the keys (null-safe), other columns and ``sources`` (cited ids); ``provenance`` (keys, source) of a
    written section is replaced whole. Returns the new sections and the new provenance; a rerun changes nothing.
    """
    cited = new.select(F.explode("sources").alias("source")).distinct()
    missing = cited.join(known.select("source").distinct(), "source", "left_anti").limit(5).collect()
    if missing:
        raise Rejected(f"cites unknown sources such as {[r['source'] for r in missing]}")
    k = list(keys)
    written = merge(sections, new.drop("sources"), k)
    t, s = provenance.alias("t"), new.select(*k).distinct().alias("s")
    kept = t.join(s, [F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}")) for c in k], "left_anti").select("t.*")
    return written, kept.unionByName(new.select(*k, F.explode("sources").alias("source")).distinct())


class AppendOnly:
    """A table that only grows, in versions: appends add rows; a rewrite that would change or lose one is undone before anybody sees it.

    ``rewrite`` takes the whole table as it should be. It is staged and compared with the current version: rows of that version,
    by ``key`` and contents, must all be there. If one is not, nothing is published and 0 comes back, as an update or delete of such a table does nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.versions = Versions(spark, path)

    def append(self, rows: DataFrame) -> int:
        return self.versions.commit({"log": rows}, append=True)

    def rewrite(self, rows: DataFrame) -> int:
        def keeps_all(staged: dict[str, DataFrame]) -> None:
            if not self.read().exceptAll(staged["log"]).isEmpty():
                raise Rejected("a row would change or go")

        try:
            return self.versions.commit({"log": rows}, keeps_all)
        except Rejected:
            return 0

    def update(self, column: str, value: Column) -> int:
        return self.rewrite(self.read().withColumn(column, value))

    def delete(self, where: Column) -> int:
        return self.rewrite(self.read().where(~where))

    def read(self) -> DataFrame:
        return self.versions.read("log")


def durable_sections(store: Versions, new: DataFrame, known: DataFrame, keys: tuple[str, ...] = ("session", "topic", "ordinal")) -> int:
    """``persist_sections`` on a store that has ``sections`` and ``provenance``: both change in one commit, or neither."""
    based_on = store.latest()
    sections, provenance = persist_sections(store.read("sections", based_on), store.read("provenance", based_on), known, new, keys)

    def no_orphans(staged: dict[str, DataFrame]) -> None:
        p, t = staged["provenance"].alias("p"), staged["sections"].alias("t")
        if not p.join(t, [F.col(f"p.{c}").eqNullSafe(F.col(f"t.{c}")) for c in keys], "left_anti").isEmpty():
            raise Rejected("a source has no section")
        if not staged["sections"].groupBy(*keys).count().where("count > 1").isEmpty():
            raise Rejected("two sections have one key")

    return store.commit({"sections": sections, "provenance": provenance}, no_orphans, based_on=based_on)


def capture(rows: DataFrame, edits: DataFrame, key: str, column: str, kind: str, flag: tuple[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Apply user edits (key, value, user_id, consent) to a column and record each as a correction.

    Returns the rows with the edits applied (and ``flag`` set where one was), and the corrections
    (correction_type, source_id, user_id, original_value, corrected_value, consent_for_training), values as JSON. Edits of
    keys that the rows lack are recorded with an empty original and change nothing.
    """
    e = edits.select(F.col(key), F.struct("value").alias("_edit"))
    joined = rows.join(e, key, "left")
    hit = F.col("_edit").isNotNull()
    value = {column: F.when(hit, F.col("_edit.value")).otherwise(F.col(column)).alias(column)}
    if flag:
        value[flag[0]] = F.when(hit, flag[1]).otherwise(F.col(flag[0])).alias(flag[0])
    changed = joined.select(*(value.get(c, F.col(c)) for c in rows.columns))
    before = edits.join(rows.select(key, F.col(column).alias("before")), key, "left")
    as_json = lambda c: F.to_json(F.struct(F.col(c).alias(column)))
    log = before.select(F.lit(kind).alias("correction_type"), F.col(key).alias("source_id"), "user_id", as_json("before").alias("original_value"), as_json("value").alias("corrected_value"), F.col("consent").alias("consent_for_training"))
    return changed, log


def forget_user(user, users: DataFrame, chain: list[tuple[DataFrame, str, str]], corrections: DataFrame, user_col: str = "user_id") -> tuple[list[DataFrame], DataFrame]:
    """Deletion of a user: the user's row and, link by link of ``chain`` (table, its key, its parent key), all rows below go; corrections stay without their author."""
    gone = users.where(F.col(users.columns[0]) == F.lit(user)).select(F.col(users.columns[0]).alias("k"))
    left = [users.join(gone, F.col(users.columns[0]) == F.col("k"), "left_anti")]
    for table, own, parent in chain:
        left.append(table.join(gone, F.col(parent) == F.col("k"), "left_anti"))
        gone = table.join(gone, F.col(parent) == F.col("k"), "left_semi").select(F.col(own).alias("k"))
    masked = F.when(F.col(user_col) == F.lit(user), F.lit(None)).otherwise(F.col(user_col)).alias(user_col)
    return left, corrections.select(*(masked if c == user_col else F.col(c) for c in corrections.columns))


_WRITER: ContextVar[bool] = ContextVar("syllabus_writer", default=False)


@contextmanager
def write_authority() -> Iterator[None]:
    """Only code inside this context may write the guarded table."""
    token = _WRITER.set(True)
    try:
        yield
    finally:
        _WRITER.reset(token)


def guarded_write(rows: DataFrame, path: str, mode: str = "append") -> None:
    if not _WRITER.get():
        raise PermissionError("only the extraction path may write this table")
    rows.write.mode(mode).parquet(path)


def reprocessed(sections: DataFrame, edited: DataFrame, new: DataFrame, session: str = "session", ordinal: str = "ordinal", key: str = "section") -> tuple[DataFrame, DataFrame]:
    """Sections of a newer version, but for ordinals that a human has edited: (sections after, counts by session).

    ``edited`` has the keys of edited sections. Counts are (session, written, preserved) over the new sections.
    """
    kept = sections.join(edited.select(key).distinct(), key, "left_semi").select(session, ordinal).distinct().withColumn("held", F.lit(True))
    marked = new.join(kept, [session, ordinal], "left").withColumn("held", F.coalesce("held", F.lit(False)))
    counts = marked.groupBy(session).agg(F.count_if(~F.col("held")).alias("written"), F.count_if("held").alias("preserved"))
    return merge(sections, marked.where("NOT held").drop("held"), [session, ordinal]), counts


def linked(rows: DataFrame, edits: DataFrame, key: str, column: str = "covered_by") -> DataFrame:
    """Links of items edited by hand: (key, action, link) edits add, remove or replace links of ``column`` and set ``manually_corrected`` for good.

    Several edits of one key apply together: replacements first, then additions, then removals.
    """
    of = lambda action: F.array_sort(F.collect_set(F.when(F.col("action") == action, F.col("link"))))
    e = edits.groupBy(key).agg(of("link").alias("add"), of("unlink").alias("remove"), of("replace").alias("replace"))
    joined = rows.join(e, key, "left")
    none = F.array().cast("array<string>")
    base = F.when(F.size(F.coalesce("replace", none)) > 0, F.col("replace")).otherwise(F.col(column))
    value = F.array_except(F.array_union(base, F.coalesce("add", none)), F.coalesce("remove", none))
    edited = F.col("add").isNotNull()
    flag = F.col("manually_corrected") if "manually_corrected" in rows.columns else F.lit(False)
    others = [c for c in rows.columns if c not in (key, column, "manually_corrected")]
    return joined.select(key, F.when(edited, value).otherwise(F.col(column)).alias(column), (flag | edited).alias("manually_corrected"), *others)


def backfilled(rows: DataFrame, done: DataFrame, encode, old: str, new: str, key: str = "id") -> DataFrame:
    """Rows of version ``old`` brought to ``new`` by ``encode`` (a column of their text or vector), but for those already ``done``.

    A resumed run passes what it has written so far as ``done`` (key, version, value): those rows are taken from it, so no
    row is encoded twice and a rerun changes nothing.
    """
    ready = done.where(F.col("version") == new).select(key, "version", "value")
    todo = rows.join(ready.select(key), key, "left_anti")
    hit = F.col("version") == old
    fresh = todo.select(key, F.when(hit, F.lit(new)).otherwise(F.col("version")).alias("version"), F.when(hit, encode).otherwise(F.col("value")).alias("value"))
    return fresh.unionByName(ready)
