"""Several tables written all or not at all: staged, checked as they were written, then made current by one atomic rename.

A version is a small file that names the folders of each table: one after it was written anew, one more after each append. Files of an older version are never touched, so a reader that
has pinned a version keeps it; what a crash leaves staged is named by no version and read by nobody.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another commit came first; nothing was written."""


@dataclass(frozen=True)
class Versions:
    """Tables under a path, on any file system that Spark writes to."""

    spark: SparkSession
    path: str

    def _fs(self):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def latest(self) -> int:
        """The number of the current version; 0 before the first."""
        fs, path = self._fs()
        folder = path(f"{self.path}/versions")
        if not fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "_"), default=0)

    def tables(self, version: int | None = None) -> dict[str, list[str]]:
        """The folders of each table of a version."""
        version = self.latest() if version is None else version
        if not version:
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/versions/{version}.json", wholetext=True).first()[0])

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(*self.tables(version)[table])

    def stage(self, tables: dict[str, DataFrame]) -> dict[str, str]:
        """Write tables where no version looks: the folder of each."""
        where = {name: f"{self.path}/data/{name}-{uuid.uuid4().hex}" for name in tables}
        for name, df in tables.items():
            df.write.parquet(where[name])
        return where

    def publish(self, staged: dict[str, str], based_on: int, append: bool = False) -> int:
        """Make staged tables current (or append them), beside the unchanged ones of the version they are based on; ``Conflict`` if that is not the current one."""
        if self.latest() != based_on:
            raise Conflict(f"version {based_on} is not the current one")
        fs, path = self._fs()
        fs.mkdirs(path(f"{self.path}/versions"))
        draft, final = path(f"{self.path}/versions/_{uuid.uuid4().hex}"), path(f"{self.path}/versions/{based_on + 1}.json")
        out = fs.create(draft, False)
        before = self.tables(based_on)
        after = before | {name: [*(before.get(name, []) if append else []), where] for name, where in staged.items()}
        out.write(bytearray(json.dumps(after).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):  # the rename is the commit
            raise Conflict(f"version {based_on + 1} is there already")
        return based_on + 1

    def commit(self, tables: dict[str, DataFrame], *checks: Callable[[dict[str, DataFrame]], None], based_on: int | None = None, append: bool = False) -> int:
        """Stage, check what was staged (a check raises to refuse the whole commit), publish: the new version's number."""
        based_on = self.latest() if based_on is None else based_on
        staged = self.stage(tables)
        for check in checks:
            check({name: self.spark.read.parquet(where) for name, where in staged.items()})
        return self.publish(staged, based_on, append)
