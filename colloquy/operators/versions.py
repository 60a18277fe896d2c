"""Tables whose schema changes by numbered steps, each applied once, whole or not at all.

A store is a folder. `versions/` holds a small file per version (`000003.json`): its number, the step's name, when it
was applied, and where each table's Parquet lies; the highest number is the store's version. A step's tables are written
into a folder of their own first (`data/`), read back and counted, and only then the version's file is put in place, by
one rename that fails if the number is taken. So a step that fails, or a driver that is lost on the way, leaves the
version before as it was; readers of it are never disturbed, older versions stay readable, and of two jobs that apply
the same step one is told. Tables that a step doesn't name keep their files: nothing is copied.

Steps must be numbered 1, 2, ... without gaps and without repeats. A store that is newer than the steps at hand is
refused, and so is one whose applied steps have other names. What a failed step has written stays in `data/`, where no
version names it (`unnamed` lists such folders).

A step that gives None for a table drops it; an empty table is kept with its columns; tables may be added at any step.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Tables = Mapping[str, DataFrame | None]


class VersionError(RuntimeError):
    """Steps and store don't fit together."""


@dataclass(frozen=True)
class Step:
    """change takes the tables as they are and gives those that are other afterwards."""

    number: int
    name: str
    change: Callable[[dict[str, DataFrame]], Tables]


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.system = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.hadoop.Path(f"{self.folder}/{name}" if name else self.folder)

    def _listed(self, name: str) -> list[str]:
        at = self._path(name)
        return sorted(f.getPath().getName() for f in self.system.listStatus(at)) if self.system.exists(at) else []

    def numbers(self) -> list[int]:
        return [int(n[:6]) for n in self._listed("versions") if len(n) == 11 and n[:6].isdigit() and n.endswith(".json")]

    def entry(self, number: int) -> dict:
        file = self.system.open(self._path(f"versions/{number:06d}.json"))
        try:
            return json.loads(bytes(file.readAllBytes()).decode())
        finally:
            file.close()

    def version(self) -> int | None:
        """The store's version; None if there is no store yet."""
        return max(self.numbers(), default=None)

    def tables(self, number: int | None = None) -> dict[str, DataFrame]:
        """All tables of a version, the newest if none is named."""
        number = self.version() if number is None else number
        if number is None:
            raise VersionError(f"no store in {self.folder}")
        return {name: self.spark.read.parquet(f"{self.folder}/{at}") for name, at in self.entry(number)["tables"].items()}

    def history(self) -> DataFrame:
        """number, name, applied_at and n_tables of each version."""
        rows = [(e["number"], e["name"], e["applied_at"], len(e["tables"])) for e in map(self.entry, self.numbers())]
        return self.spark.createDataFrame(rows, "number int, name string, applied_at double, n_tables int")

    def unnamed(self) -> list[str]:
        """Folders of data that no version names: what failed steps left."""
        named = {at.split("/")[1] for n in self.numbers() for at in self.entry(n)["tables"].values()}
        return [d for d in self._listed("data") if d not in named]

    def _put(self, number: int, name: str, before: dict[str, str], changed: Tables) -> None:
        folder, now = f"data/{number:06d}-{uuid.uuid4().hex[:12]}", dict(before)
        for table, rows in changed.items():
            now.pop(table, None)
            if rows is None:
                continue
            now[table] = f"{folder}/{table}"
            seen = _counted(rows)
            seen[0].write.parquet(f"{self.folder}/{now[table]}")
            there = self.spark.read.parquet(f"{self.folder}/{now[table]}").count()
            if there != seen[1]():
                raise VersionError(f"{table}: {there} rows can be read of {seen[1]()} written")
        said = json.dumps({"number": number, "name": name, "applied_at": time.time(), "tables": now}, sort_keys=True)
        draft, final = self._path(f"drafts/{uuid.uuid4().hex}.json"), self._path(f"versions/{number:06d}.json")
        self.system.mkdirs(self._path("versions"))
        file = self.system.create(draft, False)
        file.write(bytearray(said.encode()))
        file.close()
        gateway = self.spark.sparkContext._gateway
        context = self.hadoop.FileContext.getFileContext(self._path("").toUri() if "://" in self.folder else self.system.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(self.system.makeQualified(draft), self.system.makeQualified(final), gateway.new_array(self.hadoop.Options.Rename, 0))
        except Exception as e:
            if self.system.exists(final):
                raise VersionError(f"version {number} was put in place by another job") from e
            raise

    def create(self, tables: Tables) -> None:
        """Version 0."""
        if self.version() is not None:
            raise VersionError(f"a store is in {self.folder} already")
        self._put(0, "start", {}, tables)

    def pending(self, steps: list[Step]) -> list[Step]:
        """The steps still to apply, in order; an error if steps and store don't fit."""
        ordered = sorted(steps, key=lambda s: s.number)
        if [s.number for s in ordered] != list(range(1, len(ordered) + 1)):
            raise VersionError(f"steps must be numbered 1 to {len(ordered)}: {[s.number for s in ordered]}")
        version = self.version()
        if version is None:
            raise VersionError(f"no store in {self.folder}")
        if version > len(ordered):
            raise VersionError(f"the store has version {version}, the steps end at {len(ordered)}")
        for step in ordered[:version]:
            if (applied := self.entry(step.number)["name"]) != step.name:
                raise VersionError(f"step {step.number} was applied as {applied!r}, and is {step.name!r} here")
        return ordered[version:]

    def apply(self, steps: list[Step]) -> list[int]:
        """Applies what is pending, step by step; gives the numbers. A step that fails ends it, with those before in place."""
        done = []
        for step in self.pending(steps):
            self._put(step.number, step.name, self.entry(step.number - 1)["tables"], step.change(self.tables(step.number - 1)))
            done.append(step.number)
        return done


def _counted(rows: DataFrame) -> tuple[DataFrame, Callable[[], int]]:
    """rows, and how many of them an action has passed on: counted on the way, so that nothing is computed twice."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    seen = Observation()
    return rows.observe(seen, F.count(F.lit(1)).alias("n")), lambda: seen.get["n"]
