"""Tables that change as a whole: data folders, and manifests that say which of them count.

A commit first writes its rows to new folders that nobody reads, then publishes one manifest with
the folders of every table of the store. Readers follow the newest manifest. A load that dies at
any moment before leaves the old state, one that appends copies nothing, and several tables change
together. Manifests have numbers: of two writers that start from the same state the second fails
instead of undoing the first. Folders that no manifest names are garbage and may be deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

_MANIFEST = "name: string, folder: string, place: int"
#: Folders of a table whose keys are read one by one; of more, the keys are stored together.
LOOSE_FOLDERS = 16


@dataclass(frozen=True)
class Change:
    """Rows to add to a table, or to put in its place."""

    table: str
    rows: DataFrame
    replace: bool = False
    partition_by: tuple[str, ...] = ()
    options: Mapping[str, str] = field(default_factory=dict)
    covers: tuple[str, ...] = ()


@dataclass(frozen=True)
class Keys:
    """The keys of a table, and of which folders: ``loose`` ones were read themselves."""

    rows: DataFrame
    name: str
    folders: tuple[str, ...]
    loose: tuple[str, ...]

    def gathered(self) -> list[Change]:
        """What stores the keys of all these folders in one, where there are many loose ones."""
        if len(self.loose) <= LOOSE_FOLDERS:
            return []
        return [Change(self.name, self.rows, replace=True, covers=self.folders)]


class Store:
    """Tables below one folder, which may be in any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._newest = spark, root.rstrip("/"), 0

    def _found(self, *pattern: str) -> list:
        """The paths that a path with wildcards finds. The driver asks the file system itself: no job, whatever is stored."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, "manifests", *pattern]))
        return [f.getPath() for f in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or ()]

    def _manifest(self, number: int) -> list:
        """The files of a manifest; none while another writer is at it, or where one died."""
        return self._found(f"{number:08d}", "part-*.json") if number else []

    def version(self) -> int:
        """Number of the newest manifest, 0 before the first commit. Only names are listed: all of them the first
        time, then those that follow the last one seen."""
        newest = self._newest
        if not self._manifest(newest):
            numbers = sorted((int(p.getName()) for p in self._found("*") if p.getName().isdigit()), reverse=True)
            newest = next((n for n in numbers if self._manifest(n)), 0)
        while self._manifest(newest + 1):
            newest += 1
        self._newest = newest
        return newest

    def folders(self, version: int | None = None) -> dict[str, list[str]]:
        """The data folders of every table, as of the newest or of some version."""
        number = self.version() if version is None else version
        rows = []
        for path in self._manifest(number):
            stream = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).open(path)
            try:
                rows += [json.loads(line) for line in self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()]
            finally:
                stream.close()
        found: dict[str, list[str]] = {}
        for row in sorted(rows, key=lambda r: (r["name"], r["place"])):
            found.setdefault(row["name"], []).append(row["folder"])
        return found

    def read(self, table: str, schema: StructType, version: int | None = None) -> DataFrame:
        """The rows of a table; none before the first commit that names it."""
        return self._read(table, schema, self.folders(version).get(table))

    def _read(self, table: str, schema: StructType, folders: Sequence[str] | None) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        # All folders lie below one, as values of a partition column: together they are one table.
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/data/{table.replace(' ', '-')}").parquet(
            *[f"{self.root}/{f}" for f in folders]).select(*schema.names)

    def keys(self, table: str, schema: StructType, key: str) -> Keys:
        """The column ``key`` of a table. Keys that were stored together stand for the folders they cover, as long as
        the table still has all of these; only the others are read."""
        name, state = f"{table} {key}", self.folders()
        folders, covered = state.get(table, []), state.get(f"{table} {key} of", [])
        if not set(covered) <= set(folders):
            covered = []
        known, columns = set(covered), StructType([schema[key]])
        loose = [folder for folder in folders if folder not in known]
        rows = self._read(table, columns, loose)
        if covered:
            rows = self._read(name, columns, state.get(name)).unionByName(rows)
        return Keys(rows, name, tuple(folders), tuple(loose))

    def commit(self, *changes: Change) -> int:
        """Makes all changes visible at once and returns the number of the new state."""
        start = self.version()
        state = self.folders(start)
        for change in changes:
            place = change.table.replace(" ", "-")
            folder = f"data/{place}/in_commit={start + 1:08d}-{uuid.uuid4().hex}"
            change.rows.write.options(**change.options).partitionBy(*change.partition_by).parquet(f"{self.root}/{folder}")
            state[change.table] = [folder] if change.replace else [*state.get(change.table, []), folder]
            if change.covers:
                state[f"{change.table} of"] = list(change.covers)
        self._publish(start + 1, state)
        return start + 1

    def compact(self, table: str, schema: StructType, partition_by: Sequence[str] = ()) -> int:
        """Rewrites the folders of many small commits as one."""
        return self.commit(Change(table, self.read(table, schema), True, tuple(partition_by)))

    def _publish(self, number: int, state: dict[str, list[str]]) -> None:
        rows = [{"name": table, "folder": folder, "place": place} for table, folders in state.items() for place, folder in enumerate(folders)]
        listed = F.from_json(F.lit(json.dumps(rows)), F.lit(f"array<struct<{_MANIFEST}>>"))
        # One file, renamed into place when its job is committed: there or not there.
        self.spark.range(0, 1, 1, 1).select(F.inline(listed)).write.mode("errorifexists").json(f"{self.root}/manifests/{number:08d}")
