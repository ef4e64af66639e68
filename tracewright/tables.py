"""Keyed tables in versions: upserts that rewrite only the parts they touch.

Rows are dealt into parts by a hash of their key, each part a folder of Parquet files.  A
change reads the parts that the incoming keys fall into, writes these anew, and then
commits a version: a small file that names the folder of every part.  The other parts keep
their files.  Readers take the newest version whose file is complete, so they see a
change as a whole or not at all, and a version once read stays as it is.

Two writers: a version's number is claimed by creating a file that must not exist yet, so
of two changes of one version only one commits.  The other gets ``StaleVersion``, or, if it
has not said which version it has read, works its change out again on the newer one.  This is
as strict as the file system's creation of a new file (HDFS and local disks are).  A
writer lost between its claim and its commit leaves the claim; ``release`` removes it.

Spark's own dynamic partition overwrite would also rewrite touched parts only, but part by
part: a reader, or a second writer, could meet half of a change.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Change = Callable[[DataFrame, DataFrame], DataFrame]
_PART = "key_part"


class StaleVersion(RuntimeError):
    """Another writer has committed, or is committing, a newer version."""


class _Files:
    """The few file operations that a commit needs, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm = spark._jvm
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str = "") -> bool:
        """False if the file exists already."""
        try:
            stream = self._fs.create(self._path(path), False)
        except Py4JJavaError as problem:
            if "FileAlreadyExists" in str(problem.java_exception) or "already exists" in str(problem.java_exception):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def rename(self, source: str, target: str) -> bool:
        return self._fs.rename(self._path(source), self._path(target))

    def delete(self, path: str) -> bool:
        return self._fs.delete(self._path(path), True)


class Table:
    """``path``: the table's folder.  ``key``: the columns that tell rows apart.  ``parts``: how many parts a
    new table gets (an existing one keeps its number); a part should hold what a few tasks can rewrite."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: list[str], parts: int = 64):
        self.spark, self.path, self.key = spark, path.rstrip("/"), list(key)
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._files, self._parts = _Files(spark, path), parts

    # ---- versions ------------------------------------------------------------------------------
    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        names = self._files.names(f"{self.path}/versions")
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def version(self) -> int:
        """The newest complete version; 0 before the first."""
        return max(self.versions(), default=0)

    def _entry(self, version: int) -> dict:
        if version == 0:
            return {"parts": self._parts, "folders": {}}
        return json.loads(self._files.read(f"{self.path}/versions/{version}.json"))

    def release(self, version: int) -> None:
        """Give up the claim of a writer that was lost before it committed."""
        if version not in self.versions():
            self._files.delete(f"{self.path}/versions/{version}.claim")

    # ---- reading -------------------------------------------------------------------------------
    def folders(self, version: int | None = None, parts: set[int] | None = None) -> list[str]:
        folders = self._entry(self.version() if version is None else version)["folders"]
        return [f"{self.path}/{folder}" for part, own in sorted(folders.items()) if parts is None or int(part) in parts for folder in own]

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.folders(version))

    def of_keys(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """Rows of the given keys: only the parts they fall into are read."""
        version = self.version() if version is None else version
        touched = self._touched(keys, self._entry(version)["parts"])
        return self._read(self.folders(version, touched)).join(keys.select(*self.key).distinct(), self.key, "left_semi")

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def _part(self, parts: int) -> Column:
        return F.pmod(F.xxhash64(*(F.col(k) for k in self.key)), F.lit(parts)).cast("int")

    def _touched(self, rows: DataFrame, parts: int) -> set[int]:
        # at most one row for each part
        return {r[_PART] for r in rows.select(self._part(parts).alias(_PART)).distinct().collect()}

    # ---- writing -------------------------------------------------------------------------------
    def merge(self, incoming: DataFrame, change: Change, base: int | None = None, attempts: int = 5) -> int:
        """Replace the parts that ``incoming`` falls into by ``change(their rows, incoming)``; the new version.

        ``change`` must treat each key for itself.  With ``base``, the version that the caller has read,
        a newer one is refused; without, the change is worked out again on it."""
        for attempt in range(attempts):
            version = self.version() if base is None else base
            try:
                return self._merge(incoming, change, version)
            except StaleVersion:
                if base is not None or attempt == attempts - 1:
                    raise
        raise StaleVersion(self.path)

    def _merge(self, incoming: DataFrame, change: Change, version: int) -> int:
        if self.version() != version:
            raise StaleVersion(f"{self.path}: version {self.version()} is newer than {version}")
        entry = self._entry(version)
        touched = self._touched(incoming, entry["parts"])
        changed = change(self._read(self.folders(version, touched)), incoming)
        kept = {part: own for part, own in entry["folders"].items() if int(part) not in touched}
        return self._commit(changed, version, entry["parts"], kept)

    def upsert(self, rows: DataFrame, order: str | None = None, base: int | None = None) -> int:
        """Rows replace those of their key; of several new rows of a key the greatest ``order`` comes in."""
        from .operators.ledger import upsert

        return self.merge(rows, lambda old, new: upsert(old, new, self.key, order), base)

    def insert_absent(self, rows: DataFrame, order: str | None = None, base: int | None = None) -> int:
        """Rows of keys that the table does not have; existing rows stay as they are."""
        from .operators.findings import keep_first

        def change(old: DataFrame, new: DataFrame) -> DataFrame:
            return old.unionByName(keep_first(new, self.key, order).join(old.select(*self.key), self.key, "left_anti"))

        return self.merge(rows, change, base)

    def dealt(self, rows: DataFrame, base: int, tasks: int) -> DataFrame:
        """Rows dealt into about ``tasks`` tasks by the part that they fall into: a task has rows of one part, or
        of a few where there are fewer tasks than parts."""
        parts = self._entry(base)["parts"]
        each = -(-tasks // parts)
        place = F.pmod(F.xxhash64(F.lit("task"), *(F.col(k) for k in self.key)), F.lit(each)).cast("int")
        return rows.repartitionById(tasks if tasks < parts else parts * each, self._part(parts) * each + place)

    def append(self, rows: DataFrame, base: int, most_folders: int = 32, are_dealt: bool = False) -> int:
        """Rows of keys that the version ``base`` does not have, beside what is there; no part is rewritten but
        those that consist of ``most_folders`` already.  A newer version than ``base`` is refused, as it
        may have these keys.  ``are_dealt``: the rows come from what ``dealt`` made and are not shuffled again."""
        if self.version() != base:
            raise StaleVersion(f"{self.path}: version {self.version()} is newer than {base}")
        entry = self._entry(base)
        full = {part for part, own in entry["folders"].items() if len(own) >= most_folders}
        again = self._read(self.folders(base, {int(p) for p in full})) if full else None
        kept = {part: own for part, own in entry["folders"].items() if part not in full}
        return self._commit(rows if again is None else rows.unionByName(again), base, entry["parts"], kept, are_dealt and again is None)

    def replace(self, rows: DataFrame, base: int | None = None) -> int:
        """All rows anew, as a version of their own."""
        version = self.version() if base is None else base
        return self._commit(rows, version, self._entry(version)["parts"], {})

    def _commit(self, rows: DataFrame, version: int, parts: int, kept: dict[str, list[str]], are_dealt: bool = False) -> int:
        number = version + 1
        folder = f"data/{number}-{uuid.uuid4().hex}"
        dealt = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema), self._part(parts).alias(_PART))
        if not are_dealt:  # a part goes to one task, a large one to several
            dealt = dealt.hint("rebalance", F.col(_PART))
        dealt.write.partitionBy(_PART).parquet(f"{self.path}/{folder}")
        folders = dict(kept)
        for name in self._files.names(f"{self.path}/{folder}"):
            if name.startswith(f"{_PART}="):
                part = name.removeprefix(f"{_PART}=")
                folders[part] = [*folders.get(part, []), f"{folder}/{name}"]
        marker = f"{self.path}/versions/{number}"
        if self.version() != version or not self._files.create(f"{marker}.claim"):
            self._files.delete(f"{self.path}/{folder}")
            raise StaleVersion(f"{self.path}: version {number} belongs to another writer")
        self._files.create(f"{marker}.tmp", json.dumps({"parts": parts, "folders": folders}))
        self._files.rename(f"{marker}.tmp", f"{marker}.json")
        return number

    def vacuum(self, keep: int = 2) -> int:
        """Remove all but the newest ``keep`` versions and the folders that only they name; how many folders went."""
        versions = self.versions()
        used = lambda some: {folder for v in some for own in self._entry(v)["folders"].values() for folder in own}
        needed = used(versions[-keep:])
        old = used(versions[:-keep]) - needed
        for v in versions[:-keep]:
            self._files.delete(f"{self.path}/versions/{v}.json")
        return sum(self._files.delete(f"{self.path}/{folder}") for folder in old)


def is_table(spark: SparkSession, path: str) -> bool:
    return bool(_Files(spark, path).names(f"{path.rstrip('/')}/versions"))
