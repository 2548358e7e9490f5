"""The hour-partitioned lake with versions: readers, the stream and compaction do not see each other's unfinished work.

Every write goes to a folder of its own, and becomes visible when a commit lists its files. A commit is a small text that appears at once under the
next number, or not at all where another writer was first; that writer's commit is then the base of a second try. It names a manifest, a table of the
files that it adds and removes, and the commit with the last manifest that lists all files; every :data:`FULL` commits there is one. So a failed run
leaves files that no version lists, a reader keeps the version it began with, and compaction goes on beside appends: it replaces the files that
it read, and fails only if one of them is gone.

Manifests are read and compared as tables; the driver gets the paths of the files that a read needs, as for any table of files. On a store without an
exclusive rename, one writer at a time has to be arranged by other means.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orderflow.session import child_names, delete_path, few_listing_tasks, path_exists, publish_text, read_text
from orderflow.sources.lake import PARTITIONS, TARGET_FILE_BYTES, hour_range, lake_files, with_partition_columns, write_lake

FULL = 16
MANIFEST = "version bigint, added boolean, path string, bytes bigint, " + ", ".join(f"{p} string" for p in PARTITIONS)


class Conflict(RuntimeError):
    """A file that a commit would replace is no longer in the table."""


class SnapshotLake:
    def __init__(self, spark: SparkSession, root: str, ts: str):
        self.spark, self.root, self.ts = spark, root.rstrip("/"), ts

    # --- versions -----------------------------------------------------------------------------

    def versions(self) -> list[int]:
        names = child_names(self.spark, f"{self.root}/commits")
        return sorted(int(name) for name in names if name.isdigit())

    def commit_of(self, version: int | None = None) -> dict:
        """The commit of a version, the newest by default; version 0 is the empty table."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if version == 0:
            return {"version": 0, "full": 0, "schema": None, "progress": {}}
        return json.loads(read_text(self.spark, f"{self.root}/commits/{version:09d}"))

    def files(self, version: int | None = None) -> DataFrame:
        """``path, bytes, year, month, day, hour`` of the files of a version."""
        return self._files(self.commit_of(version))

    def _files(self, commit: dict) -> DataFrame:
        if not commit["version"]:
            return self.spark.createDataFrame([], MANIFEST).drop("version", "added")
        names = [self.commit_of(v)["manifest"] for v in range(commit["full"], commit["version"])] + [commit["manifest"]]
        rows = self.spark.read.schema(MANIFEST).parquet(*[f"{self.root}/manifests/{name}" for name in names])
        last = Window.partitionBy("path").orderBy(F.desc("version"))
        return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1 and added").drop("_n", "version", "added")

    def _commit(self, added: DataFrame, removed: DataFrame | None, schema: str, progress: dict) -> int:
        """Publish the next version; after another writer's, on top of it."""
        while True:
            base = self.commit_of()
            version, manifest = base["version"] + 1, uuid.uuid4().hex
            full = version % FULL == 1
            if removed is not None:
                missing = removed.join(self._files(base), "path", "left_anti").count()
                if missing:
                    raise Conflict(f"{missing} files to replace are not in version {base['version']}")
            rows = added.withColumn("added", F.lit(True))
            if full:
                old = self._files(base)
                kept = old if removed is None else old.join(removed.select("path"), "path", "left_anti")
                rows = rows.unionByName(kept.withColumn("added", F.lit(True)))
            elif removed is not None:
                rows = rows.unionByName(removed.withColumn("added", F.lit(False)))
            fields = [f.split()[0] for f in MANIFEST.split(", ")]
            rows.withColumn("version", F.lit(version).cast("bigint")).select(*fields).write.parquet(f"{self.root}/manifests/{manifest}")
            text = json.dumps({
                "version": version, "manifest": manifest, "full": version if full else base["full"], "schema": schema,
                "progress": base["progress"] | progress,
            })
            if publish_text(self.spark, f"{self.root}/commits/{version:09d}", text):
                return version

    # --- writers ------------------------------------------------------------------------------

    def _write(self, rows: DataFrame, rows_per_file: int) -> DataFrame:
        """Data files of one write, and their rows of a manifest."""
        folder = f"{self.root}/data/write={uuid.uuid4().hex}"
        write_lake(rows, folder, self.ts, "overwrite", rows_per_file)
        parts = [F.regexp_extract("path", rf"/{p}=([^/]+)/", 1).alias(p) for p in PARTITIONS]
        return lake_files(self.spark, folder).select("path", "bytes", *parts)

    def append(self, rows: DataFrame, rows_per_file: int = 2_000_000, source: str | None = None, batch_id: int | None = None) -> int:
        """Add rows. With ``source`` and ``batch_id`` a micro-batch that was committed before changes nothing."""
        base = self.commit_of()
        if source is not None and base["progress"].get(source, -1) >= batch_id:
            return base["version"]
        progress = {source: batch_id} if source is not None else {}
        return self._commit(self._write(rows, rows_per_file), None, rows.schema.json(), progress)

    def appending(self, source: str, rows_per_file: int = 2_000_000):
        """The sink of a streaming query: each micro-batch is one commit, once."""

        def write(batch: DataFrame, batch_id: int) -> None:
            batch.persist()
            try:
                if not batch.isEmpty():
                    self.append(batch, rows_per_file, source, batch_id)
            finally:
                batch.unpersist()

        return write

    def small_files(self, version: int, target_bytes: int) -> DataFrame:
        """Files of the hours that have several below the target."""
        small = self.files(version).filter(F.col("bytes") < target_bytes)
        several = small.groupBy(*PARTITIONS).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
        return small.join(several, PARTITIONS, "left_semi")

    def compact(self, target_bytes: int = TARGET_FILE_BYTES, rows_per_file: int = 2_000_000, while_running=None) -> int:
        """Replace the small files of each hour by files near the target. Rows that arrive meanwhile stay beside them. ``while_running`` is
        called before the commit, for tests."""
        base = self.commit_of()
        old = self.small_files(base["version"], target_bytes) if base["version"] else None
        if old is None or old.isEmpty():
            return base["version"]
        new = self._write(self._rows(old, base), rows_per_file)
        if while_running is not None:
            while_running()
        return self._commit(new, old, base["schema"], {})

    # --- readers ------------------------------------------------------------------------------

    def _rows(self, files: DataFrame, commit: dict) -> DataFrame:
        """What the listed files hold."""
        schema = StructType.fromJson(json.loads(commit["schema"]))
        paths = [r.path for r in files.select("path").collect()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        with few_listing_tasks(self.spark):
            return self.spark.read.schema(schema).parquet(*paths)

    def read(self, start: datetime | None = None, end: datetime | None = None, version: int | None = None) -> DataFrame:
        """Rows of a version, of ``start <= ts < end`` if given: only files of these hours are opened."""
        commit = self.commit_of(version)
        if not commit["version"]:
            raise ValueError(f"{self.root} has no version yet")
        files = self._files(commit)
        if start is None or end is None:
            return self._rows(files, commit)
        time = F.col(self.ts)
        rows = self._rows(files.filter(hour_range(start, end)), commit)
        return rows.filter((time >= F.lit(start).cast("timestamp")) & (time < F.lit(end).cast("timestamp")))

    # --- old versions -------------------------------------------------------------------------

    def vacuum(self, keep: int = 2, running: set[str] = frozenset()) -> int:
        """Forget all but the last ``keep`` versions and delete the writes that none of them lists, but for the folders named in ``running`` (writes
        under way). Returns the number of folders deleted. A folder goes when all its files are out of use."""
        known = self.versions()
        kept = known[-keep:]
        if not kept:
            return 0
        used = self._files(self.commit_of(kept[0]))
        for version in kept[1:]:
            used = used.unionByName(self._files(self.commit_of(version)))
        of = F.regexp_extract("path", r"/data/(write=[^/]+)/", 1).alias("folder")
        live = {r.folder for r in used.select(of).distinct().collect()} | set(running)
        gone = [n for n in child_names(self.spark, f"{self.root}/data") if n.startswith("write=") and n not in live]
        for name in gone:
            delete_path(self.spark, f"{self.root}/data/{name}")
        needed = {v for version in kept for v in range(self.commit_of(version)["full"], version + 1)}
        for version in known:
            if version not in needed and path_exists(self.spark, f"{self.root}/commits/{version:09d}"):
                delete_path(self.spark, f"{self.root}/manifests/{self.commit_of(version)['manifest']}")
                delete_path(self.spark, f"{self.root}/commits/{version:09d}")
        return len(gone)


def hours_of(rows: DataFrame, ts: str) -> DataFrame:
    return with_partition_columns(rows, ts).groupBy(*PARTITIONS).agg(F.count("*").alias("rows"))
