"""Keyed Parquet tables whose state is a numbered manifest: a commit is one rename that fails if another writer was first.

    table/manifest/00000003.json    {"buckets": 16, "live": {"5": ["data/<write>/bucket=5", ...], ...}, "properties": {...}}
    table/data/<write>/bucket=<b>/  Parquet files of one write

Rows lie in buckets by a hash of their keys. A write puts new files beside the old ones and then a manifest that names
what is live. Until that manifest is in place nothing has changed, so a crash at any step leaves the old table, and a
reader sees one manifest's files whatever writers do. Writers that lose the race read the new manifest and try again.

The file system must refuse to put a file where one is: HDFS does on rename, local ones and those mounted by POSIX do on
link. Object stores without such an operation can't hold these tables.
"""

from __future__ import annotations

import contextlib
import functools
import json
import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.sources.staging import staged

BUCKETS, RETRIES = 16, 20


class Conflict(Exception):
    """Another writer's manifest was first."""


@dataclass
class Snapshot:
    """One manifest: its number (0: no table yet) and the folders of each bucket."""

    version: int = 0
    buckets: int = BUCKETS
    live: dict[str, list[str]] = field(default_factory=dict)
    properties: dict[str, str] = field(default_factory=dict)

    def folders(self, of: list[int] | None = None) -> list[str]:
        return [f for b, fs in sorted(self.live.items(), key=lambda x: int(x[0])) if of is None or int(b) in of for f in fs]


class KeyedTable:
    """A table at a path, with the columns that identify its rows."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.schema, self._buckets = spark, path.rstrip("/"), keys, schema, buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- manifests ------------------------------------------------------------

    def _versions(self) -> list[int]:
        at = self._path(f"{self.path}/manifest")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest manifest, or that of a version."""
        versions = self._versions()
        if version is None:
            if not versions:
                return Snapshot(buckets=self._buckets)
            version = versions[-1]
        stream = self._fs.open(self._path(f"{self.path}/manifest/{version:08d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        got = json.loads(text)
        return Snapshot(version, got["buckets"], got["live"], got.get("properties", {}))

    def _put(self, base: Snapshot, live: dict[str, list[str]], properties: dict[str, str]) -> Snapshot:
        """Make the next manifest; Conflict where another writer has made one since base."""
        folder = self._path(f"{self.path}/manifest")
        self._fs.mkdirs(folder)
        new = Snapshot(base.version + 1, base.buckets, {b: f for b, f in live.items() if f}, properties)
        final, temp = self._path(f"{self.path}/manifest/{new.version:08d}.json"), self._path(f"{self.path}/manifest/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(temp, False)
        try:
            out.write(bytearray(json.dumps({"buckets": new.buckets, "live": new.live, "properties": new.properties}).encode()))
        finally:
            out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                try:
                    os.link(temp.toUri().getPath(), final.toUri().getPath())  # a local rename would overwrite
                except FileExistsError:
                    raise Conflict(str(final)) from None
            elif self._fs.exists(final) or not self._fs.rename(temp, final):
                raise Conflict(str(final))
        finally:
            with contextlib.suppress(Exception):
                self._fs.delete(temp, False)
        return new

    # ---- reading --------------------------------------------------------------

    def _of(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        return self._of(self.snapshot(version).folders())

    # ---- writing --------------------------------------------------------------

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, buckets: int, where_they_lie: bool = False) -> dict[str, list[str]]:
        """rows as files of a new write: bucket -> its folders. Where they lie: each task writes to all buckets, and no row is sent."""
        write = f"data/{uuid.uuid4().hex}"
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema.fields]
        out = rows.select(*names).withColumn("bucket", self._bucket(buckets))
        (out if where_they_lie else out.repartition("bucket")).write.partitionBy("bucket").parquet(f"{self.path}/{write}")
        parts = self._fs.listStatus(self._path(f"{self.path}/{write}"))
        return {n.split("=")[1]: [f"{write}/{n}"] for n in (s.getPath().getName() for s in parts) if n.startswith("bucket=")}

    def _firsts(self, rows: DataFrame) -> DataFrame:
        """One row for each key: the smallest by its other columns."""
        rest = [c for c in rows.columns if c not in self.keys]
        if not rest:
            return rows.distinct()
        return rows.groupBy(*self.keys).agg(F.min(F.struct(*rest)).alias("_least")).select(*self.keys, *[F.col(f"_least.{c}").alias(c) for c in rest])

    def _without(self, folders: list[str], keys: DataFrame) -> DataFrame:
        """The rows of folders whose key isn't in keys (distinct, staged).

        The smaller set of keys, those that go or those that stay, is joined to the rows: its size is known, so that rows
        are not sent where it can be broadcast.
        """
        held = self._of(folders)
        if not folders or 2 * keys.count() <= held.count():
            return held.join(keys, self.keys, "left_anti")
        stay = staged(held.select(*self.keys).distinct().join(keys, self.keys, "left_anti"), "stay").toDF(*[f"_stay_{k}" for k in self.keys])
        same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_stay_{k}")) for k in self.keys])
        return held.join(stay, same, "left_semi")

    def _retried(self, attempt) -> int:
        for _ in range(RETRIES):
            with contextlib.suppress(Conflict):
                return attempt(self.snapshot())
        raise Conflict(f"{self.path}: lost {RETRIES} races")

    def append(self, rows: DataFrame) -> int:
        """Add rows as they are; the version. The files are written once, whatever races the manifest loses."""
        files: dict[str, dict[str, list[str]]] = {}

        def attempt(base: Snapshot) -> int:
            if base.buckets not in files:
                files[base.buckets] = self._write(rows, base.buckets)
            live = {b: [*base.live.get(b, []), *files[base.buckets].get(b, [])] for b in {*base.live, *files[base.buckets]}}
            return self._put(base, live, base.properties).version

        return self._retried(attempt)

    def insert_or_ignore(self, rows: DataFrame, value: str | None = None) -> int:
        """Add rows whose key isn't held; how many. With `value`, a key held (or given twice) with another value is an error."""

        def attempt(base: Snapshot) -> int:
            held = self._of(base.folders())
            if value:
                both = held.select(*self.keys, value).union(rows.select(*self.keys, value)).groupBy(*self.keys).agg(F.countDistinct(value).alias("n"), F.count_if(F.col(value).isNull()).alias("nulls"))
                if not both.where("n > 1 or (n = 1 and nulls > 0)").isEmpty():
                    raise ValueError(f"a key of {self.path} is held with another {value}")
            added = self._write(self._firsts(rows).join(held.select(*self.keys), self.keys, "left_anti"), base.buckets)
            if not added:
                return 0
            live = {b: [*base.live.get(b, []), *added.get(b, [])] for b in {*base.live, *added}}
            self._put(base, live, base.properties)
            return self._of([f for fs in added.values() for f in fs]).count()

        return self._retried(attempt)

    def replace(self, rows: DataFrame, retired: DataFrame | None = None, properties: dict[str, str] | None = None) -> list[int]:
        """Put rows in place of those with their keys, and drop the keys in retired; the buckets whose files changed.

        Buckets without any of these keys keep their files.
        """
        changed: list[int] = []
        keys = rows.select(*self.keys) if retired is None else rows.select(*self.keys).union(retired.select(*self.keys))
        keys = staged(keys.distinct(), "keys")

        def attempt(base: Snapshot) -> int:
            touched = sorted(r[0] for r in keys.select(self._bucket(base.buckets)).distinct().collect())  # at most the number of buckets
            rest = self._without(base.folders(touched), keys)
            files = self._write(rest.unionByName(self._firsts(rows)), base.buckets, where_they_lie=True) if touched else {}
            live = {b: f for b, f in base.live.items() if int(b) not in touched} | files
            changed[:] = touched
            return self._put(base, live, base.properties | (properties or {})).version

        self._retried(attempt)
        return changed

    def overwrite(self, rows: DataFrame, properties: dict[str, str] | None = None) -> int:
        """rows in place of all there is; they may be read from this table."""

        def attempt(base: Snapshot) -> int:
            return self._put(base, self._write(rows, base.buckets), base.properties | (properties or {})).version

        return self._retried(attempt)

    def compact(self) -> int:
        """One folder for each bucket."""

        def attempt(base: Snapshot) -> int:
            many = [int(b) for b, f in base.live.items() if len(f) > 1]
            files = self._write(self._of(base.folders(many)), base.buckets) if many else {}
            return self._put(base, {b: f for b, f in base.live.items() if int(b) not in many} | files, base.properties).version

        return self._retried(attempt)

    def vacuum(self, keep: int = 1) -> int:
        """Delete manifests but for the newest `keep` and files that none of those names; not safe beside a writer."""
        versions = self._versions()
        kept = {f.split("/bucket=")[0] for v in versions[-keep:] for f in self.snapshot(v).folders()}
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.path}/manifest/{v:08d}.json"), False)
        data = self._path(f"{self.path}/data")
        gone = [s.getPath() for s in self._fs.listStatus(data) if f"data/{s.getPath().getName()}" not in kept] if self._fs.exists(data) else []
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)
