"""Tables kept by key in hash buckets, changed by copy-on-write.

Every row lies in the bucket of its key's hash. A merge reads and rewrites the buckets that its source
touches and leaves the files of the others as they are. A manifest per version lists the folder of
each bucket, so a version is one small file and readers always see a whole one.

Writers work side by side: each writes its buckets to a folder of its own and then claims the next version by
creating its manifest, which fails if the file is there. Who comes second merges again into the new state. A writer
that dies leaves files no manifest names; they go when old versions are dropped.

The number of buckets is fixed when the table is made; it bounds the manifest and what the driver sees.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firnlake.sources.lake import filesystem

BUCKETS = 64
KEPT_VERSIONS = 3
END = "\n"  # a manifest that does not end so was not written to its end


class ConcurrentWrite(RuntimeError):
    """Another writer took the version."""


class BucketTable:
    """A table with at most one row per ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS, kept: int = KEPT_VERSIONS):
        self.spark, self.path, self.key, self.kept = spark, path.rstrip("/"), key, kept
        found = self.manifest()
        self.buckets = found["buckets"] if found else buckets

    # -- manifests ----------------------------------------------------------------------------

    def _file(self, version: int) -> str:
        return f"{self.path}/manifests/{version:012d}.json"

    def _text(self, version: int) -> str:
        fs, p = filesystem(self.spark, self._file(version))
        stream = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _listed(self) -> list[int]:
        fs, p = filesystem(self.spark, f"{self.path}/manifests")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))

    def versions(self) -> list[int]:
        """Finished versions."""
        return [v for v in self._listed() if self._text(v).endswith(END)]

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of a version, or of the newest; None if there is none."""
        for v in reversed(self._listed()):
            if version is None or v == version:
                text = self._text(v)
                if text.endswith(END):
                    return json.loads(text) | {"version": v}
        return None

    def _claim(self, version: int, manifest: dict) -> None:
        fs, p = filesystem(self.spark, self._file(version))
        try:
            stream = fs.create(p, False)  # fails if the file is there
        except Py4JJavaError as error:
            if fs.exists(p):
                raise ConcurrentWrite(self._file(version)) from error
            raise
        try:
            stream.write((json.dumps(manifest) + END).encode())
        finally:
            stream.close()

    # -- reading ------------------------------------------------------------------------------

    def bucket(self, key: str | Column) -> Column:
        column = F.col(key) if isinstance(key, str) else key
        return F.pmod(F.xxhash64(column.cast("string")), F.lit(self.buckets)).cast("int")

    def _read(self, manifest: dict | None, only: Sequence[int] | None = None) -> DataFrame | None:
        if manifest is None:
            return None
        schema = T.StructType.fromJson(manifest["schema"])
        folders = [f"{self.path}/{f}" for b, f in manifest["folders"].items() if only is None or int(b) in set(only)]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def read(self, version: int | None = None) -> DataFrame | None:
        """A version as a whole; None before the first write."""
        return self._read(self.manifest(version))

    def touched(self, keys: DataFrame, key: str | None = None) -> list[int]:
        """The buckets in which the keys lie: at most as many as the table has."""
        found = keys.select(self.bucket(key or self.key).alias("bucket")).distinct().collect()
        return sorted(r.bucket for r in found)

    def lookup(self, keys: DataFrame, key: str | None = None, version: int | None = None) -> DataFrame | None:
        """The rows in the buckets of some keys (and others in them); the rest of the table is not read."""
        manifest = self.manifest(version)
        return None if manifest is None else self._read(manifest, self.touched(keys, key))

    # -- writing ------------------------------------------------------------------------------

    def _stored(self, df: DataFrame) -> str:
        place = f"data/{uuid.uuid4().hex}"
        bucket = self.bucket(self.key)
        df.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{place}")
        return place

    def _written(self, place: str) -> list[int]:
        fs, p = filesystem(self.spark, f"{self.path}/{place}")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return [int(n.split("=")[1]) for n in names if n.startswith("_bucket=") and n[8:].isdigit()]

    def merge(self, source: DataFrame, merged: Callable[[DataFrame | None, DataFrame], DataFrame], tries: int = 10) -> int:
        """Put ``source`` into the table by ``merged(rows of its buckets, source)``; gives the new version.

        ``source`` is computed once and must fit what ``merged`` expects; rows with a null key are left out.
        """
        source = source.filter(F.col(self.key).isNotNull())
        inbox = f"{self.path}/inbox/{uuid.uuid4().hex}"
        source.write.parquet(inbox)
        source = self.spark.read.schema(source.schema).parquet(inbox)
        hit = self.touched(source)
        for _ in range(tries):
            before = self.manifest()
            out = merged(self._read(before, hit), source) if before else merged(None, source)
            if before and not hit:
                break
            place = self._stored(out)
            folders = dict(before["folders"]) if before else {}
            for b in hit:
                folders.pop(str(b), None)
            folders |= {str(b): f"{place}/_bucket={b}" for b in self._written(place)}
            schema = out.schema if not before else T.StructType.fromJson(before["schema"])
            manifest = {"buckets": self.buckets, "key": self.key, "schema": json.loads(schema.json()), "folders": folders}
            version = (self._listed() or [-1])[-1] + 1 if before is None else before["version"] + 1
            while version in self._unfinished():  # left by a writer that died while claiming
                version += 1
            try:
                self._claim(version, manifest)
            except ConcurrentWrite:
                continue
            self._forget()
            self._delete(inbox)
            return version
        else:
            raise ConcurrentWrite(f"{self.path}: no version free after {tries} tries")
        self._delete(inbox)
        return before["version"]

    def _unfinished(self) -> set[int]:
        return set(self._listed()) - set(self.versions())

    def _delete(self, path: str) -> None:
        fs, p = filesystem(self.spark, path)
        fs.delete(p, True)

    def _forget(self) -> None:
        """Drop manifests beyond the kept ones, and the bucket folders that only they named."""
        done = self.versions()
        old, kept = done[: -self.kept], done[-self.kept :]
        if not old:
            return
        used = reduce(set.union, (set(self.manifest(v)["folders"].values()) for v in kept))
        for v in old:
            gone = self.manifest(v)
            self._delete(self._file(v))
            for folder in set(gone["folders"].values()) - used if gone else ():
                self._delete(f"{self.path}/{folder}")
