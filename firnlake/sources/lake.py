"""Lake tables on Parquet: scans, versioned snapshots, change logs, date-range loads."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnlake.operators.latest import latest_per_key

# The namespaces of the lake.
NAMESPACES = [
    "partner_silver", "policy_silver", "claims_silver", "billing_silver", "product_silver",
    "hr_silver", "partner_gold", "policy_gold", "claims_gold", "billing_gold", "hr_gold",
    "analytics",
]


def create_namespaces(spark: SparkSession) -> None:
    for name in NAMESPACES:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")


def scan(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A whole Parquet table; filters and column choice reach the scan."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def filesystem(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = filesystem(spark, path)
    return fs.exists(p)


def create_new(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False if it is there already, whoever made it."""
    fs, p = filesystem(spark, path)
    try:
        fs.create(p, False).close()
    except Py4JJavaError:
        if fs.exists(p):
            return False
        raise
    return True


def _numbers(spark: SparkSession, path: str, prefix: str, start: int | None = None) -> list[int]:
    """The numbers N, from ``start`` on, of the committed sub-folders ``prefix``N."""
    fs, p = filesystem(spark, path)
    if not fs.exists(p):
        return []
    found = []
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        if not name.startswith(prefix):
            continue
        number = int(name[len(prefix):])
        if start is not None and number < start:
            continue
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")):
            found.append(number)
    return sorted(found)


class SnapshotTable:
    """A table rewritten as a whole: each write is a new version, readers see the newest
    finished one, and a path being read is never overwritten.

    A version is claimed by creating a file that must not exist, so two writers never take one; the
    newest ``kept`` versions stay.  A repeated write of a named version replaces it, so a retried job
    does no harm.  Large tables under frequent loads are better kept in buckets
    (:class:`firnlake.sources.buckets.BucketTable`).
    """

    def __init__(self, spark: SparkSession, path: str, kept: int = 10):
        self.spark, self.path, self.kept = spark, path.rstrip("/"), kept

    def versions(self) -> list[int]:
        return _numbers(self.spark, self.path, "version=")

    def read(self) -> DataFrame | None:
        done = self.versions()
        if not done:
            return None
        return self.spark.read.parquet(f"{self.path}/version={done[-1]}")

    def _claim(self) -> int:
        done = self.versions()
        version = done[-1] + 1 if done else 0
        while not create_new(self.spark, f"{self.path}/_claims/{version}"):
            version += 1
        return version

    def write(self, df: DataFrame, version: int | None = None) -> int:
        version = self._claim() if version is None else version
        df.write.mode("overwrite").parquet(f"{self.path}/version={version}")
        for old in self.versions()[: -self.kept]:
            fs, p = filesystem(self.spark, f"{self.path}/version={old}")
            fs.delete(p, True)
        return version


class ChangeLog:
    """A read model kept as a log of changes, one folder per micro-batch.

    A batch writes only its own rows, however large the model is, and writing the same
    batch again replaces it.  The current state is folded when read.  From time to time
    the log so far is condensed into a base, so that readers start there.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def append(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/batch={batch_id}")

    def read(self, before_batch: int | None = None) -> DataFrame:
        """All logged rows with their ``batch``; optionally only those of earlier batches."""
        schema = f"{self.schema}, batch bigint"

        def earlier(n: int, limit: int | None) -> bool:
            return limit is None or n < limit

        bases = [n for n in _numbers(self.spark, self.path, "base=")
                 if before_batch is None or n <= before_batch]
        start = bases[-1] if bases else 0
        done = [n for n in _numbers(self.spark, self.path, "batch=", start) if earlier(n, before_batch)]
        parts = []
        if bases:
            parts.append(self.spark.read.schema(schema).parquet(f"{self.path}/base={start}"))
        if done:
            parts.append(
                self.spark.read.schema(schema).option("basePath", self.path)
                .parquet(*[f"{self.path}/batch={n}" for n in done])
            )
        if not parts:
            return self.spark.createDataFrame([], schema)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def only(self, batch_id: int) -> DataFrame:
        """What one batch has logged."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/batch={batch_id}")

    def condense(self, before_batch: int, key: Sequence[str], order: Sequence[str]) -> None:
        """Write the base of all batches before ``before_batch``: the newest row per ``key``.

        The rows keep the number of the batch they came from.
        """
        log = self.read(before_batch)
        rest = [c for c in log.columns if c not in key]
        newest = latest_per_key(log, key, order, rest)
        self.write_base(newest, before_batch)

    def write_base(self, df: DataFrame, before_batch: int) -> None:
        """A base, and an end of what the base before it has replaced: folders stay few."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/base={before_batch}")
        older = [n for n in _numbers(self.spark, self.path, "base=") if n < before_batch]
        if not older:
            return
        gone = [f"batch={n}" for n in _numbers(self.spark, self.path, "batch=") if n < older[-1]]
        for name in [*gone, *[f"base={n}" for n in older[:-1]]]:
            fs, p = filesystem(self.spark, f"{self.path}/{name}")
            fs.delete(p, True)


def append_range(df: DataFrame, path: str, time: str, day: str = "event_date", unit: str = "day") -> None:
    """Load of a date range: the days (or months) in ``df`` replace those of the table.

    The table is partitioned by the first day of each ``unit`` and only touched ones are
    rewritten.  Rows are dealt by ranges of (day, row hash), so that a day gets files in
    proportion to its rows.
    """
    (
        df.withColumn(day, F.date_trunc(unit, time).cast("date"))
        .repartitionByRange(day, F.xxhash64(*df.columns))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(day)
        .parquet(path)
    )


def rebuild(df: DataFrame, path: str, sort: Sequence[str] = (), kept: int = 2) -> None:
    """Full rebuild of a mart (read it with :func:`rebuilt`).

    The rows are written aside as a new version; it counts once it is finished, so readers never see a gap,
    a job that reads the mart may rebuild it, and a job that fails leaves the old rows.  Sorting within files
    tightens their min/max statistics.
    """
    out = df.sortWithinPartitions(*sort) if sort else df
    SnapshotTable(df.sparkSession, path, kept).write(out)


def rebuilt(spark: SparkSession, path: str) -> DataFrame:
    """The newest finished version of a rebuilt mart."""
    found = SnapshotTable(spark, path).read()
    if found is None:
        raise FileNotFoundError(path)
    return found
