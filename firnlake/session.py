"""Session settings and the shared folder used for written intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that change results or plan quality and can be set on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # keep the skew split even when it costs one more shuffle above the join
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


# A scanned piece of a table becomes several wide events per row before they are combined per key; the
# sort that combines them must fit a task's memory, or it spills all of them.
PIECE = "spark.sql.files.maxPartitionBytes"
PIECE_BYTES = 8 << 20
# Spark counts a small file as so many bytes; at its own 4 MB a piece would hold two files, not 32
OPEN = "spark.sql.files.openCostInBytes"
OPEN_BYTES = PIECE_BYTES // 32

# A step's shuffle files go when the step has ended, not when the driver happens to collect its garbage. Who
# reads them again makes them again.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_UNITS = {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30, "t": 40, "tb": 40}


def _size(text: str) -> int:
    """Bytes of a size as settings write it: 16m, 64kb, 134217728b."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([a-z]*)\s*", text.lower()).groups()
    return int(number) << _UNITS[unit]


def release_shuffles(spark: SparkSession) -> None:
    """For jobs of many steps whose results are stored: the disk holds the shuffle files of the running step only."""
    spark.conf.set(RELEASE, "true")


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every job in this package relies on."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    for key, most in ((PIECE, PIECE_BYTES), (OPEN, OPEN_BYTES)):
        if _size(spark.conf.get(key)) > most:
            spark.conf.set(key, str(most))
    return spark


def local_session(cpus: int = 8, app: str = "firnlake", memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="firnlake-warehouse-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # call-site capture on every column expression slows down building plans; static
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where the session names none and runs on a single machine (tests), a temporary one is
    set; on a cluster the executors could not see it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="firnlake-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused folder below the shared one."""
    return f"{shared_dir(spark)}/firnlake/{label}-{uuid.uuid4().hex}"
