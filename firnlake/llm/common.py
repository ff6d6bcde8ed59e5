"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnlake.session import new_path
from firnlake.sources.lake import filesystem

# The white space of the word definition, U+0020 and U+0009 to U+000D.
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete what :func:`stored` wrote, once no later step reads it."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        fs, path = filesystem(spark, folder)
        fs.delete(path, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bitmap(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of 2 ** ``bits`` places of a column of 64-bit hashes: of fixed size, whatever the number of rows."""
    slot = F.col(column).bitwiseAND((1 << bits) - 1)
    place, bit = F.shiftright(slot, 6), F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))")
    found = hashes.select(place.alias("place"), bit.alias("bit")).groupBy("place").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[found.column("place").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2500


def in_small_batches(spark: SparkSession) -> None:
    """Rows go to Python by ``BATCH_ROWS`` at most: the JVM and every worker hold a few batches and keep that memory."""
    rows = int(spark.conf.get(BATCH))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(BATCH, str(BATCH_ROWS))


TASK_BYTES = 256 << 20


def in_large_tasks(df: DataFrame) -> DataFrame:
    """``df`` read by tasks of up to ``TASK_BYTES``, but two for every core: what a task sums up meets more of its kind.

    Splits are joined, not shuffled.
    """
    spark = df.sparkSession
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    parts = df.rdd.getNumPartitions()
    wanted = max(2 * spark.sparkContext.defaultParallelism, -(-parts * split // TASK_BYTES))
    return df.coalesce(wanted) if wanted < parts else df
