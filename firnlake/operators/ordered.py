"""Ordered computations per key that survive hot keys.

A plain window sorts all rows of a key in one task.  Here the rows are dealt by ranges of
(key, time, tie), so a key with many rows, even with many at one time, lies in many ranges
of like size.  Each (key, range) is its own window group, and a second pass over one or two rows
per group carries the results from range to range.  A task then holds one range, or the edges of
one key, whose number is bounded by the number of ranges.

The ranges are drawn from a sample, so they are written once and all passes read the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firnlake.session import new_path


def in_ranges(df: DataFrame, order: Sequence[str], label: str = "ranges") -> DataFrame:
    """``df`` with ``_block``: the number of the row's range in the given order.

    The rows are written before they are sampled, so what leads to them is computed once.
    """
    spark, plain, dealt = df.sparkSession, new_path(df.sparkSession, f"{label}-rows"), new_path(df.sparkSession, label)
    df.write.parquet(plain)
    rows = spark.read.schema(df.schema).parquet(plain)
    rows.repartitionByRange(*order).withColumn("_block", F.spark_partition_id()).write.parquet(dealt)
    return spark.read.parquet(dealt)


def lag_per_key(df: DataFrame, keys: Sequence[str], time: str, tie: str, value: str, name: str) -> DataFrame:
    """Adds ``name``: ``value`` of the key's previous row in (time, tie) order.

    ``value`` must not be NULL, so that NULL in the result means "first row".  The
    predecessor of a range's first row is the last row of an earlier range; only the
    first and last rows of the ranges go into the second window.
    """
    inner = Window.partitionBy(*keys, "_block").orderBy(time, tie)
    rows = in_ranges(df, [*keys, time, tie]).withColumns(
        {"_prev": F.lag(value).over(inner), "_next": F.lead(value).over(inner)}
    )
    within = rows.filter(F.col("_prev").isNotNull()).withColumn(name, F.col("_prev"))
    across = Window.partitionBy(*keys).orderBy("_block", time, tie)
    edges = rows.filter(F.col("_prev").isNull() | F.col("_next").isNull())
    firsts = edges.withColumn(name, F.lag(value).over(across)).filter(F.col("_prev").isNull())
    return within.unionByName(firsts).drop("_block", "_prev", "_next")


def carried(sizes: DataFrame, keys: Sequence[str], total: Column, name: str) -> DataFrame:
    """Per (key, range): ``total`` over the key's earlier ranges; keys are renamed for a null-safe join."""
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(*[F.col(c).alias(f"_o{c}") for c in (*keys, "_block")], total.over(before).alias(name))


def with_carried(rows: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with what :func:`carried` has for their key and range."""
    names = [*keys, "_block"]
    joined = rows.join(offsets, [F.col(c).eqNullSafe(F.col(f"_o{c}")) for c in names], "left")
    return joined.drop(*[f"_o{c}" for c in names])


def number_per_key(df: DataFrame, keys: Sequence[str], time: str, tie: str, name: str) -> DataFrame:
    """Adds ``name``: 1, 2, 3 … of the row within its key in (time, tie) order."""
    blocked = in_ranges(df, [*keys, time, tie])
    inner = Window.partitionBy(*keys, "_block").orderBy(time, tie)
    rows = blocked.withColumn("_rn", F.row_number().over(inner))
    sizes = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    offsets = carried(sizes, keys, F.sum("_n"), "_before")
    counted = (F.col("_rn") + F.coalesce("_before", F.lit(0))).cast("bigint")
    return with_carried(rows, offsets, keys).withColumn(name, counted).drop("_block", "_rn", "_before")


def number_rows(df: DataFrame, order: Sequence[Column | str], name: str, start: int = 0) -> DataFrame:
    """Adds ``name``: start+1, start+2 … over the whole frame in the given order.

    The rows are range-partitioned and written once; the row count of each partition then
    gives its offset.  Only those counts, one per partition, pass through a single task.
    """
    path = new_path(df.sparkSession, "numbered")
    (
        df.repartitionByRange(*order)
        .withColumn("_part", F.spark_partition_id())
        .write.parquet(path)
    )
    stored = df.sparkSession.read.parquet(path)
    counts = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + start).alias("_before")
    )
    inner = Window.partitionBy("_part").orderBy(*order)
    return (
        stored.withColumn("_rn", F.row_number().over(inner))
        .join(offsets, "_part")
        .withColumn(name, (F.col("_rn") + F.col("_before")).cast("bigint"))
        .drop("_part", "_rn", "_before")
    )
