"""Equi-join helpers: enrichment, orphan search, read-model lookups.

No side is broadcast by hint.  Spark broadcasts a side when its measured size is below
``spark.sql.autoBroadcastJoinThreshold`` (statically or, under AQE, from the finished
shuffle) and otherwise joins by shuffle, splitting skewed partitions of the left side.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def detached(key: str) -> Column:
    """A (text) key marked with a prefix, to be compared with another marked key.

    AQE splits a skewed join only when both sides come straight from a shuffle.  A lookup
    side that was just grouped by the key would be joined without one, and a hot key of
    the other side would stay in one task.  Marked keys make both sides shuffle for the
    join; the lookup side, one row per key, is the cheap one to move again.
    """
    return F.concat(F.lit("="), F.col(key))


def enrich(
    facts: DataFrame,
    dims: DataFrame,
    on: tuple[str, str],
    columns: dict[str, str],
    *,
    spread_by: str | None = None,
    unique: bool = False,
) -> DataFrame:
    """Left join ``facts.on[0] == dims.on[1]`` adding ``columns`` (dim name -> new name).

    Thin events leave many foreign keys NULL.  Such rows can never match, yet a plain
    join would send them all to one task.  With ``spread_by``, a text column of
    ``facts``, they travel on a stand-in made from that column.  Keys are text.
    ``unique`` says that ``facts`` has one row per key, so there is no skew to prepare for.
    """
    left_key, right_key = on
    picked = dims.select(
        (F.col(right_key) if unique else detached(right_key)).alias("_dim_key"),
        *[F.col(src).alias(dst) for src, dst in columns.items()],
    )
    key = F.col(left_key) if unique else detached(left_key)
    if spread_by is not None:
        key = F.coalesce(key, F.concat(F.lit("~"), F.col(spread_by)))  # never a marked key
    return facts.join(picked, key == F.col("_dim_key"), "left").drop("_dim_key")


def orphans(
    facts: DataFrame, dims: DataFrame, on: tuple[str, str], *, nulls_are_orphans: bool
) -> DataFrame:
    """Rows of ``facts`` whose key has no partner in ``dims``.

    Rows with a NULL key never match; they either count as orphans (a foreign key that
    must be set) or are left out (an optional one).  They skip the join in both cases.
    """
    left_key, right_key = on
    keys = dims.select(detached(right_key).alias("_dim_key")).filter(F.col("_dim_key").isNotNull())
    known = facts.filter(F.col(left_key).isNotNull())
    missing = known.join(keys, detached(left_key) == F.col("_dim_key"), "left_anti")
    if nulls_are_orphans:
        missing = missing.unionByName(facts.filter(F.col(left_key).isNull()))
    return missing


def flag_match(facts: DataFrame, dims: DataFrame, on: tuple[str, str], flag: str) -> DataFrame:
    """Adds ``flag``: whether the row's key occurs in ``dims`` (coverage check of claims)."""
    left_key, right_key = on
    keys = dims.select(right_key).distinct().select(detached(right_key).alias("_dim_key"))
    joined = facts.join(keys, detached(left_key) == F.col("_dim_key"), "left")
    return joined.withColumn(flag, F.col("_dim_key").isNotNull()).drop("_dim_key")


def side_by_side(*rows: DataFrame) -> DataFrame:
    """Single-row frames with different columns as one row, without a cross join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def latest_lookup(
    df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Lookup table: ``columns`` of the newest row per key (combined map-side)."""
    return df.groupBy(key).agg(
        *[F.max_by(c, F.struct(*order)).alias(c) for c in columns]
    )


def with_children(
    parents: DataFrame, children: DataFrame, on: tuple[str, str]
) -> DataFrame:
    """Parents with their child rows, one output row per pair, childless parents kept.

    The pairs stay flat: nesting them would put all children of one parent in one row,
    which has no size bound.  Pairs come from an inner join, where a parent with very many
    children can be split over tasks (a left join could not split its right side).
    """
    parent_key, child_key = on
    right = children.withColumnRenamed(child_key, "_child_key")
    match = F.col(parent_key) == F.col("_child_key")
    pairs = parents.join(right, match).drop("_child_key")
    childless = parents.join(right.select("_child_key").distinct(), match, "left_anti")
    return pairs.unionByName(childless, allowMissingColumns=True)


def exists(df: DataFrame, condition: Column) -> bool:
    """Whether any row satisfies the condition; stops at the first hit."""
    return not df.filter(condition).limit(1).isEmpty()
