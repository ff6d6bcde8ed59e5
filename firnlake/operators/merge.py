"""Incremental loads as DataFrame operators: interval filter, upsert, guarded upsert."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_interval(df: DataFrame, column: str, start: datetime | str, end: datetime | str) -> DataFrame:
    """Rows with ``start <= column <= end``; both ends belong to the interval."""
    return df.filter(
        F.col(column).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    )


def upsert(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Replace target rows whose key occurs in ``source``; add the rest of ``source``.

    The source must hold one row per key.
    """
    kept = target.join(source.select(key), key, "left_anti")
    return kept.unionByName(source)


def upsert_newer(
    target: DataFrame,
    source: DataFrame,
    key: str,
    version: str,
    keep_first: Sequence[str] = (),
) -> DataFrame:
    """Upsert that updates only when ``source.version > target.version``.

    Equal versions keep the target row.  ``keep_first`` columns hold on to the target's
    value once it is set.  A NULL on either side of the comparison does not update.
    """
    t, s = target.alias("t"), source.alias("s")
    joined = t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full_outer")
    newer = F.col(f"s.{version}") > F.col(f"t.{version}")
    inserted = F.col(f"t.{key}").isNull()
    take_source = inserted | F.coalesce(newer, F.lit(False))

    def pick(column: str):
        ours, theirs = F.col(f"t.{column}"), F.col(f"s.{column}")
        if column == key:
            return F.coalesce(ours, theirs).alias(column)
        if column in keep_first:
            theirs = F.coalesce(ours, theirs)
        return F.when(take_source, theirs).otherwise(ours).alias(column)

    return joined.select(*[pick(c) for c in target.columns])


def replace_range(
    target: DataFrame, source: DataFrame, column: str, start: datetime | str, end: datetime | str
) -> DataFrame:
    """Drop the target rows of the interval and put the source's rows of it in their place."""
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    outside = (F.col(column) < lo) | (F.col(column) > hi) | F.col(column).isNull()
    return target.filter(outside).unionByName(in_interval(source, column, start, end))


def merge_statement(
    table: str, source_view: str, key: str, columns: Sequence[str],
    version: str | None = None, keep_first: Sequence[str] = (),
) -> str:
    """The same upsert as one MERGE INTO, for catalogs whose tables support row-level updates."""
    guard = f" AND s.{version} > t.{version}" if version else ""
    sets = ", ".join(
        f"t.{c} = COALESCE(t.{c}, s.{c})" if c in keep_first else f"t.{c} = s.{c}"
        for c in columns if c != key
    )
    names = ", ".join(columns)
    values = ", ".join(f"s.{c}" for c in columns)
    return (
        f"MERGE INTO {table} t USING {source_view} s ON t.{key} = s.{key} "
        f"WHEN MATCHED{guard} THEN UPDATE SET {sets} "
        f"WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({values})"
    )
