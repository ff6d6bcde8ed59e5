"""Current row per key, and first event per key.

Both are aggregates, not windows: Spark combines them map-side, so a key that holds a
third of the table still sends only one row per map task through the shuffle.  The
latest row and the first-event time share one scan and one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(
    df: DataFrame,
    key: str | Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    *,
    when: Column | None = None,
    extras: Sequence[Column] = (),
) -> DataFrame:
    """One row per ``key`` holding ``columns`` of the row with the greatest ``order``.

    ``order`` is compared left to right with NULL lowest, which is ``DESC NULLS LAST``.
    The last entry should be unique per key so that ties cannot depend on task order;
    rows that are equal in ``order`` are compared by ``columns``, whose types must be orderable.
    ``when`` limits the rows that may win; ``extras`` are further aggregates over *all*
    rows of the key (a first-event minimum, a counter).  Keys without a winning row are
    left out, NULL keys too.
    """
    keys = [key] if isinstance(key, str) else list(key)
    # the ordering columns lead the row and are held once, though they may be wanted too
    row = F.struct(*[F.col(c) for c in dict.fromkeys([*order, *columns])])
    won = []
    if when is not None:
        # a NULL row is skipped by max, so losers never enter the buffer
        row = F.when(when, row)
        # of its own, so that who wants the keys only does not move the rows
        won = [F.max(F.when(when, True)).alias("_won")]
    grouped = (
        df.filter(reduce(and_, [F.col(k).isNotNull() for k in keys]))
        .groupBy(*keys)
        .agg(F.max(row).alias("_row"), *won, *extras)
    )
    if when is not None:
        grouped = grouped.filter("_won")
    kept = [c for c in grouped.columns if c not in (*keys, "_row", "_won")]
    return grouped.select(*keys, *[F.col("_row")[c].alias(c) for c in columns], *kept)


def carried_forward(
    df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Like :func:`latest_per_key`, but every column keeps its latest non-NULL value.

    Later thin events then do not blank what an earlier full event said.
    """
    rank = F.struct(*[F.col(c) for c in order])
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            *[
                F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c)
                for c in columns
            ]
        )
    )


def first_time(kind_column: str, kind: str, time_column: str, name: str) -> Column:
    """Aggregate: the earliest ``time_column`` among rows of one event kind."""
    return F.min(F.when(F.col(kind_column) == kind, F.col(time_column))).alias(name)
