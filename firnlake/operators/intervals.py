"""Address validity per person and type: later entries trim earlier ones.

Entries apply in arrival order.  A stored interval that starts before a new one ends the
day before it (also when it encloses the new one); else one that outlasts it starts the
day after it; else it is dropped.  The outcome depends on the order, so it is a fold.

The fold streams over rows sorted by (person, type, arrival) and holds only the intervals
still alive.  Those never overlap, so their number is bounded by the days of the calendar
however many entries one person has.

Entries that lie apart never meet: a new interval trims only what it overlaps, and an update
takes its own former interval away.  So a (person, type) with more than ``HOT`` entries is cut
into components, the runs of overlapping spans, an address' span reaching from the first to the last day
it was ever given.  Each component is folded by itself.  A component is one fold, however large: an address
without an end reaches to the end of the calendar and keeps what starts after it in its component.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firnlake.operators.ordered import carried, in_ranges, with_carried
from firnlake.session import new_path

OPEN_END = 2**31 - 1
HOT = 100_000  # entries of a person and type from which on they are cut into components
_OUT = "partner_id string, address_type string, address_id string, lo int, hi int"


def place(live: list[tuple[int, int, str]], lo: int, hi: int, entry: str, held: dict[str, int] | None = None) -> None:
    """Put ``[lo, hi]`` into the disjoint, ascending list ``live``, trimming what it meets.

    ``held`` follows the first day of each address that lives; an address given twice counts as its last interval.
    """
    first = bisect_left(live, lo, key=lambda r: r[1])
    last = bisect_right(live, hi, key=lambda r: r[0])
    met = live[first:last]
    before = [(a, lo - 1, e) for a, _, e in met if a < lo]
    after = [(hi + 1, b, e) for a, b, e in met if a >= lo and b > hi]
    live[first:last] = [*before, (lo, hi, entry), *after]
    if held is not None:
        for a, b, e in met:
            if a >= lo and held.get(e) == a:
                if b > hi:
                    held[e] = hi + 1
                else:
                    del held[e]
        held[entry] = lo


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    group: tuple | None = None
    live: list[tuple[int, int, str]] = []
    held: dict[str, int] = {}  # first day of each living address
    out: list[tuple] = []
    for batch in batches:
        for person, kind, part, action, entry, lo, hi in batch.itertuples(index=False, name=None):
            if (person, kind, part) != group:
                out.extend((*group[:2], e, a, b) for a, b, e in live) if group else None
                group, live, held = (person, kind, part), [], {}
            if action == "UPDATE":
                if entry not in held:
                    continue
                live.pop(bisect_left(live, held.pop(entry), key=lambda r: r[0]))
            place(live, lo, hi, entry, held)
        if len(out) >= 50_000:
            yield _frame(out)
            out = []
    if group:
        out.extend((*group[:2], e, a, b) for a, b, e in live)
    yield _frame(out)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["partner_id", "address_type", "address_id", "lo", "hi"])


GROUP = ["partner_id", "address_type"]


def components(days: DataFrame) -> DataFrame:
    """(partner_id, address_type, address_id, part): the first day of the component each address lies in.

    A component starts where a span begins after all earlier ones have ended.  Ends and starts are carried
    from range to range of (person, type, first day), so a hot person's spans lie in many tasks.
    """
    spans = days.groupBy(*GROUP, "address_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    rows = in_ranges(spans, [*GROUP, "lo", "address_id"], "spans")
    ends = carried(rows.groupBy(*GROUP, "_block").agg(F.max("hi").alias("_hi")), GROUP, F.max("_hi"), "_ended")
    order = Window.partitionBy(*GROUP, "_block").orderBy("lo", "address_id")
    earlier = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = with_carried(rows.withColumn("_earlier", earlier), ends, GROUP)
    reach = F.greatest("_ended", "_earlier")  # of what is not null
    rows = rows.withColumn("_start", F.when(reach.isNull() | (F.col("lo") > reach), F.col("lo")))
    path = new_path(days.sparkSession, "span-starts")
    rows.drop("_ended", "_earlier").write.parquet(path)
    rows = days.sparkSession.read.parquet(path)
    # starts ascend, so the last one so far is the largest
    starts = carried(rows.groupBy(*GROUP, "_block").agg(F.max("_start").alias("_s")), GROUP, F.max("_s"), "_begun")
    last = F.max("_start").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = with_carried(rows.withColumn("_last", last), starts, GROUP)
    return rows.select(*GROUP, "address_id", F.coalesce("_last", "_begun").alias("part"))


def resolve_validity(entries: DataFrame, hot: int = HOT) -> DataFrame:
    """Final validity of each surviving address.

    ``entries``: partner_id, address_type, address_id, action (ADD or UPDATE), valid_from,
    valid_to (NULL = open), arrived_at, arrival_id.  Entries that end before they start, and
    updates of unknown addresses, change nothing.
    """
    days = entries.filter(
        F.col("valid_from").isNotNull()
        & (F.col("valid_to").isNull() | (F.col("valid_from") <= F.col("valid_to")))
    ).select(
        "partner_id", "address_type", "action", "address_id",
        F.unix_date("valid_from").alias("lo"),
        F.coalesce(F.unix_date("valid_to"), F.lit(OPEN_END)).alias("hi"),
        "arrived_at", "arrival_id",
    )
    path = new_path(entries.sparkSession, "address-entries")
    days.write.parquet(path)
    days = entries.sparkSession.read.parquet(path)
    large = days.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot).select(*[F.col(c).alias(f"_l{c}") for c in GROUP])
    if large.isEmpty():
        parted = days.withColumn("part", F.lit(0))
    else:
        is_large = [F.col(c).eqNullSafe(F.col(f"_l{c}")) for c in GROUP]
        held = days.join(large, is_large, "left_semi")
        place = components(held).select(*[F.col(c).alias(f"_p{c}") for c in (*GROUP, "address_id")], "part")
        same = [F.col(c).eqNullSafe(F.col(f"_p{c}")) for c in (*GROUP, "address_id")]
        parted = days.join(large, is_large, "left_anti").withColumn("part", F.lit(0)).unionByName(held.join(place, same).select(*days.columns, "part"))
    ordered = (
        parted.repartition(*GROUP, "part")
        .sortWithinPartitions(*GROUP, "part", "arrived_at", "arrival_id")
        .select(*GROUP, "part", "action", "address_id", "lo", "hi")
    )
    return ordered.mapInPandas(_fold, _OUT).select(
        "partner_id", "address_type", "address_id",
        F.date_from_unix_date("lo").alias("valid_from"),
        F.when(F.col("hi") != OPEN_END, F.date_from_unix_date("hi")).alias("valid_to"),
    )
