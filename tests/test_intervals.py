import random
from datetime import date, datetime, timedelta

import pytest

from pyspark.sql import functions as F

from firnlake.operators.intervals import components, resolve_validity

SCHEMA = ("partner_id string, address_type string, address_id string, action string, valid_from date, "
          "valid_to date, arrived_at timestamp, arrival_id long")
T0 = datetime(2024, 1, 1)


def entries(spark, rows):
    return spark.createDataFrame(
        [(p, t, a, act, f, e, T0 + timedelta(seconds=i), i) for i, (p, t, a, act, f, e) in enumerate(rows)], SCHEMA
    )


def run(spark, rows, **kwargs):
    return {
        (r.partner_id, r.address_type, r.address_id): (r.valid_from, r.valid_to)
        for r in resolve_validity(entries(spark, rows), **kwargs).collect()
    }


def one(spark, *periods):
    got = run(spark, [("p", "RESIDENCE", f"a{i}", "ADD", f, t) for i, (f, t) in enumerate(periods)])
    return {k[2]: v for k, v in got.items()}


D = date


@pytest.mark.parametrize(
    "periods, expected",
    [
        # overlap, adjacent, shared day, open end, contained, enclosing (cut, not split)
        ([(D(2020, 1, 1), D(2020, 12, 31)), (D(2020, 6, 1), D(2021, 6, 30))],
         {"a0": (D(2020, 1, 1), D(2020, 5, 31)), "a1": (D(2020, 6, 1), D(2021, 6, 30))}),
        ([(D(2020, 1, 1), D(2020, 12, 31)), (D(2021, 1, 1), None)],
         {"a0": (D(2020, 1, 1), D(2020, 12, 31)), "a1": (D(2021, 1, 1), None)}),
        ([(D(2020, 1, 1), D(2020, 12, 31)), (D(2020, 12, 31), None)],
         {"a0": (D(2020, 1, 1), D(2020, 12, 30)), "a1": (D(2020, 12, 31), None)}),
        ([(D(2020, 1, 1), None), (D(2025, 1, 1), None)],
         {"a0": (D(2020, 1, 1), D(2024, 12, 31)), "a1": (D(2025, 1, 1), None)}),
        ([(D(2021, 1, 1), D(2021, 12, 31)), (D(2020, 1, 1), None)], {"a1": (D(2020, 1, 1), None)}),
        ([(D(2020, 1, 1), None), (D(2021, 1, 1), D(2021, 12, 31))],
         {"a0": (D(2020, 1, 1), D(2020, 12, 31)), "a1": (D(2021, 1, 1), D(2021, 12, 31))}),
        ([(D(2021, 6, 1), None), (D(2021, 1, 1), D(2021, 12, 31))],
         {"a0": (D(2022, 1, 1), None), "a1": (D(2021, 1, 1), D(2021, 12, 31))}),
    ],
)
def test_cases(spark, periods, expected):
    assert one(spark, *periods) == expected


def test_update_moves_the_next_start(spark):
    rows = [
        ("p", "RESIDENCE", "a", "ADD", D(2015, 1, 1), D(2019, 12, 31)),
        ("p", "RESIDENCE", "b", "ADD", D(2020, 1, 1), None),
        ("p", "RESIDENCE", "a", "UPDATE", D(2015, 1, 1), D(2020, 6, 30)),
        ("p", "RESIDENCE", "zz", "UPDATE", D(2015, 1, 1), None),
        ("p", "DELIVERY", "c", "ADD", D(2016, 1, 1), None),
        ("p", "DELIVERY", "bad", "ADD", D(2018, 1, 1), D(2017, 1, 1)),
    ]
    got = run(spark, rows)
    assert got == {
        ("p", "RESIDENCE", "a"): (D(2015, 1, 1), D(2020, 6, 30)),
        ("p", "RESIDENCE", "b"): (D(2020, 7, 1), None),
        ("p", "DELIVERY", "c"): (D(2016, 1, 1), None),
    }


def brute(rows):
    """The rule as stated, entry by entry, without any ordering trick."""
    groups = {}
    for p, t, a, act, f, e in rows:
        live = groups.setdefault((p, t), {})
        if e is not None and f > e or act == "UPDATE" and a not in live:
            continue
        for other, (of, oe) in list(live.items()):
            if other == a and act == "UPDATE":
                continue
            if (e is not None and of > e) or (oe is not None and oe < f):
                continue
            if of < f:
                live[other] = (of, f - timedelta(days=1))
            elif e is not None and (oe is None or oe > e):
                live[other] = (e + timedelta(days=1), oe)
            else:
                del live[other]
        live[a] = (f, e)
    return {(p, t, a): v for (p, t), live in groups.items() for a, v in live.items()}


def test_random_against_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        f = D(2020, 1, 1) + timedelta(days=rng.randrange(400))
        e = None if rng.random() < 0.2 else f + timedelta(days=rng.randrange(-3, 60))
        act = "UPDATE" if rng.random() < 0.2 else "ADD"
        # one person holds a third of all entries
        p = "hot" if rng.random() < 0.34 else f"p{rng.randrange(30)}"
        a = f"a{rng.randrange(i + 1)}" if act == "UPDATE" else f"a{i}"
        rows.append((p, rng.choice(["RESIDENCE", "DELIVERY"]), a, act, f, e))
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, hot=5) == brute(rows)


def test_a_hot_person_lies_in_many_components(spark):
    """Spans of one person over many years: they fall apart into components that are folded one by one."""
    rng = random.Random(11)
    rows, starts = [], []
    for i in range(4000):
        move = rng.randrange(i) if i and rng.random() < 0.1 else None
        day = rng.randrange(60_000) if move is None else starts[move] + rng.randrange(40)
        starts.append(day)
        f = D(1900, 1, 1) + timedelta(days=day)
        e = None if day > 59_500 and rng.random() < 0.3 else f + timedelta(days=rng.randrange(20))
        rows.append(("hot", "RESIDENCE", f"a{i if move is None else move}", "ADD" if move is None else "UPDATE", f, e))
    rows += [("cold", "RESIDENCE", f"c{i}", "ADD", D(2020, 1, 1 + i), None) for i in range(5)]
    assert run(spark, rows, hot=100) == brute(rows)
    days = entries(spark, rows).filter("valid_to is null or valid_from <= valid_to").selectExpr(
        "partner_id", "address_type", "address_id", "unix_date(valid_from) AS lo", "coalesce(unix_date(valid_to), 2147483647) AS hi")
    parts = components(days).groupBy("partner_id").agg(F.countDistinct("part").alias("n")).collect()
    n = {r.partner_id: r.n for r in parts}
    assert n["hot"] > 50 and n["cold"] == 1
