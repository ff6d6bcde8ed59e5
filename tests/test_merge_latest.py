import glob
import io
import os
import random
from contextlib import redirect_stdout
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import as_set
from firnlake.operators import lookup, merge, ordered
from firnlake.operators.latest import latest_per_key
from firnlake.plans.models import MODELS, run_interval
from firnlake.sources.buckets import BucketTable
from firnlake.sources.lake import ChangeLog, SnapshotTable, append_range, rebuild, rebuilt

T0 = datetime(2024, 1, 1)
ROW = "k string, v string, first timestamp, at timestamp"


def test_latest_takes_newest_and_breaks_ties(spark):
    df = spark.createDataFrame(
        [("a", T0, "1", "x"), ("a", T0, "2", "y"), ("b", None, "1", "n"), ("b", T0, "0", "t"), (None, T0, "9", "z")],
        "k string, at timestamp, id string, v string",
    )
    got = latest_per_key(df, "k", ["at", "id"], ["v"])
    assert as_set(got) == {("a", "y"), ("b", "t")}


def test_latest_limits_winners_but_not_extras(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("b", 9, "z")], "k string, n int, v string")
    got = latest_per_key(df, "k", ["n"], ["v"], when=F.col("n") < 5, extras=[F.max("n").alias("top")])
    assert as_set(got) == {("a", "x", 5)}


def frame(spark, rows):
    return spark.createDataFrame(rows, ROW)


def test_plain_upsert_lets_old_rows_win(spark):
    t = frame(spark, [("a", "new", T0, T0 + timedelta(days=5)), ("b", "keep", T0, T0)])
    s = frame(spark, [("a", "old", T0, T0), ("c", "add", T0, T0)])
    assert {(r.k, r.v) for r in merge.upsert(t, s, "k").collect()} == {("a", "old"), ("b", "keep"), ("c", "add")}


def test_guarded_upsert(spark):
    later = T0 + timedelta(days=1)
    t = frame(spark, [("a", "t", T0, T0), ("b", "t", T0, T0), ("c", "t", None, T0), ("e", "t", T0, None)])
    s = frame(spark, [("a", "tie", later, T0), ("b", "s", later, later), ("c", "s", later, later),
                      ("d", "s", later, later), ("e", "s", later, later)])
    got = {r.k: (r.v, r.first) for r in merge.upsert_newer(t, s, "k", "at", ["first"]).collect()}
    assert got == {"a": ("t", T0), "b": ("s", T0), "c": ("s", later), "d": ("s", later), "e": ("t", T0)}


def test_guarded_replay_is_order_free(spark):
    rng = random.Random(3)
    batches = []
    for n in range(4):
        batches.append([(f"k{i}", f"v{n}-{i}", T0, T0 + timedelta(minutes=7 * n + i)) for i in rng.sample(range(9), 5)])
    results = set()
    for order in ([0, 1, 2, 3], [3, 2, 1, 0], [2, 0, 3, 1]):
        state = frame(spark, batches[order[0]])
        for n in order[1:]:
            state = merge.upsert_newer(state, frame(spark, batches[n]), "k", "at", ["first"])
        results.add(frozenset((r.k, r.v) for r in state.collect()))
    assert len(results) == 1


def test_range_replace_is_inclusive(spark):
    t = spark.createDataFrame([("a", T0), ("b", T0 + timedelta(days=1)), ("c", T0 + timedelta(days=2))], "k string, at timestamp")
    s = spark.createDataFrame([("B", T0 + timedelta(days=1)), ("X", T0 + timedelta(days=9))], "k string, at timestamp")
    got = merge.replace_range(t, s, "at", "2024-01-01", "2024-01-02")
    assert {r.k for r in got.collect()} == {"B", "c"}


def test_merge_statement_has_guard_and_first_value():
    sql = merge.merge_statement("t", "s", "id", ["id", "a", "issued_at", "updated_at"], "updated_at", ["issued_at"])
    assert "s.updated_at > t.updated_at" in sql
    assert "t.issued_at = COALESCE(t.issued_at, s.issued_at)" in sql
    assert "t.id =" not in sql.split("UPDATE SET")[1].split("WHEN NOT")[0]


def test_snapshot_versions_and_repeated_write(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    assert table.read() is None
    table.write(spark.range(3))
    table.write(table.read().filter("id > 0"))
    assert table.versions() == [0, 1] and table.read().count() == 2
    table.write(spark.range(7), version=1)
    assert table.versions() == [0, 1] and table.read().count() == 7


def test_two_writers_take_two_versions_and_old_ones_go(spark, tmp_path):
    one, two = (SnapshotTable(spark, str(tmp_path / "t"), kept=2) for _ in range(2))
    assert (one._claim(), two._claim()) == (0, 1)  # both have read the same state
    for _ in range(4):
        one.write(spark.range(3))
    assert len(one.versions()) == 2


def test_rebuild_that_fails_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "mart")
    rebuild(spark.range(4), path, ["id"])
    broken = spark.range(100).select(F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("no")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="no"):
        rebuild(broken, path)
    assert rebuilt(spark, path).count() == 4
    rebuild(rebuilt(spark, path).filter("id > 0"), path)  # from itself
    assert rebuilt(spark, path).count() == 3


def bucket_files(path):
    """Files and their times, by bucket folder."""
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/data/*/_bucket=*/*.parquet")}


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    table = BucketTable(spark, path, "k", buckets=16)
    assert table.read() is None and table.lookup(spark.createDataFrame([("a",)], "k string")) is None
    rows = lambda ks, v: spark.createDataFrame([(f"k{i}", v) for i in ks] + [(None, v)], "k string, v int")
    merged = lambda t, s: s if t is None else merge.upsert(t, s, "k")
    table.merge(rows(range(200), 1), merged)
    first, before = table.manifest(), bucket_files(path)
    table.merge(rows([3, 300], 2), merged)
    second = table.manifest()
    hit = {str(b) for b in table.touched(rows([3, 300], 0).filter("k is not null"))}
    assert {b for b in second["folders"] if second["folders"][b] != first["folders"].get(b)} == hit and len(hit) <= 2
    after = bucket_files(path)
    assert all(after[f] == t for f, t in before.items())
    assert as_set(table.read()) == {(f"k{i}", 2 if i == 3 else 1) for i in range(200)} | {("k300", 2)}
    found = table.lookup(rows([3], 0).filter("k is not null"))
    assert {f.split("/_bucket=")[1].split("/")[0] for f in found.inputFiles()} <= hit
    table.merge(spark.createDataFrame([], "k string, v int"), merged)
    assert table.manifest()["version"] == second["version"]


def test_writers_side_by_side_lose_nothing(spark, tmp_path):
    """A second writer that commits in between is merged into, not overwritten."""
    path = str(tmp_path / "t")
    one, two = (BucketTable(spark, path, "k", buckets=4) for _ in range(2))
    row = lambda k, v: spark.createDataFrame([(k, v)], "k string, v int")
    plain = lambda t, s: s if t is None else merge.upsert(t, s, "k")
    one.merge(row("a", 1), plain)
    calls = []

    def slow(t, s):
        calls.append(1)
        if len(calls) == 1:
            two.merge(row("b", 2), plain)
            two.merge(row("c", 3), plain)
        return plain(t, s)

    one.merge(row("a", 9), slow)
    assert len(calls) == 2 and as_set(one.read()) == {("a", 9), ("b", 2), ("c", 3)}
    assert one.versions() == [1, 2, 3]


def test_a_writer_that_dies_while_claiming_blocks_nobody(spark, tmp_path):
    path = str(tmp_path / "t")
    table = BucketTable(spark, path, "k", buckets=2, kept=1)
    plain = lambda t, s: s if t is None else merge.upsert(t, s, "k")
    row = lambda k: spark.createDataFrame([(k,)], "k string")
    table.merge(row("a"), plain)
    with open(f"{path}/manifests/{1:012d}.json", "w") as file:
        file.write('{"buckets": 2')
    assert as_set(table.read()) == {("a",)}
    table.merge(row("b"), plain)
    assert as_set(table.read()) == {("a",), ("b",)}
    used = set(table.manifest()["folders"].values())
    left = {os.path.relpath(p, path) for p in glob.glob(f"{path}/data/*/_bucket=*")}
    assert used <= left


def test_runs_over_dated_tables_read_their_dates_only(spark, tmp_path, sf):
    """With the index of first events no run but the first reads a date outside its interval."""
    from firnlake.plans import silver
    from firnlake.plans.models import first_index
    from firnlake.workload import starschema as star

    raw = silver.with_event_time(star.claims_events(spark, sf)).withColumn("event_date", F.col("event_at").cast("date"))
    raw.write.partitionBy("event_date").parquet(str(tmp_path / "raw"))
    stored = spark.read.parquet(str(tmp_path / "raw"))
    model = MODELS["claims_silver.claim"]
    table = BucketTable(spark, str(tmp_path / "claim"), "claim_id", buckets=4)
    intervals = [("2024-01-15", "2024-01-31 23:59:59"), ("2024-01-01", "2024-01-20"), ("2024-01-18", "2024-01-22")]
    for interval in intervals:
        run_interval(table, model, stored, interval)
    assert as_set(table.read()) == as_set(silver.claim(raw).filter("updated_at <= '2024-01-31 23:59:59'"))
    begun = first_index(table, model, stored, intervals[-1])
    for df in (model.build(stored, intervals[-1], begun=begun), silver.first_events(stored, "claimid", "ClaimOpened", intervals[-1])):
        out = io.StringIO()
        with redirect_stdout(out):
            df.explain("formatted")
        scans = [x for x in out.getvalue().split("Scan parquet") if "eventtype" in x.split("ReadSchema")[-1].split("\n")[0] and "ReadSchema" in x]
        filters = [line for x in scans for line in x.splitlines() if line.startswith("PartitionFilters")]
        assert filters and all("2024-01-18" in f and "2024-01-22" in f for f in filters)


def test_change_log_batches_replace_themselves(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"), "id bigint")
    assert log.read().count() == 0
    log.append(spark.range(3), 0)
    log.append(spark.range(5), 1)
    log.append(spark.range(2), 1)
    assert log.read().count() == 5 and log.read(before_batch=1).count() == 3
    log.condense(2, ["id"], ["batch"])
    log.append(spark.range(2, 4), 2)
    assert sorted((r.id, r.batch) for r in log.read().collect()) == [(0, 1), (1, 1), (2, 0), (2, 2), (3, 2)]
    assert log.read(before_batch=2).count() == 3 and log.read(before_batch=1).count() == 3


def test_date_range_load_touches_only_its_days(spark, tmp_path):
    path = str(tmp_path / "days")
    mk = lambda rows: spark.createDataFrame(rows, "k string, at timestamp")
    append_range(mk([("a", T0), ("b", T0 + timedelta(days=1))]), path, "at")
    append_range(mk([("B", T0 + timedelta(days=1))]), path, "at")
    assert {r.k for r in spark.read.parquet(path).collect()} == {"a", "B"}


def test_model_interval_run(spark, tmp_path, sf):
    from firnlake.workload import starschema as star
    from firnlake.plans import silver

    raw = star.claims_events(spark, sf)
    model = MODELS["claims_silver.claim"]
    table = BucketTable(spark, str(tmp_path / "claim"), "claim_id", buckets=4)
    for interval in [("2024-01-15", "2024-01-31 23:59:59"), ("2024-01-01", "2024-01-20")]:
        run_interval(table, model, raw, interval)
    assert as_set(table.read()) == as_set(silver.claim(raw).filter("updated_at <= '2024-01-31 23:59:59'"))


def test_enrich_keeps_null_and_unknown_keys(spark):
    facts = spark.createDataFrame([("1", "a"), ("2", None), ("3", "zz"), ("4", "a")], "id string, k string")
    dims = spark.createDataFrame([("a", "A"), ("b", "B")], "key string, name string")
    for spread in (None, "id"):
        got = lookup.enrich(facts, dims, ("k", "key"), {"name": "label"}, spread_by=spread)
        assert as_set(got) == {("1", "a", "A"), ("2", None, None), ("3", "zz", None), ("4", "a", "A")}


def test_null_keys_are_spread_over_partitions(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        facts = spark.range(2000).select(F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("k"))
        dims = spark.createDataFrame([("a", "A")], "key string, name string")
        joined = lookup.enrich(facts, dims, ("k", "key"), {"name": "label"}, spread_by="id")
        sizes = [r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 2000 and max(sizes) < 1500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_orphans(spark):
    facts = spark.createDataFrame([("1", "a"), ("2", None), ("3", "zz")], "id string, k string")
    dims = spark.createDataFrame([("a",), (None,)], "k string")
    assert {r.id for r in lookup.orphans(facts, dims, ("k", "k"), nulls_are_orphans=True).collect()} == {"2", "3"}
    assert {r.id for r in lookup.orphans(facts, dims, ("k", "k"), nulls_are_orphans=False).collect()} == {"3"}


def hot_rows(spark):
    rng = random.Random(5)
    rows = [
        ("hot" if rng.random() < 0.4 else f"k{rng.randrange(40)}", T0 + timedelta(minutes=rng.randrange(20_000)), i, f"s{i % 4}")
        for i in range(2000)
    ]
    return spark.createDataFrame(rows, "k string, at timestamp, id long, v string")


def test_blocked_windows_equal_plain_windows(spark):
    df = hot_rows(spark)
    w = Window.partitionBy("k").orderBy("at", "id")
    plain = df.select("id", F.lag("v").over(w), F.row_number().over(w).cast("bigint"))
    lagged = ordered.lag_per_key(df, ["k"], "at", "id", "v", "p")
    numbered = ordered.number_per_key(df, ["k"], "at", "id", "n")
    got = lagged.select("id", "p").join(numbered.select("id", "n"), "id")
    assert as_set(got) == as_set(plain)


def test_number_rows_is_dense_and_ordered(spark):
    df = spark.range(500).select(((F.col("id") * 37) % 500).alias("x"))
    got = sorted((r.n, r.x) for r in ordered.number_rows(df, ["x"], "n", start=10).collect())
    assert got == [(i + 11, i) for i in range(500)]


def test_a_piece_of_a_scan_is_small_but_never_made_larger(spark):
    from firnlake.session import PIECE, PIECE_BYTES, prepare

    before = spark.conf.get(PIECE)
    try:
        for given, wanted in [("128MB", str(PIECE_BYTES)), ("1m", "1m"), (str(64 << 20), str(PIECE_BYTES))]:
            spark.conf.set(PIECE, given)
            prepare(spark)
            assert spark.conf.get(PIECE) == wanted
    finally:
        spark.conf.set(PIECE, before)


def test_who_wants_keys_only_moves_no_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "k string, t int, v string")
    latest = latest_per_key(df, "k", ["t"], ["v", "t"], when=F.col("t") < 3)
    assert as_set(latest) == {("a", "y", 2)}
    keys = latest.select("k")
    assert as_set(keys) == {("a",)}
    plan = keys._jdf.queryExecution().optimizedPlan().toString()
    assert "struct" not in plan and "_row" not in plan


def test_equal_order_is_settled_by_the_columns(spark):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", 1, None)]
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, "k string, t int, v string").coalesce(1)
        assert as_set(latest_per_key(df, "k", ["t"], ["v"])) == {("a", "y")}


def test_invoices_carry_only_the_wanted_columns(spark, sf):
    from firnlake.plans import silver
    from firnlake.workload import starschema as star

    raw = star.invoice_events(spark, sf)
    whole = silver.invoice(raw)
    assert whole.columns == silver.INVOICE_COLUMNS
    for wanted in (["invoice_status"], ["created_at", "invoice_id", "total_amount_chf"]):
        part = silver.invoice(raw, columns=wanted)
        assert part.columns == wanted
        assert part.exceptAll(whole.select(wanted)).isEmpty() and whole.select(wanted).exceptAll(part).isEmpty()
    plan = silver.invoice(raw, columns=["invoice_status"])._jdf.queryExecution().optimizedPlan().toString()
    moved = [line for line in plan.splitlines() if "Aggregate" in line]
    assert moved and all("policynumber" not in line and "invoicenumber" not in line for line in moved)
