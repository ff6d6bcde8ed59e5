import io
from contextlib import redirect_stdout
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import as_set
from firnlake.operators import lookup
from firnlake.operators.privacy import join_keys
from firnlake.plans import silver
from firnlake.plans.models import MODELS, build_lake, current_state, keep_current
from firnlake.sources.outbox import write_topics
from firnlake.sources.topics import raw_table, stream_messages
from firnlake.streaming import run
from firnlake.workload import queries as q
from firnlake.workload import starschema as star


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("files", [1, 3])
@pytest.mark.parametrize("name, prefix, build", [
    ("policy_silver.policy", "policy.", q.policy_messages), ("claims_silver.claim", "claims.", q.claim_messages),
])
def test_stream_equals_batch(spark, tmp_path, sf, files, name, prefix, build):
    from firnlake.contracts import CONTRACTS

    source, home = str(tmp_path / "topics"), str(tmp_path / "home")
    write_topics(build(spark, sf).repartition(files), source)
    topics = [t for t in CONTRACTS if t.startswith(prefix)]
    raw = raw_table(stream_messages(spark, source, files_per_trigger=1), topics)
    run.finish([keep_current(raw, MODELS[name], home, once=True)])
    batch = MODELS[name].build(raw_table(build(spark, sf), topics))
    assert as_set(current_state(spark, MODELS[name], home, raw.schema)) == as_set(batch)


def test_build_lake_answers_sql(spark, sf, tmp_path):
    raw = {
        "policy_raw.policy_events": star.policy_events(spark, sf),
        "partner_raw.person_events": star.person_events(spark, sf),
        "product_raw.product_events": star.product_events(spark, sf),
        "billing_raw.billing_events": star.billing_events(spark, sf),
        "claims_raw.claims_events": star.claims_events(spark, sf),
        "hr_raw.employee_events": star.employee_events(spark, sf),
        "hr_raw.org_unit_events": star.org_unit_events(spark, sf),
    }
    written = build_lake(spark, raw, q.person_keys(spark, sf))
    assert len(written) == 16
    n = spark.sql("""
        SELECT count_if(partner_id IS NULL OR partner_id NOT IN (SELECT partner_id FROM partner_silver.partner))
        FROM policy_silver.policy""").first()[0]
    assert n == q.QUERIES["orphan_policies"](spark, sf).count()
    assert spark.table("policy_gold.policy_detail").count() == spark.table("policy_silver.policy").count()


def test_filters_and_columns_reach_the_scan(spark, sf, tmp_path):
    raw = silver.with_event_time(star.claims_events(spark, sf))
    raw.write.parquet(str(tmp_path / "raw"))
    stored = spark.read.parquet(str(tmp_path / "raw"))
    plan = plan_of(silver.claim(stored, ("2024-01-05", "2024-01-20")).select("claim_id", "status"))
    assert "In(eventtype" in plan and "IsNotNull(claimid)" in plan
    read = next(line for line in plan.splitlines() if line.startswith("ReadSchema"))
    assert "settlementamount" not in read and "timestamp:string" not in read
    one_scan_one_shuffle = plan_of(silver.claim(stored))
    assert one_scan_one_shuffle.count("Exchange") - one_scan_one_shuffle.count("ReusedExchange") <= 4


def test_no_cross_joins_and_no_forced_broadcast(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("policy_detail", "claim_detail", "financial_summary", "management_kpi", "dq_report",
                     "silver_completeness", "lifecycle_claim", "invoices_by_insured_number", "partner_decrypted"):
            plan = plan_of(q.QUERIES[name](spark, sf))
            assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
            assert "BroadcastHashJoin" not in plan, name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_skewed_policy_in_every_mart(spark):
    """One policy holds a third of the claims and of the invoices."""
    from firnlake.plans import gold

    policies = spark.range(10).select(
        F.col("id").cast("string").alias("policy_id"), F.lit("n").alias("policy_number"),
        F.lit(None).cast("string").alias("partner_id"), F.lit(None).cast("string").alias("product_id"),
        F.lit(10).cast("decimal(15,2)").alias("premium_chf"), F.lit("ACTIVE").alias("policy_status"),
        F.lit(None).cast("timestamp").alias("issued_at"))
    invoices = spark.range(3000).select(
        F.col("id").cast("string").alias("invoice_id"),
        F.when(F.col("id") % 3 == 0, "0").otherwise((F.col("id") % 12).cast("string")).alias("policy_id"),
        F.when(F.col("id") % 2 == 0, "OPEN").otherwise("PAID").alias("invoice_status"),
        F.lit(1).cast("decimal(15,2)").alias("total_amount_chf"))
    got = gold.financial_summary(policies, invoices)
    assert got.count() == 10
    expected = invoices.filter("cast(policy_id as int) < 10").count()
    assert got.agg(F.sum("total_invoices")).first()[0] == expected


@pytest.mark.parametrize("how", ["enrich", "flag", "orphans", "keys"])
def test_hot_key_of_a_join_is_split(spark, how):
    """A key with a third of the rows is split although the lookup side was grouped by it."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB", "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        facts = spark.range(0, 30000, 1, 8).select(
            F.col("id").cast("string").alias("id"),
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
        dims = facts.filter("id % 2 = 0 or k = 'hot'").groupBy("k").agg(F.max("id").alias("v"))
        if how == "enrich":
            df = lookup.enrich(facts, dims, ("k", "k"), {"v": "v"}, spread_by="id")
        elif how == "flag":
            df = lookup.flag_match(facts, dims, ("k", "k"), "known")
        elif how == "keys":
            df = join_keys(facts, dims.select(F.col("k").alias("partner_id"), F.col("v").cast("binary").alias("key")), "k")
        else:
            df = lookup.orphans(facts, dims, ("k", "k"), nulls_are_orphans=False)
        rows = df.collect()
        assert len(rows) == (10000 if how == "orphans" else 30000)
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_exists(spark):
    df = spark.range(5)
    assert lookup.exists(df, F.col("id") == 3) and not lookup.exists(df, F.col("id") == 9)


def test_entry_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    own = {k for k in entry.queries() if k not in entry.LLM_QUERIES}
    assert own <= set(entry.oracle_sql())


def test_policy_delta_is_rounded_like_the_warehouse(spark):
    from decimal import Decimal

    from firnlake.plans import gold

    p = spark.createDataFrame([("1", Decimal("112.50"))], "policy_id string, premium_chf decimal(15,2)").select(
        "*", F.lit("x").alias("policy_number"), F.lit("ACTIVE").alias("policy_status"), F.lit("pa").alias("partner_id"),
        F.lit("pr").alias("product_id"), F.lit(None).cast("date").alias("coverage_start_date"),
        F.lit(None).cast("timestamp").alias("issued_at"), F.lit(None).cast("timestamp").alias("updated_at"))
    pa = spark.createDataFrame([("pa", None, "PROSPECT")], "partner_id string, insured_number string, partner_status string")
    for base, delta in (("100.00", "13.0"), ("0.00", None)):
        pr = spark.createDataFrame([("pr", "P", None, Decimal(base))],
                                   "product_id string, product_name string, product_line string, base_premium_chf decimal(15,2)")
        r = gold.policy_detail(p, pa, pr).first()
        assert (None if r.premium_delta_pct is None else str(r.premium_delta_pct)) == delta
        assert r.insured_number == "UNKNOWN" and r.product_line == "UNKNOWN"


def test_interval_reads_only_its_dates(spark, sf, tmp_path):
    """The scan for the latest rows prunes folders; the first-event time still covers all dates."""
    raw = silver.with_event_time(star.claims_events(spark, sf)).withColumn("event_date", F.col("event_at").cast("date"))
    raw.write.partitionBy("event_date").parquet(str(tmp_path / "raw"))
    stored = spark.read.parquet(str(tmp_path / "raw"))
    interval = ("2024-01-05", "2024-01-20")
    found = silver.claim(stored, interval)
    filters = [line for line in plan_of(found).splitlines() if line.startswith("PartitionFilters") and "event_date" in line]
    assert filters and all("2024-01-05" in f and "2024-01-20" in f for f in filters)
    want = silver.claim(stored).select("claim_id", F.col("opened_at").alias("all_opened"))
    joined = found.join(want, "claim_id")
    assert joined.count() == found.count() > 0
    assert joined.filter(~F.col("opened_at").eqNullSafe(F.col("all_opened"))).isEmpty()


def test_unreadable_values_are_listed(spark):
    raw = spark.createDataFrame(
        [("e1", "PolicyIssued", "p1", "12.50", "2024-01-01", "2024-01-01T00:00:00Z"),
         ("e2", "PolicyIssued", "p2", "many", "soon", "2024-01-01T00:00:00Z"),
         ("e3", "PolicyIssued", "p3", None, None, "?")],
        "eventid string, eventtype string, policyid string, premium string, coveragestartdate string, timestamp string",
    ).select("*", F.lit("n").alias("policynumber"), F.lit("a").alias("partnerid"), F.lit("x").alias("productid"))
    rows = {r.policy_id: r for r in silver.policy(raw).collect()}
    assert rows["p1"].premium_chf is not None and rows["p2"].premium_chf is None
    assert {r.eventid: r.reason for r in silver.unreadable(raw).collect()} == {
        "e2": "premium is no decimal;coveragestartdate is no date", "e3": "timestamp is no timestamp"}


def test_numbers_of_rows_without_a_time(spark):
    from firnlake.operators.ordered import number_per_key

    df = spark.createDataFrame([("k", None, 1), ("k", datetime(2024, 1, 1), 2), ("k", None, 3)], "k string, t timestamp, tie int")
    got = {r.tie: r.n for r in number_per_key(df, ["k"], "t", "tie", "n").collect()}
    assert got == {1: 1, 3: 2, 2: 3}


def test_new_files_are_seen_by_the_next_query(spark, sf, tmp_path):
    from firnlake.workload import queries as q

    spark.read.parquet(f"{sf}/customer.parquet").limit(10).write.parquet(str(tmp_path / "customer.parquet"))
    for name in ("orders", "nation"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    before = q.QUERIES["silver_partner"](spark, str(tmp_path)).count()
    more = spark.read.parquet(f"{sf}/customer.parquet").filter("c_custkey > 50")
    more.write.mode("append").parquet(str(tmp_path / "customer.parquet"))
    assert q.QUERIES["silver_partner"](spark, str(tmp_path)).count() > before


def test_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from firnlake.session import shared_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None)))
