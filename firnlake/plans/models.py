"""The lake's models: what each reads, how it loads, and runs over intervals.

A model can be kept three ways: by interval runs that merge into a bucketed table, as a stream
whose batches are logged and folded when read, or by a full rebuild of all tables.

Interval runs over raw tables stored by ``event_date`` keep an index of first-event times beside
the model's table: key and earliest time, made once from all dates and min-merged with each run's
interval.  So no later run reads a date outside its interval.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnlake.operators.latest import latest_per_key
from firnlake.operators.merge import upsert, upsert_newer
from firnlake.plans import gold, silver
from firnlake.session import new_path
from firnlake.sources.buckets import BucketTable
from firnlake.sources.lake import ChangeLog, create_namespaces
from firnlake.streaming.run import CONDENSE_EVERY, dead_letters, each_batch

BACKFILL_START = "2024-01-01"  # fixed: first day of a backfill when none is given


@dataclass(frozen=True)
class Model:
    """A silver model kept by merge: raw table, key, and the guard if it has one."""

    name: str
    raw: str
    build: Callable[..., DataFrame]
    key: str
    version: str | None = None
    keep_first: tuple[str, ...] = ()
    first: str | None = None  # column holding the time of the first event
    tie: bool = False  # whether events of one time are settled by the event id
    raw_key: str | None = None  # the key's name in the raw table
    first_kind: str | None = None  # kind of the first event


MODELS = {
    m.name: m
    for m in [
        Model("policy_silver.policy", "policy_raw.policy_events", silver.policy, "policy_id",
              "updated_at", ("issued_at",), first="issued_at", tie=True,
              raw_key="policyid", first_kind="PolicyIssued"),
        Model("claims_silver.claim", "claims_raw.claims_events", silver.claim, "claim_id",
              "updated_at", ("opened_at",), first="opened_at", tie=True,
              raw_key="claimid", first_kind="ClaimOpened"),
        Model("billing_silver.invoice", "billing_raw.billing_events", silver.invoice, "invoice_id",
              first="created_at", tie=True, raw_key="invoiceid", first_kind="InvoiceCreated"),
        Model("partner_silver.partner", "partner_raw.person_events", silver.partner, "partner_id"),
        Model("product_silver.product", "product_raw.product_events", silver.product, "product_id"),
        Model("hr_silver.employee", "hr_raw.employee_events", silver.employee, "employee_id"),
        Model("hr_silver.org_unit", "hr_raw.org_unit_events", silver.org_unit, "org_unit_id"),
    ]
}


def merged(
    target: DataFrame | None, source: DataFrame, key: str, version: str | None,
    keep_first: Sequence[str] = (),
) -> DataFrame:
    """``source`` merged into ``target``; newer-wins when a version column is named."""
    if target is None:
        return source
    if version is None:
        return upsert(target, source, key)
    return upsert_newer(target, source, key, version, keep_first)


def _least(target: DataFrame | None, source: DataFrame) -> DataFrame:
    both = source if target is None else target.unionByName(source)
    return both.groupBy("key").agg(F.min("first_at").alias("first_at"))


def first_index(table: BucketTable, model: Model, raw: DataFrame, interval: tuple) -> DataFrame:
    """First-event times of at least the keys of the interval, after the index took in its events."""
    index = BucketTable(table.spark, f"{table.path}/first-events", "key", table.buckets)
    reach = None if index.manifest() is None else interval
    index.merge(silver.first_events(raw, model.raw_key, model.first_kind, reach), _least)
    keys = silver.within(silver.with_event_time(raw), interval).filter(F.col(model.raw_key).isNotNull()).select(F.col(model.raw_key).alias("key"))
    return index.lookup(keys)


def run_interval(table: BucketTable, model: Model, raw: DataFrame, interval: tuple) -> DataFrame:
    """Load one interval of a model and return the new state of its table."""
    if model.first_kind and "event_date" in raw.columns:
        source = model.build(raw, interval, begun=first_index(table, model, raw, interval))
    else:
        source = model.build(raw, interval)
    table.merge(source, lambda t, s: merged(t, s, model.key, model.version, model.keep_first))
    return table.read()


def replay(
    spark: SparkSession,
    build: Callable[[tuple], DataFrame],
    intervals: Sequence[tuple],
    *,
    key: str,
    version: str | None,
    keep_first: Sequence[str] = (),
    label: str = "model",
) -> DataFrame:
    """Backfill: merge the intervals in turn, each into a new version of the table.

    Writing each version ends its lineage, so the plan does not grow with the intervals.
    """
    table = BucketTable(spark, new_path(spark, label), key)
    for interval in intervals:
        table.merge(build(interval), lambda t, s: merged(t, s, key, version, keep_first))
    return table.read()


# --- as a stream -----------------------------------------------------------------------------


def _logged(model: Model, raw: DataFrame) -> DataFrame:
    """What a batch adds to the log: its latest rows, with the event ids that settle ties."""
    return model.build(raw, keep_tie=True) if model.tie else model.build(raw)


def _log(spark: SparkSession, model: Model, path: str, raw: DataFrame) -> ChangeLog:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _logged(model, raw).schema.fields)
    return ChangeLog(spark, f"{path}/log", schema)


def _unusable(model: Model, batch: DataFrame) -> DataFrame:
    """Raw rows whose amounts or dates cannot be read, as dead letters."""
    bad = silver.unreadable(batch)
    key = F.col(model.raw_key) if model.raw_key else F.lit(None).cast("string")
    return bad.select(
        F.lit(model.raw).alias("topic"), key.alias("key"),
        F.to_json(F.struct(*[F.col(c) for c in batch.columns])).alias("value"),
        F.current_timestamp().alias("created_at"), "reason",
    )


def keep_current(raw: DataFrame, model: Model, path: str, *, once: bool = False, condense_every: int = CONDENSE_EVERY):
    """Keep a model current from its raw rows as a stream.

    Each batch logs the latest row per key it saw; nothing stored is rewritten.  Rows with values
    that cannot be read go to the dead letters as well.  The log is condensed from time to time.
    """
    spark: SparkSession = raw.sparkSession
    empty = spark.createDataFrame([], raw.schema)
    log = _log(spark, model, path, empty)

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch_id and batch_id % condense_every == 0:
            _condense(log, model, batch_id)
        batch = batch.persist()
        try:
            log.append(_logged(model, batch), batch_id)
            dead_letters(f"{path}/dead-letters", _unusable(model, batch), batch_id)
        finally:
            batch.unpersist()

    return each_batch(raw, handle, f"{path}/checkpoint", once=once)


def _condense(log: ChangeLog, model: Model, batch_id: int) -> None:
    """The newest row per key so far, with the earliest first time."""
    rows = log.read(batch_id)
    newest = _newest(rows, model, [c for c in rows.columns if c not in (model.key, model.first)])
    log.write_base(newest.select(rows.columns), batch_id)


def _newest(rows: DataFrame, model: Model, columns: Sequence[str]) -> DataFrame:
    extras = [F.min(model.first).alias(model.first)] if model.first else []
    order = ["updated_at", *(["_tie"] if "_tie" in rows.columns else []), "_earlier"]
    return latest_per_key(rows.withColumn("_earlier", -F.col("batch")), model.key, order, columns, extras=extras)


def current_state(spark: SparkSession, model: Model, path: str, raw_schema) -> DataFrame:
    """The state a stream keeps: newest row per key, first time over all batches.

    Ties are settled by the event id as in the batch models, without one by the earlier batch.
    Batches may have come in any order.
    """
    empty = spark.createDataFrame([], raw_schema)
    names = model.build(empty).columns
    log = _log(spark, model, path, empty).read()
    return _newest(log, model, [c for c in names if c not in (model.key, model.first)]).select(names)


# --- as a full rebuild -----------------------------------------------------------------------


def build_lake(
    spark: SparkSession, raw: dict[str, DataFrame], keys: DataFrame | None = None, folder: str | None = None
) -> list[str]:
    """Rebuild all silver and gold tables in the session catalog from the raw tables.

    Silver tables are written first and gold reads them back, so each model is computed once.
    ``keys`` adds the decrypted partner table; ``folder`` holds the files instead of the warehouse.
    """
    create_namespaces(spark)
    written: list[str] = []

    def save(name: str, df: DataFrame) -> DataFrame:
        writer = df.write.mode("overwrite").format("parquet")
        (writer.option("path", f"{folder}/{name}") if folder else writer).saveAsTable(name)
        written.append(name)
        return spark.table(name)

    t = {m.name: save(m.name, m.build(raw[m.raw])) for m in MODELS.values() if m.raw in raw}
    if "policy_raw.policy_events" in raw:
        save("policy_silver.coverage", silver.coverage(raw["policy_raw.policy_events"]))
    if "partner_raw.person_events" in raw:
        save("partner_silver.address", silver.address(raw["partner_raw.person_events"]))
    policy, claim = t.get("policy_silver.policy"), t.get("claims_silver.claim")
    partner, product = t.get("partner_silver.partner"), t.get("product_silver.product")
    invoice = t.get("billing_silver.invoice")
    marts = {
        "policy_gold.policy_detail": (gold.policy_detail, [policy, partner, product]),
        "policy_gold.portfolio_summary": (gold.portfolio_summary, [policy, product]),
        "billing_gold.financial_summary": (gold.financial_summary, [policy, invoice]),
        "claims_gold.claim_detail": (gold.claim_detail, [claim, policy, partner, product]),
        "analytics.management_kpi": (gold.management_kpi, [policy, product]),
        "analytics.org_hierarchy": (
            gold.org_hierarchy, [t.get("hr_silver.org_unit"), t.get("hr_silver.employee")]
        ),
        "partner_gold.partner_decrypted": (gold.partner_decrypted, [partner, keys]),
    }
    for name, (build, inputs) in marts.items():
        if all(i is not None for i in inputs):
            save(name, build(*inputs))
    return written
