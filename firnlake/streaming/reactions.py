"""Reactions of one domain to another's events: invoices, cancellation, payouts, numbers.

What must be known of a policy or partner is keyed state of the stream itself, kept by Spark's
streaming aggregation: a batch reads and writes the state of the keys it touches, however long the
history.  Handlers get the keys that changed and write logs named by the batch; a batch that is delivered
again starts from the same state and replaces its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from firnlake.functions.text import insured_number, is_blank, name_uuid
from firnlake.operators.latest import latest_per_key
from firnlake.operators.lookup import detached, latest_lookup
from firnlake.operators.ordered import number_rows
from firnlake.operators.rules import CYCLE_LABELS, PAYMENT_DAYS
from firnlake.session import release_shuffles
from firnlake.sources.buckets import BucketTable
from firnlake.sources.lake import ChangeLog, exists
from firnlake.streaming.run import CONDENSE_EVERY, dead_letters, each_batch, keep_rejects, keyed_state

INVOICE_LOG = (
    "invoice_id string, policy_id string, policy_number string, partner_id string, "
    "billing_cycle string, total_amount_chf decimal(15,2), invoice_date date, due_date date, "
    "line_text string, status string, created_at timestamp, step int"
)


ISSUED = "policyId string, policyNumber string, partnerId string, premium string"


def _field(name: str) -> Column:
    return F.get_json_object("value", f"$.{name}")


def billing_reason(topic: str = "topic") -> Column:
    """Why a message cannot be billed: '' or what is missing; an issue needs all four fields."""
    m = F.from_json("value", ISSUED)
    issue = F.when(m["premium"].try_cast("decimal(15,2)").isNull(), "premium is not a number").otherwise("")
    for f in ("premium", "partnerId", "policyNumber", "policyId"):
        issue = F.when(is_blank(m[f]), f"{f} is missing").otherwise(issue)
    cancel = F.when(is_blank(_field("policyId")), "policyId is missing").otherwise("")
    return F.when(F.col(topic) == "policy.v1.issued", issue).otherwise(cancel)


def billing_state(messages: DataFrame) -> DataFrame:
    """Per policy: its first issue and its last cancellation; batch or stream.

    Of several issues the earliest message counts, ties are settled by its text.  Neither depends on how
    the messages are dealt into batches.  Time and text are all that is kept of an issue; its fields are read from the text.
    """
    usable = messages.withColumns({"m": F.from_json("value", ISSUED), "reason": billing_reason()}).filter("reason = ''")
    issue = F.col("topic") == "policy.v1.issued"
    state = usable.groupBy(F.coalesce("m.policyId", _field("policyId")).alias("policy_id")).agg(
        F.min(F.when(issue, F.struct("created_at", "value"))).alias("issue"), F.max(F.when(~issue, F.col("created_at"))).alias("cancelled_at")
    )
    state = state.withColumn("m", F.from_json("issue.value", ISSUED))
    row = F.struct("m.policyNumber", "m.partnerId", F.col("m.premium").alias("premium"), F.col("issue.created_at").alias("created_at"))
    return state.select("policy_id", F.when(F.col("issue").isNotNull(), row).alias("row"), "cancelled_at")


def billed(state: DataFrame) -> DataFrame:
    """One annual invoice per issued policy, cancelled if a cancellation came with or after the issue.

    A cancellation before the issue finds no invoice and changes nothing.
    """
    day = F.col("row.created_at").cast("date")
    return state.filter("row is not null").select(
        name_uuid(F.concat(F.lit("invoice:"), "policy_id")).alias("invoice_id"),
        "policy_id",
        F.col("row.policyNumber").alias("policy_number"),
        F.col("row.partnerId").alias("partner_id"),
        F.lit("ANNUAL").alias("billing_cycle"),
        F.col("row.premium").cast("decimal(15,2)").alias("total_amount_chf"),
        day.alias("invoice_date"),
        F.date_add(day, PAYMENT_DAYS).alias("due_date"),
        F.concat_ws(" ", F.lit(CYCLE_LABELS["ANNUAL"]), "row.policyNumber").alias("line_text"),
        F.when(F.col("cancelled_at") >= F.col("row.created_at"), "CANCELLED").otherwise("OPEN").alias("status"),
        F.col("row.created_at").alias("created_at"),
        F.lit(0).alias("step"),
    )


def invoice_view(log: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Current invoices: the last logged row of each; of ``columns``, if given, the others are not moved."""
    wanted = [c for c in columns or log.columns if c not in ("invoice_id", "batch", "step")]
    return latest_per_key(log, "invoice_id", ["batch", "step"], wanted)


def bill_policies(messages: DataFrame, path: str, *, payees: str | None = None, once: bool = False) -> list[StreamingQuery]:
    """Invoices from policy.v1.issued, cancelled again by policy.v1.cancelled; rejects beside them.

    ``payees`` names a bucketed table that is kept at the payee of each billed policy (see :func:`pay_claims`).
    """
    spark: SparkSession = messages.sparkSession
    log = ChangeLog(spark, f"{path}/log", INVOICE_LOG)

    def handle(changed: DataFrame, batch_id: int) -> None:
        if batch_id and batch_id % CONDENSE_EVERY == 0:
            log.condense(batch_id, ["invoice_id"], ["batch", "step"])
        log.append(billed(changed), batch_id)
        if payees:
            keep_payees(BucketTable(spark, payees, "policy_id"), log.only(batch_id))

    keyed_state(spark)
    release_shuffles(spark)
    wanted = messages.filter(F.col("topic").isin("policy.v1.issued", "policy.v1.cancelled"))
    return [
        each_batch(billing_state(wanted), handle, f"{path}/checkpoint", once=once, output="update"),
        keep_rejects(wanted, billing_reason(), f"{path}/dead-letters", f"{path}/checkpoint-rejects", once=once),
    ]


def invoices(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    return invoice_view(ChangeLog(spark, f"{path}/log", INVOICE_LOG).read(), columns)


# --- payouts ---------------------------------------------------------------------------------


def payouts(settled: DataFrame, known_invoices: DataFrame) -> DataFrame:
    """Payout rows for settled claims; the partner comes from the policy's newest invoice.

    ``settled`` are claims.v1.settled messages, batch or stream.  Messages missing a field
    and claims without any invoice are skipped.
    """
    m = F.from_json("value", "claimId string, policyId string, settlementAmount decimal(15,2)")
    rows = settled.filter(F.col("topic") == "claims.v1.settled").select(m.alias("m")).select(
        F.col("m.claimId").alias("claim_id"), F.col("m.policyId").alias("policy_id"),
        F.col("m.settlementAmount").alias("settlement_amount_chf"),
    ).dropna()
    owner = latest_lookup(known_invoices, "policy_id", ["invoice_date", "invoice_id"], ["partner_id"])
    owner = owner.select(detached("policy_id").alias("_owned"), "partner_id")
    return rows.join(owner, detached("policy_id") == F.col("_owned")).select(
        "claim_id", "policy_id", "partner_id", "settlement_amount_chf"
    )


PAYEE = ["policy_id", "partner_id", "invoice_date", "invoice_id"]


def keep_payees(table: BucketTable, new_invoices: DataFrame) -> None:
    """Merge invoices into the payees: per policy the partner of the newest invoice."""

    def merged(known: DataFrame | None, new: DataFrame) -> DataFrame:
        rows = new if known is None else known.unionByName(new)
        return latest_per_key(rows, "policy_id", ["invoice_date", "invoice_id"], PAYEE[1:])

    table.merge(new_invoices.select(PAYEE), merged)


PAYOUT_LOG = "claim_id string, policy_id string, partner_id string, settlement_amount_chf decimal(15,2)"
SETTLED = "claimId string, policyId string, settlementAmount string"


def payout_reason() -> Column:
    """Why a settlement cannot be paid: '' or what is missing."""
    m = F.from_json("value", SETTLED)
    reason = F.when(m["settlementAmount"].try_cast("decimal(15,2)").isNull(), "settlementAmount is not a number").otherwise("")
    for f in ("settlementAmount", "policyId", "claimId"):
        reason = F.when(is_blank(m[f]), f"{f} is missing").otherwise(reason)
    return reason


def pay_claims(messages: DataFrame, payees: str, path: str, *, once: bool = False) -> StreamingQuery:
    """Payouts for settled claims as a stream; the payee is looked up when the claim is settled.

    A batch reads the buckets of its policies as they are then, so an invoice written since the batch before
    counts.  Incomplete settlements and those of policies without any invoice go to the dead letters.
    """
    spark: SparkSession = messages.sparkSession
    log = ChangeLog(spark, f"{path}/log", PAYOUT_LOG)

    def handle(batch: DataFrame, batch_id: int) -> None:
        judged = batch.withColumns({"m": F.from_json("value", SETTLED), "reason": payout_reason()}).persist()
        try:
            good = judged.filter("reason = ''").withColumn("policy_id", F.col("m.policyId"))
            found = BucketTable(spark, payees, "policy_id").lookup(good)
            if found is None:
                found = spark.createDataFrame([], "policy_id string, partner_id string")
            owner = found.select(detached("policy_id").alias("_owned"), "partner_id")
            placed = good.join(owner, detached("policy_id") == F.col("_owned"), "left").persist()
            paid = placed.filter("_owned is not null").select(
                F.col("m.claimId").alias("claim_id"), "policy_id", "partner_id",
                F.col("m.settlementAmount").cast("decimal(15,2)").alias("settlement_amount_chf"),
            )
            log.append(paid, batch_id)
            lost = placed.filter("_owned is null").withColumn("reason", F.lit("no invoice of the policy"))
            columns = ["topic", "key", "value", "created_at", "reason"]
            dead_letters(f"{path}/dead-letters", judged.filter("reason != ''").select(columns).unionByName(lost.select(columns)), batch_id)
            placed.unpersist()
        finally:
            judged.unpersist()

    return each_batch(messages.filter(F.col("topic") == "claims.v1.settled"), handle, f"{path}/checkpoint", once=once)


def paid_claims(spark: SparkSession, path: str) -> DataFrame:
    return ChangeLog(spark, f"{path}/log", PAYOUT_LOG).read().drop("batch")


# --- insured numbers -------------------------------------------------------------------------

NUMBER_LOG = "partner_id string, sequence bigint, insured_number string"


def number_state(issued: DataFrame) -> DataFrame:
    """Per partner of issued policies: time of the first policy, and of the first and last batch.

    In a stream ``current_timestamp`` is the batch's time, which a second delivery keeps.
    """
    partner = F.get_json_object("value", "$.partnerId")
    seen = issued.select(partner.alias("partner_id"), "created_at", F.current_timestamp().alias("batch_at")).filter(~is_blank("partner_id"))
    return seen.groupBy("partner_id").agg(
        F.min("created_at").alias("first_at"), F.min("batch_at").alias("first_batch"), F.max("batch_at").alias("last_batch")
    )


def new_numbers(waiting: DataFrame, start: int) -> DataFrame:
    """Numbers after ``start`` for (partner_id, first_at), in the order of the first policies."""
    numbered = number_rows(waiting.select("partner_id", "first_at"), ["first_at", "partner_id"], "sequence", start)
    return numbered.select("partner_id", "sequence", insured_number("sequence").alias("insured_number"))


def _mark(spark: SparkSession, path: str, batch_id: int) -> int:
    """The last number given out before a batch: one small file of the batch before it."""
    if batch_id == 0:
        return 0
    marks = ChangeLog(spark, f"{path}/marks", "last bigint")
    found = marks.only(batch_id - 1) if exists(spark, f"{path}/marks/batch={batch_id - 1}/_SUCCESS") else marks.read(batch_id)
    return found.agg(F.max("last")).first()[0] or 0


def assign_numbers(messages: DataFrame, partners: DataFrame, path: str, *, once: bool = False) -> list[StreamingQuery]:
    """Insured numbers from policy.v1.issued; a partner keeps the first one.

    ``partners`` are the known persons with the number they already carry, if any.  A partner is numbered in
    the batch of the first policy; the numbers of a batch are a block after the stored high-water mark.  Messages
    without a partner, and partners that are not known then, go to the dead letters.
    """
    spark: SparkSession = messages.sparkSession
    log = ChangeLog(spark, f"{path}/log", NUMBER_LOG)
    marks = ChangeLog(spark, f"{path}/marks", "last bigint")

    def handle(changed: DataFrame, batch_id: int) -> None:
        start = _mark(spark, path, batch_id)
        known = partners.select(F.col("partner_id").alias("_known"), F.col("insured_number").alias("_has"))
        fresh = changed.filter("first_batch = last_batch").join(known, F.col("partner_id") == F.col("_known"), "left").persist()
        try:
            log.append(new_numbers(fresh.filter("_known is not null and _has is null"), start), batch_id)
            last = log.only(batch_id).agg(F.max("sequence")).first()[0] or start
            marks.append(spark.createDataFrame([(last,)], "last bigint"), batch_id)
            lost = fresh.filter("_known is null").select(
                F.lit("policy.v1.issued").alias("topic"), F.col("partner_id").alias("key"), F.lit(None).cast("string").alias("value"),
                F.col("first_at").alias("created_at"), F.lit("partner is not known").alias("reason"),
            )
            dead_letters(f"{path}/dead-letters/unknown", lost, batch_id)
        finally:
            fresh.unpersist()

    keyed_state(spark)
    wanted = messages.filter(F.col("topic") == "policy.v1.issued")
    reason = F.when(is_blank(_field("partnerId")), "partnerId is missing").otherwise("")
    return [
        each_batch(number_state(wanted), handle, f"{path}/checkpoint", once=once, output="update"),
        keep_rejects(wanted, reason, f"{path}/dead-letters/incomplete", f"{path}/checkpoint-rejects", once=once),
    ]


def numbers(spark: SparkSession, path: str) -> DataFrame:
    return ChangeLog(spark, f"{path}/log", NUMBER_LOG).read().drop("batch")
