"""Lifecycle checks over event tables and entity history.

A transition is legal when the status an event claims may follow the status claimed by
the entity's previous event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnlake.functions.text import mapped
from firnlake.operators.ordered import lag_per_key, number_per_key

START = "NONE"

# Status claimed by each event kind, and the statuses it may follow.
POLICY = {
    "PolicyIssued": ("ACTIVE", ["NONE"]),
    "PolicyChanged": ("ACTIVE", ["ACTIVE"]),
    "PolicyCancelled": ("CANCELLED", ["ACTIVE"]),
}
INVOICE = {
    "InvoiceCreated": ("OPEN", ["NONE"]),
    "PaymentReceived": ("PAID", ["OPEN", "OVERDUE"]),
    "DunningInitiated": ("OVERDUE", ["OPEN", "OVERDUE"]),
    "InvoiceCancelled": ("CANCELLED", ["OPEN", "OVERDUE"]),
}
CLAIM = {
    "ClaimOpened": ("OPEN", ["NONE"]),
    "ClaimUnderReview": ("IN_REVIEW", ["OPEN"]),
    "ClaimSettled": ("SETTLED", ["IN_REVIEW"]),
    "ClaimRejected": ("REJECTED", ["OPEN", "IN_REVIEW"]),
}


def illegal_transitions(
    events: DataFrame, key: str, rules: dict[str, tuple[str, list[str]]], tie: str = "eventid"
) -> DataFrame:
    """Events that may not follow their predecessor: key, event, from, to, time.

    Repeated dunning is legal here; its levels are checked by :func:`dunning_levels`.
    """
    status = {kind: claimed for kind, (claimed, _) in rules.items()}
    known = events.filter(F.col("eventtype").isin(*rules) & F.col(key).isNotNull()).select(
        key, "event_at", F.col(tie).alias("event_id"), "eventtype"
    )
    stepped = lag_per_key(known, [key], "event_at", "event_id", "eventtype", "_before").select(
        key, "event_at", "event_id", "eventtype",
        mapped("eventtype", status).alias("to_status"),
        F.coalesce(mapped("_before", status), F.lit(START)).alias("from_status"),
    )
    legal: Column = F.lit(False)
    for kind, (_, before) in rules.items():
        legal = legal | ((F.col("eventtype") == kind) & F.col("from_status").isin(before))
    return stepped.filter(~legal).select(
        key, "event_id", "eventtype", "from_status", "to_status", "event_at"
    )


# Dunning levels in order of escalation.
DUNNING_LEVELS = ["REMINDER", "FIRST_WARNING", "FINAL_WARNING", "COLLECTION"]


def dunning_levels(events: DataFrame, tie: str = "eventid") -> DataFrame:
    """The level each dunning event of an invoice reaches; NULL level = beyond the last one."""
    steps = events.filter(F.col("eventtype") == "DunningInitiated").select(
        "invoiceid", F.col(tie).alias("event_id"), "event_at"
    )
    numbered = number_per_key(steps, ["invoiceid"], "event_at", "event_id", "step")
    return numbered.select(
        F.col("invoiceid").alias("invoice_id"), "event_id", "event_at", "step",
        mapped("step", {i + 1: level for i, level in enumerate(DUNNING_LEVELS)}).alias("level"),
    )


def revision_history(
    events: DataFrame,
    key: str,
    kinds: dict[str, str],
    state: list[str],
    author: Column | None = None,
    tie: str = "eventid",
) -> DataFrame:
    """Numbered revisions per entity with kind, time, author and the state as JSON.

    ``kinds`` maps event types to INSERT, UPDATE or DELETE.
    """
    picked = events.filter(F.col("eventtype").isin(*kinds) & F.col(key).isNotNull()).select(
        F.col(key).alias("entity_id"),
        F.col(tie).alias("event_id"),
        F.col("event_at").alias("changed_at"),
        mapped("eventtype", kinds).alias("kind"),
        (author if author is not None else F.lit(None).cast("string")).alias("changed_by"),
        F.to_json(F.struct(*[F.col(c) for c in state])).alias("state"),
    )
    return number_per_key(picked, ["entity_id"], "changed_at", "event_id", "revision")
