"""Silver models: the current state of every entity, from the raw event tables.

Raw columns are the lower-cased JSON names, amounts and times still text.  Each model
takes an optional inclusive interval ``(start, end)`` for incremental runs.  Of a table stored by
``event_date`` only the folders of the interval are read; the times of first events then come from
an index (``begun``, see :mod:`firnlake.plans.models`), or, without one, from a scan of the first
events of all dates.  Other tables are read once for both.  Amounts and dates that cannot be
read are NULL; :func:`unreadable` lists their events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnlake.functions.text import full_name, is_set
from firnlake.operators.latest import carried_forward, first_time, latest_per_key

MONEY = "decimal(15,2)"

Interval = tuple[object, object] | None


def with_event_time(raw: DataFrame) -> DataFrame:
    """Adds ``event_at``; a typed column written at landing is used as it is."""
    if "event_at" in raw.columns:
        return raw
    return raw.withColumn("event_at", F.col("timestamp").try_cast("timestamp"))


def _inside(interval: Interval) -> Column:
    start, end = interval
    return F.col("event_at").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))


def within(events: DataFrame, interval: Interval) -> DataFrame:
    """Events of the interval; tables stored by ``event_date`` read only those folders."""
    if interval is None:
        return events
    kept = events.filter(_inside(interval))
    if "event_date" in events.columns:
        start, end = (F.lit(t).cast("timestamp").cast("date") for t in interval)
        kept = kept.filter(F.col("event_date").between(start, end))
    return kept


def _tie(raw: DataFrame) -> list[str]:
    return ["eventid"] if "eventid" in raw.columns else []


def first_events(raw: DataFrame, key: str, kind: str, interval: Interval = None) -> DataFrame:
    """(key, first_at): time of the earliest event of a kind, of the interval or of all events."""
    events = within(with_event_time(raw), interval)
    events = events.filter((F.col("eventtype") == kind) & F.col(key).isNotNull() & F.col("event_at").isNotNull())
    return events.groupBy(F.col(key).alias("key")).agg(F.min("event_at").alias("first_at"))


def _current(
    events: DataFrame, key: str, order: list[str], columns: list[str], interval: Interval, kind: str, first: str,
    begun: DataFrame | None = None,
) -> DataFrame:
    """Latest row per key with the time ``first`` of the key's earliest event of one kind."""
    earliest = first_time("eventtype", kind, "event_at", first)
    if interval is None:
        return latest_per_key(events, key, order, columns, extras=[earliest])
    if begun is None and "event_date" not in events.columns:
        return latest_per_key(events, key, order, columns, when=_inside(interval), extras=[earliest])
    recent = latest_per_key(within(events, interval), key, order, columns)
    if begun is None:
        wanted = recent.select(F.col(key).alias("_wanted"))
        begun = (
            events.filter(F.col("eventtype") == kind).select(key, "event_at", "eventtype")
            .join(wanted, F.col(key) == F.col("_wanted"), "left_semi").groupBy(key).agg(earliest)
        )
    else:
        begun = begun.select(F.col("key").alias(key), F.col("first_at").alias(first))
    return recent.join(begun, key, "left")


# Raw columns that are read as amounts and as dates.
AMOUNTS = ("premium", "insuredamount", "totalamount", "amountpaid", "settlementamount", "basepremium")
DATES = ("coveragestartdate", "duedate", "paidat", "claimdate", "entrydate", "exitdate", "validfrom", "validto")


def unreadable(raw: DataFrame) -> DataFrame:
    """Events with an amount, date or time that cannot be read, and the ``reason``."""
    kinds = {**dict.fromkeys(AMOUNTS, MONEY), **dict.fromkeys(DATES, "date"), "timestamp": "timestamp"}
    wrong = [
        F.when(F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull(), f"{c} is no {kind.split('(')[0]}")
        for c, kind in kinds.items() if c in raw.columns
    ]
    return raw.withColumn("reason", F.concat_ws(";", *wrong)).filter("reason != ''")


POLICY_COLUMNS = [
    "policy_id", "policy_number", "partner_id", "product_id", "coverage_start_date",
    "premium_chf", "policy_status", "issued_at", "updated_at",
]


def policy(
    raw: DataFrame, interval: Interval = None, *, carry_forward: bool = False, keep_tie: bool = False,
    begun: DataFrame | None = None,
) -> DataFrame:
    """Latest of issued / changed / cancelled per policy.

    A later thin event blanks the fields it does not carry, unless ``carry_forward``.
    ``keep_tie`` adds the id of the event that won as ``_tie``.
    """
    tie = _tie(raw) if keep_tie else []
    events = with_event_time(raw).filter(
        F.col("eventtype").isin("PolicyIssued", "PolicyCancelled", "PolicyChanged")
    )
    columns = ["policynumber", "partnerid", "productid", "coveragestartdate", "premium",
               "eventtype", "event_at"]
    order = ["event_at", *_tie(raw)]
    if carry_forward:
        inside = within(events, interval)
        state = carried_forward(inside, "policyid", order, columns)
        issued = first_time("eventtype", "PolicyIssued", "event_at", "issued_at")
        first = events.groupBy("policyid").agg(issued)
        latest = state.join(first, "policyid", "left")
    else:
        latest = _current(events, "policyid", order, columns + tie, interval, "PolicyIssued", "issued_at", begun)
    return latest.select(
        F.col("policyid").alias("policy_id"),
        F.col("policynumber").alias("policy_number"),
        F.col("partnerid").alias("partner_id"),
        F.col("productid").alias("product_id"),
        F.col("coveragestartdate").try_cast("date").alias("coverage_start_date"),
        F.col("premium").try_cast(MONEY).alias("premium_chf"),
        F.when(F.col("eventtype") == "PolicyCancelled", "CANCELLED")
        .otherwise("ACTIVE").alias("policy_status"),
        "issued_at",
        F.col("event_at").alias("updated_at"),
        *[F.col(c).alias("_tie") for c in tie],
    )


def coverage(raw: DataFrame, interval: Interval = None) -> DataFrame:
    """Every coverage ever added; an append-only projection without a shuffle."""
    added = within(with_event_time(raw), interval).filter(
        (F.col("eventtype") == "CoverageAdded") & F.col("coverageid").isNotNull()
    )
    return added.select(
        F.col("coverageid").alias("coverage_id"),
        F.col("policyid").alias("policy_id"),
        F.col("coveragetype").alias("coverage_type"),
        F.col("insuredamount").try_cast(MONEY).alias("insured_amount_chf"),
        F.col("event_at").alias("created_at"),
    )


# Output column of an invoice → the raw column it is read from.
_INVOICE = {
    "invoice_number": "invoicenumber", "policy_id": "policyid", "partner_id": "partnerid", "policy_number": "policynumber",
    "billing_cycle": "billingcycle", "total_amount_chf": "totalamount", "due_date": "duedate", "invoice_status": "eventtype",
    "amount_paid_chf": "amountpaid", "paid_at": "paidat", "dunning_level": "dunninglevel", "updated_at": "event_at",
}
INVOICE_COLUMNS = [
    "invoice_id", "invoice_number", "policy_id", "partner_id", "policy_number", "billing_cycle", "total_amount_chf",
    "due_date", "invoice_status", "amount_paid_chf", "paid_at", "dunning_level", "created_at", "updated_at",
]


def invoice(
    raw: DataFrame, interval: Interval = None, *, keep_tie: bool = False, begun: DataFrame | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Latest billing event per invoice.  Payouts carry no invoice id and drop out.

    ``columns`` are the output columns wanted, all if not given: the winning row travels as one value, from
    which Spark cannot leave out what nobody reads.
    """
    columns = INVOICE_COLUMNS if columns is None else list(columns)
    tie = _tie(raw) if keep_tie else []
    events = with_event_time(raw).filter(
        F.col("eventtype").isin(
            "InvoiceCreated", "PaymentReceived", "DunningInitiated", "PayoutTriggered"
        )
    )
    latest = _current(
        events, "invoiceid", ["event_at", *_tie(raw)],
        [*[_INVOICE[c] for c in columns if c in _INVOICE], *tie],
        interval, "InvoiceCreated", "created_at", begun,
    )
    kind = F.col("eventtype")
    typed = {
        "invoice_id": F.col("invoiceid"),
        "total_amount_chf": F.col("totalamount").try_cast(MONEY),
        "due_date": F.col("duedate").try_cast("date"),
        "invoice_status": F.when(kind == "PaymentReceived", "PAID")
        .when(kind == "DunningInitiated", "OVERDUE")
        .when(kind == "PayoutTriggered", "PAYOUT")
        .otherwise("OPEN"),
        "amount_paid_chf": F.col("amountpaid").try_cast(MONEY),
        "paid_at": F.col("paidat").try_cast("date"),
        "created_at": F.col("created_at"),
    }
    return latest.select(
        *[(typed[c] if c in typed else F.col(_INVOICE[c])).alias(c) for c in columns],
        *[F.col(c).alias("_tie") for c in tie],
    )


def claim(
    raw: DataFrame, interval: Interval = None, *, keep_tie: bool = False, begun: DataFrame | None = None
) -> DataFrame:
    """Latest claim event per claim; the status comes from the payload."""
    tie = _tie(raw) if keep_tie else []
    events = with_event_time(raw).filter(
        F.col("eventtype").isin("ClaimOpened", "ClaimUnderReview", "ClaimSettled", "ClaimRejected")
    )
    latest = _current(
        events, "claimid", ["event_at", *_tie(raw)],
        ["claimnumber", "policyid", "description", "claimdate", "status", "event_at", *tie],
        interval, "ClaimOpened", "opened_at", begun,
    )
    return latest.select(
        F.col("claimid").alias("claim_id"),
        F.col("claimnumber").alias("claim_number"),
        F.col("policyid").alias("policy_id"),
        "description",
        F.col("claimdate").try_cast("date").alias("claim_date"),
        "status",
        "opened_at",
        F.col("event_at").alias("updated_at"),
        *[F.col(c).alias("_tie") for c in tie],
    )


def partner(raw: DataFrame, interval: Interval = None) -> DataFrame:
    """Latest person state; personal fields stay encrypted as they came."""
    events = within(with_event_time(raw), interval).filter(F.col("eventtype") == "PersonState")
    latest = latest_per_key(
        events, "personid", ["event_at", *_tie(raw)],
        ["name", "firstname", "socialsecuritynumber", "insurednumber", "dateofbirth", "gender",
         "encrypted", "deleted", "event_at"],
    )
    deleted = F.coalesce("deleted", F.lit(False))
    return latest.select(
        F.col("personid").alias("partner_id"),
        F.col("name").alias("family_name"),
        F.col("firstname").alias("first_name"),
        F.col("socialsecuritynumber").alias("social_security_number"),
        F.col("insurednumber").alias("insured_number"),
        F.col("dateofbirth").alias("date_of_birth"),
        "gender",
        "encrypted",
        deleted.alias("deleted"),
        F.when(deleted, "DELETED")
        .when(is_set("insurednumber"), "INSURED")
        .otherwise("PROSPECT").alias("partner_status"),
        F.col("event_at").alias("updated_at"),
    )


def address(raw: DataFrame) -> DataFrame:
    """One row per address of the latest person state that carries an address list."""
    events = with_event_time(raw).filter(
        (F.col("eventtype") == "PersonState") & F.col("addresses").isNotNull()
    )
    latest = latest_per_key(
        events, "personid", ["event_at", *_tie(raw)], ["encrypted", "addresses", "event_at"]
    )
    a = F.col("a")
    return latest.select("personid", "encrypted", "event_at", F.explode("addresses").alias("a")).select(
        a["addressId"].alias("address_id"),
        F.col("personid").alias("partner_id"),
        a["addressType"].alias("address_type"),
        a["street"].alias("street"),
        a["houseNumber"].alias("house_number"),
        a["postalCode"].alias("postal_code"),
        a["city"].alias("city"),
        a["land"].alias("country"),
        a["validFrom"].try_cast("date").alias("valid_from"),
        "encrypted",
        F.col("event_at").alias("updated_at"),
    )


def product(raw: DataFrame, interval: Interval = None) -> DataFrame:
    """Latest of state / defined / deprecated; updated events are ignored."""
    events = within(with_event_time(raw), interval).filter(
        F.col("eventtype").isin("ProductState", "ProductDefined", "ProductDeprecated")
    )
    latest = latest_per_key(
        events, "productid", ["event_at", *_tie(raw)],
        ["name", "productline", "basepremium", "status", "deleted", "event_at"],
    )
    deleted = F.coalesce("deleted", F.lit(False))
    return latest.select(
        F.col("productid").alias("product_id"),
        F.col("name").alias("product_name"),
        F.col("productline").alias("product_line"),
        F.col("basepremium").try_cast(MONEY).alias("base_premium_chf"),
        "status",
        deleted.alias("deleted"),
        F.when(deleted, True).when(F.col("status") == "DEPRECATED", True)
        .otherwise(False).alias("is_deprecated"),
        F.col("event_at").alias("updated_at"),
    )


def employee(raw: DataFrame, interval: Interval = None) -> DataFrame:
    """Latest by time then version; change rows without a name may win, as in the source."""
    events = within(with_event_time(raw), interval).filter(
        (F.col("employeeid") != "")
        & ((F.col("eventtype") == "employee.updated") | F.col("eventtype").isNull())
    )
    latest = latest_per_key(
        events, "employeeid", ["event_at", "version", *_tie(raw)],
        ["externalid", "firstname", "lastname", "email", "jobtitle", "department", "orgunitid",
         "entrydate", "active", "deleted", "event_at"],
    )
    active, deleted = F.coalesce("active", F.lit(True)), F.coalesce("deleted", F.lit(False))
    return latest.select(
        F.col("employeeid").alias("employee_id"),
        F.col("externalid").alias("external_id"),
        F.col("firstname").alias("first_name"),
        F.col("lastname").alias("last_name"),
        full_name("firstname", "lastname").alias("full_name"),
        "email",
        F.col("jobtitle").alias("job_title"),
        "department",
        F.col("orgunitid").alias("org_unit_id"),
        F.col("entrydate").try_cast("date").alias("entry_date"),
        active.alias("active"),
        deleted.alias("deleted"),
        F.when(deleted, "DELETED").when(~active, "INACTIVE").otherwise("ACTIVE")
        .alias("employment_status"),
        F.col("event_at").alias("updated_at"),
    )


def org_unit(raw: DataFrame, interval: Interval = None) -> DataFrame:
    """Latest named row by time then version."""
    events = within(with_event_time(raw), interval).filter(
        F.col("name").isNotNull()
        & ((F.col("eventtype") == "org-unit.updated") | F.col("eventtype").isNull())
    )
    latest = latest_per_key(
        events, "orgunitid", ["event_at", "version", *_tie(raw)],
        ["externalid", "name", "parentorgunitid", "level", "active", "deleted", "event_at"],
    )
    return latest.select(
        F.col("orgunitid").alias("org_unit_id"),
        F.col("externalid").alias("external_id"),
        "name",
        F.col("parentorgunitid").alias("parent_org_unit_id"),
        F.col("level").cast("int").alias("level"),
        F.coalesce("active", F.lit(True)).alias("active"),
        F.coalesce("deleted", F.lit(False)).alias("deleted"),
        F.col("event_at").alias("updated_at"),
    )
