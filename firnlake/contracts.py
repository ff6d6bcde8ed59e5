"""Topic contracts: fields, required keys, allowed values, unique keys and freshness.

A contract compiles to a read schema and to check expressions over the message text.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ADDRESS = (
    "array<struct<addressId:string,addressType:string,street:string,houseNumber:string,"
    "postalCode:string,city:string,land:string,validFrom:string,validTo:string>>"
)

# JSON types of the fields that are not text
_TYPES = {
    "basePremium": "decimal(15,2)",
    "deleted": "boolean",
    "encrypted": "boolean",
    "active": "boolean",
    "version": "bigint",
    "level": "int",
    "addresses": ADDRESS,
}


@dataclass(frozen=True)
class Contract:
    topic: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    event_type: str | None = None
    values: dict[str, tuple[str, ...]] = field(default_factory=dict)
    unique: tuple[str, ...] = ()
    freshness_seconds: int = 300
    key: str = ""
    number_fields: tuple[str, ...] = ()  # JSON numbers rather than text

    @property
    def fields(self) -> tuple[str, ...]:
        return self.required + self.optional

    @property
    def schema(self) -> T.StructType:
        parts = []
        for name in self.fields:
            kind = "decimal(15,2)" if name in self.number_fields else _TYPES.get(name, "string")
            parts.append(f"{name} {kind}")
        return T.StructType.fromDDL(", ".join(parts))

    @property
    def allowed(self) -> dict[str, tuple[str, ...]]:
        own = {"eventType": (self.event_type,)} if self.event_type else {}
        return {**own, **self.values}

    # --- checks over the JSON text -------------------------------------------------------

    def problems(self, found: Column) -> Column:
        """What is wrong with a message of this topic (:func:`problems_by`)."""
        spec = self.spec()
        kinds = sorted({k["kind"] for k in spec["kinds"]} - {"array"})
        return problems_by(found, F.from_json(F.lit(json.dumps(spec)), _SPEC), kinds)

    def spec(self) -> dict:
        """The checks as data: needed and known fields, allowed values, and fields that are no text."""
        kinds = [(f.name, "array" if isinstance(f.dataType, T.ArrayType) else f.dataType.simpleString()) for f in self.schema.fields]
        return {
            "required": list(self.required), "known": list(self.fields),
            "allowed": [{"name": n, "values": list(v)} for n, v in self.allowed.items()],
            "kinds": [{"name": n, "kind": k} for n, k in kinds if k != "string"],
        }


_SPEC = (
    "struct<required:array<string>,known:array<string>,allowed:array<struct<name:string,values:array<string>>>,"
    "kinds:array<struct<name:string,kind:string>>>"
)


def problems_by(found: Column, spec: Column, kinds: Sequence[str]) -> Column:
    """What is wrong with a message: '' or e.g. ``missing:premium;extra:foo``.

    ``found`` is the text parsed to a map (:func:`as_map`), NULL if it is no JSON object; ``spec`` the checks of its
    topic as data, so that one expression serves all topics. What a well-formed message passes by a plain comparison
    (the needed fields in order, one field with allowed values, no typed field) is not looked at one by one.
    """
    keys = F.map_keys(found)
    as_needed = F.coalesce(keys == spec["required"], F.lit(False))
    only = F.get(spec["allowed"], 0)
    allowed = (F.size(spec["allowed"]) == 1) & F.array_contains(only["values"], F.try_element_at(found, only["name"]))
    allowed = F.coalesce((F.size(spec["allowed"]) == 0) | allowed, F.lit(False))
    missing = F.array_join(F.array_except(spec["required"], keys), ",")
    extra = F.array_join(F.sort_array(F.array_except(keys, spec["known"])), ",")

    def value(check: Column) -> Column:
        text = F.try_element_at(found, check["name"])
        return F.when(text.isNotNull() & ~F.array_contains(check["values"], text), F.concat(F.lit("value:"), check["name"]))

    def typed(check: Column) -> Column:
        text = F.try_element_at(found, check["name"])
        wrong = F.when(check["kind"] == "array", ~text.startswith("["))
        for kind in kinds:
            wrong = wrong.when(check["kind"] == kind, text.isNotNull() & text.try_cast(kind).isNull())
        return F.when(wrong, F.concat(F.lit("type:"), check["name"]))

    listed = F.concat_ws(
        ";",
        F.when(~as_needed, F.when(missing != "", F.concat(F.lit("missing:"), missing))),
        F.when(~as_needed, F.when(extra != "", F.concat(F.lit("extra:"), extra))),
        F.when(~allowed, F.transform(spec["allowed"], value)),
        F.when(F.size(spec["kinds"]) > 0, F.transform(spec["kinds"], typed)),
    )
    fine = as_needed & allowed & (F.size(spec["kinds"]) == 0)
    return F.when(found.isNull(), "not a JSON object").when(fine, "").otherwise(listed)


def as_map(text: Column | str = "value") -> Column:
    """Top-level fields of a JSON object as text; NULL for anything else."""
    t = F.col(text) if isinstance(text, str) else text
    return F.when(F.ltrim(t).startswith("{"), F.from_json(t, "map<string,string>"))


_ADDRESS_TYPES = ("RESIDENCE", "CORRESPONDENCE", "DELIVERY")
_LINES = ("HOUSEHOLD_CONTENTS", "LIABILITY", "MOTOR_VEHICLE", "TRAVEL", "LEGAL_EXPENSES")

# The topics and their messages.
CONTRACTS: dict[str, Contract] = {
    c.topic: c
    for c in [
        Contract(
            "policy.v1.issued",
            ("eventId", "eventType", "policyId", "policyNumber", "partnerId", "productId",
             "coverageStartDate", "premium", "timestamp"),
            event_type="PolicyIssued", unique=("eventId",), key="policyId",
        ),
        Contract(
            "policy.v1.changed",
            ("eventId", "eventType", "policyId", "policyNumber", "premium", "deductible",
             "timestamp"),
            event_type="PolicyChanged", unique=("eventId",), key="policyId",
        ),
        Contract(
            "policy.v1.cancelled",
            ("eventId", "eventType", "policyId", "policyNumber", "timestamp"),
            event_type="PolicyCancelled", unique=("eventId",), key="policyId",
        ),
        Contract(
            "policy.v1.coverage-added",
            ("eventId", "eventType", "policyId", "coverageId", "coverageType", "insuredAmount",
             "timestamp"),
            event_type="CoverageAdded", unique=("eventId",), key="policyId",
        ),
        Contract(
            "policy.v1.coverage-removed",
            ("eventId", "eventType", "policyId", "coverageId", "timestamp"),
            event_type="CoverageRemoved", unique=("eventId",), key="policyId",
        ),
        Contract(
            "billing.v1.invoice-created",
            ("eventId", "eventType", "invoiceId", "invoiceNumber", "policyId", "policyNumber",
             "partnerId", "billingCycle", "totalAmount", "dueDate", "timestamp"),
            event_type="InvoiceCreated", unique=("eventId",), key="invoiceId",
            freshness_seconds=30,
        ),
        Contract(
            "billing.v1.payment-received",
            ("eventId", "eventType", "invoiceId", "invoiceNumber", "policyId", "partnerId",
             "amountPaid", "paidAt", "timestamp"),
            event_type="PaymentReceived", unique=("eventId",), key="invoiceId",
            freshness_seconds=30,
        ),
        Contract(
            "billing.v1.dunning-initiated",
            ("eventId", "eventType", "dunningCaseId", "invoiceId", "invoiceNumber", "policyId",
             "partnerId", "dunningLevel", "totalAmount", "dueDate", "timestamp"),
            event_type="DunningInitiated", unique=("eventId",), key="invoiceId",
            freshness_seconds=60,
        ),
        Contract(
            "billing.v1.payout-triggered",
            ("eventId", "eventType", "claimId", "policyId", "partnerId", "settlementAmount",
             "timestamp"),
            event_type="PayoutTriggered", unique=("eventId",), key="claimId",
            freshness_seconds=60,
        ),
        Contract(
            "claims.v1.opened",
            ("eventId", "eventType", "claimId", "claimNumber", "policyId", "description",
             "claimDate", "status", "timestamp"),
            event_type="ClaimOpened", unique=("claimId", "eventId"), key="claimId",
        ),
        Contract(
            "claims.v1.under-review",
            ("eventId", "eventType", "claimId", "claimNumber", "policyId", "claimDate", "status",
             "timestamp"),
            event_type="ClaimUnderReview", unique=("eventId",), key="claimId",
        ),
        Contract(
            "claims.v1.settled",
            ("eventId", "eventType", "claimId", "claimNumber", "policyId", "claimDate", "status",
             "settlementAmount", "timestamp"),
            event_type="ClaimSettled", unique=("eventId",), key="claimId",
            number_fields=("settlementAmount",),
        ),
        Contract(
            "claims.v1.rejected",
            ("eventId", "eventType", "claimId", "claimNumber", "policyId", "claimDate", "status",
             "timestamp"),
            event_type="ClaimRejected", unique=("eventId",), key="claimId",
        ),
        Contract(
            "product.v1.defined",
            ("eventId", "eventType", "productId", "name", "productLine", "basePremium",
             "timestamp"),
            event_type="ProductDefined", unique=("eventId",), key="productId",
            freshness_seconds=600,
        ),
        Contract(
            "product.v1.updated",
            ("eventId", "eventType", "productId", "name", "productLine", "basePremium",
             "timestamp"),
            event_type="ProductUpdated", unique=("eventId",), key="productId",
            freshness_seconds=600,
        ),
        Contract(
            "product.v1.deprecated",
            ("eventId", "eventType", "productId", "timestamp"),
            event_type="ProductDeprecated", unique=("eventId",), key="productId",
            freshness_seconds=600,
        ),
        Contract(
            "product.v1.state",
            ("eventType", "productId", "deleted", "timestamp"),
            ("name", "productLine", "basePremium", "status"),
            event_type="ProductState", key="productId",
            values={"productLine": _LINES, "status": ("ACTIVE", "DEPRECATED")},
        ),
        Contract(
            "person.v1.created",
            ("eventId", "eventType", "personId", "name", "firstName", "dateOfBirth", "timestamp"),
            ("socialSecurityNumber", "insuredNumber", "encrypted"),
            event_type="PersonCreated", unique=("eventId",), key="personId",
        ),
        Contract(
            "person.v1.updated",
            ("eventId", "eventType", "personId", "name", "firstName", "timestamp"),
            ("insuredNumber", "encrypted"),
            event_type="PersonUpdated", unique=("eventId",), key="personId",
        ),
        Contract(
            "person.v1.deleted",
            ("eventId", "eventType", "personId", "timestamp"),
            event_type="PersonDeleted", unique=("eventId",), key="personId",
        ),
        Contract(
            "person.v1.address-added",
            ("eventId", "eventType", "personId", "addressId", "addressType", "street",
             "houseNumber", "postalCode", "city", "land", "validFrom", "timestamp"),
            ("validTo", "encrypted"),
            event_type="AddressAdded", values={"addressType": _ADDRESS_TYPES},
            unique=("eventId",), key="personId",
        ),
        Contract(
            "person.v1.address-updated",
            ("eventId", "eventType", "personId", "addressId", "validFrom", "timestamp"),
            ("validTo",),
            event_type="AddressUpdated", unique=("eventId",), key="personId",
        ),
        Contract(
            "person.v1.state",
            ("eventType", "personId", "deleted", "timestamp"),
            ("name", "firstName", "gender", "dateOfBirth", "socialSecurityNumber",
             "insuredNumber", "encrypted", "addresses"),
            event_type="PersonState", key="personId",
        ),
        Contract(
            "hr.v1.employee.state",
            ("employeeId", "externalId", "firstName", "lastName", "entryDate", "active",
             "deleted", "version", "timestamp"),
            ("email", "jobTitle", "department", "orgUnitId", "exitDate"),
            key="employeeId",
        ),
        Contract(
            "hr.v1.employee.changed",
            ("eventId", "eventType", "employeeId", "externalId", "timestamp"),
            values={"eventType": ("employee.created", "employee.updated", "employee.deleted")},
            unique=("eventId",), key="employeeId",
        ),
        Contract(
            "hr.v1.org-unit.state",
            ("orgUnitId", "externalId", "name", "level", "active", "deleted", "version",
             "timestamp"),
            ("parentOrgUnitId", "managerEmployeeId"),
            key="orgUnitId",
        ),
        Contract(
            "hr.v1.org-unit.changed",
            ("eventId", "eventType", "orgUnitId", "externalId", "timestamp"),
            values={"eventType": ("org-unit.created", "org-unit.updated", "org-unit.deleted")},
            unique=("eventId",), key="orgUnitId",
        ),
    ]
}

# Raw table fed by each group of topics.
RAW_TABLES: dict[str, list[str]] = {
    "policy_raw.policy_events": [t for t in CONTRACTS if t.startswith("policy.")],
    "billing_raw.billing_events": [t for t in CONTRACTS if t.startswith("billing.")],
    "claims_raw.claims_events": [t for t in CONTRACTS if t.startswith("claims.")],
    "product_raw.product_events": [t for t in CONTRACTS if t.startswith("product.")],
    "partner_raw.person_events": [t for t in CONTRACTS if t.startswith("person.")],
    "hr_raw.employee_events": ["hr.v1.employee.state", "hr.v1.employee.changed"],
    "hr_raw.org_unit_events": ["hr.v1.org-unit.state", "hr.v1.org-unit.changed"],
}


def split_valid(messages: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """(valid messages, rejects with a ``reason``) by the contract's message checks."""
    flagged = with_reason(messages, {contract.topic: contract}, every_topic=contract)
    return flagged.filter("reason = ''").drop("reason"), flagged.filter("reason != ''")


def with_reason(
    messages: DataFrame, contracts: dict[str, Contract] = CONTRACTS, every_topic: Contract | None = None
) -> DataFrame:
    """Adds ``reason``: the problems of each message by the contract of its topic.

    The text is parsed once.  Topics without a contract are judged by ``every_topic``, if given.
    """
    known = {t: c.spec() for t, c in contracts.items()}
    every = every_topic.spec() if every_topic else None
    kinds = sorted({k["kind"] for s in [*known.values(), *([every] if every else [])] for k in s["kinds"]} - {"array"})
    if every and all(c is every_topic for c in contracts.values()):
        spec = F.from_json(F.lit(json.dumps(every)), _SPEC)
    else:
        spec = F.try_element_at(F.from_json(F.lit(json.dumps(known)), f"map<string,{_SPEC}>"), F.col("topic"))
        spec = F.coalesce(spec, F.from_json(F.lit(json.dumps(every)), _SPEC)) if every else spec
    # each is evaluated once per message
    parsed = messages.withColumns({"_found": as_map("value"), "_spec": spec})
    reason = problems_by(F.col("_found"), F.col("_spec"), kinds)
    return parsed.withColumn("reason", F.when(F.col("_spec").isNull(), "unknown topic").otherwise(reason)).drop("_found", "_spec")


def contract_report(messages: DataFrame, contracts: dict[str, Contract] = CONTRACTS) -> DataFrame:
    """Messages and broken ones per topic, in one pass over (topic, value)."""
    return (
        with_reason(messages.select("topic", "value"), contracts)
        .groupBy("topic", "reason")
        .agg(F.count(F.lit(1)).alias("messages"))
    )


def duplicates(messages: DataFrame, contracts: dict[str, Contract] = CONTRACTS) -> DataFrame:
    """(topic, field, key, n): repeated values of the unique fields of all topics, in one pass.

    Counts are summed in each task, so a value with a third of all messages is no hot key. Topic and field are
    one number until the repeated values are found: ids are many, and their rows short.
    """
    some = {t: c.unique for t, c in contracts.items() if c.unique}
    slots = [(t, f) for t, unique in some.items() for f in unique]
    listed = None
    for unique in dict.fromkeys(some.values()):
        mine = [t for t, u in some.items() if u == unique]

        def slot(field: str, mine: list[str] = mine) -> Column:
            numbers = F.array(*[F.lit(slots.index((t, field))) for t in mine])
            return F.get(numbers, (F.array_position(F.array(*[F.lit(t) for t in mine]), F.col("topic")) - 1).cast("int"))

        fields = F.array(*[F.struct(slot(f).alias("slot"), F.get_json_object("value", f"$.{f}").alias("key")) for f in unique])
        match = F.col("topic").isin(mine)
        listed = F.when(match, fields) if listed is None else listed.when(match, fields)
    found = messages.select(F.explode(listed).alias("u")).select("u.*").filter(F.col("key").isNotNull())
    several = found.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    topics, fields = (F.array(*[F.lit(x) for x in names]) for names in zip(*slots, strict=True))
    return several.select(F.get(topics, F.col("slot")).alias("topic"), F.get(fields, F.col("slot")).alias("field"), "key", "n")
