"""Business rules over whole tables: pricing, instalments, coverage and address checks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnlake.functions.text import is_blank, mapped, starts_with_any

MONEY = "decimal(15,2)"

# Premium rates as parts of the base premium, and urban postal prefixes.
YOUNG_BELOW, YOUNG_RATE = 25, "0.10"
SENIOR_ABOVE, SENIOR_RATE = 70, "0.20"
URBAN_RATE = "0.05"
EXTRA_COVERAGE_RATE = "0.03"
BUNDLE_FROM, BUNDLE_RATE = 3, "0.05"
URBAN_PREFIXES = ["80", "81", "30", "31", "40", "12", "10"]
CURRENCY = "CHF"

# Instalments per year and line-item label of each billing cycle.
INSTALMENTS = {"ANNUAL": 1, "SEMI_ANNUAL": 2, "QUARTERLY": 4, "MONTHLY": 12}
CYCLE_LABELS = {
    "ANNUAL": "Jahresprämie",
    "SEMI_ANNUAL": "Halbjahresprämie",
    "QUARTERLY": "Quartalsprämie",
    "MONTHLY": "Monatsprämie",
}
PAYMENT_DAYS = 30


def risk_is_valid() -> Column:
    """Age within 0..150 and a postal code that is not blank."""
    return F.coalesce(F.col("age").between(0, 150), F.lit(False)) & ~is_blank("postal_code")


def price(risks: DataFrame) -> DataFrame:
    """Adds surcharges, discount and total to rows with ``base_premium``, ``age``,
    ``postal_code`` and ``coverage_types``; rows of invalid risks are left out.
    """
    def rate(text: str) -> Column:
        return F.lit(text).cast("decimal(3,2)")

    zero = rate("0.00")
    base = F.col("base_premium").cast(MONEY)
    n = F.size(F.coalesce("coverage_types", F.array().cast("array<string>")))
    age_rate = (
        F.when(F.col("age") < YOUNG_BELOW, rate(YOUNG_RATE))
        .when(F.col("age") > SENIOR_ABOVE, rate(SENIOR_RATE))
        .otherwise(zero)
    )
    urban = F.when(starts_with_any("postal_code", URBAN_PREFIXES), rate(URBAN_RATE)).otherwise(zero)
    extra = F.greatest(n - 1, F.lit(0)).cast("decimal(9,0)")
    risk = base * (age_rate + urban)
    coverage = base * rate(EXTRA_COVERAGE_RATE) * extra
    discount = base * F.when(n >= BUNDLE_FROM, rate(BUNDLE_RATE)).otherwise(zero)
    total = F.greatest(base + risk + coverage - discount, F.lit(0).cast(MONEY))
    return risks.filter(risk_is_valid()).withColumns(
        {
            "risk_surcharge": F.round(risk, 2).cast(MONEY),
            "coverage_surcharge": F.round(coverage, 2).cast(MONEY),
            "discount": F.round(discount, 2).cast(MONEY),
            "total_premium": F.round(total, 2).cast(MONEY),
            "currency": F.lit(CURRENCY),
        }
    )


def rejected_risks(risks: DataFrame) -> DataFrame:
    """The rows :func:`price` leaves out, with a reason."""
    bad_age = ~F.coalesce(F.col("age").between(0, 150), F.lit(False))
    return risks.filter(~risk_is_valid()).withColumn(
        "reason", F.when(bad_age, "invalid age").otherwise("postal code is blank")
    )


def instalments(policies: DataFrame, invoice_date: Column | date | str) -> DataFrame:
    """First invoice of each policy: amount per instalment, due date and line text."""
    day = invoice_date if isinstance(invoice_date, Column) else F.lit(invoice_date).cast("date")
    per_year = mapped("billing_cycle", INSTALMENTS)
    amount = F.round(F.col("annual_premium_chf") / per_year.cast("decimal(2,0)"), 2).cast(MONEY)
    return policies.withColumns(
        {
            "instalments_per_year": per_year,
            "total_amount_chf": amount,
            "invoice_date": day,
            "due_date": F.date_add(day, PAYMENT_DAYS),
            "line_text": F.concat_ws(" ", mapped("billing_cycle", CYCLE_LABELS), "policy_number"),
        }
    )


# --- coverages -----------------------------------------------------------------------------


def current_coverages(added: DataFrame, removed: DataFrame) -> DataFrame:
    """Coverages added and not removed again."""
    return added.join(removed.select("coverage_id"), "coverage_id", "left_anti")


def repeated_coverage_types(coverages: DataFrame) -> DataFrame:
    """(policy, type) pairs held more than once."""
    return (
        coverages.groupBy("policy_id", "coverage_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )


# --- addresses -----------------------------------------------------------------------------

DEFAULT_COUNTRY = "Schweiz"


def address_problems() -> Column:
    """The broken rules of an address row, joined with commas; '' when there are none."""
    def problem(condition: Column, text: str) -> Column:
        return F.when(F.coalesce(condition, F.lit(True)), text)

    return F.concat_ws(
        ",",
        problem(F.col("address_id").isNull(), "address_id"),
        problem(F.col("partner_id").isNull(), "partner_id"),
        problem(F.col("address_type").isNull(), "address_type"),
        problem(is_blank("street"), "street"),
        problem(is_blank("house_number"), "house_number"),
        problem(~F.col("postal_code").rlike(r"^\d{4}$"), "postal_code"),
        problem(is_blank("city"), "city"),
        problem(F.col("valid_from").isNull(), "valid_from"),
        F.when(F.col("valid_from") > F.col("valid_to"), "valid_to"),
    )


def default_country() -> Column:
    return F.when(is_blank("country"), DEFAULT_COUNTRY).otherwise(F.col("country"))


def is_current(as_of: date | str) -> Column:
    day = F.lit(as_of).cast("date")
    return (F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day))


def validity(as_of: date | str) -> Column:
    """CURRENT, PRE_RECORDED (starts later) or PAST."""
    day = F.lit(as_of).cast("date")
    return (
        F.when(F.col("valid_from") > day, "PRE_RECORDED")
        .when(is_current(as_of), "CURRENT")
        .otherwise("PAST")
    )


def address_history(
    addresses: DataFrame, as_of: date | str, address_type: str | None = None,
    current_only: bool = False,
) -> DataFrame:
    """Addresses by start of validity, optionally of one type and current only."""
    kept = addresses
    if address_type is not None:
        kept = kept.filter(F.col("address_type") == address_type)
    if current_only:
        kept = kept.filter(is_current(as_of))
    return kept.withColumn("validity", validity(as_of)).orderBy(
        "partner_id", "valid_from", "address_id"
    )
