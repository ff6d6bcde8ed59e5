"""Data quality: declared checks, one aggregate per table, plus audits and completeness.

All checks of a table share one scan: rows are grouped by the column whose duplicates are
counted, the other counts ride along and are summed up above it.  Only a second duplicate
column of the same table, or a comparison with another table, adds a scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from firnlake.operators.lookup import side_by_side


@dataclass(frozen=True)
class Check:
    """One declared check; it passes when its count is 0 (``rows``: when it is not)."""

    kind: str  # rows, duplicate, missing, invalid, same_rows
    name: str
    column: str | None = None
    values: tuple[str, ...] = ()
    pattern: str | None = None
    where: str | None = None
    other: str | None = None

    def row_measure(self) -> Column:
        if self.kind == "rows":
            return F.count(F.lit(1))
        if self.kind == "missing":
            return F.count_if(F.col(self.column).isNull())
        col = F.col(self.column)
        valid = col.isin(*self.values) if self.values else col.rlike(self.pattern)
        condition = col.isNotNull() & ~valid
        if self.where:
            condition = condition & F.expr(self.where)
        return F.count_if(condition)


def rows() -> Check:
    return Check("rows", "has rows")


def no_duplicates(column: str) -> Check:
    return Check("duplicate", f"{column} unique", column)


def no_missing(column: str) -> Check:
    return Check("missing", f"{column} present", column)


def only_values(column: str, values: Sequence[str]) -> Check:
    return Check("invalid", f"{column} in list", column, values=tuple(values))


def only_pattern(column: str, pattern: str, where: str | None = None) -> Check:
    return Check("invalid", f"{column} in form", column, pattern=pattern, where=where)


def same_rows(other: str) -> Check:
    return Check("same_rows", f"as many rows as {other}", other=other)


# The declared checks per table.  The insured-number pattern is anchored.
CHECKS: dict[str, list[Check]] = {
    "billing_raw.billing_events": [
        rows(),
        no_duplicates("eventid"),
        no_missing("invoiceid"),
    ],
    "billing_silver.invoice": [
        rows(),
        no_duplicates("invoice_id"),
        no_missing("policy_id"),
        only_values("invoice_status", ["OPEN", "PAID", "OVERDUE", "PAYOUT"]),
    ],
    "hr_raw.employee_events": [
        rows(),
        no_missing("employeeid"),
    ],
    "hr_raw.org_unit_events": [
        rows(),
        no_missing("orgunitid"),
    ],
    "hr_silver.employee": [
        rows(),
        no_duplicates("employee_id"),
        no_missing("last_name"),
        no_missing("entry_date"),
        only_values("employment_status", ["ACTIVE", "INACTIVE", "DELETED"]),
        only_pattern("email", r"^[\w.+-]+@[\w-]+\.[\w.-]+$", "email IS NOT NULL"),
    ],
    "hr_silver.org_unit": [
        rows(),
        no_duplicates("org_unit_id"),
        no_missing("name"),
    ],
    "analytics.org_hierarchy": [
        rows(),
    ],
    "partner_raw.person_events": [
        rows(),
        no_duplicates("eventid"),
        no_missing("personid"),
    ],
    "partner_silver.partner": [
        rows(),
        no_duplicates("partner_id"),
        only_pattern("insured_number", r"^VN-\d{8}$", "insured_number IS NOT NULL"),
    ],
    "policy_raw.policy_events": [
        rows(),
        no_duplicates("eventid"),
        no_missing("policyid"),
    ],
    "policy_silver.policy": [
        rows(),
        no_duplicates("policy_id"),
        only_values("policy_status", ["ACTIVE", "CANCELLED"]),
    ],
    "policy_gold.policy_detail": [
        rows(),
        no_duplicates("policy_id"),
        same_rows("policy_silver.policy"),
    ],
    "product_raw.product_events": [
        rows(),
        no_duplicates("eventid"),
        no_missing("productid"),
    ],
    "product_silver.product": [
        rows(),
        no_duplicates("product_id"),
    ],
}


def written(df: DataFrame, path: str) -> tuple[DataFrame, int]:
    """``df`` written and read back, with its number of rows, which is counted as they are written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["rows"]


def check_table(
    table: str, df: DataFrame, checks: Sequence[Check], tables: dict[str, DataFrame] | None = None,
    counts: dict[str, int] | None = None,
) -> DataFrame:
    """One row per check: table_name, check_name, measured, passed.

    ``counts`` are the numbers of rows that are known already (:func:`written`); other tables are counted.
    """
    def result(check: Check, measured: Column, passed: Column | None = None) -> Column:
        return F.struct(
            F.lit(table).alias("table_name"),
            F.lit(check.name).alias("check_name"),
            measured.cast("bigint").alias("measured"),
            (measured == 0 if passed is None else passed).alias("passed"),
        )

    plain = [c for c in checks if c.kind in ("rows", "missing", "invalid")]
    repeats = [c for c in checks if c.kind == "duplicate"]
    others = [c for c in checks if c.kind == "same_rows"]
    measures = {f"m{i}": c.row_measure() for i, c in enumerate(plain)}
    measures["_rows"] = F.count(F.lit(1))
    named = [m.alias(n) for n, m in measures.items()]
    results = [
        result(c, F.col(f"m{i}"), F.col(f"m{i}") > 0 if c.kind == "rows" else None)
        for i, c in enumerate(plain)
    ]
    frames = []
    if repeats:
        # the values of the first duplicate column, each with its share of the other counts
        grouped = df.groupBy(F.col(repeats[0].column).alias("_value")).agg(*named)
        repeated = F.count_if(F.col("_value").isNotNull() & (F.col("_rows") > 1)).alias("d0")
        sums = [F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in measures]
        frames.append(grouped.agg(repeated, *sums))
    else:
        frames.append(df.agg(*named))
    for i, check in enumerate(repeats):
        if i:
            grouped = df.groupBy(F.col(check.column).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
            repeated = F.count_if(F.col("_value").isNotNull() & (F.col("_n") > 1))
            frames.append(grouped.agg(repeated.alias(f"d{i}")))
        results.append(result(check, F.col(f"d{i}")))
    for i, check in enumerate(others):
        if counts and check.other in counts:
            results.append(result(check, F.abs(F.col("_rows") - F.lit(counts[check.other]))))
            continue
        frames.append(tables[check.other].agg(F.count(F.lit(1)).alias(f"o{i}")))
        results.append(result(check, F.abs(F.col("_rows") - F.col(f"o{i}"))))
    measured = frames[0] if len(frames) == 1 else side_by_side(*frames)
    return measured.select(F.inline(F.array(*results)))


def report(
    tables: dict[str, DataFrame], checks: dict[str, list[Check]] = CHECKS, counts: dict[str, int] | None = None
) -> DataFrame:
    """The results of all checks of the tables at hand."""
    parts = [check_table(t, df, checks[t], tables, counts) for t, df in tables.items() if checks.get(t)]
    return reduce(DataFrame.unionByName, parts)


# --- audits ----------------------------------------------------------------------------------


def premium_not_positive(policies: DataFrame) -> DataFrame:
    """Active policies without a positive premium."""
    return policies.filter(
        (F.col("policy_status") == "ACTIVE")
        & (F.col("premium_chf").isNull() | (F.col("premium_chf") <= 0))
    ).select("policy_id")


# Event types that must occur in each raw table.
EXPECTED_EVENTS = {
    "policy_raw.policy_events": ["PolicyIssued", "PolicyCancelled", "CoverageAdded"],
    "claims_raw.claims_events": ["ClaimOpened", "ClaimSettled"],
    "product_raw.product_events": ["ProductState", "ProductDefined"],
    "partner_raw.person_events": ["PersonState"],
    "billing_raw.billing_events": [
        "InvoiceCreated", "PaymentReceived", "DunningInitiated", "PayoutTriggered"
    ],
}


def event_coverage(
    tables: dict[str, DataFrame], expected: dict[str, list[str]] = EXPECTED_EVENTS
) -> DataFrame:
    """One row per expected (table, event type) with its count and whether it is present."""
    parts = []
    for table, kinds in expected.items():
        counts = tables[table].agg(
            *[F.count_if(F.col("eventtype") == kind).alias(kind) for kind in kinds]
        )
        rows_ = [
            F.struct(
                F.lit(table).alias("table_name"), F.lit(kind).alias("event_type"),
                F.col(kind).alias("events"), (F.col(kind) > 0).alias("present"),
            )
            for kind in kinds
        ]
        parts.append(counts.select(F.inline(F.array(*rows_))))
    return reduce(DataFrame.unionByName, parts)


def non_empty(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table and whether it has rows."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count", (F.col("row_count") > 0).alias("passed")
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def silver_completeness(coverages: DataFrame, policies: DataFrame) -> DataFrame:
    """Coverage rows present, and both ACTIVE and CANCELLED among the policy statuses."""
    n = coverages.agg(F.count(F.lit(1)).alias("coverage_rows"))
    # distinct first: only the few status values meet in one row
    statuses = policies.select("policy_status").distinct().agg(
        F.array_join(F.sort_array(F.collect_list("policy_status")), ",").alias("policy_statuses"),
        F.count_if(F.col("policy_status").isin("ACTIVE", "CANCELLED")).alias("_n"),
    )
    return side_by_side(n, statuses).select(
        "coverage_rows", "policy_statuses",
        ((F.col("coverage_rows") > 0) & (F.col("_n") == 2)).alias("passed"),
    )


def freshness(
    tables: dict[str, DataFrame], as_of: str, limits: dict[str, int], time: str = "event_at"
) -> DataFrame:
    """Seconds between ``as_of`` and the newest row of each table, against its limit."""
    now = F.lit(as_of).cast("timestamp")
    parts = [
        df.agg(F.max(time).alias("newest")).select(
            F.lit(name).alias("table_name"), "newest",
            (F.unix_seconds(now) - F.unix_seconds("newest")).alias("age_seconds"),
            F.lit(limits[name]).cast("bigint").alias("limit_seconds"),
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts).withColumn(
        "passed", F.coalesce(F.col("age_seconds") <= F.col("limit_seconds"), F.lit(False))
    )
