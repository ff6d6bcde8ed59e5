"""Dashboard data: column subsets of silver tables and the grouped figures of its charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns of the dashboard's data sets.
DATASETS = {
    "policy": ["policy_id", "policy_number", "partner_id", "product_id", "coverage_start_date",
               "premium_chf", "policy_status", "issued_at", "updated_at"],
    "claim": ["claim_id", "claim_number", "policy_id", "description", "claim_date", "status",
              "opened_at", "updated_at"],
    "invoice": ["invoice_id", "invoice_number", "policy_id", "partner_id", "policy_number",
                "billing_cycle", "total_amount_chf", "due_date", "invoice_status",
                "amount_paid_chf", "paid_at", "created_at", "updated_at"],
    "partner": ["partner_id", "insured_number", "gender", "partner_status", "encrypted", "deleted",
                "updated_at"],
    "product": ["product_id", "product_name", "product_line", "base_premium_chf", "status",
                "is_deprecated", "updated_at"],
}


def dataset(table: DataFrame, name: str) -> DataFrame:
    return table.select(*DATASETS[name])


def count_by(
    table: DataFrame, keys: Sequence[str], limit: int, sums: Sequence[str] = ()
) -> DataFrame:
    """Rows per key, biggest groups first, with optional sums."""
    figures = [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums]]
    return table.groupBy(*keys).agg(*figures).orderBy(F.col("n").desc(), *keys).limit(limit)


def sum_by(table: DataFrame, keys: Sequence[str], sums: Sequence[str], limit: int) -> DataFrame:
    """Sums per key, biggest first sum first."""
    return (
        table.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
        .orderBy(F.col(sums[0]).desc(), *keys).limit(limit)
    )


def total(table: DataFrame) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("n"))
