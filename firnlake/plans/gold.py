"""Gold marts: enrichment joins, roll-ups and management figures over silver tables.

Silver tables hold one row per key; the marts rely on that.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnlake.functions.text import full_name
from firnlake.operators.lookup import enrich, side_by_side
from firnlake.operators.privacy import decrypt, join_keys

MONEY = "decimal(15,2)"


def policy_detail(policies: DataFrame, partners: DataFrame, products: DataFrame) -> DataFrame:
    """Policies with insured number, product and premium deviation in percent.

    The warehouse this replaces divides DECIMAL(15,2) by DECIMAL(15,2) at scale 2, so its
    ratio is already rounded to whole percents before the final ROUND(x, 1).  The same
    rounding is applied here to give the same figures.
    """
    joined = enrich(
        policies, partners, ("partner_id", "partner_id"),
        {"partner_id": "_partner", "insured_number": "insured_number",
         "partner_status": "partner_status"},
        spread_by="policy_id",
    )
    joined = enrich(
        joined, products, ("product_id", "product_id"),
        {"product_name": "product_name", "product_line": "product_line",
         "base_premium_chf": "base_premium_chf"},
        spread_by="policy_id",
    )
    base = F.col("base_premium_chf")
    ratio = (F.col("premium_chf") - base) / F.nullif(base, F.lit(0).cast(MONEY))
    delta = F.round(ratio, 2) * 100
    return joined.select(
        "policy_id", "policy_number", "policy_status",
        F.col("_partner").alias("partner_id"),
        F.coalesce("insured_number", F.lit("UNKNOWN")).alias("insured_number"),
        "partner_status",
        F.coalesce("product_name", F.lit("UNKNOWN")).alias("product_name"),
        F.coalesce("product_line", F.lit("UNKNOWN")).alias("product_line"),
        "coverage_start_date", "premium_chf", "base_premium_chf",
        F.round(delta, 1).cast("decimal(18,1)").alias("premium_delta_pct"),
        "issued_at", "updated_at",
    )


def portfolio_summary(policies: DataFrame, products: DataFrame) -> DataFrame:
    """Active policies of products not deprecated, per line and product.

    Policies are first rolled up per product id, so the join sees one row per product and
    a best-selling product cannot overload a task.
    """
    per_product = (
        policies.filter(F.col("policy_status") == "ACTIVE")
        .groupBy("product_id")
        .agg(
            F.count("policy_id").alias("n"),
            F.count("premium_chf").alias("n_premium"),
            F.sum("premium_chf").alias("total"),
            F.min("coverage_start_date").alias("lo"),
            F.max("coverage_start_date").alias("hi"),
        )
    )
    joined = enrich(
        per_product, products, ("product_id", "product_id"),
        {"product_line": "product_line", "product_name": "product_name",
         "is_deprecated": "is_deprecated"}, unique=True,
    ).filter(F.col("is_deprecated").isNull() | ~F.col("is_deprecated"))
    total = F.sum("total")
    return (
        joined.groupBy(
            F.coalesce("product_line", F.lit("UNKNOWN")).alias("product_line"),
            F.coalesce("product_name", F.lit("UNKNOWN")).alias("product_name"),
        )
        .agg(
            F.sum("n").alias("active_policies"),
            total.cast("decimal(25,2)").alias("total_premium_chf"),
            F.round(total.cast("decimal(25,2)") / F.nullif(F.sum("n_premium"), F.lit(0).cast("bigint")), 2)
            .cast("decimal(18,2)").alias("avg_premium_chf"),
            F.min("lo").alias("earliest_coverage_start"),
            F.max("hi").alias("latest_coverage_start"),
        )
    )


def financial_summary(policies: DataFrame, invoices: DataFrame) -> DataFrame:
    """Invoice roll-up per policy with a collection status.

    Invoices are summed per policy before the join; the policy table itself is not
    grouped, its key being unique.
    """
    status, amount = F.col("invoice_status"), F.col("total_amount_chf")

    def billed(condition: Column) -> Column:
        return F.sum(F.when(condition, amount))

    per_policy = invoices.filter(F.col("policy_id").isNotNull()).groupBy("policy_id").agg(
        F.count("invoice_id").alias("n"),
        F.count_if(status == "OPEN").alias("n_open"),
        F.count_if(status == "PAID").alias("n_paid"),
        F.count_if(status == "OVERDUE").alias("n_overdue"),
        F.sum(amount).alias("billed"),
        billed(status == "PAID").alias("collected"),
        billed(status.isin("OPEN", "OVERDUE")).alias("outstanding"),
    )
    names = ["n", "n_open", "n_paid", "n_overdue", "billed", "collected", "outstanding"]
    joined = enrich(policies, per_policy, ("policy_id", "policy_id"), {c: c for c in names}, unique=True)

    def count(column: str, alias: str) -> Column:
        return F.coalesce(column, F.lit(0).cast("bigint")).alias(alias)

    def total(column: str, alias: str) -> Column:
        return F.coalesce(column, F.lit(0)).cast("decimal(25,2)").alias(alias)

    return joined.select(
        "policy_id", "policy_number", "partner_id", "product_id",
        F.col("premium_chf").alias("annual_premium_chf"),
        "policy_status", "issued_at",
        count("n", "total_invoices"), count("n_open", "open_invoices"),
        count("n_paid", "paid_invoices"), count("n_overdue", "overdue_invoices"),
        total("billed", "total_billed_chf"), total("collected", "total_collected_chf"),
        total("outstanding", "total_outstanding_chf"),
        F.when(F.col("n_overdue") > 0, "AT_RISK").when(F.col("n_open") > 0, "PENDING")
        .otherwise("CURRENT").alias("collection_status"),
    )


def claim_detail(
    claims: DataFrame, policies: DataFrame, partners: DataFrame, products: DataFrame
) -> DataFrame:
    """Claims with policy, insured number and product."""
    joined = enrich(
        claims, policies, ("policy_id", "policy_id"),
        {"policy_number": "policy_number", "partner_id": "partner_id", "product_id": "product_id"},
        spread_by="claim_id",
    )
    joined = enrich(
        joined, partners, ("partner_id", "partner_id"),
        {"insured_number": "insured_number"}, spread_by="claim_id",
    )
    joined = enrich(
        joined, products, ("product_id", "product_id"),
        {"product_name": "product_name", "product_line": "product_line"}, spread_by="claim_id",
    )
    return joined.select(
        "claim_id", "claim_number", "policy_id", "policy_number", "partner_id", "insured_number",
        "product_name", "product_line", "description", "claim_date", "status", "opened_at",
        "updated_at",
    )


def org_hierarchy(units: DataFrame, employees: DataFrame) -> DataFrame:
    """Units with parent name and employee counts; deleted employees are not counted."""
    staff = (
        employees.filter(~F.col("deleted"))
        .groupBy("org_unit_id")
        .agg(
            F.count("employee_id").alias("n"),
            F.count_if(F.col("employment_status") == "ACTIVE").alias("n_active"),
        )
    )
    joined = enrich(
        units.filter(~F.col("deleted")), units, ("parent_org_unit_id", "org_unit_id"),
        {"name": "parent_name"},
    )
    joined = enrich(joined, staff, ("org_unit_id", "org_unit_id"), {"n": "n", "n_active": "n_active"}, unique=True)
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "org_unit_id", F.col("name").alias("org_unit_name"), "level", "parent_name",
        F.coalesce("n", zero).alias("employee_count"),
        F.coalesce("n_active", zero).alias("active_employee_count"),
    )


def management_kpi(
    policies: DataFrame, products: DataFrame, as_of: date | str | None = None
) -> DataFrame:
    """One row of cross-domain figures.

    Partners are counted through the partner ids of policies.  Policy ids are unique in
    silver, so counting rows is counting distinct policies; only partner and product ids
    need a distinct count.  The partner table adds nothing and is not read.
    """
    today = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    since = F.date_sub(today, 30)
    active = F.col("policy_status") == "ACTIVE"
    cancelled = (F.col("policy_status") == "CANCELLED") & (
        F.col("updated_at") >= since.cast("timestamp")
    )
    figures = policies.agg(
        F.count_distinct("partner_id").alias("total_partners"),
        F.count_if(active).alias("active_policies"),
        F.sum(F.when(active, F.col("premium_chf")).otherwise(F.lit(0).cast(MONEY)))
        .cast("decimal(25,2)").alias("total_portfolio_premium_chf"),
        F.avg(F.when(active, F.col("premium_chf"))).cast(MONEY).alias("avg_premium_chf"),
        F.count_if(F.col("coverage_start_date") >= since).alias("new_policies_last_30d"),
        F.count_if(cancelled).alias("cancelled_last_30d"),
    )
    sold = policies.select("product_id").distinct()
    known = products.select("product_id").join(sold, "product_id", "left_semi")
    products_sold = known.agg(F.count("product_id").alias("active_products"))
    return side_by_side(figures, products_sold).select(
        today.alias("report_date"), "total_partners", "active_policies",
        "total_portfolio_premium_chf", "avg_premium_chf", "active_products",
        "new_policies_last_30d", "cancelled_last_30d",
    )


def partner_decrypted(partners: DataFrame, keys: DataFrame) -> DataFrame:
    """Readable personal fields of the partners not deleted; shredded ones turn NULL."""
    joined = join_keys(partners.filter(~F.col("deleted")), keys, "partner_id", unique=True)

    def plain(column: str) -> Column:
        return F.when(F.col("encrypted"), decrypt(F.col(column))).otherwise(F.col(column))

    clear = joined.select(
        "partner_id",
        plain("family_name").alias("family_name"),
        plain("first_name").alias("first_name"),
        plain("social_security_number").alias("social_security_number"),
        "insured_number",
        plain("date_of_birth").cast("date").alias("date_of_birth"),
        "gender", "partner_status", "updated_at",
    )
    return clear.select(
        "partner_id", "family_name", "first_name",
        full_name("first_name", "family_name").alias("full_name"),
        "social_security_number", "insured_number", "date_of_birth", "gender",
        "partner_status", "updated_at",
    )
