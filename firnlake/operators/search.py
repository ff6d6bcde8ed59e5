"""Search, lookup and paging queries of the application screens."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnlake.functions.text import contains_ignore_case, ssn_digits

TOP = 20  # fixed: rows of a search result


def where_all(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """Filter by the conditions given; ``None`` stands for an argument left empty."""
    given = [c for c in conditions if c is not None]
    return df.filter(reduce(lambda a, b: a & b, given)) if given else df


def _given(text: str | None) -> bool:
    return text is not None and text.strip() != ""


def contains(column: str, text: str | None) -> Column | None:
    return contains_ignore_case(column, text) if _given(text) else None


def equals(column: str, value: object | None) -> Column | None:
    if value is None or (isinstance(value, str) and not _given(value)):
        return None
    return F.col(column) == value


def page(df: DataFrame, order: Sequence[Column | str], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 0).  The order should end in a unique column."""
    return df.orderBy(*order).offset(number * size).limit(size)


def page_after(df: DataFrame, column: str, last: object | None, size: int) -> DataFrame:
    """The next ``size`` rows after key ``last``; deep pages cost no more than the first."""
    rest = df if last is None else df.filter(F.col(column) > last)
    return rest.orderBy(column).limit(size)


def page_counts(df: DataFrame, size: int) -> DataFrame:
    """One row: total rows and number of pages."""
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("total_elements"), F.ceil(total / F.lit(size)).cast("int").alias("total_pages")
    )


def search_policies(
    policies: DataFrame, number: str | None = None, partner_id: str | None = None,
    status: str | None = None,
) -> DataFrame:
    return where_all(
        policies, contains("policy_number", number), equals("partner_id", partner_id),
        equals("policy_status", status),
    )


def search_persons(
    persons: DataFrame, name: str | None = None, first_name: str | None = None,
    ssn: str | None = None, birth_date: str | None = None,
) -> DataFrame:
    """Persons by name parts, social security number (any notation) and birth date."""
    number = "".join(ch for ch in ssn if ch.isdigit()) if _given(ssn) else None
    return where_all(
        persons, contains("family_name", name), contains("first_name", first_name),
        None if number is None else ssn_digits("social_security_number") == number,
        equals("date_of_birth", birth_date),
    )


def search_products(
    products: DataFrame, name: str | None = None, line: str | None = None
) -> DataFrame:
    return where_all(products, contains("product_name", name), equals("product_line", line))


def search_partner_view(view: DataFrame, query: str | None) -> DataFrame:
    """``VN-…`` finds the insured number, nothing lists the first names, else a substring."""
    if not _given(query):
        return view.orderBy("name", "partner_id").limit(TOP)
    if query.upper().startswith("VN-"):
        return view.filter(F.col("insured_number") == query.upper()).orderBy("partner_id").limit(1)
    return view.filter(contains_ignore_case("name", query)).orderBy("name", "partner_id").limit(TOP)


def search_by_name(view: DataFrame, query: str | None, size: int = TOP) -> DataFrame:
    """Substring of "last first" or "first last"; a blank query finds nothing.

    ``%`` and ``_`` in the query keep their pattern meaning, as on the search screen.
    """
    if not _given(query):
        return view.limit(0)
    pattern = f"%{query.strip()}%"
    last, first = F.col("last_name"), F.col("first_name")
    either = F.concat(last, F.lit(" "), first).ilike(pattern) | F.concat(
        first, F.lit(" "), last
    ).ilike(pattern)
    return view.filter(either).orderBy("last_name", "first_name", "partner_id").limit(size)


def find_by_insured_number(view: DataFrame, number: str | None) -> DataFrame:
    if not _given(number):
        return view.limit(0)
    return view.filter(F.col("insured_number") == number.strip().upper()).limit(1)


def find_by_ssn(view: DataFrame, ssn: str | None) -> DataFrame:
    if not _given(ssn):
        return view.limit(0)
    return view.filter(F.col("social_security_number") == ssn.strip()).limit(1)


def invoices_of(invoices: DataFrame, policyholders: DataFrame, partner: str) -> DataFrame:
    """Invoices of a partner id, or of the partner behind an insured number ``VN-…``."""
    if partner.upper().startswith("VN-"):
        owner = policyholders.filter(F.col("insured_number") == partner.upper()).select("partner_id")
        return invoices.join(owner, "partner_id", "left_semi")
    return invoices.filter(F.col("partner_id") == partner)


def claims_page(
    claims: DataFrame, number: int, size: int, status: str | None = None,
    filter_after_paging: bool = False,
) -> DataFrame:
    """Newest claims, optionally of one status.

    ``filter_after_paging`` filters the finished page, which may then come back short.
    """
    order = [F.col("opened_at").desc_nulls_last(), "claim_id"]
    wanted = equals("status", status)
    if filter_after_paging:
        return where_all(page(claims, order, number, size), wanted)
    return page(where_all(claims, wanted), order, number, size)
