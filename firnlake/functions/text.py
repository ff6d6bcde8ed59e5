"""Text and identifier expressions; each takes column names or Columns and returns a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(column: ColumnOrName) -> Column:
    return F.col(column) if isinstance(column, str) else column


def is_set(column: ColumnOrName) -> Column:
    """Neither NULL nor the empty string (never NULL itself)."""
    return F.coalesce(_c(column) != "", F.lit(False))


def is_blank(column: ColumnOrName) -> Column:
    """NULL, empty or whitespace only (never NULL itself)."""
    return F.coalesce(F.trim(_c(column)) == "", F.lit(True))


def full_name(first: ColumnOrName, last: ColumnOrName) -> Column:
    """First and last name with one blank between; missing parts leave no blanks."""
    empty = F.lit("")
    return F.trim(F.concat(F.coalesce(_c(first), empty), F.lit(" "), F.coalesce(_c(last), empty)))


def contains_ignore_case(column: ColumnOrName, needle: str) -> Column:
    """Case-insensitive substring test; the needle is taken literally."""
    return F.lower(_c(column)).contains(needle.lower())


# --- social security number: 13 digits, prefix 756, EAN-13 check digit -------------------


def ssn_digits(column: ColumnOrName) -> Column:
    return F.regexp_replace(_c(column), "[^0-9]", "")


def ean13_check_digit(digits: ColumnOrName) -> Column:
    """Check digit of the first 12 digits: weights 1 and 3 in turn."""
    d = _c(digits)
    total = F.lit(0)
    for i in range(12):
        total = total + F.substring(d, i + 1, 1).try_cast("int") * (1 if i % 2 == 0 else 3)
    return F.pmod(F.lit(10) - total % 10, F.lit(10))


def ssn_is_valid(column: ColumnOrName) -> Column:
    """Thirteen digits after stripping, prefix 756 and a right check digit."""
    d = ssn_digits(column)
    last = F.substring(d, 13, 1).try_cast("int")
    return F.coalesce(
        (F.length(d) == 13) & d.startswith("756") & (ean13_check_digit(d) == last), F.lit(False)
    )


def ssn_formatted(column: ColumnOrName) -> Column:
    """``756.XXXX.XXXX.XX``"""
    d = ssn_digits(column)
    return F.concat_ws(
        ".", F.substring(d, 1, 3), F.substring(d, 4, 4), F.substring(d, 8, 4), F.substring(d, 12, 2)
    )


def ssn_masked(column: ColumnOrName) -> Column:
    """``756.****.****.NN``; values shorter than the dotted form stay as they are."""
    c = _c(column)
    return F.when(F.length(c) < 16, c).otherwise(
        F.concat(F.substring(c, 1, 4), F.lit("****.****."), F.substr(c, F.lit(15)))
    )


# --- insured number ----------------------------------------------------------------------

INSURED_NUMBER = r"^VN-\d{8}$"  # fixed format


def insured_number(sequence: ColumnOrName) -> Column:
    """``VN-`` and the sequence value with eight digits."""
    return F.format_string("VN-%08d", _c(sequence).cast("bigint"))


def insured_number_is_valid(column: ColumnOrName) -> Column:
    return F.coalesce(_c(column).rlike(INSURED_NUMBER), F.lit(False))


# --- others ------------------------------------------------------------------------------


def swiss_date(column: ColumnOrName) -> Column:
    """``dd.MM.yyyy``"""
    return F.date_format(_c(column), "dd.MM.yyyy")


def name_uuid(name: ColumnOrName) -> Column:
    """Name-based UUID (version 3): md5 of the UTF-8 bytes with version and variant set."""
    h = F.md5(_c(name).cast("binary"))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3),
        F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def starts_with_any(column: ColumnOrName, prefixes: list[str]) -> Column:
    """Prefix membership for prefixes of one common length."""
    width = len(prefixes[0])
    return F.coalesce(F.substring(_c(column), 1, width).isin(prefixes), F.lit(False))


def mapped(column: ColumnOrName, mapping: dict[str, object]) -> Column:
    """Code to code; codes not listed give NULL."""
    c = _c(column)
    out = None
    for code, value in mapping.items():
        out = F.when(c == code, value) if out is None else out.when(c == code, value)
    return out
