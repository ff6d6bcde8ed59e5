from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from firnlake.functions import text
from firnlake.operators import rules

RISK = "base_premium decimal(15,2), age int, postal_code string, coverage_types array<string>"


def priced(spark, age, postal, coverages, base="1000.00"):
    df = spark.createDataFrame([(Decimal(base), age, postal, coverages)], RISK)
    r = rules.price(df).first()
    return tuple(str(r[c]) for c in ("risk_surcharge", "coverage_surcharge", "discount", "total_premium"))


@pytest.mark.parametrize(
    "age, postal, coverages, expected",
    [
        (35, "6000", ["LIABILITY"], ("0.00", "0.00", "0.00", "1000.00")),
        (20, "6000", ["LIABILITY"], ("100.00", "0.00", "0.00", "1100.00")),
        (75, "6000", ["LIABILITY"], ("200.00", "0.00", "0.00", "1200.00")),
        (35, "8001", ["LIABILITY"], ("50.00", "0.00", "0.00", "1050.00")),
        (22, "8001", ["LIABILITY"], ("150.00", "0.00", "0.00", "1150.00")),
        (35, "6000", ["LIABILITY", "THEFT"], ("0.00", "30.00", "0.00", "1030.00")),
        (35, "6000", ["LIABILITY", "THEFT", "BUILDING"], ("0.00", "60.00", "50.00", "1010.00")),
        (25, "6000", None, ("0.00", "0.00", "0.00", "1000.00")),
        (70, "6000", [], ("0.00", "0.00", "0.00", "1000.00")),
    ],
)
def test_pricing(spark, age, postal, coverages, expected):
    assert priced(spark, age, postal, coverages) == expected


def test_pricing_rejects(spark):
    df = spark.createDataFrame(
        [(Decimal("1"), -1, "8001", None), (Decimal("1"), 151, "8001", None),
         (Decimal("1"), 30, "  ", None), (Decimal("1"), 30, None, None), (Decimal("1"), 30, "8001", None)],
        RISK,
    )
    assert rules.price(df).count() == 1
    reasons = sorted(r.reason for r in rules.rejected_risks(df).collect())
    assert reasons == ["invalid age", "invalid age", "postal code is blank", "postal code is blank"]


@pytest.mark.parametrize(
    "cycle, amount, label",
    [("ANNUAL", "1200.00", "Jahresprämie"), ("SEMI_ANNUAL", "600.00", "Halbjahresprämie"),
     ("QUARTERLY", "300.00", "Quartalsprämie"), ("MONTHLY", "100.00", "Monatsprämie")],
)
def test_instalments(spark, cycle, amount, label):
    df = spark.createDataFrame(
        [("p", "POL-1", Decimal("1200"), cycle)],
        "policy_id string, policy_number string, annual_premium_chf decimal(15,2), billing_cycle string",
    )
    r = rules.instalments(df, "2024-01-01").first()
    assert str(r.total_amount_chf) == amount
    assert r.due_date == date(2024, 1, 31)
    assert r.line_text == f"{label} POL-1"


def test_instalment_rounds_half_up(spark):
    df = spark.createDataFrame(
        [("p", "POL-1", Decimal("100.06"), "QUARTERLY")],
        "policy_id string, policy_number string, annual_premium_chf decimal(15,2), billing_cycle string",
    )
    assert str(rules.instalments(df, "2024-01-01").first().total_amount_chf) == "25.02"


def test_ssn(spark):
    df = spark.createDataFrame(
        [("756.9217.0769.85",), ("7569217076985",), ("756.9217.0769.84",), ("123.4567.8901.23",),
         ("756.1",), (None,), ("",)], "s string",
    )
    rows = df.select(text.ssn_is_valid("s").alias("v"), text.ssn_masked("s").alias("m"),
                     text.ssn_formatted("s").alias("f")).collect()
    assert [r.v for r in rows] == [True, True, False, False, False, False, False]
    assert rows[0].m == "756.****.****.85"
    assert rows[1].m == "7569217076985" and rows[1].f == "756.9217.0769.85"
    assert rows[5].m is None


def test_insured_number(spark):
    df = spark.createDataFrame([("VN-00000042",), ("VN-42",), ("xVN-00000042",), ("VN-000000421",), (None,)], "v string")
    assert [r[0] for r in df.select(text.insured_number_is_valid("v")).collect()] == [True, False, False, False, False]
    assert spark.range(42, 43).select(text.insured_number("id")).first()[0] == "VN-00000042"


def test_name_uuid_matches_rfc4122_version_3(spark):
    import hashlib
    import uuid

    for name in ("hr-employee:EMP-1", "E-1:7", "", "zürich"):
        raw = bytearray(hashlib.md5(name.encode()).digest())
        raw[6] = raw[6] & 0x0F | 0x30
        raw[8] = raw[8] & 0x3F | 0x80
        got = spark.range(1).select(text.name_uuid(F.lit(name))).first()[0]
        assert got == str(uuid.UUID(bytes=bytes(raw)))


def test_full_name(spark):
    df = spark.createDataFrame([("Hans", "Muster"), (None, "Muster"), ("Hans", None), (None, None)], "f string, l string")
    assert [r[0] for r in df.select(text.full_name("f", "l")).collect()] == ["Hans Muster", "Muster", "Hans", ""]


def test_address_rules(spark):
    schema = ("address_id string, partner_id string, address_type string, street string, house_number string, "
              "postal_code string, city string, country string, valid_from date, valid_to date")
    ok = ("a", "p", "RESIDENCE", "Weg", "1", "8001", "Zürich", None, date(2020, 1, 1), None)
    df = spark.createDataFrame([
        ok,
        (*ok[:5], "801", *ok[6:]),
        (*ok[:3], " ", *ok[4:9], date(2019, 1, 1)),
    ], schema)
    rows = df.select(rules.address_problems().alias("p"), rules.default_country().alias("c")).collect()
    assert [r.p for r in rows] == ["", "postal_code", "street,valid_to"]
    assert rows[0].c == "Schweiz"


def test_address_history(spark):
    df = spark.createDataFrame(
        [("a", "p", "RESIDENCE", date(2020, 1, 1), date(2020, 12, 31)),
         ("b", "p", "RESIDENCE", date(2021, 1, 1), None),
         ("c", "p", "DELIVERY", date(2030, 1, 1), None)],
        "address_id string, partner_id string, address_type string, valid_from date, valid_to date",
    )
    got = {r.address_id: r.validity for r in rules.address_history(df, "2024-01-01").collect()}
    assert got == {"a": "PAST", "b": "CURRENT", "c": "PRE_RECORDED"}
    only = rules.address_history(df, "2020-12-31", "RESIDENCE", current_only=True).collect()
    assert [r.address_id for r in only] == ["a"]
