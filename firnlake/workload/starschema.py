"""Raw event tables derived from the star-schema test tables.

Each function reads the tables of one folder and projects them to the raw shape the
silver models expect: lower-cased JSON names, amounts and times as text.  Several events
of one entity come from a single scan by exploding an array of event structs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnlake.functions.text import ean13_check_digit, mapped, ssn_formatted
from firnlake.sources.lake import scan

MONEY = "decimal(15,2)"

_plans: dict[tuple[str, str, str], DataFrame] = {}


def forget_plans() -> None:
    """Called when a query starts: plans hold file listings, and files may have come since."""
    _plans.clear()


def planned(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Build the plan of a derived table once per query and folder (no data is kept)."""

    @wraps(fn)
    def reuse(spark: SparkSession, folder: str) -> DataFrame:
        slot = (spark.sparkContext.applicationId, folder, fn.__module__ + "." + fn.__qualname__)
        if slot not in _plans:
            _plans[slot] = fn(spark, folder)
        return _plans[slot]

    return reuse


# Enumerations of the event payloads.
COVERAGE_TYPES = ["LIABILITY", "COMPREHENSIVE", "GLASS_BREAKAGE", "NATURAL_HAZARD", "THEFT",
                  "BUILDING", "HOUSEHOLD_CONTENTS"]
ADDRESS_TYPES = ["RESIDENCE", "CORRESPONDENCE", "DELIVERY"]
CYCLES = ["ANNUAL", "SEMI_ANNUAL", "QUARTERLY", "MONTHLY"]
PRODUCT_LINES = {
    "STANDARD": "HOUSEHOLD_CONTENTS", "ECONOMY": "LIABILITY", "SMALL": "MOTOR_VEHICLE",
    "MEDIUM": "TRAVEL", "LARGE": "LEGAL_EXPENSES",
}
CLAIM_KINDS = {
    "signup": "ClaimOpened", "click": "ClaimOpened", "view": "ClaimUnderReview",
    "purchase": "ClaimSettled", "error": "ClaimRejected",
}
CLAIM_STATUS = {"signup": "OPEN", "click": "OPEN", "view": "IN_REVIEW", "purchase": "SETTLED",
                "error": "REJECTED"}


def iso(ts: Column, micros: bool = False) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss" + (".SSSSSS'Z'" if micros else "'Z'"))


def _text(value: object) -> Column:
    return F.lit(value).cast("string")


def _days(ts: Column, n: Column | int) -> Column:
    return ts + F.make_dt_interval(n if isinstance(n, Column) else F.lit(n))


def _seconds(ts: Column, n: Column | int) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return ts + F.make_dt_interval(secs=n.cast("decimal(18,6)"))


def _pick(index: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), index.cast("int") + 1)


def _explode(df: DataFrame, columns: dict[str, str], kinds: list[tuple[Column | None, dict]]) -> DataFrame:
    """One row per event kind whose condition holds; columns a kind does not set are NULL.

    A kind that does not apply is a NULL struct, which ``inline`` turns into a row of NULLs;
    the filter on the always present time drops it without leaving generated code.
    """
    # each value is computed once, in a projection below the explode; one that only a single
    # conditional kind uses is computed only where that kind applies
    uses: dict[int, int] = {}
    for _, values in kinds:
        for value in values.values():
            uses[id(value)] = uses.get(id(value), 0) + 1
    shared: dict[tuple[int, str], tuple[str, Column]] = {}
    structs = []
    for condition, values in kinds:
        parts = []
        for name, kind in columns.items():
            if name in values:
                value = values[name]
                slot = (id(value), kind)
                if slot not in shared:
                    typed = value.cast(kind)
                    if condition is not None and uses[id(value)] == 1:
                        typed = F.when(condition, typed)
                    shared[slot] = (f"_v{len(shared)}", typed)
                parts.append(f"{shared[slot][0]} AS {name}")
            else:
                parts.append(f"CAST(NULL AS {kind}) AS {name}")
        row = f"struct({', '.join(parts)})"
        if condition is not None:
            flag = f"_c{len(structs)}"
            shared[(id(condition), flag)] = (flag, condition)
            row = f"IF({flag}, {row}, NULL)"
        structs.append(row)
    prepared = df.select(*[value.alias(name) for name, value in shared.values()])
    return prepared.selectExpr(f"inline(array({', '.join(structs)}))").filter("timestamp IS NOT NULL")


def _day(text: str) -> Column:
    return F.lit(text).cast("timestamp")


# --- partner ---------------------------------------------------------------------------------

_ADDRESSES = (
    "array<struct<addressId:string,addressType:string,street:string,houseNumber:string,"
    "postalCode:string,city:string,land:string,validFrom:string,validTo:string>>"
)
PERSON = {
    "eventid": "string", "eventtype": "string", "personid": "string", "name": "string",
    "firstname": "string", "gender": "string", "dateofbirth": "string",
    "socialsecuritynumber": "string", "insurednumber": "string", "deleted": "boolean",
    "encrypted": "boolean", "addresses": _ADDRESSES, "timestamp": "string",
}


@planned
def persons(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer with the person attributes events are made of."""
    c = scan(spark, folder, "customer")
    k = F.col("c_custkey")
    holder = k - F.when(k % 400 == 1, 1).otherwise(0)  # a few numbers are held twice
    body = F.concat(F.lit("756"), F.lpad(holder.cast("string"), 9, "0"))
    wrong = F.when(k % 50 == 7, 1).otherwise(0)
    segment = F.col("c_mktsegment")
    return c.select(
        k,
        "c_nationkey",
        "c_acctbal",
        k.cast("string").alias("personid"),
        F.col("c_name").alias("name"),
        F.concat(F.upper(F.substring(segment, 1, 1)), F.lower(F.substr(segment, F.lit(2)))).alias("firstname"),
        F.when(k % 2 == 0, "FEMALE").otherwise("MALE").alias("gender"),
        F.date_add(F.lit("1935-01-01").cast("date"), ((k * 37) % 25000).cast("int"))
        .cast("string").alias("dateofbirth"),
        ssn_formatted(
            F.concat(body, ((ean13_check_digit(body) + wrong) % 10).cast("string"))
        ).alias("ssn"),
        _days(_day("1994-01-01"), (k % 300).cast("int")).alias("born"),
    )


@planned
def person_events(spark: SparkSession, folder: str) -> DataFrame:
    people = persons(spark, folder)
    first_order = scan(spark, folder, "orders").groupBy("o_custkey").agg(
        F.min(F.col("o_orderdate").cast("timestamp")).alias("ordered")
    )
    nations = scan(spark, folder, "nation").select("n_nationkey", "n_name")
    df = people.join(first_order, F.col("c_custkey") == F.col("o_custkey"), "left").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    k = F.col("c_custkey")
    df = df.withColumn("first_order", F.when(k % 23 != 0, F.col("ordered")))
    addresses = F.transform(
        F.sequence(F.lit(0), (k % 3).cast("int")),
        lambda i: F.struct(
            F.concat_ws("-", F.lit("A"), k.cast("string"), i.cast("string")).alias("addressId"),
            _pick(i, ADDRESS_TYPES).alias("addressType"),
            F.concat(F.lit("Street "), (k % 89).cast("string")).alias("street"),
            (k % 200 + 1).cast("string").alias("houseNumber"),
            (F.lit(1000) + (k * 13 + i * 7) % 9000).cast("string").alias("postalCode"),
            F.col("n_name").alias("city"),
            F.lit("Schweiz").alias("land"),
            F.date_add(F.lit("1994-01-01").cast("date"), i * 365).cast("string").alias("validFrom"),
            F.when(i == 1, "1999-12-31").alias("validTo"),
        ),
    )
    base = {
        "personid": F.col("personid"), "name": F.col("name"), "firstname": F.col("firstname"),
        "dateofbirth": F.col("dateofbirth"), "socialsecuritynumber": F.col("ssn"),
    }
    number = F.concat(F.lit("VN-"), F.lpad(k.cast("string"), 8, "0"))
    state = {
        **base, "eventtype": F.lit("PersonState"), "gender": F.col("gender"),
        "deleted": F.lit(False), "encrypted": F.lit(False), "addresses": addresses,
    }
    gone = F.col("c_acctbal") < -500
    return _explode(df, PERSON, [
        (None, {**base, "eventid": F.concat(F.lit("PC-"), F.col("personid")),
                "eventtype": F.lit("PersonCreated"), "timestamp": iso(F.col("born"))}),
        (None, {**state, "timestamp": iso(F.col("born"))}),
        (F.col("first_order").isNotNull(),
         {**state, "insurednumber": number, "timestamp": iso(_days(F.col("first_order"), 1))}),
        (F.col("first_order").isNotNull(),
         {"personid": F.col("personid"), "eventid": F.concat(F.lit("PU-"), F.col("personid")),
          "eventtype": F.lit("PersonUpdated"),
          "name": F.when(k % 40 != 9, F.col("name")), "firstname": F.when(k % 40 != 9, F.col("firstname")),
          "insurednumber": number, "timestamp": iso(_days(F.col("first_order"), 1))}),
        (gone, {"eventid": F.concat(F.lit("PD-"), F.col("personid")),
                "eventtype": F.lit("PersonDeleted"), "personid": F.col("personid"),
                "timestamp": iso(_day("2002-01-01"))}),
        (gone, {"eventtype": F.lit("PersonState"), "personid": F.col("personid"),
                "deleted": F.lit(True), "timestamp": iso(_day("2002-01-01"))}),
    ])


# --- product ---------------------------------------------------------------------------------

PRODUCT = {
    "eventid": "string", "eventtype": "string", "productid": "string", "name": "string",
    "productline": "string", "basepremium": MONEY, "status": "string", "deleted": "boolean",
    "timestamp": "string",
}


@planned
def product_events(spark: SparkSession, folder: str) -> DataFrame:
    p = scan(spark, folder, "part").withColumn(
        "t0", _days(_day("1993-01-01"), (F.col("p_partkey") % 200).cast("int"))
    ).withColumn("t1", _days(_day("2001-06-01"), (F.col("p_partkey") % 30).cast("int")))
    key = F.col("p_partkey").cast("string")
    full = {
        "productid": key, "name": F.col("p_name"),
        "productline": mapped("p_type", PRODUCT_LINES),
        "basepremium": F.col("p_retailprice").cast(MONEY),
    }
    size = F.col("p_size")

    def eid(prefix: str) -> Column:
        return F.concat(F.lit(prefix), key)

    return _explode(p, PRODUCT, [
        (None, {**full, "eventid": eid("D-"), "eventtype": F.lit("ProductDefined"),
                "timestamp": iso(F.col("t0"))}),
        (None, {**full, "eventtype": F.lit("ProductState"), "status": F.lit("ACTIVE"),
                "deleted": F.lit(False), "timestamp": iso(_seconds(F.col("t0"), 1))}),
        (None, {**full, "eventid": eid("U-"), "eventtype": F.lit("ProductUpdated"),
                "timestamp": iso(_days(F.col("t0"), 10))}),
        (size > 45, {"eventid": eid("X-"), "eventtype": F.lit("ProductDeprecated"),
                     "productid": key, "timestamp": iso(F.col("t1"))}),
        (size.between(46, 48), {**full, "eventtype": F.lit("ProductState"),
                                "status": F.lit("DEPRECATED"), "deleted": F.lit(False),
                                "timestamp": iso(_seconds(F.col("t1"), 1))}),
        (size == 50, {"eventtype": F.lit("ProductState"), "productid": key,
                      "deleted": F.lit(True), "timestamp": iso(_day("2001-12-01"))}),
    ])


# --- policy ----------------------------------------------------------------------------------

POLICY = {
    "eventid": "string", "eventtype": "string", "policyid": "string", "policynumber": "string",
    "partnerid": "string", "productid": "string", "coveragestartdate": "string",
    "premium": "string", "deductible": "string", "coverageid": "string",
    "coveragetype": "string", "insuredamount": "string", "timestamp": "string",
}


def policy_number(key: Column) -> Column:
    return F.concat_ws(
        "-", F.lit("POL"), (F.lit(1995) + key % 7).cast("string"),
        F.lpad((key % 10000).cast("string"), 4, "0"),
    )


@planned
def policy_lifecycle_events(spark: SparkSession, folder: str) -> DataFrame:
    o = scan(spark, folder, "orders")
    k = F.col("o_orderkey")
    key = k.cast("string")
    whole = F.floor("o_totalprice").cast("decimal(13,0)")
    cents = F.lit("0.01").cast("decimal(3,2)")
    premium = F.when(k % 501 == 0, F.lit(0)).otherwise((whole * cents).cast(MONEY)).cast(MONEY)
    ts = _seconds(F.col("o_orderdate").cast("timestamp"), (k % 86400).cast("int"))
    product = (
        F.when(k % 60 == 0, F.lit(None))
        .when(k % 97 == 0, F.concat(F.lit("X-"), key))
        .otherwise(F.col("o_custkey").cast("string"))
    )
    base = {"policyid": key, "policynumber": policy_number(k)}

    def eid(prefix: str) -> Column:
        return F.concat(F.lit(prefix), key)

    return _explode(o, POLICY, [
        (None, {**base, "eventid": eid("PI-"), "eventtype": F.lit("PolicyIssued"),
                "partnerid": F.col("o_custkey"), "productid": product,
                "coveragestartdate": F.date_add(F.col("o_orderdate").cast("date"), (k % 28).cast("int")),
                "premium": premium, "timestamp": iso(ts)}),
        (F.col("o_orderstatus") == "P",
         {**base, "eventid": eid("PC-"), "eventtype": F.lit("PolicyChanged"),
          "premium": (premium + whole * cents * cents * 10).cast(MONEY),
          "deductible": F.lit("500.00"), "timestamp": iso(_days(ts, 30))}),
        (F.col("o_orderstatus") == "F",
         {**base, "eventid": eid("PX-"), "eventtype": F.lit("PolicyCancelled"),
          "timestamp": iso(_days(ts, 90))}),
        ((F.col("o_orderstatus") == "F") & (k % 211 == 3),  # a change after the end
         {**base, "eventid": eid("PZ-"), "eventtype": F.lit("PolicyChanged"), "premium": premium,
          "deductible": F.lit("100.00"), "timestamp": iso(_days(ts, 120))}),
    ])


def line_key() -> Column:
    return F.concat_ws(
        "-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    )


@planned
def coverage_events(spark: SparkSession, folder: str) -> DataFrame:
    li = scan(spark, folder, "lineitem").withColumn("key", line_key())
    ts = F.col("l_shipdate").cast("timestamp")
    base = {"policyid": F.col("l_orderkey"), "coverageid": F.concat(F.lit("C-"), F.col("key"))}
    return _explode(li, POLICY, [
        (None, {**base, "eventid": F.concat(F.lit("CA-"), F.col("key")),
                "eventtype": F.lit("CoverageAdded"),
                "coveragetype": _pick(F.col("l_linenumber") % 7, COVERAGE_TYPES),
                "insuredamount": F.col("l_extendedprice").cast(MONEY), "timestamp": iso(ts)}),
        (F.col("l_returnflag") == "R",
         {**base, "eventid": F.concat(F.lit("CR-"), F.col("key")),
          "eventtype": F.lit("CoverageRemoved"), "timestamp": iso(_days(ts, 100))}),
    ])


@planned
def policy_events(spark: SparkSession, folder: str) -> DataFrame:
    return policy_lifecycle_events(spark, folder).unionByName(coverage_events(spark, folder))


# --- billing ---------------------------------------------------------------------------------

BILLING = {
    "eventid": "string", "eventtype": "string", "invoiceid": "string", "invoicenumber": "string",
    "policyid": "string", "policynumber": "string", "partnerid": "string",
    "billingcycle": "string", "totalamount": "string", "duedate": "string",
    "amountpaid": "string", "paidat": "string", "dunningcaseid": "string",
    "dunninglevel": "string", "claimid": "string", "settlementamount": "string",
    "timestamp": "string",
}


@planned
def invoice_events(spark: SparkSession, folder: str) -> DataFrame:
    li = scan(spark, folder, "lineitem").withColumn("key", line_key())
    ok, ln = F.col("l_orderkey"), F.col("l_linenumber")
    ts = F.col("l_shipdate").cast("timestamp")
    day = F.col("l_shipdate").cast("date")
    amount = F.col("l_extendedprice").cast(MONEY)
    base = {
        "invoiceid": F.concat_ws("-", F.lit("I"), ok.cast("string"), ln.cast("string")),
        "invoicenumber": F.concat_ws(
            "-", F.lit("BILL"), (F.lit(1995) + ok % 7).cast("string"),
            F.lpad(((ok * 10 + ln) % 100000).cast("string"), 5, "0"),
        ),
        "policyid": ok, "partnerid": F.col("l_suppkey"),
    }
    dunned = {
        **base, "eventtype": F.lit("DunningInitiated"), "totalamount": amount,
        "dunningcaseid": F.concat(F.lit("DC-"), base["invoiceid"]),
        "duedate": F.date_add(day, 30),
    }

    def eid(prefix: str) -> Column:
        return F.concat(F.lit(prefix), F.col("key"))

    flag = F.col("l_returnflag")
    return _explode(li, BILLING, [
        (None, {**base, "eventid": eid("B0-"), "eventtype": F.lit("InvoiceCreated"),
                "policynumber": policy_number(ok), "billingcycle": _pick(ln % 4, CYCLES),
                "totalamount": amount, "duedate": F.date_add(day, 30), "timestamp": iso(ts)}),
        (flag == "A", {**base, "eventid": eid("B1-"), "eventtype": F.lit("PaymentReceived"),
                       "amountpaid": amount, "paidat": F.date_add(day, 20),
                       "timestamp": iso(_days(ts, 20))}),
        (flag == "N", {**dunned, "eventid": eid("B2-"), "dunninglevel": F.lit("REMINDER"),
                       "timestamp": iso(_days(ts, 40))}),
        ((flag == "N") & (F.col("l_quantity") > 25),
         {**dunned, "eventid": eid("B3-"), "dunninglevel": F.lit("FIRST_WARNING"),
          "timestamp": iso(_days(ts, 60))}),
    ])


@planned
def payout_events(spark: SparkSession, folder: str) -> DataFrame:
    e = scan(spark, folder, "events").filter(F.col("event_type") == "purchase")
    claim = F.floor(F.col("event_id") / 4).cast("bigint")
    return _explode(e, BILLING, [
        (None, {"eventid": F.concat(F.lit("B4-"), F.col("event_id").cast("string")),
                "eventtype": F.lit("PayoutTriggered"),
                "claimid": F.concat(F.lit("CL-"), claim.cast("string")), "policyid": claim * 7,
                "partnerid": F.col("user_id"), "settlementamount": F.col("value").cast(MONEY),
                "timestamp": iso(_days(F.col("ts").cast("timestamp"), 1), micros=True)}),
    ])


@planned
def billing_events(spark: SparkSession, folder: str) -> DataFrame:
    return invoice_events(spark, folder).unionByName(payout_events(spark, folder))


# --- claims ----------------------------------------------------------------------------------


@planned
def claims_events(spark: SparkSession, folder: str) -> DataFrame:
    e = scan(spark, folder, "events")
    claim = F.floor(F.col("event_id") / 4).cast("bigint")
    kind = F.col("event_type")
    return e.select(
        F.lpad(F.col("event_id").cast("string"), 18, "0").alias("eventid"),
        mapped(kind, CLAIM_KINDS).alias("eventtype"),
        F.concat(F.lit("CL-"), claim.cast("string")).alias("claimid"),
        F.concat(F.lit("CLM-20240101-"), F.lpad((claim % 10000).cast("string"), 4, "0")).alias("claimnumber"),
        (claim * 7).cast("string").alias("policyid"),
        F.when(kind.isin("signup", "click"), F.col("props")).alias("description"),
        F.col("ts").cast("date").cast("string").alias("claimdate"),
        mapped(kind, CLAIM_STATUS).alias("status"),
        F.when(kind == "purchase", F.col("value").cast(MONEY)).alias("settlementamount"),
        iso(F.col("ts").cast("timestamp"), micros=True).alias("timestamp"),
    )


# --- HR --------------------------------------------------------------------------------------

EMPLOYEE = {
    "eventid": "string", "eventtype": "string", "employeeid": "string", "externalid": "string",
    "firstname": "string", "lastname": "string", "email": "string", "jobtitle": "string",
    "department": "string", "orgunitid": "string", "entrydate": "string", "exitdate": "string",
    "active": "boolean", "deleted": "boolean", "version": "bigint", "timestamp": "string",
}
ORG_UNIT = {
    "eventid": "string", "eventtype": "string", "orgunitid": "string", "externalid": "string",
    "name": "string", "parentorgunitid": "string", "manageremployeeid": "string",
    "level": "int", "active": "boolean", "deleted": "boolean", "version": "bigint",
    "timestamp": "string",
}


@planned
def employee_source(spark: SparkSession, folder: str) -> DataFrame:
    """The HR employee table the poll reads."""
    s = scan(spark, folder, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k,
        F.concat(F.lit("EMP-"), k.cast("string")).alias("employee_id"),
        F.when(k % 11 != 0, F.concat(F.lit("S"), (k % 7).cast("string"))).alias("first_name"),
        F.col("s_name").alias("last_name"),
        F.when(k % 13 == 0, F.lit("no address"))
        .otherwise(F.concat(F.lower(F.replace("s_name", F.lit("#"), F.lit("."))), F.lit("@example.org")))
        .alias("email"),
        F.lit("Clerk").alias("job_title"),
        F.concat(F.lit("D"), (k % 5).cast("string")).alias("department"),
        F.when(k % 97 == 5, F.lit("N-404"))
        .otherwise(F.concat(F.lit("N-"), F.col("s_nationkey").cast("string"))).alias("org_unit_id"),
        F.date_add(F.lit("2000-01-01").cast("date"), (k % 3000).cast("int")).alias("entry_date"),
        F.lit(None).cast("date").alias("exit_date"),
        (F.col("s_acctbal") > 0).alias("active"),
        F.when(k % 4 != 0, (k % 3 + 1).cast("bigint")).alias("version"),
        _days(_day("2010-01-01"), (k % 100).cast("int")).alias("last_modified"),
    )


@planned
def employee_events(spark: SparkSession, folder: str) -> DataFrame:
    s = employee_source(spark, folder)
    k, ts = F.col("s_suppkey"), F.col("last_modified")
    key = F.concat(F.lit("E-"), k.cast("string"))
    ids = {"employeeid": key, "externalid": F.col("employee_id")}
    state = {
        **ids, "firstname": F.col("first_name"), "lastname": F.col("last_name"),
        "email": F.col("email"), "jobtitle": F.col("job_title"), "department": F.col("department"),
        "orgunitid": F.col("org_unit_id"), "entrydate": F.col("entry_date"),
        "active": F.col("active"), "deleted": F.lit(False), "version": F.lit(1),
    }
    return _explode(s, EMPLOYEE, [
        (None, {**state, "timestamp": iso(ts)}),
        (k % 3 == 0, {**state, "department": F.lit("D9"), "version": F.lit(2), "timestamp": iso(ts)}),
        (k % 29 == 0, {**state, "deleted": F.lit(True), "version": F.lit(3),
                       "timestamp": iso(_days(ts, 10))}),
        (None, {**ids, "eventid": F.concat(F.lit("EU-"), key), "eventtype": F.lit("employee.updated"),
                "timestamp": iso(F.when(k % 10 == 3, _seconds(ts, 1)).otherwise(ts))}),
    ])


@planned
def org_units(spark: SparkSession, folder: str) -> DataFrame:
    """Regions and their nations as a two-level unit tree."""
    regions = scan(spark, folder, "region").select(
        F.concat(F.lit("R-"), F.col("r_regionkey").cast("string")).alias("org_unit_id"),
        F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_org_unit_id"),
        F.lit(1).alias("level"), F.lit(False).alias("deleted"),
    )
    nations = scan(spark, folder, "nation").select(
        F.concat(F.lit("N-"), F.col("n_nationkey").cast("string")).alias("org_unit_id"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("R-"), F.col("n_regionkey").cast("string")).alias("parent_org_unit_id"),
        F.lit(2).alias("level"), (F.col("n_nationkey") % 12 == 11).alias("deleted"),
    )
    return regions.unionByName(nations)


@planned
def org_unit_events(spark: SparkSession, folder: str) -> DataFrame:
    u = org_units(spark, folder)
    ts = iso(_day("2009-01-01"))
    ids = {"orgunitid": F.col("org_unit_id"), "externalid": F.col("org_unit_id"), "timestamp": ts}
    return _explode(u, ORG_UNIT, [
        (None, {**ids, "name": F.concat(F.col("name"), F.lit(" (old)")),
                "parentorgunitid": F.col("parent_org_unit_id"), "level": F.col("level"),
                "active": F.lit(True), "deleted": F.lit(False), "version": F.lit(1)}),
        (None, {**ids, "name": F.col("name"), "parentorgunitid": F.col("parent_org_unit_id"),
                "level": F.col("level"), "deleted": F.col("deleted"), "version": F.lit(2)}),
        (None, {**ids, "eventid": F.concat(F.lit("OU-"), F.col("org_unit_id")),
                "eventtype": F.lit("org-unit.updated")}),
    ])
