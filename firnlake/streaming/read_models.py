"""Read models fed by topics: translation, log schema and the fold to current rows.

Translations mark messages they cannot use with a ``reason``.  Logs keep one row per
change; views fold them with map-side combining aggregates.  Of two changes to one key
the later message wins, ties are settled by the message text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firnlake.functions.text import full_name, is_blank, is_set
from firnlake.operators.latest import latest_per_key
from firnlake.operators.privacy import decrypt, join_keys
from firnlake.sources.lake import ChangeLog
from firnlake.streaming.run import CONDENSE_EVERY, dead_letters, each_batch

ORDER = ["created_at", "batch", "tie"]
_STAMP = "created_at timestamp, tie string"


def _json(schema: str) -> Column:
    return F.from_json("value", schema)


def _stamped(messages: DataFrame, schema: str) -> DataFrame:
    """Messages with their parsed body ``m`` and a text that settles ties."""
    return messages.withColumns({"m": _json(schema), "tie": F.md5("value")})


def _reason(*problems: tuple[Column, str]) -> Column:
    out = F.lit("")
    for condition, text in reversed(problems):
        out = F.when(condition, text).otherwise(out)
    return out


def compacted(messages: DataFrame) -> DataFrame:
    """State topic after compaction: newest message per key, tombstoned keys gone."""
    stamped = messages.withColumn("tie", F.md5("value"))
    latest = latest_per_key(stamped, "key", ["created_at", "tie"], ["topic", "value", "created_at"])
    gone = F.get_json_object("value", "$.deleted") == "true"
    return latest.filter(~F.coalesce(gone, F.lit(False)))


# --- partner view (policy side) --------------------------------------------------------------

PARTNER_LOG = f"partner_id string, name string, insured_number string, {_STAMP}"


def translate_partner(messages: DataFrame) -> DataFrame:
    """person.v1.created / updated → id, full name, insured number."""
    p = _stamped(messages, "personId string, firstName string, name string, insuredNumber string")
    name = full_name(p["m"]["firstName"], p["m"]["name"])
    return p.select(
        "topic", "key", "value", "created_at", "tie",
        p["m"]["personId"].alias("partner_id"), name.alias("name"),
        p["m"]["insuredNumber"].alias("insured_number"),
        _reason(
            (~is_set(p["m"]["personId"]), "personId is missing"), (name == "", "name is missing")
        ).alias("reason"),
    )


def partner_view(log: DataFrame) -> DataFrame:
    return latest_per_key(log, "partner_id", ORDER, ["name", "insured_number"])


# --- product view ----------------------------------------------------------------------------

PRODUCT_LOG = (
    "product_id string, name string, product_line string, base_premium decimal(15,2), "
    f"deactivates boolean, {_STAMP}"
)


def translate_product(messages: DataFrame) -> DataFrame:
    """product.v1.defined / updated upsert, deprecated deactivates."""
    p = _stamped(messages, "productId string, name string, productLine string, basePremium string")
    gone = F.col("topic") == "product.v1.deprecated"
    return p.select(
        "topic", "key", "value", "created_at", "tie",
        p["m"]["productId"].alias("product_id"), p["m"]["name"].alias("name"),
        F.coalesce(p["m"]["productLine"], F.lit("UNKNOWN")).alias("product_line"),
        F.coalesce(p["m"]["basePremium"].try_cast("decimal(15,2)"), F.lit(0)).cast("decimal(15,2)")
        .alias("base_premium"),
        gone.alias("deactivates"),
        _reason(
            (~is_set(p["m"]["productId"]), "productId is missing"),
            (~gone & p["m"]["name"].isNull(), "name is missing"),
            (p["m"]["basePremium"].isNotNull()
             & p["m"]["basePremium"].try_cast("decimal(15,2)").isNull(), "basePremium is not a number"),
        ).alias("reason"),
    )


def product_view(log: DataFrame) -> DataFrame:
    """Current products with ``active``; deactivating an unknown product changes nothing."""
    columns = ["name", "product_line", "base_premium"]
    upsert = F.when(~F.col("deactivates"), F.struct(*ORDER))
    off = F.when(F.col("deactivates"), F.struct(*ORDER))
    folded = log.groupBy("product_id").agg(
        F.max_by(F.struct(*columns), upsert).alias("row"),
        F.max(upsert).alias("on"), F.max(off).alias("off"),
    )
    return folded.filter(F.col("row").isNotNull()).select(
        "product_id", "row.*", F.coalesce(F.col("off") < F.col("on"), F.lit(True)).alias("active")
    )


# --- policyholder view (billing side) --------------------------------------------------------

POLICYHOLDER_LOG = PARTNER_LOG


def translate_policyholder(messages: DataFrame) -> DataFrame:
    """person.v1.state; deleted persons and messages without id are skipped, not rejected."""
    p = _stamped(
        messages,
        "personId string, firstName string, name string, insuredNumber string, deleted boolean",
    )
    name = full_name(p["m"]["firstName"], p["m"]["name"])
    return p.filter(
        ~is_blank(p["m"]["personId"]) & ~F.coalesce(p["m"]["deleted"], F.lit(False))
    ).select(
        "topic", "key", "value", "created_at", "tie",
        p["m"]["personId"].alias("partner_id"),
        F.coalesce(F.nullif(name, F.lit("")), p["m"]["personId"]).alias("name"),
        p["m"]["insuredNumber"].alias("insured_number"),
        F.lit("").alias("reason"),
    )


# --- partner search view (claims side) -------------------------------------------------------

SEARCH_LOG = (
    "partner_id string, last_name string, first_name string, date_of_birth date, "
    f"social_security_number string, insured_number string, deleted boolean, {_STAMP}"
)


def translate_search(messages: DataFrame, keys: DataFrame) -> DataFrame:
    """person.v1.state decrypted; tombstones delete; a field that cannot be read rejects its message."""
    p = _stamped(
        messages,
        "personId string, firstName string, name string, dateOfBirth string, "
        "socialSecurityNumber string, insuredNumber string, deleted boolean, encrypted boolean",
    ).select("topic", "key", "value", "created_at", "tie", "m.*")
    p = join_keys(p, keys, "personId")
    encrypted = F.coalesce("encrypted", F.lit(False))

    def plain(column: str) -> Column:
        return F.when(encrypted, decrypt(F.col(column))).otherwise(F.col(column))

    deleted = F.coalesce("deleted", F.lit(False))
    out = p.select(
        "topic", "key", "value", "created_at", "tie",
        F.col("personId").alias("partner_id"), plain("name").alias("last_name"),
        plain("firstName").alias("first_name"), plain("dateOfBirth").alias("birth"),
        plain("socialSecurityNumber").alias("social_security_number"),
        F.col("insuredNumber").alias("insured_number"), deleted.alias("deleted"),
        reduce(
            Column.__or__,
            [encrypted & F.coalesce(F.col(c).startswith("vault:"), F.lit(False)) & plain(c).isNull()
             for c in ("name", "firstName", "dateOfBirth", "socialSecurityNumber")],
        ).alias("sealed"),
    )
    nameless = is_blank("last_name") | is_blank("first_name")
    bad_birth = ~is_blank("birth") & F.col("birth").try_cast("date").isNull()
    return out.withColumns(
        {
            "date_of_birth": F.col("birth").try_cast("date"),
            "reason": _reason(
                (is_blank("partner_id"), "personId is missing"),
                (~F.col("deleted") & F.col("sealed"), "cannot decrypt"),
                (~F.col("deleted") & nameless, "name or firstName is missing"),
                (~F.col("deleted") & bad_birth, "dateOfBirth is not a date"),
            ),
        }
    ).drop("birth", "sealed")


def search_view(log: DataFrame) -> DataFrame:
    columns = ["last_name", "first_name", "date_of_birth", "social_security_number",
               "insured_number", "deleted"]
    return latest_per_key(log, "partner_id", ORDER, columns).filter(~F.col("deleted")).drop("deleted")


# --- policy snapshot (claims side) -----------------------------------------------------------

SNAPSHOT_LOG = (
    "policy_id string, policy_number string, partner_id string, product_id string, "
    f"coverage_start_date date, premium decimal(15,2), {_STAMP}"
)

_ISSUED = (
    "policyId string, policyNumber string, partnerId string, productId string, "
    "coverageStartDate string, premium string"
)


def translate_snapshot(messages: DataFrame) -> DataFrame:
    """policy.v1.issued; messages without one of four fields are skipped, broken values rejected."""
    p = _stamped(messages, _ISSUED)
    m = p["m"]
    premium, start = m["premium"].try_cast("decimal(15,2)"), m["coverageStartDate"].try_cast("date")
    return p.filter(
        m["policyId"].isNotNull() & m["partnerId"].isNotNull()
        & m["coverageStartDate"].isNotNull() & m["premium"].isNotNull()
    ).select(
        "topic", "key", "value", "created_at", "tie",
        m["policyId"].alias("policy_id"), m["policyNumber"].alias("policy_number"),
        m["partnerId"].alias("partner_id"), m["productId"].alias("product_id"),
        start.alias("coverage_start_date"), premium.alias("premium"),
        _reason(
            (start.isNull(), "coverageStartDate is not a date"),
            (premium.isNull(), "premium is not a number"),
        ).alias("reason"),
    )


def snapshot_view(log: DataFrame) -> DataFrame:
    columns = ["policy_number", "partner_id", "product_id", "coverage_start_date", "premium"]
    return latest_per_key(log, "policy_id", ORDER, columns)


# --- one way to run them ---------------------------------------------------------------------


@dataclass(frozen=True)
class ReadModel:
    """A read model: its topics, translation, log columns, fold and log key."""

    topics: tuple[str, ...]
    translate: Callable[[DataFrame], DataFrame]
    schema: str
    view: Callable[[DataFrame], DataFrame]
    key: tuple[str, ...]


PARTNER = ReadModel(
    ("person.v1.created", "person.v1.updated"), translate_partner, PARTNER_LOG, partner_view,
    ("partner_id",),
)
PRODUCT = ReadModel(
    ("product.v1.defined", "product.v1.updated", "product.v1.deprecated"),
    translate_product, PRODUCT_LOG, product_view, ("product_id", "deactivates"),
)
POLICYHOLDER = ReadModel(
    ("person.v1.state",), translate_policyholder, POLICYHOLDER_LOG, partner_view,
    ("partner_id",),
)
SNAPSHOT = ReadModel(
    ("policy.v1.issued",), translate_snapshot, SNAPSHOT_LOG, snapshot_view, ("policy_id",)
)


def search_model(keys: DataFrame) -> ReadModel:
    return ReadModel(
        ("person.v1.state",), lambda m: translate_search(m, keys), SEARCH_LOG, search_view,
        ("partner_id",),
    )




def maintain(
    messages: DataFrame, model: ReadModel, path: str, *, once: bool = False,
    condense_every: int = CONDENSE_EVERY,
):
    """Keep the read model's log and its dead letters below ``path`` up to date."""
    spark: SparkSession = messages.sparkSession
    log = ChangeLog(spark, f"{path}/log", model.schema)
    columns = T.StructType.fromDDL(model.schema).names

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch_id and batch_id % condense_every == 0:
            log.condense(batch_id, model.key, ORDER)
        translated = model.translate(batch).persist()
        try:
            log.append(translated.filter("reason = ''").select(*columns), batch_id)
            dead_letters(f"{path}/dead-letters", translated.filter("reason != ''"), batch_id)
        finally:
            translated.unpersist()

    wanted = messages.filter(F.col("topic").isin(*model.topics))
    return each_batch(wanted, handle, f"{path}/checkpoint", once=once)


def current(spark: SparkSession, model: ReadModel, path: str) -> DataFrame:
    """The read model's current rows."""
    return model.view(ChangeLog(spark, f"{path}/log", model.schema).read())


REJECT = "topic string, key string, value string, created_at timestamp, reason string"


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """All dead letters of a read model or reaction kept below ``path``."""
    return ChangeLog(spark, f"{path}/dead-letters", REJECT).read().drop("batch")
