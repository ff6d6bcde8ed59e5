"""Personal data: per-person keys, field encryption, decryption, shredding, retention.

The key table (``partner_id``, ``key`` binary of 32 bytes) stands where a secret store
would.  One join brings the key to the row; everything after it is built-in AES-GCM.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator, Sequence
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnlake.operators.lookup import detached

PREFIX = "vault:v1:"  # fixed format of an encrypted field: prefix + base64(nonce, text, tag)

# Encrypted fields of a person event, and of each element of its addresses.
# Keys, the insured number, gender and validity dates stay readable.
PERSON_FIELDS = ["name", "firstname", "socialsecuritynumber", "dateofbirth"]
ADDRESS_FIELDS = ["street", "houseNumber", "postalCode", "city", "land"]

# Personal-data tags per column and per topic, and the retention in days.
COLUMN_TAGS = {
    "family_name": ["PII.Sensitive"],
    "first_name": ["PII.Sensitive"],
    "full_name": ["PII.Sensitive"],
    "social_security_number": ["PII.PersonIdentifier"],
    "date_of_birth": ["PII.Sensitive"],
}
TABLE_TAGS = {
    "partner_raw.person_events": ["PII.Sensitive", "PII.PersonIdentifier"],
    "analytics.dim_partner": ["PII.Sensitive", "PII.PersonIdentifier"],
}
TOPIC_TAGS = {
    "person.v1.created": ["PII.Sensitive", "PII.PersonIdentifier"],
    "person.v1.updated": ["PII.Sensitive"],
    "person.v1.state": ["PII.Sensitive", "PII.PersonIdentifier", "PII.Address"],
    "person.v1.address-added": ["PII.Address"],
}
RETENTION_DAYS = 2555

KEY = "_person_key"


def new_keys(partners: DataFrame) -> DataFrame:
    """A random AES-256 key for each distinct ``partner_id``.

    The keys differ on every evaluation: write the result once and read it back.
    """

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["key"] = [secrets.token_bytes(32) for _ in range(len(batch))]
            yield batch

    ids = partners.select("partner_id").filter(F.col("partner_id").isNotNull()).distinct()
    return ids.mapInPandas(draw, "partner_id string, key binary")


def join_keys(df: DataFrame, keys: DataFrame, person: str, *, unique: bool = False) -> DataFrame:
    """Left join of the key table; rows of shredded persons get a NULL key.

    Both sides are shuffled for the join, so that a person with many rows can be split, and rows without a
    person travel on a stand-in.  ``unique`` says that ``df`` has one row per person, so neither is needed.
    """
    if unique:
        right = keys.select(F.col("partner_id").alias("_key_owner"), F.col("key").alias(KEY))
        return df.join(right, F.col(person) == F.col("_key_owner"), "left").drop("_key_owner")
    right = keys.select(detached("partner_id").alias("_key_owner"), F.col("key").alias(KEY))
    said = [F.col(c) for c, kind in df.dtypes if "map<" not in kind]
    owner = F.coalesce(detached(person), F.concat(F.lit("~"), F.xxhash64(*said).cast("string")))
    return df.join(right, owner == F.col("_key_owner"), "left").drop("_key_owner")


def encrypt(value: Column, key: Column | str = KEY) -> Column:
    """Encrypted field; NULL and the empty string pass through.  A missing key gives NULL."""
    k = F.col(key) if isinstance(key, str) else key
    text = F.concat(F.lit(PREFIX), F.base64(F.aes_encrypt(value.cast("binary"), k, F.lit("GCM"))))
    return F.when(value == "", value).otherwise(text)


def decrypt(value: Column, key: Column | str = KEY) -> Column:
    """Plain field; text without the prefix passes through, any failure gives NULL."""
    k = F.col(key) if isinstance(key, str) else key
    body = F.try_to_binary(F.substr(value, F.lit(len(PREFIX) + 1)), F.lit("base64"))
    plain = F.try_aes_decrypt(body, k, F.lit("GCM")).cast("string")
    return F.when(~value.startswith("vault:"), value).otherwise(plain)


def register_sql_function(spark: SparkSession, name: str = "vault_decrypt") -> None:
    """``name(key, text)`` for SQL: the same decryption, NULL where it fails."""
    spark.sql(
        f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(person_key BINARY, secret STRING) RETURNS STRING
        RETURN CASE WHEN NOT startswith(secret, '{PREFIX[:6]}') THEN secret ELSE CAST(try_aes_decrypt(
            try_to_binary(substr(secret, {len(PREFIX) + 1}), 'base64'), person_key, 'GCM') AS STRING) END
        """
    )


def keyed_view(df: DataFrame, keys: DataFrame, person: str, view: str) -> None:
    """A temporary view of ``df`` with ``person_key``: one join, however many fields are decrypted."""
    join_keys(df, keys, person).withColumnRenamed(KEY, "person_key").createOrReplaceTempView(view)


def encrypt_person_events(
    events: DataFrame, keys: DataFrame, fields: Sequence[str] = PERSON_FIELDS
) -> DataFrame:
    """Person events with the personal fields, also those inside ``addresses``, encrypted."""
    out = join_keys(events, keys, "personid")
    replaced = {f: encrypt(F.col(f)) for f in fields if f in events.columns}
    if "addresses" in events.columns:
        parts = events.schema["addresses"].dataType.elementType.fieldNames()
        replaced["addresses"] = F.transform(
            "addresses",
            lambda a: F.struct(
                *[(encrypt(a[p]) if p in ADDRESS_FIELDS else a[p]).alias(p) for p in parts]
            ),
        )
    return out.withColumns({**replaced, "encrypted": F.lit(True)}).drop(KEY)


def decrypt_columns(
    df: DataFrame, keys: DataFrame, person: str, columns: Sequence[str]
) -> DataFrame:
    """The named columns decrypted where ``encrypted`` says so."""
    joined = join_keys(df, keys, person)
    return joined.withColumns(
        {
            c: F.when(F.col("encrypted"), decrypt(F.col(c))).otherwise(F.col(c))
            for c in columns
        }
    ).drop(KEY)


def split_undecryptable(
    df: DataFrame, keys: DataFrame, person: str, columns: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(readable rows decrypted, rejects): a field that cannot be read rejects its row."""
    joined = join_keys(df, keys, person)
    failed = F.lit(False)
    for c in columns:
        failed = failed | (
            F.coalesce(F.col("encrypted"), F.lit(False))
            & F.col(c).startswith("vault:")
            & decrypt(F.col(c)).isNull()
        )
    flagged = joined.withColumn("_failed", F.coalesce(failed, F.lit(False)))
    good = flagged.filter(~F.col("_failed")).withColumns(
        {c: F.when(F.col("encrypted"), decrypt(F.col(c))).otherwise(F.col(c)) for c in columns}
    )
    bad = flagged.filter("_failed").withColumn("reason", F.lit("cannot decrypt"))
    return good.drop(KEY, "_failed"), bad.drop(KEY, "_failed")


def shred(keys: DataFrame, erased: DataFrame) -> DataFrame:
    """The key table without the keys of ``erased`` (column ``partner_id``)."""
    return keys.join(erased.select("partner_id"), "partner_id", "left_anti")


def due_for_shredding(
    events: DataFrame, as_of: date | str, days: int = RETENTION_DAYS
) -> DataFrame:
    """Persons whose last event is older than the retention period."""
    limit = F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp")
    return (
        events.groupBy(F.col("personid").alias("partner_id"))
        .agg(F.max("event_at").alias("last_event_at"))
        .filter(F.col("last_event_at") < limit)
    )


def tag_columns(df: DataFrame) -> DataFrame:
    """Attach the personal-data tags to the columns as metadata."""
    for name, tags in COLUMN_TAGS.items():
        if name in df.columns:
            df = df.withMetadata(name, {"tags": tags})
    return df


def tagged(df: DataFrame) -> list[str]:
    """Columns carrying a personal-data tag."""
    return [f.name for f in df.schema.fields if f.metadata.get("tags")]


def masked(df: DataFrame) -> DataFrame:
    """Tagged columns replaced by ``***`` (NULL stays NULL)."""
    return df.withColumns(
        {c: F.when(F.col(c).isNotNull(), F.lit("***")) for c in tagged(df)}
    )
