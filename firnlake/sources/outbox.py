"""Outbox: rows of event columns to JSON messages, and messages to topic folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnlake.contracts import CONTRACTS


def payload(topic: str, columns: dict[str, str]) -> Column:
    """The message text: contract fields in order, read from lower-cased columns.

    Fields whose value is NULL are left out, as thin events do.
    """
    fields = [f for f in CONTRACTS[topic].fields if f.lower() in columns]
    return F.to_json(F.struct(*[F.col(columns[f.lower()]).alias(f) for f in fields]))


def to_messages(events: DataFrame, topics: str | dict[str, str]) -> DataFrame:
    """Raw-shaped event rows as messages.

    ``topics`` is one topic for all rows, or event type → topic; rows of other types are
    left out.  All topics come from one pass over the events.
    """
    columns = {c.lower(): c for c in events.columns}
    kind = F.col("eventtype") if "eventtype" in columns else F.lit(None).cast("string")

    def key(topic: str) -> Column:
        return F.col(columns[CONTRACTS[topic].key.lower()])

    if isinstance(topics, str):
        topic, message_key, value = F.lit(topics), key(topics), payload(topics, columns)
    else:
        events = events.filter(F.col("eventtype").isin(*topics))
        topic, message_key, value = F.lit(None), F.lit(None), F.lit(None)
        for event_type, name in topics.items():
            match = kind == event_type
            topic = F.when(match, name).otherwise(topic)
            message_key = F.when(match, key(name)).otherwise(message_key)
            value = F.when(match, payload(name, columns)).otherwise(value)
    return events.select(
        topic.alias("topic"),
        message_key.alias("key"),
        value.alias("value"),
        kind.alias("event_type"),
        F.col("timestamp").cast("timestamp").alias("created_at"),
    )


def to_outbox(messages: DataFrame, aggregate_type: str) -> DataFrame:
    """Messages as outbox rows."""
    return messages.select(
        F.sha2(F.concat_ws("|", "topic", "key", "value"), 256).alias("id"),
        F.lit(aggregate_type).alias("aggregate_type"),
        F.col("key").alias("aggregate_id"),
        "event_type",
        "topic",
        F.col("value").alias("payload"),
        "created_at",
    )


def from_outbox(outbox: DataFrame) -> DataFrame:
    """Routing: key is the aggregate id, the event type travels beside the payload."""
    return outbox.select(
        "topic", F.col("aggregate_id").alias("key"), F.col("payload").alias("value"),
        "event_type", "created_at",
    )


def fan_out(mutations: DataFrame, delta: Column, state: Column) -> DataFrame:
    """Two events per mutation: the delta and the full state.

    ``delta`` and ``state`` are structs of one and the same shape.
    """
    return mutations.select(F.explode(F.array(delta, state)).alias("e")).select("e.*")


# Texts repeat their field names and neighbours are alike: the more of them share a page, the better they pack.
PACKED = {"compression": "zstd", "parquet.page.size": str(8 << 20), "parquet.page.row.count.limit": "100000"}


def write_topics(messages: DataFrame, path: str) -> None:
    """Append messages to one folder per topic."""
    messages.write.mode("append").partitionBy("topic").options(**PACKED).parquet(path)
