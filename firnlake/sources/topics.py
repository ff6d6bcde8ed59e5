"""Topics: read messages, parse them by contract, union them into wide raw tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnlake.contracts import CONTRACTS, Contract

# A message as this package sees it, whatever carried it.
MESSAGE = "topic string, key string, value string, event_type string, created_at timestamp"


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """All messages stored below ``path`` (one folder per topic)."""
    return spark.read.schema(MESSAGE).parquet(path)


def stream_messages(
    spark: SparkSession,
    path: str,
    topics: Sequence[str] | None = None,
    files_per_trigger: int = 64,
    *,
    consume: bool = False,
) -> DataFrame:
    """The same folder as a stream from its first file on.

    ``consume`` deletes the files of the batches that are done, for a folder that one query alone reads.
    """
    reader = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_trigger)
    stream = (reader.option("cleanSource", "delete") if consume else reader).parquet(path)
    return stream if topics is None else stream.filter(F.col("topic").isin(*topics))


def stream_kafka(
    spark: SparkSession, servers: str, topics: Sequence[str], offsets_per_trigger: int = 1_000_000
) -> DataFrame:
    """Messages from Kafka, from the earliest offset (needs the Kafka package on the classpath)."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics))
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", offsets_per_trigger)
        .load()
        .select(
            "topic",
            F.col("key").cast("string").alias("key"),
            F.col("value").cast("string").alias("value"),
            F.lit(None).cast("string").alias("event_type"),
            F.col("timestamp").alias("created_at"),
        )
    )


def parse(messages: DataFrame, contract: Contract) -> DataFrame:
    """Raw rows of one topic: JSON fields as lower-cased columns, plus typed event time."""
    parsed = messages.filter(F.col("topic") == contract.topic).select(
        F.from_json("value", contract.schema).alias("m")
    )
    columns = [F.col("m")[f].alias(f.lower()) for f in contract.fields]
    event_at = F.col("m")["timestamp"].try_cast("timestamp")
    return parsed.select(
        *columns, event_at.alias("event_at"), event_at.cast("date").alias("event_date")
    )


def union_wide(parts: Iterable[DataFrame]) -> DataFrame:
    """Bag union by column name; a column some part lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def raw_table(messages: DataFrame, topics: Sequence[str]) -> DataFrame:
    """Several topics as one wide raw table, in one pass over the messages.

    All contracts are merged into one schema, so the text is parsed once instead of once
    per topic.  A field that is text in one topic and a number in another stays text.
    """
    kinds: dict[str, str] = {}
    for topic in topics:
        for f in CONTRACTS[topic].schema.fields:
            kind = f.dataType.simpleString()
            kinds[f.name] = kind if kinds.get(f.name, kind) == kind else "string"
    ddl = ", ".join(f"`{name}` {kind}" for name, kind in kinds.items())
    parsed = messages.filter(F.col("topic").isin(*topics)).select(F.from_json("value", ddl).alias("m"))
    event_at = F.col("m")["timestamp"].try_cast("timestamp")
    return parsed.select(
        *[F.col("m")[name].alias(name.lower()) for name in kinds],
        event_at.alias("event_at"),
        event_at.cast("date").alias("event_date"),
    )
