"""Starting streams: landing to raw tables, batch handlers, dead letters, duplicates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from firnlake.contracts import CONTRACTS, split_valid, with_reason
from firnlake.session import release_shuffles
from firnlake.sources.lake import exists, filesystem
from firnlake.sources.outbox import PACKED
from firnlake.sources.topics import MESSAGE, parse

COMMIT_INTERVAL = "10 seconds"  # fixed: how often landed rows become visible
CONDENSE_EVERY = 200  # batches between two bases of a log
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
# neighbouring keys have like rows, so larger blocks pack better than RocksDB's 4 KB
STATE_PACKED = {
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd", "spark.sql.streaming.stateStore.rocksdb.blockSizeKB": "16",
}
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

REJECT = "topic string, key string, value string, created_at timestamp, reason string"

BatchHandler = Callable[[DataFrame, int], None]


def _triggered(writer, once: bool, interval: str):
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)


def land_topic(
    messages: DataFrame, topic: str, raw_path: str, checkpoint: str, *, once: bool = False,
    interval: str = COMMIT_INTERVAL,
) -> StreamingQuery:
    """One query per topic: parsed rows appended to ``raw_path``/``topic``, by event date.

    Messages that break the topic's contract are left to :func:`land_rejects`.
    """
    contract = CONTRACTS[topic]
    good, _ = split_valid(messages.filter(F.col("topic") == topic), contract)
    rows = _few_files(parse(good, contract), "event_date")
    writer = (
        rows.writeStream.format("parquet")
        .queryName(f"land {topic} {checkpoint[-8:]}")
        .option("checkpointLocation", f"{checkpoint}/{topic}")
        .option("path", f"{raw_path}/{topic}")
        .partitionBy("event_date")
        .outputMode("append")
    )
    return _triggered(writer, once, interval).start()


def land_topics(
    messages: DataFrame, topics: Sequence[str], raw_path: str, checkpoint: str, **kwargs
) -> list[StreamingQuery]:
    return [land_topic(messages, t, raw_path, checkpoint, **kwargs) for t in topics]


def land_all(
    messages: DataFrame, raw_path: str, checkpoint: str, *, topics: Sequence[str] = tuple(CONTRACTS),
    unit: str = "day", once: bool = False, interval: str = COMMIT_INTERVAL,
) -> StreamingQuery:
    """All topics and their rejects landed by one query: a batch is read and checked once.

    The rows of a topic go to ``raw_path``/topic by event date and batch (read them with :func:`landed`),
    messages that break their contract, or belong to no topic, to ``raw_path``/_rejects by batch.  A batch
    that is delivered again replaces its own files.  ``unit`` month or year makes fewer folders when a
    batch holds a long history.
    """
    folder = "event_date" if unit == "day" else f"event_{unit}"
    spark = messages.sparkSession
    known = {t: CONTRACTS[t] for t in topics}

    def handle(batch: DataFrame, batch_id: int) -> None:
        # the checked texts of the batch, by the topic they land in; a topic then reads its own only
        aside = f"{checkpoint}/_checked/batch={batch_id}"
        bad = F.col("reason") != ""
        (
            with_reason(batch, known)
            .select(
                "value", F.when(bad, F.col("topic")).alias("topic"), F.when(bad, F.col("key")).alias("key"),
                F.when(bad, F.col("created_at")).alias("created_at"), "reason", F.when(~bad, F.col("topic")).alias("lands"),
            )
            .write.mode("overwrite").partitionBy("lands").options(**PACKED).parquet(aside)
        )
        checked = spark.read.schema(f"{REJECT}, lands string").parquet(aside)
        dead_letters(f"{raw_path}/_rejects", checked.filter("lands is null"), batch_id)

        def land(topic: str) -> None:
            good = checked.filter(F.col("lands") == topic).select("value", F.col("lands").alias("topic"))
            rows = parse(good, CONTRACTS[topic]).withColumn("batch", F.lit(batch_id).cast("bigint"))
            if unit == "day":
                rows = _few_files(rows, folder)
            else:
                # few folders: a task's rows of each are one file, nothing is moved
                rows = rows.withColumn(folder, F.date_trunc(unit, "event_date").cast("date"))
            (
                rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
                .partitionBy(folder, "batch").parquet(f"{raw_path}/{topic}")
            )
            delete(f"{aside}/lands={topic}")

        present = [t for t in topics if exists(spark, f"{aside}/lands={t}")]
        with ThreadPoolExecutor(TOPICS_AT_ONCE) as pool:
            list(pool.map(land, present))
        delete(aside)

    def delete(folder: str) -> None:
        fs, done = filesystem(spark, folder)
        fs.delete(done, True)

    release_shuffles(spark)
    return each_batch(messages, handle, f"{checkpoint}/_all", once=once, interval=interval)


TOPICS_AT_ONCE = 4  # most topics of a batch are small and would leave the cluster idle


def _few_files(rows: DataFrame, folder: str) -> DataFrame:
    """A day's rows of a batch in one file, not one from every task; AQE splits a hot day by its size."""
    return rows.hint("rebalance", F.col(folder))


def landed(spark: SparkSession, raw_path: str, topic: str) -> DataFrame:
    """The rows of a topic that :func:`land_all` has landed so far, whatever its unit."""
    empty = parse(spark.createDataFrame([], MESSAGE), CONTRACTS[topic])
    if not exists(spark, f"{raw_path}/{topic}"):
        return empty
    return spark.read.schema(empty.schema).parquet(f"{raw_path}/{topic}").select(*empty.columns)


def land_rejects(
    messages: DataFrame, path: str, checkpoint: str, *, once: bool = False, interval: str = COMMIT_INTERVAL
) -> StreamingQuery:
    """Dead letters of the landing: messages of all topics that break their contract, text kept."""
    bad = with_reason(messages).filter("reason != ''")
    writer = (
        bad.select("topic", "key", "value", "created_at", "reason").writeStream.format("parquet")
        .queryName(f"reject {checkpoint[-8:]}")
        .option("checkpointLocation", f"{checkpoint}/_rejects").option("path", path).outputMode("append")
    )
    return _triggered(writer, once, interval).start()


def each_batch(
    messages: DataFrame, handler: BatchHandler, checkpoint: str, *, once: bool = False,
    interval: str = COMMIT_INTERVAL, output: str = "append",
) -> StreamingQuery:
    """Run ``handler(batch, batch_id)`` per micro-batch; ``output`` update gives changed groups.

    A batch may be delivered again after a failure; handlers write to places named by the
    batch id, so that the second delivery replaces the first.
    """
    writer = messages.writeStream.foreachBatch(handler).outputMode(output).option("checkpointLocation", checkpoint)
    return _triggered(writer, once, interval).start()


def dead_letters(path: str, rejects: DataFrame, batch_id: int) -> None:
    """Rejected messages of a batch with their ``reason``."""
    rejects.select("topic", "key", "value", "created_at", "reason").write.mode("overwrite").parquet(
        f"{path}/batch={batch_id}"
    )


def _days(spark: SparkSession, path: str, days: Sequence[str], schema: str) -> DataFrame:
    """The rows stored for some days; folders of other days are not even listed."""
    stored = f"{schema}, event_date date, batch bigint"
    there = [f"{path}/event_date={d}" for d in days if exists(spark, f"{path}/event_date={d}")]
    if not there:
        return spark.createDataFrame([], stored)
    return spark.read.schema(stored).option("basePath", path).parquet(*there)


def keyed_state(spark: SparkSession) -> None:
    """State of streams on the executors' disks, unless the session names another store; packed, unless it says how."""
    if spark.conf.get(STATE_STORE, None) in (None, "", _MEMORY):
        spark.conf.set(STATE_STORE, ON_DISK)
    for key, value in STATE_PACKED.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


# Fixed value: Spark's own default, which holds all keys in memory.
_MEMORY = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"


def keep_rejects(
    messages: DataFrame, reason: Column, path: str, checkpoint: str, *, once: bool = False, interval: str = COMMIT_INTERVAL
) -> StreamingQuery:
    """Dead letters of a stream whose handler does not see single messages: those with a ``reason``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        dead_letters(path, batch.withColumn("reason", reason).filter("reason != ''"), batch_id)

    return each_batch(messages, handle, checkpoint, once=once, interval=interval)


def _identity(id_column: str, columns: Sequence[str]) -> Column:
    """The event's id; of an event without one, the hash of all it says."""
    said = F.to_json(F.struct(*[F.col(c) for c in columns]))
    return F.coalesce(F.concat(F.lit("id:"), F.col(id_column).cast("string")), F.concat(F.lit("said:"), F.sha2(said, 256)))


def without_repeats(
    events: DataFrame, id_column: str, time: str, path: str, *, once: bool = False, interval: str = COMMIT_INTERVAL
) -> StreamingQuery:
    """Each event id once, for at-least-once input, however late an event or its repeat comes.

    New events are kept below ``path`` by event date and batch (read them with :func:`passed_on`),
    and a batch is compared with the dates it touches only.  A repeat carries the time of its
    original.  An event without id is known by all its columns; of different events with one id in a batch
    the earliest stays, then the first by text.  A batch that is delivered again replaces its own rows.
    """
    spark = events.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    stored = f"{path}/passed"
    names = events.columns

    def handle(batch: DataFrame, batch_id: int) -> None:
        dated = batch.withColumn("event_date", F.col(time).cast("date")).persist()
        try:
            # at most one value per calendar day of the batch
            days = [r[0] for r in dated.select(F.coalesce(F.col("event_date").cast("string"), F.lit(NO_DATE))).distinct().collect()]
            seen = _days(spark, stored, days, schema).filter(F.col("batch") < batch_id)
            seen = seen.select(_identity(id_column, names).alias("_seen")).distinct()
            row = F.struct(*[F.col(c) for c in (*names, "event_date")])
            order = F.struct(F.col(time), F.to_json(row))
            single = dated.groupBy(_identity(id_column, names).alias("_event")).agg(F.min_by(row, order).alias("_row"))
            fresh = single.join(seen, F.col("_event") == F.col("_seen"), "left_anti").select("_row.*")
            (
                fresh.withColumn("batch", F.lit(batch_id).cast("bigint"))
                .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                .partitionBy("event_date", "batch").parquet(stored)
            )
        finally:
            dated.unpersist()

    return each_batch(events, handle, f"{path}/checkpoint", once=once, interval=interval)


NO_DATE = "__HIVE_DEFAULT_PARTITION__"  # fixed: the folder of rows without a date


def passed_on(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What :func:`without_repeats` has passed on so far."""
    if not exists(spark, f"{path}/passed"):
        return spark.createDataFrame([], schema)
    stored = StructType([*schema.fields]).add("event_date", "date").add("batch", "long")
    return spark.read.schema(stored).parquet(f"{path}/passed").select(*schema.names)


def finish(queries: Sequence[StreamingQuery], timeout: int | None = None) -> None:
    """Wait for run-once streams and raise what they raised."""
    for query in queries:
        query.awaitTermination(timeout) if timeout else query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()
