"""Structured Streaming: event messages to bronze, dead letters, and live aggregates.

A stream only appends to a bronze log, routed by partition watermarks. The log
lies by batch and day. Live aggregates are rebuilt, for the days that a batch
touches, from those days of the log; so a bucket that comes in several batches,
or again after a restart, has the same value as the nightly model's, and what a
trigger reads does not grow with the history.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from finlake import schemas
from finlake.functions.columns import with_cancellation_keys, with_rate_keys, with_transaction_keys
from finlake.operators.dedup import POSITION, latest
from finlake.operators.keyed import exists
from finlake.operators.routing import dead_letters, route
from finlake.plans import gold
from finlake.plans.silver import cancellations_clean, newest, transactions_clean

Dimensions = Callable[[], tuple[DataFrame, DataFrame, DataFrame]]


def kafka(spark: SparkSession, servers: str, topic: str, at_most: int = 10_000, start: str = "earliest") -> DataFrame:
    """Messages as value, source_ts, source_offset. Needs the Kafka connector on the class path. ``start``: earliest, latest or offsets as JSON, where there is no checkpoint."""
    stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", start)
    raw = stream.option("maxOffsetsPerTrigger", at_most).option("failOnDataLoss", "false").load()
    return raw.select(F.col("value").cast("string").alias("value"), F.col("timestamp").cast("timestamp_ntz").alias("source_ts"), F.col("offset").alias("source_offset"))


def lines(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """The same from a folder of text files; rows have no offset."""
    raw = spark.readStream.option("maxFilesPerTrigger", files).text(path)
    return raw.select("value", F.lit(None).cast("timestamp_ntz").alias("source_ts"), F.lit(None).cast("long").alias("source_offset"))


def topic_dump(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """The same from a folder of JSON lines with value, timestamp and offset, as a topic is dumped to files."""
    raw = spark.readStream.schema("value string, timestamp timestamp_ntz, offset long").option("maxFilesPerTrigger", files).json(path)
    return raw.select("value", F.col("timestamp").alias("source_ts"), F.col("offset").alias("source_offset"))


def parsed(messages: DataFrame) -> DataFrame:
    """Columns of all kinds; bad JSON gives nulls, and no kind."""
    return messages.select(F.from_json("value", schemas.STREAM_EVENT).alias("e"), "source_ts", "source_offset").select("e.*", "source_ts", "source_offset")


def of_kind(events: DataFrame, kind: str) -> DataFrame:
    return events.where(F.col("_source") == kind).select(*schemas.columns(schemas.KINDS[kind]), "source_ts", POSITION)


@dataclass(frozen=True)
class Folders:
    root: str

    def bronze(self, table: str) -> str:
        return f"{self.root}/bronze/{table}"

    @property
    def dead(self) -> str:
        return f"{self.root}/bronze_dlq/late_events"

    @property
    def offsets(self) -> str:
        return f"{self.root}/bronze/offsets"

    def checkpoint(self, name: str) -> str:
        return f"{self.root}/checkpoints/{name}"


def _prepared(rows: DataFrame, kind: str, now: F.Column) -> tuple[DataFrame, str, str, str | None]:
    """(rows, table, key, day that a watermark can close)."""
    at = F.coalesce("source_ts", now)
    if kind == "transaction":
        return with_transaction_keys(rows, at).drop("source_ts"), "transactions", "composite_pk", "event_day"
    if kind == "cancellation":
        return with_cancellation_keys(rows, at, F.to_date(at)).drop("source_ts"), "cancellations", "cancellation_pk", "ingestion_day"
    return with_rate_keys(rows, at).drop("source_ts"), "exchange_rates", "rate_pk", None


def ingest_batch(batch: DataFrame, batch_id: int, folders: Folders, closed: Callable[[str], datetime.date | None], now: F.Column, mark: Callable[[int, int], None] | None = None) -> None:
    """Routes one micro-batch. Files are named by the batch, so running it again replaces what it wrote. ``mark`` gets the batch and its largest offset, if any."""
    batch = batch.persist()
    try:
        for kind in schemas.KINDS:
            rows, table, key, day = _prepared(of_kind(batch, kind), kind, now)
            on_time, late = route(rows, day, closed(table)) if day else (rows, None)  # rates are idempotent by key and exempt
            # The rows of a day are brought together: files follow from their size, not from days times tasks.
            on_time.withColumn("log_day", F.expr(LOG_DAYS[table])).hint("rebalance", F.col("log_day")).write.mode("overwrite").partitionBy("log_day").parquet(f"{folders.bronze(table)}/batch={batch_id}")
            if late is not None:
                dead_letters(late, table, key, day).write.mode("overwrite").parquet(f"{folders.dead}/batch={batch_id}/table={table}")
        last = batch.agg(F.max("source_offset").alias("offset"), F.count("*").alias("rows"))
        last.write.mode("overwrite").parquet(f"{folders.offsets}/batch={batch_id}")
        if mark and (offset := last.first()["offset"]) is not None:
            mark(batch_id, offset)
    finally:
        batch.unpersist()


def ingest(messages: DataFrame, folders: Folders, closed: Callable[[str], datetime.date | None], now: F.Column, trigger: dict, mark: Callable[[int, int], None] | None = None) -> StreamingQuery:
    writer = parsed(messages).writeStream.foreachBatch(lambda batch, n: ingest_batch(batch, n, folders, closed, now, mark))
    return writer.option("checkpointLocation", folders.checkpoint("ingest")).trigger(**trigger).start()


#: The day that a row of the log is filed under: that of the aggregates it goes into.
LOG_DAYS = {"transactions": "event_day", "cancellations": "event_day", "exchange_rates": "'all'"}
_LOGS = {
    "transactions": f"{schemas.TRANSACTIONS}, event_day string, composite_pk string, ingested_at timestamp_ntz",
    "cancellations": f"{schemas.CANCELLATIONS}, cancelled_ts timestamp_ntz, ingestion_day date, event_day string, ingested_at timestamp_ntz, cancellation_pk string",
    "exchange_rates": f"{schemas.RATES}, rate_pk string, ingested_at timestamp_ntz",
}
LOG_SCHEMAS = {table: f"{schema}, {POSITION} long, batch long, log_day string" for table, schema in _LOGS.items()}


def log(spark: SparkSession, folders: Folders, table: str, days: Iterable[str | None] | None = None) -> DataFrame:
    """The log, or the files of some of its days."""
    rows = spark.read.schema(LOG_SCHEMAS[table]).parquet(folders.bronze(table))
    if days is None:
        return rows
    known = [d for d in days if d is not None]
    wanted = F.col("log_day").isin(*known)
    return rows.where(wanted if len(known) == len(list(days)) else wanted | F.col("log_day").isNull())


def bronze(spark: SparkSession, folders: Folders, table: str, key: str, days: Iterable[str | None] | None = None) -> DataFrame:
    """The log, or some of its days, as a table: the newest row of each key (every key has one day)."""
    return latest(log(spark, folders, table, days).drop("batch", "log_day"), [key], newest())


def last_batch(spark: SparkSession, folders: Folders, table: str) -> int:
    """The newest batch of the log, -1 without one: where a stream that wants new rows only begins."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folders.bronze(table)}/batch=*")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    return max((int(x.getPath().getName().partition("=")[2]) for x in found), default=-1)


def changes(spark: SparkSession, folders: Folders, table: str, after: int = -1) -> DataFrame:
    """The log as a stream of new rows, from the batch after ``after`` on; the checkpoint holds the position."""
    rows = spark.readStream.schema(LOG_SCHEMAS[table]).parquet(folders.bronze(table))
    return rows.where(F.col("batch") > after) if after >= 0 else rows


def days_of(batch: DataFrame, day: str) -> list[str | None]:
    """The days that a micro-batch touches."""
    return [r[0] for r in batch.select(day).distinct().collect()]


def live(spark: SparkSession, folders: Folders, dimensions: Dimensions, upsert: Callable[[str, DataFrame], None], closed: Callable[[str], datetime.date | None], trigger: dict) -> list[StreamingQuery]:
    """Three queries that keep the live aggregates; ``upsert`` gets a table name and its rows, keyed by pk."""

    def of_transactions(batch: DataFrame, _: int) -> None:
        batch, _late = route(batch, "event_day", closed("transactions"))
        if batch.isEmpty():
            return
        rows = bronze(spark, folders, "transactions", "composite_pk", days_of(batch, "event_day"))
        tx = transactions_clean(rows, *dimensions()).persist()
        try:
            upsert("transactions_by_hour", gold.transactions_by_hour(tx))
            upsert("purchases_by_hour", gold.purchases_by_hour(tx))
        finally:
            tx.unpersist()

    def of_cancellations(batch: DataFrame, _: int) -> None:
        batch, _late = route(batch, "ingestion_day", closed("cancellations"))
        if not batch.isEmpty():
            rows = bronze(spark, folders, "cancellations", "cancellation_pk", days_of(batch, "event_day"))
            upsert("cancellations_summary", gold.cancellations_live(cancellations_clean(rows)))

    def of_rates(batch: DataFrame, _: int) -> None:
        upsert("exchange_rates_latest", batch)

    # The newest quote is kept in the stream's state, so a trigger reads its own quotes only.
    queries = {"transactions": (of_transactions, lambda df: df), "cancellations": (of_cancellations, lambda df: df), "exchange_rates": (of_rates, gold.rates_latest)}
    return [
        model(changes(spark, folders, table)).writeStream.outputMode("update").foreachBatch(handler).option("checkpointLocation", folders.checkpoint(f"live-{table}")).trigger(**trigger).start()
        for table, (handler, model) in queries.items()
        if exists(spark, folders.bronze(table))
    ]


def wait_for_any(spark: SparkSession, queries: list[StreamingQuery], timeout: float | None = None) -> bool:
    """Waits until any query of the session ends, then stops the others; a query that failed raises. False after ``timeout`` seconds without an end."""
    ended = spark.streams.awaitAnyTermination() if timeout is None else spark.streams.awaitAnyTermination(timeout)
    if ended is False:
        return False
    for query in queries:
        query.stop()
    return True


def replay(messages: DataFrame, folders: Folders, dimensions: Dimensions, upsert: Callable[[str, DataFrame], None], closed: Callable[[str], datetime.date | None], now: F.Column, mark: Callable[[int, int], None] | None = None) -> None:
    """Runs both steps over what is there and ends."""
    ingest(messages, folders, closed, now, {"availableNow": True}, mark).awaitTermination()
    for query in live(messages.sparkSession, folders, dimensions, upsert, closed, {"availableNow": True}):
        query.awaitTermination()
