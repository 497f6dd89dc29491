"""Partition watermarks: who owns a day, and what comes too late for it."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = r"^day=(\d{4}-\d{2}-\d{2})$"
LATE, NO_DAY, MALFORMED = "late_partition_owned_by_batch", "no_partition_day", "malformed_line"
NONPARTITIONED = "snapshot"


def watermark_rows(table: str, producer: str, partitions: DataFrame, rows: int | Column, committed_at: str) -> DataFrame:
    """Watermark rows for ``partitions`` (its first column); ``rows``: a number, or a column of ``partitions``."""
    part = F.col(partitions.columns[0]).cast("string")
    return partitions.select(
        F.concat_ws("|", F.lit(table), F.lit(producer), part).alias("watermark_id"), F.lit(table).alias("table_name"),
        part.alias("source_partition"), (rows if isinstance(rows, Column) else F.lit(rows)).cast("long").alias("rows_in_batch"), F.lit(committed_at).alias("committed_at"),
    )


def normalised_partitions(raw: DataFrame, column: str, prefix: str = "day", marker: str = NONPARTITIONED) -> DataFrame:
    """Distinct partition names: ``<anything>=value`` as ``prefix=value``, the empty name as ``marker``."""
    name = F.col(column)
    return raw.select(F.when(name == "", marker).when(name.contains("="), F.concat(F.lit(f"{prefix}="), F.substring_index(name, "=", -1))).otherwise(name).alias("partition")).distinct()


def high_watermark(marks: DataFrame, table: str) -> DataFrame:
    """One row: the latest day that batch has closed for ``table``, null if none."""
    day = F.regexp_extract("source_partition", DAY, 1)
    return marks.where((F.col("table_name") == table) & F.col("source_partition").like("day=%")).agg(F.max(F.when(day != "", day)).alias("high_day"))


def closed_day(marks: DataFrame, table: str) -> datetime.date | None:
    day = high_watermark(marks, table).first()["high_day"]
    return datetime.date.fromisoformat(day) if day else None


def route(df: DataFrame, day: str, closed: datetime.date | None) -> tuple[DataFrame, DataFrame]:
    """(on time, late). Days after ``closed`` are on time; without a watermark all are. A row without a day is late: it has no partition to go to."""
    if closed is None:
        return df, df.where(F.lit(False))
    after = F.try_to_date(F.col(day).cast("string")) > F.lit(closed)
    return df.where(after), df.where(~F.coalesce(after, F.lit(False)))


def dead_letters(late: DataFrame, table: str, key: str, day: str) -> DataFrame:
    """Late rows with the whole prepared row as JSON."""
    observed = F.try_to_date(F.col(day).cast("string"))
    return late.select(
        F.concat_ws("|", F.lit(table), F.col(key)).alias("dlq_pk"), F.lit(table).alias("source_table"),
        F.when(observed.isNull(), NO_DAY).otherwise(LATE).alias("reason"), F.to_json(F.struct(*late.columns)).alias("payload_json"),
        observed.cast("string").alias("event_day_observed"),
    )


def malformed(lines: DataFrame, table: str, line: str, day: str) -> DataFrame:
    """Lines that are no records as dead letters: one for each day and content, with the number of times it stood there."""
    per = lines.groupBy(day, line).agg(F.count("*").alias("times"))
    return per.select(
        F.concat_ws("|", F.lit(table), F.col(day), F.sha2(F.col(line), 256)).alias("dlq_pk"), F.lit(table).alias("source_table"), F.lit(MALFORMED).alias("reason"),
        F.to_json(F.struct(F.col(line).alias("line"), "times")).alias("payload_json"), F.col(day).alias("event_day_observed"),
    )


def is_ready(marks: DataFrame, day: str) -> DataFrame:
    """One row, ``ready``: transactions closed the day with rows; cancellations and rates with any row for it."""
    mine = marks.where(F.col("source_partition").isin(f"day={day}", NONPARTITIONED))
    newest = lambda value: F.max_by(value, F.struct("committed_at", "watermark_id"))
    per = mine.groupBy("table_name").agg(newest(F.col("rows_in_batch")).alias("rows"))
    need: dict[str, Column] = {"transactions": F.col("rows") > 0, "cancellations": F.lit(True), "exchange_rates": F.lit(True)}
    passed = F.coalesce(*[F.when(F.col("table_name") == t, c) for t, c in need.items()])
    return per.agg((F.count_if(passed) == len(need)).alias("ready"))
