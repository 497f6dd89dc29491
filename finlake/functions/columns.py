"""Column expressions: keys, days, flags. All times are wall-clock UTC without a zone, so no session setting changes a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a missing part of a key (fixed values).
ZERO, NO_TIME, NO_ID = "0", "__nullts__", "__nullid__"
CANCELLED_AT = "yyyy MMM dd HH:mm"


def text(name: str, missing: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(missing))


def day_of(epoch: str) -> Column:
    """yyyy-MM-dd of epoch seconds."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(epoch) / 86400).cast("int")).cast("string")


def time_of(epoch: str) -> Column:
    return F.expr(f"timestampadd(SECOND, {epoch}, TIMESTAMP_NTZ'1970-01-01 00:00:00')")


def time_of_micros(epoch: str) -> Column:
    """Time of epoch microseconds, to the second."""
    return F.expr(f"timestampadd(SECOND, cast(floor({epoch} / 1000000) as bigint), TIMESTAMP_NTZ'1970-01-01 00:00:00')")


def hour_of(epoch: str) -> Column:
    return F.pmod(F.floor(F.col(epoch) / 3600), F.lit(24)).cast("long")


def with_transaction_keys(df: DataFrame, ingested_at: Column) -> DataFrame:
    """event_day, composite_pk (a null transaction_id leaves a key of two parts) and ingested_at."""
    key = F.concat_ws("|", F.col("transaction_id").cast("string"), text("created_at", ZERO), text("user_id", ZERO))
    return df.withColumns({"event_day": day_of("created_at"), "composite_pk": key, "ingested_at": ingested_at})


def with_cancellation_keys(df: DataFrame, ingested_at: Column, ingestion_day: Column) -> DataFrame:
    """cancelled_ts (null if it can't be parsed), ingestion_day, event_day (falls back to ingestion_day), ingested_at and cancellation_pk."""
    parsed = F.try_to_timestamp("cancelled_at", F.lit(CANCELLED_AT)).cast("timestamp_ntz")
    key = F.concat_ws("|", text("cancelled_at", NO_TIME), text("cancellation_id", NO_ID), text("original_transaction_id", NO_ID))
    df = df.withColumns({"cancelled_ts": parsed, "ingestion_day": ingestion_day})
    day = F.coalesce(F.to_date("cancelled_ts").cast("string"), F.col("ingestion_day").cast("string"))
    return df.withColumns({"event_day": day, "ingested_at": ingested_at, "cancellation_pk": key})


def with_rate_keys(df: DataFrame, ingested_at: Column) -> DataFrame:
    return df.withColumns({"rate_pk": F.concat_ws("|", F.col("update_id").cast("string"), text("timestamp", ZERO)), "ingested_at": ingested_at})


def holds(condition: Column) -> Column:
    """A flag: true where the condition is true, false where it is false or unknown."""
    return F.coalesce(condition, F.lit(False))


def n_if(condition: Column) -> Column:
    return F.count_if(condition).cast("long")


def revenue_eligible() -> Column:
    return holds((F.col("status") == "completed") & (F.col("transaction_type") == "purchase"))


def amount_invalid() -> Column:
    return F.col("amount").isNull() | (F.col("amount") <= 0)
