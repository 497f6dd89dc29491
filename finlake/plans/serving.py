"""Unified settled-plus-live datasets and the dashboard's queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPOCH_DAY = "1970-01-01"


def unified(settled: DataFrame, live: DataFrame, day: str) -> DataFrame:
    """Settled rows, and live rows of days after the last settled one."""
    last = settled.agg(F.coalesce(F.max(day), F.lit(EPOCH_DAY)).alias("__last"))
    newer = live.join(F.broadcast(last), F.col(day) > F.col("__last")).drop("__last")  # one row
    return settled.withColumn("source", F.lit("settled")).unionByName(newer.select(settled.columns).withColumn("source", F.lit("live")))


def recent(df: DataFrame, day: str, today: str, days: int = 30) -> DataFrame:
    """The dashboard's time range."""
    return df.where(F.col(day) >= F.date_sub(F.lit(today).cast("date"), days).cast("string"))


def adhoc(df: DataFrame, column: str, op: str, value) -> DataFrame:
    """A chart's filter."""
    tests: dict[str, Callable[[Column], Column]] = {"==": lambda c: c == value, "!=": lambda c: c != value, ">": lambda c: c > value, ">=": lambda c: c >= value, "<": lambda c: c < value, "<=": lambda c: c <= value, "IN": lambda c: c.isin(*value)}
    return df.where(tests[op](F.col(column)))


def total(column: str) -> Column:
    return F.sum(column).alias(column)


def by(df: DataFrame, keys: list[str], *metrics: Column, limit: int | None = None) -> DataFrame:
    """A grouped chart in the order of its keys, with all groups unless there is a limit."""
    out = df.groupBy(*keys).agg(*metrics).orderBy(*keys)
    return out.limit(limit) if limit else out


def real(df: DataFrame) -> DataFrame:
    return adhoc(df, "is_test_user", "IN", [False])


def invalid_refund_pct(cancelled: DataFrame) -> DataFrame:
    return cancelled.agg(F.round(F.try_divide(F.sum("invalid_refund_cnt") * 100.0, F.sum("cancellations_cnt")), 1).alias("invalid_refund_pct"))


def real_and_test_by_hour(tx: DataFrame) -> DataFrame:
    share = lambda c: F.sum(F.when(c, F.col("tx_cnt")).otherwise(0))
    return by(tx, ["hour_of_day"], share(~F.col("is_test_user")).alias("real_tx"), share(F.col("is_test_user")).alias("test_tx"), limit=24)


PROMO_COLUMNS = ("promo_code_id", "code", "max_uses", "expiry_date", "uses_total", "uses_completed", "uses_failed", "last_used_at", "used_after_expiry", "over_limit")


def promo_table(promo: DataFrame, limit: int = 1000) -> DataFrame:
    """The most used codes; the limit is the report's own."""
    return promo.select(*PROMO_COLUMNS).orderBy(F.col("uses_total").desc(), "promo_code_id").limit(limit)


def cancellation_rate(cancelled: DataFrame, purchases: DataFrame) -> DataFrame:
    """Cancellations over purchases of the same day."""
    c = cancelled.groupBy(F.col("cancel_day").alias("event_day")).agg(F.sum("cancellations_cnt").alias("cancellations_cnt"))
    p = purchases.groupBy("event_day").agg(F.sum("purchase_cnt").alias("purchase_cnt"))
    return c.join(p, "event_day").withColumn("cancellation_rate", F.round(F.try_divide(F.col("cancellations_cnt") * 1.0, F.col("purchase_cnt")), 6))
