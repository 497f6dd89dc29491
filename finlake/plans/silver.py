"""Silver models: one deduplicated, flagged row per key. Nothing but older versions is dropped.

``run_date`` makes a model work on the slice of one day, as the nightly run
does; without it, on all history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from finlake.functions.columns import amount_invalid, day_of, holds, revenue_eligible, time_of
from finlake.operators.dedup import latest
from finlake.operators.joins import counted

RATE_COLUMNS = {"PUNK": "rate_tgrk_punk", "RUB": "rate_tgrk_rub"}


def newest() -> list[Column]:
    return [F.col("ingested_at").desc()]


#: Values that rows without a key are spread over.
SALTS = 1024


def matched(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Left join with a dimension that is unique by ``key``. Rows without a key match nothing; where the sides are shuffled they are spread, so that they do not meet in one task."""
    salt = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    # Always 0, but no constant, which the optimizer would take out of the join's key.
    zero = F.pmod(F.xxhash64(key), F.lit(1).cast("long"))
    return df.withColumn("__salt", salt).join(counted(dimension).withColumn("__salt", zero), [key, "__salt"], "left").drop("__salt")


def enriched(tx: DataFrame, users: DataFrame, test_users: DataFrame, promo_codes: DataFrame) -> DataFrame:
    """``tx`` with the flags that need dimensions. The same for settled and live rows.

    The dimensions are unique by key. Those of few rows are broadcast where Catalyst's
    statistics show them to be small, the rest are merged.
    """
    u = users.select("user_id", F.col("is_test_user").alias("__test"), F.lit(True).alias("__known"))
    t = test_users.select(F.col("test_user_uuid").alias("user_uuid"), F.lit(True).alias("__listed"))
    p = promo_codes.select("promo_code_id", F.date_add(F.try_to_date("expiry_date"), 1).alias("__invalid_from"))
    wide = matched(matched(matched(tx, u, "user_id"), t, "user_uuid"), p, "promo_code_id")
    known, test, listed = holds(F.col("__known")), holds(F.col("__test")), holds(F.col("__listed"))
    return wide.withColumns({
        "is_user_missing": F.col("user_id").isNull(),
        "is_user_unknown": F.col("user_id").isNotNull() & ~known,
        "is_test_user": listed | test,
        "is_test_user_inconsistent": F.col("user_id").isNotNull() & (test != listed),
        "is_amount_invalid": amount_invalid(),
        "is_revenue_eligible": revenue_eligible(),
        "is_promo_expired_at_use": holds(F.col("event_day").cast("date") >= F.col("__invalid_from")),
    }).drop("__test", "__known", "__listed", "__invalid_from")


def transactions_clean(bronze: DataFrame, users: DataFrame, test_users: DataFrame, promo_codes: DataFrame, run_date: str | None = None) -> DataFrame:
    """A transaction id counts as duplicated if its day has it under another key, in a full run too."""
    if run_date:
        bronze = bronze.where(F.col("event_day") == run_date)
    rows = latest(bronze, ["composite_pk"], newest()).withColumn("created_ts", time_of("created_at"))
    # Null ids are no duplicates; each in a window of its own key, so that they never meet in one task.
    same_id = Window.partitionBy("event_day", "transaction_id", F.when(F.col("transaction_id").isNull(), F.col("composite_pk")))
    rows = rows.withColumn("is_transaction_id_duplicated", F.col("transaction_id").isNotNull() & (F.count("*").over(same_id) > 1))
    return enriched(rows, users, test_users, promo_codes)


def cancellations_clean(bronze: DataFrame, run_date: str | None = None) -> DataFrame:
    """``run_date`` is a day of loading here: cancellations come late for their own day."""
    if run_date:
        bronze = bronze.where(F.to_date("ingested_at") == F.lit(run_date).cast("date"))
    rows = latest(bronze, ["cancellation_pk"], newest())
    flagged = rows.withColumn("is_refund_invalid", F.col("refund_amount").isNull() | (F.col("refund_amount") < 0))
    return flagged.select("cancellation_pk", "cancellation_id", "original_transaction_id", "reason", "cancelled_ts", "refund_amount", "event_day", "ingested_at", "is_refund_invalid")


def rates_daily(bronze: DataFrame, run_date: str | None = None) -> DataFrame:
    """The last quote of each day."""
    if run_date:  # bounds on the raw column reach the scan
        first = F.unix_date(F.lit(run_date).cast("date")).cast("long") * 86400
        bronze = bronze.where((F.col("timestamp") >= first) & (F.col("timestamp") < first + 86400))
    rows = bronze.withColumn("rate_day", day_of("timestamp"))
    return latest(rows, ["rate_day"], [F.col("timestamp").desc()]).select("rate_day", "update_id", "timestamp", *RATE_COLUMNS.values())


def rates_long(daily: DataFrame) -> DataFrame:
    """One row per day and currency, in units per 1 TGRK; null and zero quotes are no quotes."""
    wide = daily.select("rate_day", "timestamp", F.lit(1.0).alias("TGRK"), *[F.col(c).alias(k) for k, c in RATE_COLUMNS.items()])
    long = wide.unpivot(["rate_day", "timestamp"], ["TGRK", *RATE_COLUMNS], "currency", "rate_to_tgrk")
    return long.where("rate_to_tgrk <> 0").select(F.concat("rate_day", F.lit("|"), "currency").alias("rate_day_currency"), "rate_day", "currency", "rate_to_tgrk", "timestamp")
