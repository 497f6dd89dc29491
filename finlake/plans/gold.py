"""Gold models. Batch and live call the same aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finlake.functions.columns import hour_of, n_if
from finlake.operators.asof import as_of

def rows() -> Column:
    return F.count("*").cast("long")


def real() -> Column:
    return ~F.col("is_test_user")


def fresh() -> Column:
    return F.max("ingested_at").alias("updated_at")


def key(*parts: str | Column) -> Column:
    """Parts joined by ``_``; a null part makes a null key."""
    parts = [F.col(p).cast("string") if isinstance(p, str) else p for p in parts]
    return F.concat(*[x for p in parts for x in (F.lit("_"), p)][1:]).alias("pk")


def on_day(df: DataFrame, run_date: str | None) -> DataFrame:
    return df.where(F.col("event_day") == run_date) if run_date else df


def transactions_by_hour(tx: DataFrame, run_date: str | None = None) -> DataFrame:
    per = on_day(tx, run_date).groupBy("event_day", hour_of("created_at").alias("hour_of_day"), "is_test_user")
    counted = per.agg(rows().alias("tx_cnt"), n_if(F.col("status") == "completed").alias("completed_cnt"), n_if(F.col("status") == "failed").alias("failed_cnt"), fresh())
    return counted.select(key("event_day", "hour_of_day", "is_test_user"), "*")


def purchases_by_hour(tx: DataFrame, run_date: str | None = None) -> DataFrame:
    bought = on_day(tx, run_date).where(F.col("is_revenue_eligible") & real())
    counted = bought.groupBy("event_day", hour_of("created_at").alias("hour_of_day")).agg(rows().alias("purchase_cnt"), F.sum("amount").alias("gross_amount_native"), fresh())
    return counted.select(key("event_day", "hour_of_day"), "*")


def revenue_daily(tx: DataFrame, rates_long: DataFrame, run_date: str | None = None) -> DataFrame:
    """Gross revenue in TGRK at the rate as of the day; what has no rate is counted but adds nothing."""
    sold = on_day(tx, run_date).where(F.col("is_revenue_eligible") & real() & ~F.col("is_amount_invalid"))
    # Pre-aggregated by day and currency, so only a few rows meet the rates.
    per = sold.groupBy("event_day", "currency").agg(F.sum("amount").alias("amount"), rows().alias("n"), F.max("ingested_at").alias("ingested_at"))
    rates = as_of(per.select("currency", "event_day"), rates_long, "currency", "event_day", "rate_to_tgrk", "rate_day")
    priced = per.join(rates, ["currency", "event_day"], "left")
    n_of = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    counters = [n_of(F.col("rate_source") == s).alias(f"tx_rate_{a}") for s, a in (("missing", "missing"), ("backward", "backfilled"))]
    counters += [n_of(F.col("currency") == c).alias(f"tx_{c.lower()}") for c in ("TGRK", "PUNK", "RUB")]
    return priced.groupBy("event_day").agg(F.sum(F.try_divide("amount", "rate_to_tgrk")).alias("gross_revenue_tgrk"), F.sum("n").alias("tx_cnt"), *counters, fresh())


def touched(cancelled: DataFrame, run_date: str | None) -> DataFrame:
    """All rows of the cancel days that got a row on ``run_date``: late rows rebuild their own day, whole."""
    found = cancelled.withColumnRenamed("event_day", "cancel_day")
    if not run_date:
        return found
    days = found.where(F.to_date("ingested_at") == F.lit(run_date).cast("date")).select("cancel_day").distinct()
    return found.join(days, "cancel_day", "left_semi")


def refunds_daily(cancelled: DataFrame, run_date: str | None = None) -> DataFrame:
    """Native refunds by cancel day. Invalid refunds are left out first, so their counter stays 0."""
    paid = touched(cancelled, run_date).where((F.col("refund_amount") > 0) & ~F.col("is_refund_invalid"))
    return paid.groupBy("cancel_day").agg(F.sum("refund_amount").alias("refund_native_sum"), rows().alias("refund_cnt"), n_if(F.col("is_refund_invalid")).alias("invalid_refund_cnt"), fresh())


def _cancelled_by_reason(df: DataFrame, orphan: Column, ambiguous: Column, seconds: Column) -> DataFrame:
    per = df.withColumns({"reason": F.coalesce("reason", F.lit("unknown")), "__seconds": seconds, "__orphan": orphan, "__ambiguous": ambiguous}).groupBy("cancel_day", "reason")
    counted = per.agg(
        rows().alias("cancellations_cnt"), n_if(F.col("is_refund_invalid")).alias("invalid_refund_cnt"), n_if(F.col("__orphan")).alias("orphan_cnt"),
        n_if(F.col("__ambiguous")).alias("ambiguous_attribution_cnt"), F.avg("__seconds").alias("avg_seconds_to_cancel"),
        F.min("__seconds").alias("min_seconds_to_cancel"), F.max("__seconds").alias("max_seconds_to_cancel"),
        F.sum(F.coalesce("refund_amount", F.lit(0.0))).alias("total_refund_amount"), fresh(),
    )
    return counted.select(key("cancel_day", "reason"), "*")


def cancellations_summary(cancelled: DataFrame, tx: DataFrame, run_date: str | None = None) -> DataFrame:
    """Attributed to the earliest transaction of a real user with the id. A day's run looks only at transactions that its cancel days name."""
    if run_date:
        named = touched(cancelled, run_date).select(F.col("original_transaction_id").alias("transaction_id")).distinct()
        tx = tx.join(named, "transaction_id", "left_semi")
    bought = tx.where(real() & F.col("transaction_id").isNotNull()).groupBy(F.col("transaction_id").alias("original_transaction_id")).agg(F.min("created_ts").alias("__bought"), F.count("*").alias("__matches"))
    attributed = touched(cancelled, run_date).join(bought, "original_transaction_id", "left")
    seconds = F.expr("timestampdiff(SECOND, __bought, cancelled_ts)")
    return _cancelled_by_reason(attributed, F.col("__bought").isNull(), F.col("__matches") > 1, seconds)


def cancellations_live(cancelled: DataFrame) -> DataFrame:
    """The same without attribution, which a stream does not wait for."""
    return _cancelled_by_reason(touched(cancelled, None), F.lit(False), F.lit(False), F.lit(None).cast("long"))


def first_seen(tx: DataFrame, run_date: str | None = None) -> DataFrame:
    """The first day of each real user among the rows of ``run_date``, or of all. ``not_before`` falls as days rise, so that the earliest wins a merge by the larger."""
    known = on_day(tx, run_date).where(real() & ~F.col("is_user_missing"))
    first = known.groupBy("user_id").agg(F.min("event_day").alias("first_day"))
    return first.withColumn("not_before", F.date_sub(F.lit("1970-01-01").cast("date"), F.unix_date(F.col("first_day").cast("date"))))


def user_cohorts(tx: DataFrame, run_date: str | None = None, first: DataFrame | None = None) -> DataFrame:
    """New users have their first day in all history on that day. ``first``: the kept first days of users, so that a day's run reads its day only."""
    known = tx.where(real() & ~F.col("is_user_missing"))
    first = (first_seen(tx) if first is None else first).select("user_id", F.col("first_day").alias("__first"))
    per_user = on_day(known, run_date).groupBy("user_id", "event_day").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "completed").alias("done"), F.count_if("is_revenue_eligible").alias("eligible"),
        F.sum("amount").alias("amount"), F.count("amount").alias("amounts"), F.max("ingested_at").alias("ingested_at"),
    )
    kind = F.when(F.col("__first") == F.col("event_day"), "new").otherwise("returning")
    # One row per user and day is left, so a plain count is the exact distinct count.
    cohorts = per_user.join(first, "user_id").groupBy("event_day", kind.alias("user_type")).agg(
        rows().alias("unique_users"), F.sum("n").alias("tx_cnt"), F.sum("done").alias("completed_cnt"), F.sum("eligible").alias("revenue_eligible_cnt"),
        F.try_divide(F.sum("amount"), F.sum("amounts")).alias("avg_amount"), fresh(),
    )
    return cohorts.select(key("event_day", "user_type"), "*")


def promo_codes_analysis(tx: DataFrame, promo_codes: DataFrame, updated_at: Column | None = None) -> DataFrame:
    """All history per code, with codes never used and uses of unknown codes. ``updated_at`` is the caller's clock, which no row of the input gives."""
    used = tx.where(F.col("promo_code_id").isNotNull() & real()).groupBy("promo_code_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.min("created_ts").alias("first_used_at"), F.max("created_ts").alias("last_used_at"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    false = lambda c: F.coalesce(c, F.lit(False))
    return promo_codes.join(used, "promo_code_id", "full_outer").select(
        "promo_code_id", "code", "max_uses", "expiry_date", zero("total").alias("uses_total"), zero("done").alias("uses_completed"), zero("failed").alias("uses_failed"),
        "first_used_at", "last_used_at", false(F.col("last_used_at") > F.try_to_date("expiry_date").cast("timestamp_ntz")).alias("used_after_expiry"),
        false(F.col("total") > F.col("max_uses")).alias("over_limit"), *([] if updated_at is None else [updated_at.alias("updated_at")]),
    )


def promo_expired_usage_daily(tx: DataFrame, run_date: str | None = None) -> DataFrame:
    used = on_day(tx, run_date).where(F.col("promo_code_id").isNotNull() & real())
    late = F.col("is_promo_expired_at_use")
    return used.groupBy("event_day").agg(rows().alias("promo_uses_total"), n_if(late).alias("promo_uses_expired"), n_if(late & (F.col("status") == "completed")).alias("promo_uses_expired_completed"), fresh())


#: Counter of dq_summary_daily -> flag of transactions_clean.
DQ = {
    "tx_user_missing": "is_user_missing", "tx_user_unknown": "is_user_unknown", "tx_test_user": "is_test_user", "tx_test_user_inconsistent": "is_test_user_inconsistent",
    "tx_amount_invalid": "is_amount_invalid", "tx_id_duplicated": "is_transaction_id_duplicated", "tx_promo_expired": "is_promo_expired_at_use",
}


def dq_summary_daily(tx: DataFrame, run_date: str | None = None) -> DataFrame:
    return on_day(tx, run_date).groupBy("event_day").agg(rows().alias("tx_total"), *[n_if(F.col(flag)).alias(name) for name, flag in DQ.items()], fresh())


def rates_latest(rates: DataFrame) -> DataFrame:
    """The newest quote, one row for the pair ``tgrk``; of two deliveries of it the later one. Works on a stream too."""
    newest = F.max_by(F.struct("rate_tgrk_punk", "rate_tgrk_rub"), F.struct("timestamp", "update_id", "ingested_at"))
    return rates.where(F.col("timestamp").isNotNull()).groupBy(F.lit("tgrk").alias("pair")).agg(F.max("timestamp").alias("rate_ts"), newest.alias("r")).select("pair", "rate_ts", "r.*")
