"""Every query by name, over the driver's tables, with the same in DuckDB SQL.

For comparison, times are shown as text and doubles are rounded to 4 places.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlake.operators.dedup import cutover, latest
from finlake.operators.keyed import merged
from finlake.operators.quality import accepted_values, not_null, orphan_rate, orphans_above, same_count, unique
from finlake.operators.routing import dead_letters, high_watermark, is_ready, normalised_partitions, route, watermark_rows
from finlake.plans import checks, gold, serving, silver
from finlake.sources.adapters import Bronze, settled, streamed
from finlake.sources.jsonl import residual

#: The settled part ends here where a query needs both parts; a nightly run's day; the dashboard's today.
SETTLED_UNTIL, RUN_DATE, TODAY = "2024-01-20", "2024-01-15", "2024-01-31"


def shown(df: DataFrame) -> DataFrame:
    def show(name: str, kind: str):
        c = F.col(name)
        if kind in ("timestamp_ntz", "timestamp", "date"):
            return c.cast("string").alias(name)
        return F.round(c, 4).alias(name) if kind == "double" else c

    return df.select(*[show(n, k) for n, k in df.dtypes])


class Warehouse:
    """Frames of all layers over one data directory; nothing runs until a query does."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.bronze = Bronze(spark, sf_dir)

    @property
    def dims(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.bronze.users, self.bronze.test_users, self.bronze.promo_codes

    def tx_on(self, run_date: str | None) -> DataFrame:
        return silver.transactions_clean(self.bronze.transactions, *self.dims, run_date=run_date)

    @cached_property
    def tx(self) -> DataFrame:
        return self.tx_on(None)

    @cached_property
    def cancelled(self) -> DataFrame:
        return silver.cancellations_clean(self.bronze.cancellations)

    @cached_property
    def daily(self) -> DataFrame:
        return silver.rates_daily(self.bronze.rates)

    @cached_property
    def long(self) -> DataFrame:
        return silver.rates_long(self.daily)

    @cached_property
    def marks(self) -> DataFrame:
        """Batch has closed all days up to SETTLED_UNTIL, and loaded one snapshot of the rates."""
        days = self.bronze.transactions.where(F.col("event_day") <= SETTLED_UNTIL).select(F.concat(F.lit("day="), "event_day").alias("p")).distinct()
        snapshot = days.sparkSession.range(1).select(F.lit("snapshot").alias("p"))
        return (
            watermark_rows("transactions", "batch", days, 10, "2024-02-01 00:00:00")
            .union(watermark_rows("cancellations", "batch", days, 0, "2024-02-01 00:00:00"))
            .union(watermark_rows("exchange_rates", "batch", snapshot, 5, "2024-02-01 00:00:00"))
        )

    def unified_transactions(self) -> DataFrame:
        hours = gold.transactions_by_hour(self.tx)
        return serving.unified(hours.where(F.col("event_day") <= SETTLED_UNTIL), hours, "event_day")

    def unified_purchases(self) -> DataFrame:
        hours = gold.purchases_by_hour(self.tx)
        return serving.unified(hours.where(F.col("event_day") <= SETTLED_UNTIL), hours, "event_day")

    def unified_cancellations(self) -> DataFrame:
        settled = gold.cancellations_summary(self.cancelled.where(F.col("event_day") <= SETTLED_UNTIL), self.tx)
        return serving.unified(settled, gold.cancellations_live(self.cancelled), "cancel_day")

    def late(self) -> tuple[DataFrame, DataFrame]:
        return route(self.bronze.transactions, "event_day", datetime.date.fromisoformat(SETTLED_UNTIL))

    def tables(self) -> dict[str, DataFrame]:
        b = self.bronze
        return {
            "bronze.transactions": b.transactions, "bronze.cancellations": b.cancellations, "bronze.exchange_rates": b.rates, "bronze.users": b.users,
            "bronze.test_users": b.test_users, "bronze.promo_codes": b.promo_codes, "bronze_dlq.late_events": dead_letters(self.late()[1], "transactions", "composite_pk", "event_day"),
            "silver.transactions_clean": self.tx, "silver.cancellations_clean": self.cancelled, "silver.exchange_rates_daily": self.daily, "silver.exchange_rates_long": self.long,
            "gold.transactions_by_hour": gold.transactions_by_hour(self.tx), "gold.purchases_by_hour": gold.purchases_by_hour(self.tx), "gold.revenue_daily": gold.revenue_daily(self.tx, self.long),
            "gold.refunds_daily": gold.refunds_daily(self.cancelled), "gold.promo_codes_analysis": gold.promo_codes_analysis(self.tx, b.promo_codes),
            "gold.cancellations_summary": gold.cancellations_summary(self.cancelled, self.tx), "gold.user_cohorts": gold.user_cohorts(self.tx),
            "gold.promo_expired_usage_daily": gold.promo_expired_usage_daily(self.tx), "gold.dq_summary_daily": gold.dq_summary_daily(self.tx),
        }


Query = Callable[[Warehouse], DataFrame]
FLAGS = ("is_user_missing", "is_user_unknown", "is_test_user", "is_test_user_inconsistent", "is_amount_invalid", "is_revenue_eligible", "is_transaction_id_duplicated", "is_promo_expired_at_use")
TX = ("composite_pk", "transaction_id", "user_id", "user_uuid", "amount", "currency", "transaction_type", "promo_code_id", "status", "created_at", "created_ts", "event_day", "ingested_at", *FLAGS)
BRONZE_TX = ("composite_pk", "status", "event_day", "ingested_at")


def _upserted(w: Warehouse) -> DataFrame:
    """The table after a batch of redelivered rows was merged into first deliveries."""
    rows = w.bronze.transactions.select(*BRONZE_TX)
    again = rows.where(F.col("status") == "failed")
    return merged(rows.where(F.col("status") != "failed"), latest(again, ["composite_pk"], [F.col("ingested_at").desc()]), ["composite_pk"], "ingested_at")


def _partition_key(w: Warehouse) -> DataFrame:
    """Keys that hold within a partition only: the newest per key and loading day."""
    return latest(w.bronze.cancellations, ["ingestion_day", "cancellation_id"], [F.col("ingested_at").desc(), F.col("cancellation_pk")]).select("ingestion_day", "cancellation_id", "cancellation_pk")


def _cutover_all(w: Warehouse) -> DataFrame:
    """The batch of all days over what the stream left in the partitions that the batch touches."""
    batch = settled(w.bronze.transactions)
    return cutover(batch, residual(streamed(w.bronze.transactions), "event_day", batch, batch), "composite_pk").select(*BRONZE_TX, "promo_code_id")


def _counts(w: Warehouse) -> DataFrame:
    """Both sides of the reconciliation; the check itself returns nothing when they agree."""
    differs = same_count(w.bronze.transactions, w.tx, "composite_pk", "ingested_at").agg(F.count("*").alias("failures"))
    return w.tx.agg(F.count("*").alias("silver_cnt")).crossJoin(F.broadcast(differs))  # two rows of one


def _tests(w: Warehouse) -> DataFrame:
    """Failures of three kinds of data tests."""
    found = [
        ("not_null_user", not_null(w.tx, "user_id").agg(F.count("*").alias("failures"))),
        ("unique_key", unique(w.tx, "composite_pk").agg(F.count("*").alias("failures"))),
        ("unique_transaction_id", unique(w.tx, "transaction_id").agg(F.count("*").alias("failures"))),
        ("accepted_currency", accepted_values(w.tx, "currency", ["TGRK", "PUNK", "RUB"]).agg(F.count("*").alias("failures"))),
    ]
    out = [df.select(F.lit(name).alias("test"), "failures") for name, df in found]
    return out[0].union(out[1]).union(out[2]).union(out[3])


WAREHOUSE_QUERIES: dict[str, Query] = {
    "silver_transactions_clean": lambda w: w.tx.select(*TX),
    "silver_transactions_clean_day": lambda w: w.tx_on(RUN_DATE).select(*TX),
    "silver_cancellations_clean": lambda w: w.cancelled,
    "silver_cancellations_clean_day": lambda w: silver.cancellations_clean(w.bronze.cancellations, RUN_DATE),
    "silver_rates_daily": lambda w: w.daily,
    "silver_rates_daily_day": lambda w: silver.rates_daily(w.bronze.rates, "2024-01-14"),
    "silver_rates_long": lambda w: w.long,
    "gold_transactions_by_hour": lambda w: gold.transactions_by_hour(w.tx),
    "gold_purchases_by_hour": lambda w: gold.purchases_by_hour(w.tx),
    "gold_revenue_daily": lambda w: gold.revenue_daily(w.tx, w.long),
    "gold_revenue_day": lambda w: gold.revenue_daily(w.tx_on(RUN_DATE), w.long, RUN_DATE),
    "gold_refunds_daily": lambda w: gold.refunds_daily(w.cancelled),
    "gold_refunds_touched": lambda w: gold.refunds_daily(w.cancelled, RUN_DATE),
    "gold_cancellations_summary": lambda w: gold.cancellations_summary(w.cancelled, w.tx),
    "gold_cancellations_touched": lambda w: gold.cancellations_summary(w.cancelled, w.tx, RUN_DATE),
    "gold_cancellations_live": lambda w: gold.cancellations_live(w.cancelled),
    "gold_user_cohorts": lambda w: gold.user_cohorts(w.tx),
    "gold_promo_codes_analysis": lambda w: gold.promo_codes_analysis(w.tx, w.bronze.promo_codes),
    "gold_promo_expired_usage_daily": lambda w: gold.promo_expired_usage_daily(w.tx),
    "gold_dq_summary_daily": lambda w: gold.dq_summary_daily(w.tx),
    "gold_exchange_rates_latest": lambda w: gold.rates_latest(w.bronze.rates),
    "unified_transactions": Warehouse.unified_transactions,
    "unified_purchases": Warehouse.unified_purchases,
    "unified_cancellations": Warehouse.unified_cancellations,
    "cutover_merge_all": _cutover_all,
    "route_on_time": lambda w: w.late()[0].select(*BRONZE_TX),
    "route_late": lambda w: w.late()[1].select(*BRONZE_TX),
    "dlq_late_events": lambda w: dead_letters(w.late()[1], "transactions", "composite_pk", "event_day").drop("payload_json"),
    "dlq_payload": lambda w: dead_letters(w.late()[1], "transactions", "composite_pk", "event_day").select("dlq_pk", F.get_json_object("payload_json", "$.status").alias("status"), F.get_json_object("payload_json", "$.currency").alias("currency")),
    "high_watermark": lambda w: high_watermark(w.marks, "transactions"),
    "latest_watermark": lambda w: w.marks.orderBy(F.col("committed_at").desc(), F.col("watermark_id").desc()).limit(1).select("watermark_id", "rows_in_batch"),
    "readiness": lambda w: is_ready(w.marks, RUN_DATE),
    "partition_names": lambda w: normalised_partitions(w.bronze.transactions.select(F.concat(F.lit("event_day="), "event_day").alias("p")).union(w.bronze.spark.range(1).select(F.lit("").alias("p"))), "p"),
    "upsert_latest": _upserted,
    "partition_scoped_key": _partition_key,
    "orphans_above": lambda w: orphans_above(orphan_rate(w.cancelled, w.tx, "original_transaction_id", "transaction_id"), pct=1.0),
    "orphan_rate": lambda w: orphan_rate(w.cancelled, w.tx, "original_transaction_id", "transaction_id"),
    "count_recon": _counts,
    "data_tests": _tests,
    "declared_tests": lambda w: checks.all_failures(w.tables()),
    "chart_total_revenue": lambda w: gold.revenue_daily(w.tx, w.long).agg(serving.total("gross_revenue_tgrk")),
    "chart_total_transactions": lambda w: serving.real(w.unified_transactions()).agg(serving.total("tx_cnt")),
    "chart_invalid_refund_pct": lambda w: serving.invalid_refund_pct(w.unified_cancellations()),
    "chart_cancellations": lambda w: w.unified_cancellations().agg(serving.total("cancellations_cnt")),
    "chart_user_days": lambda w: gold.user_cohorts(w.tx).agg(serving.total("unique_users")),
    "chart_daily_revenue": lambda w: serving.by(serving.recent(gold.revenue_daily(w.tx, w.long), "event_day", TODAY), ["event_day"], serving.total("gross_revenue_tgrk"), limit=10000),
    "chart_completed_failed": lambda w: serving.by(serving.real(w.unified_transactions()), ["event_day"], serving.total("completed_cnt"), serving.total("failed_cnt"), limit=10000),
    "chart_hours_real_test": lambda w: serving.real_and_test_by_hour(w.unified_transactions()),
    "chart_purchases_by_hour": lambda w: serving.by(w.unified_purchases(), ["hour_of_day"], serving.total("purchase_cnt"), limit=24),
    "chart_cancellations_by_reason": lambda w: serving.by(w.unified_cancellations(), ["cancel_day", "reason"], serving.total("cancellations_cnt")),
    "chart_new_returning": lambda w: serving.by(gold.user_cohorts(w.tx), ["event_day", "user_type"], serving.total("unique_users"), limit=10000),
    "chart_promo_table": lambda w: serving.promo_table(gold.promo_codes_analysis(w.tx, w.bronze.promo_codes)),
    "cancellation_rate": lambda w: serving.cancellation_rate(w.unified_cancellations(), w.unified_purchases()),
}

QUERIES = {name: (lambda spark, sf_dir, q=query: shown(q(Warehouse(spark, sf_dir)))) for name, query in WAREHOUSE_QUERIES.items()}

# --- the same in DuckDB ---------------------------------------------------------------------------------------------

_BASE = """
WITH e AS (SELECT *, event_id AS i, epoch_us(ts) // 1000000 AS sec, strftime(ts, '%Y-%m-%d') AS d FROM events),
raw_tx AS (
  SELECT i, CASE i % 20 WHEN 1 THEN i - 1 ELSE i END AS transaction_id,
    if(i % 37 = 0, NULL, if(i % 41 = 0, -user_id - 1, user_id)) AS user_id, 'u-' || user_id AS user_uuid,
    if(i % 53 = 0, NULL, if(i % 59 = 0, -value, value)) AS amount, ['TGRK', 'PUNK', 'XXX', 'RUB', 'RUB'][i % 5 + 1] AS currency,
    CASE event_type WHEN 'signup' THEN 'transfer' WHEN 'error' THEN 'refund' ELSE 'purchase' END AS transaction_type,
    if(i % 4 = 0, (i // 4) % 250, NULL) AS promo_code_id, if(i % 10 <= 6, 'completed', ['pending', 'failed', 'cancelled'][i % 10 - 6]) AS status,
    sec AS created_at, date_trunc('day', ts) + INTERVAL 1 DAY AS ingested_at, d AS event_day FROM e
), bronze_tx AS (
  SELECT b.* EXCLUDE (i), transaction_id || '|' || created_at || '|' || coalesce(user_id, 0) AS composite_pk FROM (
    SELECT * FROM raw_tx UNION ALL BY NAME
    SELECT * REPLACE ('failed' AS status, ingested_at + INTERVAL 1 DAY AS ingested_at) FROM raw_tx WHERE i % 100 = 0) b
), u AS (SELECT c_custkey AS user_id, c_acctbal < 0 AS test FROM customer),
tu AS (SELECT 'u-' || c_custkey AS user_uuid FROM customer WHERE c_custkey % 7 = 0),
pc AS (SELECT p_partkey AS promo_code_id, p_name AS code, p_size::BIGINT AS max_uses, DATE '2024-01-01' + (p_partkey % 30)::INT AS expires FROM part WHERE p_partkey % 10 <> 0),
one_tx AS (SELECT * FROM bronze_tx {tx_day} QUALIFY row_number() OVER (PARTITION BY composite_pk ORDER BY ingested_at DESC) = 1),
tx AS (
  SELECT o.*, make_timestamp(created_at * 1000000) AS created_ts, o.user_id IS NULL AS is_user_missing,
    o.user_id IS NOT NULL AND u.user_id IS NULL AS is_user_unknown, tu.user_uuid IS NOT NULL OR coalesce(u.test, false) AS is_test_user,
    o.user_id IS NOT NULL AND coalesce(u.test, false) <> (tu.user_uuid IS NOT NULL) AS is_test_user_inconsistent,
    coalesce(amount <= 0, true) AS is_amount_invalid, status = 'completed' AND transaction_type = 'purchase' AS is_revenue_eligible,
    count(*) OVER (PARTITION BY event_day, transaction_id) > 1 AS is_transaction_id_duplicated,
    coalesce(event_day::DATE > pc.expires, false) AS is_promo_expired_at_use
  FROM one_tx o LEFT JOIN u ON u.user_id = o.user_id LEFT JOIN tu ON tu.user_uuid = o.user_uuid LEFT JOIN pc ON pc.promo_code_id = o.promo_code_id
), bronze_rates AS (
  SELECT i AS update_id, sec AS "timestamp", d AS rate_day, 1 + value / 100 AS rate_tgrk_punk, if(i % 3 = 0, 0, 50 + value) AS rate_tgrk_rub
  FROM e WHERE i % 331 = 150 AND day(ts) >= 4 AND day(ts) % 3 <> 0
), daily AS (SELECT * FROM bronze_rates {rate_day} QUALIFY row_number() OVER (PARTITION BY rate_day ORDER BY "timestamp" DESC) = 1),
long AS (
  SELECT rate_day || '|' || currency AS rate_day_currency, rate_day, currency, rate_to_tgrk, "timestamp" FROM (
    SELECT rate_day, "timestamp", unnest(['TGRK', 'PUNK', 'RUB']) AS currency, unnest([1.0::DOUBLE, rate_tgrk_punk, rate_tgrk_rub]) AS rate_to_tgrk FROM daily) WHERE rate_to_tgrk <> 0
), raw_cancel AS (
  SELECT i % 50 AS cancellation_id, CASE WHEN i % 70 = 9 THEN NULL WHEN i % 110 = 19 THEN i + 100000000 ELSE i - 9 END AS original_transaction_id,
    if(i % 40 = 19, NULL, event_type) AS reason, if(i % 90 = 29, 'n/a', strftime(ts + INTERVAL 2 HOUR, '%Y %b %d %H:%M')) AS cancelled_at,
    if(i % 60 = 9, NULL, if(i % 60 = 39, -value, value)) AS refund_amount, date_trunc('day', ts) + if(i % 30 = 9, INTERVAL 2 DAY, INTERVAL 1 DAY) AS ingested_at
  FROM e WHERE i % 10 = 9
), bronze_cancel AS (
  SELECT *, try_strptime(cancelled_at, '%Y %b %d %H:%M') AS cancelled_ts, ingested_at::DATE AS ingestion_day,
    coalesce(strftime(try_strptime(cancelled_at, '%Y %b %d %H:%M'), '%Y-%m-%d'), strftime(ingested_at, '%Y-%m-%d')) AS event_day,
    cancelled_at || '|' || cancellation_id || '|' || coalesce(original_transaction_id::VARCHAR, '__nullid__') AS cancellation_pk FROM raw_cancel
), cancelled AS (
  SELECT cancellation_pk, cancellation_id, original_transaction_id, reason, cancelled_ts, refund_amount, event_day, ingested_at, coalesce(refund_amount < 0, true) AS is_refund_invalid
  FROM bronze_cancel {cancel_day} QUALIFY row_number() OVER (PARTITION BY cancellation_pk ORDER BY ingested_at DESC) = 1
)"""
_TX_HOURS = """SELECT event_day || '_' || hour(created_ts) || '_' || is_test_user AS pk, event_day, hour(created_ts)::BIGINT AS hour_of_day, is_test_user,
  count(*) AS tx_cnt, count(*) FILTER (status = 'completed') AS completed_cnt, count(*) FILTER (status = 'failed') AS failed_cnt, max(ingested_at)::VARCHAR AS updated_at
FROM tx GROUP BY event_day, hour(created_ts), is_test_user"""
_BUYS = """SELECT event_day || '_' || hour(created_ts) AS pk, event_day, hour(created_ts)::BIGINT AS hour_of_day, count(*) AS purchase_cnt,
  round(sum(amount), 4) AS gross_amount_native, max(ingested_at)::VARCHAR AS updated_at
FROM tx WHERE is_revenue_eligible AND NOT is_test_user GROUP BY event_day, hour(created_ts)"""
_REVENUE = """SELECT s.event_day, round(sum(s.amount / coalesce(f.rate_to_tgrk, b.rate_to_tgrk)), 4) AS gross_revenue_tgrk, count(*) AS tx_cnt,
  count(*) FILTER (f.rate_to_tgrk IS NULL AND b.rate_to_tgrk IS NULL) AS tx_rate_missing,
  count(*) FILTER (f.rate_to_tgrk IS NULL AND b.rate_to_tgrk IS NOT NULL) AS tx_rate_backfilled,
  count(*) FILTER (s.currency = 'TGRK') AS tx_tgrk, count(*) FILTER (s.currency = 'PUNK') AS tx_punk, count(*) FILTER (s.currency = 'RUB') AS tx_rub,
  max(s.ingested_at)::VARCHAR AS updated_at
FROM (SELECT * FROM tx WHERE is_revenue_eligible AND NOT is_test_user AND NOT is_amount_invalid) s
ASOF LEFT JOIN long f ON f.currency = s.currency AND s.event_day >= f.rate_day
ASOF LEFT JOIN long b ON b.currency = s.currency AND s.event_day < b.rate_day
GROUP BY s.event_day"""
_REFUNDS = """SELECT event_day AS cancel_day, round(sum(refund_amount), 4) AS refund_native_sum, count(*) AS refund_cnt, 0::BIGINT AS invalid_refund_cnt, max(ingested_at)::VARCHAR AS updated_at
FROM cancelled WHERE refund_amount > 0 AND event_day IN ({days}) GROUP BY event_day"""
_SUMMARY = """SELECT event_day || '_' || coalesce(reason, 'unknown') AS pk, event_day AS cancel_day, coalesce(reason, 'unknown') AS reason, count(*) AS cancellations_cnt,
  count(*) FILTER (is_refund_invalid) AS invalid_refund_cnt, count(*) FILTER (bought IS NULL) AS orphan_cnt, count(*) FILTER (matches > 1) AS ambiguous_attribution_cnt,
  round(avg(epoch(cancelled_ts) - epoch(bought)), 4) AS avg_seconds_to_cancel, min(epoch(cancelled_ts) - epoch(bought))::BIGINT AS min_seconds_to_cancel,
  max(epoch(cancelled_ts) - epoch(bought))::BIGINT AS max_seconds_to_cancel, round(coalesce(sum(refund_amount), 0), 4) AS total_refund_amount, max(ingested_at)::VARCHAR AS updated_at
FROM cancelled c LEFT JOIN (SELECT transaction_id, min(created_ts) AS bought, count(*) AS matches FROM tx WHERE NOT is_test_user GROUP BY transaction_id) t ON t.transaction_id = c.original_transaction_id
WHERE event_day IN ({days}) GROUP BY event_day, coalesce(reason, 'unknown')"""
_LIVE = """SELECT event_day || '_' || coalesce(reason, 'unknown') AS pk, event_day AS cancel_day, coalesce(reason, 'unknown') AS reason, count(*) AS cancellations_cnt,
  count(*) FILTER (is_refund_invalid) AS invalid_refund_cnt, 0::BIGINT AS orphan_cnt, 0::BIGINT AS ambiguous_attribution_cnt, NULL::DOUBLE AS avg_seconds_to_cancel,
  NULL::BIGINT AS min_seconds_to_cancel, NULL::BIGINT AS max_seconds_to_cancel, round(coalesce(sum(refund_amount), 0), 4) AS total_refund_amount, max(ingested_at)::VARCHAR AS updated_at
FROM cancelled GROUP BY event_day, coalesce(reason, 'unknown')"""
_COHORTS = """SELECT event_day || '_' || user_type AS pk, event_day, user_type, count(DISTINCT user_id) AS unique_users, count(*) AS tx_cnt,
  count(*) FILTER (status = 'completed') AS completed_cnt, count(*) FILTER (is_revenue_eligible) AS revenue_eligible_cnt, round(avg(amount), 4) AS avg_amount, max(ingested_at)::VARCHAR AS updated_at
FROM (SELECT *, if(min(event_day) OVER (PARTITION BY user_id) = event_day, 'new', 'returning') AS user_type FROM tx WHERE NOT is_test_user AND user_id IS NOT NULL) GROUP BY event_day, user_type"""
_PROMO = """SELECT coalesce(pc.promo_code_id, s.promo_code_id) AS promo_code_id, code, max_uses, strftime(expires, '%Y-%m-%d') AS expiry_date, coalesce(n, 0) AS uses_total,
  coalesce(done, 0) AS uses_completed, coalesce(failed, 0) AS uses_failed, first_used::VARCHAR AS first_used_at, last_used::VARCHAR AS last_used_at,
  coalesce(last_used > expires::TIMESTAMP, false) AS used_after_expiry, coalesce(n > max_uses, false) AS over_limit
FROM pc FULL JOIN (SELECT promo_code_id, count(*) AS n, count(*) FILTER (status = 'completed') AS done, count(*) FILTER (status = 'failed') AS failed, min(created_ts) AS first_used, max(created_ts) AS last_used
  FROM tx WHERE promo_code_id IS NOT NULL AND NOT is_test_user GROUP BY promo_code_id) s ON s.promo_code_id = pc.promo_code_id"""
_TX_SHOWN = ", ".join({"amount": "round(amount, 4) AS amount", "created_ts": "created_ts::VARCHAR AS created_ts", "ingested_at": "ingested_at::VARCHAR AS ingested_at"}.get(c, c) for c in TX)
_CANCEL_SHOWN = "SELECT * REPLACE (cancelled_ts::VARCHAR AS cancelled_ts, round(refund_amount, 4) AS refund_amount, ingested_at::VARCHAR AS ingested_at) FROM cancelled"
_RATES_SHOWN = 'SELECT rate_day, update_id, "timestamp", round(rate_tgrk_punk, 4) AS rate_tgrk_punk, round(rate_tgrk_rub, 4) AS rate_tgrk_rub FROM daily'
_BRONZE_SHOWN = "composite_pk, status, event_day, ingested_at::VARCHAR AS ingested_at"


def _both(rows: str, day: str) -> str:
    """All days are in one part or the other when both come from the same rows."""
    return f"(SELECT *, if({day} <= '{SETTLED_UNTIL}', 'settled', 'live') AS source FROM ({rows}))"


_DAYS_ALL = "SELECT event_day FROM cancelled"
_DAYS_TOUCHED = f"SELECT event_day FROM cancelled WHERE ingested_at::DATE = DATE '{RUN_DATE}'"
_U_TX, _U_BUYS = _both(_TX_HOURS, "event_day"), _both(_BUYS, "event_day")
_U_CANCEL = f"(SELECT *, 'settled' AS source FROM ({_SUMMARY.format(days=_DAYS_ALL)}) WHERE cancel_day <= '{SETTLED_UNTIL}' UNION ALL SELECT *, 'live' FROM ({_LIVE}) WHERE cancel_day > '{SETTLED_UNTIL}')"
_MARKS = f"""(SELECT t || '|batch|day=' || event_day AS watermark_id, t AS table_name, 'day=' || event_day AS source_partition, n AS rows_in_batch
  FROM (SELECT DISTINCT event_day FROM bronze_tx WHERE event_day <= '{SETTLED_UNTIL}'), (VALUES ('transactions', 10::BIGINT), ('cancellations', 0::BIGINT)) AS v(t, n)
  UNION ALL SELECT 'exchange_rates|batch|snapshot', 'exchange_rates', 'snapshot', 5)"""

_SELECTS: dict[str, str] = {
    "silver_transactions_clean": f"SELECT {_TX_SHOWN} FROM tx",
    "silver_transactions_clean_day": f"SELECT {_TX_SHOWN} FROM tx",
    "silver_cancellations_clean": _CANCEL_SHOWN,
    "silver_cancellations_clean_day": _CANCEL_SHOWN,
    "silver_rates_daily": _RATES_SHOWN,
    "silver_rates_daily_day": _RATES_SHOWN,
    "silver_rates_long": "SELECT * REPLACE (round(rate_to_tgrk, 4) AS rate_to_tgrk) FROM long",
    "gold_transactions_by_hour": _TX_HOURS,
    "gold_purchases_by_hour": _BUYS,
    "gold_revenue_daily": _REVENUE,
    "gold_revenue_day": _REVENUE,
    "gold_refunds_daily": _REFUNDS.format(days=_DAYS_ALL),
    "gold_refunds_touched": _REFUNDS.format(days=_DAYS_TOUCHED),
    "gold_cancellations_summary": _SUMMARY.format(days=_DAYS_ALL),
    "gold_cancellations_touched": _SUMMARY.format(days=_DAYS_TOUCHED),
    "gold_cancellations_live": _LIVE,
    "gold_user_cohorts": _COHORTS,
    "gold_promo_codes_analysis": _PROMO,
    "gold_promo_expired_usage_daily": """SELECT event_day, count(*) AS promo_uses_total, count(*) FILTER (is_promo_expired_at_use) AS promo_uses_expired,
  count(*) FILTER (is_promo_expired_at_use AND status = 'completed') AS promo_uses_expired_completed, max(ingested_at)::VARCHAR AS updated_at
FROM tx WHERE promo_code_id IS NOT NULL AND NOT is_test_user GROUP BY event_day""",
    "gold_dq_summary_daily": f"""SELECT event_day, count(*) AS tx_total, {", ".join(f"count(*) FILTER ({flag}) AS {name}" for name, flag in gold.DQ.items())}, max(ingested_at)::VARCHAR AS updated_at FROM tx GROUP BY event_day""",
    "gold_exchange_rates_latest": """SELECT 'tgrk' AS pair, "timestamp" AS rate_ts, round(rate_tgrk_punk, 4) AS rate_tgrk_punk, round(rate_tgrk_rub, 4) AS rate_tgrk_rub FROM bronze_rates ORDER BY "timestamp" DESC, update_id DESC LIMIT 1""",
    "unified_transactions": f"SELECT * FROM {_U_TX}",
    "unified_purchases": f"SELECT * FROM {_U_BUYS}",
    "unified_cancellations": f"SELECT * FROM {_U_CANCEL}",
    "cutover_merge_all": f"""SELECT {_BRONZE_SHOWN}, promo_code_id FROM (
  SELECT *, 0 AS origin FROM bronze_tx WHERE status <> 'pending' UNION ALL
  SELECT * REPLACE ('stream-' || status AS status, ingested_at + INTERVAL 5 DAY AS ingested_at, NULL AS promo_code_id), 1 FROM bronze_tx
  WHERE event_day IN (SELECT event_day FROM bronze_tx WHERE status <> 'pending'))
QUALIFY row_number() OVER (PARTITION BY composite_pk ORDER BY origin, ingested_at DESC) = 1""",
    "route_on_time": f"SELECT {_BRONZE_SHOWN} FROM bronze_tx WHERE event_day > '{SETTLED_UNTIL}'",
    "route_late": f"SELECT {_BRONZE_SHOWN} FROM bronze_tx WHERE event_day <= '{SETTLED_UNTIL}'",
    "dlq_late_events": f"SELECT 'transactions|' || composite_pk AS dlq_pk, 'transactions' AS source_table, 'late_partition_owned_by_batch' AS reason, event_day AS event_day_observed FROM bronze_tx WHERE event_day <= '{SETTLED_UNTIL}'",
    "dlq_payload": f"SELECT 'transactions|' || composite_pk AS dlq_pk, status, currency FROM bronze_tx WHERE event_day <= '{SETTLED_UNTIL}'",
    "high_watermark": f"SELECT max(event_day) AS high_day FROM bronze_tx WHERE event_day <= '{SETTLED_UNTIL}'",
    "latest_watermark": f"SELECT watermark_id, rows_in_batch FROM {_MARKS} ORDER BY watermark_id DESC LIMIT 1",
    "readiness": f"SELECT count(DISTINCT table_name) FILTER (table_name <> 'transactions' OR rows_in_batch > 0) = 3 AS ready FROM {_MARKS} WHERE source_partition IN ('day={RUN_DATE}', 'snapshot')",
    "partition_names": "SELECT DISTINCT 'day=' || event_day AS partition FROM bronze_tx UNION ALL SELECT 'snapshot'",
    "upsert_latest": f"SELECT {_BRONZE_SHOWN} FROM one_tx",
    "partition_scoped_key": "SELECT ingestion_day::VARCHAR AS ingestion_day, cancellation_id, min(cancellation_pk) AS cancellation_pk FROM bronze_cancel GROUP BY ALL",
    "orphan_rate": """SELECT count(*) AS total, count(*) FILTER (NOT known) AS orphan_cnt, round(100.0 * count(*) FILTER (NOT known) / nullif(count(*), 0), 4) AS orphan_pct
FROM (SELECT coalesce(original_transaction_id IN (SELECT transaction_id FROM tx), false) AS known FROM cancelled)""",
    "orphans_above": """SELECT * FROM (SELECT count(*) AS total, count(*) FILTER (NOT known) AS orphan_cnt, round(100.0 * count(*) FILTER (NOT known) / nullif(count(*), 0), 4) AS orphan_pct
FROM (SELECT coalesce(original_transaction_id IN (SELECT transaction_id FROM tx), false) AS known FROM cancelled)) WHERE total > 100 AND orphan_pct > 1.0""",
    "count_recon": "SELECT count(*) AS silver_cnt, 0::BIGINT AS failures FROM tx",
    "data_tests": """SELECT 'not_null_user' AS test, count(*) FILTER (user_id IS NULL) AS failures FROM tx UNION ALL SELECT 'unique_key', 0 UNION ALL
SELECT 'unique_transaction_id', count(*) FROM (SELECT 1 FROM tx GROUP BY transaction_id HAVING count(*) > 1) UNION ALL
SELECT 'accepted_currency', count(DISTINCT currency) FROM tx WHERE currency NOT IN ('TGRK', 'PUNK', 'RUB')""",
    "chart_total_revenue": f"SELECT round(sum(gross_revenue_tgrk), 4) AS gross_revenue_tgrk FROM ({_REVENUE.replace('round(sum(s.amount / coalesce(f.rate_to_tgrk, b.rate_to_tgrk)), 4)', 'sum(s.amount / coalesce(f.rate_to_tgrk, b.rate_to_tgrk))')})",
    "chart_total_transactions": f"SELECT sum(tx_cnt)::BIGINT AS tx_cnt FROM {_U_TX} WHERE NOT is_test_user",
    "chart_invalid_refund_pct": f"SELECT round(sum(invalid_refund_cnt) * 100.0 / nullif(sum(cancellations_cnt), 0), 1) AS invalid_refund_pct FROM {_U_CANCEL}",
    "chart_cancellations": f"SELECT sum(cancellations_cnt)::BIGINT AS cancellations_cnt FROM {_U_CANCEL}",
    "chart_user_days": f"SELECT sum(unique_users)::BIGINT AS unique_users FROM ({_COHORTS})",
    "chart_daily_revenue": f"SELECT event_day, gross_revenue_tgrk FROM ({_REVENUE}) WHERE event_day >= strftime(DATE '{TODAY}' - INTERVAL 30 DAY, '%Y-%m-%d')",
    "chart_completed_failed": f"SELECT event_day, sum(completed_cnt)::BIGINT AS completed_cnt, sum(failed_cnt)::BIGINT AS failed_cnt FROM {_U_TX} WHERE NOT is_test_user GROUP BY event_day",
    "chart_hours_real_test": f"SELECT hour_of_day, coalesce(sum(tx_cnt) FILTER (NOT is_test_user), 0)::BIGINT AS real_tx, coalesce(sum(tx_cnt) FILTER (is_test_user), 0)::BIGINT AS test_tx FROM {_U_TX} GROUP BY hour_of_day",
    "chart_purchases_by_hour": f"SELECT hour_of_day, sum(purchase_cnt)::BIGINT AS purchase_cnt FROM {_U_BUYS} GROUP BY hour_of_day",
    "chart_cancellations_by_reason": f"SELECT cancel_day, reason, sum(cancellations_cnt)::BIGINT AS cancellations_cnt FROM {_U_CANCEL} GROUP BY ALL",
    "chart_new_returning": f"SELECT event_day, user_type, unique_users FROM ({_COHORTS})",
    "chart_promo_table": f"SELECT {', '.join(serving.PROMO_COLUMNS)} FROM ({_PROMO}) ORDER BY uses_total DESC, promo_code_id LIMIT 1000",
    "cancellation_rate": f"""SELECT event_day, c AS cancellations_cnt, p AS purchase_cnt, round(round(c * 1.0 / p, 6), 4) AS cancellation_rate
FROM (SELECT cancel_day AS event_day, sum(cancellations_cnt)::BIGINT AS c FROM {_U_CANCEL} GROUP BY ALL) JOIN (SELECT event_day, sum(purchase_cnt)::BIGINT AS p FROM {_U_BUYS} GROUP BY ALL) USING (event_day)""",
}
_RELATIONS = {
    "bronze.transactions": "bronze_tx", "bronze.cancellations": "bronze_cancel", "bronze.exchange_rates": """(SELECT *, update_id || '|' || "timestamp" AS rate_pk FROM bronze_rates)""",
    "bronze.users": "u", "bronze.test_users": "(SELECT user_uuid AS test_user_uuid FROM tu)", "bronze.promo_codes": "pc", "bronze_dlq.late_events": f"({_SELECTS['dlq_late_events']})",
    "silver.transactions_clean": "tx", "silver.cancellations_clean": "cancelled", "silver.exchange_rates_daily": "daily", "silver.exchange_rates_long": "long",
}


def _declared_sql() -> str:
    parts = []
    for table, c in checks.DECLARED.items():
        tests = {f"not_null:{x}": f"count(*) FILTER ({x} IS NULL)" for x in c.not_null} | {f"unique:{x}": f"count({x}) - count(DISTINCT {x})" for x in c.unique}
        tests |= {f"accepted_values:{x}": f"count(*) FILTER ({x} NOT IN {values})" for x, values in c.accepted.items()}
        relation = _RELATIONS.get(table) or f"({_SELECTS['gold_' + table.split('.')[1]]})"
        parts.append(f"SELECT '{table}' AS table_name, unnest({list(tests)}) AS test, unnest([{', '.join(tests.values())}]) AS failures FROM {relation}")
    return "\nUNION ALL ".join(parts)


_SELECTS["declared_tests"] = _declared_sql()
_SLICES = {
    "silver_transactions_clean_day": {"tx_day": f"WHERE event_day = '{RUN_DATE}'"},
    "gold_revenue_day": {"tx_day": f"WHERE event_day = '{RUN_DATE}'"},
    "silver_cancellations_clean_day": {"cancel_day": f"WHERE ingested_at::DATE = DATE '{RUN_DATE}'"},
    "silver_rates_daily_day": {"rate_day": "WHERE rate_day = '2024-01-14'"},
}
ORACLE = {name: _BASE.format(**{"tx_day": "", "rate_day": "", "cancel_day": ""} | _SLICES.get(name, {})) + "\n" + select for name, select in _SELECTS.items()}
