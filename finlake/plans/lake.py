"""The tables of the lake: where they are, their keys, and how each is made."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finlake import schemas
from finlake.operators.keyed import KeyedTable
from finlake.operators.routing import watermark_rows

BATCH, STREAM, STREAM_BATCHES = "s3", "kafka", "__kafka_batch__"
SOURCES = ("transactions", "cancellations", "exchange_rates")
#: One watermark table per writer, so that each has a single writer.
WATERMARK_TABLES = (*SOURCES, STREAM)

FLAGS = "is_user_missing boolean, is_user_unknown boolean, is_test_user boolean, is_test_user_inconsistent boolean, is_amount_invalid boolean, is_revenue_eligible boolean, is_transaction_id_duplicated boolean, is_promo_expired_at_use boolean"
_HOURS = "pk string, event_day string, hour_of_day long, is_test_user boolean, tx_cnt long, completed_cnt long, failed_cnt long, updated_at timestamp_ntz"
_BUYS = "pk string, event_day string, hour_of_day long, purchase_cnt long, gross_amount_native double, updated_at timestamp_ntz"
_CANCELLED = "pk string, cancel_day string, reason string, cancellations_cnt long, invalid_refund_cnt long, orphan_cnt long, ambiguous_attribution_cnt long, avg_seconds_to_cancel double, min_seconds_to_cancel long, max_seconds_to_cancel long, total_refund_amount double, updated_at timestamp_ntz"
_DQ = "tx_user_missing long, tx_user_unknown long, tx_test_user long, tx_test_user_inconsistent long, tx_amount_invalid long, tx_id_duplicated long, tx_promo_expired long"


@dataclass(frozen=True)
class Spec:
    schema: str
    key: str
    order: str = "updated_at"
    partition: str | None = None
    global_key: bool = True
    sort: tuple[str, ...] = ()
    buckets: int = 0
    keep: int = 2


SPECS: dict[str, Spec] = {
    "bronze.transactions": Spec(f"{schemas.TRANSACTIONS}, event_day string, composite_pk string, ingested_at timestamp_ntz", "composite_pk", "ingested_at", "event_day", False, ("user_id",)),
    "bronze.cancellations": Spec(f"{schemas.CANCELLATIONS}, cancelled_ts timestamp_ntz, ingestion_day string, event_day string, ingested_at timestamp_ntz, cancellation_pk string", "cancellation_pk", "ingested_at", "ingestion_day", False),
    "bronze.exchange_rates": Spec(f"{schemas.RATES}, rate_pk string, ingested_at timestamp_ntz", "rate_pk", "ingested_at"),
    "bronze.users": Spec(f"{schemas.USERS}, ingested_at timestamp_ntz", "user_id", "ingested_at"),
    "bronze.test_users": Spec(f"{schemas.TEST_USERS}, ingested_at timestamp_ntz", "test_user_uuid", "ingested_at"),
    "bronze.promo_codes": Spec(f"{schemas.PROMO_CODES}, ingested_at timestamp_ntz", "promo_code_id", "ingested_at"),
    "bronze_dlq.late_events": Spec(f"{schemas.DEAD_LETTERS}, ingested_at timestamp_ntz", "dlq_pk", "ingested_at"),
    "silver.transactions_clean": Spec(f"{schemas.TRANSACTIONS}, composite_pk string, created_ts timestamp_ntz, event_day string, ingested_at timestamp_ntz, {FLAGS}", "composite_pk", "ingested_at", "event_day", False),
    "silver.cancellations_clean": Spec("cancellation_pk string, cancellation_id long, original_transaction_id long, reason string, cancelled_ts timestamp_ntz, refund_amount double, event_day string, ingested_at timestamp_ntz, is_refund_invalid boolean", "cancellation_pk", "ingested_at", "event_day", buckets=16),
    "silver.exchange_rates_daily": Spec("rate_day string, update_id long, timestamp long, rate_tgrk_punk double, rate_tgrk_rub double", "rate_day", "timestamp"),
    "silver.exchange_rates_long": Spec("rate_day_currency string, rate_day string, currency string, rate_to_tgrk double, timestamp long", "rate_day_currency", "timestamp"),
    "silver.users_first_seen": Spec("user_id long, first_day string, not_before date", "user_id", "not_before", buckets=16),
    "gold.transactions_by_hour": Spec(_HOURS, "pk"),
    "gold.purchases_by_hour": Spec(_BUYS, "pk"),
    "gold.revenue_daily": Spec("event_day string, gross_revenue_tgrk double, tx_cnt long, tx_rate_missing long, tx_rate_backfilled long, tx_tgrk long, tx_punk long, tx_rub long, updated_at timestamp_ntz", "event_day"),
    "gold.refunds_daily": Spec("cancel_day string, refund_native_sum double, refund_cnt long, invalid_refund_cnt long, updated_at timestamp_ntz", "cancel_day"),
    "gold.cancellations_summary": Spec(_CANCELLED, "pk"),
    "gold.user_cohorts": Spec("pk string, event_day string, user_type string, unique_users long, tx_cnt long, completed_cnt long, revenue_eligible_cnt long, avg_amount double, updated_at timestamp_ntz", "pk"),
    "gold.promo_codes_analysis": Spec("promo_code_id long, code string, max_uses long, expiry_date string, uses_total long, uses_completed long, uses_failed long, first_used_at timestamp_ntz, last_used_at timestamp_ntz, used_after_expiry boolean, over_limit boolean, updated_at timestamp_ntz", "promo_code_id"),
    "gold.promo_expired_usage_daily": Spec("event_day string, promo_uses_total long, promo_uses_expired long, promo_uses_expired_completed long, updated_at timestamp_ntz", "event_day"),
    "gold.dq_summary_daily": Spec(f"event_day string, tx_total long, {_DQ}, updated_at timestamp_ntz", "event_day"),
    "gold.transactions_by_hour_live": Spec(_HOURS, "pk"),
    "gold.purchases_by_hour_live": Spec(_BUYS, "pk"),
    "gold.cancellations_summary_live": Spec(_CANCELLED, "pk"),
    "gold.transactions_by_hour_signed": Spec(_HOURS, "pk"),
    "gold.purchases_by_hour_signed": Spec(f"{_BUYS}, amount_cnt long", "pk"),
    "gold.cancellations_summary_signed": Spec("pk string, cancel_day string, reason string, cancellations_cnt long, invalid_refund_cnt long, total_refund_amount double, updated_at timestamp_ntz", "pk"),
    "gold.exchange_rates_latest": Spec("pair string, rate_ts long, rate_tgrk_punk double, rate_tgrk_rub double", "pair", "rate_ts"),
} | {f"bronze.ingest_watermarks_{name}": Spec(schemas.WATERMARKS, "watermark_id", "committed_at") for name in WATERMARK_TABLES}
LAYERS = tuple(dict.fromkeys(name.split(".")[0] for name in SPECS))


@dataclass(frozen=True)
class Lake:
    """All tables below one folder. With a ``prefix`` they are in the catalogue too, as ``<prefix><layer>.<table>``."""

    spark: SparkSession
    root: str
    prefix: str | None = None

    def table(self, name: str) -> KeyedTable:
        spec = SPECS[name]
        return KeyedTable(f"{self.root}/{name.replace('.', '/')}", spec.schema, (spec.key,), spec.order, spec.partition, spec.global_key, spec.sort, spec.buckets, spec.keep, name=None if self.prefix is None else f"{self.prefix}{name}")

    def read(self, name: str) -> DataFrame:
        return self.table(name).read(self.spark)

    def bootstrap(self) -> None:
        """Schemas, empty tables, and one sentinel row in each watermark table that has none; a second call changes nothing."""
        for layer in LAYERS if self.prefix is not None else ():
            self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS {self.prefix}{layer}")
        for name in SPECS:
            table = self.table(name)
            if table.version(self.spark) is None:
                table.create(self.spark)
                if "ingest_watermarks" in name:
                    shard = name.split(".")[1]
                    table.upsert(self.spark.createDataFrame([(f"__bootstrap__|__init__|{shard}", "__bootstrap__", "__init__", 0, "1970-01-01T00:00:00")], schemas.WATERMARKS))

    def attach(self) -> list[str]:
        """Temporary views ``<layer>_<table>`` of the newest versions, for ``spark.table`` and SQL; their names."""
        names = {name: name.replace(".", "_") for name in SPECS}
        for name, view in names.items():
            self.read(name).createOrReplaceTempView(view)
        return list(names.values())

    def mark(self, table: str, partitions: DataFrame, rows: int | Column, committed_at: str, producer: str = BATCH) -> None:
        """Publishes that ``producer`` has closed ``partitions`` (their first column) of ``table``; ``rows``: a number, or a column of them."""
        if producer == BATCH and table not in SOURCES or producer not in (BATCH, STREAM):
            raise ValueError(f"no watermark table of {producer} for {table}")
        shard = STREAM if producer == STREAM else table
        self.table(f"bronze.ingest_watermarks_{shard}").upsert(watermark_rows(table, producer, partitions, rows, committed_at))

    def marks(self, *sources: str) -> DataFrame:
        """Watermark rows that batch has written, without the sentinels."""
        found = [self.read(f"bronze.ingest_watermarks_{name}") for name in sources or SOURCES]
        out = found[0]
        for df in found[1:]:
            out = out.unionByName(df)
        return out.where(F.col("table_name") != "__bootstrap__")

    @property
    def dimensions(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return tuple(self.read(f"bronze.{name}") for name in ("users", "test_users", "promo_codes"))
