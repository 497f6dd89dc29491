"""The driver's tables as source-shaped frames, with ``loaded_at`` and POSITION, the order of delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finlake.functions.columns import CANCELLED_AT, with_cancellation_keys, with_rate_keys, with_transaction_keys
from finlake.operators.dedup import POSITION

EPOCH = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id() -> Column:
    return F.col("event_id")


def _position() -> Column:
    """The table's ids rise with its rows."""
    return _id().alias(POSITION)


def _loaded(days: int):
    """Midnight, ``days`` after the event's day."""
    return F.date_add(F.to_date("ts"), days).cast("timestamp_ntz")


def transactions(events: DataFrame) -> DataFrame:
    """Some ids repeat, users are missing or unknown, amounts invalid."""
    user = F.when(_id() % 37 == 0, F.lit(None).cast("long")).when(_id() % 41 == 0, -F.col("user_id") - 1).otherwise(F.col("user_id"))
    amount = F.when(_id() % 53 == 0, F.lit(None).cast("double")).when(_id() % 59 == 0, -F.col("value")).otherwise(F.col("value"))
    kind = F.when(F.col("event_type") == "signup", "transfer").when(F.col("event_type") == "error", "refund").otherwise("purchase")
    status = F.when(_id() % 10 <= 6, "completed").when(_id() % 10 == 7, "pending").when(_id() % 10 == 8, "failed").otherwise("cancelled")
    return events.select(
        F.when(_id() % 20 == 1, _id() - 1).otherwise(_id()).alias("transaction_id"), user.alias("user_id"), F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("user_uuid"),
        amount.alias("amount"), F.element_at(F.array(*map(F.lit, ("TGRK", "PUNK", "XXX", "RUB", "RUB"))), (_id() % 5 + 1).cast("int")).alias("currency"),
        kind.alias("transaction_type"), F.when(_id() % 4 == 0, F.expr("(event_id div 4) % 250")).alias("promo_code_id"), status.alias("status"),
        F.expr(EPOCH).alias("created_at"), _loaded(1).alias("loaded_at"), _position(),
    )


def redelivered(events: DataFrame) -> DataFrame:
    """A later version of one transaction in a hundred: same keys, failed, loaded a day later."""
    again = transactions(events.where(_id() % 100 == 0))
    return again.withColumns({"status": F.lit("failed"), "loaded_at": F.col("loaded_at") + F.expr("INTERVAL 1 DAY")})


def settled(bronze: DataFrame) -> DataFrame:
    """The batch's side of a cutover, of all days: it takes what is final, so pending transactions are with the stream only."""
    return bronze.where("status <> 'pending'")


def streamed(bronze: DataFrame) -> DataFrame:
    """The stream's side, of all days: every row, marked in its status, five days newer and without promo codes."""
    return bronze.withColumns({"status": F.concat(F.lit("stream-"), "status"), "ingested_at": F.col("ingested_at") + F.expr("INTERVAL 5 DAYS")}).drop("promo_code_id")


def users(customer: DataFrame) -> DataFrame:
    return customer.select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("u-"), F.col("c_custkey").cast("string")).alias("user_uuid"), (F.col("c_acctbal") < 0).alias("is_test_user"))


def test_users(customer: DataFrame) -> DataFrame:
    return customer.where("c_custkey % 7 = 0").select(F.concat(F.lit("u-"), F.col("c_custkey").cast("string")).alias("test_user_uuid"))


def promo_codes(part: DataFrame) -> DataFrame:
    expiry = F.expr("cast(date_add(DATE'2024-01-01', cast(p_partkey % 30 as int)) as string)")
    return part.where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("promo_code_id"), F.col("p_name").alias("code"), F.col("p_size").cast("long").alias("max_uses"), expiry.alias("expiry_date"))


def exchange_rates(events: DataFrame) -> DataFrame:
    quoted = events.where((_id() % 331 == 150) & (F.dayofmonth("ts") >= 4) & (F.dayofmonth("ts") % 3 != 0))
    return quoted.select(
        _id().alias("update_id"), F.expr(EPOCH).alias("timestamp"), (1 + F.col("value") / 100).alias("rate_tgrk_punk"),
        F.when(_id() % 3 == 0, F.lit(0.0)).otherwise(50 + F.col("value")).alias("rate_tgrk_rub"), _loaded(1).alias("loaded_at"), _position(),
    )


def cancellations(events: DataFrame) -> DataFrame:
    """Ids restart; some transactions are unknown or null, some times are unreadable, a third is loaded a day late."""
    original = F.when(_id() % 70 == 9, F.lit(None).cast("long")).when(_id() % 110 == 19, _id() + 100_000_000).otherwise(_id() - 9)
    at = F.when(_id() % 90 == 29, "n/a").otherwise(F.date_format((F.col("ts") + F.expr("INTERVAL 2 HOURS")).cast("timestamp"), CANCELLED_AT))
    refund = F.when(_id() % 60 == 9, F.lit(None).cast("double")).when(_id() % 60 == 39, -F.col("value")).otherwise(F.col("value"))
    return events.where(_id() % 10 == 9).select(
        (_id() % 50).alias("cancellation_id"), original.alias("original_transaction_id"), F.when(_id() % 40 != 19, F.col("event_type")).alias("reason"),
        at.alias("cancelled_at"), refund.alias("refund_amount"), F.when(_id() % 30 == 9, _loaded(2)).otherwise(_loaded(1)).alias("loaded_at"), _position(),
    )


class Bronze:
    """The bronze tables of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.events = table(spark, sf_dir, "events")
        customer = table(spark, sf_dir, "customer")
        self.users, self.test_users = users(customer), test_users(customer)
        self.promo_codes = promo_codes(table(spark, sf_dir, "part"))

    @property
    def transactions(self) -> DataFrame:
        both = transactions(self.events).unionByName(redelivered(self.events))
        return with_transaction_keys(both, F.col("loaded_at")).drop("loaded_at")

    @property
    def cancellations(self) -> DataFrame:
        return with_cancellation_keys(cancellations(self.events), F.col("loaded_at"), F.to_date("loaded_at")).drop("loaded_at")

    @property
    def rates(self) -> DataFrame:
        return with_rate_keys(exchange_rates(self.events), F.col("loaded_at")).drop("loaded_at")
