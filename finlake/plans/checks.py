"""The declared data tests of all layers, one pass over each table."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finlake.operators.quality import ERROR, WARN


@dataclass(frozen=True)
class Checks:
    """Columns that hold no null, columns without repeated values, and the values that columns may have (nulls pass)."""

    not_null: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    accepted: dict[str, tuple[str, ...]] = field(default_factory=dict)
    warn_only: tuple[str, ...] = ()

    def severity(self, test: str) -> str:
        kind, column = test.split(":")
        return WARN if kind == "accepted_values" and column in self.warn_only else ERROR


def keyed(key: str, *others: str, **more) -> Checks:
    return Checks((key, *others), (key,), **more)


FLAGS = ("is_user_missing", "is_user_unknown", "is_test_user", "is_test_user_inconsistent", "is_amount_invalid", "is_revenue_eligible", "is_transaction_id_duplicated", "is_promo_expired_at_use")
#: Fixed values of the data.
STATUSES, CURRENCIES, USER_TYPES = ("completed", "pending", "failed", "cancelled"), ("TGRK", "PUNK", "RUB"), ("new", "returning")

DECLARED: dict[str, Checks] = {
    "bronze.transactions": Checks(("composite_pk", "transaction_id")),
    "bronze.cancellations": keyed("cancellation_pk"),
    "bronze.exchange_rates": keyed("rate_pk", "update_id"),
    "bronze.users": keyed("user_id"),
    "bronze.test_users": Checks(("test_user_uuid",)),
    "bronze.promo_codes": keyed("promo_code_id"),
    "bronze_dlq.late_events": Checks(("dlq_pk", "source_table")),
    "silver.transactions_clean": keyed("composite_pk", "transaction_id", "event_day", *FLAGS, accepted={"status": STATUSES}, warn_only=("status",)),
    "silver.cancellations_clean": keyed("cancellation_pk"),
    "silver.exchange_rates_daily": keyed("rate_day", "rate_tgrk_punk", "rate_tgrk_rub"),
    "silver.exchange_rates_long": keyed("rate_day_currency", "rate_day", "currency", "rate_to_tgrk", accepted={"currency": CURRENCIES}, warn_only=("currency",)),
    "gold.transactions_by_hour": keyed("pk", "updated_at"),
    "gold.purchases_by_hour": keyed("pk", "updated_at"),
    "gold.revenue_daily": keyed("event_day", "updated_at"),
    "gold.refunds_daily": keyed("cancel_day", "updated_at"),
    "gold.promo_codes_analysis": Checks(("promo_code_id",)),
    "gold.cancellations_summary": keyed("pk", "cancel_day", "reason", "updated_at"),
    "gold.user_cohorts": keyed("pk", "event_day", "user_type", "updated_at", accepted={"user_type": USER_TYPES}),
    "gold.promo_expired_usage_daily": keyed("event_day", "updated_at"),
    "gold.dq_summary_daily": keyed("event_day", "updated_at"),
}


def failures(table: str, df: DataFrame) -> DataFrame:
    """table_name, test, failures: rows with a null, rows that repeat a value, rows with another value."""
    checks = DECLARED[table]
    counts = {f"not_null:{c}": F.count_if(F.col(c).isNull()) for c in checks.not_null}
    counts |= {f"unique:{c}": F.count(c) - F.countDistinct(c) for c in checks.unique}
    counts |= {f"accepted_values:{c}": F.count_if(~F.col(c).isin(*values)) for c, values in checks.accepted.items()}
    one = df.agg(*[c.alias(name) for name, c in counts.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("test"), F.col(f"`{name}`").alias("failures")) for name in counts])
    return one.select(F.lit(table).alias("table_name"), F.explode(pairs).alias("r")).select("table_name", "r.test", "r.failures")


def all_failures(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, [failures(name, df) for name, df in tables.items()])


def assert_passed(found: DataFrame) -> list[tuple[str, str, int]]:
    """Raises on failed tests of severity error; returns those of severity warn. At most one row per declared test is read."""
    bad = [(r["table_name"], r["test"], r["failures"]) for r in found.where("failures > 0").collect()]
    if errors := [x for x in bad if DECLARED[x[0]].severity(x[1]) == ERROR]:
        raise AssertionError(f"data tests failed: {errors}")
    return bad


def unpopulated(tables: dict[str, DataFrame]) -> list[str]:
    """Names of the tables without a row."""
    return sorted(name for name, df in tables.items() if df.isEmpty())
