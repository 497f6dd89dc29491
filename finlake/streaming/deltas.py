"""Live aggregates from signed deltas: what a new version of a key adds, less what its former version had added.

The state store holds, for each key, what its newest version counts for; keys lie in
slots by their hash. A trigger reads its new rows, the state of their slots and the few
rows of the aggregate they belong to; it does not read the day again, however much there is of it. Sums and
counts follow from deltas. The newest load time of a group can fall when its newest
row leaves it; only then is the group counted anew from the log's days.

Deltas must not be applied twice, so each commit of an aggregate names its batch,
and a batch that comes again after a crash is passed over. Flags that need
dimensions are those at a row's arrival: a query takes the snapshots that
``dimensions`` gives when it starts.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from finlake.functions.columns import hour_of
from finlake.operators.dedup import POSITION
from finlake.operators.keyed import KeyedTable
from finlake.plans.gold import key
from finlake.plans.silver import enriched
from finlake.streaming import live

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


#: Parts that the keys are dealt into by their hash; a checkpoint holds for one number only.
SLOTS = 1 << 14
#: Place of a version without a position: behind all others.
_LAST = (1 << 63) - 1
#: A version: its load time, its place in the order of delivery, a hash for what is still equal, and what it counts for.
_VERSION = {"at": "long", "place": "long", "tie": "long", "value": "string"}


def _step(_: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The rows to take off and to add for the keys of one slot; a key's newest version wins, of equal ones the first delivered."""
    former = {k: version for k, *version in zip(*state.get)} if state.exists else {}
    newest: dict[str, list] = {}
    for batch in batches:
        for k, *version in zip(*(batch[c].tolist() for c in ("key", *_VERSION))):
            best = newest.get(k) or former.get(k)
            if best is None or (version[0], -version[1], -version[2]) > (best[0], -best[1], -best[2]):
                newest[k] = version
    if newest:
        pairs = [(-1, former[k]) for k in newest if k in former] + [(1, version) for version in newest.values()]
        kept = former | newest
        state.update((list(kept), *map(list, zip(*kept.values()))))
        yield pd.DataFrame([(sign, version[3], version[0]) for sign, version in pairs], columns=["sign", "value", "at"])


def signed(rows: DataFrame, key: str, by: Column, slots: int = SLOTS) -> DataFrame:
    """A stream of (sign, value, at) from a stream of versions: ``key``, ``ingested_at``, POSITION, and ``by``, a struct of what a version counts for.

    A tie of load times goes as in ``latest``: to the first delivered, then to the
    smaller hash, the column ``tie``. A call of the step and a value of the state hold
    the keys of one slot, so a first fill of many keys costs a call for each slot and
    not for each key, and a trigger reads the slots of its keys.
    """
    at = F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, ingested_at)")
    place = F.coalesce(POSITION, F.lit(_LAST))
    slot = F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")
    # JSON keeps nulls and whole numbers as they are on their way through pandas.
    packed = rows.select(slot.alias("slot"), F.col(key).alias("key"), at.alias("at"), place.alias("place"), "tie", F.to_json(by).alias("value"))
    kept = ", ".join(f"{c} array<{kind}>" for c, kind in {"key": "string", **_VERSION}.items())
    return packed.groupBy("slot").applyInPandasWithState(_step, "sign int, value string, at long", kept, "update", GroupStateTimeout.NoTimeout)


@dataclass(frozen=True)
class Aggregate:
    """Groups ``by`` and sums of ``measures`` (SQL) over the contributions that ``where`` holds for; the first measure counts rows."""

    table: str
    by: tuple[str, ...]
    measures: dict[str, str]
    where: str = "true"
    finish: dict[str, str] = field(default_factory=dict)

    def summed(self, deltas: DataFrame) -> DataFrame:
        newest = lambda side: F.max(F.when(side, F.expr(f"timestampadd(MICROSECOND, at, {_EPOCH})")))
        return deltas.where(self.where).groupBy(*self.by).agg(
            *[F.sum(F.col("sign") * F.expr(m)).alias(name) for name, m in self.measures.items()], newest(F.col("sign") > 0).alias("__added"), newest(F.col("sign") < 0).alias("__removed")
        ).select(key(*self.by), "*")

    def apply(self, table: KeyedTable, deltas: DataFrame, again: Callable[[DataFrame], DataFrame], source: tuple[str, int]) -> None:
        """Adds ``deltas`` to the table. ``again`` gives all contributions of some groups (``by``), for those whose newest row left."""
        spark, count = deltas.sparkSession, next(iter(self.measures))
        change = self.summed(deltas)
        old = table.read(spark).select(F.col("pk").alias("__pk"), *[F.col(m).alias(f"__{m}") for m in self.measures], F.col("updated_at").alias("__at"))
        now = change.join(old, F.col("pk").eqNullSafe(F.col("__pk")), "left")
        now = now.withColumns({m: F.coalesce(F.col(f"__{m}"), F.lit(0)) + F.col(m) for m in self.measures} | {"updated_at": F.greatest("__at", "__added")})
        now = now.withColumn("__stale", F.coalesce((F.col("__removed") >= F.col("updated_at")) & (F.col(count) > 0), F.lit(False))).persist()
        try:
            fresh = now.where("not __stale")
            stale = now.where("__stale").select("pk", *self.by)
            if not stale.isEmpty():
                counted = self.summed(again(stale).withColumn("sign", F.lit(1)))
                asked = counted.join(stale.select(F.col("pk").alias("__pk")), F.col("pk").eqNullSafe(F.col("__pk")), "left_semi")
                fresh = fresh.select("pk", *self.by, *self.measures, "updated_at").unionByName(asked.withColumnRenamed("__added", "updated_at").drop("__removed"))
            table.upsert(fresh.withColumns({c: F.expr(x) for c, x in self.finish.items()}), source, replace=True, gone=F.col(count) == 0)
        finally:
            now.unpersist()


def _n(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("long")


def bought() -> Column:
    """What a transaction counts for."""
    return F.struct(
        "event_day", hour_of("created_at").alias("hour_of_day"), "is_test_user", _n(F.col("status") == "completed").alias("completed"), _n(F.col("status") == "failed").alias("failed"),
        "is_revenue_eligible", F.coalesce("amount", F.lit(0.0)).alias("amount"), _n(F.col("amount").isNotNull()).alias("amounts"),
    )


def cancelled() -> Column:
    """What a cancellation counts for."""
    return F.struct(
        F.col("event_day").alias("cancel_day"), F.coalesce("reason", F.lit("unknown")).alias("reason"), F.col("ingestion_day").cast("string").alias("ingestion_day"),
        _n(F.col("refund_amount").isNull() | (F.col("refund_amount") < 0)).alias("invalid"), F.coalesce("refund_amount", F.lit(0.0)).alias("refund"),
    )


BOUGHT = "event_day string, hour_of_day long, is_test_user boolean, completed long, failed long, is_revenue_eligible boolean, amount double, amounts long"
CANCELLED = "cancel_day string, reason string, ingestion_day string, invalid long, refund double"

HOURS = Aggregate("gold.transactions_by_hour_signed", ("event_day", "hour_of_day", "is_test_user"), {"tx_cnt": "1L", "completed_cnt": "completed", "failed_cnt": "failed"})
BUYS = Aggregate(
    "gold.purchases_by_hour_signed", ("event_day", "hour_of_day"), {"purchase_cnt": "1L", "gross_amount_native": "amount", "amount_cnt": "amounts"},
    "is_revenue_eligible and not is_test_user", {"gross_amount_native": "if(amount_cnt > 0, gross_amount_native, null)"},
)
REASONS = Aggregate("gold.cancellations_summary_signed", ("cancel_day", "reason"), {"cancellations_cnt": "1L", "invalid_refund_cnt": "invalid", "total_refund_amount": "refund"})


def _versions(spark: SparkSession, folders: live.Folders, table: str) -> DataFrame:
    rows = live.changes(spark, folders, table).drop("batch", "log_day")
    return rows.withColumn("tie", F.xxhash64(*rows.columns))


def run(spark: SparkSession, folders: live.Folders, dimensions: live.Dimensions, table: Callable[[str], KeyedTable], closed: Callable[[str], datetime.date | None], trigger: dict) -> list[StreamingQuery]:
    """Two queries over the stream's log that keep HOURS, BUYS and REASONS in the tables that ``table`` gives by name."""

    def days(groups: DataFrame, day: str) -> list[str | None]:
        return [r[0] for r in groups.select(day).distinct().collect()]

    def bought_again(groups: DataFrame) -> DataFrame:
        rows = live.bronze(spark, folders, "transactions", "composite_pk", days(groups, "event_day"))
        return _unpacked(enriched(rows, *dimensions()).select(F.to_json(bought()).alias("value"), F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, ingested_at)").alias("at")), BOUGHT)

    def cancelled_again(groups: DataFrame) -> DataFrame:
        rows = live.bronze(spark, folders, "cancellations", "cancellation_pk", days(groups, "cancel_day"))
        return _unpacked(rows.select(F.to_json(cancelled()).alias("value"), F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, ingested_at)").alias("at")), CANCELLED)

    def of(name: str, schema: str, day: str, aggregates: tuple[Aggregate, ...], again: Callable[[DataFrame], DataFrame]):
        def handle(batch: DataFrame, number: int) -> None:
            # Days that the batch side has closed meanwhile are left as they are.
            deltas = live.route(_unpacked(batch, schema), day, closed(name))[0].persist()
            try:
                for x in aggregates:
                    x.apply(table(x.table), deltas, again, (f"signed-{name}", number))
            finally:
                deltas.unpersist()

        return handle

    users, test_users, promo_codes = dimensions()
    tx = signed(enriched(_versions(spark, folders, "transactions"), users, test_users, promo_codes), "composite_pk", bought())
    gone = signed(_versions(spark, folders, "cancellations"), "cancellation_pk", cancelled())
    started = []
    for name, stream, handler in (
        ("transactions", tx, of("transactions", BOUGHT, "event_day", (HOURS, BUYS), bought_again)),
        ("cancellations", gone, of("cancellations", CANCELLED, "ingestion_day", (REASONS,), cancelled_again)),
    ):
        writer = stream.writeStream.outputMode("update").foreachBatch(handler).option("checkpointLocation", folders.checkpoint(f"signed-{name}"))
        started.append(writer.trigger(**trigger).start())
    return started


def _unpacked(rows: DataFrame, schema: str) -> DataFrame:
    return rows.select(*[c for c in rows.columns if c != "value"], F.from_json("value", schema).alias("v")).select("*", "v.*").drop("v")
