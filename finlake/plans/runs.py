"""Nightly runs over a lake: ingest of source days, reference snapshots, models in order, and their tests."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finlake import schemas
from finlake.functions.columns import with_cancellation_keys, with_rate_keys, with_transaction_keys
from finlake.operators.dedup import cutover
from finlake.operators.joins import counted
from finlake.operators.keyed import delete, exists
from finlake.operators.quality import orphan_rate, orphans_above, same_count
from finlake.operators.routing import NONPARTITIONED, is_ready, malformed
from finlake.plans import checks, gold, silver
from finlake.plans.lake import Lake
from finlake.sources.jsonl import BAD, DAY, Source, load_snapshots, scan_days

#: Reference tables; the first must be there.
REFERENCES = {"users": schemas.USERS, "test_users": schemas.TEST_USERS, "promo_codes": schemas.PROMO_CODES}
REQUIRED = frozenset({"users"})


def _prepared(source: Source, rows: DataFrame, ingested_at: Column) -> DataFrame:
    if source.name == "transactions":
        return with_transaction_keys(rows, ingested_at)
    if source.name == "exchange_rates":
        return with_rate_keys(rows, ingested_at)
    # A cancellation belongs to the day that it was delivered with.
    return with_cancellation_keys(rows, ingested_at, F.col(DAY))


def ingest(lake: Lake, source: Source, days: Iterable[str], ingested_at: Column, committed_at: str) -> int:
    """Reads source days, merges them over what a stream left in their partitions, writes, and marks the days closed; the number of source records.

    The source is read once: its lines are set aside, and records are counted by day
    from two columns of that. Lines that are no records go to the dead letters. A day
    without files closes with no rows, so that the readiness gate stays shut for it
    where rows are needed. Rows without a partition value go nowhere else either and
    stay in their own partition.
    """
    spark, days = lake.spark, list(dict.fromkeys(days))
    table = lake.table(f"bronze.{source.name}")
    aside, good = f"{table.path}/_source-{uuid.uuid4().hex}", F.col(BAD).isNull()
    lines = scan_days(spark, source, days)
    try:
        lines.write.parquet(aside)
        lines = spark.read.schema(lines.schema).parquet(aside)
        per_day = lines.groupBy(DAY).agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad")).collect()  # one row for each day
        got = {r[DAY]: r["good"] for r in per_day}
        prepared = _prepared(source, lines.where(good).drop(BAD), ingested_at).select(*table.columns)
        if table.partition:
            values = [r[0] for r in prepared.select(table.partition).distinct().collect()]
            left = table.read(spark, {table.folder(spark, v) for v in values})
            table.overwrite_partitions(cutover(prepared, left, table.key[0]), values)
        else:
            table.upsert(prepared)
        if any(r["bad"] for r in per_day):
            dead = malformed(lines.where(~good), source.name, BAD, DAY).withColumn("ingested_at", ingested_at)
            lake.table("bronze_dlq.late_events").upsert(dead)
    finally:
        delete(spark, aside)
    n = [got.get(d, 0) for d in days]
    closed = [(f"day={d}", k) for d, k in zip(days, n)] if table.partition else [(NONPARTITIONED, sum(n))]
    lake.mark(source.name, spark.createDataFrame(closed, "p string, n long"), F.col("n"), committed_at)
    return sum(n)


def load_references(lake: Lake, root: str, ingested_at: Column, strict: bool = True) -> list[str]:
    """Replaces the reference tables by the snapshots under ``root``; the names that were not there. ``strict``: none but REQUIRED ones may be missing."""
    found, missing = load_snapshots(lake.spark, root, REFERENCES, ingested_at, REQUIRED if strict else frozenset())
    for name, df in found.items():
        table = lake.table(f"bronze.{name}")
        table.snapshot(df.select(*table.columns))
    return missing


def ready(lake: Lake, day: str) -> bool:
    return bool(is_ready(lake.marks(), day).first()["ready"])


def source_ready(lake: Lake, source: Source, day: str) -> bool:
    """Whether the day is there at all; a run without it ends early."""
    return exists(lake.spark, source.path.format(day=day))


#: Name -> (lake, run date or None for all history) -> rows; in the order that they depend on each other.
MODELS: dict[str, Callable[[Lake, str | None], DataFrame]] = {
    "silver.transactions_clean": lambda w, d: silver.transactions_clean(w.read("bronze.transactions"), *w.dimensions, run_date=d),
    "silver.cancellations_clean": lambda w, d: silver.cancellations_clean(w.read("bronze.cancellations"), d),
    "silver.exchange_rates_daily": lambda w, d: silver.rates_daily(w.read("bronze.exchange_rates"), d),
    "silver.exchange_rates_long": lambda w, d: silver.rates_long(w.read("silver.exchange_rates_daily")),
    "silver.users_first_seen": lambda w, d: gold.first_seen(w.read("silver.transactions_clean"), d),
    "gold.transactions_by_hour": lambda w, d: gold.transactions_by_hour(w.read("silver.transactions_clean"), d),
    "gold.purchases_by_hour": lambda w, d: gold.purchases_by_hour(w.read("silver.transactions_clean"), d),
    "gold.revenue_daily": lambda w, d: gold.revenue_daily(w.read("silver.transactions_clean"), w.read("silver.exchange_rates_long"), d),
    "gold.refunds_daily": lambda w, d: gold.refunds_daily(w.read("silver.cancellations_clean"), d),
    "gold.cancellations_summary": lambda w, d: gold.cancellations_summary(w.read("silver.cancellations_clean"), w.read("silver.transactions_clean"), d),
    "gold.user_cohorts": lambda w, d: gold.user_cohorts(w.read("silver.transactions_clean"), d, counted(w.read("silver.users_first_seen"))),
    "gold.promo_codes_analysis": lambda w, d: gold.promo_codes_analysis(w.read("silver.transactions_clean"), w.read("bronze.promo_codes"), updated_at=F.localtimestamp()),
    "gold.promo_expired_usage_daily": lambda w, d: gold.promo_expired_usage_daily(w.read("silver.transactions_clean"), d),
    "gold.dq_summary_daily": lambda w, d: gold.dq_summary_daily(w.read("silver.transactions_clean"), d),
}


#: What each model reads of the others; models of one level run side by side.
LEVELS: tuple[tuple[str, ...], ...] = (
    ("silver.transactions_clean", "silver.cancellations_clean", "silver.exchange_rates_daily"),
    ("silver.exchange_rates_long", "silver.users_first_seen"),
    tuple(name for name in MODELS if name.startswith("gold.")),
)


def run_models(lake: Lake, run_date: str | None = None, only: Iterable[str] = (), at_once: int = 4) -> list[str]:
    """Merges each model's rows of the day (of all history without one) into its table; the names of the tables that were written.

    Up to ``at_once`` models of a level run side by side, each in a pool of its own
    (which counts where Spark's scheduler is fair) and under one tag. When one fails,
    the jobs of the others are cancelled by the tag, no later level begins, and the
    error is raised; tables whose commit did not come stay as they were.
    """
    wanted, spark, tag, written = set(only) or set(MODELS), lake.spark, f"models-{uuid.uuid4().hex}", []

    def run(name: str) -> bool:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        spark.addTag(tag)
        try:
            return lake.table(name).upsert(MODELS[name](lake, run_date))
        finally:
            spark.removeTag(tag)
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    for level in LEVELS:
        names = [name for name in level if name in wanted]
        with ThreadPoolExecutor(max(1, min(at_once, len(names)))) as pool:
            started = {pool.submit(inheritable_thread_target(spark)(run), name): name for name in names}
            done, waiting = wait(started, return_when=FIRST_EXCEPTION)
            if failed := next((x for x in done if x.exception()), None):
                for x in waiting:
                    x.cancel()
                spark.interruptTag(tag)
                wait(started)
                raise failed.exception()
        written += [name for x, name in started.items() if x.result()]
    return written


def test_tables(lake: Lake) -> DataFrame:
    """table_name, test, failures: the declared tests, on the written tables."""
    return checks.all_failures({name: lake.read(name) for name in checks.DECLARED})


test_tables.__test__ = False  # not a test of this repository


def nightly(lake: Lake, sources: dict[str, Source], days: str | list[str], ingested_at: Column, committed_at: str, references: str | None = None) -> list[tuple[str, str, int]] | None:
    """Reference snapshots, bronze, then (only if every source is ready) silver, gold and the tests of one day; the warnings, or None where the day was not there or not ready.

    Several ``days`` are a first fill: all must be there, and the models run over all
    history. A day without transactions ends the run before anything is read. ``references``:
    the folder of the snapshots; without it the tables stay as they are.
    """
    days = [days] if isinstance(days, str) else list(days)
    if not all(source_ready(lake, sources["transactions"], day) for day in days):
        return None
    if references:
        load_references(lake, references, ingested_at)
    for source in sources.values():
        ingest(lake, source, days, ingested_at, committed_at)
    if not all(ready(lake, day) for day in days):
        return None
    run_models(lake, days[0] if len(days) == 1 else None)
    warned = checks.assert_passed(test_tables(lake))
    orphans = orphans_above(orphan_rate(lake.read("silver.cancellations_clean"), lake.read("silver.transactions_clean"), "original_transaction_id", "transaction_id"))
    if n := orphans.count():
        warned.append(("silver.cancellations_clean", "orphan_rate", n))
    if not same_count(lake.read("bronze.transactions"), lake.read("silver.transactions_clean"), "composite_pk", "ingested_at").isEmpty():
        warned.append(("silver.transactions_clean", "same_count", 1))
    return warned
