"""Queries that write tables, by batch or stream, and read them back; with the same in DuckDB SQL.

What several queries read is written once in a session for the tables of a
directory as they stand; a second call reads it.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlake.functions.columns import time_of_micros, with_transaction_keys
from finlake.operators.dedup import POSITION, aligned
from finlake.operators.keyed import KeyedTable, put_text
from finlake.plans import catalogue, checks, gold, runs
from finlake.plans.catalogue import BRONZE_TX, RUN_DATE, SETTLED_UNTIL, Warehouse, shown
from finlake.plans.lake import SPECS, WATERMARK_TABLES, Lake
from finlake.sources import adapters
from finlake.sources.jsonl import Source, read_days
from finlake.sources.storage import new_folder
from finlake.streaming import deltas, live, progress
from finlake.streaming.changes import follow

BATCH_TIME, MISSING_DAY = "2024-02-01 00:00:00", "2031-01-01"
_made: dict[tuple, tuple[object, object]] = {}


def _stand(spark: SparkSession, sf_dir: str) -> tuple:
    """Names and times of the tables of a directory."""
    at = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return tuple(sorted((x.getPath().getName(), x.getModificationTime(), x.getLen()) for x in found))


def once(make: Callable[[SparkSession, str], object]):
    """``make``, once for each session and directory, and anew where its tables have changed."""

    def get(spark: SparkSession, sf_dir: str):
        key, stand = (make.__name__, spark.sparkContext.applicationId, sf_dir), _stand(spark, sf_dir)
        if key not in _made or _made[key][0] != stand:
            _made[key] = (stand, make(spark, sf_dir))
        return _made[key][1]

    return get


def at_batch():
    return F.lit(BATCH_TIME).cast("timestamp_ntz")


@once
def day_files(spark: SparkSession, sf_dir: str) -> dict[str, Source]:
    """JSON lines by day, as the upstream systems deliver them: final transactions, cancellations, quotes."""
    root, events = new_folder(spark, "days"), adapters.table(spark, sf_dir, "events")
    day = F.to_date("loaded_at") - F.expr("INTERVAL 1 DAY")
    made = {"transactions": adapters.settled(adapters.transactions(events)), "cancellations": adapters.cancellations(events), "exchange_rates": adapters.exchange_rates(events)}
    found = {}
    for name, df in made.items():
        df.withColumn("day", F.date_format(day, "yyyy-MM-dd")).drop("loaded_at", POSITION).repartition("day").write.partitionBy("day").json(f"{root}/{name}")
        schema = {"transactions": runs.schemas.TRANSACTIONS, "cancellations": runs.schemas.CANCELLATIONS, "exchange_rates": runs.schemas.RATES}[name]
        found[name] = Source(name, schema, f"{root}/{name}/day={{day}}", "*.json")
    return found


def days(spark: SparkSession, sf_dir: str) -> list[str]:
    """Every day that has events, and one that has none."""
    found = adapters.table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd")).distinct().collect()
    return sorted(r[0] for r in found) + [MISSING_DAY]


def _ingested(spark: SparkSession, sf_dir: str, wanted: list[str]) -> DataFrame:
    """The batch of ``wanted`` days over what a stream has left in all."""
    lake = Lake(spark, new_folder(spark, "lake"))
    table = lake.table("bronze.transactions")
    first = with_transaction_keys(adapters.transactions(adapters.table(spark, sf_dir, "events")), F.col("loaded_at"))
    table.upsert(aligned(adapters.streamed(first), spark.createDataFrame([], table.schema)))
    runs.ingest(lake, day_files(spark, sf_dir)["transactions"], wanted, at_batch(), BATCH_TIME)
    return table.read(spark).select(*BRONZE_TX, "promo_code_id")


@once
def nightly(spark: SparkSession, sf_dir: str) -> Lake:
    """A lake after one night: bootstrap, and all three sources of one day."""
    lake = Lake(spark, new_folder(spark, "lake"))
    for _ in range(2):
        lake.bootstrap()
    for source in day_files(spark, sf_dir).values():
        runs.ingest(lake, source, [RUN_DATE], at_batch(), BATCH_TIME)
    return lake


def _bronze(spark: SparkSession, sf_dir: str, prefix: str | None = None) -> Lake:
    """A lake whose bronze tables got two deliveries of transactions."""
    lake, b = Lake(spark, new_folder(spark, "lake"), prefix), adapters.Bronze(spark, sf_dir)
    lake.bootstrap()
    for version in (adapters.transactions(b.events), adapters.redelivered(b.events)):
        lake.table("bronze.transactions").upsert(with_transaction_keys(version, F.col("loaded_at")))
    lake.table("bronze.cancellations").upsert(b.cancellations.withColumn("ingestion_day", F.col("ingestion_day").cast("string")))
    lake.table("bronze.exchange_rates").upsert(b.rates)
    for name, df in (("users", b.users), ("test_users", b.test_users), ("promo_codes", b.promo_codes)):
        lake.table(f"bronze.{name}").snapshot(aligned(df.withColumn("ingested_at", at_batch()), lake.read(f"bronze.{name}")))
    return lake


@once
def history(spark: SparkSession, sf_dir: str) -> Lake:
    """All models over all history; the tables have names in the catalogue."""
    lake = _bronze(spark, sf_dir, f"lake_{uuid.uuid4().hex[:8]}_")
    runs.run_models(lake)
    return lake


@once
def one_day(spark: SparkSession, sf_dir: str) -> Lake:
    """All models of one day, twice: a run that is repeated changes nothing."""
    lake = _bronze(spark, sf_dir)
    for _ in range(2):
        runs.run_models(lake, RUN_DATE)
    return lake


@once
def streamed(spark: SparkSession, sf_dir: str) -> tuple[Lake, live.Folders]:
    """All messages through the stream, in several batches, and a restart that finds nothing new."""
    b, root = adapters.Bronze(spark, sf_dir), new_folder(spark, "stream")
    frames = [("transaction", adapters.transactions(b.events)), ("transaction", adapters.redelivered(b.events)), ("cancellation", adapters.cancellations(b.events)), ("exchange_rate", adapters.exchange_rates(b.events))]
    messages = reduce(DataFrame.union, [df.select(F.to_json(F.struct(F.lit(kind).alias("_source"), *[c for c in df.columns if c not in ("loaded_at", POSITION)])).alias("value"), F.col("loaded_at").alias("timestamp"), (F.col(POSITION) * len(frames) + n).alias("offset")) for n, (kind, df) in enumerate(frames)])
    numbered = messages.repartition(6)
    numbered.union(spark.createDataFrame([("not json", None, -1)], numbered.schema)).write.json(f"{root}/topic")
    lake, folders = Lake(spark, f"{root}/lake"), live.Folders(f"{root}/stream")
    watched = progress.Progress(spark, f"{root}/progress")
    put_text(spark, f"{root}/progress/README", "one file for each event")
    spark.streams.addListener(watched)
    closed = lambda table: datetime.date.fromisoformat(SETTLED_UNTIL) if table != "exchange_rates" else None
    mark = lambda batch, offset: lake.mark("__kafka_batch__", spark.createDataFrame([(f"offset={offset}",)], "p string"), 0, f"{batch:09d}", "kafka")
    live_name = lambda name: f"gold.{name}" if name == "exchange_rates_latest" else f"gold.{name}_live"
    for _ in range(2):
        live.replay(live.topic_dump(spark, f"{root}/topic", files=3), folders, lambda: (b.users, b.test_users, b.promo_codes), lambda name, df: lake.table(live_name(name)).upsert(df), closed, at_batch(), mark)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    spark.streams.removeListener(watched)
    return lake, folders


class Crash(Exception):
    """Stands for a driver that is lost between a commit and the stream's checkpoint."""


@once
def signed(spark: SparkSession, sf_dir: str) -> Lake:
    """Aggregates by signed deltas over the stream's log, with a crash right after a commit, and restarts."""
    lake, folders = streamed(spark, sf_dir)
    b, crashes = adapters.Bronze(spark, sf_dir), ["once"]
    closed = lambda table: datetime.date.fromisoformat(SETTLED_UNTIL) if table != "exchange_rates" else None

    @dataclass(frozen=True)
    class Failing(KeyedTable):
        def upsert(self, *args, **more) -> bool:
            done = super().upsert(*args, **more)
            if crashes:
                raise Crash(crashes.pop())
            return done

    for _ in range(3):
        table = (lambda name: Failing(**vars(lake.table(name)))) if crashes else lake.table
        for query in deltas.run(spark, folders, lambda: (b.users, b.test_users, b.promo_codes), table, closed, {"availableNow": True}):
            try:
                query.awaitTermination()
            except Exception:
                if crashes or table == lake.table:
                    raise
    return lake


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the ingest read, by the progress of its batches, and whether it took several."""
    _, folders = streamed(spark, sf_dir)
    seen = spark.read.schema(progress.PROGRESS).option("pathGlobFilter", "*.json").json(f"{folders.root.removesuffix('/stream')}/progress")
    first = spark.read.json(f"{folders.checkpoint('ingest')}/metadata").select(F.col("id").alias("query"))
    rows = seen.where("event = 'progress'").join(first, "query", "left_semi")
    return rows.agg(F.sum("rows").alias("messages"), (F.countDistinct("batch") > 1).alias("several"))


CHANGES = "composite_pk string, status string, event_day string, ingested_at timestamp_ntz"


def _change_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four upserts of a keyed table; a stream begins after the second, is restarted after the fourth, and files what it is given."""
    root, events = new_folder(spark, "changes"), adapters.table(spark, sf_dir, "events")
    table = KeyedTable(f"{root}/tx", CHANGES, ("composite_pk",), "ingested_at", buckets=16, keep=4)
    keyed = lambda df: with_transaction_keys(df, F.col("loaded_at")).select(*BRONZE_TX)
    again = keyed(adapters.redelivered(events))
    later = again.withColumns({"status": F.lit("cancelled"), "ingested_at": F.expr("ingested_at + INTERVAL 5 DAYS")})

    def take(changes: DataFrame, version: int, number: int) -> None:
        changes.select(F.lit(version).cast("long").alias("version"), "change", F.col("row.composite_pk").alias("composite_pk"), F.col("before.status").alias("before"), F.col("row.status").alias("status")).write.mode("overwrite").parquet(f"{root}/seen/batch={number}")

    def go() -> None:
        follow(table, spark, take, f"{root}/checkpoint", start=1).awaitTermination()

    table.upsert(keyed(adapters.transactions(events.where("event_id % 7 <> 0"))))
    table.upsert(again)
    go()  # nothing has come after version 1
    table.upsert(later)
    go()
    table.upsert(keyed(adapters.transactions(events.where("event_id % 7 = 0"))))
    go()
    go()
    return spark.read.parquet(f"{root}/seen").drop("batch")


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by commit and partition, as they were counted while they were written."""
    return history(spark, sf_dir).table("bronze.transactions").commits(spark)


def _bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose files have broken lines between their records: all are in the dead letters."""
    root, events = new_folder(spark, "broken"), adapters.table(spark, sf_dir, "events")
    tx = adapters.settled(adapters.transactions(events))
    good = tx.select(F.to_json(F.struct(*[c for c in tx.columns if c not in ("loaded_at", POSITION)])).alias("value"), F.to_date(F.col("loaded_at") - F.expr("INTERVAL 1 DAY")).alias("day"))
    bad = events.where("event_id % 97 = 5").select(F.concat(F.lit('{"transaction_id": '), F.expr("event_id div 970"), F.lit(', "sta')).alias("value"), F.to_date("ts").alias("day"))
    good.unionByName(bad).repartition("day").write.partitionBy("day").text(root + "/tx")
    lake = Lake(spark, f"{root}/lake")
    runs.ingest(lake, Source("transactions", runs.schemas.TRANSACTIONS, f"{root}/tx/day={{day}}", "*.txt"), days(spark, sf_dir), at_batch(), BATCH_TIME)
    line = F.get_json_object("payload_json", "$.line")
    return lake.read("bronze_dlq.late_events").select("source_table", "reason", "event_day_observed", line.alias("line"), F.get_json_object("payload_json", "$.times").cast("long").alias("times"))


@once
def whole_nights(spark: SparkSession, sf_dir: str) -> tuple[Lake, dict[str, bool]]:
    """A night over all days and one over a day that is not there, with reference snapshots from files; which of them ran."""
    lake, root, b = Lake(spark, new_folder(spark, "lake")), new_folder(spark, "references"), adapters.Bronze(spark, sf_dir)
    lake.bootstrap()
    for name, df in (("users", b.users), ("test_users", b.test_users), ("promo_codes", b.promo_codes)):
        df.write.json(f"{root}/{name}.jsonl")
    every = [d for d in days(spark, sf_dir) if d != MISSING_DAY]
    ran = {d: runs.nightly(lake, day_files(spark, sf_dir), d, at_batch(), BATCH_TIME, root) is not None for d in (MISSING_DAY,)}
    ran[every[-1]] = runs.nightly(lake, day_files(spark, sf_dir), every, at_batch(), BATCH_TIME, root) is not None
    return lake, ran


def _nightly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake, _ = whole_nights(spark, sf_dir)
    return lake.read("gold.dq_summary_daily").select("event_day", "tx_total", "tx_user_missing", "tx_user_unknown", "tx_promo_expired")


def _nightly_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was closed with how many rows, and how the nights ended."""
    lake, ran = whole_nights(spark, sf_dir)
    ended = spark.createDataFrame([("nightly", f"ran={ok}", 1) for ok in ran.values()], "table_name string, source_partition string, rows_in_batch long")
    return lake.marks("transactions", "cancellations").select("table_name", "source_partition", "rows_in_batch").union(ended)


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = adapters.users(adapters.table(spark, sf_dir, "customer"))
    table = KeyedTable(f"{new_folder(spark, 'snapshot')}/users", "user_id long, user_uuid string, is_test_user boolean", ("user_id",), "user_id")
    table.snapshot(users)
    table.snapshot(table.read(spark).where("not is_test_user"))
    return table.read(spark)


def _overwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    bronze = adapters.Bronze(spark, sf_dir).transactions.select(*BRONZE_TX)
    table = KeyedTable(f"{new_folder(spark, 'partitions')}/tx", "composite_pk string, status string, event_day string, ingested_at timestamp_ntz", ("composite_pk",), "ingested_at", "event_day", sort=("composite_pk",))
    table.snapshot(bronze)
    table.overwrite_partitions(bronze.where((F.col("event_day") > SETTLED_UNTIL) & (F.col("status") == "completed")))
    return table.read(spark)


def _created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap of a lake that has the reference tables already: they stay, all others are empty."""
    lake, b = Lake(spark, new_folder(spark, "lake")), adapters.Bronze(spark, sf_dir)
    for name, df in (("users", b.users), ("test_users", b.test_users), ("promo_codes", b.promo_codes)):
        lake.table(f"bronze.{name}").snapshot(aligned(df, spark.createDataFrame([], lake.table(f"bronze.{name}").schema)))
    lake.bootstrap()
    return reduce(DataFrame.union, [lake.read(name).agg(F.lit(name).alias("table_name"), F.count("*").alias("n")) for name in SPECS])


def _watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = nightly(spark, sf_dir)
    shards = [lake.read(f"bronze.ingest_watermarks_{name}") for name in WATERMARK_TABLES]
    return reduce(DataFrame.union, shards).drop("committed_at")


def _ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake, sources = nightly(spark, sf_dir), day_files(spark, sf_dir)
    return spark.createDataFrame([(d, runs.ready(lake, d), runs.source_ready(lake, sources["transactions"], d)) for d in (RUN_DATE, MISSING_DAY)], "day string, ready boolean, source_there boolean")


def _by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As another session finds it."""
    return spark.newSession().table(f"{history(spark, sf_dir).prefix}gold.dq_summary_daily")


def _day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = one_day(spark, sf_dir)
    return reduce(DataFrame.union, [lake.read(name).agg(F.lit(name).alias("table_name"), F.count("*").alias("n")) for name in runs.MODELS if name not in ("silver.users_first_seen", "gold.promo_codes_analysis")])


def _offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake, folders = streamed(spark, sf_dir)
    marks = lake.read("bronze.ingest_watermarks_kafka").select(F.max(F.regexp_extract("source_partition", r"^offset=(\d+)$", 1).try_cast("long")).alias("offset"))
    rows = spark.read.parquet(folders.offsets).agg(F.sum("rows").alias("messages"), F.max("offset").alias("logged"))
    return rows.crossJoin(marks).select("messages", (F.col("offset") == F.col("logged")).alias("marked"))  # two rows of one


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = history(spark, sf_dir)
    return checks.all_failures({name: lake.read(name) for name in checks.DECLARED if name.startswith(("silver", "gold"))})


#: Read back as they stand, with the SQL of the model itself.
MODELS = ("silver_transactions_clean", "silver_cancellations_clean", "silver_rates_daily", "silver_rates_long", "gold_transactions_by_hour", "gold_purchases_by_hour", "gold_revenue_daily", "gold_refunds_daily", "gold_cancellations_summary", "gold_user_cohorts", "gold_promo_codes_analysis", "gold_promo_expired_usage_daily", "gold_dq_summary_daily")
DAILY: dict[str, Callable[[Warehouse], DataFrame]] = {
    "gold_transactions_by_hour_day": lambda w: gold.transactions_by_hour(w.tx, RUN_DATE),
    "gold_purchases_by_hour_day": lambda w: gold.purchases_by_hour(w.tx, RUN_DATE),
    "gold_dq_summary_day": lambda w: gold.dq_summary_daily(w.tx, RUN_DATE),
    "gold_promo_expired_usage_day": lambda w: gold.promo_expired_usage_daily(w.tx, RUN_DATE),
    "gold_user_cohorts_day": lambda w: gold.user_cohorts(w.tx, RUN_DATE, gold.first_seen(w.tx)),
}


def _model(name: str):
    layer, table = name.split("_", 1)
    table = f"{layer}.{table.replace('rates_', 'exchange_rates_')}" if layer == "silver" else f"{layer}.{table}"

    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = history(spark, sf_dir).read(table)
        return df.select(*catalogue.TX) if name == "silver_transactions_clean" else df.withColumn("updated_at", F.col("updated_at").isNotNull()) if name == "gold_promo_codes_analysis" else df

    return read


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "jsonl_scan": lambda spark, sf_dir: read_days(spark, day_files(spark, sf_dir)["transactions"], days(spark, sf_dir)),
    "ingest_all": lambda spark, sf_dir: _ingested(spark, sf_dir, days(spark, sf_dir)),
    "ingest_day": lambda spark, sf_dir: _ingested(spark, sf_dir, [RUN_DATE]),
    "watermarks_written": _watermarks,
    "readiness_written": _ready,
    "created_empty": _created,
    "snapshot_written": _snapshot,
    "partitions_overwritten": _overwritten,
    "upsert_written": lambda spark, sf_dir: history(spark, sf_dir).read("bronze.transactions").select(*BRONZE_TX),
    "table_by_name": _by_name,
    "materialise_day": _day_counts,
    "written_tests": _tests,
    "stream_log": lambda spark, sf_dir: live.bronze(spark, streamed(spark, sf_dir)[1], "transactions", "composite_pk").select(*BRONZE_TX),
    "stream_dead_letters": lambda spark, sf_dir: spark.read.parquet(streamed(spark, sf_dir)[1].dead).where("table = 'transactions'").select("dlq_pk", "source_table", "reason", "event_day_observed"),
    "stream_offsets": _offsets,
    **{f"signed_{name}": lambda spark, sf_dir, name=name: signed(spark, sf_dir).read(f"gold.{name}_signed").drop("amount_cnt") for name in ("transactions_by_hour", "purchases_by_hour", "cancellations_summary")},
    "stream_progress": _progress,
    "change_stream": _change_stream,
    "commit_rows": _commits,
    "bad_lines": _bad_lines,
    "nightly_all": _nightly_counts,
    "nightly_marks": _nightly_marks,
    "stream_rates_latest": lambda spark, sf_dir: streamed(spark, sf_dir)[0].read("gold.exchange_rates_latest"),
    **{f"stream_{name}": lambda spark, sf_dir, name=name: streamed(spark, sf_dir)[0].read(f"gold.{name}_live") for name in ("transactions_by_hour", "purchases_by_hour", "cancellations_summary")},
    "micros_to_time": lambda spark, sf_dir: adapters.table(spark, sf_dir, "events").select("event_id", F.expr(f"{adapters.EPOCH} * 1000000 + 999999").alias("us")).select("event_id", time_of_micros("us").alias("at")),
    **{f"written_{name}": _model(name) for name in MODELS},
    **{name: lambda spark, sf_dir, q=query: q(Warehouse(spark, sf_dir)) for name, query in DAILY.items()},
}
QUERIES = {name: (lambda spark, sf_dir, q=query: shown(q(spark, sf_dir))) for name, query in _QUERIES.items()}

# --- the same in DuckDB ---------------------------------------------------------------------------------------------

_KEY = "transaction_id || '|' || created_at || '|' || coalesce(user_id, 0)"
_INGESTED = f"""SELECT composite_pk, status, event_day, ingested_at::VARCHAR AS ingested_at, promo_code_id FROM (
  SELECT 0 AS origin, {_KEY} AS composite_pk, status, event_day, TIMESTAMP '{BATCH_TIME}' AS ingested_at, promo_code_id FROM raw_tx WHERE status <> 'pending' {{days}}
  UNION ALL SELECT 1, {_KEY}, 'stream-' || status, event_day, ingested_at + INTERVAL 5 DAY, NULL FROM raw_tx)
QUALIFY row_number() OVER (PARTITION BY composite_pk ORDER BY origin, ingested_at DESC) = 1"""
_DAY_OF_CANCEL = "strftime(ingested_at - INTERVAL 1 DAY, '%Y-%m-%d')"
_COUNTED = {
    "silver.transactions_clean": "tx", "silver.cancellations_clean": "cancelled", "silver.exchange_rates_daily": "daily", "silver.exchange_rates_long": "long",
    "gold.transactions_by_hour": f"({catalogue._TX_HOURS})", "gold.purchases_by_hour": f"({catalogue._BUYS})", "gold.revenue_daily": f"({catalogue._REVENUE})",
    "gold.refunds_daily": f"({catalogue._REFUNDS.format(days=catalogue._DAYS_TOUCHED)})", "gold.cancellations_summary": f"({catalogue._SUMMARY.format(days=catalogue._DAYS_TOUCHED)})",
    "gold.user_cohorts": f"({catalogue._COHORTS})", "gold.promo_expired_usage_daily": f"({catalogue._SELECTS['gold_promo_expired_usage_daily']})", "gold.dq_summary_daily": f"({catalogue._SELECTS['gold_dq_summary_daily']})",
}
_ONE_DAY = {"tx_day": f"WHERE event_day = '{RUN_DATE}'", "cancel_day": f"WHERE ingested_at::DATE = DATE '{RUN_DATE}'", "rate_day": f"WHERE rate_day = '{RUN_DATE}'"}
_OPEN = {"tx_day": f"WHERE event_day > '{SETTLED_UNTIL}'", "cancel_day": f"WHERE ingestion_day > DATE '{SETTLED_UNTIL}'"}
_SELECTS: dict[str, str] = {
    "jsonl_scan": "SELECT transaction_id, user_id, user_uuid, round(amount, 4) AS amount, currency, transaction_type, promo_code_id, status, created_at FROM raw_tx WHERE status <> 'pending'",
    "ingest_all": _INGESTED.format(days=""),
    "ingest_day": _INGESTED.format(days=f"AND event_day = '{RUN_DATE}'"),
    "watermarks_written": f"""SELECT '__bootstrap__|__init__|ingest_watermarks_' || t AS watermark_id, '__bootstrap__' AS table_name, '__init__' AS source_partition, 0::BIGINT AS rows_in_batch
  FROM (SELECT unnest({list(WATERMARK_TABLES)}) AS t)
UNION ALL SELECT 'transactions|s3|day={RUN_DATE}', 'transactions', 'day={RUN_DATE}', count(*) FROM raw_tx WHERE status <> 'pending' AND event_day = '{RUN_DATE}'
UNION ALL SELECT 'cancellations|s3|day={RUN_DATE}', 'cancellations', 'day={RUN_DATE}', count(*) FROM raw_cancel WHERE {_DAY_OF_CANCEL} = '{RUN_DATE}'
UNION ALL SELECT 'exchange_rates|s3|snapshot', 'exchange_rates', 'snapshot', count(*) FROM bronze_rates WHERE rate_day = '{RUN_DATE}'""",
    "readiness_written": f"SELECT * FROM (VALUES ('{RUN_DATE}', true, true), ('{MISSING_DAY}', false, false)) AS v(day, ready, source_there)",
    "created_empty": f"""SELECT table_name, CASE table_name WHEN 'bronze.users' THEN (SELECT count(*) FROM u) WHEN 'bronze.test_users' THEN (SELECT count(*) FROM tu) WHEN 'bronze.promo_codes' THEN (SELECT count(*) FROM pc) ELSE n END AS n
FROM (SELECT unnest({list(SPECS)}) AS table_name, unnest({[int('ingest_watermarks' in x) for x in SPECS]})::BIGINT AS n)""",
    "snapshot_written": "SELECT c_custkey AS user_id, 'u-' || c_custkey AS user_uuid, false AS is_test_user FROM customer WHERE c_acctbal >= 0",
    "partitions_overwritten": f"SELECT {catalogue._BRONZE_SHOWN} FROM bronze_tx WHERE event_day <= '{SETTLED_UNTIL}' OR status = 'completed'",
    "upsert_written": catalogue._SELECTS["upsert_latest"],
    "table_by_name": catalogue._SELECTS["gold_dq_summary_daily"],
    "materialise_day": "\nUNION ALL ".join(f"SELECT '{name}' AS table_name, count(*) AS n FROM {rows}" for name, rows in _COUNTED.items()),
    "written_tests": f"SELECT * FROM ({catalogue._SELECTS['declared_tests']}) WHERE table_name LIKE 'silver%' OR table_name LIKE 'gold%'",
    "stream_log": catalogue._SELECTS["upsert_latest"],
    "stream_dead_letters": catalogue._SELECTS["dlq_late_events"],
    "stream_offsets": "SELECT (SELECT count(*) FROM bronze_tx) + (SELECT count(*) FROM bronze_cancel) + (SELECT count(*) FROM bronze_rates) + 1 AS messages, true AS marked",
    "stream_rates_latest": catalogue._SELECTS["gold_exchange_rates_latest"],
    "stream_transactions_by_hour": catalogue._TX_HOURS,
    "stream_purchases_by_hour": catalogue._BUYS,
    "stream_cancellations_summary": catalogue._LIVE,
    "signed_transactions_by_hour": catalogue._TX_HOURS,
    "signed_purchases_by_hour": catalogue._BUYS,
    "signed_cancellations_summary": f"SELECT pk, cancel_day, reason, cancellations_cnt, invalid_refund_cnt, total_refund_amount, updated_at FROM ({catalogue._LIVE})",
    "stream_progress": "SELECT (SELECT count(*) FROM bronze_tx) + (SELECT count(*) FROM bronze_cancel) + (SELECT count(*) FROM bronze_rates) + 1 AS messages, true AS several",
    "change_stream": f"""SELECT 2::BIGINT AS version, 'update' AS change, {_KEY} AS composite_pk, 'failed' AS before, 'cancelled' AS status FROM raw_tx WHERE i % 100 = 0
UNION ALL SELECT 3, 'insert', {_KEY}, NULL, status FROM raw_tx WHERE i % 7 = 0 AND i % 100 <> 0""",
    "commit_rows": """SELECT 1::BIGINT AS version, 'event_day=' || event_day AS folder, count(DISTINCT composite_pk) AS rows FROM bronze_tx GROUP BY event_day
UNION ALL SELECT 2, 'event_day=' || event_day, count(DISTINCT composite_pk) FROM bronze_tx WHERE event_day IN (SELECT event_day FROM raw_tx WHERE i % 100 = 0) GROUP BY event_day""",
    "bad_lines": """SELECT 'transactions' AS source_table, 'malformed_line' AS reason, d AS event_day_observed, '{"transaction_id": ' || (i // 970) || ', "sta' AS line, count(*) AS times FROM e WHERE i % 97 = 5 GROUP BY ALL""",
    "nightly_all": "SELECT event_day, count(*) AS tx_total, count(*) FILTER (is_user_missing) AS tx_user_missing, count(*) FILTER (is_user_unknown) AS tx_user_unknown, count(*) FILTER (is_promo_expired_at_use) AS tx_promo_expired FROM tx GROUP BY event_day",
    "nightly_marks": f"""SELECT 'transactions' AS table_name, 'day=' || event_day AS source_partition, count(*) FILTER (status <> 'pending') AS rows_in_batch FROM raw_tx GROUP BY event_day
UNION ALL SELECT 'cancellations', 'day=' || d, count(c.d2) FROM (SELECT DISTINCT d FROM e) LEFT JOIN (SELECT {_DAY_OF_CANCEL} AS d2 FROM raw_cancel) c ON c.d2 = d GROUP BY d
UNION ALL SELECT 'nightly', 'ran=False', 1 UNION ALL SELECT 'nightly', 'ran=True', 1""",
    "micros_to_time": "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS at FROM events",
    **{f"written_{name}": catalogue._SELECTS[name] for name in MODELS},
    "written_gold_promo_codes_analysis": f"SELECT *, true AS updated_at FROM ({catalogue._SELECTS['gold_promo_codes_analysis']})",
    **{name: f"SELECT * FROM ({catalogue._SELECTS[base]}) WHERE event_day = '{RUN_DATE}'" for name, base in {
        "gold_transactions_by_hour_day": "gold_transactions_by_hour", "gold_purchases_by_hour_day": "gold_purchases_by_hour", "gold_dq_summary_day": "gold_dq_summary_daily",
        "gold_promo_expired_usage_day": "gold_promo_expired_usage_daily", "gold_user_cohorts_day": "gold_user_cohorts"}.items()},
}
_SLICES = {"materialise_day": _ONE_DAY, "nightly_all": {"tx_day": "WHERE status <> 'pending' AND NOT (status = 'failed' AND ingested_at > event_day::DATE + INTERVAL 1 DAY)"}} | dict.fromkeys(("signed_transactions_by_hour", "signed_purchases_by_hour", "signed_cancellations_summary", "stream_log", "stream_transactions_by_hour", "stream_purchases_by_hour", "stream_cancellations_summary"), _OPEN)
ORACLE = {name: catalogue._BASE.format(**{"tx_day": "", "rate_day": "", "cancel_day": ""} | _SLICES.get(name, {})) + "\n" + select for name, select in _SELECTS.items()}
