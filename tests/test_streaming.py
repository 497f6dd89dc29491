"""The stream, run over a folder, gives what the batch models give on the same rows."""

import datetime
import json

from support import SF
from pyspark.sql import functions as F

from finlake.plans import gold, silver
from finlake.sources import adapters
from finlake.streaming import live


def rows(df):
    return sorted(df.collect(), key=str)


def test_live_equals_batch(spark, tmp_path):
    w = adapters.Bronze(spark, SF)
    events = w.events.where("event_id < 400")
    frames = {"transaction": adapters.transactions(events), "cancellation": adapters.cancellations(events), "exchange_rate": adapters.exchange_rates(w.events)}
    messages = [json.loads(r) | {"_source": kind} for kind, df in frames.items() for r in df.drop("loaded_at").toJSON().collect()]
    source = tmp_path / "in"
    source.mkdir()
    for part in range(3):  # hours and days come in several batches
        (source / f"{part}.jsonl").write_text("\n".join(json.dumps(m) for m in messages[part::3]) + "\nnot json\n")
    folders, tables = live.Folders(f"file://{tmp_path}/lake"), {}
    dims = lambda: (w.users, w.test_users, w.promo_codes)
    closed = lambda table: datetime.date(2024, 1, 10) if table == "transactions" else None
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")

    def upsert(table, df):
        for r in df.drop("updated_at").collect():
            tables.setdefault(table, {})[r[0]] = r

    for _ in range(2):  # a restart finds nothing new and changes nothing
        live.replay(live.lines(spark, f"file://{source}", files=1), folders, dims, upsert, closed, now)
    tx = silver.transactions_clean(live.with_transaction_keys(frames["transaction"].drop("loaded_at"), now).where("event_day > '2024-01-10'"), *dims())
    assert sorted(tables["transactions_by_hour"].values(), key=str) == rows(gold.transactions_by_hour(tx).drop("updated_at"))
    amounts = lambda rs: {r["pk"]: round(r["gross_amount_native"] or 0, 6) for r in rs}
    assert amounts(tables["purchases_by_hour"].values()) == amounts(gold.purchases_by_hour(tx).collect())
    cancelled = silver.cancellations_clean(live.with_cancellation_keys(frames["cancellation"].drop("loaded_at"), now, F.to_date(now)))
    assert {k: r["cancellations_cnt"] for k, r in tables["cancellations_summary"].items()} == {r["pk"]: r["cancellations_cnt"] for r in gold.cancellations_live(cancelled).collect()}
    assert [r["rate_ts"] for r in tables["exchange_rates_latest"].values()] == [frames["exchange_rate"].agg(F.max("timestamp")).first()[0]]
    dead = spark.read.parquet(folders.dead)
    late = live.with_transaction_keys(frames["transaction"].drop("loaded_at"), now).where("event_day <= '2024-01-10'")
    assert dead.count() == late.count() and json.loads(dead.first()["payload_json"])["composite_pk"]
    assert live.last_batch(spark, folders, "transactions") == 2 and live.last_batch(spark, live.Folders(f"file://{tmp_path}/none"), "transactions") == -1
    days = live.log(spark, folders, "transactions", ["2024-01-12"])
    assert {r["event_day"] for r in days.collect()} == {"2024-01-12"}
    assert all("/log_day=2024-01-12/" in r[0] for r in days.select(F.input_file_name()).collect())


def test_a_stream_may_start_after_a_batch(spark, tmp_path):
    folders, now = live.Folders(f"file://{tmp_path}/lake"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    batch = lambda n: spark.createDataFrame([(json.dumps({"_source": "exchange_rate", "update_id": n, "timestamp": n}), None, n)], "value string, source_ts timestamp_ntz, source_offset long")
    marks = []
    for n in range(3):
        live.ingest_batch(live.parsed(batch(n)), n, folders, lambda _: None, now, lambda b, o: marks.append((b, o)))
    assert marks == [(0, 0), (1, 1), (2, 2)]
    seen = []
    query = live.changes(spark, folders, "exchange_rates", after=1).writeStream.foreachBatch(lambda df, _: seen.extend(r["update_id"] for r in df.collect())).trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/c").start()
    query.awaitTermination()
    assert seen == [2]
    spark.streams.resetTerminated()
    idle = [live.changes(spark, folders, "exchange_rates").writeStream.foreachBatch(lambda df, _: None).start() for _ in range(2)]
    assert not live.wait_for_any(spark, idle, timeout=1) and all(q.isActive for q in idle)
    idle[0].stop()
    assert live.wait_for_any(spark, idle) and not any(q.isActive for q in idle)


def test_a_batch_of_the_log_has_a_file_for_each_day(spark, tmp_path):
    folders, now = live.Folders(f"file://{tmp_path}/lake"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    value = F.to_json(F.struct(F.lit("transaction").alias("_source"), F.col("id").alias("transaction_id"), (1704067200 + F.col("id") % 3 * 86400).alias("created_at")))
    batch = spark.range(600, numPartitions=6).select(value.alias("value"), F.lit(None).cast("timestamp_ntz").alias("source_ts"), F.col("id").alias("source_offset"))
    live.ingest_batch(live.parsed(batch), 0, folders, lambda _: None, now)
    found = live.log(spark, folders, "transactions")
    assert found.count() == 600 and found.select(F.input_file_name()).distinct().count() == 3
