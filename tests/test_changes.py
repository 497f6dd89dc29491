"""Change streams and signed deltas: starts, restarts, crashes, redelivered and moved keys."""

import datetime
import json

import pytest
from pyspark.sql import functions as F
from support import SF

from finlake.functions.columns import with_cancellation_keys, with_transaction_keys
from finlake.operators.keyed import KeyedTable
from finlake.plans import gold, silver
from finlake.plans.lake import Lake
from finlake.sources import adapters
from finlake.streaming import changes, deltas, live

NOW = "timestamp_ntz'2024-02-01 00:00:00'"


def batch(spark, *items):
    return spark.createDataFrame(items, "k string, v long")


@pytest.mark.parametrize("start,expected", [("earliest", {"a": 1, "b": 1}), ("latest", {}), (0, {"b": 1})])
def test_a_stream_of_changes_starts_where_it_is_told(spark, tmp_path, start, expected):
    t = KeyedTable(f"file://{tmp_path}/t", "k string, v long", ("k",), "v", keep=5)
    t.upsert(batch(spark, ("a", 1)))
    t.upsert(batch(spark, ("b", 1)))
    seen = []

    def take(df, version, number):
        seen.append((version, {(r["row"] or r["before"])["k"]: (r["row"] or r["before"])["v"] for r in df.collect()}))

    def go():
        changes.follow(t, spark, take, f"file://{tmp_path}/c", start).awaitTermination()

    go()
    assert seen == ([(1, expected)] if expected else [])
    seen.clear()
    go()
    assert seen == []  # nothing new
    for n in (2, 3):
        t.upsert(batch(spark, ("a", n), (f"n{n}", n)))
    go()
    assert seen == [(3, {"a": 3, "n2": 2, "n3": 3})]


def test_a_stream_that_fell_behind_says_so(spark, tmp_path):
    t = KeyedTable(f"file://{tmp_path}/t", "k string, v long", ("k",), "v", keep=2)
    t.upsert(batch(spark, ("a", 1)))
    go = lambda: changes.follow(t, spark, lambda *_: None, f"file://{tmp_path}/c").awaitTermination()
    go()
    for n in range(2, 7):
        t.upsert(batch(spark, ("a", n)))
    with pytest.raises(Exception, match="is gone"):
        go()


class Crash(Exception):
    pass


def test_a_crash_between_commit_and_checkpoint_counts_nothing_twice(spark, tmp_path):
    """A running total is not idempotent; the batch named in the commit makes it so."""
    source = tmp_path / "in"
    source.mkdir()
    t = KeyedTable(f"file://{tmp_path}/t", "k string, n long", ("k",), "n")
    crash = [True, True]

    def add(df, number):
        old = {r["k"]: r["n"] for r in t.read(spark).collect()}
        new = [(r["value"], r["count"] + old.get(r["value"], 0)) for r in df.groupBy("value").count().collect()]
        t.upsert(spark.createDataFrame(new, t.schema), ("totals", number))
        if crash and crash.pop():
            raise Crash("lost between commit and checkpoint")

    def go():
        stream = spark.readStream.option("maxFilesPerTrigger", 1).text(f"file://{source}")
        stream.writeStream.foreachBatch(add).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()

    for n in range(3):
        (source / f"{n}.txt").write_text("x\ny\nx\n")
    for _ in range(2):
        with pytest.raises(Exception, match="between commit and checkpoint"):
            go()
    go()
    assert {r["k"]: r["n"] for r in t.read(spark).collect()} == {"x": 6, "y": 3} and t.batch(spark, "totals") == 2


@pytest.fixture(scope="module")
def messages(spark):
    w = adapters.Bronze(spark, SF)
    events = w.events.where("event_id < 300")
    again = adapters.redelivered(events)
    moved = adapters.transactions(events.where("event_id % 50 = 3")).withColumns({"status": F.lit("cancelled"), "loaded_at": F.expr("loaded_at + INTERVAL 3 DAYS")})  # leave the purchases
    tx = adapters.transactions(events).unionByName(again).unionByName(moved)
    return w, tx, adapters.cancellations(events)


def written(tmp_path, tx, cancelled, parts):
    """Dumps of a topic, its messages dealt over files by their keys, later versions first in some."""
    source = tmp_path / "topic"
    source.mkdir()
    rows = [(r, "transaction") for r in tx.collect()] + [(r, "cancellation") for r in cancelled.collect()]
    lines = []
    for n, (r, kind) in enumerate(sorted(rows, key=lambda x: hash((str(x[0][0]), str(x[0]["loaded_at"]))))):
        value = {k: v for k, v in r.asDict().items() if k != "loaded_at" and v is not None} | {"_source": kind}
        lines.append(json.dumps({"value": json.dumps(value), "timestamp": str(r["loaded_at"]), "offset": n}))
    for k in range(parts):
        (source / f"{k}.json").write_text("\n".join(lines[k::parts]) + "\n")
    return source


def test_deltas_equal_settled_aggregates(spark, tmp_path, messages, monkeypatch):
    w, tx, cancelled = messages
    source = written(tmp_path, tx, cancelled, 4)
    lake, folders = Lake(spark, f"file://{tmp_path}/lake"), live.Folders(f"file://{tmp_path}/stream")
    dims = lambda: (w.users, w.test_users, w.promo_codes)
    closed = lambda table: datetime.date(2024, 1, 3) if table == "transactions" else None
    read, real = [], live.bronze
    monkeypatch.setattr(live, "bronze", lambda *a: read.append(a[-1]) or real(*a))
    crash = [True]
    upsert = KeyedTable.upsert

    def failing(self, *a, **b):
        out = upsert(self, *a, **b)
        if crash and "purchases_by_hour_signed" in self.path:
            crash.pop()
            raise Crash("lost")
        return out

    monkeypatch.setattr(KeyedTable, "upsert", failing)
    progress = []
    for k in range(1, 5):  # file by file; the second run crashes after a commit
        live.ingest(live.topic_dump(spark, f"file://{source}", files=1), folders, closed, F.expr(NOW), {"availableNow": True}).awaitTermination()
        for _ in range(2):
            queries = deltas.run(spark, folders, dims, lake.table, closed, {"availableNow": True})
            for q in queries:
                try:
                    q.awaitTermination()
                except Exception as error:
                    assert "lost" in str(error)
                progress += [p["numInputRows"] for p in q.recentProgress]
    assert not crash
    settled = silver.transactions_clean(with_transaction_keys(tx, F.col("loaded_at")).drop("loaded_at").where("event_day > '2024-01-03'"), *dims())
    show = lambda df, cols: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect()), key=str)
    cols = ["pk", "event_day", "hour_of_day", "is_test_user", "tx_cnt", "completed_cnt", "failed_cnt", "updated_at"]
    assert show(lake.read("gold.transactions_by_hour_signed"), cols) == show(gold.transactions_by_hour(settled), cols)
    cols = ["pk", "event_day", "hour_of_day", "purchase_cnt", "gross_amount_native", "updated_at"]
    assert show(lake.read("gold.purchases_by_hour_signed"), cols) == show(gold.purchases_by_hour(settled), cols)
    cols = ["pk", "cancel_day", "reason", "cancellations_cnt", "invalid_refund_cnt", "total_refund_amount", "updated_at"]
    gone = silver.cancellations_clean(with_cancellation_keys(cancelled, F.col("loaded_at"), F.to_date("loaded_at")).drop("loaded_at"))
    assert show(lake.read("gold.cancellations_summary_signed"), cols) == show(gold.cancellations_live(gone), cols)


def test_a_trigger_reads_its_rows_only(spark, tmp_path, monkeypatch):
    """A day grows tenfold; what a trigger reads stays, and the log is read again only where a group's newest row left it."""
    w = adapters.Bronze(spark, SF)
    lake, folders, source = Lake(spark, f"file://{tmp_path}/lake"), live.Folders(f"file://{tmp_path}/stream"), tmp_path / "topic"
    source.mkdir()
    rebuilt, real = [], live.bronze
    monkeypatch.setattr(live, "bronze", lambda *a: rebuilt.append(a[-1]) or real(*a))

    def send(n, rows):
        body = [json.dumps({"value": json.dumps({"_source": "transaction", "transaction_id": i, "user_id": 1, "amount": 2.0, "created_at": 1704067200 + i, "status": s, "transaction_type": "purchase"}), "timestamp": f"2024-01-0{d} 00:00:00", "offset": n}) for i, s, d in rows]
        (source / f"{n}.json").write_text("\n".join(body) + "\n")
        live.ingest(live.topic_dump(spark, f"file://{source}"), folders, lambda _: None, F.expr(NOW), {"availableNow": True}).awaitTermination()
        found = []
        for q in deltas.run(spark, folders, lambda: (w.users.where("user_id < 0"), w.test_users.limit(0), w.promo_codes), lake.table, lambda _: None, {"availableNow": True}):
            q.awaitTermination()
            found += [p["numInputRows"] for p in q.recentProgress]
        return sum(found)

    reads = [send(n, [(n * 20 + i, "completed", 2) for i in range(20)]) for n in range(4)]
    assert reads == [20] * 4 and not rebuilt
    total = lambda: lake.read("gold.purchases_by_hour_signed").select("purchase_cnt", "gross_amount_native", F.col("updated_at").cast("string")).collect()
    assert [tuple(r) for r in total()] == [(80, 160.0, "2024-01-02 00:00:00")]
    send(4, [(3, "completed", 5)])  # a later version that counts as much
    assert [tuple(r) for r in total()] == [(80, 160.0, "2024-01-05 00:00:00")] and not rebuilt
    send(5, [(3, "failed", 6)])  # the newest row leaves
    assert [tuple(r) for r in total()] == [(79, 158.0, "2024-01-02 00:00:00")] and rebuilt
    send(6, [(3, "completed", 4)])  # an older version comes late: nothing changes
    assert [tuple(r) for r in total()] == [(79, 158.0, "2024-01-02 00:00:00")]
