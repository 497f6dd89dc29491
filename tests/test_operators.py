"""Operators on hand-written rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from finlake import schemas
from finlake.functions.columns import day_of, hour_of, time_of, with_cancellation_keys, with_rate_keys, with_transaction_keys
from finlake.operators import quality
from finlake.operators.asof import as_of
from finlake.operators.dedup import cutover, latest
from finlake.operators.keyed import KeyedTable
from finlake.operators.routing import closed_day, dead_letters, is_ready, normalised_partitions, route
from finlake.plans import checks, serving, silver
from finlake.sources import jsonl


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_keys_of_nulls(spark):
    tx = spark.createDataFrame([(None, None, None), (1, 2, 86400)], "transaction_id long, user_id long, created_at long")
    assert rows(with_transaction_keys(tx, F.lit(None)).select("composite_pk", "event_day").where("event_day is not null")) == [("1|86400|2", "1970-01-02")]
    assert with_transaction_keys(tx, F.lit(None)).where("transaction_id is null").first()["composite_pk"] == "0|0"
    c = spark.createDataFrame([(None, None, None), ("n/a", 1, 2), ("2024 Jan 05 10:20", 1, 2)], "cancelled_at string, cancellation_id long, original_transaction_id long")
    got = with_cancellation_keys(c, F.lit(None), F.lit("2024-02-01").cast("date")).select("cancellation_pk", "event_day").collect()
    assert [tuple(r) for r in got] == [("__nullts__|__nullid__|__nullid__", "2024-02-01"), ("n/a|1|2", "2024-02-01"), ("2024 Jan 05 10:20|1|2", "2024-01-05")]
    r = spark.createDataFrame([(7, None)], "update_id long, timestamp long")
    assert with_rate_keys(r, F.lit(None)).first()["rate_pk"] == "7|0"


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_days_do_not_depend_on_the_session(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = spark.createDataFrame([(-1,), (0,), (90061,)], "x long").select(day_of("x"), hour_of("x"), time_of("x").cast("string")).collect()
        assert [tuple(r) for r in got] == [("1969-12-31", 23, "1969-12-31 23:59:59"), ("1970-01-01", 0, "1970-01-01 00:00:00"), ("1970-01-02", 1, "1970-01-02 01:01:01")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_latest_breaks_ties_the_same_way(spark):
    df = spark.createDataFrame([("k", 1, c) for c in "abcdef"], "k string, v int, x string")
    one = rows(latest(df, ["k"], [F.col("v").desc()]))
    assert len(one) == 1 and one == rows(latest(df.repartition(3), ["k"], [F.col("v").desc()]))


def test_cutover_prefers_the_batch(spark):
    batch = spark.createDataFrame([("a", 1, "b"), ("c", 1, "b")], "pk string, ingested_at int, x string")
    left = spark.createDataFrame([("a", 9), ("d", 9), ("d", 8)], "pk string, ingested_at int")
    assert rows(cutover(batch, left, "pk").select("pk", "ingested_at", F.coalesce("x", F.lit("-")))) == [("a", 1, "b"), ("c", 1, "b"), ("d", 9, "-")]


def test_as_of(spark):
    rates = spark.createDataFrame([("PUNK", "2024-01-02", 2.0), ("PUNK", "2024-01-05", 5.0)], "currency string, rate_day string, rate double")
    asked = spark.createDataFrame([("PUNK", d) for d in ("2024-01-01", "2024-01-02", "2024-01-04", "2024-01-09")] + [("XXX", "2024-01-01"), (None, "2024-01-01")], "currency string, day string")
    got = rows(as_of(asked, rates, "currency", "day", "rate", "rate_day").select("currency", "day", F.coalesce("rate", F.lit(-1.0)), "rate_source"))
    assert got == [("PUNK", "2024-01-01", 2.0, "backward"), ("PUNK", "2024-01-02", 2.0, "forward"), ("PUNK", "2024-01-04", 2.0, "forward"), ("PUNK", "2024-01-09", 5.0, "forward"), ("XXX", "2024-01-01", -1.0, "missing")]


def test_route_keeps_every_row(spark):
    df = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-02"), ("c", None), ("d", "bad")], "pk string, day string")
    on_time, late = route(df, "day", datetime.date(2024, 1, 1))
    assert rows(on_time.select("pk")) == [("b",)] and rows(late.select("pk")) == [("a",), ("c",), ("d",)]
    assert {r["dlq_pk"]: r["reason"] for r in dead_letters(late, "t", "pk", "day").collect()} == {"t|a": "late_partition_owned_by_batch", "t|c": "no_partition_day", "t|d": "no_partition_day"}
    everything, none = route(df, "day", None)
    assert everything.count() == 4 and none.isEmpty()


def test_watermarks_and_readiness(spark):
    marks = spark.createDataFrame(
        [("1", "transactions", "day=2024-01-01", 5, "1"), ("2", "transactions", "day=2024-01-02", 0, "2"), ("3", "cancellations", "day=2024-01-02", 0, "2"), ("4", "exchange_rates", "snapshot", 1, "2"), ("5", "transactions", "offset=7", 1, "3")],
        schemas.WATERMARKS,
    )
    assert closed_day(marks, "transactions") == datetime.date(2024, 1, 2) and closed_day(marks, "none") is None
    assert not is_ready(marks, "2024-01-02").first()["ready"]
    later = marks.union(spark.createDataFrame([("6", "transactions", "day=2024-01-02", 3, "9")], schemas.WATERMARKS))
    assert is_ready(later, "2024-01-02").first()["ready"]
    names = spark.createDataFrame([("event_day=2024-01-01",), ("",), ("event_day=2024-01-01",)], "p string")
    assert rows(normalised_partitions(names, "p")) == [("day=2024-01-01",), ("snapshot",)]


def test_upsert_by_partition_key(spark, tmp_path):
    t = KeyedTable(f"file://{tmp_path}/t", "k string, v long, x string, p string", ("k",), "v", "p", global_key=False)
    t.create(spark)
    t.create(spark)
    batch = spark.createDataFrame([("a", 1, "x", "p1"), ("a", 2, "y", "p1"), ("a", 1, "z", "p2")], t.schema)
    for _ in range(2):  # twice is once
        assert t.upsert(batch)
    assert rows(t.read(spark)) == [("a", 1, "z", "p2"), ("a", 2, "y", "p1")]
    t.upsert(spark.createDataFrame([("a", 1, "older", "p1"), ("a", 1, "equal", "p2")], t.schema))
    assert rows(t.read(spark)) == [("a", 1, "equal", "p2"), ("a", 2, "y", "p1")]
    assert not t.upsert(spark.createDataFrame([], t.schema))


def test_upsert_moves_a_global_key(spark, tmp_path):
    t = KeyedTable(f"file://{tmp_path}/t", "k string, v long, p string", ("k",), "v", "p")
    t.upsert(spark.createDataFrame([("a", 1, "p1"), ("b", 1, "p2"), ("c", 1, "p2")], t.schema))
    t.upsert(spark.createDataFrame([("a", 2, "p2")], t.schema))
    assert rows(t.read(spark)) == [("a", 2, "p2"), ("b", 1, "p2"), ("c", 1, "p2")]


def test_a_failed_write_leaves_the_table(spark, tmp_path, monkeypatch):
    t = KeyedTable(f"file://{tmp_path}/t", "k string, v long, p string", ("k",), "v", "p")
    before = [("a", 1, "p1"), ("b", 1, None)]
    t.snapshot(spark.createDataFrame(before, t.schema))
    broken = spark.createDataFrame([("c", 1, "p1"), ("d", 2, "p2")], t.schema).withColumn("v", F.expr("if(k = 'd', raise_error('lost'), v)").cast("long"))
    for write in (t.snapshot, t.overwrite_partitions, t.upsert):
        with pytest.raises(Exception, match="lost"):
            write(broken)
        assert sorted(map(tuple, t.read(spark).collect()), key=str) == sorted(before, key=str)
    good = spark.createDataFrame([("a", 5, "p1")], t.schema)
    with monkeypatch.context() as m:  # the folders are written, the commit does not come
        m.setattr(KeyedTable, "_commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            t.upsert(good)
    assert sorted(map(tuple, t.read(spark).collect()), key=str) == sorted(before, key=str)
    earlier = t.read(spark)
    t.upsert(good)
    assert rows(t.read(spark).where("k = 'a'")) == [("a", 5, "p1")] and earlier.count() == 2  # a reader may finish
    with pytest.raises(RuntimeError):  # a second writer that began at the same version
        t._commit(spark, t.version(spark), {}, {}, {})
    for _ in range(3):
        t.upsert(good)
    left = [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("table_version=")]
    assert len(left) <= 3 and len(list((tmp_path / "t" / "_manifests").glob("[0-9]*[0-9]"))) == 2


def test_untouched_partitions_are_not_read(spark, tmp_path):
    t = KeyedTable(f"file://{tmp_path}/t", "k string, v long, p string", ("k",), "v", "p", global_key=False)
    t.snapshot(spark.createDataFrame([("a", 1, "p1"), ("b", 1, "p2/x y")], t.schema))
    folder = t.folders(spark)["p=p1"]
    for file in (tmp_path / "t" / folder).glob("*.parquet"):
        file.write_bytes(b"unreadable")
    t.upsert(spark.createDataFrame([("b", 2, "p2/x y")], t.schema))
    assert t.folders(spark)["p=p1"] == folder and rows(t.read(spark).where("p <> 'p1'")) == [("b", 2, "p2/x y")]


def test_overwrites(spark, tmp_path):
    t = KeyedTable(f"file://{tmp_path}/t", "k string, v long, p string", ("k",), "v", "p")
    t.snapshot(spark.createDataFrame([("a", 1, "p1"), ("b", 1, "p2")], t.schema))
    t.overwrite_partitions(spark.createDataFrame([("c", 1, "p2")], t.schema))
    assert rows(t.read(spark)) == [("a", 1, "p1"), ("c", 1, "p2")]
    t.snapshot(t.read(spark).where("p = 'p2'"))
    assert rows(t.read(spark)) == [("c", 1, "p2")]


def test_jsonl_days(spark, tmp_path):
    (tmp_path / "day=2024-01-01/a/b").mkdir(parents=True)
    (tmp_path / "day=2024-01-01/a/b/transactions.jsonl").write_text('{"transaction_id": 1, "status": "completed", "other": 3}\n{"transaction_id": 2}\n')
    (tmp_path / "day=2024-01-01/a/other.jsonl").write_text('{"transaction_id": 3}\n')
    source = jsonl.sources(f"file://{tmp_path}")["transactions"]
    day = jsonl.read_day(spark, source, "2024-01-01")
    assert day.columns == schemas.columns(schemas.TRANSACTIONS) and rows(day.select("transaction_id")) == [(1,), (2,)]
    empty = jsonl.read_day(spark, source, "2024-01-02")
    assert empty.columns == day.columns and empty.isEmpty()
    (tmp_path / "users.jsonl").write_text('{"user_id": 1}\n')
    found, missing = jsonl.load_snapshots(spark, f"file://{tmp_path}", {"users": schemas.USERS, "test_users": schemas.TEST_USERS}, F.lit(None).cast("timestamp_ntz"), frozenset({"users"}))
    assert found["users"].count() == 1 and missing == ["test_users"]
    with pytest.raises(FileNotFoundError):
        jsonl.load_snapshots(spark, f"file://{tmp_path}", {"promo_codes": schemas.PROMO_CODES}, F.lit(None), frozenset({"promo_codes"}))
    table = spark.createDataFrame([("a", "p1", 1), ("b", "p2", 2)], "pk string, part string, gone int")
    like = spark.createDataFrame([("x", "p1", 1.0)], "pk string, part string, added double")
    assert rows(jsonl.residual(table, "part", like, like)) == [("a", "p1", None)]


def test_flags_with_nulls(spark):
    tx = spark.createDataFrame([(None, "u", None, None, None, None, "2024-01-02")], "user_id long, user_uuid string, promo_code_id long, amount double, status string, transaction_type string, event_day string")
    users = spark.createDataFrame([(1, True)], "user_id long, is_test_user boolean")
    listed = spark.createDataFrame([("u",)], "test_user_uuid string")
    codes = spark.createDataFrame([(1, "not a day")], "promo_code_id long, expiry_date string")
    r = silver.enriched(tx, users, listed, codes).first()
    assert (r.is_user_missing, r.is_user_unknown, r.is_test_user, r.is_test_user_inconsistent, r.is_amount_invalid, r.is_revenue_eligible, r.is_promo_expired_at_use) == (True, False, True, False, True, False, False)


def test_quality(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "z")], "k long, v string")
    assert quality.not_null(df, "k").count() == 1 and rows(quality.unique(df, "k")) == [(1, 2)] and rows(quality.accepted_values(df, "v", ["a", "b"])) == [("z", 1)]
    tests = {"w": (quality.WARN, lambda: quality.not_null(df, "k"))}
    assert quality.run(tests) == {"w": 1}
    with pytest.raises(AssertionError):
        quality.run(tests | {"e": (quality.ERROR, lambda: quality.unique(df, "k"))})
    silver_rows = spark.createDataFrame([("a", 1)], "pk string, at long")
    assert quality.same_count(spark.createDataFrame([("a", 1), ("a", 0), ("b", 5)], "pk string, at long"), silver_rows, "pk", "at").isEmpty()
    assert rows(quality.same_count(spark.createDataFrame([("a", 1), ("b", 1)], "pk string, at long"), silver_rows, "pk", "at")) == [(2, 1)]
    children = spark.createDataFrame([(1,), (1,), (2,), (None,)], "c long")
    assert rows(quality.orphan_rate(children, spark.createDataFrame([(1,), (1,)], "p long"), "c", "p")) == [(4, 2, 50.0)]


def test_orphan_threshold(spark):
    def failures(orphans: int, known: int) -> dict:
        children = spark.range(orphans).selectExpr("-1 - id as c").union(spark.range(known).selectExpr("1L as c"))
        rate = quality.orphan_rate(children, spark.createDataFrame([(1,)], "p long"), "c", "p")
        return quality.run({"orphans": (quality.WARN, lambda: quality.orphans_above(rate))})

    assert failures(101, 0) == {"orphans": 1} and failures(199, 1) == {"orphans": 1}
    assert failures(100, 0) == {} and failures(99, 1) == {} and failures(198, 2) == {} and failures(5, 200) == {} and failures(0, 0) == {}


def test_declared_tests():
    n = [len(c.not_null) + len(c.unique) + len(c.accepted) for c in checks.DECLARED.values()]
    assert sum(n) == 69  # promo_codes_analysis has no clock column


def test_declared_tests_raise_on_errors_only(spark):
    long = spark.createDataFrame([("a", "d", "XXX", 1.0), ("b", "d", "RUB", 1.0)], "rate_day_currency string, rate_day string, currency string, rate_to_tgrk double")
    assert checks.assert_passed(checks.failures("silver.exchange_rates_long", long)) == [("silver.exchange_rates_long", "accepted_values:currency", 1)]
    with pytest.raises(AssertionError):
        checks.assert_passed(checks.failures("silver.exchange_rates_long", long.union(long)))
    assert checks.unpopulated({"a": long, "b": long.limit(0)}) == ["b"]
    assert jsonl.committed({"batchId": 3, "numInputRows": 9}) == (3, 9) and jsonl.committed({}) == (-1, 0)


def test_unified_without_settled_rows(spark):
    live = spark.createDataFrame([("2024-01-01", 1)], "event_day string, n int")
    assert rows(serving.unified(live.limit(0), live, "event_day")) == [("2024-01-01", 1, "live")]
    assert rows(serving.adhoc(live, "n", ">=", 1)) == [("2024-01-01", 1)]
