"""Keyed tables: buckets, clustering, counts of commits, batches that come again, changes between versions; ingest of bad lines."""

import json

import pytest
from pyspark.sql import functions as F

from finlake.functions.columns import with_transaction_keys
from finlake.operators import keyed
from finlake.operators.keyed import KeyedTable
from finlake.plans import runs
from finlake.plans.lake import Lake
from finlake.sources import jsonl

SCHEMA = "k string, v long, p string, price decimal(10, 2)"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def table(tmp_path, **more) -> KeyedTable:
    return KeyedTable(f"file://{tmp_path}/t", SCHEMA, ("k",), "v", "p", **more)


def batch(spark, *items):
    return spark.createDataFrame([(k, v, p, None) for k, v, p in items], SCHEMA)


def test_columns_come_from_the_schema(tmp_path, spark):
    assert table(tmp_path).columns == ["k", "v", "p", "price"]


def test_upserts_touch_the_buckets_of_their_keys_only(spark, tmp_path):
    t = table(tmp_path, buckets=16)
    t.upsert(batch(spark, *[(f"k{i}", 1, f"p{i % 3}") for i in range(200)]))
    before = t.folders(spark)
    assert len(before) == 16
    asked = batch(spark, ("k7", 2, "moved"), ("k8", 2, "p2"))
    mine = {t.folder(spark, v) for v in t._values(asked)}
    for name, folder in before.items():  # other buckets can't even be read
        if name not in mine:
            for file in (tmp_path / "t" / folder).rglob("*.parquet"):
                file.rename(file.with_suffix(".gone"))
    t.upsert(asked)
    after = t.folders(spark)
    assert {n for n in after if after[n] != before[n]} == mine
    files = t.read(spark, mine).select(F.input_file_name()).distinct().collect()
    assert all(any(f"/{m}/" in r[0] for m in mine) for r in files)
    for file in (tmp_path / "t").rglob("*.gone"):
        file.rename(file.with_suffix(".parquet"))
    found = {r["k"]: (r["v"], r["p"]) for r in t.read(spark).collect()}
    assert len(found) == 200 and t.read(spark).count() == 200 and found["k7"] == (2, "moved") and found["k8"] == (2, "p2") and found["k9"] == (1, "p0")
    with pytest.raises(ValueError):
        t.overwrite_partitions(asked)
    with pytest.raises(ValueError):
        table(tmp_path, buckets=4, global_key=False)


def test_files_hold_ranges_that_do_not_overlap(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        t = KeyedTable(f"file://{tmp_path}/t", "k string, user long, p string", ("k",), "user", "p", sort=("user",), file_bytes=8000)
        source = spark.range(4000).selectExpr("concat('k', id) AS k", "(id * 7919) % 4001 AS user", "concat('p', id % 2) AS p").repartition(5)
        t.snapshot(source)
        whole = KeyedTable(f"file://{tmp_path}/w", t.schema, ("k",), "user", sort=("user",))
        whole.snapshot(source)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert whole.read(spark).select(F.input_file_name()).distinct().count() == 1  # a small table is one file
    read = t.read(spark).withColumn("file", F.input_file_name())
    ranges = read.groupBy("p", "file").agg(F.min("user").alias("a"), F.max("user").alias("b")).orderBy("p", "a").collect()
    for x, y in zip(ranges, ranges[1:]):
        assert x["p"] != y["p"] or x["b"] < y["a"]
    assert 2 < len(ranges) <= 7 and rows(t.read(spark)) == rows(source)
    for r in ranges:  # and each file is sorted
        users = [x["user"] for x in spark.read.parquet(r["file"]).select("user").collect()]
        assert users == sorted(users)


def test_commits_count_their_rows(spark, tmp_path):
    t = table(tmp_path, keep=9)
    t.create(spark)
    t.upsert(batch(spark, ("a", 1, "p1"), ("b", 1, "p1"), ("c", 1, None)))
    t.upsert(batch(spark, ("b", 2, "p2")))
    t.snapshot(batch(spark, ("z", 1, "p1")))
    t.overwrite_partitions(batch(spark, ("y", 1, "p9")), ["p9"])
    null = "p=__HIVE_DEFAULT_PARTITION__"
    assert rows(t.commits(spark)) == sorted([(1, "p=p1", 2), (1, null, 1), (2, "p=p1", 1), (2, "p=p2", 1), (3, "", 1), (4, "p=p9", 1)], key=str)


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    t = table(tmp_path)
    assert t.upsert(batch(spark, ("a", 1, "p")), ("q", 0)) and t.batch(spark, "q") == 0 and t.batch(spark, "r") == -1
    assert not t.upsert(batch(spark, ("a", 9, "p")), ("q", 0))
    assert t.upsert(batch(spark, ("b", 1, "p")), ("r", 0)) and t.upsert(batch(spark, ("c", 1, "p")), ("q", 1)) and t.upsert(batch(spark, ("d", 1, "p")))
    assert (t.batch(spark, "q"), t.batch(spark, "r")) == (1, 0) and not t.upsert(batch(spark, ("a", 9, "p")), ("q", 1))
    assert {r["k"]: r["v"] for r in t.read(spark).collect()} == dict.fromkeys("abcd", 1)


def test_a_batch_may_replace_and_remove(spark, tmp_path):
    t = table(tmp_path)
    t.upsert(batch(spark, ("a", 5, "p"), ("b", 5, "p")))
    t.upsert(batch(spark, ("a", 1, "p"), ("b", 0, "q")), replace=True, gone=F.col("v") == 0)
    assert rows(t.read(spark).select("k", "v")) == [("a", 1)]


@pytest.mark.parametrize("buckets", [0, 4])
def test_changes_between_versions(spark, tmp_path, buckets):
    t = table(tmp_path, keep=3, buckets=buckets)
    t.upsert(batch(spark, ("a", 1, "p1"), ("b", 1, "p1"), ("c", 1, "p2"), ("d", 1, "p3")))
    t.upsert(batch(spark, ("a", 2, "p1"), ("c", 2, "p1"), ("e", 1, "p3")))
    show = lambda a, b: rows(t.changes(spark, a, b).select("change", F.coalesce("row.k", "before.k"), "before.v", "row.v", "row.p"))
    assert show(0, 1) == [("insert", "e", None, 1, "p3"), ("update", "a", 1, 2, "p1"), ("update", "c", 1, 2, "p1")]
    assert len(show(-1, 0)) == 4 and show(1, 1) == []
    t.snapshot(batch(spark, ("a", 2, "p1")))
    assert show(0, 2) == [("delete", "b", 1, None, None), ("delete", "c", 1, None, None), ("delete", "d", 1, None, None), ("update", "a", 1, 2, "p1")]
    t.upsert(batch(spark, ("x", 1, "p1")))
    with pytest.raises(LookupError):
        t.changes(spark, 0, 3)


LINES = ['{"transaction_id": 1, "user_id": 5, "created_at": 1704067200, "status": "completed"}', '{"transaction_id": 2, "amount": "much", "created_at": 1704067300}', "{broken", "{broken", "[1, 2", "null and void", ""]


def test_bad_lines_go_to_the_dead_letters_with_their_number(spark, tmp_path):
    for day in ("2024-01-01", "2024-01-02"):
        (tmp_path / f"in/day={day}").mkdir(parents=True)
        (tmp_path / f"in/day={day}/transactions.jsonl").write_text("\n".join(LINES) + "\n")
    lake, at = Lake(spark, f"file://{tmp_path}/lake"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    source = jsonl.sources(f"file://{tmp_path}/in")["transactions"]
    for _ in range(2):
        assert runs.ingest(lake, source, ["2024-01-01", "2024-01-02", "2024-01-03"], at, "t") == 4
    assert rows(lake.read("bronze.transactions").select("transaction_id", "amount", "event_day")) == [(1, None, "2024-01-01"), (2, None, "2024-01-01")]
    dead = lake.read("bronze_dlq.late_events").collect()
    found = {(r["event_day_observed"], (x := json.loads(r["payload_json"]))["line"]): x["times"] for r in dead}
    assert found == {(d, line): n for d in ("2024-01-01", "2024-01-02") for line, n in (("{broken", 2), ("[1, 2", 1), ("null and void", 1))} and {r["reason"] for r in dead} == {"malformed_line"}
    marks = {r["source_partition"]: r["rows_in_batch"] for r in lake.marks("transactions").collect()}
    assert marks == {"day=2024-01-01": 2, "day=2024-01-02": 2, "day=2024-01-03": 0}
    assert rows(jsonl.read_days(spark, source, ["2024-01-01"]).select("transaction_id")) == [(1,), (2,)]


def test_ingest_reads_its_source_once(spark, tmp_path, monkeypatch):
    (tmp_path / "in/day=2024-01-01").mkdir(parents=True)
    (tmp_path / "in/day=2024-01-01/transactions.jsonl").write_text(LINES[0] + "\n")
    lake, opened = Lake(spark, f"file://{tmp_path}/lake"), []
    lake.table("bronze.transactions").upsert(with_transaction_keys(spark.createDataFrame([(7, 1704067200)], "transaction_id long, created_at long").selectExpr("transaction_id", "1L AS user_id", "'u' AS user_uuid", "1D AS amount", "'RUB' AS currency", "'purchase' AS transaction_type", "null AS promo_code_id", "'failed' AS status", "created_at"), F.current_timestamp().cast("timestamp_ntz")))
    real = jsonl.scan_days

    def seen(spark, source, days):
        opens = spark.sparkContext.accumulator(0)

        def count(batches):
            opens.add(1)
            yield from batches

        opened.append(opens)
        df = real(spark, source, days)
        return df.mapInArrow(count, df.schema)  # runs once for each task that reads the source

    monkeypatch.setattr(runs, "scan_days", seen)
    runs.ingest(lake, jsonl.sources(f"file://{tmp_path}/in")["transactions"], ["2024-01-01"], F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"), "t")
    assert [x.value for x in opened] == [1] and lake.read("bronze.transactions").count() == 2


@pytest.mark.parametrize("more", [{}, {"buckets": 5}])
def test_files_do_not_multiply_with_tasks(spark, tmp_path, more):
    t = table(tmp_path, **more)
    t.snapshot(spark.range(4000, numPartitions=8).selectExpr("concat('k', id) AS k", "id AS v", "'p' AS p" if more else "concat('p', id % 5) AS p", "cast(null AS decimal(10, 2)) AS price"))
    assert t.read(spark).count() == 4000 and t.read(spark).select(F.input_file_name()).distinct().count() == 5


def test_a_task_sorts_a_bounded_range(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        assert table(tmp_path)._files(spark.range(16 << 20)) == 8  # 128 MB
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_first_fill_merges_with_nothing(spark, tmp_path, monkeypatch):
    calls, t = [], table(tmp_path, global_key=False)
    whole = keyed.merged
    monkeypatch.setattr(keyed, "merged", lambda *args: calls.append(1) or whole(*args))
    t.upsert(batch(spark, ("a", 1, "p1"), ("a", 2, "p1"), ("b", 1, "p2")))
    t.upsert(batch(spark, ("c", 1, "p3")))
    assert not calls
    t.upsert(batch(spark, ("a", 3, "p1")))
    assert calls == [1] and rows(t.read(spark).select("k", "v")) == [("a", 3), ("b", 1), ("c", 1)]
