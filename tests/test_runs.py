"""Nightly runs, models side by side, tables of the catalogue, joins of rows without keys, progress of streams."""

import pytest
from pyspark.sql import functions as F
from support import SF

from finlake.operators import quality
from finlake.operators.keyed import KeyedTable
from finlake.plans import gold, runs, silver, written
from finlake.plans.lake import Lake
from finlake.sources import adapters
from finlake.streaming import progress


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_failing_model_stops_the_run(spark, tmp_path, monkeypatch):
    lake = written._bronze(spark, SF)
    monkeypatch.setattr(lake.__class__, "root", lake.root, raising=False)
    slow = lambda w, d: w.read("bronze.cancellations").withColumn("x", F.expr("raise_error('model failed')")).where("x is null")
    monkeypatch.setitem(runs.MODELS, "silver.cancellations_clean", slow)
    with pytest.raises(Exception, match="model failed"):
        runs.run_models(lake)
    later = [name for level in runs.LEVELS[1:] for name in level]
    assert all(lake.table(name).version(spark) == 0 and lake.read(name).isEmpty() for name in [*later, "silver.cancellations_clean"])
    monkeypatch.undo()
    assert set(runs.run_models(lake)) == set(runs.MODELS)  # and the next run does it all
    assert {x for level in runs.LEVELS for x in level} == set(runs.MODELS)


@pytest.mark.parametrize("more", [{}, {"partition": "p"}, {"partition": "p", "buckets": 3}])
def test_other_sessions_find_a_table_by_its_name(spark, tmp_path, more):
    spark.sql("CREATE SCHEMA IF NOT EXISTS names")
    name = f"names.t{len(more)}"
    t = KeyedTable(f"file://{tmp_path}/t", "k string, v long, p string", ("k",), "v", name=name, **more)
    t.create(spark)
    other = spark.newSession()
    assert other.table(name).columns and other.table(name).isEmpty()
    t.upsert(spark.createDataFrame([("a", 1, "p1"), ("b", 1, "it's 2/3"), ("c", 1, None)], t.schema))
    assert rows(other.table(name).select("k", "v", "p")) == [("a", 1, "p1"), ("b", 1, "it's 2/3"), ("c", 1, None)]
    t.upsert(spark.createDataFrame([("a", 2, "p2")], t.schema))
    assert rows(other.table(name).select("k", "v", "p")) == [("a", 2, "p2"), ("b", 1, "it's 2/3"), ("c", 1, None)]
    t.snapshot(spark.createDataFrame([("z", 9, "p1")], t.schema))
    assert rows(spark.newSession().sql(f"SELECT k, v, p FROM {name}")) == [("z", 9, "p1")]


def test_rows_without_a_key_do_not_meet_in_one_task(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    for k, v in {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}.items():
        spark.conf.set(k, v)
    try:
        b = adapters.Bronze(spark, SF)
        wide = spark.range(8000).selectExpr("id AS transaction_id", "if(id % 4 > 0, null, id % 97) AS user_id", "if(id % 4 > 0, null, concat('u-', id)) AS user_uuid", "if(id % 4 > 0, null, id % 991) AS promo_code_id", "1D AS amount", "'completed' AS status", "'purchase' AS transaction_type", "'2024-01-01' AS event_day")
        out = silver.enriched(wide, b.users, b.test_users, b.promo_codes)
        sizes = sorted(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
        assert sum(sizes) == 8000 and len(sizes) == 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
        plain = wide.join(b.users.select("user_id", F.col("is_test_user").alias("t")), "user_id", "left")
        assert out.where("is_user_unknown").count() == plain.where("user_id is not null and t is null").count()
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_days_attribution_reads_named_transactions_only(spark):
    w = written.Warehouse(spark, SF)
    plan = gold.cancellations_summary(w.cancelled, w.tx, written.RUN_DATE)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") >= 2


def test_progress_of_queries_that_stop_together(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"in{n}").mkdir()
        (tmp_path / f"in{n}/a.txt").write_text("x\n" * (n + 1))
    (tmp_path / "progress").mkdir()
    listener = progress.Progress(spark, f"file://{tmp_path}/progress")
    spark.streams.addListener(listener)

    def start(n, fail=False):
        def handle(df, number):
            df.count()
            if fail and number:
                raise RuntimeError("third query broke")

        writer = spark.readStream.text(f"file://{tmp_path}/in{n}").writeStream.foreachBatch(handle).option("checkpointLocation", f"file://{tmp_path}/c{n}")
        return listener.watch(f"q{n}", writer.trigger(processingTime="1 second").start())

    try:
        queries = [start(0), start(1), start(2, fail=True)]
        assert not progress.together(spark, queries, timeout=15) and not any(q.isActive for q in queries)
        queries = [start(0), start(1), start(2, fail=True)]
        for n in range(3):
            (tmp_path / f"in{n}/b.txt").write_text("y\n")
        with pytest.raises(Exception, match="third query broke"):
            progress.together(spark, queries, timeout=60)
        assert not any(q.isActive for q in queries)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = listener.read()
        counts = {r["query"]: r["n"] for r in found.where("event = 'progress'").groupBy("query").agg(F.sum("rows").alias("n")).collect()}
        assert counts["q0"] >= 1 and counts["q1"] >= 2 and counts["q2"] >= 3
        assert {r["query"] for r in found.where("event = 'ended' and error like '%third query broke%'").collect()} == {"q2"}
    finally:
        spark.streams.removeListener(listener)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_rows_of_a_dimension_are_not_broadcast(spark, tmp_path):
    """Their files are smaller than what Spark broadcasts, their rows in the driver are not."""
    dims = (
        spark.range(150_000).selectExpr("id AS user_id", "concat('u-', id) AS user_uuid", "id % 3 = 0 AS is_test_user"),
        spark.range(150_000).selectExpr("concat('u-', id * 2) AS test_user_uuid"),
        spark.range(150_000).selectExpr("id AS promo_code_id", "'2024-01-03' AS expiry_date"),
    )
    many, few = [], []
    for n, df in enumerate(dims):
        for size, out in ((150_000, many), (100, few)):
            at = f"file://{tmp_path}/{n}-{size}"
            df.limit(size).write.option("compression", "zstd").parquet(at)
            out.append(spark.read.parquet(at))
    tx = spark.range(400).selectExpr("id AS transaction_id", "id AS user_id", "concat('u-', id) AS user_uuid", "if(id % 4 = 0, null, id) AS promo_code_id", "1D AS amount", "'completed' AS status", "'purchase' AS transaction_type", "'2024-01-05' AS event_day")
    large, small = silver.enriched(tx, *many), silver.enriched(tx, *few)
    assert "BroadcastHashJoin" not in plan_of(large) and plan_of(small).count("BroadcastHashJoin") == 3
    assert large.where("is_user_unknown").count() == 0 and small.where("is_user_unknown").count() == 300
    assert large.where("is_test_user").count() == 267 and large.where("is_promo_expired_at_use").count() == 300


def test_kept_first_days_of_many_users_are_not_broadcast(spark, tmp_path):
    tx = spark.range(300).selectExpr("id AS user_id", "false AS is_test_user", "false AS is_user_missing", "true AS is_revenue_eligible", "'2024-01-05' AS event_day", "'completed' AS status", "1D AS amount", "TIMESTAMP_NTZ'2024-01-06 00:00:00' AS ingested_at")
    first = KeyedTable(f"file://{tmp_path}/first", "user_id long, first_day string, not_before date", ("user_id",), "not_before")
    first.snapshot(spark.range(150_000).selectExpr("id AS user_id", "if(id < 100, '2024-01-05', '2024-01-01') AS first_day", "DATE'1970-01-01' AS not_before"))

    class Tables:
        @staticmethod
        def read(name):
            return first.read(spark) if name == "silver.users_first_seen" else tx

    made = runs.MODELS["gold.user_cohorts"](Tables, None)
    assert "BroadcastHashJoin" not in plan_of(made)
    assert rows(made.select("user_type", "unique_users")) == [("new", 100), ("returning", 200)]


def test_orphans_are_counted_without_a_broadcast_of_all_parents(spark, tmp_path):
    spark.range(150_000).selectExpr("id AS transaction_id").write.option("compression", "zstd").parquet(f"file://{tmp_path}/parents")
    parents = spark.read.parquet(f"file://{tmp_path}/parents")
    children = spark.range(1000).selectExpr("if(id % 10 = 0, null, 149500 + id) AS original_transaction_id")
    found = quality.orphan_rate(children.union(children), parents.union(parents.limit(10)), "original_transaction_id", "transaction_id")
    assert "BroadcastHashJoin" not in plan_of(found)
    assert rows(found) == [(2000, 1100, 55.0)]
    assert rows(quality.orphan_rate(children.limit(0), parents, "original_transaction_id", "transaction_id")) == [(0, 0, None)]
