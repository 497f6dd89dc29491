import shutil

import duckdb
import pytest
from support import SF, same_rows

from finlake.plans import catalogue, written

QUERIES, ORACLE = catalogue.QUERIES | written.QUERIES, catalogue.ORACLE | written.ORACLE


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) and not set(catalogue.QUERIES) & set(written.QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(name, spark, duck):
    same_rows(QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE[name]).df())


def test_cutover_merges_every_day(spark):
    """Each day keeps every key, and has rows of both sides."""
    found = catalogue.QUERIES["cutover_merge_all"](spark, SF).toPandas()
    every = catalogue.QUERIES["upsert_latest"](spark, SF).toPandas()
    assert sorted(found["composite_pk"]) == sorted(every["composite_pk"]) and every["event_day"].nunique() > 1
    sides = found["status"].str.startswith("stream-").groupby(found["event_day"]).agg(["any", "all"])
    assert set(sides.index) == set(every["event_day"]) and sides["any"].all() and not sides["all"].any()


def test_cancellations_by_reason_have_every_group(spark, tmp_path):
    """10,500 reasons of one cancellation each, more than the row limit of a dashboard: all are there, in order, of settled and live days."""
    for name in ("customer", "part"):
        shutil.copy(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i * 10 + 9 AS event_id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(i * 3) AS ts, i % 50 + 1 AS user_id, 'reason ' || i AS event_type, 1.5::DOUBLE AS value, '{{}}' AS props
      FROM range(14000) r(i) ORDER BY i) TO '{tmp_path}/events.parquet'""")
    for name in ("customer", "part", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    expected = con.execute(ORACLE["chart_cancellations_by_reason"]).df()
    found = QUERIES["chart_cancellations_by_reason"](spark, str(tmp_path)).toPandas()
    same_rows(found, expected)
    keys = list(zip(found["cancel_day"], found["reason"]))
    assert len(keys) > 10000 and keys == sorted(keys) and min(keys)[0] <= catalogue.SETTLED_UNTIL < max(keys)[0]
