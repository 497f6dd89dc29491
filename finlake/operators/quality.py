"""Data tests: each returns the offending rows, and none means passed."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR, WARN = "error", "warn"


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, column: str) -> DataFrame:
    """Values that stand more than once; nulls do not count."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def accepted_values(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    return df.where(~F.col(column).isin(*values)).groupBy(column).agg(F.count("*").alias("n"))


def same_count(bronze: DataFrame, silver: DataFrame, key: str, order: str) -> DataFrame:
    """One row with both counts where the distinct bronze keys, up to the newest silver row, are not as many as the silver rows."""
    newest = silver.agg(F.max(order).alias("__newest"))
    left = bronze.crossJoin(F.broadcast(newest)).where(F.col(order) <= F.col("__newest")).agg(F.countDistinct(key).alias("bronze_unique"))
    return left.crossJoin(silver.agg(F.count("*").alias("silver_cnt"))).where("bronze_unique <> silver_cnt")


def orphan_rate(children: DataFrame, parents: DataFrame, child: str, parent: str) -> DataFrame:
    """total, orphan_cnt and orphan_pct of the children; a child counts once however many parents it has."""
    known = parents.select(F.col(parent).alias(child)).where(F.col(child).isNotNull()).distinct().withColumn("__known", F.lit(True))
    # Both sides have one row per id, nulls too; the ids of all parents are merged, as they are too many to broadcast.
    counted = children.groupBy(child).agg(F.count("*").alias("__n")).join(known.hint("merge"), child, "left")
    n_of = lambda n, name: F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(name)
    got = counted.agg(n_of("__n", "total"), n_of(F.when(F.col("__known").isNull(), F.col("__n")), "orphan_cnt"))
    return got.withColumn("orphan_pct", F.try_divide(F.col("orphan_cnt") * 100.0, F.col("total")))


def orphans_above(rate: DataFrame, more_than: int = 100, pct: float = 99.0) -> DataFrame:
    """The row of ``orphan_rate`` where more than ``more_than`` children have more than ``pct`` % of orphans; few children prove nothing."""
    return rate.where((F.col("total") > more_than) & (F.col("orphan_pct") > pct))


def run(tests: dict[str, tuple[str, Callable[[], DataFrame]]]) -> dict[str, int]:
    """Runs name -> (severity, test); returns the failures of severity ``warn`` and raises on others."""
    found = {name: (severity, n) for name, (severity, test) in tests.items() if (n := test().count())}
    if bad := {name: n for name, (severity, n) in found.items() if severity == ERROR}:
        raise AssertionError(f"data tests failed: {bad}")
    return {name: n for name, (_, n) in found.items()}
