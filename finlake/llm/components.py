"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finlake.llm.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component): for each id of an edge (a, b), the smallest id reachable.

    Every round takes the smallest label among the neighbours and then the
    label of that label, so paths shorten by half. Each round is written to
    the shared folder; only the number of changes reaches the driver.
    """
    pairs = edges.where("a <> b").select("a", "b")
    pairs = scratch.save(pairs.union(pairs.select("b", "a")).distinct(), f"{name}-edges")
    labels = scratch.save(pairs.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = pairs.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("component").alias("before"), F.least("component", "near").alias("low"))
        lower = scratch.save(lower, f"{name}-low{step}")
        jump = labels.select(F.col("id").alias("low"), F.col("component").alias("beyond"))
        after = lower.join(jump, "low", "left").select("id", "before", F.least("low", F.coalesce("beyond", "low")).alias("component"))
        after = scratch.save(after, f"{name}-{step}")
        done = after.where("before <> component").isEmpty()
        scratch.drop(f"{name}-{step - 1}", f"{name}-low{step}")
        labels = after.select("id", "component")
        if done:
            scratch.drop(f"{name}-edges")
            return labels
