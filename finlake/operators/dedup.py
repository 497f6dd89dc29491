"""Newest row of each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Where a row stood in its source, in order of delivery; frames need not have it.
POSITION = "source_offset"


def latest(df: DataFrame, key: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first by ``order``. Of equal ones that delivered first stays, if POSITION is known, else the smaller hash of all columns, so runs agree.

    Catalyst turns the rank filter into WindowGroupLimit before the shuffle, so
    a hot key sends one row per task.
    """
    delivered = [F.col(POSITION).asc_nulls_last()] if POSITION in df.columns else []
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order, *delivered, F.xxhash64(*df.columns)))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def cutover(batch: DataFrame, residual: DataFrame, key: str) -> DataFrame:
    """Batch rows win over what a stream left in the partition; within one origin the newest wins."""
    both = batch.withColumn("__origin", F.lit(0)).unionByName(aligned(residual, batch).withColumn("__origin", F.lit(1)))
    return latest(both, [key], [F.col("__origin").asc(), F.col("ingested_at").desc()]).drop("__origin")


def aligned(df: DataFrame, like: DataFrame) -> DataFrame:
    """``df`` with the columns of ``like``: missing ones null, others dropped."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema])
