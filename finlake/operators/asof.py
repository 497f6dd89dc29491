"""As-of pick of a rate for a day: the last on or before it, else the first after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SOURCES = ("forward", "backward", "missing")


def as_of(needed: DataFrame, rates: DataFrame, by: str, day: str, value: str, at: str) -> DataFrame:
    """``needed`` (distinct by, day) with the picked ``value`` and ``rate_source``.

    Both sides are laid on one time line per ``by`` and swept by two window
    frames, so the cost is a sort of days, not days times quotes. At most one
    quote per (by, day) is expected. A null ``by`` matches nothing.
    """
    quotes = rates.select(F.col(by), F.col(at).alias(day), F.struct(F.col(value)).alias("__quote"), F.lit(0).alias("__kind"))
    asked = needed.select(by, day).distinct().where(F.col(by).isNotNull()).withColumns({"__quote": F.lit(None).cast(quotes.schema["__quote"].dataType), "__kind": F.lit(1)})
    line = Window.partitionBy(by).orderBy(day, "__kind")
    behind = F.last("__quote", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("__quote", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing))
    swept = quotes.unionByName(asked).withColumns({"__behind": behind, "__ahead": ahead}).where("__kind = 1")
    source = F.when(F.col("__behind").isNotNull(), SOURCES[0]).when(F.col("__ahead").isNotNull(), SOURCES[1]).otherwise(SOURCES[2])
    return swept.select(by, day, F.coalesce("__behind", "__ahead")[value].alias(value), source.alias("rate_source"))
