"""Which side of a join may be sent to all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that are broadcast at most; with more of them, both sides are merged.
MOST_BROADCAST = 100_000


def counted(df: DataFrame) -> DataFrame:
    """``df``, a stored table, as a side of a join: merged with the other side where it has many rows.

    Catalyst knows the size of its files alone, and compressed columns of millions of keys
    are smaller than what it broadcasts, which the driver holds as rows. The count reads
    the files' footers, so ``df`` should be a table or columns of one.
    """
    return df if df.count() <= MOST_BROADCAST else df.hint("merge")
