"""Vectors as whole numbers, for sums that are exact in any order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Whole steps that a unit of a component has.
SCALE = 1024


def whole_numbers(df: DataFrame, columns: tuple[str, ...], vector: str, limit: int, offset: int = 0, multiple: int = 1) -> DataFrame:
    """``columns`` and ``x``: floor(SCALE * component) + offset, as array<bigint>.

    Rows whose vector is null, or holds a null or non-finite component, are left
    out. Scaled components beyond ``limit`` count as ``limit``, with their sign. All
    arrays have one length, that of the longest vector rounded up to a ``multiple``:
    shorter ones count as if zeros followed.
    """
    values = F.transform(vector, lambda c: c.cast("double"))
    finite = F.forall("__v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = df.select(*columns, values.alias("__v")).where(F.col("__v").isNotNull() & F.coalesce(finite, F.lit(False)))
    longest = kept.agg(F.max(F.size("__v"))).first()[0] or 0
    size = -(-longest // multiple) * multiple
    x = F.transform("__v", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(float(limit))), F.lit(float(-limit)))).cast("long") + offset)
    rest = F.array_repeat(F.lit(offset).cast("long"), F.lit(size) - F.size("__v"))
    return kept.select(*columns, F.concat(x, rest).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
