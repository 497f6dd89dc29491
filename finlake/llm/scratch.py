"""Working tables in the folder all executors share, and Arrow batch helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlake.sources.storage import shared_root

#: Bytes of text that a NumPy kernel looks at together; bounds its temporary arrays.
BLOCK_BYTES = 1 << 20

#: Settings of a step that writes a table: its shuffle files go at once, and Arrow batches stay small however long the texts.
_STEP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


class Scratch:
    """Tables of one run of one operator, written as Parquet under the shared folder.

    Writing a table cuts the lineage: a lost executor costs the tasks of the
    current step only. The shuffle files of the step go when it ends. Results
    read these tables, so they go when they are dropped or the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.saved = spark, False
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, table: str, by: str | None = None) -> DataFrame:
        """Writes and rereads ``df``; ``by``: the column that its files are kept apart by."""
        conf = self.spark.conf
        before = {key: conf.get(key, None) for key in _STEP}
        for key, value in _STEP.items():
            conf.set(key, value)
        try:
            writer = df.write.mode("overwrite")
            (writer.partitionBy(by) if by else writer).parquet(f"{self.path}/{table}")
        finally:
            for key, value in before.items():
                if value is None:
                    conf.unset(key)
                else:
                    conf.set(key, value)
        if not self.saved:
            store, at = self._folder(self.path)
            store.deleteOnExit(at)
            self.saved = True
        return self.load(df.schema, table)

    def load(self, schema, table: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")

    def _folder(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def drop(self, *tables: str) -> None:
        """Deletes these tables, or all without a name."""
        for path in [f"{self.path}/{t}" for t in tables] or [self.path]:
            store, at = self._folder(path)
            store.delete(at, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def by_block(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Slices batches so that each holds about ``limit`` bytes of text and at most ``rows`` rows, or one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and (held + size > limit or i - start >= rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def arrow_map(df: DataFrame, kernel: Callable[[pa.RecordBatch], dict], schema: str, text: str = "text", rows: int = 1 << 16) -> DataFrame:
    """``mapInArrow`` where ``kernel`` turns one block of rows into columns named as in ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for block in by_block(batches, text, rows=rows):
            made = kernel(block)
            columns = [c if isinstance(c := made[f.name], pa.Array) else pa.array(c, type=f.type) for f in target]
            yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, target)], schema=target)

    return df.mapInArrow(run, schema)


def in_sample(doc_id):
    """Rows that a model may learn from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(doc_id.cast("string")) % 3 != 1
