"""The changes of a keyed table as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from finlake.operators.keyed import MANIFEST, MANIFEST_FILES, KeyedTable, exists, get_text, put_text

EARLIEST, LATEST = "earliest", "latest"


def _start(spark: SparkSession, table: KeyedTable, start: str | int, checkpoint: str) -> int:
    """The version after which a stream begins; settled once for a checkpoint."""
    at = f"{checkpoint}.start"
    if not exists(spark, at):
        number = {EARLIEST: -1, LATEST: table.version(spark)}.get(start, start)
        put_text(spark, at, str(-1 if number is None else number))
    return int(get_text(spark, at))


def follow(table: KeyedTable, spark: SparkSession, handler: Callable[[DataFrame, int, int], None], checkpoint: str, start: str | int = EARLIEST, trigger: dict | None = None) -> StreamingQuery:
    """Calls ``handler(changes, version, batch)`` with what differs by key from the version handled before.

    Spark's file stream reads the manifests, so the checkpoint holds the position,
    and a restart goes on after the last batch. Versions that came since are handled
    together, as their net changes; only folders that changed are read. ``start``:
    all rows (earliest), what changes from now on (latest), or the changes after a
    version; it counts where there is no checkpoint yet. A stream that fell behind
    by more versions than the table keeps fails with LookupError.
    """
    first = _start(spark, table, start, checkpoint)
    manifests = spark.readStream.schema(MANIFEST).option("pathGlobFilter", MANIFEST_FILES).json(table.manifests)

    def run(batch: DataFrame, number: int) -> None:
        versions = [r["version"] for r in batch.select("version").collect()]  # as many as there are commits
        until = max(versions, default=-1)
        after = first if number == 0 else max(min(versions, default=0) - 1, first)
        if until > after:
            handler(table.changes(spark, after, until), until, number)

    return manifests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
