"""Progress of streaming queries as a table, and queries that run and stop together."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from finlake.operators.keyed import put_text

PROGRESS = "query string, run string, event string, batch long, rows long, at string, error string"


class Progress(StreamingQueryListener):
    """Writes a row for each batch that made progress and each end of a query to files under ``path``; ``names``: query id -> name."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.names = spark, path, {}

    def watch(self, name: str, query: StreamingQuery) -> StreamingQuery:
        self.names[str(query.id)] = name
        return query

    def _put(self, query, run, event: str, batch: int, rows: int, at: str | None, error: str | None = None) -> None:
        row = {"query": str(query), "run": str(run), "event": event, "batch": batch, "rows": rows, "at": at, "error": error}
        put_text(self.spark, f"{self.path}/{event}-{run}-{batch}.json", json.dumps(row) + "\n")

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._put(event.id, event.runId, "started", -1, 0, event.timestamp)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.numInputRows:
            self._put(p.id, p.runId, "progress", p.batchId, p.numInputRows, p.timestamp)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._put(event.id, event.runId, "ended", -1, 0, None, event.exception)

    def read(self) -> DataFrame:
        """The rows so far; queries that were watched by their names."""
        rows = self.spark.read.schema(PROGRESS).option("pathGlobFilter", "*.json").json(self.path)
        return rows.replace(self.names, subset=["query"]) if self.names else rows


def together(spark: SparkSession, queries: list[StreamingQuery], timeout: float | None = None) -> bool:
    """Waits until one of ``queries`` ends, or ``timeout`` seconds; all are stopped then. A failure is raised once all have stopped. True if one ended by itself."""
    import time

    until = None if timeout is None else time.monotonic() + timeout
    try:
        while all(q.isActive for q in queries) and (until is None or time.monotonic() < until):
            next(iter(queries)).awaitTermination(1)
    finally:
        ended = any(not q.isActive for q in queries)
        for query in queries:
            query.stop()
    for query in queries:
        if error := query.exception():
            raise error
    return ended
