"""Counters of a write, taken on the way: observed metrics in place of a second pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener


def write_counted(df: DataFrame, path: str, counters: dict[str, Column]) -> dict[str, int]:
    """Writes df and gives its counters (aggregates by name), which Spark works out in the tasks that write."""
    seen = Observation()
    df.observe(seen, *[c.alias(n) for n, c in counters.items()]).write.parquet(path)
    return dict(seen.get)


class Counted(StreamingQueryListener):
    """Adds up a stream's observed counters over its batches, by the name under which they are observed."""

    def __init__(self, name: str):
        self.name, self.totals, self.batches = name, {}, set()

    def onQueryStarted(self, event) -> None:  # noqa: N802  Spark's names
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        metrics = event.progress.observedMetrics.get(self.name)
        if metrics is not None and (event.progress.id, event.progress.batchId) not in self.batches:
            self.batches.add((event.progress.id, event.progress.batchId))  # a batch that is tried again counts once
            for n, v in metrics.asDict().items():
                self.totals[n] = self.totals.get(n, 0) + (v or 0)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def totals(query: StreamingQuery, name: str) -> dict[str, int]:
    """The same from the progress that a finished query keeps (its last hundred batches)."""
    out: dict[str, int] = {}
    for progress in query.recentProgress:
        for n, v in (progress.observedMetrics.get(name).asDict() if progress.observedMetrics.get(name) is not None else {}).items():
            out[n] = out.get(n, 0) + (v or 0)
    return out
