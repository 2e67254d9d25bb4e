"""How far a run is, told by metrics that Spark collects while it computes: no jobs of their own."""

from __future__ import annotations

import threading
import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

EVENTS = "nth int, at double, kind string, stage string, metric string, value long"


class Progress:
    """Events of a run: ``current`` when a stage begins, ``done`` with its metrics, ``log`` lines, ``finish``."""

    def __init__(self):
        self.events: list[tuple[float, str, str, str | None, int | None]] = []
        self._observed: dict[str, Observation] = {}

    def watch(self, stage: str, rows: DataFrame, **metrics: Column) -> DataFrame:
        """``rows``, with their count and the given aggregates observed by the first action that reads them."""
        self.add("current", stage)
        self._observed[stage] = Observation()
        return rows.observe(self._observed[stage], F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in metrics.items()])

    def done(self, stage: str) -> dict[str, int]:
        """The metrics of a stage after its action; waits for an action, if there was none."""
        got = {k: v for k, v in self._observed.pop(stage).get.items()}
        for name, value in sorted(got.items()):
            self.add("done", stage, name, value)
        return got

    def log(self, text: str) -> None:
        self.add("log", text)

    def finish(self) -> None:
        self.add("finish", "run")

    def add(self, kind: str, stage: str, metric: str | None = None, value: int | None = None) -> None:
        self.events.append((time.time(), kind, stage, metric, None if value is None else int(value)))

    def metric(self, stage: str, name: str) -> int | None:
        return next((v for _, kind, s, m, v in reversed(self.events) if (kind, s, m) == ("done", stage, name)), None)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, *e) for i, e in enumerate(self.events, 1)], EVENTS)


def percent(checked: Column) -> Column:
    """What a bar shows after so many files, when their number is not known: it starts anew every hundred."""
    return checked % 100


class StreamProgress(StreamingQueryListener):
    """Rows and observed metrics of every micro-batch; add it with ``spark.streams.addListener``."""

    def __init__(self):
        self.batches: list[dict] = []
        self.ended: dict[str, str | None] = {}
        self._heard = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        observed = {f"{stage}.{k}": v for stage, row in p.observedMetrics.items() for k, v in row.asDict().items()}
        with self._heard:
            self.batches.append({"query": str(p.id), "batch": p.batchId, "rows": p.numInputRows} | observed)
            self._heard.notify_all()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._heard:
            self.ended[str(event.id)] = event.exception
            self._heard.notify_all()

    def wait(self, query: str, seconds: float = 60.0) -> bool:
        """Whether the end of a query was heard of in time; listeners hear of it a little later than the caller."""
        with self._heard:
            return self._heard.wait_for(lambda: query in self.ended, seconds)
