"""Daily allowances over a stream of requests."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.quota import DAILY_CAP, utc_day
from ..sources.latest import LatestTable
from .runs import drain

KEPT = "26 hours"  # fixed value: how long a counter outlives its last request
KEPT_MS = 26 * 3600 * 1000


class _Counters(StatefulProcessor):
    """Admits a caller's requests of a day as long as fewer than the cap were admitted before. A caller's counters are one value, as each look at the store costs more than many requests."""

    def __init__(self, cap: int, kept_ms: int):
        self.cap, self.kept_ms = cap, kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", "counters string", self.kept_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        found, now = self.counters.get(), timerValues.getCurrentProcessingTimeInMs()
        counters = {day: (used, until) for day, used, until in json.loads(found[0]) if until > now} if found else {}
        admitted = 0
        for r in sorted(rows, key=lambda r: (r.ts is not None, r.ts, r.request is not None, r.request)):
            used, _ = counters.get(r.day, (0, now))
            allowed = used < self.cap
            if allowed:
                used, admitted = used + 1, admitted + 1
                counters[r.day] = used, now + self.kept_ms
            yield Row(who=key[0], day=r.day, request=r.request, ts=r.ts, allowed=allowed, used=used, remaining=self.cap - used)
        if admitted:
            self.counters.update((json.dumps([(day, *counter) for day, counter in counters.items()]),))

    def close(self) -> None:
        pass


def live_admission(requests: DataFrame, who: str, ts: str, request: str, cap: int = DAILY_CAP, kept_ms: int = KEPT_MS) -> DataFrame:
    """Each request of a stream with allowed (fewer than ``cap`` of the caller's UTC day were admitted before), and used and remaining after it.

    The state store holds a caller's counters, one for each day, which is let go of 26 hours after the last request that it admitted; refused requests
    leave it as it is. Requests of a micro-batch are taken by ``ts`` and then ``request``; micro-batches in the order in which they come. Requests of
    one caller are taken one after another, so none is admitted twice, which the read-then-write of a shared counter would allow.
    """
    rows = requests.select(F.col(who).cast("string").alias("who"), utc_day(F.col(ts)).cast("string").alias("day"), F.col(request).cast("long").alias("request"), F.col(ts).alias("ts"))
    shape = "who string, day string, request long, ts timestamp, allowed boolean, used long, remaining long"
    return rows.groupBy("who").transformWithState(_Counters(cap, kept_ms), shape, "append", "ProcessingTime")


def live_daily_usage(requests: DataFrame, who: str, ts: str, cap: int = DAILY_CAP) -> DataFrame:
    """T5: requests and used per caller and UTC day, as a tumbling window with a watermark of 26 hours.

    The watermark is our choice: requests that come later than that are dropped, and a day's counter is let go of then.
    """
    day = F.window(ts, "1 day")
    counted = requests.withWatermark(ts, KEPT).groupBy(day, who).agg(F.count(F.lit(1)).alias("requests"))
    return counted.select(who, F.col("window.start").cast("date").alias("day"), "requests", F.least("requests", F.lit(cap).cast("long")).alias("used"))


def publish_latest(rows: DataFrame, table: LatestTable, checkpoint: str) -> None:
    """Put what a stream tells into a table of latest values, a version for each micro-batch; one that runs again changes nothing."""
    drain(rows, checkpoint, each=table.upsert, mode="update")
