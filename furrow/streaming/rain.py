"""Rain telemetry as streams: window totals, running excess with state, storms as sessions, first artifacts."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from furrow.session import ship

c = F.col


def stream_rain(df: DataFrame, width: str, slide: str | None, delay: str) -> DataFrame:
    """gauge_id, start, depth_mm, intensity_mm_h (depth over the window's length), n of tumbling (slide null) or sliding
    windows over ts, rain_mm."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = df.withWatermark("ts", delay).groupBy("gauge_id", w.alias("w")).agg(F.sum("rain_mm").alias("depth_mm"), F.count(F.lit(1)).alias("n"))
    hours = (c("w.end").cast("double") - c("w.start").cast("double")) / 3600
    return g.select("gauge_id", c("w.start").alias("start"), "depth_mm", (c("depth_mm") / hours).alias("intensity_mm_h"), "n")


def stream_storms(df: DataFrame, gap: str, delay: str) -> DataFrame:
    """gauge_id, start, end, depth_mm, n of storms: records less than gap apart."""
    g = df.withWatermark("ts", delay).groupBy("gauge_id", F.session_window("ts", gap).alias("w")).agg(F.sum("rain_mm").alias("depth_mm"), F.count(F.lit(1)).alias("n"))
    return g.select("gauge_id", c("w.start").alias("start"), c("w.end").alias("end"), "depth_mm", "n")


#: Parts that events are dealt to. A part's events share a call of the processor, a state and a timer; one call, which costs the
#: same for one event as for hundreds, was most of the work. Of a million live events a part holds some 500.
PARTS = 2048


class RunningExcess(StatefulProcessor):
    """Keeps the cumulative rain of each event of a part; intervals come in the order of their index. An event that brings
    nothing for idle_ms of event time ends, which drops it from the state; the part's timer is never later than the first
    of these ends. Intervals behind the watermark change nothing and are told as late."""

    COLUMNS = ("event_id", "kind", "idx", "cumulative_mm", "excess_mm")

    def __init__(self, cn: float, ratio: float, idle_ms: int):
        self.s = 25400.0 / cn - 254.0
        self.ia, self.idle_ms = ratio * self.s, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "event_id array<bigint>, mm array<double>, last_ms array<bigint>, idx array<int>, timer bigint")

    def runoff(self, p: float) -> float:
        return 0.0 if p <= self.ia else (p - self.ia) ** 2 / (p - self.ia + self.s)

    def rows(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=list(self.COLUMNS))

    def held(self) -> tuple[dict[int | None, tuple[float, int, int]], int | None]:
        """The part's events, with their rain, last time and last index, and when its timer goes off."""
        got = self.total.get()
        return (dict(zip(got[0], zip(*got[1:4], strict=True), strict=True)), got[4]) if got else ({}, None)

    def keep(self, events: dict[int | None, tuple[float, int, int]], timer: int | None) -> None:
        """timer: when the part's timer goes off as yet. One that is early stays: it ends nothing and is set again then."""
        if not events:
            self.total.clear()
            return
        first = min(last for _, last, _ in events.values()) + self.idle_ms
        if timer is None or first < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
            timer = first
        mm, last, idx = map(list, zip(*events.values(), strict=True))
        self.total.update((list(events), mm, last, idx, timer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values("idx", kind="stable")
        if key[0] < 0:  # the part of a null id
            every["event_id"] = None
        late = every["ms"] < timerValues.getCurrentWatermarkInMs()
        out = [(e, "LATE", idx, None, None) for e, idx in zip(every["event_id"][late], every["idx"][late], strict=True)]
        every = every[~late]
        if len(every):
            events, timer = self.held()
            for e, idx, rain, ms in zip(*(every[n].tolist() for n in ("event_id", "idx", "rain_mm", "ms")), strict=True):
                mm, last, _ = events.get(e, (0.0, 0, 0))
                before, mm = self.runoff(mm), mm + rain
                events[e] = mm, max(last, int(ms)), int(idx)
                out.append((e, "INTERVAL", idx, mm, max(0.0, self.runoff(mm) - before)))
            self.keep(events, timer)
        yield self.rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        events, _ = self.held()
        now = timerValues.getCurrentWatermarkInMs()
        over = {e: v for e, v in events.items() if v[1] + self.idle_ms <= now}
        self.keep({e: v for e, v in events.items() if e not in over}, None)
        if over:
            yield self.rows([(e, "ENDED", idx, mm, self.runoff(mm)) for e, (mm, _, idx) in over.items()])

    def close(self) -> None:
        pass


def stream_excess(df: DataFrame, cn: float, ratio: float, delay: str, idle_ms: int, parts: int = PARTS) -> DataFrame:
    """event_id, kind, idx, cumulative_mm, excess_mm of a stream of (event_id, idx, ts, rain_mm). kind INTERVAL: one row an
    interval, with the event's rain so far and the interval's excess; LATE: an interval behind the watermark, which counts
    for nothing else; ENDED: the event is over (nothing for idle_ms), with its rain and its whole excess, and its state is
    dropped.

    parts: how many parts the events are dealt to by their id. A batch writes the state of the parts that it touches, so
    there should be more for many millions of events that live at once; a stream keeps the number that it began with."""
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the processor also runs beside the driver, where the package may not be on the path
    # the time goes on as a plain number: rows behind the watermark are to be told, not dropped before they are seen
    rows = df.withWatermark("ts", delay).select("event_id", "idx", "rain_mm", (F.unix_micros("ts") / 1000).cast("bigint").alias("ms"))
    # null ids have a part of their own, as beside them pandas would make other ids floats
    rows = rows.withColumn("part", F.when(c("event_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("event_id"), F.lit(parts))).cast("int"))
    return rows.groupBy("part").transformWithStateInPandas(RunningExcess(cn, ratio, idle_ms), "event_id bigint, kind string, idx int, cumulative_mm double, excess_mm double", "Append", "EventTime")


def stream_artifacts(df: DataFrame, declared: DataFrame, delay: str) -> DataFrame:
    """First record of each (run_id, sha256) within the watermark, with whether it was declared."""
    first = df.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["run_id", "sha256"])
    return first.join(declared.withColumn("declared", F.lit(True)), ["run_id", "sha256"], "left").select("run_id", "sha256", F.coalesce("declared", F.lit(False)).alias("declared"))
