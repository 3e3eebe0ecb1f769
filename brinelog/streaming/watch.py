"""A watch over vessels as their positions come, in event time: gaps, speed drops, dwells, and silence without a next report.

Positions may come in any order within the watermark's delay: they wait in state until the watermark has passed them and are then taken in
order, so that a replay gives what the whole table gives. Positions later than that are dropped by Spark, which counts them
(`late_rows`). Timers of event time take what waits, tell of a vessel that has been silent for `silent_s`, and forget
one that hasn't reported for `forget_s`. State is one position, the anchor of the present dwell, and what waits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.folds import distance_km

OUT = "mmsi long, t double, code string, severity double"
WAITING = "t double, ordinal long, lat double, lon double, speed double"
KNOWN = "t double, speed double, n long, anchor_t double, phi double, lam double, dwell double, told_dwell boolean, told_silent boolean"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # what timers need: spark.sql.streaming.stateStore.providerClass


class Watch(StatefulProcessor):
    def __init__(self, km: float, least: float, silent_s: float, forget_s: float) -> None:
        self.km, self.least, self.silent_s, self.forget_s = km, least, silent_s, forget_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.known = handle.getValueState("known", KNOWN)

    def step(self, known: tuple | None, row: tuple, out: list) -> tuple:
        """The state after a position, which comes no earlier than any before it."""
        t, _, lat, lon, speed = row
        phi, lam = math.radians(lat), math.radians(lon)
        if known is None:
            return (t, speed, 1, t, phi, lam, None, False, False)
        last_t, last_speed, n, anchor_t, a_phi, a_lam, dwell, told_dwell, _ = known
        dt, n = t - last_t, n + 1
        if dt > 0 and dt <= 600 and speed is not None and last_speed is not None and last_speed - speed > 5:
            out.append((t, "speed_drop", min(1.0, (last_speed - speed) / 15)))
        if dt > 1800:
            out.append((t, "ais_gap_long" if dt > 2700 else "ais_gap_short", min(1.0, dt / 60 / 180)))
        if dwell is None:
            if distance_km(a_phi, a_lam, phi, lam) > self.km:
                anchor_t, a_phi, a_lam = t, phi, lam
            elif t - anchor_t > self.least:
                dwell = t - anchor_t
        if dwell is not None and n >= 3 and not told_dwell:
            out.append((t, "loitering", min(1.0, dwell / 21600)))
            told_dwell = True
        return (t, speed, n, anchor_t, a_phi, a_lam, dwell, told_dwell, False)

    def settle(self, key: tuple, rows: list[tuple], watermark_ms: int) -> Iterator[pd.DataFrame]:
        """Takes what the watermark has passed, in order; tells of silence; sets the next timer; forgets."""
        now, out = watermark_ms / 1000, []
        waiting = sorted([*(self.waiting.get() if self.waiting.exists() else ()), *rows], key=lambda r: (r[0], r[1] if r[1] is not None else -1))
        ready, later = [r for r in waiting if r[0] <= now], [r for r in waiting if r[0] > now]
        known = self.known.get() if self.known.exists() else None
        for row in ready:
            known = self.step(known, row, out)
        due = later[0][0] if later else math.inf
        if known is not None:
            if not known[8] and min(now, due) >= known[0] + self.silent_s:
                out.append((known[0] + self.silent_s, "went_silent", min(1.0, self.silent_s / 60 / 180)))
                known = (*known[:8], True)
            if not later and now >= known[0] + self.forget_s:
                known = None
            else:
                due = min(due, known[0] + (self.forget_s if known[8] else self.silent_s))
        if later:
            self.waiting.put(later)
        elif waiting:
            self.waiting.clear()
        if known is not None:
            self.known.update(known)
        elif self.known.exists():
            self.known.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if due < math.inf:
            self.handle.registerTimer(max(math.ceil(due * 1000), watermark_ms + 1))
        if out:
            yield pd.DataFrame([(int(key[0]), *o) for o in out], columns=["mmsi", "t", "code", "severity"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        got = [tuple(None if pd.isna(v) else v for v in r) for pdf in rows for r in pdf[["t", "ordinal", "lat", "lon", "speed"]].itertuples(index=False)]
        got = [(float(t), None if o is None else int(o), float(lat), float(lon), s) for t, o, lat, lon, s in got if None not in (t, lat, lon)]
        yield from self.settle(key, got, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        yield from self.settle(key, [], max(timerValues.getCurrentWatermarkInMs(), 0))

    def close(self) -> None:
        pass


def watch(positions: DataFrame, delay: str = "10 minutes", km: float = 2.0, least: float = 3600.0, silent_s: float = 2700.0, forget_s: float = 86400.0) -> DataFrame:
    """OUT of a stream of positions (mmsi, ordinal, t, lat, lon, speed; t in epoch seconds). Rows with a null mmsi, t or place take no part."""
    timed = positions.where("mmsi IS NOT NULL AND t IS NOT NULL").selectExpr("mmsi", "ordinal", "t", "lat", "lon", "speed", "timestamp_micros(CAST(t * 1000000 AS BIGINT)) AS event_time").withWatermark("event_time", delay)
    return timed.groupBy("mmsi").transformWithStateInPandas(Watch(km, least, silent_s, forget_s), OUT, "append", "EventTime")


def late_rows(query: StreamingQuery) -> int:
    """How many positions so far were later than the watermark and dropped."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
