"""Live sessions with typed state, timers and stop rules; state goes when a session ends or falls silent.

Needs Spark's RocksDB state store: `use_rocksdb` sets it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "session long, zone string, seconds double, entries long, distance double, frames long, detected long, late long, phase string"
WALK = "frame long, time double, begin double, x double, y double, zone string, distance double, frames long, detected long, late long"
COLUMNS = ["zone", "seconds", "entries", "distance", "frames", "detected", "late", "phase"]


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@dataclass(frozen=True)
class StopRules:
    """When a session ends by itself: after so many seconds, after so much way, or with so many entries into a zone; by any
    of the rules that are set, or by all of them together."""

    seconds: float | None = None
    distance: float | None = None
    zone: str | None = None
    entries: int | None = None
    together: bool = False

    def met(self, spent: float, distance: float, entries: int) -> bool:
        found = []
        if self.seconds is not None:
            found.append(spent >= self.seconds)
        if self.distance is not None:
            found.append(distance >= self.distance)
        if self.zone is not None and self.entries is not None:
            found.append(entries >= self.entries)
        return bool(found) and (all(found) if self.together else any(found))


class Sessions(StatefulProcessor):
    """One session's walk, the seconds and entries of its zones, and, for a while after its end, the rows that came too late."""

    def __init__(self, min_move: float, idle_s: float, rules: StopRules):
        self.min_move, self.idle_s, self.rules = min_move, idle_s, rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.walk = handle.getValueState("walk", WALK)
        self.zones = handle.getMapState("zones", "zone string", "seconds double, entries long")
        self.ended = handle.getValueState("ended", "late long")

    def wake(self, timers) -> None:
        """One timer a session, idle_s from now."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(timers.getCurrentProcessingTimeInMs() + 1000 * self.idle_s))

    def finish(self, late: int) -> None:
        """Only the count of late rows stays, until the timer."""
        self.walk.clear()
        self.zones.clear()
        self.ended.update((late,))

    def rows(self, key: tuple, state: tuple, spent: dict, phase: str) -> pd.DataFrame:
        *_, distance, frames, detected, late = state
        out = [(key[0], z, s, e, distance, frames, detected, late, phase) for z, (s, e) in spent.items()]
        out = out or [(key[0], None, 0.0, 0, distance, frames, detected, late, phase)]
        return pd.DataFrame(out, columns=["session", *COLUMNS])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fresh = (None, None, None, None, None, None, 0.0, 0, 0, 0)
        state = self.walk.get() if self.walk.exists() else fresh
        over = self.ended.exists()
        ended_late = self.ended.get()[0] if over else 0
        spent = {} if over else {k[0]: list(v) for k, v in self.zones.iterator()}
        frame, last, begin, x, y, current, distance, n, seen, late = state
        for r in pd.concat(list(rows)).sort_values("frame").itertuples():
            if r.command == "reset":
                over, ended_late, spent = False, 0, {}
                frame, last, begin, x, y, current, distance, n, seen, late = fresh
            elif over or (frame is not None and r.frame <= frame):
                if over:
                    ended_late += 1
                else:
                    late += 1
                continue
            stopping = r.command == "stop"
            if not stopping:
                frame = int(r.frame)
                known = not pd.isna(r.x)
                n, seen = n + 1, seen + int(known)
                begin = float(r.time_s) if begin is None else begin
                zone = (r.zone if isinstance(r.zone, str) else None) if known else current
                if zone is not None:
                    mine = spent.setdefault(zone, [0.0, 0])
                    mine[0] += float(r.time_s) - last if last is not None else 0.0
                    mine[1] += int(zone != current)
                current, last = zone, float(r.time_s)
                if known:
                    if x is None:
                        x, y = float(r.x), float(r.y)
                    moved = ((r.x - x) ** 2 + (r.y - y) ** 2) ** 0.5
                    if moved >= self.min_move:
                        distance, x, y = distance + float(moved), float(r.x), float(r.y)
                stopping = self.rules.met(last - begin, distance, spent.get(self.rules.zone, [0, 0])[1])
            if stopping:
                yield self.rows(key, (frame, last, begin, x, y, current, distance, n, seen, late), spent, "stopped")
                over = True
        self.wake(timerValues)
        if over:
            self.finish(ended_late)
            return
        self.ended.clear()
        state = (frame, last, begin, x, y, current, distance, n, seen, late)
        self.walk.update(state)
        self.zones.clear()
        for zone, (seconds, entries) in spent.items():
            self.zones.updateValue((zone,), (float(seconds), int(entries)))
        yield self.rows(key, state, spent, "running")

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """A session that fell silent ends; of one that had ended the late rows are told, and nothing stays."""
        if self.ended.exists():
            late = self.ended.get()[0]
            self.ended.clear()
            yield pd.DataFrame([(key[0], None, 0.0, 0, 0.0, 0, 0, late, "gone")], columns=["session", *COLUMNS])
        elif self.walk.exists():
            state, spent = self.walk.get(), {k[0]: list(v) for k, v in self.zones.iterator()}
            self.walk.clear()
            self.zones.clear()
            yield self.rows(key, state, spent, "expired")


def live_sessions(detections: DataFrame, min_move: float = 1.0, idle_s: float = 600.0, rules: StopRules | None = None) -> DataFrame:
    """Streaming (session, frame, time_s, x, y, zone, command) to the latest numbers of each session and zone, with a phase.

    A lost frame (null position) extends the zone before it; an entry is a change of zone; a step counts once the animal is
    min_move away from the last counted place. 'stop', or a rule, ends a session: its last numbers come with the phase
    stopped, and its state goes but for a count of rows that still come; 'reset' begins anew. idle_s seconds after a session's
    last row a timer ends it: with the phase expired if it ran, or gone, with the late rows, if it had ended. Frames
    that come after later ones of their session are late: counted and left out.
    """
    columns = detections.select("session", "frame", "time_s", "x", "y", "zone", "command")
    return columns.groupBy("session").transformWithStateInPandas(Sessions(min_move, idle_s, rules or StopRules()), OUTPUT, "update", "ProcessingTime")
