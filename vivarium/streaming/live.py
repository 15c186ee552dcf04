"""Live sessions as Structured Streaming: zone seconds, entries and distance per session, kept in state.

The reference point is the batch result on the same rows; watermarks and windows here are additions for streams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vivarium.operators.body import LINK, SHAPE, TAIL, WALK

OUTPUT = "session long, zone string, seconds double, entries long, distance double, frames long, detected long"
HEADS = "session long, frame long, head_x double, head_y double, tail_x double, tail_y double"
#: Pixels a frame from which on a walk counts in full (fixed value).
LIVE_SPEED = 2.0
STATE = "zones string, last_time double, x double, y double, current string, distance double, frames long, detected long"


def live_statistics(detections: DataFrame, min_move: float = 1.0) -> DataFrame:
    """Streaming (session, frame, time_s, x, y, zone, command) to the latest numbers of each session and zone.

    A lost frame (null position) extends the zone before it; an entry is a change of zone; a step counts once the animal
    is min_move away from the last counted place. The command 'reset' starts a session again, 'stop' freezes it.
    """
    import json

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        zones, last, x, y, current, distance, n, seen = ("{}", None, None, None, None, 0.0, 0, 0) if not state.exists else state.get
        held = json.loads(zones)
        rows = pd.concat(list(frames)).sort_values("frame")
        stopped = held.get("!stopped", [0, 0])[0]
        for r in rows.itertuples():
            if r.command == "reset":
                held, last, x, y, current, distance, n, seen, stopped = {}, None, None, None, None, 0.0, 0, 0, 0
            if r.command == "stop":
                stopped = 1
            if stopped:
                continue
            known = not pd.isna(r.x)
            n, seen = n + 1, seen + known
            zone = (r.zone if isinstance(r.zone, str) else None) if known else current
            if zone is not None:
                spent = held.setdefault(zone, [0.0, 0])
                spent[0] += r.time_s - last if last is not None else 0.0
                spent[1] += zone != current
            current, last = zone, r.time_s
            if known:
                if x is None:
                    x, y = r.x, r.y
                moved = ((r.x - x) ** 2 + (r.y - y) ** 2) ** 0.5
                if moved >= min_move:
                    distance, x, y = distance + moved, r.x, r.y
        held["!stopped"] = [stopped, 0]
        state.update((json.dumps(held), last, x, y, current, distance, n, seen))
        out = [(key[0], z, s, e, distance, n, seen) for z, (s, e) in held.items() if z != "!stopped"]
        yield pd.DataFrame(out, columns=["session", "zone", "seconds", "entries", "distance", "frames", "detected"])

    return detections.groupBy("session").applyInPandasWithState(update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def live_heads(ends: DataFrame) -> DataFrame:
    """Streaming (session, frame, x, y, ax, ay, bx, by, tail_ev, shape_ev) to (session, frame, head_x, head_y, tail_x, tail_y).

    Of the two ends a and b the head is the one for which the frame's evidence (`body.head_and_tail`, with the walk since the
    frame before) and its nearness to the head before speak; a tie goes to a. Frames without ends give nulls and keep the
    head. Frames are taken in order within a micro-batch; sessions, and the head of each, stay in state.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hx, hy, px, py = state.get if state.exists else (None, None, None, None)
        rows = pd.concat(list(frames)).sort_values("frame")
        out = []
        for r in rows.itertuples():
            seen = not (pd.isna(r.x) or pd.isna(r.y))
            place = (float(r.x), float(r.y)) if seen else (None, None)
            if any(pd.isna(v) for v in (r.ax, r.ay, r.bx, r.by)):
                px, py = place
                out.append((key[0], r.frame, None, None, None, None))
                continue
            ux, uy = r.ax - r.bx, r.ay - r.by
            size = math.hypot(ux, uy)
            evidence = TAIL * r.tail_ev + SHAPE * r.shape_ev
            if seen and px is not None:
                vx, vy = place[0] - px, place[1] - py
                speed = math.hypot(vx, vy)
                if size > 0 and speed > 0:
                    evidence += WALK * (ux * vx + uy * vy) / (size * speed) * min(1.0, speed / LIVE_SPEED)
            px, py = place
            if hx is not None:
                evidence += LINK * (math.hypot(r.bx - hx, r.by - hy) - math.hypot(r.ax - hx, r.ay - hy)) / max(1.0, size)
            a, b = (float(r.ax), float(r.ay)), (float(r.bx), float(r.by))
            head, tail = (a, b) if evidence >= 0 else (b, a)
            hx, hy = head
            out.append((key[0], r.frame, *head, *tail))
        state.update((hx, hy, px, py))
        yield pd.DataFrame(out, columns=["session", "frame", "head_x", "head_y", "tail_x", "tail_y"])

    columns = ends.select("session", "frame", "x", "y", "ax", "ay", "bx", "by", "tail_ev", "shape_ev")
    kept = "head_x double, head_y double, x double, y double"
    return columns.groupBy("session").applyInPandasWithState(update, HEADS, kept, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str, by: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Tumbling windows over a watermarked time column; later rows are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def bouts_by_gap(events: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of point events: a gap longer than `gap` ends a bout."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")
