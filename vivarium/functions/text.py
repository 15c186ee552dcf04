"""Names and words: labels of measures, chamber zones, strengths of agreement; and the view from above by four points."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units that end the name of a measure.
UNITS = (("_percent", " (%)"), ("_pct", " (%)"), ("_px", " (px)"), ("_s", " (s)"))
#: Upper ends of kappa by word.
AGREEMENT = ((0.0, "poor"), (0.2, "slight"), (0.4, "fair"), (0.6, "moderate"), (0.8, "substantial"))


def pretty(name: str) -> str:
    """A measure's name for people: its unit in brackets, blanks for underscores."""
    for end, unit in UNITS:
        if name.endswith(end):
            name = name[: -len(end)] + unit
            break
    return " ".join(re.split("_+", name)).strip()


def safe_name(c: Column) -> Column:
    """Letters and digits, single underscores for all between them; X for nothing."""
    kept = F.regexp_replace(c, r"[^\p{L}\p{N}]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(kept, "^_|_$", ""), F.lit("")), F.lit("X"))


def chamber_of(zone: Column) -> tuple[Column, Column]:
    """The number and the zone's own name in 'C2 · Centre'; null and the name itself without a chamber."""
    pattern = r"^C(\d+)\s*·\s*(.+)$"
    number = F.regexp_extract(zone, pattern, 1)
    return F.nullif(number, F.lit("")).cast("int"), F.when(number != "", F.regexp_extract(zone, pattern, 2)).otherwise(zone)


def agreement_word(kappa: Column) -> Column:
    out = F.when(kappa <= AGREEMENT[0][0], AGREEMENT[0][1])
    for top, word in AGREEMENT[1:]:
        out = out.when(kappa <= top, word)
    return out.when(kappa.isNotNull(), "almost perfect")


def frame_lag(fps: float) -> int:
    return max(1, round(fps / 30))


def time_window(start: float, end: float | None, fps: float, frames: int) -> tuple[int, int]:
    """First and last frame of a window in seconds, both within it, clamped to the video."""
    first = min(max(round(start * fps), 0), frames - 1)
    last = frames - 1 if end is None else min(max(round(end * fps), first), frames - 1)
    return first, last


def merged(defaults: dict, given: dict) -> dict:
    """Defaults, with what is given and not None in their place."""
    return {**defaults, **{k: v for k, v in given.items() if v is not None}}


def corners(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Four points clockwise from the top left: by their angle around the middle, begun at the least x + y."""
    mx, my = (sum(p[i] for p in points) / 4 for i in (0, 1))
    turn = sorted(points, key=lambda p: math.atan2(p[1] - my, p[0] - mx))
    at = min(range(4), key=lambda i: sum(turn[i]))
    return turn[at:] + turn[:at]


def homography(source: list[tuple[float, float]], target: list[tuple[float, float]]) -> list[float]:
    """The nine numbers (the last is 1) that take four points to four others."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return [*np.linalg.solve(np.array(rows, float), np.array(right, float)).tolist(), 1.0]


def warped(x: Column, y: Column, h: list[float]) -> tuple[Column, Column]:
    """Where a point lies in the view from above; null on the horizon."""
    w = h[6] * x + h[7] * y + h[8]
    return F.try_divide(h[0] * x + h[1] * y + h[2], w), F.try_divide(h[3] * x + h[4] * y + h[5], w)
