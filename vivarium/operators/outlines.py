"""Places against an arena's outlines: whole batches of frames against each polygon, in numpy.

Zones and objects are few and fixed by the arena, so they are listed once; a frame's results for all of them are one array,
made before frames become rows by zone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Measure = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def sides(polygon: np.ndarray) -> Iterator[tuple[float, float, float, float]]:
    """ax, ay, bx, by of each side, the last one back to the first corner."""
    for (ax, ay), (bx, by) in zip(polygon, np.roll(polygon, -1, axis=0)):
        yield ax, ay, bx, by


def inside(x: np.ndarray, y: np.ndarray, polygon: np.ndarray) -> np.ndarray:
    """By the even-odd rule, or on an edge; see zones.in_polygon."""
    odd, edge = np.zeros(len(x), bool), np.zeros(len(x), bool)
    for ax, ay, bx, by in sides(polygon):
        if ay != by:
            odd ^= ((ay > y) != (by > y)) & (x < ax + (y - ay) * (bx - ax) / (by - ay))
        line = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        edge |= (np.abs(line) < 1e-9) & (x >= min(ax, bx)) & (x <= max(ax, bx)) & (y >= min(ay, by)) & (y <= max(ay, by))
    return odd | edge


def distance(x: np.ndarray, y: np.ndarray, polygon: np.ndarray) -> np.ndarray:
    """Distance to the polygon: 0 inside."""
    least = np.full(len(x), np.inf)
    for ax, ay, bx, by in sides(polygon):
        dx, dy = bx - ax, by - ay
        long = dx * dx + dy * dy
        t = np.clip(((x - ax) * dx + (y - ay) * dy) / long, 0.0, 1.0) if long else 0.0
        least = np.minimum(least, np.hypot(x - (ax + t * dx), y - (ay + t * dy)))
    return np.where(inside(x, y, polygon), 0.0, least)


def disc_area(x: np.ndarray, y: np.ndarray, radius: float, polygon: np.ndarray) -> np.ndarray:
    """The area that a disc and a polygon share, exactly: each side adds the signed area, within the disc, of its triangle with the centre."""

    def sector(ux, uy, vx, vy):
        return radius * radius / 2 * np.arctan2(ux * vy - uy * vx, ux * vx + uy * vy)

    total = np.zeros(len(x))
    for p, q, u, v in sides(polygon):
        ax, ay, bx, by, dx, dy = p - x, q - y, u - x, v - y, u - p, v - q
        long, along = dx * dx + dy * dy, ax * dx + ay * dy
        if long == 0:
            continue
        root = along * along - long * (ax * ax + ay * ay - radius * radius)
        reach = np.sqrt(np.maximum(root, 0.0))
        first, last = np.clip((-along - reach) / long, 0.0, 1.0), np.clip((-along + reach) / long, 0.0, 1.0)
        px, py, qx, qy = ax + first * dx, ay + first * dy, ax + last * dx, ay + last * dy
        cut = sector(ax, ay, px, py) + (px * qy - py * qx) / 2 + sector(qx, qy, bx, by)
        total += np.where((root > 0) & (first < last), cut, sector(ax, ay, bx, by))
    return np.abs(total)


def by_outline(df: DataFrame, zones: DataFrame, measure: Measure, kind: str, x: Column, y: Column) -> DataFrame:
    """A row per row of df and zone (place, zone, polygon): df's columns, place, zone, and measure(x, y, corners) as __found.

    What it gives for unknown places counts for nothing: callers leave it out.
    """
    listed = sorted(zones.select("place", "zone", "polygon").collect(), key=lambda r: (r.place, r.zone))
    corners = [np.array([(p.x, p.y) for p in r.polygon], float).reshape(-1, 2) for r in listed]
    dtype = bool if kind == "boolean" else float

    @F.arrow_udf(f"array<{kind}>")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        a, b = (c.to_numpy(zero_copy_only=False).astype(float) for c in (x, y))
        with np.errstate(invalid="ignore", over="ignore"):
            found = np.stack([measure(a, b, c) for c in corners], axis=1) if corners else np.zeros((len(a), 0), dtype)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * len(corners), pa.int32()), pa.array(found.ravel()))

    types = dict(zones.dtypes)
    names = F.array(*(F.struct(F.lit(r.place).alias("place"), F.lit(r.zone).alias("zone")) for r in listed)).cast(f"array<struct<place:{types['place']},zone:{types['zone']}>>")
    rows = df.withColumn("__all", run(x.cast("double"), y.cast("double"))).select(*df.columns, F.posexplode("__all").alias("__i", "__found"))
    name = F.get(names, "__i")
    return rows.select(*df.columns, name["place"].alias("place"), name["zone"].alias("zone"), "__found")
