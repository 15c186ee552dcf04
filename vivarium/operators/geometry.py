"""Discs and polygons, and maps smoothed on a grid."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vivarium.operators.outlines import by_outline, disc_area

#: Least radius of a body in pixels, how many bodies a zone must hold for the body rule, and where a smoothing kernel ends, in sigmas (fixed values).
LEAST_RADIUS, BODIES, TRUNCATE = 2, 1.25, 4.0


def edges(polygon: Column) -> Column:
    """An array of (a, b) for each side of a polygon, the last one back to its first corner."""
    after = F.concat(F.slice(polygon, 2, F.size(polygon)), F.slice(polygon, 1, 1))
    return F.arrays_zip(polygon.alias("a"), after.alias("b"))


def added(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def polygon_area(polygon: Column) -> Column:
    cross = F.transform(edges(polygon), lambda e: e["a"]["x"] * e["b"]["y"] - e["a"]["y"] * e["b"]["x"])
    return F.abs(added(cross)) / 2


def disc_fractions(df: DataFrame, zones: DataFrame, radius: float) -> DataFrame:
    """A row per frame and zone with `fraction`, the share of a disc around (x, y) that lies in the zone; null without a place.

    The disc stands for a body set by hand: its radius is rounded to whole pixels, LEAST_RADIUS at least.
    """
    r = max(LEAST_RADIUS, round(radius))
    rows = by_outline(df, zones, lambda x, y, polygon: np.minimum(disc_area(x, y, float(r), polygon) / (math.pi * r * r), 1.0), "double", F.col("x"), F.col("y"))
    known = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    return rows.withColumn("fraction", F.when(known, F.col("__found"))).drop("__found")


def body_zones(zones: DataFrame, radius: float) -> DataFrame:
    """The zones that hold the whole animal: those of at least BODIES times its area. In others its centre counts."""
    r = max(LEAST_RADIUS, round(radius))
    return zones.filter(polygon_area(F.col("polygon")) >= BODIES * math.pi * r * r)


def body_shares(df: DataFrame, zones: DataFrame, radius: float) -> DataFrame:
    """(session, frame, time_s, status, place, zone, share) for `mazes.paw_states`, of the zones that hold the whole animal.

    Tracked: the disc's share. Hidden in a covered zone (hidden_zone, if df has it): all of that zone and nothing of others. Other
    frames have no body, so no share.
    """
    hidden = F.col("hidden_zone") if "hidden_zone" in df.columns else F.lit(None).cast("string")
    rows = disc_fractions(df, body_zones(zones, radius), radius)
    covered = F.when(hidden.isNotNull(), (hidden == F.col("zone")).cast("double"))
    share = F.when(F.col("status") == "Tracked", F.col("fraction")).when(F.col("status") == "Hidden", covered)
    return rows.select("session", "frame", "time_s", "status", "place", "zone", share.alias("share"))


def covered_zones(shares: DataFrame) -> DataFrame:
    """(session, zone) of zones in which the animal was hidden at some time."""
    return shares.filter("status = 'Hidden' AND share = 1").select("session", "zone").distinct()


def smoothed_counts(cells: DataFrame, bins: int, sigma: float = 1.2) -> DataFrame:
    """(bin_x, bin_y, heat, share): counts of grid cells (bin_x, bin_y, frames) under a Gaussian, and heat by the greatest.

    The grid is mirrored at its walls, cell by cell, and the kernel ends at TRUNCATE sigmas. Both axes are smoothed one after
    the other by the cells that have counts, so empty parts of the grid cost nothing; cells that nothing reaches have no row.
    """
    reach = int(TRUNCATE * sigma + 0.5)
    weights = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    kernel = F.array(*(F.struct(F.lit(k).cast("long").alias("off"), F.lit(w / sum(weights)).alias("weight")) for k, w in zip(range(-reach, reach + 1), weights)))
    turns = reach // (2 * bins) + 1

    def spread(df: DataFrame, axis: str, other: str) -> DataFrame:
        images = [F.col(axis) + 2 * bins * t for t in range(-turns, turns + 1)] + [2 * bins * t - 1 - F.col(axis) for t in range(-turns, turns + 1)]
        rows = df.withColumn("at", F.explode(F.array(*(i.cast("long") for i in images)))).filter(F.col("at").between(-reach, bins - 1 + reach))
        rows = rows.withColumn("k", F.explode(kernel)).withColumn("to", F.col("at") - F.col("k.off")).filter(F.col("to").between(0, bins - 1))
        return rows.groupBy(F.col("to").alias(axis), other).agg(F.sum(F.col("heat") * F.col("k.weight")).alias("heat"))

    heat = spread(spread(cells.withColumn("heat", F.col("frames").cast("double")), "bin_x", "bin_y"), "bin_y", "bin_x")
    top = heat.agg(F.max("heat").alias("top"))
    return heat.join(F.broadcast(top)).select("bin_x", "bin_y", "heat", F.try_divide("heat", "top").alias("share"))  # one row
