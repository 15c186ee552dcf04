"""Time bins: edges, labels, and all measures by bin or up to its end."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vivarium.operators.zones import present


def bin_edges(t0: float, t1: float, width: float) -> list[float]:
    """t0, t0 + width, ..., t1; a last piece shorter than 0.5 s or 2 % of the width joins the one before."""
    if width <= 0 or t1 <= t0:
        return []
    edges = [t0 + i * width for i in range(math.ceil((t1 - t0) / width))] + [t1]
    if len(edges) > 2 and edges[-1] - edges[-2] < max(0.5, 0.02 * width):
        del edges[-2]
    return edges


def size_label(width: float) -> str:
    """1min for whole minutes, else 30s or 2.5s."""
    if width > 0 and width % 60 == 0:
        return f"{width / 60:.0f}min"
    return f"{width:g}s"


def row_label(a: float, b: float, t0: float, width: float, cumulative: bool = False) -> str:
    unit, name = (60.0, "min") if width > 0 and width % 60 == 0 else (1.0, "s")
    return f"{0 if cumulative else (a - t0) / unit:.0f}-{(b - t0) / unit:.0f} {name}"


def bin_of(t: Column, edges: list[float], width: float) -> Column:
    """The bin (from 0) that t is in, [a, b); null outside. All bins but the last are equally wide."""
    place = F.least(F.floor((t - edges[0]) / width), F.lit(len(edges) - 2)).cast("int")
    return F.when((t >= edges[0]) & (t < edges[-1]), place)


def bin_table(df: DataFrame, edges: list[float], keys: list[str], width: float) -> DataFrame:
    """(*keys, bin, start_s, end_s, label) for every key of df and every bin."""
    rows = [F.struct(F.lit(i).alias("bin"), F.lit(a).alias("start_s"), F.lit(b).alias("end_s"), F.lit(row_label(a, b, edges[0], width)).alias("label")) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    return df.select(*keys).distinct().withColumn("b", F.explode(F.array(*rows))).select(*keys, "b.*")


def _running(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.sum(c).over(w) for c in columns})


def session_bins(frames: DataFrame, moved: DataFrame, edges: list[float], width: float, fps: float, cumulative: bool = False) -> DataFrame:
    """By session and bin: frames with the animal, moves between zones, distance, and mean speed of Tracked frames.

    frames: session, frame, time_s, x, y, status; a frame's distance is that from the frame before. Bins without any
    frame have zeros. cumulative: from the start to each bin's end, without speed.
    """
    w = Window.partitionBy("session").orderBy("frame")
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    rows = frames.withColumn("step", step).withColumn("bin", bin_of(F.col("time_s"), edges, width)).filter("bin IS NOT NULL")
    sums = rows.filter(present()).groupBy("session", "bin").agg(F.count("*").alias("frames"), F.sum("step").alias("distance"), (F.avg(F.when(F.col("status") == "Tracked", F.col("step"))) * fps).alias("speed"))
    counts = moved.groupBy("session", bin_of(F.col("time_s"), edges, width).alias("bin")).agg(F.count("*").alias("moves"))
    out = bin_table(frames, edges, ["session"], width).join(sums, ["session", "bin"], "left").join(counts, ["session", "bin"], "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("frames", "distance", "speed", "moves")})
    return _running(out, ["session"], ["frames", "distance", "moves"]).drop("speed", "start_s", "label") if cumulative else out


def zone_bins(flags: DataFrame, edges: list[float], width: float, fps: float, cumulative: bool = False) -> DataFrame:
    """By session, zone and bin: seconds inside and their share of the bin's (or, cumulative, of the time so far)."""
    rows = flags.filter(present() & F.col("inside")).withColumn("bin", bin_of(F.col("time_s"), edges, width)).filter("bin IS NOT NULL")
    sums = rows.groupBy("session", "zone", "bin").agg((F.count("*") / fps).alias("time_s"))
    out = bin_table(flags, edges, ["session", "zone"], width).join(sums, ["session", "zone", "bin"], "left").withColumn("time_s", F.coalesce("time_s", F.lit(0.0)))
    if cumulative:
        out = _running(out, ["session", "zone"], ["time_s"]).withColumn("start_s", F.lit(edges[0]))
    return out.select("session", "zone", "bin", "time_s", (F.col("time_s") / (F.col("end_s") - F.col("start_s")) * 100).alias("percent"))
