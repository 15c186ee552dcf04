"""Several chambers in one view: zones and positions are dealt to chambers, and each chamber is a session of its own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vivarium.operators.trajectory import step_length

#: A zone's name may begin with its chamber, as in "C2 · Centre" (fixed format).
PREFIX = r"^\s*C(\d+)\s*·\s*"


@dataclass(frozen=True)
class Chamber:
    """A rectangle of the view, numbered from 1, with the name of its animal if it has one."""

    number: int
    x0: float
    y0: float
    x1: float
    y1: float
    animal: str = ""


def zone_chamber(name: Column) -> Column:
    """The chamber that a zone's name tells, or null."""
    return F.regexp_extract(name, PREFIX, 1).try_cast("int")


def bare_name(name: Column) -> Column:
    """A zone's name without its chamber; a name that is nothing else stays."""
    bare = F.trim(F.regexp_replace(name, PREFIX, ""))
    return F.when(bare == "", name).otherwise(bare)


def boxes(layout: list[Chamber]) -> Column:
    each = [F.struct(F.lit(c.number).alias("number"), *(F.lit(float(v)).alias(k) for k, v in (("x0", c.x0), ("y0", c.y0), ("x1", c.x1), ("y1", c.y1))), F.lit(c.animal).alias("animal")) for c in layout]
    return F.array(*each)


def chamber_at(layout: list[Chamber], x: Column, y: Column) -> Column:
    """The number of the chamber that holds a place; of several the one whose walls are farthest, then the least number. Null outside all."""
    depth = lambda c: F.least(x - c["x0"], c["x1"] - x, y - c["y0"], c["y1"] - y)
    held = F.filter(boxes(layout), lambda c: x.between(c["x0"], c["x1"]) & y.between(c["y0"], c["y1"]))
    return -F.array_max(F.transform(held, lambda c: F.struct(depth(c).alias("depth"), (-c["number"]).alias("number"))))["number"]


def chamber_zones(zones: DataFrame, layout: list[Chamber]) -> DataFrame:
    """(place, zone, polygon) to (chamber, place, zone, polygon): the chamber of the name, or else of the mean of the corners.

    Zones of no chamber are left out, as are those without a named chamber and with fewer than three corners. A bare name
    that a chamber has already gets a mark (') for each zone of that name before it.
    """
    mean = lambda k: F.aggregate("polygon", F.lit(0.0), lambda a, p: a + p[k]) / F.size("polygon")
    told = zone_chamber(F.col("zone"))
    found = F.when(told.isNotNull(), F.when(told.between(1, len(layout)), told)).when(F.size("polygon") >= 3, chamber_at(layout, mean("x"), mean("y")))
    rows = zones.withColumn("chamber", found).filter("chamber IS NOT NULL").withColumn("zone", bare_name(F.col("zone")))
    again = F.row_number().over(Window.partitionBy("chamber", "zone").orderBy("place")) - 1
    return rows.withColumn("again", again).select("chamber", "place", F.concat("zone", F.repeat(F.lit("'"), F.col("again"))).alias("zone"), "polygon")


def chamber_tracks(detections: DataFrame, layout: list[Chamber]) -> DataFrame:
    """(session, frame, time_s, x, y, status, area) to a row for each frame and chamber: session, chamber, subject, frame, time_s, x, y, status.

    session is "<session> C<number>", so that all operators by session work by chamber; subject is the chamber's animal, or
    that name. A chamber takes the detection of the largest area in it (ties: the least x, then y); without one it is Lost.
    """
    key = F.concat(F.col("session").cast("string"), F.lit(" C"), F.col("c.number").cast("string"))
    own = F.col("c.number") == F.col("at")
    seen = F.max(F.when(own, F.struct("area", (-F.col("x")).alias("x"), (-F.col("y")).alias("y"), "status")))
    rows = detections.withColumn("at", chamber_at(layout, F.col("x"), F.col("y"))).withColumn("c", F.explode(boxes(layout)))
    named = F.when(F.col("c.animal") == "", key).otherwise(F.col("c.animal"))
    each = rows.groupBy(key.alias("session"), F.col("c.number").alias("chamber"), named.alias("subject"), "frame").agg(F.min("time_s").alias("time_s"), seen.alias("seen"))
    return each.select("session", "chamber", "subject", "frame", "time_s", (-F.col("seen.x")).alias("x"), (-F.col("seen.y")).alias("y"), F.coalesce("seen.status", F.lit("Lost")).alias("status"))


def chamber_summary(tracks: DataFrame) -> DataFrame:
    """A row for each chamber: its frames, the share of lost ones and the distance between frames next to each other."""
    lost = F.col("status") == "Lost"
    rows = tracks.withColumn("step", step_length())
    return rows.groupBy("session", "chamber", "subject").agg(
        F.count("*").alias("frames"),
        (F.avg(lost.cast("double")) * 100).alias("lost_percent"),
        F.coalesce(F.sum("step"), F.lit(0.0)).alias("distance"),
    )
