"""One subject among zones and objects: seconds, shares, bouts near objects and way, in pixels and in a scale's unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vivarium.functions.text import safe_name
from vivarium.operators.animals import object_bouts
from vivarium.operators.outlines import by_outline, distance
from vivarium.operators.trajectory import step_length
from vivarium.operators.zones import zone_flags


def known_place() -> Column:
    return F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")


def near_objects(df: DataFrame, objects: DataFrame, margin: float = 0.0) -> DataFrame:
    """(session, frame, object, near): within an object's outline, or `margin` pixels from it at most."""
    if margin <= 0:
        return zone_flags(df, objects).select("session", "frame", F.col("zone").alias("object"), F.coalesce("inside", F.lit(False)).alias("near"))
    rows = by_outline(df.select("session", "frame", "x", "y"), objects, distance, "double", F.bround("x"), F.bround("y"))
    return rows.select("session", "frame", F.col("zone").alias("object"), F.coalesce(F.when(known_place(), F.col("__found") <= margin), F.lit(False)).alias("near"))


def joined_labels(flags: DataFrame) -> DataFrame:
    """(session, frame, roi): the names of all zones that a frame is in, in their order, joined by '_'; 'None' for none."""
    here = F.array_sort(F.collect_list(F.when(F.col("inside"), F.struct("place", "zone"))))
    names = F.array_join(F.transform("here", lambda z: z["zone"]), "_")
    rows = flags.groupBy("session", "frame").agg(here.alias("here"))
    return rows.select("session", "frame", F.when(F.size("here") > 0, names).otherwise("None").alias("roi"))


def scaled(df: DataFrame, measure: str, factor: float | None, unit: str = "cm") -> DataFrame:
    """(session, measure, value) rows with, for each named ..._pixels, a row in the scale's unit; none without a scale."""
    if not factor:
        return df
    own = df.filter(F.col(measure).endswith("_pixels"))
    name = F.concat(F.expr(f"left({measure}, length({measure}) - 6)"), F.lit(unit))
    return df.unionByName(own.withColumns({measure: name, "value": F.col("value") * factor}))


def interaction_stats(df: DataFrame, zones: DataFrame, objects: DataFrame, fps: float, least_s: float = 0.3, margin: float = 0.0, factor: float | None = None, unit: str = "cm") -> tuple[DataFrame, DataFrame]:
    """(session, measure, value) and the bouts near objects (session, object, first, last, start, end, duration).

    Measures: Total_distance_pixels over frames in a row with known places; <zone>_time_s and <zone>_percent of all frames;
    <object>_near_time_s and <object>_bout_count; with a factor, distances in `unit` too. A zone's or an object's name is written
    as letters and digits.
    """

    def listed(rows: DataFrame, *named: tuple[Column, Column]) -> DataFrame:
        """One row for each named value, all from one pass over rows."""
        each = F.array(*(F.struct(name.alias("measure"), value.cast("double").alias("value")) for name, value in named))
        return rows.select("session", F.inline(each))

    way = df.withColumn("step", F.when(known_place(), step_length())).groupBy("session").agg(F.coalesce(F.sum(F.nanvl("step", F.lit(None))), F.lit(0.0)).alias("v"))
    inside = F.count(F.when(F.col("inside") & known_place(), 1))
    zoned = zone_flags(df, zones).groupBy("session", "zone").agg((inside / fps).alias("s"), (100 * inside / F.count("*")).alias("p"))
    near = near_objects(df, objects, margin)
    bouts = object_bouts(near, fps, least_s)
    close = near.groupBy("session", "object").agg((F.count(F.when(F.col("near"), 1)) / fps).alias("s"))
    counted = close.join(bouts.groupBy("session", "object").agg(F.count("*").alias("n")), ["session", "object"], "left")
    zone, thing = safe_name(F.col("zone")), safe_name(F.col("object"))
    rows = scaled(listed(way, (F.lit("Total_distance_pixels"), F.col("v"))), "measure", factor, unit)
    rows = rows.unionByName(listed(zoned, (F.concat(zone, F.lit("_time_s")), F.col("s")), (F.concat(zone, F.lit("_percent")), F.col("p"))))
    rows = rows.unionByName(listed(counted, (F.concat(thing, F.lit("_near_time_s")), F.col("s")), (F.concat(thing, F.lit("_bout_count")), F.coalesce("n", F.lit(0)))))
    return rows, bouts
