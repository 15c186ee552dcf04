"""Stop rules of a session: the first frame at which the animal has rested, entered a zone or walked enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pixels a frame below which an animal rests (fixed value).
REST_PX = 2.0


def _along():
    return Window.partitionBy("session").orderBy("frame")


def _up_to():
    return _along().rowsBetween(Window.unboundedPreceding, 0)


def tracked() -> Column:
    return F.coalesce(F.col("status") == "Tracked", F.lit(False))


def _moved(df: DataFrame) -> DataFrame:
    """Adds `moved`: the distance of a tracked frame to the tracked frame before it, 0 for all others."""
    seen = F.last(F.when(tracked(), F.struct("x", "y")), ignorenulls=True).over(_along().rowsBetween(Window.unboundedPreceding, -1))
    far = F.hypot(F.col("x") - F.col("seen.x"), F.col("y") - F.col("seen.y"))
    return df.withColumn("seen", seen).withColumn("moved", F.when(tracked(), F.coalesce(far, F.lit(0.0))).otherwise(0.0)).drop("seen")


def _first(df: DataFrame, met: Column) -> DataFrame:
    return df.filter(met).groupBy("session").agg(F.min("frame").alias("frame"))


def rested(df: DataFrame, seconds: float, fps: float, rest_px: float = REST_PX) -> DataFrame:
    """(session, frame): tracked frames in a row that each moved less than `rest_px` last `seconds`; sessions without are left out."""
    place = F.row_number().over(_along())
    rows = _moved(df).withColumn("place", place).withColumn("rests", tracked() & (F.col("moved") < rest_px))
    broken = F.coalesce(F.max(F.when(~F.col("rests"), F.col("place"))).over(_up_to()), F.lit(0))
    return _first(rows.withColumn("n", F.col("place") - broken), F.col("rests") & (F.col("n") / fps >= seconds - 1e-9))


def walked(df: DataFrame, pixels: float) -> DataFrame:
    """(session, frame): the path reaches `pixels`."""
    rows = _moved(df).withColumn("far", F.sum("moved").over(_up_to()))
    return _first(rows, F.col("far") >= pixels)


def entered(flags: DataFrame, times: int) -> DataFrame:
    """(session, frame): the entry number `times` into the zone that `flags` (one zone) tells; not debounced, lost frames are outside."""
    rows = flags.withColumn("here", tracked() & F.coalesce("inside", F.lit(False)))
    new = F.col("here") & ~F.coalesce(F.lag("here").over(_along()), F.lit(False))
    rows = rows.withColumn("new", new.cast("int")).withColumn("entries", F.sum("new").over(_up_to()))
    return _first(rows, F.col("entries") >= times)
