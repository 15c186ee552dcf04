"""Cleaning of positions along a session, and measures of the path."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vivarium.operators.runs import ordered, with_runs

KEY = ["session"]


def along():
    return ordered(KEY, "frame")


def before():
    return along().rowsBetween(Window.unboundedPreceding, 0)


def after():
    return along().rowsBetween(0, Window.unboundedFollowing)


def gap_fill(df: DataFrame, max_gap: int) -> DataFrame:
    """Straight lines over gaps of at most max_gap rows with known positions on both sides; adds `interpolated`."""
    known = F.col("x").isNotNull()
    place = F.row_number().over(along())
    rows = df.withColumn("__i", place)
    for side, window, pick in (("a", before(), F.last), ("b", after(), F.first)):
        for c in ("__i", "x", "y"):
            rows = rows.withColumn(f"__{side}{c}", pick(F.when(known, F.col(c)), ignorenulls=True).over(window))
    share = (F.col("__i") - F.col("__a__i")) / (F.col("__b__i") - F.col("__a__i"))
    fits = ~known & F.col("__a__i").isNotNull() & F.col("__b__i").isNotNull() & (F.col("__b__i") - F.col("__a__i") - 1 <= max_gap)
    at = lambda c: F.when(fits, F.col(f"__a{c}") + (F.col(f"__b{c}") - F.col(f"__a{c}")) * share).otherwise(F.col(c))
    filled = rows.withColumns({"__x": at("x"), "__y": at("y"), "interpolated": fits})
    return filled.select(*(c for c in df.columns if c not in ("x", "y")), F.col("__x").alias("x"), F.col("__y").alias("y"), "interpolated")


def hold_last(df: DataFrame) -> DataFrame:
    """Unknown positions take the last known one, those at the start the first; adds `held`."""
    held = {c: F.coalesce(F.last(c, ignorenulls=True).over(before()), F.first(c, ignorenulls=True).over(after())) for c in ("x", "y")}
    return df.withColumn("held", F.col("x").isNull()).withColumns({f"__{c}": v for c, v in held.items()}).drop("x", "y").withColumnsRenamed({"__x": "x", "__y": "y"})


def smooth(df: DataFrame, window: int, factor: float = 3.5, floor: float = 0.5) -> DataFrame:
    """Known positions: outliers from the rolling median by over factor x MAD become the median, then a rolling mean."""
    if window < 2:
        return df
    known = df.filter("x IS NOT NULL")
    frame = along().rowsBetween(-(window // 2), window - 1 - window // 2)
    out = known
    for c in ("x", "y"):
        out = out.withColumn("__m", F.percentile(c, F.lit(0.5)).over(frame)).withColumn("__d", F.abs(F.col(c) - F.col("__m")))
        out = out.withColumn("__mad", F.greatest(F.percentile("__d", F.lit(0.5)).over(frame), F.lit(floor)))
        out = out.withColumn(f"__{c}", F.when(F.col("__d") > factor * F.col("__mad"), F.col("__m")).otherwise(F.col(c)))
    smoothed = out.select("session", "frame", *(F.avg(f"__{c}").over(frame).alias(f"{c}_smooth") for c in ("x", "y")))
    return df.join(smoothed, ["session", "frame"], "left")


def path_distance(df: DataFrame, min_move: float) -> DataFrame:
    """(session, distance, steps): a step counts once the animal is min_move away from the last counted place.

    The anchor makes this sequential: sorted rows pass through a task batch by batch, of which it keeps only the anchor and
    the sums, however long a session is.
    """
    kind = df.schema["session"].dataType
    out = f"session {kind.simpleString()}, distance double, steps long"
    types = [f.type for f in to_arrow_schema(StructType.fromDDL(out))]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, anchor, total, steps = None, None, 0.0, 0
        for batch in batches:
            done = []
            for s, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                if anchor is None or s != session:
                    if anchor is not None:
                        done.append((session, total, steps))
                    session, anchor, total, steps = s, (x, y), 0.0, 0
                    continue
                d = ((x - anchor[0]) ** 2 + (y - anchor[1]) ** 2) ** 0.5
                if d >= min_move:
                    total, steps, anchor = total + d, steps + 1, (x, y)
            yield rows(done)
        yield rows([] if anchor is None else [(session, total, steps)])

    def rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names=["session", "distance", "steps"])

    known = df.filter("x IS NOT NULL").select("session", "frame", "x", "y")
    return known.repartition("session").sortWithinPartitions("session", "frame").select("session", "x", "y").mapInArrow(walk, out)


def step_length() -> Column:
    """Distance to the row before; null at the start and next to unknown positions."""
    return F.hypot(F.col("x") - F.lag("x").over(along()), F.col("y") - F.lag("y").over(along()))


def time_course(df: DataFrame) -> DataFrame:
    """Cumulative distance and speed; a step over no time has no speed."""
    rows = df.withColumn("step", step_length()).withColumn("dt", F.col("time_s") - F.lag("time_s").over(along()))
    speed = F.when(F.col("dt") > 0, F.col("step") / F.col("dt"))
    return rows.select("session", "frame", F.sum(F.coalesce("step", F.lit(0.0))).over(before()).alias("cumulative"), speed.alias("speed"))


def border_band(width: float, height: float, across: float, along: float) -> Column:
    """Within `across` of the left or right wall or within `along` of the others."""
    return (F.col("x") < across) | (F.col("x") > width - across) | (F.col("y") < along) | (F.col("y") > height - along)


def thigmotaxis(df: DataFrame, inside: Column, fps: float) -> DataFrame:
    """Time, share, distance and entries in the band along the walls, of Tracked rows; a step needs both ends there."""
    rows = df.filter("status = 'Tracked'")
    rows = rows.withColumn("near", inside).withColumn("was", F.lag("near").over(along())).withColumn("step", step_length())
    return rows.groupBy("session").agg(
        (F.sum(F.col("near").cast("int")) / fps).alias("border_s"),
        (F.avg(F.col("near").cast("double")) * 100).alias("border_percent"),
        F.coalesce(F.sum(F.when(F.col("near") & F.col("was"), F.col("step"))), F.lit(0.0)).alias("border_distance"),
        F.sum(F.when(F.col("near") & ~F.coalesce("was", F.lit(True)), 1).otherwise(0)).alias("border_entries"),
    )


def heat_map(df: DataFrame, width: float, height: float, bins: int = 50) -> DataFrame:
    """Frames by bin of a bins x bins grid."""
    cell = lambda c, size: F.least(F.floor(F.col(c) / size * bins), F.lit(bins - 1)).cast("long")
    return df.filter("x IS NOT NULL").groupBy(cell("x", width).alias("bin_x"), cell("y", height).alias("bin_y")).agg(F.count("*").alias("frames"))


def problems(df: DataFrame, radius: float) -> DataFrame:
    """Lost runs, and jumps: steps between known positions over max(4 radii, 8 x the session's median step)."""
    lost = with_runs(df, KEY, "frame", F.col("status") == "Lost").filter("status = 'Lost'")
    lost = lost.groupBy("session", "run").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    known = df.filter("x IS NOT NULL").withColumn("step", step_length())
    typical = known.groupBy("session").agg(F.percentile("step", F.lit(0.5)).alias("median"))
    jumps = known.join(typical, "session").filter(F.col("step") > F.greatest(F.lit(4 * radius), 8 * F.col("median")))
    kind = lambda d, name, a, b: d.select("session", F.lit(name).alias("problem"), F.col(a).alias("first"), F.col(b).alias("last"))
    return kind(lost, "lost", "first", "last").unionByName(kind(jumps, "jump", "frame", "frame"))
