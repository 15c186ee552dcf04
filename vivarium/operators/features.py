"""Features of a frame for behaviour classifiers: how body and parts move, and what they did around that time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The base features and the widths, in seconds, of the windows around a frame.
BASE = ("speed", "body_motion", "head_motion", "leg_motion", "tail_motion", "animal_motion", "region_motion", "spread", "length", "nose_distance", "turning")
WINDOWS_S = (0.33, 1.0, 3.0)
POINTS = ("nose", "centre", "tail_base")


def _along():
    return Window.partitionBy("session").orderBy("frame")


def _gradient(c: str) -> Column:
    """Half the difference of the neighbours; at the ends the difference to the one neighbour."""
    before, after = F.lag(c).over(_along()), F.lead(c).over(_along())
    first, last = F.lag("frame").over(_along()).isNull(), F.lead("frame").over(_along()).isNull()
    return F.when(first, after - F.col(c)).when(last, F.col(c) - before).otherwise((after - before) / 2)


def base_features(df: DataFrame, fps: float, body_length: float) -> DataFrame:
    """(session, frame, *BASE, seen) from (session, frame, x, y), the points <part>_x and <part>_y of POINTS and any
    *_motion columns; what isn't there is null.

    Speed is of the centre, smoothed over three frames, in body lengths a second; turning is the change of the heading
    from centre to nose, at most half a turn, in radians a second; spread, length and nose_distance are in body lengths.
    """
    three = _along().rowsBetween(-1, 1)
    size = max(1.0, body_length)
    have = set(df.columns)
    rows = df.withColumns({"__x": F.avg("x").over(three), "__y": F.avg("y").over(three)})
    rows = rows.withColumns({"__dx": _gradient("__x"), "__dy": _gradient("__y")})
    nothing = F.lit(None).cast("double")
    points = [p for p in POINTS if {f"{p}_x", f"{p}_y"} <= have]
    apart = lambda a, b: F.hypot(F.col(f"{a}_x") - F.col(f"{b}_x"), F.col(f"{a}_y") - F.col(f"{b}_y")) / size
    heading = F.atan2(F.col("nose_y") - F.col("centre_y"), F.col("nose_x") - F.col("centre_x")) if {"nose", "centre"} <= set(points) else nothing
    rows = rows.withColumn("__h", heading)
    turn = F.col("__h") - F.coalesce(F.lag("__h").over(_along()), F.col("__h"))
    extent = lambda a: F.greatest(*(F.col(f"{p}_{a}") for p in points)) - F.least(*(F.col(f"{p}_{a}") for p in points))
    made = {
        "speed": F.hypot("__dx", "__dy") * fps / size,
        "spread": (extent("x") + extent("y")) / size if len(points) > 1 else nothing,
        "length": apart("nose", "tail_base") if {"nose", "tail_base"} <= set(points) else nothing,
        "nose_distance": apart("nose", "centre") if {"nose", "centre"} <= set(points) else nothing,
        "turning": F.abs(F.atan2(F.sin(turn), F.cos(turn))) * fps,
    }
    seen = F.coalesce(F.col("seen").cast("double"), F.lit(0.0)) if "seen" in have else F.lit(1.0)
    return rows.select("session", "frame", *((made[c] if c in made else F.col(c) if c in have else nothing).cast("double").alias(c) for c in BASE), seen.alias("seen"))


def feature_names() -> list[str]:
    """The 100 names in order: each base feature, its means and spreads by window and its extremes over 1 s; seen."""
    out = []
    for c in BASE:
        out += [c, *(f"{c}_{k}{w:g}s" for w in WINDOWS_S for k in ("mean", "sd")), f"{c}_min1s", f"{c}_max1s"]
    return [*out, "seen"]


def context_features(base: DataFrame, fps: float) -> DataFrame:
    """(session, frame, features): array<double> in the order of feature_names(); null where nothing is known around.

    Windows are centred and shrink at the ends; missing values in them are left out. All share one order.
    """
    def around(seconds: float):
        k = max(1, round(seconds * fps))
        return _along().rowsBetween(-(k // 2), k - 1 - k // 2)

    columns: list[Column] = []
    for c in BASE:
        columns.append(F.col(c))
        for w in WINDOWS_S:
            columns += [F.avg(c).over(around(w)), F.stddev_pop(c).over(around(w))]
        columns += [F.min(c).over(around(1.0)), F.max(c).over(around(1.0))]
    names = feature_names()
    wide = base.select("session", "frame", *(x.alias(n) for x, n in zip([*columns, F.col("seen")], names)))
    return wide.select("session", "frame", F.array(*(F.col(f"`{n}`") for n in names)).alias("features"))


def label_frames(frames: DataFrame, events: DataFrame, behaviour: str, fps: float) -> DataFrame:
    """Adds `truth`: the frame's time lies in a state event [start, stop) of the behaviour. Events are dealt to minutes, so
    frames meet only the events near them."""
    minute = 60.0
    own = events.filter((F.col("behaviour") == behaviour) & F.col("stop").isNotNull()).select("session", "start", "stop")
    dealt = own.withColumn("__m", F.explode(F.sequence(F.floor(F.col("start") / minute), F.floor(F.col("stop") / minute))))
    rows = frames.withColumn("__t", F.col("frame") / fps).withColumn("__m", F.floor(F.col("__t") / minute))
    hit = rows.join(dealt, ["session", "__m"]).filter((F.col("__t") >= F.col("start")) & (F.col("__t") < F.col("stop"))).select("session", "frame").distinct().withColumn("truth", F.lit(True))
    return frames.join(hit, ["session", "frame"], "left").withColumn("truth", F.coalesce("truth", F.lit(False)))
