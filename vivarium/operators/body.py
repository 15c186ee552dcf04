"""Ends of the body, and stays under cover."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vivarium.operators.ranks import medians
from vivarium.operators.runs import ordered, with_runs
from vivarium.operators.walks import along_sessions
from vivarium.operators.zones import in_polygon

KEY = ["session"]
#: Weights of the evidence for the head (tail shape, outline, direction of walking), and of the link between frames.
TAIL, SHAPE, WALK, LINK = -1.5, 0.5, 1.2, 2.0
#: Frames of a session that one task traces; results don't depend on it.
BLOCK = 10_000


def polygon_distance(x: Column, y: Column, polygon: Column) -> Column:
    """Distance to the polygon: 0 inside."""
    after = F.concat(F.slice(polygon, 2, F.size(polygon)), F.slice(polygon, 1, 1))

    def to_edge(e: Column) -> Column:
        a, b = e["a"], e["b"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = F.coalesce(F.try_divide((x - a["x"]) * dx + (y - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        return F.hypot(x - (a["x"] + t * dx), y - (a["y"] + t * dy))

    edges = F.arrays_zip(polygon.alias("a"), after.alias("b"))
    return F.when(in_polygon(x, y, polygon), 0.0).otherwise(F.array_min(F.transform(edges, to_edge)))


def hidden_in_covered(df: DataFrame, covered: DataFrame, near: float) -> DataFrame:
    """Adds `hidden_zone`: the covered zone that a run of unseen rows was spent in, else null.

    The animal was last seen and is next seen within `near` of the same nearest covered zone (place, zone, polygon; the
    earlier place wins ties); at the ends of a session one side decides.
    """
    listed = covered.agg(F.collect_list(F.struct("place", "zone", "polygon")).alias("__zones"))  # one row: a short list
    rows = df.join(F.broadcast(listed))
    x, y = F.bround(F.col("x")), F.bround(F.col("y"))
    far = F.transform("__zones", lambda z: F.struct(polygon_distance(x, y, z["polygon"]).alias("d"), z["place"].alias("place"), z["zone"].alias("zone")))
    seen = F.col("status") == "Tracked"
    best = F.array_min(far)
    rows = rows.withColumn("__near", F.when(seen & F.col("x").isNotNull() & (best["d"] <= near), best["zone"])).drop("__zones")
    named = with_runs(rows, KEY, "frame", seen)
    w = ordered(KEY, "frame")
    side = F.struct(seen.alias("seen"), F.col("__near").alias("zone"))
    back = F.last(F.when(seen, side), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(F.when(seen, side), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    sided = named.withColumns({"__a": back, "__b": ahead})
    a, b = F.col("__a.zone"), F.col("__b.zone")
    zone = F.when(F.col("__a").isNull(), b).when(F.col("__b").isNull(), a).when(a == b, a)
    return sided.withColumn("hidden_zone", F.when(~seen, zone)).drop("__near", "__a", "__b", "run")


class Forward:
    """Along a session's blocks: the costs of both orientations before each, from the blocks' matrices."""

    def __init__(self):
        self.cost = np.zeros(2)

    def step(self, block: int, m: list[float]) -> list[tuple]:
        before = self.cost
        self.cost = (before[:, None] + np.array(m).reshape(2, 2)).min(axis=0)
        return [(block, before.tolist(), m, int(self.cost.argmin()))]

    def end(self) -> list[tuple]:
        return []


class Backward:
    """Along the blocks from the last to the first: the orientation at the end of each."""

    def __init__(self):
        self.state: int | None = None

    def step(self, block: int, before: list[float], m: list[float], best: int) -> list[tuple]:
        state = best if self.state is None else self.state
        self.state = int((np.array(before) + np.array(m).reshape(2, 2)[:, state]).argmin())
        return [(block, before, state)]

    def end(self) -> list[tuple]:
        return []


def _moves(kept: float, swapped: float, evidence: float) -> tuple[float, float, float, float]:
    """The 2 x 2 costs of going on from an orientation to one, its own evidence with it, by rows."""
    return kept - evidence, swapped + evidence, swapped - evidence, kept + evidence


class Matrix:
    """Along a block's frames: the least costs from an orientation before the block to one at its end."""

    def __init__(self):
        self.m = 0.0, float("inf"), float("inf"), 0.0

    def step(self, *costs: float) -> list[tuple]:
        (a, b, c, d), (p, q, r, t) = self.m, _moves(*costs)
        self.m = min(a + p, b + r), min(a + q, b + t), min(c + p, d + r), min(c + q, d + t)
        return []

    def end(self) -> list[tuple]:
        return [(list(self.m),)]


class Trace:
    """Along a block's frames, with the costs before it and the orientation at its end: the ends of each frame."""

    def __init__(self):
        self.cost: list[float] | None = None
        self.rows: list[tuple] = []

    def step(self, frame: int, kept: float, swapped: float, evidence: float, ax: float, ay: float, bx: float, by: float, before: list[float], state: int) -> list[tuple]:
        first, second = before if self.cost is None else self.cost
        p, q, r, t = _moves(kept, swapped, evidence)
        came = int(second + r < first + p), int(second + t < first + q)
        self.cost, self.state = [min(first + p, second + r), min(first + q, second + t)], state
        self.rows.append((came, (frame, ax, ay, bx, by), (frame, bx, by, ax, ay)))
        return []

    def end(self) -> list[tuple]:
        state, out = self.state, []
        for came, *ends in reversed(self.rows):
            out.append(ends[state])
            state = came[state]
        return out


def _frames_with_ends(df: DataFrame, fps: float, body_length: float | None, block: int) -> DataFrame:
    """Frames that have both ends: their places, evidence that b is the head's end, and costs of keeping or swapping since the one before."""
    w = Window.partitionBy("session").orderBy("frame")
    k = max(1, round(0.2 * fps))
    rows = df.withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("session"))})
    first, last = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    low = lambda c: F.when(F.col("i") >= k, F.lag(c, k).over(w)).otherwise(F.first(c).over(first))
    high = lambda c: F.when(F.col("i") + k < F.col("n"), F.lead(c, k).over(w)).otherwise(F.last(c).over(last))
    seconds = F.greatest((F.least(F.col("i") + k, F.col("n") - 1) - F.greatest(F.col("i") - k, F.lit(0))) / fps, F.lit(1e-9))
    rows = rows.withColumns({"vx": (high("x") - low("x")) / seconds, "vy": (high("y") - low("y")) / seconds})
    ends = ("ax", "ay", "bx", "by")
    rows = rows.dropna(subset=list(ends)).withColumn("length", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")))
    if body_length is None:
        size = medians(rows.select("session", F.col("length").alias("value")), ["session"], few=False).select(F.col("session").alias("whose"), F.greatest("median", F.lit(4.0)).alias("size"))
        rows = rows.join(size, F.col("session").eqNullSafe(F.col("whose"))).drop("whose")
    else:
        rows = rows.withColumn("size", F.lit(max(float(body_length), 4.0)))
    speed = F.hypot("vx", "vy")
    along = F.try_divide((F.col("ax") - F.col("bx")) * F.col("vx") + (F.col("ay") - F.col("by")) * F.col("vy"), F.col("length") * speed)
    walk = F.coalesce(along * F.least(F.lit(1.0), speed / (1.5 * F.col("size"))), F.lit(0.0))
    known = lambda c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
    evidence = TAIL * known("tail_ev") + SHAPE * known("shape_ev") + WALK * walk
    was = {f"p{c}": F.lag(c).over(w) for c in (*ends, "i")}
    rows = rows.withColumn("evidence", evidence).withColumns(was).withColumn("block", F.floor((F.row_number().over(w) - 1) / block))
    gap = lambda a, b, c, d: F.hypot(F.col(a) - F.col(f"p{c}"), F.col(b) - F.col(f"p{d}"))
    link = LINK / (1 + 0.5 * F.greatest(F.col("i") - F.col("pi") - 1, F.lit(0))) / F.col("size")
    kept = F.coalesce(link * (gap("ax", "ay", "ax", "ay") + gap("bx", "by", "bx", "by")), F.lit(0.0))
    swapped = F.coalesce(link * (gap("ax", "ay", "bx", "by") + gap("bx", "by", "ax", "ay")), F.lit(0.0))
    return rows.select("session", "block", "frame", *ends, "evidence", kept.alias("kept"), swapped.alias("swapped"))


def head_and_tail(df: DataFrame, fps: float, body_length: float | None = None, block: int = BLOCK) -> DataFrame:
    """(session, frame, head_x, head_y, tail_x, tail_y) from frames with two ends a, b and evidence columns.

    df: session, frame, x, y (centre), ax, ay, bx, by, tail_ev, shape_ev; rows without ends get nulls, null evidence counts as none. The
    orientation that costs least over a session: evidence that an end is the head, and jumps of the ends between frames in body
    lengths (linked weaker over missing frames).

    A block of frames is one matrix of least costs from an orientation before it to one at its end. Blocks become matrices side by
    side; these are added up along each session, a row a block, forward for the costs before each block and
    back for the orientation at its end; with both, blocks are traced side by side. No task holds more frames than a block.
    """
    columns = ("session", "frame", "x", "y", "ax", "ay", "bx", "by", "tail_ev", "shape_ev")
    rows = df.select(*(F.col(c) if c in columns[:2] else F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns))
    framed = _frames_with_ends(rows, fps, body_length, block).persist()

    framed = framed.withColumn("session", F.struct("session", "block"))  # blocks are walked side by side, many in one call
    matrices = along_sessions(framed, ["kept", "swapped", "evidence"], Matrix, "m array<double>").select("session.session", "session.block", "m")
    onward = along_sessions(matrices, ["block", "m"], Forward, "block long, before array<double>, m array<double>, best int", order="block")
    back = along_sessions(onward.withColumn("turn", -F.col("block")), ["block", "before", "m", "best"], Backward, "block long, before array<double>, state int", order="turn")

    ends = back.select(F.struct("session", "block").alias("whose"), "before", F.col("state").alias("last"))
    known = framed.join(ends, F.col("session").eqNullSafe(F.col("whose"))).withColumnRenamed("last", "state")
    columns = ["frame", "kept", "swapped", "evidence", "ax", "ay", "bx", "by", "before", "state"]
    solved = along_sessions(known, columns, Trace, "frame long, head_x double, head_y double, tail_x double, tail_y double")
    solved = solved.select("session.session", "frame", "head_x", "head_y", "tail_x", "tail_y")
    none = [F.lit(None).cast("double").alias(c) for c in ("head_x", "head_y", "tail_x", "tail_y")]
    bare = rows.filter("ax IS NULL OR ay IS NULL OR bx IS NULL OR by IS NULL").select("session", F.col("frame").cast("long").alias("frame"), *none)
    return solved.unionByName(bare)
