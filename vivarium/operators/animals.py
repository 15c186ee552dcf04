"""Several animals at once: identities along frames, and what each animal did."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vivarium.operators.assignment import matched
from vivarium.operators.bins import bin_of, bin_table
from vivarium.operators.walks import along_sessions

#: Variances of velocity and of a detection, those at the start, and how long a lost animal coasts on.
PROCESS, MEASURED, START, COAST = 4.0, 25.0, (1.0, 50.0), 15
#: Fixed values of looks: frames remembered, looks needed, least spread, and pooled spreads that tell two animals apart.
LOOK_FRAMES, LOOKS_NEEDED, LEAST_SPREAD, APART = 300, 15, 1.5, 4.0


class Motion:
    """Constant-velocity filters of all animals at once, each axis on its own; both axes have the same covariance. Plain numbers, as
    a session has few animals and many frames."""

    def __init__(self, places: list[tuple[float, float]]):
        n = len(places)
        self.at, self.speed = [(float(x), float(y)) for x, y in places], [(0.0, 0.0)] * n
        self.pp, self.pv, self.vv = [START[0]] * n, [0.0] * n, [START[1]] * n
        self.lost = [0] * n

    def predict(self) -> list[tuple[float, float]]:
        self.speed = [(0.0, 0.0) if lost > COAST else v for v, lost in zip(self.speed, self.lost)]
        self.at = [(x + u, y + v) for (x, y), (u, v) in zip(self.at, self.speed)]
        self.pp = [a + 2 * b + c for a, b, c in zip(self.pp, self.pv, self.vv)]
        self.pv = [b + c for b, c in zip(self.pv, self.vv)]
        self.vv = [c + PROCESS for c in self.vv]
        return self.at

    def update(self, who: list[int], seen: list[tuple[float, float]]) -> None:
        self.at = list(self.at)
        self.lost = [lost + 1 for lost in self.lost]
        for a, (sx, sy) in zip(who, seen):
            pp, pv = self.pp[a], self.pv[a]
            gain_p, gain_v = pp / (pp + MEASURED), pv / (pp + MEASURED)
            (x, y), (u, v) = self.at[a], self.speed[a]
            dx, dy = sx - x, sy - y
            self.at[a], self.speed[a] = (x + gain_p * dx, y + gain_p * dy), (u + gain_v * dx, v + gain_v * dy)
            self.pp[a], self.pv[a], self.vv[a] = pp * (1 - gain_p), pv * (1 - gain_p), self.vv[a] - gain_v * pv
            self.lost[a] = 0

    def reorder(self, order: list[int]) -> None:
        """Animal a goes on with what animal order[a] had."""
        for name in ("at", "speed", "pp", "pv", "vv", "lost"):
            kept = getattr(self, name)
            setattr(self, name, [kept[a] for a in order])


def distances(a: list[tuple[float, float]], b: list[tuple[float, float]]) -> list[list[float]]:
    return [[math.hypot(x - u, y - v) for u, v in b] for x, y in a]


def placed(spots: list[dict] | None) -> list[dict]:
    return [s for s in spots or [] if s["x"] is not None and s["y"] is not None and math.isfinite(s["x"]) and math.isfinite(s["y"])]


class Spots:
    """A session's animals by place alone: spots go to the predicted animals at the least summed distance."""

    def __init__(self, animals: int):
        self.animals, self.motion = animals, None

    def step(self, frame: int, spots: list[dict] | None) -> list[tuple]:
        seen = [(float(s["x"]), float(s["y"])) for s in placed(spots)]
        if self.motion is None:
            if len(seen) < self.animals:
                return []
            self.motion = Motion(sorted(seen)[: self.animals])
            return [(frame, a, *place, "ok") for a, place in enumerate(self.motion.at)]
        places = list(self.motion.predict())
        who, which = matched(distances(places, seen))
        self.motion.update(who, [seen[w] for w in which])
        for a, w in zip(who, which):
            places[a] = seen[w]
        return [(frame, a, *place, "ok" if a in who else "lost") for a, place in enumerate(places)]

    def end(self) -> list[tuple]:
        return []


def identities(detections: DataFrame, animals: int) -> DataFrame:
    """(session, frame, animal, x, y, status) from (session, frame, spots: array<struct<x, y>>), by places alone.

    The first frame with all animals names them from left to right; then each frame's spots go to the predicted animals
    at the least total distance. status is ok where an animal has a spot, else lost, with its predicted place. Frames
    before the first whole one give no rows. `identities.track_animals` is the whole loop, with looks.
    """
    return along_sessions(detections, ["frame", "spots"], lambda: Spots(animals), "frame long, animal int, x double, y double, status string")


def _each():
    return Window.partitionBy("session", "animal").orderBy("frame")


def _step():
    return F.hypot(F.col("x") - F.lag("x").over(_each()), F.col("y") - F.lag("y").over(_each()))


def animal_summary(tracks: DataFrame) -> DataFrame:
    """By session and animal: distance over the frames it was seen in (across gaps), frames by status, and quality."""
    seen = F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("status") != "lost")
    lengths = tracks.filter(seen).withColumn("step", _step()).groupBy("session", "animal").agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("distance"))
    n = lambda c: F.count(F.when(c, 1))
    counts = tracks.groupBy("session", "animal").agg(n(seen).alias("tracked"), n(F.col("status") == "lost").alias("lost"), n(F.col("status") == "partial").alias("partial"), (100 * n(seen) / F.count("*")).alias("quality"))
    return counts.join(lengths, ["session", "animal"], "left").withColumn("distance", F.coalesce("distance", F.lit(0.0)))


def animal_bins(tracks: DataFrame, edges: list[float], width: float) -> DataFrame:
    """By session, animal and bin: summed steps and frames not lost; empty bins have zeros."""
    rows = tracks.withColumn("step", F.coalesce(_step(), F.lit(0.0))).withColumn("bin", bin_of(F.col("time_s"), edges, width)).filter("bin IS NOT NULL")
    sums = rows.groupBy("session", "animal", "bin").agg(F.sum("step").alias("distance"), F.count(F.when(F.col("status") != "lost", 1)).alias("frames"))
    out = bin_table(tracks, edges, ["session", "animal"], width).join(sums, ["session", "animal", "bin"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("distance", "frames")})


def bridge(tracks: DataFrame) -> DataFrame:
    """Tracks in the form of one animal's: status in words, and a distance only between two known places in a row."""
    known = F.col("x").isNotNull() & F.col("y").isNotNull()
    word = F.when(F.col("status") == "lost", "Lost").when(F.col("status") == "partial", "Partial").otherwise("Tracked")
    return tracks.withColumn("distance", F.when(known, F.coalesce(_step(), F.lit(0.0))).otherwise(F.lit(0.0))).withColumn("status", word)


def object_bouts(near: DataFrame, fps: float, least_s: float = 0.3) -> DataFrame:
    """(session, object, first, last, start, end, duration) of runs near an object of least_s or more, from (session, object,
    frame, near)."""
    from vivarium.operators.runs import with_runs

    found = with_runs(near.withColumn("near", F.coalesce("near", F.lit(False))), ["session", "object"], "frame", "near").filter("near")
    runs = found.groupBy("session", "object", "run").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("n"))
    kept = runs.filter(F.col("n") >= max(1, round(least_s * fps)))
    return kept.select("session", "object", "first", "last", (F.col("first") / fps).alias("start"), (F.col("last") / fps).alias("end"), (F.col("n") / fps).alias("duration"))


def nose_exploration(flags: DataFrame, fps: float, novel: str, familiar: str) -> DataFrame:
    """By session: seconds with the nose in each of two objects' zones, and how much more at the novel one, from zone flags of
    nose positions."""
    of = lambda z: F.count(F.when((F.col("zone") == z) & F.col("inside"), 1)) / fps
    n, f = F.col("novel_s"), F.col("familiar_s")
    rows = flags.groupBy("session").agg(of(novel).alias("novel_s"), of(familiar).alias("familiar_s"))
    return rows.withColumns({"total_s": n + f, "discrimination": F.try_divide(n - f, n + f), "ratio": F.try_divide(n, n + f), "recognition_percent": 100 * F.try_divide(n, n + f)})


def looks(samples: DataFrame) -> DataFrame:
    """(session, animal, look, spread) from (session, frame, animal, look) of frames in which the animals are clearly apart.

    The median of an animal's last LOOK_FRAMES known looks, and 1.4826 times the median distance to it, LEAST_SPREAD at
    least; animals with fewer than LOOKS_NEEDED looks have no row.
    """
    newest = Window.partitionBy("session", "animal").orderBy(F.desc("frame"))
    known = samples.filter(F.col("look").isNotNull() & ~F.isnan("look"))
    rows = known.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= LOOK_FRAMES)
    whole = Window.partitionBy("session", "animal")  # LOOK_FRAMES rows at most
    rows = rows.withColumn("middle", F.percentile("look", F.lit(0.5)).over(whole))
    found = rows.groupBy("session", "animal").agg(F.count("*").alias("n"), F.first("middle").alias("look"), F.percentile(F.abs(F.col("look") - F.col("middle")), F.lit(0.5)).alias("off"))
    return found.filter(F.col("n") >= LOOKS_NEEDED).select("session", "animal", "look", F.greatest(F.lit(LEAST_SPREAD), 1.4826 * F.col("off")).alias("spread"))


def distinct_looks(found: DataFrame, animals: int) -> DataFrame:
    """(session, look, spread), arrays by animal, of sessions in which all looks are known and each two differ by over APART pooled spreads."""
    at = lambda c: F.array_agg(F.struct("animal", c)).alias(c)
    by = found.groupBy("session").agg(F.count("*").alias("n"), at("look"), at("spread")).filter(F.col("n") == animals)
    by = by.select("session", *(F.array_sort(c)[c].alias(c) for c in ("look", "spread")))
    for a, b in itertools.combinations(range(animals), 2):
        pooled = F.sqrt((F.col("spread")[a] ** 2 + F.col("spread")[b] ** 2) / 2)
        by = by.filter(F.abs(F.col("look")[a] - F.col("look")[b]) >= APART * pooled)
    return by


def look_order(meetings: DataFrame, found: DataFrame, animals: int) -> DataFrame:
    """(session, frame, order): which detection is which animal in the first clear frame after a contact, by looks.

    meetings: session, frame, looks (an array by detection). Of all orders (animals are few) that with the least sum of
    squared distances in spreads; equal ones in the order of their numbers. Frames with an unknown look, and sessions
    whose animals look alike, have no row.
    """
    ways = list(itertools.permutations(range(animals)))
    cost = lambda p: sum(((F.col("looks")[d] - F.col("look")[a]) / F.col("spread")[a]) ** 2 for a, d in enumerate(p))
    best = F.array_min(F.array(*(F.struct(cost(p).alias("cost"), F.lit(i).alias("way")) for i, p in enumerate(ways))))["way"]
    rows = meetings.filter(~F.exists("looks", lambda v: v.isNull() | F.isnan(v))).join(distinct_looks(found, animals), "session")
    return rows.select("session", "frame", F.array(*(F.array(*(F.lit(d) for d in p)) for p in ways))[best].alias("order"))
