"""Zones: membership, visits, moves between them, and the indices of behavioural tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vivarium.operators.outlines import by_outline, inside
from vivarium.operators.runs import debounced, ordered, run_table, with_runs

ZONE_KEY = ["session", "zone"]


def present() -> Column:
    return F.col("status").isin("Tracked", "Hidden")


def in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Inside by the even-odd rule, or on an edge."""
    after = F.concat(F.slice(polygon, 2, F.size(polygon)), F.slice(polygon, 1, 1))
    edges = F.arrays_zip(polygon.alias("a"), after.alias("b"))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        over = (a["y"] > y) != (b["y"] > y)
        at = a["x"] + F.try_divide((y - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"])
        return over & (x < at)

    def touches(e: Column) -> Column:
        a, b = e["a"], e["b"]
        line = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        return (F.abs(line) < 1e-9) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    return (F.size(F.filter(edges, crosses)) % 2 == 1) | F.exists(edges, touches)


def zone_flags(df: DataFrame, zones: DataFrame) -> DataFrame:
    """Long form: a row per frame and zone with `inside` (null position: null); zones are few and fixed by the arena."""
    pixel = lambda c: F.bround(F.col(c))
    rows = by_outline(df, zones, inside, "boolean", pixel("x"), pixel("y"))
    return rows.withColumn("inside", F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.col("__found"))).drop("__found")


def labelled(flags: DataFrame) -> DataFrame:
    """One row per frame with `label`: the first zone it is in, null outside all."""
    hit = F.min(F.when(F.col("inside"), F.struct("place", "zone")))
    return flags.groupBy("session", "frame").agg(F.first("time_s").alias("time_s"), F.first("status").alias("status"), hit["zone"].alias("label"))


def zone_states(flags: DataFrame, min_frames: int) -> DataFrame:
    """Adds `state`: lost frames keep the flag before (false at first), then debounced."""
    w = ordered(ZONE_KEY, "frame").rowsBetween(Window.unboundedPreceding, 0)
    kept = flags.withColumn("flag", F.coalesce(F.last(F.when(present(), F.col("inside")), ignorenulls=True).over(w), F.lit(False)))
    return debounced(kept, ZONE_KEY, "frame", "flag", min_frames)


def zone_visits(flags: DataFrame, min_frames: int, fps: float) -> DataFrame:
    """(session, zone, start, stop, n): runs of the debounced state."""
    found = run_table(zone_states(flags, min_frames), ZONE_KEY, "frame", "state").filter("state")
    return found.select("session", "zone", F.col("t_first").alias("start"), (F.col("t_last") + 1 / fps).alias("stop"), "n")


def zone_table(flags: DataFrame, min_frames: int, fps: float) -> DataFrame:
    """Seconds, share of present time, entries, latency, mean visit and distance by session and zone."""
    w = ordered(ZONE_KEY, "frame")
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    inside = present() & F.coalesce("inside", F.lit(False))
    rows = flags.withColumn("step", F.coalesce(step, F.lit(0.0)))
    sums = rows.groupBy("session", "zone").agg(
        (F.count(F.when(inside, 1)) / fps).alias("time_s"),
        (F.try_divide(F.count(F.when(inside, 1)), F.count(F.when(present(), 1))) * 100).alias("percent"),
        F.sum(F.when(inside, F.col("step")).otherwise(0.0)).alias("distance"),
    )
    visits = zone_visits(flags, min_frames, fps).groupBy("session", "zone").agg(F.count("*").alias("entries"), F.min("start").alias("latency_s"))
    return sums.join(visits, ZONE_KEY, "left").withColumn("entries", F.coalesce("entries", F.lit(0))).withColumn("mean_visit_s", F.try_divide("time_s", "entries"))


def moves(labels: DataFrame, confirmation: int = 3) -> DataFrame:
    """(session, from_zone, to_zone, time_s): a new label counts once seen `confirmation` frames in a row, at that frame.

    Frames without the animal or outside all zones are left out first; the first label counts at once.
    """
    rows = with_runs(labels.filter(present() & F.col("label").isNotNull()), ["session"], "frame", "label")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("session", "run").orderBy("frame")))
    found = rows.groupBy("session", "run").agg(F.first("label").alias("label"), F.count("*").alias("n"), F.max(F.when(F.col("k") == confirmation, F.col("time_s"))).alias("time_s"))
    kept = found.filter((F.col("n") >= confirmation) | (F.col("run") == 1))
    kept = kept.withColumn("was", F.lag("label").over(ordered(["session"], "run")))
    return kept.filter("was IS NOT NULL AND was <> label").select("session", F.col("was").alias("from_zone"), F.col("label").alias("to_zone"), "time_s")


def transition_counts(moved: DataFrame) -> DataFrame:
    return moved.groupBy("from_zone", "to_zone").agg(F.count("*").alias("n"))


def entries_by_candidate(rows: DataFrame, min_frames: int = 3) -> DataFrame:
    """(session, zone, time_s) of four-paw entries from (session, frame, time_s, candidate).

    Frames without candidate don't break a run; a run of min_frames or more of another zone is an entry at its first frame.
    """
    found = run_table(rows.filter("candidate IS NOT NULL"), ["session"], "frame", "candidate").filter(F.col("n") >= min_frames)
    was = F.lag("candidate").over(ordered(["session"], "run"))
    return found.withColumn("was", was).filter("was IS NULL OR was <> candidate").select("session", F.col("candidate").alias("zone"), F.col("t_first").alias("time_s"))


def alternation(entries: DataFrame) -> DataFrame:
    """Of each session's entries: triplets of three different arms, same-arm and alternate-arm returns, and the share."""
    w = ordered(["session"], "time_s")
    rows = entries.withColumns({"b": F.lead("zone", 1).over(w), "c": F.lead("zone", 2).over(w)})
    a, b, c = F.col("zone"), F.col("b"), F.col("c")
    whole = c.isNotNull()
    count = lambda cond: F.count(F.when(whole & cond, 1))
    return rows.groupBy("session").agg(
        F.count("*").alias("entries"), count((a != b) & (b != c) & (a != c)).alias("alternations"), count((b == c)).alias("same_arm"), count((a == c) & (a != b)).alias("alternate_arm"),
        (F.try_divide(count((a != b) & (b != c) & (a != c)), F.count(F.when(whole, 1))) * 100).alias("percent"),
    )


def plus_maze(table: DataFrame, totals: DataFrame) -> DataFrame:
    """Open and closed arm time, entries, their ratios and the anxiety index; totals has total_s of all frames."""
    kind = F.when(F.col("zone").startswith("Open"), "open").when(F.col("zone").startswith("Closed"), "closed")
    of = lambda k, c: F.coalesce(F.sum(F.when(kind == k, F.col(c))), F.lit(0))
    sums = table.groupBy("session").agg(of("open", "time_s").alias("open_s"), of("closed", "time_s").alias("closed_s"), of("open", "entries").alias("open_n"), of("closed", "entries").alias("closed_n"), F.min(F.when(kind == "open", F.col("latency_s"))).alias("open_latency_s"))
    joined = sums.join(totals, "session")
    arms = F.col("open_n") + F.col("closed_n")
    anxiety = 1 - (F.try_divide("open_s", "total_s") + F.try_divide(F.col("open_n"), arms)) / 2
    return joined.select("session", "open_s", "closed_s", "open_n", "closed_n", "open_latency_s", F.try_divide(F.col("open_s"), F.col("open_s") + F.col("closed_s")).alias("open_share"), F.try_divide(F.col("open_n"), arms).alias("entry_share"), anxiety.alias("anxiety"))


def preference(table: DataFrame, first: str, second: str) -> DataFrame:
    """(a - b) / (a + b) and a / (a + b) of the seconds in two zones: discrimination and preference."""
    of = lambda z: F.coalesce(F.sum(F.when(F.col("zone") == z, F.col("time_s"))), F.lit(0.0))
    rows = table.groupBy("session").agg(of(first).alias("a"), of(second).alias("b"))
    return rows.select("session", F.try_divide(F.col("a") - F.col("b"), F.col("a") + F.col("b")).alias("discrimination"), F.try_divide(F.col("a"), F.col("a") + F.col("b")).alias("preference"))


def time_bins(flags: DataFrame, width: float, fps: float, cumulative: bool = False) -> DataFrame:
    """Seconds in each zone by bin [k x width, (k + 1) x width), or up to its end."""
    rows = flags.withColumn("bin", F.floor(F.col("time_s") / width)).groupBy("session", "zone", "bin")
    out = rows.agg((F.count(F.when(present() & F.col("inside"), 1)) / fps).alias("time_s"))
    if not cumulative:
        return out.withColumn("percent", F.col("time_s") / width * 100)
    return out.withColumn("time_s", F.sum("time_s").over(ordered(ZONE_KEY, "bin").rowsBetween(Window.unboundedPreceding, 0)))
