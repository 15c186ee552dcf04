"""A session's freezing as one result: summary, periods with their baseline, bins, motion by body area, and checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vivarium.operators import freezing as fz
from vivarium.operators.bins import bin_edges
from vivarium.operators.runs import ordered, with_runs

KEY = ["session"]
#: Body area by squared length, the share of a region that stands for an unknown body, the widest cutoff.
AREA_PER_LENGTH2, UNKNOWN_SHARE, MOST_CUTOFF = 1 / 2.4, 0.025, 40


def body_area(measured: Column, outline: Column, tracked: Column, region: Column) -> Column:
    """The body's area: from its measured length, else its outline's, else the tracked one, else a share of the region."""
    known = lambda c: F.when(c > 0, c)
    return F.coalesce(AREA_PER_LENGTH2 * known(measured) * known(measured), known(outline), known(tracked), UNKNOWN_SHARE * region)


def body_motion(df: DataFrame, cutoff: int, area: Column) -> DataFrame:
    """Adds `motion`, changed pixels as a share of the body's area in percent, from (hist, rate): pixels by grey change, and
    the share of pixels that change as much in a typical tile, which is taken off; null where not valid."""
    c = min(max(cutoff, 1), 63)
    over = F.aggregate(F.slice("hist", c + 1, 64), F.lit(0).cast("long"), lambda a, x: a + x)
    every = F.aggregate("hist", F.lit(0).cast("long"), lambda a, x: a + x)
    quiet = F.coalesce(F.try_element_at("rate", F.lit(c + 1)).cast("double"), F.lit(0.0)) * every
    motion = 100 * F.greatest(over - quiet, F.lit(0.0)) / F.greatest(area, F.lit(1e-6))
    return df.withColumn("motion", F.when(F.col("valid"), motion) if "valid" in df.columns else motion)


def part_threshold(percent: float) -> float:
    """A part of the body moved when its changed pixels reach this share of the body."""
    return max(1.0, percent / 2)


def threshold_pixels(percent: float, area: Column) -> Column:
    return percent / 100 * area


def tile_rates(tiles: DataFrame, grey: int = 6, quiet: float = 0.75) -> DataFrame:
    """(session, frame, rate) from tiles' histograms (session, frame, tile, hist): by grey level, the median share of pixels
    changed by that much over the quietest tiles of each frame."""
    over = lambda k: F.aggregate(F.slice("hist", k, 64), F.lit(0).cast("long"), lambda a, x: a + x)
    w = Window.partitionBy("session", "frame").orderBy(over(grey + 1), "tile")
    size = F.count("*").over(Window.partitionBy("session", "frame"))
    kept = tiles.withColumns({"__i": F.row_number().over(w), "__n": size}).filter(F.col("__i") <= F.greatest(F.lit(1), F.floor(F.col("__n") * quiet)))
    total = over(1)
    return kept.groupBy("session", "frame").agg(F.array(*(F.percentile(F.try_divide(over(k + 1), total), F.lit(0.5)) for k in range(64))).alias("rate"))


def periods(df: DataFrame, epochs: DataFrame, fps: float) -> DataFrame:
    """By session and epoch [start_s, end_s) of (session, epoch, start_s, end_s): share of freezing, seconds, bouts cut at
    its edges and their mean length, mean motion, and its own length. Epochs may overlap.

    Each epoch is dealt to the frames' blocks of a minute, so that frames meet only the epochs near them.
    """
    t = F.col("frame") / fps
    minute = 60.0
    dealt = epochs.withColumn("__m", F.explode(F.sequence(F.floor(F.col("start_s") / minute), F.floor(F.col("end_s") / minute))))
    rows = df.withColumn("__t", t).withColumn("__m", F.floor(F.col("__t") / minute)).join(dealt, ["session", "__m"])
    rows = rows.filter((F.col("__t") >= F.col("start_s") - 1e-9) & (F.col("__t") < F.col("end_s") - 1e-9))
    w = Window.partitionBy("session", "epoch").orderBy("frame")
    begins = F.col("freezing") & ~F.coalesce(F.lag("freezing").over(w), F.lit(False))
    sums = rows.withColumn("__b", begins.cast("int")).groupBy("session", "epoch").agg(
        F.first("start_s").alias("start_s"), F.first("end_s").alias("end_s"), (F.avg(F.col("freezing").cast("int")) * 100).alias("percent"), (F.sum(F.col("freezing").cast("int")) / fps).alias("seconds"),
        F.sum("__b").alias("bouts"), F.avg("motion").alias("mean_motion"), (F.count("*") / fps).alias("length_s"),
    )
    return sums.withColumn("mean_bout_s", F.coalesce(F.try_divide("seconds", "bouts"), F.lit(0.0)))


def with_baseline(df: DataFrame, epochs: DataFrame, fps: float, before_s: float = 30.0, t0: float = 0.0) -> DataFrame:
    """Periods with the before_s seconds before each: their share of freezing, the change, and the suppression of motion,
    m / (m + m before). Null where the time before isn't whole within the session."""
    own = periods(df, epochs, fps)
    earlier = epochs.filter(F.col("start_s") - before_s >= t0 - 1e-9).select("session", "epoch", (F.col("start_s") - before_s).alias("start_s"), F.col("start_s").alias("end_s"))
    base = periods(df, earlier, fps).select("session", "epoch", F.col("percent").alias("before_percent"), F.col("mean_motion").alias("before_motion"))
    joined = own.join(base, ["session", "epoch"], "left")
    both = F.col("mean_motion") + F.col("before_motion")
    return joined.withColumns({"change": F.col("percent") - F.col("before_percent"), "suppression": F.when(both > 0, F.col("mean_motion") / both)}).drop("before_motion")


def bins(df: DataFrame, width: float, t0: float, t1: float, fps: float) -> DataFrame:
    """Periods of equal width; a tiny last piece joins the one before."""
    edges = bin_edges(t0, t1, width)
    rows = [F.struct(F.lit(i).alias("epoch"), F.lit(a).alias("start_s"), F.lit(b).alias("end_s")) for i, (a, b) in enumerate(zip(edges, edges[1:]), 1)]
    listed = df.select("session").distinct().withColumn("e", F.explode(F.array(*rows))).select("session", "e.*")
    return periods(df, listed, fps).withColumnRenamed("epoch", "bin")


def summary(df: DataFrame, fps: float) -> DataFrame:
    """One row per session of (session, frame, freezing, motion): time, share, bouts and the time between them."""
    t0, t1 = F.min("frame") / fps, (F.max("frame") + 1) / fps
    freezing = F.col("freezing").cast("int")
    whole = df.groupBy("session").agg((F.count("*") / fps).alias("analysed_s"), t0.alias("start_s"), t1.alias("end_s"), (F.avg(freezing) * 100).alias("percent"), (F.sum(freezing) / fps).alias("freezing_s"), F.avg("motion").alias("mean_motion"))
    runs = with_runs(df, KEY, "frame", "freezing").filter("freezing").groupBy("session", "run").agg((F.min("frame") / fps).alias("start"), ((F.max("frame") + 1) / fps).alias("end"), (F.count("*") / fps).alias("long"))
    runs = runs.withColumn("gap", F.lead("start").over(ordered(KEY, "start")) - F.col("end"))
    middle = lambda c: F.percentile(c, F.lit(0.5))
    of = runs.groupBy("session").agg(
        F.count("*").alias("bouts"), F.avg("long").alias("mean_bout_s"), middle("long").alias("median_bout_s"), F.max("long").alias("longest_bout_s"), F.min("start").alias("first"),
        F.avg("gap").alias("mean_gap_s"), middle("gap").alias("median_gap_s"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    n = F.coalesce("bouts", F.lit(0))
    return whole.join(of, "session", "left").select(
        "session", "analysed_s", "start_s", "end_s", "percent", "freezing_s", (F.col("analysed_s") - F.col("freezing_s")).alias("active_s"), n.alias("bouts"), zero("mean_bout_s"), zero("median_bout_s"), zero("longest_bout_s"),
        (F.col("first") - F.col("start_s")).alias("latency_s"), (n / (F.col("analysed_s") / 60)).alias("bouts_per_min"), "mean_gap_s", "median_gap_s", "mean_motion",
    )


def cumulative(df: DataFrame, fps: float) -> DataFrame:
    """(session, frame, seconds): freezing so far."""
    w = ordered(KEY, "frame").rowsBetween(Window.unboundedPreceding, 0)
    return df.select("session", "frame", (F.sum(F.col("freezing").cast("int")).over(w) / fps).alias("seconds"))


def more_checks(found: DataFrame) -> DataFrame:
    """(session, level, code, value) beside freezing.quality_checks, from one row per session: cutoff, size_source, body_length,
    tracked_length, core_ratio, core_share, looks_other, animal_percent, percent, moved_elsewhere (share of moving frames with a
    still animal), outside_percent, trimmed_s; missing columns are skipped, and so is what is null."""
    have = set(found.columns)
    ratio = F.try_divide("body_length", "tracked_length")
    by_hand = F.col("size_source") == "measured" if "size_source" in have else F.lit(False)
    rules = (
        (("cutoff",), lambda: F.col("cutoff") >= MOST_CUTOFF, "error", "cutoff", lambda: F.col("cutoff")),
        (("size_source",), lambda: F.col("size_source") == "unknown", "error", "size", lambda: F.lit(0)),
        (("size_source", "body_length", "tracked_length"), lambda: by_hand & ~ratio.between(0.6, 1.6), "warn", "size", lambda: ratio),
        (("size_source", "core_ratio", "core_share"), lambda: ~by_hand & (F.col("size_source") != "unknown") & (F.col("core_ratio") < 0.8) & (F.col("core_share") < 0.5), "warn", "bodysize", lambda: F.col("core_ratio")),
        (("looks_other",), lambda: F.col("looks_other"), "warn", "colour", lambda: F.lit(1)),
        (("moved_elsewhere", "animal_percent", "percent"), lambda: (F.col("moved_elsewhere") > 0.2) | (F.col("animal_percent") - F.col("percent") > 15), "warn", "elsewhere", lambda: F.col("animal_percent") - F.col("percent")),
        (("outside_percent",), lambda: F.col("outside_percent") > 25, "warn", "outside", lambda: F.col("outside_percent")),
        (("trimmed_s",), lambda: F.col("trimmed_s") > 0, "info", "trim", lambda: F.col("trimmed_s")),
    )
    each = [F.when(when(), F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), value().cast("double").alias("value"))) for needs, when, level, code, value in rules if have >= set(needs)]
    return found.select("session", F.explode(F.array_compact(F.array(*each))).alias("c")).select("session", "c.*")


@dataclass
class Result:
    """What analyse() finds, each a table by session."""

    frames: DataFrame
    summary: DataFrame
    bouts: DataFrame
    epochs: DataFrame
    kinds: DataFrame
    bins: DataFrame
    checks: DataFrame


def analyse(df: DataFrame, epochs: DataFrame, fps: float, threshold: float, min_freeze_s: float = 1.0, blip_s: float = 0.0, before_s: float = 30.0, bin_s: float = 60.0, t1: float | None = None) -> Result:
    """The whole freezing result of (session, frame, motion, usable and, where known, bright, found, still, light_change).

    Dark or over-bright ends are trimmed first; epochs: (session, epoch, start_s, end_s). t1 ends the bins (else the last
    frame of all sessions).
    """
    if "bright" in df.columns:
        df = df.join(fz.lights_trim(df, fps), "session").filter(F.col("frame").between(F.col("first"), F.col("last"))).drop("first", "last")
    frames = fz.states(df, threshold, round(blip_s * fps), max(1, round(min_freeze_s * fps)))
    end = t1 if t1 is not None else (frames.agg(F.max("frame")).first()[0] or 0) / fps + 1 / fps
    found = with_baseline(frames, epochs, fps, before_s)
    return Result(frames, summary(frames, fps), fz.bouts(frames, fps), found, fz.epoch_kinds(found), bins(frames, bin_s, 0.0, end, fps), fz.quality_checks(frames, threshold, fps))
