"""Freezing from per-frame motion: states, bouts and periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vivarium.operators.runs import ordered, with_runs

KEY = ["session"]


def motion_percent(df: DataFrame, cutoff: int) -> DataFrame:
    """Adds `motion`: the share of pixels whose change is at least `cutoff` grey levels, from a histogram of changes."""
    over = F.aggregate(F.slice("hist", cutoff + 1, F.size("hist")), F.lit(0).cast("long"), lambda a, x: a + x)
    every = F.aggregate("hist", F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("motion", F.try_divide(over, every) * 100)


def tail_level(df: DataFrame, share: float) -> DataFrame:
    """Adds `level`: the grey level that only `share` of the pixels reach, linear within a level."""
    total = F.aggregate("hist", F.lit(0.0), lambda a, x: a + x)
    zero = F.struct(F.lit(0.0).alias("cum"), F.lit(0).alias("i"), F.lit(None).cast("double").alias("level"))

    def step(a: Column, x: Column) -> Column:
        want = total * (1 - share)
        found = F.when(a["level"].isNull() & (a["cum"] + x >= want) & (x > 0), a["i"] + (want - a["cum"]) / x).otherwise(a["level"])
        return F.struct((a["cum"] + x).alias("cum"), (a["i"] + 1).alias("i"), found.alias("level"))

    return df.withColumn("level", F.aggregate("hist", zero, step, lambda a: a["level"]))


def auto_cutoff(df: DataFrame, share: float = 1e-4, cap_share: float = 1e-3) -> DataFrame:
    """By session: twice the 75th percentile of the tail level, capped by 1.6 x that of a wider tail, within 3 to 40."""
    rows = tail_level(df, share).withColumnRenamed("level", "a")
    rows = tail_level(rows, cap_share).withColumnRenamed("level", "b")
    sums = rows.groupBy("session").agg(F.percentile("a", F.lit(0.75)).alias("a"), F.percentile("b", F.lit(0.75)).alias("b"))
    level = F.least(F.col("a"), 1.6 * F.col("b"))
    return sums.select("session", level.alias("level"), F.greatest(F.least(F.bround(2 * level), F.lit(40.0)), F.lit(3.0)).cast("long").alias("cutoff"))


def states(df: DataFrame, threshold: float, blip_frames: int, min_frames: int) -> DataFrame:
    """Adds `freezing` to (session, frame, motion, usable).

    Below the threshold counts; unusable frames copy the last usable one, at the start the first; runs above within the
    session of at most blip_frames are filled; then runs of min_frames or more stay.
    """
    w = ordered(KEY, "frame")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    raw = F.when(F.col("usable"), F.col("motion") < threshold)
    rows = df.withColumn("below", F.coalesce(F.last(raw, ignorenulls=True).over(back), F.first(raw, ignorenulls=True).over(ahead), F.lit(False)))
    rows = with_runs(rows, KEY, "frame", "below")
    size, last = F.count("*").over(Window.partitionBy("session", "run")), F.max("run").over(Window.partitionBy("session"))
    rows = rows.withColumns({"__n": size, "__last": last})
    blip = ~F.col("below") & (F.col("__n") <= blip_frames) & (F.col("run") > 1) & (F.col("run") < F.col("__last"))
    rows = with_runs(rows.withColumn("filled", F.col("below") | blip).drop("run"), KEY, "frame", "filled")
    rows = rows.withColumn("__n", F.count("*").over(Window.partitionBy("session", "run")))
    return rows.withColumn("freezing", F.col("filled") & (F.col("__n") >= min_frames)).drop("__n", "__last", "run", "below", "filled")


def bouts(df: DataFrame, fps: float) -> DataFrame:
    """(session, start, end, duration) of runs of freezing."""
    rows = with_runs(df, KEY, "frame", "freezing").filter("freezing").groupBy("session", "run").agg((F.min("frame") / fps).alias("start"), ((F.max("frame") + 1) / fps).alias("end"))
    return rows.select("session", "start", "end", (F.col("end") - F.col("start")).alias("duration"))


def periods(df: DataFrame, epochs: DataFrame, fps: float) -> DataFrame:
    """By session and epoch [start, end): share of freezing, seconds, bouts cut at the epoch's edges, mean motion.

    Epochs are a short list and may overlap.
    """
    t = F.col("frame") / fps
    rows = df.join(F.broadcast(epochs), (t >= F.col("start")) & (t < F.col("end")))
    w = Window.partitionBy("session", "epoch").orderBy("frame")
    begins = F.col("freezing") & ~F.coalesce(F.lag("freezing").over(w), F.lit(False))
    rows = rows.withColumn("begins", begins)
    return rows.groupBy("session", "epoch").agg(
        (F.avg(F.col("freezing").cast("int")) * 100).alias("percent"), (F.sum(F.col("freezing").cast("int")) / fps).alias("seconds"), F.sum(F.col("begins").cast("int")).alias("bouts"), F.avg("motion").alias("mean_motion")
    )


def epoch_kinds(found: DataFrame) -> DataFrame:
    """Periods of one kind (the name without its number) together: mean, first, last, change and slope over their order."""
    kind = F.coalesce(F.nullif(F.regexp_replace("epoch", r"[\s_\-#]*\d+\s*$", ""), F.lit("")), F.col("epoch"))
    number = F.row_number().over(Window.partitionBy("session", "kind").orderBy("epoch"))
    rows = found.withColumn("kind", kind).withColumn("i", number)
    return rows.groupBy("session", "kind").agg(
        F.count("*").alias("n"), F.avg("percent").alias("mean"), F.stddev_samp("percent").alias("sd"), F.min_by("percent", "i").alias("first"), F.max_by("percent", "i").alias("last"),
        (F.max_by("percent", "i") - F.min_by("percent", "i")).alias("change"), F.regr_slope("percent", "i").alias("slope"),
    )


def probability_bouts(df: DataFrame, smooth_frames: int, gap_frames: int, min_frames: int, level: float = 0.5) -> DataFrame:
    """(session, first, last) where the smoothed probability p is at least `level`, gaps closed and short runs dropped."""
    w = ordered(KEY, "frame").rowsBetween(-(smooth_frames // 2), smooth_frames - 1 - smooth_frames // 2)
    rows = df.withColumn("motion", -F.avg("p").over(w)).withColumn("usable", F.lit(True))
    found = states(rows.withColumn("motion", F.when(-F.col("motion") >= level, F.lit(0.0)).otherwise(1.0)), 0.5, gap_frames, min_frames)
    return with_runs(found, KEY, "frame", "freezing").filter("freezing").groupBy("session", "run").agg(F.min("frame").alias("first"), F.max("frame").alias("last")).drop("run")


def quality_checks(df: DataFrame, threshold: float, fps: float, min_rows: int = 30) -> DataFrame:
    """(session, level, code, value): what could make a session's freezing wrong; sessions without findings have no row.

    df: session, frame, motion, usable, and where known found (the animal is seen), still (no pixel changed) and
    light_change; missing columns are skipped.
    """
    share = lambda c: F.avg(F.col(c).cast("double")) * 100
    used = F.when(F.col("usable") & F.col("motion").isNotNull(), F.col("motion"))
    sums = [F.count(used).alias("n"), F.percentile(used, F.lit(0.05)).alias("floor"), F.count("*").alias("frames")]
    has = [c for c in ("found", "still", "light_change") if c in df.columns]
    s = df.groupBy("session").agg(*sums, *(share(c).alias(c) for c in has))
    seconds = F.col("light_change") / 100 * F.col("frames") / fps if "light_change" in has else F.lit(0.0)
    finding = lambda when, level, code, value: F.when(when, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), value.alias("value")))
    rules = [finding((F.col("n") >= min_rows) & (F.col("floor") >= threshold), "warn", "noise", F.col("floor"))]
    if "found" in has:
        rules += [finding(F.col("found") < 60, "error", "found", F.col("found")), finding(F.col("found").between(60, 90) & (F.col("found") < 90), "warn", "found", F.col("found"))]
    if "still" in has:
        rules += [finding(F.col("still") > 90, "error", "static", F.col("still")), finding((F.col("still") > 30) & (F.col("still") <= 90), "warn", "static", F.col("still"))]
    if "light_change" in has:
        rules += [finding(F.col("light_change") > 10, "warn", "light", seconds), finding((F.col("light_change") <= 10) & (seconds >= 0.1), "info", "light", seconds)]
    return s.select("session", F.explode(F.array_compact(F.array(*rules))).alias("found")).select("session", "found.*")


def lights_trim(df: DataFrame, fps: float, lag: int = 0, low: float = 0.55, high: float = 1.8, least_s: float = 1.0) -> DataFrame:
    """(session, first, last): what stays of (session, frame, bright) without dark or over-bright runs at the two ends.

    A run is cut off if it has at least least_s seconds (two frames) of odd brightness, with `lag` frames more; null
    brightness prolongs a run. A session with a median of at most 1, or of which too little would stay, stays whole.
    """
    need = max(2, round(least_s * fps))
    middle = df.groupBy("session").agg(F.percentile("bright", F.lit(0.5)).alias("median"))
    good = F.coalesce(F.col("bright").between(low * F.col("median"), high * F.col("median")), F.lit(False))
    rows = df.join(middle, "session").select("session", "frame", "median", good.alias("good"), (~good & F.col("bright").isNotNull()).alias("odd"))
    every = Window.partitionBy("session")
    edges = rows.withColumns({"g": F.min(F.when(F.col("good"), F.col("frame"))).over(every), "h": F.max(F.when(F.col("good"), F.col("frame"))).over(every)})
    count = lambda when: F.count(F.when(F.col("odd") & when, 1))
    s = edges.groupBy("session").agg(
        F.first("median").alias("median"), F.first("g").alias("g"), F.first("h").alias("h"), F.min("frame").alias("a"), F.max("frame").alias("z"),
        count(F.col("frame") < F.col("g")).alias("before"), count(F.col("frame") > F.col("h")).alias("after"),
    )
    first = F.when(F.col("before") >= need, F.col("g") + lag).otherwise(F.col("a"))
    last = F.when(F.col("after") >= need, F.greatest(F.col("h") - lag, first - 1)).otherwise(F.col("z"))
    keeps = (F.col("median") > 1) & F.col("g").isNotNull() & (last - first + 1 >= max(2, lag + 2))
    return s.select("session", F.when(keeps, first).otherwise(F.col("a")).alias("first"), F.when(keeps, last).otherwise(F.col("z")).alias("last"))
