"""Scored behaviours: clipping to a window, budgets, bins, transitions and markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_order():
    return Window.partitionBy("session").orderBy("start", "seq")


def clip(events: DataFrame, t0: float, t1: float, close_open_at: float | None = None) -> DataFrame:
    """States cut to [t0, t1], open ones closed at close_open_at or left out; points kept if t0 <= start <= t1."""
    state = F.col("kind") == "state"
    stop = F.coalesce("stop", F.lit(close_open_at).cast("double"))
    rows = events.withColumn("stop", F.when(state, stop))
    kept = (state & F.col("stop").isNotNull() & (F.col("stop") > t0) & (F.col("start") < t1)) | (~state & F.col("start").between(t0, t1))
    cut = rows.filter(kept)
    return cut.withColumns({"start": F.when(state, F.greatest("start", F.lit(t0))).otherwise(F.col("start")), "stop": F.when(state, F.least("stop", F.lit(t1)))})


def unpaired(events: DataFrame) -> DataFrame:
    return events.filter("kind = 'state' AND stop IS NULL")


def budget(events: DataFrame, inventory: DataFrame, t0: float, t1: float) -> DataFrame:
    """For each session and behaviour of the inventory: number, seconds, share, gaps between, latency, rate; zeros kept."""
    w = Window.partitionBy("session", "behaviour").orderBy("start", "seq")
    rows = events.withColumn("gap", F.lead("start").over(w) - F.coalesce("stop", "start")).withColumn("length", F.col("stop") - F.col("start"))
    sums = rows.groupBy("session", "behaviour").agg(
        F.count("*").alias("n"), F.sum("length").alias("total_s"), F.avg("length").alias("mean_s"), F.stddev_samp("length").alias("sd_s"), F.min("length").alias("min_s"), F.max("length").alias("max_s"),
        F.avg("gap").alias("mean_gap_s"), (F.min("start") - t0).alias("latency_s"),
    )
    every = events.select("session").distinct().join(F.broadcast(inventory.select("behaviour")))  # the inventory is a short list
    out = every.join(sums, ["session", "behaviour"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumns({"percent": F.coalesce("total_s", F.lit(0.0)) / (t1 - t0) * 100, "rate_per_min": F.col("n") / ((t1 - t0) / 60)})


def budget_bins(events: DataFrame, t0: float, t1: float, width: float) -> DataFrame:
    """By bin: occurrences that start in it (the last bin closed at its end), and seconds of states inside it."""
    last = int(-(-(t1 - t0) // width)) - 1
    of = lambda c: F.least(F.floor((c - t0) / width), F.lit(last)).cast("long")
    end = F.coalesce("stop", "start")
    spread = events.withColumn("first", of(F.col("start"))).withColumn("bin", F.explode(F.sequence(of(F.col("start")), F.greatest(of(end), of(F.col("start"))))))
    a = t0 + F.col("bin") * width
    inside = F.greatest(F.least(end, a + width) - F.greatest("start", a), F.lit(0.0))
    return spread.groupBy("session", "behaviour", "bin").agg(F.count(F.when(F.col("bin") == F.col("first"), 1)).alias("n"), F.sum(inside).alias("seconds"))


def next_behaviour(events: DataFrame) -> DataFrame:
    """(behaviour, following, n, probability) over all sessions; probabilities by row."""
    pairs = events.withColumn("following", F.lead("behaviour").over(in_order())).filter("following IS NOT NULL")
    counts = pairs.groupBy("behaviour", "following").agg(F.count("*").alias("n"))
    return counts.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy("behaviour")))


def transition_matrix(events: DataFrame, inventory: DataFrame) -> DataFrame:
    """All pairs of the inventory's behaviours with their counts, zeros kept; rows without any move have no probability."""
    names = inventory.select("behaviour")
    every = names.join(F.broadcast(names.withColumnRenamed("behaviour", "following")))  # both sides are the short inventory
    out = every.join(next_behaviour(events).select("behaviour", "following", "n"), ["behaviour", "following"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("probability", F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy("behaviour"))))


def pair_markers(markers: DataFrame) -> DataFrame:
    """START and STOP rows (session, seq, behaviour, status, time) to bouts: a STOP closes the latest START; others drop."""
    w = Window.partitionBy("session", "behaviour").orderBy("time", "seq")
    rows = markers.withColumns({"after": F.lead("status").over(w), "stop": F.lead("time").over(w)})
    return rows.filter("status = 'START' AND after = 'STOP'").select("session", "behaviour", F.col("time").alias("start"), "stop")


def tone_protocol(epochs: DataFrame) -> DataFrame:
    """(name, start, end) of epochs to a protocol with the time before the first and between neighbours."""
    w = Window.orderBy("start")  # a protocol is a short list
    rows = epochs.withColumn("before", F.lag("end").over(w)).withColumn("i", F.row_number().over(w))
    gaps = rows.filter(F.coalesce("before", F.lit(0.0)) < F.col("start"))
    gaps = gaps.select(F.when(F.col("i") == 1, "Baseline").otherwise(F.concat(F.lit("ITI "), (F.col("i") - 1).cast("string"))).alias("name"), F.coalesce("before", F.lit(0.0)).alias("start"), F.col("start").alias("end"))
    return rows.select("name", "start", "end").unionByName(gaps)
