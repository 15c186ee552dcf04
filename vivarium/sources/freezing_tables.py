"""Freezing results as tables of a study and of its sessions; Spark writes them as folders of CSV parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vivarium.operators.freezing_result import Result
from vivarium.sources.sinks import freezing_tidy, write_csv

#: Measures of a session's result with their labels, and how they are computed.
MEASURES = (
    ("percent", "Freezing (%)", "frames freezing / frames analysed x 100"),
    ("freezing_s", "Freezing time (s)", "frames freezing / FPS"),
    ("active_s", "Active time (s)", "analysed time - freezing time"),
    ("bouts", "Freezing bouts", "runs of frames freezing"),
    ("mean_bout_s", "Mean bout (s)", "freezing time / bouts"),
    ("median_bout_s", "Median bout (s)", "middle of the bouts' lengths"),
    ("longest_bout_s", "Longest bout (s)", "greatest of the bouts' lengths"),
    ("latency_s", "Latency to the first bout (s)", "start of the first bout - start"),
    ("bouts_per_min", "Bouts per minute", "bouts / (analysed time / 60)"),
    ("mean_gap_s", "Mean time between bouts (s)", "mean of next start - end"),
    ("median_gap_s", "Median time between bouts (s)", "middle of next start - end"),
    ("mean_motion", "Mean motion (%)", "mean of the frames' motion"),
    ("analysed_s", "Analysed time (s)", "frames analysed / FPS"),
    ("start_s", "Analysed from (s)", ""),
    ("end_s", "Analysed to (s)", ""),
)
#: Columns of wide tables, by epoch, kind of epoch and bin.
EPOCH = (("start_s", "start (s)"), ("end_s", "end (s)"), ("percent", "freezing (%)"), ("seconds", "freezing time (s)"), ("bouts", "freezing bouts"), ("mean_motion", "mean motion (%)"), ("before_percent", "freezing before (%)"), ("change", "change (%)"), ("suppression", "suppression ratio"))
KIND = (("n", "trials"), ("mean", "mean freezing (%)"), ("first", "first (%)"), ("last", "last (%)"), ("change", "change, last - first (%)"), ("slope", "slope by trial (%)"))
#: A wide table has at most so many names of epochs, kinds or bins; more is refused.
MOST_NAMES = 200


def names_of(df: DataFrame, name: str, *order: str) -> list:
    """The distinct values of a column, by the least of `order` that they have."""
    found = df.groupBy(name).agg(*(F.min(c).alias(f"o{i}") for i, c in enumerate(order))).orderBy(*(f"o{i}" for i in range(len(order))), name).limit(MOST_NAMES + 1).collect()
    if len(found) > MOST_NAMES:
        raise ValueError(f"over {MOST_NAMES} names in {name}")
    return [r[name] for r in found]


def wide(df: DataFrame, name: str, names: list, columns, label) -> DataFrame:
    """A row per session with a column for each name and measure; what a session lacks is null."""
    each = [F.max(F.when(F.col(name) == n, F.col(c))).alias(label(n, text)) for n in names for c, text in columns if c in df.columns]
    return df.groupBy("session").agg(*each)


def study_tables(result: Result, info: DataFrame | None = None) -> dict[str, DataFrame]:
    """Wide tables of a study, a row per session: summary, epochs, kinds and bins; and tidy, a row for each measure.

    info: (session, ...) columns that stand before the measures (Subject, Group); sessions without results have no row.
    The summary has each epoch's share of freezing, and the mean of kinds of several epochs, beside a session's own measures.
    """
    shown = [(c, text) for c, text, _ in MEASURES]
    summary = result.summary.select("session", *(F.col(c).alias(text) for c, text in shown if c in result.summary.columns))
    epochs = names_of(result.epochs, "epoch", "start_s")
    kinds = names_of(result.kinds.join(result.epochs.groupBy("session").agg(F.min("start_s").alias("__s")), "session"), "kind", "__s")
    label = lambda n, text: f"{n} – {text}"
    tables = {}
    if epochs:
        tables["epochs"] = wide(result.epochs, "epoch", epochs, EPOCH, label)
        several = [r["kind"] for r in result.kinds.filter("n > 1").select("kind").distinct().collect()]  # some of `kinds`
        means = wide(result.kinds, "kind", [k for k in kinds if k in several], (("mean", "mean freezing (%)"),), label)
        summary = summary.join(means, "session", "left").join(wide(result.epochs, "epoch", epochs, (("percent", "freezing (%)"),), label), "session", "left")
        tables["kinds"] = wide(result.kinds, "kind", kinds, KIND, label)
    numbered = names_of(result.bins, "bin", "start_s")
    if numbered:
        ends = {r["bin"]: (r["a"], r["b"]) for r in result.bins.groupBy("bin").agg(F.min("start_s").alias("a"), F.max("end_s").alias("b")).collect()}  # as many as numbered
        tables["bins"] = wide(result.bins, "bin", numbered, (("percent", ""),), lambda n, _: f"Bin {n} ({ends[n][0]:g}–{ends[n][1]:g} s) – freezing (%)")
    tables = {"summary": summary} | tables
    tables["checks"] = result.checks
    tables["tidy"] = freezing_tidy(result.summary, result.epochs, result.bins)
    return {name: t if info is None else info.join(t, "session") for name, t in tables.items()}


def session_tables(result: Result, fps: float) -> dict[str, DataFrame]:
    """Long tables of each session: results with their formulas, epochs, kinds, bins, bouts by number, and frames."""
    each = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(text).alias("measure"), F.col(c).cast("double").alias("value"), F.lit(how).alias("formula")) for i, (c, text, how) in enumerate(MEASURES) if c in result.summary.columns))
    results = result.summary.select("session", F.explode(each).alias("m")).select("session", "m.*")
    number = F.row_number().over(Window.partitionBy("session").orderBy("start"))
    bouts = result.bouts.withColumn("bout", number).select("session", "bout", *(F.round(c, 4).alias(c) for c in ("start", "end", "duration")))
    frames = result.frames.select("session", "frame", F.round(F.col("frame") / fps, 4).alias("time_s"), F.round("motion", 4).alias("motion"), F.col("freezing").cast("int").alias("freezing"))
    return {"results": results, "epochs": result.epochs, "kinds": result.kinds, "bins": result.bins, "bouts": bouts, "frames": frames}


def write_study(result: Result, folder: str, info: DataFrame | None = None) -> list[str]:
    return [write_csv(t, f"{folder}/{name}") for name, t in study_tables(result, info).items()]


def write_sessions(result: Result, folder: str, fps: float) -> list[str]:
    """Each table below the folder, parted by session, so that a session's files lie together."""
    out = []
    for name, t in session_tables(result, fps).items():
        t.write.mode("overwrite").partitionBy("session").option("header", True).csv(f"{folder}/{name}")
        out.append(f"{folder}/{name}")
    return out
