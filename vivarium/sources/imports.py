"""Readers of other programs' files: scored events, event times, and body points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vivarium.operators.events import pair_markers
from vivarium.operators.runs import with_runs

#: Names of columns and of body points, the preferred first.
TIME, BEHAVIOUR, STATUS = ("time",), ("behavior", "behaviour"), ("status", "behavior type")
NAME, START, STOP, DURATION = ("name", "label", "event", "class"), ("start (s)", "start", "onset", "begin"), ("stop (s)", "stop", "end", "offset"), ("duration (s)", "duration", "length")
CENTRE = ("centre", "center", "body", "bodycenter", "body_center", "centroid", "spine", "spine2", "mid", "midbody", "back", "torso", "thorax")
TAIL = ("tailbase", "tail_base", "tail base", "tail1", "tail_1", "tailroot", "tail_root", "base_of_tail")
NOSE = ("nose", "snout", "head", "nosetip", "nose_tip")
SLEAP_KEYS = ("frame_idx", "track")
#: A skeleton has at most so many parts.
MOST_PARTS = 200
NOT_TRUNK = ("tail_", "tailtip", "tail_end", "tail2", "tail3", "tail4")


def number(c: Column | str) -> Column:
    """A number with a decimal point or comma, else null."""
    text = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.regexp_replace(text, ",", ".").try_cast("double")


def separator(line: str) -> str:
    if line.count("\t") > line.count(","):
        return "\t"
    return ";" if line.count(";") > line.count(",") else ","


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A text table with a header; tabs, commas or semicolons by what its first lines (4 KB) have most of."""
    lines = [r[0] for r in spark.read.text(path).take(64)]
    if not lines:
        raise ValueError("the file is empty")
    return spark.read.option("header", True).option("sep", separator("\n".join(lines)[:4096])).csv(path)


def best_match(found: list[str], wanted: tuple[str, ...], loosely) -> str | None:
    """Of the found names the one that fits best: one that is a wanted name before one that only loosely(name, wanted) fits,
    then that of the earlier wanted name, then the earlier one."""
    plain = [n.strip().lower().replace(" ", "_") for n in found]
    keys = [w.replace(" ", "_") for w in wanted]
    fits = [(n != w, i, j) for i, w in enumerate(keys) for j, n in enumerate(plain) if n == w or loosely(n, w)]
    return found[min(fits)[2]] if fits else None


def column(df: DataFrame, names: tuple[str, ...]) -> str | None:
    """The column with one of the names in any case, else one that begins with one."""
    return best_match(df.columns, names, str.startswith)


def as_events(df: DataFrame) -> DataFrame:
    return df.select("session", "behaviour", "kind", F.round("start", 4).alias("start"), F.round("stop", 4).alias("stop"))


def flag_events(df: DataFrame, behaviours: list[str], fps: float, offset: float = 0.0) -> DataFrame:
    """State events from one 0/1 column for each behaviour, by session and frame: runs above 0.5; null is 0."""
    long = df.select("session", "frame", *(F.coalesce(F.col(f"`{b}`").cast("double"), F.lit(0.0)).alias(b) for b in behaviours))
    long = long.unpivot(["session", "frame"], behaviours, "behaviour", "value")
    runs = with_runs(long, ["session", "behaviour"], "frame", F.col("value") > 0.5).filter("value > 0.5")
    spans = runs.groupBy("session", "behaviour", "run").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    return as_events(spans.select("session", "behaviour", F.lit("state").alias("kind"), (F.col("first") / fps + offset).alias("start"), ((F.col("last") + 1) / fps + offset).alias("stop")))


def marker_events(df: DataFrame, offset: float = 0.0) -> DataFrame:
    """Events from START, STOP and POINT rows (session, seq, behaviour, status, time)."""
    rows = df.withColumns({"status": F.upper(F.trim("status")), "time": F.col("time") + offset})
    states = pair_markers(rows.filter("status IN ('START', 'STOP')")).withColumn("kind", F.lit("state"))
    points = rows.filter("status = 'POINT'").select("session", "behaviour", F.col("time").alias("start"), F.lit(None).cast("double").alias("stop"), F.lit("point").alias("kind"))
    return as_events(states.unionByName(points))


def span_events(df: DataFrame, offset: float = 0.0) -> DataFrame:
    """Events from (session, behaviour, start, stop): a state if it stops after its start, else a point."""
    rows = df.filter("start IS NOT NULL AND NOT isnan(start)")
    lasts = F.coalesce((F.col("stop") > F.col("start")) & ~F.isnan("stop"), F.lit(False))
    kind = F.when(lasts, "state").otherwise("point")
    return as_events(rows.select("session", "behaviour", kind.alias("kind"), (F.col("start") + offset).alias("start"), F.when(lasts, F.col("stop") + offset).alias("stop")))


def read_events(spark: SparkSession, path: str, session: str, fps: float = 30.0, offset: float = 0.0) -> DataFrame:
    """Events of one file: a frame table with Probability_ columns, START / STOP rows, or a table of starts and stops."""
    df = read_table(spark, path)
    scored = [c[len("Probability_") :] for c in df.columns if c.startswith("Probability_")]
    scored = [b for b in scored if b in df.columns]
    if scored:
        frame = column(df, ("frame", "frames", "unnamed: 0")) or df.columns[0]
        rows = df.select(F.lit(session).alias("session"), number(f"`{frame}`").cast("long").alias("frame"), *(number(f"`{b}`").alias(b) for b in scored))
        return flag_events(rows, scored, fps, offset)
    time, behaviour, status = column(df, TIME), column(df, BEHAVIOUR), column(df, STATUS)
    if time and behaviour and status:
        rows = df.select(F.lit(session).alias("session"), F.monotonically_increasing_id().alias("seq"), F.col(f"`{behaviour}`").alias("behaviour"), F.col(f"`{status}`").alias("status"), number(f"`{time}`").alias("time"))
        return marker_events(rows, offset)
    name, start, stop, length = behaviour or column(df, NAME), column(df, START), column(df, STOP), column(df, DURATION)
    if name and start and (stop or length):
        end = number(f"`{stop}`") if stop else number(f"`{start}`") + number(f"`{length}`")
        return span_events(df.select(F.lit(session).alias("session"), F.col(f"`{name}`").alias("behaviour"), number(f"`{start}`").alias("start"), end.alias("stop")), offset)
    raise ValueError("no events: expected Probability_ columns, Time / Behavior / Status, or behaviour with start and stop")


def epochs_from_times(times: DataFrame, length: float, name: str = "Tone", offset: float = 0.0, scale: float = 1.0) -> DataFrame:
    """(session, name, start, end): every time an epoch of so many seconds, numbered by session in order."""
    i = F.row_number().over(Window.partitionBy("session").orderBy("time"))
    at = offset + F.col("time") * scale
    return times.select("session", F.concat(F.lit(f"{name} "), i.cast("string")).alias("name"), F.round(at, 4).alias("start"), F.round(at + length, 4).alias("end"))


def shift_epochs(epochs: DataFrame, offset: float = 0.0, scale: float = 1.0) -> DataFrame:
    """Epochs on another clock."""
    return epochs.withColumns({c: F.round(offset + F.col(c) * scale, 4) for c in ("start", "end")})


def read_epochs(spark: SparkSession, path: str, session: str, length: float = 10.0) -> DataFrame:
    """(session, seq, name, start, end): a table of starts with ends or durations, or columns of numbers, each a series of times
    that begin epochs of `length` seconds. Epochs that don't end after their start are left out."""
    df = read_table(spark, path)
    start, stop, lasts, name = column(df, START), column(df, STOP), column(df, DURATION), column(df, NAME)
    who, seq = F.lit(session).alias("session"), F.monotonically_increasing_id().alias("seq")
    if start and (stop or lasts):
        end = number(f"`{stop}`") if stop else number(f"`{start}`") + number(f"`{lasts}`")
        label = F.coalesce(F.col(f"`{name}`"), F.lit("Epoch")) if name else F.lit("Epoch")
        rows = df.select(who, seq, label.alias("name"), number(f"`{start}`").alias("start"), end.alias("end"))
    else:
        series = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), number(f"`{c}`").alias("start")) for c in df.columns)))
        rows = df.select(who, seq, series.alias("s")).select("session", "seq", "s.*").withColumn("end", F.col("start") + length)
    return rows.filter("end > start")


def read_medpc(spark: SparkSession, path: str) -> DataFrame:
    """(file, letter, i, value) of the letter arrays in MED-PC data files, of the first subject of each file.

    A letter with a number on its own line is a scalar; else numbered lines below belong to it.
    """
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    head = F.regexp_extract("text", r"^\s*([A-Z]):", 1)
    heads = lines.withColumn("head", F.when(head != "", head)).withColumn("starts", F.lower(F.trim("text")).startswith("file:"))
    heads = heads.withColumn("seen", F.coalesce(F.max(F.when(F.col("head").isNotNull(), F.col("line"))).over(w), F.lit(-1)))
    heads = heads.withColumn("over", F.max(F.col("starts") & (F.col("seen") >= 0)).over(w)).filter(~F.col("over"))
    numbered = F.col("text").rlike(r"^\s*\d+:")
    body = F.regexp_replace("text", r"^\s*([A-Z]|\d+):\s*", "")
    # other lines (titles, dates) and scalars end an array
    owner = F.last(F.when(F.col("head").isNotNull(), F.when(F.trim(body) == "", F.col("head")).otherwise("")).when(~numbered & (F.trim("text") != ""), F.lit("")), ignorenulls=True).over(w)
    rows = heads.withColumn("letter", F.coalesce("head", F.when(numbered, owner))).filter("letter <> ''")
    words = F.when(F.col("head").isNotNull(), F.slice(F.split(F.trim(body), r"\s+"), 1, 1)).otherwise(F.split(F.trim(body), r"\s+"))
    values = rows.select("file", "letter", "line", F.posexplode(words).alias("place", "word")).withColumn("value", number("word")).filter("value IS NOT NULL")
    i = F.row_number().over(Window.partitionBy("file", "letter").orderBy("line", "place")) - 1
    return values.select("file", "letter", i.cast("long").alias("i"), "value")


# --- body points ----------------------------------------------------------------------------------------------------


def read_pose(spark: SparkSession, path: str) -> DataFrame:
    """(frame, part, x, y, p) of a DeepLabCut table (first individual) or a SLEAP analysis table (first track)."""
    first = spark.read.text(path).first()
    if first is None:
        raise ValueError("the file is empty")
    if first[0].lstrip("﻿").lower().startswith("scorer"):
        df = spark.read.csv(path)
        key = df.columns[0]
        named = {r[0].lstrip("﻿").lower(): list(r)[1:] for r in df.filter(F.lower(F.ltrim(F.col(key), F.lit("﻿"))).isin("scorer", "individuals", "bodyparts", "coords")).limit(4).collect()}
        animals = named.get("individuals", [""] * (len(df.columns) - 1))
        places: dict[str, dict[str, str]] = {}
        for c, animal, part, what in zip(df.columns[1:], animals, named["bodyparts"], named["coords"]):
            if animal == animals[0]:
                places.setdefault(part, {})[what] = c
        rows, frame = df, F.col(key).try_cast("double").cast("long")
        points = {part: (at["x"], at["y"], at.get("likelihood")) for part, at in places.items() if "x" in at and "y" in at}
    else:
        rows = spark.read.option("header", True).csv(path)
        index, owner = (next((c for c in rows.columns if c.lower() == n), None) for n in SLEAP_KEYS)
        split = [(c, *c.rpartition(".")[::2]) for c in rows.columns]
        held = {part: {what: c for c, own, what in split if own == part} for _, part, what in split if what == "x"}
        if index is None or not held:
            raise ValueError("neither a DeepLabCut nor a SLEAP table")
        frame = F.col(index).try_cast("double").cast("long")
        if owner is not None:  # the animal of the first row that names one; a file may name none
            named_first = rows.agg(F.first(owner, ignorenulls=True).alias("t"))
            rows = rows.join(F.broadcast(named_first)).filter(F.col("t").isNull() | (F.col(owner) == F.col("t"))).drop("t")
        points = {part: (c["x"], c.get("y"), c.get("score")) for part, c in held.items() if "y" in c}
    if not points:
        raise ValueError("the file has no body points")
    each = [F.struct(F.lit(part).alias("part"), number(f"`{x}`").alias("x"), number(f"`{y}`").alias("y"), (number(f"`{p}`") if p else F.lit(1.0)).alias("p")) for part, (x, y, p) in points.items()]
    return rows.select(frame.alias("frame"), F.explode(F.array(*each)).alias("at")).filter("frame IS NOT NULL").select("frame", "at.*")


def pick_part(parts: list[str], names: tuple[str, ...]) -> str | None:
    """The part with one of the names, else one that holds one."""
    return best_match(parts, names, str.__contains__)


def pose_positions(points: DataFrame, centre: Column, p_cut: float = 0.6) -> DataFrame:
    """(session, frame, x, y, status): the mean of the points for which `centre` holds and whose p is at least p_cut."""
    good = centre & (F.coalesce(F.nanvl("p", F.lit(0.0)), F.lit(0.0)) >= p_cut) & F.col("x").isNotNull() & F.col("y").isNotNull()
    means = points.groupBy("session", "frame").agg(F.avg(F.when(good, F.col("x"))).alias("x"), F.avg(F.when(good, F.col("y"))).alias("y"))
    return means.withColumn("status", F.when(F.col("x").isNotNull(), "Tracked").otherwise("Lost"))


def centre_parts(parts: list[str]) -> list[str]:
    """The part named as the centre, else all parts of the trunk."""
    named, nose = pick_part(parts, CENTRE), pick_part(parts, NOSE)
    return [named] if named else [p for p in parts if p != nose and not p.strip().lower().replace(" ", "_").startswith(NOT_TRUNK)]


def pose_track(points: DataFrame, fps: float, p_cut: float = 0.6, view: list[float] | None = None, start_s: float = 0.0, end_s: float | None = None) -> DataFrame:
    """(session, frame, time_s, x, y, status, ax, ay, bx, by, tail_ev, shape_ev) from (session, frame, part, x, y, p) of one skeleton.

    The centre is the part named so, else the mean of the trunk's parts; a point counts with p of at least p_cut. Where there
    are a nose and a tail's base, they are the ends a and b of frames that have both, with strong evidence that a is the
    head. view: the nine numbers of `text.homography`, by which places are seen from above. Frames from start_s to end_s, whether
    the animal was found or not. Every part's name comes to the driver: a skeleton has few.
    """
    from vivarium.functions.text import warped

    parts = sorted(r[0] for r in points.select("part").distinct().limit(MOST_PARTS + 1).collect())
    if not parts or len(parts) > MOST_PARTS:
        raise ValueError(f"no body points, or over {MOST_PARTS}")
    centre, nose, tail = centre_parts(parts), pick_part(parts, NOSE), pick_part(parts, TAIL)
    rows = points.filter(F.col("frame") >= round(start_s * fps))
    if end_s is not None:
        rows = rows.filter(F.col("frame") <= round(end_s * fps))
    good = (F.coalesce(F.nanvl("p", F.lit(0.0)), F.lit(0.0)) >= p_cut) & F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    of = lambda names, c: F.avg(F.when(good & F.col("part").isin(*names), F.col(c)))
    groups = {"": centre, "a": [nose], "b": [tail]} if nose and tail else {"": centre}
    means = rows.groupBy("session", "frame").agg(*(of(names, c).alias(side + c) for side, names in groups.items() for c in ("x", "y")))
    for side in groups:
        if view is not None:
            u, v = warped(F.col(f"{side}x"), F.col(f"{side}y"), view)
            means = means.withColumns({f"{side}x": u, f"{side}y": v})
    both = F.col("ax").isNotNull() & F.col("bx").isNotNull() if "a" in groups else F.lit(False)
    ends = [(F.when(both, F.col(c)) if "a" in groups else F.lit(None).cast("double")).alias(c) for c in ("ax", "ay", "bx", "by")]
    status = F.when(F.col("x").isNotNull(), "Tracked").otherwise("Lost").alias("status")
    return means.select("session", "frame", (F.col("frame") / fps).alias("time_s"), "x", "y", status, *ends, F.when(both, F.lit(-1.0)).alias("tail_ev"), F.when(both, F.lit(1.0)).alias("shape_ev"))


def pose_body(track: DataFrame) -> DataFrame:
    """(session, length, area): the middle distance from nose to tail, and the body's area from it; sessions without ends have none."""
    from vivarium.operators.freezing_result import AREA_PER_LENGTH2
    from vivarium.operators.ranks import medians

    long = track.filter("ax IS NOT NULL").select("session", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")).alias("value"))
    return medians(long, ["session"], few=False).select("session", F.col("median").alias("length"), (F.col("median") * F.col("median") * AREA_PER_LENGTH2).alias("area"))
