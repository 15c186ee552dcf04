"""Behavioural tests: entries by the whole body or by the centre, and the measures of each kind of test.

What a zone is (hub, open arm, light side) follows from its name. Entries of arms are told by the body's shares where
there are any, else by the centre of the body. All functions take many sessions at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vivarium.operators.runs import ordered, run_table
from vivarium.operators.zones import alternation, entries_by_candidate, present, zone_visits

ENTRY_SHARE = 0.8
HUB = "__HUB__"
#: Words in the names of zones that tell what they are.
HUBS = ("center", "centre", "hub", "middle")
OPEN, CLOSED = ("open",), ("closed", "close")
LIGHT, DARK = ("light", "bright", "white"), ("dark", "black")
GOAL, NO_GOAL = ("goal", "left", "right"), ("stem", "start")
OBJECTS, NOVEL, FAMILIAR = ("object", "novel", "familiar", "obj"), ("novel", "new"), ("familiar", "old")
SOCIAL, EMPTY = ("social", "stranger", "mouse", "novel"), ("object", "empty", "cup")


def named(names: Sequence[str], *words: str) -> list[str]:
    """Those of the names that hold one of the words, in any case."""
    return [n for n in names if any(w in n.lower() for w in words)]


def is_named(name: Column, *words: str) -> Column:
    """The same of a column of names."""
    return F.coalesce(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(name), w)), F.lit(False))


def classify_test(key: str | None, names: Sequence[str]) -> str:
    """The given kind of test, else what the zones' names say."""
    if key:
        return key
    for kind, a, b in (("epm", OPEN, CLOSED[:1]), ("light_dark", LIGHT[:1], DARK[:1])):
        if named(names, *a) and named(names, *b):
            return kind
    return "custom"


# --- entries by the whole body --------------------------------------------------------------------------------------


def body_candidates(shares: DataFrame, least: float = ENTRY_SHARE) -> DataFrame:
    """(session, frame, time_s, candidate) from (session, frame, time_s, place, zone, share): the zone that holds most of
    the body if it holds `least` of it, the earlier one of equals; unknown shares hold nothing."""
    share = F.coalesce(F.nanvl(F.col("share"), F.lit(-1.0)), F.lit(-1.0))
    best = F.max(F.struct(share.alias("share"), (-F.col("place")).alias("place"), "zone"))
    rows = shares.groupBy("session", "frame").agg(F.first("time_s").alias("time_s"), best.alias("best"))
    return rows.select("session", "frame", "time_s", F.when(F.col("best.share") >= least - 1e-9, F.col("best.zone")).alias("candidate"))


def body_entries(shares: DataFrame, min_frames: int = 3, least: float = ENTRY_SHARE) -> DataFrame:
    """(session, zone, time_s): the body enters a zone with min_frames frames in it, frames without any zone not counted."""
    return entries_by_candidate(body_candidates(shares, least), min_frames)


def body_labels(shares: DataFrame, min_frames: int = 3, least: float = ENTRY_SHARE) -> DataFrame:
    """(session, frame, label): the zone entered last, from the first frame of the entry on; 'None' before the first."""
    entered = body_entries(shares, min_frames, least).select("session", "time_s", F.col("zone").alias("entered"))
    frames = shares.select("session", "frame", "time_s").distinct().join(entered, ["session", "time_s"], "left")
    back = ordered(["session"], "frame").rowsBetween(Window.unboundedPreceding, 0)
    return frames.select("session", "frame", F.coalesce(F.last("entered", ignorenulls=True).over(back), F.lit("None")).alias("label"))


def two_part_entries(shares: DataFrame | None, flags: DataFrame, part_a: Sequence[str], min_frames: int, fps: float) -> DataFrame:
    """(session, a, b): entries of the zones of part_a, taken as one, and of all others, taken as one.

    By the body's shares, summed by part and at most 1; without shares by visits of the centre.
    """
    part = F.when(F.col("zone").isin(*part_a), "a").otherwise("b").alias("zone")
    if shares is not None:
        summed = shares.groupBy("session", "frame", part).agg(F.first("time_s").alias("time_s"), F.when(F.count("share") > 0, F.greatest(F.least(F.sum("share"), F.lit(1.0)), F.lit(0.0))).alias("share"))
        found = body_entries(summed.withColumn("place", F.when(F.col("zone") == "a", 0).otherwise(1)), min_frames)
    else:
        either = F.coalesce(F.bool_or("inside"), F.lit(False)).alias("inside")
        found = zone_visits(flags.groupBy("session", "frame", part).agg(F.first("time_s").alias("time_s"), F.first("status").alias("status"), either), min_frames, fps)
    of = lambda p: F.count(F.when(F.col("zone") == p, 1)).alias(p)
    counts = found.groupBy("session").agg(of("a"), of("b"))
    every = flags.select("session").distinct().join(counts, "session", "left")
    return every.select("session", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("a", "b")))


# --- entries by the centre ------------------------------------------------------------------------------------------


def arm_sequence(flags: DataFrame, arms: Sequence[str], hubs: Sequence[str], min_frames: int = 3) -> DataFrame:
    """(session, time_s, zone) of arm entries by the centre of the body, in order.

    A frame is in its first arm, else in a hub; without hub zones all that is no arm is the hub. A frame outside both, or
    without the animal, breaks a run. A run of min_frames counts, and the same arm again only after the hub or another arm.
    """
    inside = F.coalesce("inside", F.lit(False))
    arm = F.min(F.when(inside & F.col("zone").isin(*arms), F.struct("place", "zone")))["zone"]
    hub = F.when(F.bool_or(inside & F.col("zone").isin(*hubs)), HUB) if hubs else F.lit(HUB)
    rows = flags.groupBy("session", "frame").agg(F.first("time_s").alias("time_s"), F.first("status").alias("status"), F.coalesce(arm, hub).alias("label"))
    rows = rows.withColumn("label", F.when(present(), F.col("label")))
    found = run_table(rows, ["session"], "frame", "label").filter(F.col("label").isNotNull() & (F.col("n") >= min_frames))
    found = found.withColumn("was", F.lag("label").over(ordered(["session"], "run")))
    return found.filter((~F.col("label").eqNullSafe(F.col("was"))) & (F.col("label") != HUB)).select("session", F.col("t_first").alias("time_s"), F.col("label").alias("zone"))


def arm_entries(flags: DataFrame, shares: DataFrame | None, arms: Sequence[str], hubs: Sequence[str], min_frames: int = 3) -> DataFrame:
    """Arm entries by the whole body where its shares are known, else by the centre."""
    if shares is None:
        return arm_sequence(flags, arms, hubs, min_frames)
    held = shares.filter(F.col("zone").isin(*arms, *hubs))
    return body_entries(held, min_frames).filter(F.col("zone").isin(*arms)).select("session", "time_s", "zone")


# --- measures of the tests ------------------------------------------------------------------------------------------


def _sum(names: Sequence[str], column: str, zero: Column | None = None) -> Column:
    held = F.when(F.col("zone").isin(*names), F.col(column)) if names else F.lit(None).cast("double")
    return F.coalesce(F.sum(held), F.lit(0) if zero is None else zero)


def _index(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def anxiety(time: Column, total_time: Column, entries: Column, all_entries: Column) -> Column:
    """1 less the mean share of time and of entries; null where either total is 0."""
    return 1 - (F.try_divide(time, total_time) + F.try_divide(entries, all_entries)) / 2


def first_entry(entries: DataFrame, names: Sequence[str]) -> Column:
    return F.min(F.when(F.col("zone").isin(*names), F.col("time_s")))


def light_dark(table: DataFrame, entries: DataFrame, totals: DataFrame, start: float = 0.0) -> DataFrame:
    """Light and dark time, changes of side along the entries, where it began and when it first went to each side.

    table: zones.zone_table; entries: (session, time_s, zone); totals: (session, total_s) of all frames.
    """
    names = [r.zone for r in table.select("zone").distinct().collect()]  # the arena's zones
    light, dark = named(names, *LIGHT), named(names, *DARK)
    sums = table.groupBy("session").agg(*(_sum(z, c).alias(f"{p}_{k}") for p, z in (("light", light), ("dark", dark)) for k, c in (("s", "time_s"), ("entries", "entries"))))
    side = F.when(F.col("zone").isin(*light), "Light").otherwise("Dark")
    rows = entries.withColumn("side", side).withColumn("was", F.lag("side").over(ordered(["session"], "time_s")))
    of = rows.groupBy("session").agg(
        F.count(F.when(F.col("side") != F.col("was"), 1)).alias("transitions"), F.min_by("side", "time_s").alias("start_side"),
        (first_entry(rows, dark) - start).alias("to_dark"), (first_entry(rows, light) - start).alias("to_light"),
    )
    joined = sums.join(of, "session", "left").join(totals, "session")
    latency = lambda side, c: F.when(F.col("start_side") == side, F.lit(0.0)).otherwise(F.col(c))
    both = F.col("light_entries") + F.col("dark_entries")
    return joined.select(
        "session", "light_s", "dark_s", (100 * F.try_divide("light_s", F.col("light_s") + F.col("dark_s"))).alias("light_percent"), F.coalesce("transitions", F.lit(0)).alias("transitions"),
        "light_entries", "dark_entries", "start_side", latency("Dark", "to_dark").alias("latency_to_dark_s"), latency("Light", "to_light").alias("latency_to_light_s"),
        anxiety(F.col("light_s"), F.col("total_s"), F.col("light_entries"), both).alias("anxiety"),
    )


def open_field(table: DataFrame, parts: DataFrame, totals: DataFrame) -> DataFrame:
    """Centre and periphery: time, entries, distance, first entry and the anxiety index.

    parts: two_part_entries of the centre; totals: (session, total_s, present_s, distance) with the distance of Tracked frames.
    """
    hub = is_named(F.col("zone"), *HUBS)  # by name, row by row: the table is worked out once
    of = lambda rows, column: F.coalesce(F.sum(F.when(rows, F.col(column))), F.lit(0)).alias
    sums = table.groupBy("session").agg(
        of(hub, "time_s")("centre_s"), of(hub, "entries")("centre_entries"), of(~hub, "time_s")("periphery_s"), of(hub, "distance")("centre_distance"),
        F.min(F.when(hub, F.col("latency_s"))).alias("latency_to_centre_s"),
    )
    joined = sums.join(parts, "session").join(totals, "session")
    return joined.select(
        "session", "centre_s", (100 * F.try_divide("centre_s", "present_s")).alias("centre_percent"), "centre_entries", "periphery_s", F.col("b").alias("periphery_entries"), "centre_distance",
        (100 * F.try_divide("centre_distance", F.nullif("distance", F.lit(0.0)))).alias("centre_distance_percent"), "latency_to_centre_s", anxiety(F.col("centre_s"), F.col("total_s"), F.col("a"), F.col("a") + F.col("b")).alias("anxiety"),
    )


def social(table: DataFrame) -> DataFrame:
    """Time with another animal and with an object and their index; without such names the first side against the last."""
    listed = table.select("zone", "place").distinct().orderBy("place").collect() if "place" in table.columns else table.select("zone").distinct().orderBy("zone").collect()
    names = [r.zone for r in listed]
    hubs = named(names, *HUBS)
    sides = [n for n in names if n not in hubs]
    with_animal, with_object = named(names, *SOCIAL), named(names, *EMPTY)
    a, b = (with_animal, with_object) if with_animal and with_object else (sides[:1], sides[-1:] if len(sides) > 1 else [])
    sums = table.groupBy("session").agg(_sum(a, "time_s").alias("social_s"), _sum(b, "time_s").alias("object_s"), _sum(hubs, "time_s").alias("centre_s"), _sum(sides, "entries").alias("chamber_entries"))
    return sums.withColumn("sociability", _index(F.col("social_s"), F.col("object_s")))


def t_maze(entries: DataFrame, arms: Sequence[str]) -> DataFrame:
    """Entries of goal arms, changes of goal from one to the next, the first choice, and alternation over all arms."""
    goals = named(arms, *GOAL) or [a for a in arms if a not in named(arms, *NO_GOAL)]
    of_goals = entries.filter(F.col("zone").isin(*goals)).withColumn("was", F.lag("zone").over(ordered(["session"], "time_s")))
    g = of_goals.groupBy("session").agg(F.count("*").alias("goal_entries"), F.count(F.when(F.col("zone") != F.col("was"), 1)).alias("goal_alternations"), F.min_by("zone", "time_s").alias("first_choice"))
    whole = alternation(entries).select("session", "entries", "alternations", F.greatest(F.col("entries") - 2, F.lit(0)).alias("possible"), "percent")
    joined = whole.join(g, "session", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    share = F.when(F.col("goal_entries") > 1, 100 * F.col("goal_alternations") / (F.col("goal_entries") - 1))
    return joined.select("session", "entries", count("goal_entries"), count("goal_alternations"), share.alias("goal_percent"), "first_choice", "alternations", "possible", "percent")


def object_exploration(table: DataFrame) -> DataFrame:
    """Seconds at objects and how much more at the novel one; without such names, the second object against the first."""
    names = [r.zone for r in table.select("zone").distinct().orderBy("zone").collect()]
    objects = named(names, *OBJECTS)
    novel, familiar = named(objects, *NOVEL), named(objects, *FAMILIAR)
    a, b = (novel, familiar) if novel and familiar else (objects[1:2], objects[:1] if len(objects) > 1 else [])
    sums = table.groupBy("session").agg(_sum(objects, "time_s").alias("total_s"), _sum(a, "time_s").alias("a"), _sum(b, "time_s").alias("b"))
    x, y = F.col("a"), F.col("b")
    return sums.select("session", "total_s", _index(x, y).alias("discrimination"), F.try_divide(x, x + y).alias("ratio"), (100 * F.try_divide(x, x + y)).alias("recognition_percent"))


def zone_groups(flags: DataFrame, groups: dict[str, Sequence[str]], fps: float, confirmation: int = 3) -> DataFrame:
    """(session, group, time_s, percent, entries): zones taken together; entries are confirmed changes into the group."""
    from vivarium.operators.zones import moves

    listed = F.array(*(F.struct(F.lit(g).alias("group"), F.array(*map(F.lit, zs)).alias("zones")) for g, zs in groups.items()))
    rows = flags.withColumn("g", F.explode(listed)).filter(F.array_contains("g.zones", F.col("zone")))
    inside = F.coalesce(F.bool_or("inside"), F.lit(False))
    frames = rows.groupBy("session", F.col("g.group").alias("group"), "frame").agg(F.first("time_s").alias("time_s"), F.first("status").alias("status"), inside.alias("inside"))
    sums = frames.groupBy("session", "group").agg(
        (F.count(F.when(present() & F.col("inside"), 1)) / fps).alias("time_s"), (100 * F.try_divide(F.count(F.when(present() & F.col("inside"), 1)), F.count(F.when(present(), 1)))).alias("percent")
    )
    key = F.struct("session", "group").alias("session")
    moved = moves(frames.select(key, "frame", "time_s", "status", F.when(F.col("inside"), "in").otherwise("out").alias("label")), confirmation)
    entered = moved.filter("to_zone = 'in'").groupBy(F.col("session.session").alias("session"), F.col("session.group").alias("group")).agg(F.count("*").alias("entries"))
    return sums.join(entered, ["session", "group"], "left").withColumn("entries", F.coalesce("entries", F.lit(0)))


def flat(df: DataFrame, test: str) -> DataFrame:
    """(session, test, measure, value, text): one measure a row, numbers in value and words in text."""
    kinds = dict(df.dtypes)
    each = [
        F.struct(F.lit(c).alias("measure"), (F.lit(None) if kinds[c] == "string" else F.col(c)).cast("double").alias("value"), (F.col(c) if kinds[c] == "string" else F.lit(None)).cast("string").alias("text"))
        for c in df.columns
        if c != "session"
    ]
    return df.select("session", F.lit(test).alias("test"), F.explode(F.array(*each)).alias("m")).select("session", "test", "m.*")
