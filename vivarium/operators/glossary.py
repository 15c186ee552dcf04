"""What measures are called, mean, are computed from, and which sheet of a report they belong to.

Names come as rows, so that a report's wide columns, long measures of a whole archive, or both, are described by joins: with the
zones that the names themselves tell, with a small table of known names, and by rules for families of names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The sheets in order; the fields of a zone's measures with their sheets; and the names of known measures.
SHEETS = ("info", "time", "entries", "distance", "indices", "settings", "other")
FIELDS = (
    ("time_s", "time", "time (s)", "Seconds in the zone, by the centre of the body.", "frames in the zone / FPS"),
    ("percent", "time", "time (%)", "Share of the analysed time in the zone.", "time in the zone / analysed time x 100"),
    ("entries", "entries", "entries", "Times that the animal came in with all paws.", "runs of 3 frames or more with 80 % of the body inside"),
    ("latency_s", "distance", "latency (s)", "Seconds until the animal came in first.", "time of the first entry - start"),
)
KNOWN = (
    ("Video_name", "info", "Video", "The recording.", ""),
    ("Subject", "info", "Subject", "The animal, as named in the design.", ""),
    ("Test_type", "info", "Test", "The test whose measures these are.", ""),
    ("Start_s", "info", "Analysed from (s)", "Beginning of the window.", ""),
    ("End_s", "info", "Analysed to (s)", "End of the window.", ""),
    ("Analysed_time_s", "info", "Analysed time (s)", "Length of the window.", "frames analysed / FPS"),
    ("FPS", "info", "Frames per second", "Frame rate of the recording.", ""),
    ("Frames_processed", "info", "Frames analysed", "Frames within the window.", ""),
    ("Tracking_quality_percent", "info", "Animal seen (%)", "Share of frames with the animal; trust starts at some 95 %.", "frames seen / (frames analysed - frames hidden) x 100"),
    ("Detected_frames", "info", "Frames seen", "Frames in which the animal was found.", ""),
    ("Interpolated_frames", "info", "Gaps filled", "Frames between two places, filled in.", ""),
    ("Tracked_frames", "info", "Frames with a place", "Frames seen or filled in.", ""),
    ("Lost_frames", "info", "Frames lost", "Frames without the animal.", ""),
    ("Held_frames", "info", "Frames held", "Lost frames that keep the last place.", ""),
    ("Held_time_s", "info", "Time held (s)", "Held frames as seconds.", "frames held / FPS"),
    ("Hidden_frames", "info", "Frames hidden", "Frames under the lid of a covered zone.", ""),
    ("Hidden_time_s", "info", "Time hidden (s)", "Hidden frames as seconds.", "frames hidden / FPS"),
    ("Open_arm_time_s", "time", "Open-arm time (s)", "Seconds on open arms.", "sum over open arms"),
    ("Open_arm_time_pct", "time", "Open-arm time (%)", "Share of time on open arms; little of it speaks of anxiety.", "open-arm time / analysed time x 100"),
    ("Open_arm_time_ratio_pct", "time", "Open of arm time (%)", "The same, of the time on any arm.", "open-arm time / (open-arm + closed-arm time) x 100"),
    ("Closed_arm_time_s", "time", "Closed-arm time (s)", "Seconds in closed arms.", "sum over closed arms"),
    ("Center_time_s", "time", "Centre time (s)", "Seconds in the centre.", ""),
    ("Center_time_pct", "time", "Centre time (%)", "Share of time in the centre.", "centre time / analysed time x 100"),
    ("Periphery_time_s", "time", "Periphery time (s)", "Seconds away from the centre.", "analysed time - centre time"),
    ("Light_time_s", "time", "Time in light (s)", "Seconds in the light box.", ""),
    ("Light_time_pct", "time", "Time in light (%)", "Share of time in the light box.", "light time / analysed time x 100"),
    ("Dark_time_s", "time", "Time in dark (s)", "Seconds in the dark box, hidden ones too.", ""),
    ("Total_exploration_s", "time", "Exploration (s)", "Seconds at any object.", "sum over objects"),
    ("Open_arm_entries", "entries", "Open-arm entries", "Entries into open arms.", ""),
    ("Closed_arm_entries", "entries", "Closed-arm entries", "Entries into closed arms: activity.", ""),
    ("Total_arm_entries", "entries", "Arm entries", "Entries into any arm: activity.", ""),
    ("Open_arm_entries_pct", "entries", "Open-arm entries (%)", "Share of entries into open arms.", "open-arm entries / arm entries x 100"),
    ("Light_entries", "entries", "Light-box entries", "Entries into the light box.", ""),
    ("Dark_entries", "entries", "Dark-box entries", "Entries into the dark box.", ""),
    ("Transitions", "entries", "Light-dark transitions", "Crossings between the boxes.", ""),
    ("Alternations", "entries", "Alternations", "Three different arms in a row.", ""),
    ("Possible_alternations", "entries", "Possible alternations", "Triplets of entries.", "arm entries - 2"),
    ("Spontaneous_alternation_pct", "entries", "Spontaneous alternation (%)", "Alternations of those possible: working memory.", "alternations / (arm entries - 2) x 100"),
    ("Same_arm_returns", "entries", "Same-arm returns", "Entries into the arm just left.", ""),
    ("Alternate_arm_returns", "entries", "Alternate-arm returns", "Entries into the arm before that.", ""),
    ("Goal_arm_entries", "entries", "Goal-arm entries", "Entries into goal arms.", ""),
    ("Goal_arm_alternations", "entries", "Goal-arm alternations", "Choices that differ from the one before.", ""),
    ("Goal_arm_alternation_pct", "entries", "Goal-arm alternation (%)", "Share of such choices.", "goal-arm alternations / (goal-arm entries - 1) x 100"),
    ("Chamber_entries", "entries", "Chamber entries", "Entries into side chambers.", ""),
    ("Total_interaction_bouts", "entries", "Object bouts", "Separate visits to objects.", ""),
    ("Total_transitions", "entries", "Transitions", "Moves from one zone into another.", "sum over pairs of zones"),
    ("Total_distance_cm", "distance", "Distance (cm)", "How far the animal went.", "sum of steps of at least the minimum movement x cm per pixel"),
    ("Total_distance_pixels", "distance", "Distance (px)", "The same in pixels.", "sum of steps of at least the minimum movement"),
    ("Mean_speed_cm_s", "distance", "Speed (cm/s)", "Mean speed while seen.", "distance / time seen"),
    ("Mean_speed_pixels_s", "distance", "Speed (px/s)", "The same in pixels.", "distance / time seen"),
    ("Latency_first_open_arm_s", "distance", "Latency to an open arm (s)", "Seconds until the first open-arm entry.", "time of the first open-arm entry - start"),
    ("Latency_to_dark_s", "distance", "Latency to the dark (s)", "Seconds until the first dark-box entry.", "time of the first dark-box entry - start"),
    ("Latency_to_light_s", "distance", "Latency to the light (s)", "Seconds until the first light-box entry.", "time of the first light-box entry - start"),
    ("Latency_first_center_s", "distance", "Latency to the centre (s)", "Seconds until the first centre entry.", "time of the first centre entry - start"),
    ("Start_compartment", "distance", "Start compartment", "Where the animal began.", ""),
    ("Anxiety_index", "indices", "Anxiety index (0-1)", "Little time and few entries in the exposed part.", "1 - (share of time + share of entries of the exposed part) / 2"),
    ("Discrimination_index", "indices", "Discrimination index", "Above nil: more at the novel object.", "(novel - familiar) / (novel + familiar)"),
    ("Discrimination_ratio", "indices", "Discrimination ratio", "Above a half: more at the novel object.", "novel / (novel + familiar)"),
    ("Recognition_index_pct", "indices", "Recognition index (%)", "The ratio as a percentage.", "novel / (novel + familiar) x 100"),
    ("Sociability_index", "indices", "Sociability index", "Above nil: more on the social side.", "(social - object side time) / (social + object side time)"),
    ("Detection_engine", "settings", "Engine", "How the animal was found.", ""),
    ("Entry_rule", "settings", "Entry rule", "When an entry counts.", ""),
    ("Min_move_px", "settings", "Minimum movement (px)", "Shorter steps are rest.", ""),
    ("Covered_zones", "settings", "Covered zones", "Zones with a lid.", ""),
    ("Bin_size_s", "settings", "Time bin (s)", "Length of time bins.", ""),
)
#: The exposed part of each test, for the formula of its anxiety index.
EXPOSED = {"epm": "open arms", "light_dark": "light box", "open_field": "centre"}
#: Endings that tell the unit, and families of names by their ends or beginnings.
UNITS = (("_pct", " (%)"), ("_percent", " (%)"), ("_time_s", " time (s)"), ("_s", " (s)"), ("_px", " (px)"), ("_cm", " (cm)"))
MOVE, PAIR = "^Trans_(.+)_to_(.+)$", "^(Preference_index|Discrimination_index|Discrimination_ratio)_(.+)_vs_(.+)$"


def words(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "_", " "))


def zones_of(names: DataFrame) -> DataFrame:
    """(zone, seq) that (measure, seq) rows tell: names with a time in seconds and a percentage, but the band along the walls."""
    timed = names.filter(F.col("measure").endswith("_time_s") & ~F.col("measure").startswith("Thigmotaxis_"))
    zone = F.expr("left(measure, length(measure) - 7)")
    found = timed.select(zone.alias("zone"), "seq").filter("zone <> ''")
    shares = names.select(F.col("measure").alias("share")).distinct()
    return found.join(shares, F.concat("zone", F.lit("_percent")) == F.col("share"), "left_semi").groupBy("zone").agg(F.min("seq").alias("seq"))


def zone_fields(names: DataFrame, zones: DataFrame) -> DataFrame:
    """(measure, zone, zone_seq, field) of names that are a zone's measure; where two zones fit, the longest."""
    fields = F.array(*(F.lit(f) for f, *_ in FIELDS))
    each = names.select("measure", F.explode(fields).alias("field")).filter(F.col("measure").endswith(F.concat(F.lit("_"), F.col("field"))))
    each = each.withColumn("zone", F.expr("left(measure, length(measure) - length(field) - 1)"))
    met = each.join(zones.select("zone", F.col("seq").alias("zone_seq")), "zone")
    best = F.max_by(F.struct("zone", "zone_seq", "field"), F.length("zone")).alias("b")
    return met.groupBy("measure").agg(best).select("measure", "b.*")


def _known(names: DataFrame) -> DataFrame:
    rows = [(name, i, *rest) for i, (name, *rest) in enumerate(KNOWN)]
    return names.sparkSession.createDataFrame(rows, "measure string, known_seq int, sheet string, label string, meaning string, formula string")


def with_unit() -> Column:
    """A measure's words with its unit in brackets, by the first ending of UNITS that fits."""
    m = F.col("measure")
    out = words(m)
    for end, unit in reversed(UNITS):
        out = F.when(m.endswith(end), F.concat(words(F.expr(f"left(measure, length(measure) - {len(end)})")), F.lit(unit))).otherwise(out)
    return out


def describe(names: DataFrame, test: str | None = None, zones: DataFrame | None = None) -> DataFrame:
    """(measure, zone, field, sheet, place, label, meaning, formula) of (measure, seq) rows, seq the order in which they came.

    zones: (zone, seq), those told by the names if left out. A name that is both a zone's measure and
    known has the zone's label and sheet, and the known meaning and formula, if any. Sheets list zones' measures field by field,
    zones in the order they came in, and then known names in the order of KNOWN; other names in their own order. A
    move from or to no zone is no measure of its own and has no sheet; nor have an arm's entries that its zone's entries repeat. place numbers a sheet's measures.
    """
    names = names.groupBy("measure").agg(F.min("seq").alias("seq"))
    zones = zones_of(names) if zones is None else zones
    m = F.col("measure")
    known = F.broadcast(_known(names))  # a fixed table
    rows = names.join(known, "measure", "left").join(zone_fields(names, zones), "measure", "left")
    is_zone = F.col("zone").isNotNull()
    order = {f: i for i, (f, *_) in enumerate(FIELDS)}
    of_field = lambda k: F.create_map(*(F.lit(v) for f in FIELDS for v in (f[0], f[k])))[F.col("field")]
    move = [F.regexp_extract(m, MOVE, i) for i in (1, 2)]
    pair = [F.regexp_extract(m, PAIR, i) for i in (1, 2, 3)]
    moved, paired = m.rlike(MOVE), m.rlike(PAIR)
    arm, explored = m.endswith("_arm_entries"), m.endswith("_exploration_s")
    stem = lambda n: words(F.expr(f"left(measure, length(measure) - {n})"))
    a, b = words(pair[1]), words(pair[2])
    start = F.when(move[0] == "None", "(start / outside the zones)").otherwise(words(move[0]))
    stop = F.when(move[1] == "None", "(outside the zones)").otherwise(words(move[1]))
    label = F.when(is_zone, F.concat(words(F.col("zone")), F.lit(" – "), of_field(2))).when(moved, F.concat(start, F.lit(" → "), stop)).when(arm, F.concat(stem(12), F.lit(" arm entries")))
    label = label.when(explored, F.concat(stem(14), F.lit(" exploration (s)"))).when(paired, words(m)).otherwise(with_unit())
    meaning = F.when(is_zone, of_field(3)).when(moved, "Moves from the first zone straight into the second.").when(arm, "Entries into this arm.").when(explored, "Seconds at this object.")
    meaning = meaning.when(paired & (pair[0] == "Preference_index"), "Above nil: more time in the first.").otherwise("")
    share = F.when(pair[0] == "Preference_index", F.concat(F.lit("("), a, F.lit(" time - "), b, F.lit(" time) / (sum of both)")))
    share = share.when(pair[0] == "Discrimination_index", F.concat(F.lit("("), a, F.lit(" - "), b, F.lit(") / ("), a, F.lit(" + "), b, F.lit(")"))).otherwise(F.concat(a, F.lit(" / ("), a, F.lit(" + "), b, F.lit(")")))
    formula = F.when(is_zone, of_field(4)).when(moved, "moves counted").when(paired, share).otherwise("")
    exposed = EXPOSED.get(test or "")
    own = F.when((m == "Anxiety_index") & F.lit(exposed is not None), F.lit(f"1 - (share of time + share of entries of the {exposed}) / 2")).otherwise(F.col("formula"))
    entered = Window.partitionBy("twin")
    twin = F.when(arm, F.expr("concat(left(measure, length(measure) - 12), '_entries')")).when(is_zone & (F.col("field") == "entries"), m)
    rows = rows.withColumn("twin", twin)
    repeats = arm & F.col("twin").isNotNull() & F.max(F.when(is_zone, True)).over(entered)
    outside = moved & ((move[0] == "None") | (move[1] == "None"))
    sheet = F.when(outside | F.coalesce(repeats, F.lit(False)), None).when(is_zone, of_field(1)).when(F.col("sheet").isNotNull(), F.col("sheet"))
    sheet = sheet.when(moved | arm, "entries").when(explored, "time").when(paired, "indices").otherwise("other")
    block = F.when(is_zone & (F.col("field") != "latency_s"), 0).when(F.col("sheet").isNotNull(), 1).otherwise(2)
    listed = rows.select(
        "measure", "zone", "field", sheet.alias("sheet"), F.when(is_zone, label).otherwise(F.coalesce("label", label)).alias("label"),
        F.coalesce("meaning", meaning).alias("meaning"), F.coalesce(F.nullif(own, F.lit("")), formula).alias("formula"), block.alias("block"),
        F.when(is_zone, F.create_map(*(F.lit(v) for f, i in order.items() for v in (f, i)))[F.col("field")]).when(F.col("sheet").isNotNull(), F.col("known_seq")).otherwise(0).alias("o1"),
        F.when(is_zone, F.col("zone_seq")).otherwise(F.col("seq")).alias("o2"),
    )
    place = F.when(F.col("sheet").isNotNull(), F.row_number().over(Window.partitionBy("sheet").orderBy("block", "o1", "o2", "measure")))
    return listed.select("measure", "zone", "field", "sheet", place.alias("place"), "label", "meaning", "formula")
