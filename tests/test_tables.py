"""Tables in and out, names, and the whole freezing analysis, worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from vivarium.functions import text
from vivarium.operators import freezing_result, summary
from vivarium.sources import freezing_tables, imports, sinks


def read_back(spark, folder):
    return sinks.read_csv(spark, folder)


def test_names_and_windows():
    assert text.pretty("open_arm__time_pct") == "open arm time (%)" and text.pretty("latency_s") == "latency (s)" and text.pretty("bouts") == "bouts"
    assert text.merged({"a": 1, "b": 2}, {"a": None, "b": 3, "c": 4}) == {"a": 1, "b": 3, "c": 4}
    assert [text.frame_lag(f) for f in (10.0, 30.0, 59.0, 120.0)] == [1, 1, 2, 4]
    assert text.time_window(1.0, 2.0, 10.0, 100) == (10, 20) and text.time_window(-5.0, None, 10.0, 100) == (0, 99)
    assert text.time_window(50.0, 1.0, 10.0, 100) == (99, 99) and text.time_window(3.0, 1.0, 10.0, 100) == (30, 30)


def test_thresholds_of_body_parts(spark):
    assert freezing_result.part_threshold(1.0) == 1.0 and freezing_result.part_threshold(6.0) == 3.0
    assert spark.range(1).select(freezing_result.threshold_pixels(2.5, F.lit(400.0))).first()[0] == 10.0


def test_epoch_files(spark, tmp_path):
    def of(content):
        path = tmp_path / "epochs.csv"
        path.write_text(content)
        return sorted((r.name, r.start, r.end) for r in imports.read_epochs(spark, str(path), "s", 5.0).collect())

    assert of("Name;Start (s);End (s)\nTone 1;1,5;3\nbad;5;5\nTone 2;8;9,25\n") == [("Tone 1", 1.5, 3.0), ("Tone 2", 8.0, 9.25)]
    assert of("start,duration\n2,4\n10,1\n") == [("Epoch", 2.0, 6.0), ("Epoch", 10.0, 11.0)]
    assert of("Tone,Light\n1,20\n30,\n") == [("Light", 20.0, 25.0), ("Tone", 1.0, 6.0), ("Tone", 30.0, 35.0)]


def test_writers(spark, tmp_path):
    long = spark.createDataFrame([("v1", "time", 1.5), ("v1", "entries", 2.0), ("v2", "time", 3.0), ("v2", "other", 9.0)], "video string, measure string, value double")
    sheets = {"zones": ["time", "entries"], "rest": ["other"]}
    assert sinks.write_batch_summary(long, sheets, str(tmp_path / "batch")) == [f"{tmp_path}/batch/{k}" for k in sheets]
    assert {(r.video, r.time, r.entries) for r in read_back(spark, f"{tmp_path}/batch/zones").collect()} == {("v1", 1.5, 2.0), ("v2", 3.0, None)}
    frames = spark.createDataFrame([(1, 0, 0.123456, 12.34567, True), (1, 1, 0.9, 0.0, False)], "session int, frame int, p double, motion double, freezing boolean")
    bouts = spark.createDataFrame([(1, 0.0, 1.0)], "session int, start double, stop double")
    folders = sinks.write_predictions(frames, bouts, str(tmp_path / "found"))
    assert [r.p for r in read_back(spark, folders[0]).orderBy("frame").collect()] == [0.1235, 0.9] and read_back(spark, folders[1]).count() == 1
    table = sinks.frame_table(frames, 4.0).orderBy("Frame").collect()
    assert [tuple(r) for r in table] == [(1, 0, 0.0, 12.3457, 1), (1, 1, 0.25, 0.0, 0)]


def test_trails_and_first_places(spark):
    trail = spark.createDataFrame([], "seq long, entry string, hash string, previous string")
    for part in ([(1, "made"), (2, "seen")], [(3, "changed")]):
        trail = sinks.audit_append(trail, spark.createDataFrame(part, "seq long, entry string"))
    assert [r.valid for r in summary.audit_chain(trail).orderBy("seq").collect()] == [True] * 3
    forged = trail.withColumn("entry", F.when(F.col("seq") == 2, "forged").otherwise(F.col("entry")))
    assert [r.valid for r in summary.audit_chain(forged).orderBy("seq").collect()][1] is False
    names = spark.createDataFrame([(3, "a"), (1, "b"), (2, "a"), (9, "c")], "seq int, name string")
    assert {(r.name, r.place) for r in sinks.first_seen(names, "name").collect()} == {("b", 1), ("a", 2), ("c", 3)}
    df = spark.createDataFrame([(1, None, 5), (None, 2, 6), (3, 4, None)], "a int, b int, c int").toDF("Dose", "dose", "Other")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        assert sinks.case_conflicts(df, ["Dose", "dose", "Other"]) == [("Dose", "dose")]
        assert sinks.case_conflicts(df.filter("Dose IS NULL OR dose IS NULL"), ["Dose", "dose", "Other"]) == []
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def analysed(spark):
    """Two sessions at 2 frames a second: freezing is motion under 5 for a second or more."""
    still = {1: set(range(4, 12)) | set(range(20, 26)), 2: set(range(30, 34))}
    rows = [(s, f, 1.0 if f in still[s] else 9.0 + f % 2, True, 100.0 if f < 38 else 10.0, f != 0 and s == 1, False) for s in still for f in range(40)]
    df = spark.createDataFrame(rows, "session int, frame int, motion double, usable boolean, bright double, found boolean, still boolean")
    epochs = spark.createDataFrame([(s, n, a, b) for s in still for n, a, b in (("Tone 1", 2.0, 5.0), ("Tone 2", 10.0, 13.0), ("End", 15.0, 17.0))], "session int, epoch string, start_s double, end_s double")
    return freezing_result.analyse(df, epochs, 2.0, 5.0, 1.0, 0.0, 2.0, 9.5)


def test_analysis_of_whole_sessions(spark):
    found = analysed(spark)
    assert found.frames.count() == 76  # the dark end is trimmed
    one, two = found.summary.orderBy("session").collect()
    assert (one.analysed_s, one.bouts, one.freezing_s, one.longest_bout_s, one.latency_s, one.mean_gap_s) == (19.0, 2, 7.0, 4.0, 2.0, 4.0)
    assert (two.bouts, round(two.percent, 9), two.latency_s) == (1, round(400 / 38, 9), 15.0)
    epochs = {(r.session, r.epoch): r for r in found.epochs.collect()}
    assert epochs[1, "Tone 1"].percent == 100 and epochs[1, "Tone 1"].before_percent == 0 and epochs[1, "Tone 1"].change == 100
    assert math.isclose(epochs[1, "Tone 1"].suppression, 1 / 10.5) and epochs[2, "End"].percent == 100 and epochs[2, "Tone 2"].percent == 0
    kinds = {(r.session, r.kind): (r.n, r["mean"], r.first, r.last, r.slope) for r in found.kinds.collect()}
    assert kinds[1, "Tone"] == (2, 100.0, 100.0, 100.0, 0.0) and kinds[2, "End"][0] == 1
    assert [r.percent for r in found.bins.filter("session = 1").orderBy("bin").collect()] == pytest.approx([800 / 19, 600 / 19])
    assert {(r.session, r.level, r.code) for r in found.checks.collect()} == {(2, "error", "found")}


def test_every_quality_rule(spark):
    ddl = "session int, cutoff double, size_source string, body_length double, tracked_length double, core_ratio double, core_share double, looks_other boolean, animal_percent double, percent double, moved_elsewhere double, outside_percent double, trimmed_s double"
    rows = [
        (1, 40.0, "unknown", None, None, 0.1, 0.1, False, 10.0, 10.0, 0.0, 25.0, 0.0),
        (2, 39.0, "measured", 5.0, 10.0, 0.1, 0.1, True, 10.0, 10.0, 0.3, 26.0, 1.5),
        (3, 10.0, "tracked", 9.0, 10.0, 0.7, 0.4, None, 30.0, 10.0, 0.1, None, None),
        (4, 10.0, "measured", 9.0, 10.0, 0.7, 0.4, False, 24.0, 10.0, 0.1, 1.0, 0.0),
    ]
    got = {(r.session, r.level, r.code) for r in freezing_result.more_checks(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {
        (1, "error", "cutoff"), (1, "error", "size"), (2, "warn", "size"), (2, "warn", "colour"), (2, "warn", "elsewhere"), (2, "warn", "outside"), (2, "info", "trim"),
        (3, "warn", "bodysize"), (3, "warn", "elsewhere"),
    }
    assert freezing_result.more_checks(spark.createDataFrame([(1, 41.0)], "session int, cutoff double")).first().code == "cutoff"


def test_freezing_tables(spark, tmp_path):
    found = analysed(spark)
    info = spark.createDataFrame([(1, "Ada", "a"), (2, "Bea", "b")], "session int, Subject string, Group string")
    tables = freezing_tables.study_tables(found, info)
    assert list(tables) == ["summary", "epochs", "kinds", "bins", "checks", "tidy"]
    one = tables["summary"].filter("session = 1").first()
    assert one.Subject == "Ada" and one["Freezing bouts"] == 2 and one["Tone – mean freezing (%)"] == 100 and one["End – freezing (%)"] == 0 and "End – mean freezing (%)" not in tables["summary"].columns
    assert [c for c in tables["epochs"].columns if c.endswith("start (s)")] == ["Tone 1 – start (s)", "Tone 2 – start (s)", "End – start (s)"]
    assert tables["kinds"].filter("session = 1").first()["Tone – trials"] == 2 and "Bin 2 (9.5–19 s) – freezing (%)" in tables["bins"].columns
    assert len(freezing_tables.write_study(found, str(tmp_path / "study"), info)) == 6 and read_back(spark, f"{tmp_path}/study/summary").count() == 2
    long = freezing_tables.session_tables(found, 2.0)
    assert {r.measure: r.value for r in long["results"].filter("session = 2").collect()}["Freezing time (s)"] == 2.0
    assert [(r.bout, r.start, r.duration) for r in long["bouts"].filter("session = 1").orderBy("bout").collect()] == [(1, 2.0, 4.0), (2, 10.0, 3.0)]
    freezing_tables.write_sessions(found, str(tmp_path / "sessions"), 2.0)
    assert (tmp_path / "sessions/frames/session=1").is_dir() and read_back(spark, f"{tmp_path}/sessions/frames").filter("session = 2").count() == 38
    empty = freezing_tables.study_tables(freezing_result.Result(*(t.limit(0) for t in (found.frames, found.summary, found.bouts, found.epochs, found.kinds, found.bins, found.checks))))
    assert list(empty) == ["summary", "checks", "tidy"] and empty["tidy"].count() == 0


def test_too_many_names_are_refused(spark):
    df = spark.range(300).select(F.lit(1).alias("session"), F.col("id").cast("string").alias("epoch"), F.col("id").alias("start_s"))
    with pytest.raises(ValueError):
        freezing_tables.names_of(df, "epoch", "start_s")


def test_pose_tracks(spark):
    points = [("s", f, part, x, y, p) for f, rows in enumerate([
        [("nose", 10.0, 0.0, 0.9), ("tail_base", 0.0, 0.0, 0.9), ("left ear", 8.0, 2.0, 0.9), ("tail_tip", -9.0, 0.0, 0.9)],
        [("nose", 10.0, 0.0, 0.2), ("tail_base", 0.0, 4.0, 0.9), ("left ear", 8.0, 2.0, 0.9), ("tail_tip", -9.0, 0.0, 0.9)],
        [("nose", 10.0, 0.0, 0.9), ("tail_base", 4.0, 0.0, 0.9), ("left ear", math.nan, 2.0, 0.9), ("tail_tip", None, None, None)],
        [("nose", 10.0, 0.0, 0.1), ("tail_base", 0.0, 0.0, None), ("left ear", 8.0, 2.0, 0.1), ("tail_tip", -9.0, 0.0, 0.9)],
    ]) for part, x, y, p in rows]
    df = spark.createDataFrame(points, "session string, frame long, part string, x double, y double, p double")
    track = imports.pose_track(df, 2.0)
    got = [tuple(r)[1:] for r in track.orderBy("frame").collect()]
    assert got[0] == (0, 0.0, 8.0, 2.0, "Tracked", 10.0, 0.0, 0.0, 0.0, -1.0, 1.0) and got[1][2:9] == (8.0, 2.0, "Tracked", None, None, None, None)
    assert got[2][2:9] == (None, None, "Lost", 10.0, 0.0, 4.0, 0.0) and got[3][2:5] == (None, None, "Lost") and got[3][9] is None
    assert tuple(imports.pose_body(track).first()) == ("s", 8.0, 64 / 2.4)
    view = text.homography([(0, 0), (10, 0), (10, 10), (0, 10)], [(0, 0), (20, 0), (20, 30), (0, 30)])
    seen = imports.pose_track(df, 2.0, view=view, start_s=0.5, end_s=1.0).orderBy("frame").collect()
    assert [r.frame for r in seen] == [1, 2] and seen[0].x == pytest.approx(16.0) and seen[0].y == pytest.approx(6.0) and seen[1].ax == pytest.approx(20.0)
    bare = imports.pose_track(df.filter("part = 'left ear'"), 2.0)
    assert bare.filter("ax IS NULL AND tail_ev IS NULL").count() == 4
    with pytest.raises(ValueError):
        imports.pose_track(df.limit(0), 2.0)


def test_interactions(spark):
    from vivarium.operators import interactions

    box = lambda a, b: [(a, 0.0), (b, 0.0), (b, 10.0), (a, 10.0)]
    zones = spark.createDataFrame([(0, "Left side", box(0.0, 50.0)), (1, "Whole", box(0.0, 100.0))], "place int, zone string, polygon array<struct<x:double,y:double>>")
    cup = spark.createDataFrame([(0, "Cup 1", box(60.0, 70.0))], zones.schema)
    xs = [10.0, 40.0, 55.0, 58.0, None, 62.0, 75.0, 20.0]
    df = spark.createDataFrame([(1, f, float(f), x, None if x is None else 5.0, "Lost" if x is None else "Tracked") for f, x in enumerate(xs)], "session int, frame int, time_s double, x double, y double, status string")
    stats, bouts = interactions.interaction_stats(df, zones, cup, 1.0, 2.0, 5.0, 0.1, "mm")
    got = {r.measure: round(r.value, 9) for r in stats.collect()}
    assert got == {
        "Total_distance_pixels": 116.0, "Total_distance_mm": 11.6, "Left_side_time_s": 3.0, "Left_side_percent": 37.5, "Whole_time_s": 7.0, "Whole_percent": 87.5,
        "Cup_1_near_time_s": 4.0, "Cup_1_bout_count": 2.0,
    }
    assert sorted((r.first, r.last) for r in bouts.collect()) == [(2, 3), (5, 6)]
    strict, _ = interactions.interaction_stats(df, zones, cup, 1.0, 2.0)
    assert {r.measure: r.value for r in strict.collect()}["Cup_1_near_time_s"] == 1.0 and strict.filter("measure LIKE '%mm'").count() == 0
    flags = interactions.zone_flags(df, zones)
    assert {r.frame: r.roi for r in interactions.joined_labels(flags).collect()} == {0: "Left side_Whole", 1: "Left side_Whole", 2: "Whole", 3: "Whole", 4: "None", 5: "Whole", 6: "Whole", 7: "Left side_Whole"}
