import numpy as np
import pytest

from vivarium.operators import chambers, classifier
from vivarium.operators.chambers import Chamber


def test_chambers_of_places_and_zones(spark):
    layout = [Chamber(1, 0, 0, 10, 10, "Ada"), Chamber(2, 8, 0, 20, 10)]
    square = lambda x, y: [(x, y), (x + 1.0, y), (x + 1.0, y + 1.0), (x, y + 1.0)]
    rows = [(0, "Nest", square(1.0, 1.0)), (1, "C1 · Nest", square(15.0, 1.0)), (2, "C3 · Nest", square(1.0, 1.0)), (3, "Far", square(40.0, 1.0)), (4, "Line", [(1.0, 1.0), (2.0, 2.0)]), (5, "C2 · ", [])]
    df = spark.createDataFrame(rows, "place int, zone string, polygon array<struct<x:double,y:double>>")
    got = {(r.chamber, r.place, r.zone) for r in chambers.chamber_zones(df, layout).collect()}
    assert got == {(1, 0, "Nest"), (1, 1, "Nest'"), (2, 5, "C2 · ")}
    assert chambers.chamber_zones(df.filter("false"), layout).count() == 0

    seen = [("s", 0, 0.0, 9.0, 5.0, "Tracked", 1.0), ("s", 0, 0.0, 15.0, 5.0, "Tracked", 2.0), ("s", 0, 0.0, 16.0, 5.0, "Tracked", 3.0), ("s", 1, 1.0, None, None, "Lost", None), ("s", 1, 1.0, 30.0, 5.0, "Tracked", 1.0)]
    df = spark.createDataFrame(seen, "session string, frame long, time_s double, x double, y double, status string, area double")
    tracks = chambers.chamber_tracks(df, layout)
    got = {(r.session, r.subject, r.frame): (r.x, r.status) for r in tracks.collect()}
    assert got == {("s C1", "Ada", 0): (9.0, "Tracked"), ("s C2", "s C2", 0): (16.0, "Tracked"), ("s C1", "Ada", 1): (None, "Lost"), ("s C2", "s C2", 1): (None, "Lost")}
    assert {(r.chamber, r.frames, r.lost_percent, r.distance) for r in chambers.chamber_summary(tracks).collect()} == {(1, 2, 50.0, 0.0), (2, 2, 50.0, 0.0)}


def test_models_of_several_behaviours(spark, tmp_path):
    rng = np.random.default_rng(3)
    truth = np.arange(400) // 20 % 2 == 0
    x = np.stack([truth + rng.normal(0, 0.2, 400), rng.normal(size=400)], axis=1)
    rows = [(i // 200, i, [float(v) for v in x[i]], bool(truth[i]), i < 3) for i in range(400)]
    df = spark.createDataFrame(rows, "session int, frame long, features array<double>, `rearing up` boolean, rare boolean")
    models = classifier.train_behaviours(df, ["rearing up", "rare"], ["signal", "noise"], 10.0, trees=10)
    assert models.report["rare"] == {"error": "fewer than 10 frames scored"} and list(models.forests) == ["rearing up"]
    found = models.report["rearing up"]
    assert found["folds"] == 2 and found["f1"] > 0.9 and found["hand_s"] == 20.0 and found["top_features"][0] == "signal"
    with pytest.raises(ValueError):
        models.predict(df, ["noise", "signal"])
    models.save(spark, str(tmp_path))
    again = classifier.BehaviourModels.load(spark, str(tmp_path))
    assert again.names == models.names and again.report == models.report
    key = lambda m: sorted((r.frame, r.behaviour, r.p) for r in m.predict(df, ["signal", "noise"]).collect())
    assert key(again) == key(models) and len(key(models)) == 400


def test_live_heads(spark, tmp_path):
    from vivarium.streaming import live

    ddl = "session long, frame long, x double, y double, ax double, ay double, bx double, by double, tail_ev double, shape_ev double"
    rows = [
        (1, 0, 0.0, 0.0, 5.0, 0.0, -5.0, 0.0, 0.0, 0.0),  # no evidence: a
        (1, 1, 3.0, 0.0, -2.0, 0.0, 8.0, 0.0, 0.0, 0.0),  # walks towards b, and b is near the head before
        (1, 2, None, None, None, None, None, None, None, None),
        (1, 3, 3.0, 0.0, 8.0, 0.0, -2.0, 0.0, 0.2, 0.0),  # a is the head before; weak evidence for b
        (1, 4, 3.0, 0.0, 8.0, 0.0, -2.0, 0.0, 2.0, 0.0),  # strong evidence for b
        (2, 0, 0.0, 0.0, 5.0, 0.0, -5.0, 0.0, 0.0, -1.0),  # outline: b
    ]
    df = spark.createDataFrame(rows, ddl)
    for part in ("frame <= 1", "frame > 1"):
        df.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.live_heads(stream).writeStream.format("memory").queryName("heads").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.session, r.frame): (r.head_x, r.tail_x) for r in spark.table("heads").collect()}
    assert got == {(1, 0): (5.0, -5.0), (1, 1): (8.0, -2.0), (1, 2): (None, None), (1, 3): (8.0, -2.0), (1, 4): (-2.0, 8.0), (2, 0): (-5.0, 5.0)}


def test_looks_undo_a_swap_only_between_animals_that_differ(spark):
    from vivarium.operators import animals

    rows = [("a", f, k, 50.0 * k + f % 3) for f in range(20) for k in range(3)] + [("b", f, k, 10.0 + f % 3) for f in range(20) for k in range(3)] + [("c", f, k, 50.0 * k) for f in range(14) for k in range(3)]
    found = animals.looks(spark.createDataFrame([*rows, ("a", 30, 0, None)], "session string, frame long, animal int, look double"))
    assert {(r.session, r.animal, r.look, r.spread) for r in found.collect()} == {("a", k, 50.0 * k + 1, 1.5) for k in range(3)} | {("b", k, 11.0, 1.5) for k in range(3)}
    met = [("a", 40, [100.0, 2.0, 49.0]), ("a", 41, [0.0, None, 100.0]), ("b", 40, [1.0, 2.0, 3.0]), ("c", 40, [0.0, 50.0, 100.0])]
    got = animals.look_order(spark.createDataFrame(met, "session string, frame long, looks array<double>"), found, 3).collect()
    assert [(r.session, r.frame, r.order) for r in got] == [("a", 40, [1, 2, 0])]
