"""Micro-fixtures worked out by hand, loops against window forms, and the catalogue against SQL."""

import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vivarium.functions.custom import add_variables, parse_lines
from vivarium.operators import events, freezing, ranks, runs, statistics, summary, trajectory, zones
from vivarium.plans import catalogue, measures, records, studies, tracks  # noqa: F401
from vivarium.sources import tables

SF = "/root/testdata/sf0.001"


def flags_frame(spark, values):
    return spark.createDataFrame([(1, i, float(i), bool(v)) for i, v in enumerate(values)], "session long, frame long, time_s double, flag boolean")


def loop_debounce(values, least):
    state, i = values[0], 0
    out = []
    while i < len(values):
        j = i
        while j < len(values) and values[j] == values[i]:
            j += 1
        if j - i >= least:
            state = values[i]
        out += [state] * (j - i)
        i = j
    return out


def test_debounce_by_hand_and_by_loop(spark):
    rng = random.Random(5)
    for values in [[1, 0, 1, 1, 1, 0, 0, 1, 0, 0, 0]] + [[rng.randint(0, 1) for _ in range(rng.randint(1, 25))] for _ in range(4)]:
        got = [int(r.state) for r in runs.debounced(flags_frame(spark, values), ["session"], "frame", "flag", 3).orderBy("frame").collect()]
        assert got == loop_debounce(values, 3)


def test_moves_are_stamped_at_the_confirming_frame(spark):
    rows = [(1, i, float(i), "Tracked", z) for i, z in enumerate("AABABBB")]
    got = zones.moves(spark.createDataFrame(rows, "session long, frame long, time_s double, status string, label string"), 3).collect()
    assert [(r.from_zone, r.to_zone, r.time_s) for r in got] == [("A", "B", 6.0)]


def test_frames_without_candidate_do_not_break_a_run(spark):
    rows = [(1, i, float(i), z) for i, z in enumerate(["A", None, "A", None, "A", "B", "B", "A", "B", "B", "B"])]
    got = zones.entries_by_candidate(spark.createDataFrame(rows, "session long, frame long, time_s double, candidate string"), 3).orderBy("time_s").collect()
    assert [(r.zone, r.time_s) for r in got] == [("A", 0.0), ("B", 8.0)]


def test_path_distance_ignores_jitter(spark):
    xs = [0, 0.5, 0, 0.4, 0, 5]
    rows = [(1, i, float(x), 0.0) for i, x in enumerate(xs)]
    got = trajectory.path_distance(spark.createDataFrame(rows, "session long, frame long, x double, y double"), 1.0).first()
    assert (got.distance, got.steps) == (5.0, 1)


def test_gap_fill_and_hold(spark):
    xs = [None, 0.0, None, None, 3.0, None, None, None, 9.0, None]
    df = spark.createDataFrame([(1, i, x, x) for i, x in enumerate(xs)], "session long, frame long, x double, y double")
    filled = [r.x for r in trajectory.gap_fill(df, 2).orderBy("frame").collect()]
    assert filled == [None, 0.0, 1.0, 2.0, 3.0, None, None, None, 9.0, None]
    held = [r.x for r in trajectory.hold_last(df).orderBy("frame").collect()]
    assert held == [0.0, 0.0, 0.0, 0.0, 3.0, 3.0, 3.0, 3.0, 9.0, 9.0]


def test_freezing_states(spark):
    motion = [9, 9, 1, 1, 1, 9, 1, 1, 9, 9, 1, 1, 9]
    usable = [False, True] + [True] * 11
    df = spark.createDataFrame([(1, i, float(m), u) for i, (m, u) in enumerate(zip(motion, usable))], "session long, frame long, motion double, usable boolean")
    got = [int(r.freezing) for r in freezing.states(df, 5.0, 1, 3).orderBy("frame").collect()]
    assert got == [0, 0, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]


def test_clip_closes_or_drops_open_bouts(spark):
    rows = [(1, 1, "a", "state", 5.0, None), (1, 2, "a", "state", -3.0, 4.0), (1, 3, "b", "point", 0.0, None), (1, 4, "b", "point", 10.0, None), (1, 5, "b", "point", 10.1, None)]
    df = spark.createDataFrame(rows, "session long, seq long, behaviour string, kind string, start double, stop double")
    assert sorted((r.seq, r.start, r.stop) for r in events.clip(df, 0.0, 10.0).collect() if r.stop) == [(2, 0.0, 4.0)]
    assert {r.seq for r in events.clip(df, 0.0, 10.0, close_open_at=8.0).collect()} == {1, 2, 3, 4}
    assert [r.seq for r in events.unpaired(df).collect()] == [1]


def test_alternation(spark):
    df = spark.createDataFrame([(1, float(i), z) for i, z in enumerate("ABCABAAC")], "session long, time_s double, zone string")
    got = zones.alternation(df).first()
    assert (got.entries, got.alternations, got.same_arm, got.alternate_arm, round(got.percent, 3)) == (8, 3, 1, 1, 50.0)


def test_bh(spark):
    df = spark.createDataFrame([(p,) for p in (0.01, 0.04, 0.03, None, 0.20)], "p double")
    got = {r.p: r.q for r in statistics.bh_adjust(df).collect()}
    assert got[None] is None
    assert [round(got[p], 4) for p in (0.01, 0.03, 0.04, 0.20)] == [0.04, 0.0533, 0.0533, 0.2]


def test_kruskal_with_ties(spark):
    df = spark.createDataFrame([("m", "a", 1.0), ("m", "a", 2.0), ("m", "b", 2.0), ("m", "b", 3.0)], "metric string, group string, value double")
    got = ranks.kruskal(df).first()  # ranks 1, 2.5 and 2.5, 4: H = 0.6 x 26.5 - 15 over 1 - 6 / 60
    assert math.isclose(got.h, (12 / 20 * (3.5**2 / 2 + 6.5**2 / 2) - 15) / 0.9) and got.df == 1


def test_kappa_edges(spark):
    df = spark.createDataFrame([(True, True)] * 3, "a boolean, b boolean")
    assert statistics.binary_scores(df, F.col("a"), F.col("b")).first().kappa == 1.0
    df = spark.createDataFrame([(True, False)] * 2 + [(False, True)] * 2, "a boolean, b boolean")
    assert statistics.binary_scores(df, F.col("a"), F.col("b")).first().kappa == -1.0


def test_distributions_against_commons_math(spark):
    dist = spark._jvm.org.apache.commons.math3.distribution
    for t, df in ((0.5, 3.0), (2.1, 17.4), (5.0, 120.0), (0.0, 9.0)):
        assert math.isclose(statistics.t_p(t, df), 2 * dist.TDistribution(df).cumulativeProbability(-abs(t)), rel_tol=1e-9)
    for f, a, b in ((0.7, 2.0, 30.0), (4.4, 5.0, 200.0), (1.0, 1.0, 1.0)):
        assert math.isclose(statistics.f_p(f, a, b), 1 - dist.FDistribution(a, b).cumulativeProbability(f), rel_tol=1e-8)
    low, high = statistics.bootstrap_d(np.array([1.0, 2, 3, 4]), np.array([2.0, 3, 4, 6]))
    assert low < -0.7 < high


def test_polygon_edges(spark):
    tri = [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)]
    rows = [(float(x), float(y), tri) for x in range(-1, 6) for y in range(-1, 6)]
    df = spark.createDataFrame(rows, "x double, y double, p array<struct<x:double,y:double>>")
    got = {(r.x, r.y) for r in df.filter(zones.in_polygon(F.col("x"), F.col("y"), F.col("p"))).collect()}
    assert got == {(x, y) for x, y, _ in rows if x >= 0 and y >= 0 and x + y <= 4}


def test_custom_variables(spark):
    df = spark.createDataFrame([(7.0, -2.0), (0.0, 3.0)], "a double, b double")
    out, skipped = add_variables(df, "c = a // b\nd = a % b\ne = sqrt(b)\na = 1\nf = __import__('os')\ng = max(a, b) * k", k=2.0)
    assert skipped == ["a", "f"]
    assert [tuple(r) for r in out.collect()] == [(7.0, -2.0, -4.0, -1.0, None, 14.0), (0.0, 3.0, 0.0, 0.0, 3**0.5, 6.0)]
    with pytest.raises(ValueError):
        parse_lines("1x = 2")


def test_audit_chain(spark):
    import hashlib

    previous, rows = None, []
    for i in range(3):
        h = hashlib.sha256(f"{previous or ''}|e{i}".encode()).hexdigest()
        rows.append((i, f"e{i}", h, previous))
        previous = h
    df = spark.createDataFrame(rows, "seq long, entry string, hash string, previous string")
    assert [r.valid for r in summary.audit_chain(df).orderBy("seq").collect()] == [True] * 3
    assert not all(r.valid for r in summary.audit_chain(df.withColumn("entry", F.lit("e0"))).collect())


def test_live_stream_equals_batch(spark, tmp_path):
    from vivarium.streaming import live

    zone = zones.labelled(zones.zone_flags(tables.trajectory(spark, SF), tables.zones(spark))).select("session", "frame", F.col("label").alias("zone"))
    rows = tables.trajectory(spark, SF).join(zone, ["session", "frame"]).withColumn("command", F.lit(None).cast("string")).select("session", "frame", "time_s", "x", "y", "zone", "command")
    rows = rows.withColumn("session", F.col("session").cast("long"))
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = live.live_statistics(stream, 30.0).writeStream.format("memory").queryName("live").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    want = {r.session: r.distance for r in trajectory.path_distance(tables.trajectory(spark, SF), 30.0).collect()}
    got = {r.session: r.distance for r in spark.table("live").collect()}
    assert got and all(math.isclose(want[s], d, rel_tol=1e-9) for s, d in got.items())


def normal(rows, columns):
    def value(v):
        if isinstance(v, float) and v != v:
            return "None"
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
            return f"{float(v) + 0.0:.5g}" if abs(float(v)) > 1e-9 else "0"
        return str(v)

    return sorted(tuple(value(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_catalogue_against_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    got = con.execute(catalogue.ORACLES[name])
    columns = sorted(c[0] for c in got.description)
    names = [c[0] for c in got.description]
    want = [dict(zip(names, r)) for r in got.fetchall()]
    have = catalogue.QUERIES[name](spark, SF)
    assert sorted(have.columns) == columns
    assert normal([r.asDict() for r in have.collect()], columns) == normal(want, columns)
