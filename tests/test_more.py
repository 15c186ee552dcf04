"""Importers, choice of tests, the mixed model, body ends and classifiers, against brute force or values worked out by hand."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vivarium.operators import body, classifier, comparison, freezing, mixed, ranks, statistics
from vivarium.sources import imports


def events_of(df):
    return sorted((r.behaviour, r.kind, r.start, r.stop) for r in df.collect())


def test_flag_table(spark, tmp_path):
    path = tmp_path / "machine.csv"
    path.write_text("frame,Probability_groom,groom,rear\n0,0.9,1,1\n1,0.8,1,1\n2,0.1,0,1\n3,0.7,1,1\n")
    assert events_of(imports.read_events(spark, str(path), "s", fps=10.0, offset=1.0)) == [("groom", "state", 1.0, 1.2), ("groom", "state", 1.3, 1.4)]


def test_marker_table(spark, tmp_path):
    path = tmp_path / "tabular.tsv"
    path.write_text("Time\tBehavior\tStatus\n1.0\ta\tSTART\n2.0\ta\tSTART\n3.5\ta\tSTOP\n4.0\tb\tPOINT\n5.0\ta\tSTOP\n6.0\ta\tSTART\n")
    assert events_of(imports.read_events(spark, str(path), "s")) == [("a", "state", 2.0, 3.5), ("b", "point", 4.0, None)]


def test_span_table(spark, tmp_path):
    path = tmp_path / "spans.csv"
    path.write_text("Label;Start (s);Duration (s)\na;1,5;2\nb;3;0\nc;;1\n")
    assert events_of(imports.read_events(spark, str(path), "s")) == [("a", "state", 1.5, 3.5), ("b", "point", 3.0, None)]
    path.write_text("x,y\n1,2\n")
    with pytest.raises(ValueError):
        imports.read_events(spark, str(path), "s")


def test_medpc(spark, tmp_path):
    path = tmp_path / "box1.txt"
    path.write_text("File: a\nStart Date: 1/1/24\n\nA:       3.000\nB:\n     0:     1.5     2.5\n     5:     4.0\nMSN: x\n     0:     9\nC:\n     0:     7,25\n\nFile: b\nA:       8.000\n")
    got = sorted((r.letter, r.i, r.value) for r in imports.read_medpc(spark, str(path)).collect())
    assert got == [("A", 0, 3.0), ("B", 0, 1.5), ("B", 1, 2.5), ("B", 2, 4.0), ("C", 0, 7.25)]


def test_pose_tables(spark, tmp_path):
    path = tmp_path / "dlc.csv"
    path.write_text("scorer,m,m,m,m,m,m\nbodyparts,nose,nose,nose,body,body,body\ncoords,x,y,likelihood,x,y,likelihood\n0,1,2,0.9,3,4,0.9\n1,1,2,0.9,5,6,0.1\n")
    points = imports.read_pose(spark, str(path)).withColumn("session", F.lit("s"))
    assert imports.centre_parts(["nose", "body"]) == ["body"] and imports.centre_parts(["nose", "neck", "hip", "tailtip"]) == ["neck", "hip"]
    got = imports.pose_positions(points, F.col("part").isin("body")).orderBy("frame").collect()
    assert [(r.x, r.y, r.status) for r in got] == [(3.0, 4.0, "Tracked"), (None, None, "Lost")]
    path = tmp_path / "many.csv"
    path.write_text("scorer,m,m,m,m\nindividuals,one,one,two,two\nbodyparts,nose,nose,nose,nose\ncoords,x,y,x,y\n0,1,2,3,4\n")
    assert [tuple(r) for r in imports.read_pose(spark, str(path)).collect()] == [(0, "nose", 1.0, 2.0, 1.0)]
    path = tmp_path / "sleap.csv"
    path.write_text("track,frame_idx,nose.x,nose.y,nose.score\nt0,4,1,2,0.5\nt1,4,9,9,0.5\n")
    assert [tuple(r) for r in imports.read_pose(spark, str(path)).collect()] == [(4, "nose", 1.0, 2.0, 0.5)]


def test_shapiro_wilk_of_a_published_sample():
    w, p = ranks.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]))
    assert math.isclose(w, 0.7888, abs_tol=2e-4) and math.isclose(p, 0.0067, abs_tol=2e-4)
    rng = np.random.default_rng(1)
    ps = [ranks.shapiro_wilk(rng.normal(size=50))[1] for _ in range(300)]
    assert 0.02 < np.mean(np.array(ps) < 0.05) < 0.09 and 0.4 < np.mean(ps) < 0.6
    assert all(math.isnan(v) for v in ranks.shapiro_wilk(np.ones(9)))


def test_mann_whitney_by_all_orders(spark):
    a, b = [1.0, 4.0, 7.5], [2.0, 3.0, 8.0, 9.0]
    df = spark.createDataFrame([("m", "a", v) for v in a] + [("m", "b", v) for v in b], "metric string, group string, value double")
    got = ranks.mann_whitney(df, "a", "b").first()
    wins = lambda x, y: sum(i > j for i in x for j in y)
    every = [wins(c, [v for v in a + b if v not in c]) for c in itertools.combinations(a + b, 3)]
    most = max(wins(a, b), 12 - wins(a, b))
    assert got.u == wins(a, b) and math.isclose(got.p, min(1, 2 * sum(u >= most for u in every) / len(every)))


def test_value_ranks_with_ties_nulls_and_ranges(spark):
    rng = np.random.default_rng(3)
    values = [float(v) for v in rng.integers(0, 300, 900)]
    df = spark.createDataFrame([("m", v) for v in values] + [("m", None)], "metric string, value double")
    got = {r.value: (r.tied, r["rank"]) for r in ranks.value_ranks(df, ["metric"]).collect()}
    order = np.array(sorted(values))
    assert got == {v: (int((order == v).sum()), float((order < v).sum() + ((order == v).sum() + 1) / 2)) for v in set(values)}
    assert ranks.value_ranks(df.filter("value < 0"), ["metric"]).count() == 0


def test_chi_squared_against_commons_math(spark):
    dist = spark._jvm.org.apache.commons.math3.distribution
    for x, k in ((0.3, 1.0), (3.2, 2.0), (15.0, 6.0), (120.0, 80.0)):
        assert math.isclose(1 - statistics.gamma_share(k / 2, x / 2), 1 - dist.ChiSquaredDistribution(k).cumulativeProbability(x), rel_tol=1e-9)


def test_comparison_chooses_tests(spark):
    rng = np.random.default_rng(5)
    rows = [("two normal", g, float(v)) for g, m in (("a", 0), ("b", 2)) for v in rng.normal(m, 1, 40)]
    rows += [("two skewed", g, float(v)) for g in "ab" for v in rng.exponential(1, 60) ** 3]
    rows += [("three normal", g, float(v)) for g in "abc" for v in rng.normal(0, 1, 30)]
    rows += [("three skewed", g, float(v)) for g in "abc" for v in rng.exponential(1, 60) ** 3]
    rows += [("one", "a", 1.0), ("one", "a", 2.0), ("one", "b", 3.0)]
    got = {r.metric: r for r in comparison.compare_groups(spark.createDataFrame(rows, "metric string, group string, value double"), 0.01).collect()}
    assert {k: r.test for k, r in got.items()} == {
        "two normal": "Welch t-test", "two skewed": "Mann-Whitney U", "three normal": "One-way ANOVA", "three skewed": "Kruskal-Wallis", "one": "insufficient data",
    }
    assert got["two normal"].significant and got["one"].p is None and all(got[k].q >= got[k].p for k in got if k != "one")


def test_mixed_effects_against_dense_matrices(spark):
    rng = np.random.default_rng(9)
    rows = []
    for s in range(24):
        own = rng.normal(0, 2)
        for t in range(3):
            for _ in range(int(rng.integers(0, 3))):
                rows.append((s, "ab"[s % 2], t, float(5 + own + (s % 2) * 1.5 + t * 0.7 + rng.normal())))
    rows.append((None, "a", 0, 1.0))
    got = {r.term: r for r in mixed.mixed_effects(spark.createDataFrame(rows, "subject long, group string, timepoint int, value double")).collect()}
    rows = rows[:-1]
    y = np.array([r[3] for r in rows])
    g, t = np.array([r[1] == "b" for r in rows], float), np.array([r[2] for r in rows])
    x = np.stack([np.ones(len(y)), g, t == 1, t == 2, g * (t == 1), g * (t == 2)], axis=1).astype(float)
    z = np.equal.outer([r[0] for r in rows], sorted({r[0] for r in rows})).astype(float)

    def loss(ratio):
        v = np.linalg.inv(np.eye(len(y)) + ratio * z @ z.T)
        beta = np.linalg.solve(x.T @ v @ x, x.T @ v @ y)
        s2 = float((y - x @ beta) @ v @ (y - x @ beta)) / len(y)
        return len(y) * math.log(s2) - np.linalg.slogdet(v)[1], beta, s2, s2 * np.linalg.inv(x.T @ v @ x)

    ratio = got["variance between"].estimate / got["variance within"].estimate
    low, beta, s2, cov = loss(ratio)
    assert low <= min(loss(ratio * f)[0] for f in (0.8, 0.95, 1.05, 1.25)) + 1e-9
    assert math.isclose(got["variance within"].estimate, s2, rel_tol=1e-6)
    for i, term in enumerate(["Intercept", "group[b]", "time[1]", "time[2]", "group[b]:time[1]", "group[b]:time[2]"]):
        assert math.isclose(got[term].estimate, beta[i], rel_tol=1e-6) and math.isclose(got[term].se, math.sqrt(cov[i, i]), rel_tol=1e-6)
    assert mixed.mixed_effects(spark.createDataFrame([], "subject long, group string, timepoint int, value double")).count() == 0


def test_head_and_tail_by_all_orientations(spark):
    rng = np.random.default_rng(11)
    n, fps = 9, 5.0
    centre = rng.normal(0, 5, (n, 2)).cumsum(axis=0)
    half = rng.normal(0, 8, (n, 2))
    ends = np.hstack([centre + half, centre - half])
    tail, shape = rng.uniform(-1, 1, n), rng.uniform(-1, 1, n)
    missing = {3}
    rows = [(1, i, *map(float, centre[i]), *((None,) * 4 if i in missing else map(float, ends[i])), float(tail[i]), float(shape[i])) for i in range(n)]
    names = ("x", "y", "ax", "ay", "bx", "by", "tail_ev", "shape_ev")
    got = body.head_and_tail(spark.createDataFrame(rows, "session long, frame long, " + ", ".join(f"{c} double" for c in names)), fps).orderBy("frame").collect()
    seen = [i for i in range(n) if i not in missing]
    size = np.median([2 * np.hypot(*half[i]) for i in seen])

    def cost(flips):
        total, last = 0.0, None
        for i, s in zip(seen, flips):
            a, b = max(0, i - 1), min(n - 1, i + 1)
            v = (centre[b] - centre[a]) / ((b - a) / fps)
            along = 2 * half[i]
            walk = along @ v / (np.hypot(*along) * np.hypot(*v)) * min(1, np.hypot(*v) / (1.5 * size))
            total += (-1 if s == 0 else 1) * (-1.5 * tail[i] + 0.5 * shape[i] + 1.2 * walk)
            head, rear = (ends[i][:2], ends[i][2:]) if s == 0 else (ends[i][2:], ends[i][:2])
            if last is not None:
                total += 2 / (1 + 0.5 * (i - last[0] - 1)) * (np.hypot(*(head - last[1])) + np.hypot(*(rear - last[2]))) / size
            last = (i, head, rear)
        return total

    best = min(itertools.product((0, 1), repeat=len(seen)), key=cost)
    for i, s in zip(seen, best):
        assert np.allclose([got[i].head_x, got[i].head_y], ends[i][:2] if s == 0 else ends[i][2:])
    assert got[3].head_x is None and got[3].tail_y is None


def test_hidden_at_the_edges_of_a_session(spark):
    zone = spark.createDataFrame([(0, "box", [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)])], "place int, zone string, polygon array<struct<x:double,y:double>>")
    seen = {2: (5.0, 2.0), 4: (1.0, 1.0), 6: (30.0, 2.0), 8: (6.0, 2.0)}
    rows = [(1, i, *seen.get(i, (None, None)), "Tracked" if i in seen else "Lost") for i in range(10)]
    df = spark.createDataFrame(rows, "session long, frame long, x double, y double, status string")
    got = [r.hidden_zone for r in body.hidden_in_covered(df, zone, 2.0).orderBy("frame").collect()]
    assert got == ["box", "box", None, "box", None, None, None, None, None, "box"]


def test_lights_are_trimmed_only_at_the_ends(spark):
    bright = [1.0, 2.0, None, 50.0, 50.0, 9.0, 50.0, 50.0, 50.0, 120.0]
    df = spark.createDataFrame([(1, i, b) for i, b in enumerate(bright)], "session long, frame long, bright double")
    got = freezing.lights_trim(df, 2.0).first()
    assert (got["first"], got["last"]) == (3, 9)  # one bright frame at the end is shorter than a second


def test_forest_finds_a_separable_behaviour(spark):
    rng = np.random.default_rng(2)
    truth = np.arange(600) // 40 % 2 == 0
    x = np.stack([truth + rng.normal(0, 0.2, 600), rng.normal(size=600)], axis=1)
    df = spark.createDataFrame([(0, i, [float(v) for v in x[i]], bool(truth[i])) for i in range(600)], "session int, frame long, features array<double>, truth boolean")
    r = classifier.cross_validate(df, "truth", 10.0, trees=10).first()
    assert r.folds == 5 and r.f1 > 0.95
    model = classifier.train(df, "truth", trees=10)
    assert classifier.important(model, ["signal", "noise"], 1)[0][0] == "signal"
    assert {f.fold for f in classifier.with_folds(df.withColumn("session", F.col("frame") % 2), 10.0).select("fold").collect()} == {"0", "1"}
    none = classifier.cross_validate(df.filter("truth"), "truth", 10.0).first()
    assert none.folds == 0 and none.f1 is None


def test_stop_rules(spark):
    from vivarium.operators import stops

    rows = [("a", 0, "Tracked", 0.0, 0.0), ("a", 1, "Tracked", 1.0, 0.0), ("a", 2, "Lost", None, None), ("a", 3, "Tracked", 1.5, 0.0), ("a", 4, "Tracked", 2.0, 0.0), ("a", 5, "Tracked", 2.0, 1.0), ("a", 6, "Tracked", 12.0, 1.0)]
    df = spark.createDataFrame([*rows, ("b", 0, "Lost", None, None)], "session string, frame int, status string, x double, y double")
    assert [tuple(r) for r in stops.rested(df, 1.5, 2.0).collect()] == [("a", 5)]  # the lost frame breaks the rest
    assert [tuple(r) for r in stops.walked(df, 3.0).collect()] == [("a", 5)]  # 1 + 0.5 (over the lost frame) + 0.5 + 1
    inside = df.withColumn("inside", df.frame != 4)
    assert [tuple(r) for r in stops.entered(inside, 3).collect()] == [("a", 5)]  # entries at 0, 3 and 5
    assert stops.entered(inside.filter("false"), 1).count() == 0
