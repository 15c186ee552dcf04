"""Several animals, nested models, bootstraps, geometry, catalogues and streams against brute force and by hand."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vivarium.operators import advanced, animals, body, classifier, comparison, geometry, glossary, identities, mixed, resampling, statistics
from vivarium.operators.assignment import least_cost
from vivarium.streaming import delayed, sessions


def every_order(cost):
    n, m = len(cost), len(cost[0]) if len(cost) else 0
    if n <= m:
        best = min(itertools.permutations(range(m), n), key=lambda p: sum(cost[i][j] for i, j in enumerate(p)))
        return dict(enumerate(best))
    best = min(itertools.permutations(range(n), m), key=lambda p: sum(cost[i][j] for j, i in enumerate(p)))
    return {i: j for j, i in enumerate(best)}


def test_least_cost_is_that_of_every_order():
    rng = np.random.default_rng(0)
    for _ in range(400):
        n, m = (int(v) for v in rng.integers(1, 6, 2))
        cost = rng.integers(0, 6, (n, m)).astype(float) if rng.random() < 0.5 else rng.normal(size=(n, m))
        rows, columns = least_cost(cost)
        want = sum(cost[i][j] for i, j in every_order(cost).items())
        assert len(rows) == min(n, m) == len(set(columns.tolist())) and rows.tolist() == sorted(rows.tolist())
        assert math.isclose(cost[rows, columns].sum(), want, abs_tol=1e-9)
    assert len(least_cost(np.zeros((3, 0)))[0]) == 0


class Filter:
    """One animal by the whole matrices of a constant-velocity filter."""

    def __init__(self, place):
        self.s, self.p, self.lost = np.array([*place, 0.0, 0.0]), np.diag([1.0, 1.0, 50.0, 50.0]), 0

    def predict(self):
        if self.lost > animals.COAST:
            self.s[2:] = 0
        f = np.eye(4) + np.eye(4, k=2)
        self.s, self.p = f @ self.s, f @ self.p @ f.T + np.diag([0, 0, 1, 1]) * animals.PROCESS
        return self.s[:2].copy()

    def update(self, place):
        h = np.eye(2, 4)
        k = self.p @ h.T @ np.linalg.inv(h @ self.p @ h.T + np.eye(2) * animals.MEASURED)
        self.s, self.p, self.lost = self.s + k @ (np.array(place) - h @ self.s), (np.eye(4) - k @ h) @ self.p, 0


def followed(frames, n, apart):
    """The loop with every order tried, a filter of its own for each animal, and plain lists of looks."""
    held = filters = None
    looks, unclear, corrections, out = [[] for _ in range(n)], 0, 0, []
    for frame, spots in frames:
        places = [(s["x"], s["y"]) for s in spots]
        status = "lost" if not spots else "partial" if len(spots) < n else "ok"
        cost = lambda at: [[math.dist(a, p) for p in places] for a in at]  # noqa: B023, E731
        if filters is None:
            if places and held is None:
                held = sorted(places)[:n] if len(places) >= n else [*places, *[places[0]] * (n - len(places))]
            elif places:
                held = [places[match[i]] if i in (match := every_order(cost(held))) else a for i, a in enumerate(held)]
            now = held or [(math.nan, math.nan)] * n
            if len(places) >= n:
                filters = [Filter(p) for p in held]
        else:
            expected = [f.predict() for f in filters]
            match = every_order(cost(expected)) if places else {}
            for i, f in enumerate(filters):
                if i in match:
                    f.update(places[match[i]])
                else:
                    f.lost += 1
            at = [f.s[:2] for f in filters]
            if len(match) == n and all(math.dist(a, b) > apart for a, b in itertools.combinations(at, 2)):
                own = [spots[match[i]]["look"] for i in range(n)]
                if unclear and all(len(v) >= 15 for v in looks) and all(v is not None for v in own):
                    mid = [np.median(v[-300:]) for v in looks]
                    spread = [max(1.5, 1.4826 * np.median(np.abs(np.array(v[-300:]) - m))) for v, m in zip(looks, mid)]
                    if all(abs(mid[a] - mid[b]) >= 4 * math.sqrt((spread[a] ** 2 + spread[b] ** 2) / 2) for a, b in itertools.combinations(range(n), 2)):
                        order = min(itertools.permutations(range(n)), key=lambda p: sum(((own[p[r]] - mid[r]) / spread[r]) ** 2 for r in range(n)))
                        if list(order) != list(range(n)):
                            filters, own, corrections = [filters[i] for i in order], [own[i] for i in order], corrections + 1
                for v, look in zip(looks, own):
                    if look is not None:
                        v.append(look)
                unclear = 0
            else:
                unclear += 1
            now = [tuple(f.s[:2]) for f in filters]
        out += [(frame, i, round(x, 6), round(y, 6), status, corrections) for i, (x, y) in enumerate(now)]
    return out


def crossing(rng, n, frames):
    """Animals on straight lines with crossings, hidden ones, spots that are no animal, and looks 30 apart."""
    start, speed = rng.uniform(0, 400, (n, 2)), rng.normal(0, 6, (n, 2))
    out = []
    for f in range(frames):
        turned = rng.random((n, 1)) < 0.05
        speed = np.where(turned, rng.normal(0, 6, (n, 2)), speed)
        start = start + speed
        if f % 40 > 30:  # all meet, and are hidden for some frames
            start += (start.mean(axis=0) - start) * 0.3
        seen = [i for i in range(n) if f == 3 or f > 3 and rng.random() > (0.4 if f % 40 > 34 else 0.03)]
        spots = [{"x": float(x), "y": float(y), "look": None if rng.random() < 0.02 else 30.0 * i + rng.normal()} for i in seen for x, y in [start[i] + rng.normal(0, 1, 2)]]
        if f > 3 and rng.random() < 0.1:
            spots.append({"x": float(rng.uniform(0, 400)), "y": 5.0, "look": 7.0})
        rng.shuffle(spots)
        out.append((f, spots))
    return out


@pytest.mark.parametrize("n", [2, 3, 5])
def test_track_animals_is_the_loop_of_every_order(spark, n):
    rng = np.random.default_rng(n)
    sessions = {s: crossing(rng, n, 240) for s in range(3)}
    ddl = "session int, frame long, spots array<struct<x:double,y:double,look:double>>"
    df = spark.createDataFrame([(s, f, spots) for s, rows in sessions.items() for f, spots in rows], ddl).repartition(3)
    got = {}
    for r in identities.track_animals(df, n, 25.0).collect():
        got.setdefault(r.session, []).append((r.frame, r.animal, r.x, r.y, r.status, r.corrections))
    for s, rows in sessions.items():
        want = [(f, a, None if math.isnan(x) else x, None if math.isnan(y) else y, *rest) for f, a, x, y, *rest in followed(rows, n, 25.0)]
        mine = [(f, a, x and round(x, 6), y and round(y, 6), *rest) for f, a, x, y, *rest in sorted(got[s])]
        assert mine == sorted(want, key=lambda r: r[:2])
    assert sum(max(r[5] for r in rows) for rows in got.values()) > 0  # looks undid swaps


def test_track_animals_of_odd_frames(spark):
    ddl = "session string, frame long, spots array<struct<x:double,y:double>>"
    rows = [("a", 0, None), ("a", 1, []), ("a", 2, [(1.0, 1.0), (None, 2.0)]), ("a", 3, [(9.0, 1.0), (2.0, 1.0)]), ("a", 4, [(float("nan"), 0.0)]), (None, 0, [(5.0, 5.0), (4.0, 4.0), (6.0, 6.0)])]
    got = sorted(((r.session or "", r.frame, r.animal, r.x, r.status) for r in identities.track_animals(spark.createDataFrame(rows, ddl), 2, 3.0).collect()))
    assert got[:2] == [("", 0, 0, 4.0, "ok"), ("", 0, 1, 5.0, "ok")]
    assert [r[3:] for r in got[2:8]] == [(None, "lost")] * 4 + [(1.0, "partial")] * 2
    assert [r[4] for r in got[8:]] == ["ok", "ok", "lost", "lost"] and {r[3] for r in got[8:10]} == {2.0, 9.0} == {r[3] for r in got[10:]}
    assert identities.track_animals(spark.createDataFrame([], ddl), 2, 3.0).count() == 0


def test_fifty_spots_a_frame_in_bounded_time():
    import time

    rng = np.random.default_rng(1)
    crew = identities.Crew(20, 5.0)
    began = time.time()
    for f in range(50):
        crew.step(f, [{"x": float(x), "y": float(y), "look": 1.0} for x, y in rng.uniform(0, 500, (50, 2))])
    assert time.time() - began < 5


# --- models with litters --------------------------------------------------------------------------------------------


def litter_rows(rng, litter_sd, subject_sd, dams=6, subjects=4):
    rows = []
    for dam in range(dams):
        for cage in range(2):
            own_cage = rng.normal(0, litter_sd)
            for s in range(subjects):
                own = rng.normal(0, subject_sd)
                for t in range(3):
                    for _ in range(int(rng.integers(0, 3))):
                        group = (dam + s) % 2
                        rows.append((f"{dam}.{cage}.{s}", f"d{dam}", f"c{cage}", "ab"[group], t, float(5 + own_cage + own + group * 1.5 + t * 0.7 + rng.normal())))
    return rows


LITTERS = "subject string, dam string, cage string, group string, timepoint int, value double"


def dense(rows):
    y = np.array([r[5] for r in rows])
    g, t = np.array([r[3] == "b" for r in rows], float), np.array([r[4] for r in rows])
    x = np.stack([np.ones(len(y)), g, t == 1, t == 2, g * (t == 1), g * (t == 2)], axis=1).astype(float)
    same = lambda keys: np.equal.outer(keys, keys).astype(float)
    subject, litter = same(np.array([r[0] for r in rows])), same(np.array([r[1] + r[2] for r in rows]))

    def at(rs, rb):
        v = np.eye(len(y)) + rs * subject + rb * litter
        vi = np.linalg.inv(v)
        beta = np.linalg.solve(x.T @ vi @ x, x.T @ vi @ y)
        s2 = float((y - x @ beta) @ vi @ (y - x @ beta)) / len(y)
        return len(y) * math.log(s2) + np.linalg.slogdet(v)[1], beta, s2, s2 * np.linalg.inv(x.T @ vi @ x)

    return x, y, subject, at


TERMS = ["Intercept", "group[b]", "time[1]", "time[2]", "group[b]:time[1]", "group[b]:time[2]"]


def test_litters_against_dense_matrices(spark):
    rows = litter_rows(np.random.default_rng(4), 1.5, 1.0)
    df = spark.createDataFrame([*rows, (None, "d", "c", "a", 1, 3.0), ("x", None, "c", "a", 1, 9.0)], LITTERS)
    got = {r.term: r for r in mixed.nested_effects(df, "dam", "cage").collect()}
    _, _, _, at = dense(rows)
    within = got["variance within"].estimate
    rs, rb = got["variance between"].estimate / within, got["variance of litters"].estimate / within
    low, beta, s2, cov = at(rs, rb)
    assert rs > 0 and rb > 0
    assert low <= min(at(rs * a, rb * b)[0] for a in (0.9, 1, 1.1) for b in (0.9, 1, 1.1)) + 1e-9
    assert math.isclose(within, s2, rel_tol=1e-6)
    for i, term in enumerate(TERMS):
        r = got[term]
        assert math.isclose(r.estimate, beta[i], rel_tol=1e-6) and math.isclose(r.se, math.sqrt(cov[i, i]), rel_tol=1e-6)
        assert math.isclose(r.high - r.low, 2 * 1.959963984540054 * r.se) and (r.q is None if i == 0 else r.q >= r.p)
    assert got["Intercept"].litters == "variance of dam > cage included" and got["Intercept"].model.endswith("(1 | subject) + (1 | dam:cage)")


def test_litters_that_can_not_be_modeled(spark):
    rng = np.random.default_rng(14)
    rows = litter_rows(rng, 0.0, 2.0)
    level = {}
    for r in rows:
        level.setdefault(r[1] + r[2], []).append(r[5] - 1.5 * (r[3] == "b") - 0.7 * r[4])
    flat = [(*r[:5], r[5] - float(np.mean(level[r[1] + r[2]]))) for r in rows]  # litters without differences
    got = {r.term: r for r in mixed.nested_effects(spark.createDataFrame(flat, LITTERS), "dam", "cage").collect()}
    assert got["Intercept"].litters == "not modeled (singular litter variance)" and "variance of litters" not in got and got["variance between"].estimate > 0
    plain = {r.term: r for r in mixed.mixed_effects(spark.createDataFrame(flat, LITTERS)).collect()}
    assert all(math.isclose(plain[t].estimate, got[t].estimate, rel_tol=1e-6, abs_tol=1e-9) for t in TERMS)
    one = spark.createDataFrame(rows, LITTERS).withColumn("dam", F.lit("d"))
    assert mixed.nested_effects(one, "dam").first().litters == "not modeled (a single litter)"
    mixed_up = [(r[0], f"d{i % 3}", *r[2:]) for i, r in enumerate(rows)]
    assert mixed.nested_effects(spark.createDataFrame(mixed_up, LITTERS), "dam").first().litters == "not modeled (a subject in several litters)"
    assert mixed.nested_effects(one.limit(0), "dam").count() == 0


def test_errors_clustered_by_subject(spark):
    rng = np.random.default_rng(5)
    rows = [(str(s), "d", "c", "ab"[s % 2], t, float(v - noise)) for s in range(16) for t in range(3) for noise in [0.0] for v in [s % 2 + t * 0.5 + (-1) ** t * rng.normal()]]
    means = {}
    for r in rows:
        means.setdefault(r[0], []).append(r[5])
    rows = [(*r[:5], r[5] - float(np.mean(means[r[0]])) + (r[3] == "b")) for r in rows]  # subjects of equal means
    got = {r.term: r for r in mixed.nested_effects(spark.createDataFrame(rows, LITTERS)).collect()}
    x, y, subject, _ = dense(rows)
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ beta
    bread = np.linalg.inv(x.T @ x)
    meat = x.T @ (subject * np.outer(e, e)) @ x
    cov = 16 / 15 * (len(y) - 1) / (len(y) - 6) * bread @ meat @ bread
    for i, term in enumerate(TERMS):
        assert math.isclose(got[term].estimate, beta[i], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(got[term].se, math.sqrt(max(cov[i, i], 0)), rel_tol=1e-6, abs_tol=1e-7)
    assert got["Intercept"].estimation.startswith("least squares") and "variance between" not in got


# --- bootstrap ------------------------------------------------------------------------------------------------------


def test_d_interval_against_a_loop_of_the_same_weights(spark):
    rng = np.random.default_rng(6)
    rows = [("m", g, round(float(rng.normal(1000 + 2 * (g == "b"), 2)), 1)) for g in "ab" for _ in range(60)] + [("one", "a", 1.0)] * 3 + [("flat", g, 1.0) for g in "aabb"] + [("m", "c", 1.0), ("m", "a", None)]
    df = spark.createDataFrame(rows, "metric string, group string, value double")
    got = {r.metric: (r.low, r.high) for r in resampling.d_interval(df, 300, 7).collect()}
    assert set(got) == {"m", "flat"} and got["flat"] == (None, None)
    values = {g: sorted(v for k, h, v in rows if k == "m" and h == g and v is not None) for g in "ab"}
    keys = {(r.group, r.value): r.key for r in spark.createDataFrame([("m", g, float(v)) for g in "ab" for v in set(values[g])], "metric string, group string, value double").withColumn("key", F.xxhash64("metric", "group", "value")).collect()}
    each = []
    w = {g: {v: resampling.weights(keys[g, v], values[g].count(v), 300, 7) for v in set(values[g])} for g in "ab"}
    for draw in range(300):
        sample = {g: np.repeat(list(w[g]), [int(x[draw]) for x in w[g].values()]) for g in "ab"}
        a, b = sample["a"], sample["b"]
        pooled = math.sqrt((((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()) / (len(a) + len(b) - 2))
        each.append((a.mean() - b.mean()) / pooled)
    assert np.allclose(got["m"], np.percentile(each, [2.5, 97.5]), rtol=1e-8)
    again = {r.metric: (r.low, r.high) for r in resampling.d_interval(df.repartition(7), 300, 7).collect()}
    assert np.allclose(again["m"], got["m"], rtol=1e-9)
    found = {r.metric: r for r in comparison.compare_groups(df.filter("group <> 'c'")).collect()}
    assert found["m"].effect_low < found["m"].effect < found["m"].effect_high < 0 and found["one"].effect_low is None
    local = statistics.bootstrap_d(np.array(values["a"]), np.array(values["b"]))
    assert np.allclose(local, (found["m"].effect_low, found["m"].effect_high), atol=0.15)


# --- statistics in one call -----------------------------------------------------------------------------------------


def test_statistics_in_one_call(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(f"s{s}", "ab"[s % 2], f"d{s % 4}", t, float(rng.normal(s % 2, 1)), s, "text") for s in range(20) for t in (1, 2) for _ in range(2)]
    df = spark.createDataFrame(rows, "Animal string, Group string, Dam string, Timepoint int, `time in zone` double, score int, note string").withColumn("empty", F.lit(float("nan")))
    assert advanced.roles(df) == {"subject": "Animal", "group": "Group", "timepoint": "Timepoint", "dam": "Dam"}
    assert advanced.metric_names(df) == ["time in zone", "score"]
    found = advanced.run(df, str(tmp_path), ["time in zone"])
    assert list(found) == ["audit", "subjects", "repeated", "mixed", "between", "methods"]
    means = {(r.Animal, r.Timepoint): r["time in zone"] for r in found["subjects"].collect()}
    assert len(means) == 40 and math.isclose(means["s3", "2"], np.mean([r[4] for r in rows if r[0] == "s3" and r[3] == 2]))
    change = found["repeated"].first()
    assert (change.metric, change["from"], change.to, change.n, change.test) == ("time in zone", "1", "2", 20, "paired t") and change.low < change.change < change.high
    assert {r.metric for r in found["mixed"].collect()} == {"time in zone"} and found["between"].first().test in ("Welch t-test", "Mann-Whitney U")
    assert {r.role: r.distinct for r in found["audit"].collect()} == {"subject": 20, "group": 2, "timepoint": 2, "dam": 4}
    assert len(list((tmp_path / "between").glob("*.csv"))) == 1 and "Animal" in dict(advanced.methods(df))["Columns"]
    bare = df.select("`time in zone`", "Group")
    assert list(advanced.run(bare)) == ["audit", "between", "methods"] and "One row" in dict(advanced.methods(bare))["Experimental unit"]
    three = df.unionByName(df.filter("Timepoint = 1").withColumn("Timepoint", F.lit(3)).withColumn("time in zone", F.col("time in zone") + 1))
    assert advanced.repeated_measures(three, ["time in zone"]).first().test == "Friedman"
    with pytest.raises(ValueError):
        advanced.subject_levels(bare)


# --- discs and smoothed maps ----------------------------------------------------------------------------------------


def inside(px, py, polygon):
    odd = np.zeros(px.shape, bool)
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1]):
        if ay != by:
            odd ^= ((ay > py) != (by > py)) & (px < ax + (py - ay) * (bx - ax) / (by - ay))
    return odd


def test_disc_fractions_against_a_fine_grid(spark):
    rng = np.random.default_rng(3)
    polygons = [[(0.0, 0.0), (40.0, 0.0), (40.0, 30.0), (0.0, 30.0)], [(0.0, 0.0), (30.0, 5.0), (12.0, 12.0), (25.0, 40.0), (-10.0, 20.0)], [(5.0, 5.0), (5.0, 25.0), (45.0, 5.0)]]
    places = [(float(x), float(y)) for x, y in rng.uniform(-15, 55, (40, 2))] + [(0.0, 0.0), (20.0, 15.0), (40.0, 30.0), (20.0, 0.0), (300.0, 300.0)]
    zones = spark.createDataFrame([(i, f"z{i}", p) for i, p in enumerate(polygons)], "place int, zone string, polygon array<struct<x:double,y:double>>")
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(places)] + [(99, None, 1.0), (98, math.nan, 1.0)], "frame int, x double, y double")
    got = {(r.frame, r.zone): r.fraction for r in geometry.disc_fractions(df, zones, 9.6).collect()}
    step = np.linspace(-10, 10, 801)
    gx, gy = np.meshgrid(step, step)
    disc = gx**2 + gy**2 <= 100
    for i, (x, y) in enumerate(places):
        for k, polygon in enumerate(polygons):
            want = inside(gx[disc] + x, gy[disc] + y, polygon).mean()
            assert abs(got[i, f"z{k}"] - want) < 4e-3, (x, y, k)
    assert got[99, "z0"] is None and got[98, "z1"] is None and got[len(places) - 1, "z0"] < 1e-12
    areas = [r[0] for r in zones.select(geometry.polygon_area(F.col("polygon"))).collect()]
    assert areas[0] == 1200 and areas[2] == 400
    assert [r.zone for r in geometry.body_zones(zones, 10.0).collect()] == ["z0", "z1", "z2"] and [r.zone for r in geometry.body_zones(zones, 15.0).collect()] == ["z0"]


def test_shares_of_hidden_and_lost_frames(spark):
    zones = spark.createDataFrame([(0, "Dark", [(0.0, 0.0), (50.0, 0.0), (50.0, 50.0), (0.0, 50.0)]), (1, "Light", [(50.0, 0.0), (100.0, 0.0), (100.0, 50.0), (50.0, 50.0)]), (2, "Slit", [(0.0, 0.0), (9.0, 0.0), (9.0, 2.0), (0.0, 2.0)])], "place int, zone string, polygon array<struct<x:double,y:double>>")
    rows = [(1, 0, 0.0, 50.0, 25.0, "Tracked", None), (1, 1, 1.0, 50.0, 25.0, "Hidden", "Dark"), (1, 2, 2.0, 50.0, 25.0, "Hidden", None), (1, 3, 3.0, None, None, "Lost", None)]
    df = spark.createDataFrame(rows, "session int, frame int, time_s double, x double, y double, status string, hidden_zone string")
    shares = geometry.body_shares(df, zones, 10.0)
    assert {(r.frame, r.zone): r.share if r.share is None else round(r.share, 9) for r in shares.collect()} == {
        (0, "Dark"): 0.5, (0, "Light"): 0.5, (1, "Dark"): 1.0, (1, "Light"): 0.0, (2, "Dark"): None, (2, "Light"): None, (3, "Dark"): None, (3, "Light"): None
    }
    assert [tuple(r) for r in geometry.covered_zones(shares).collect()] == [(1, "Dark")]


@pytest.mark.parametrize("bins,sigma", [(12, 1.2), (3, 1.2), (2, 3.0), (7, 0.4)])
def test_smoothed_counts_against_a_mirrored_grid(spark, bins, sigma):
    rng = np.random.default_rng(bins)
    grid = rng.integers(0, 5, (bins, bins)) * (rng.random((bins, bins)) < 0.5)
    grid[0, 0] = 3
    reach = int(4 * sigma + 0.5)
    k = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma**2))
    want = np.pad(grid.astype(float), reach, mode="symmetric")
    for axis in (0, 1):
        want = np.apply_along_axis(lambda v: np.convolve(v, k / k.sum(), "valid"), axis, want)
    cells = spark.createDataFrame([(i, j, int(grid[i, j])) for i in range(bins) for j in range(bins) if grid[i, j]], "bin_x long, bin_y long, frames long")
    got = np.zeros((bins, bins))
    for r in geometry.smoothed_counts(cells, bins, sigma).collect():
        got[r.bin_x, r.bin_y] = r.heat
        assert math.isclose(r.share, r.heat / want.max(), rel_tol=1e-9)
    assert np.allclose(got, want)
    assert geometry.smoothed_counts(cells.limit(0), bins, sigma).count() == 0


# --- names of measures ----------------------------------------------------------------------------------------------


def described(spark, names, test=None):
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "measure string, seq int")
    return {r.measure: r for r in glossary.describe(df, test).collect()}


def test_zones_told_by_names(spark):
    names = ["Arm_time_s", "Arm_percent", "Arm_A_time_s", "Arm_A_percent", "Arm_A_entries", "Arm_entries", "Arm_latency_s", "Light_time_s", "Thigmotaxis_border_time_s", "Thigmotaxis_border_percent", "Arm_A_latency_s", "Lone_time_s", "A_time_s_time_s", "A_time_s_percent"]
    got = described(spark, names)
    of = {n: (r.zone, r.field) for n, r in got.items()}
    assert of["Arm_A_entries"] == ("Arm_A", "entries") and of["Arm_entries"] == ("Arm", "entries") and of["Arm_latency_s"] == ("Arm", "latency_s")
    assert of["Lone_time_s"] == (None, None) and of["Thigmotaxis_border_time_s"] == (None, None) and of["A_time_s_time_s"] == ("A_time_s", "time_s") and of["A_time_s_percent"] == ("A_time_s", "percent")
    assert got["Light_time_s"].label == "Time in light (s)" and got["Light_time_s"].zone is None and got["Lone_time_s"].label == "Lone time (s)"
    times = sorted((r.place, n) for n, r in got.items() if r.sheet == "time")
    assert [n for _, n in times] == ["Arm_time_s", "Arm_A_time_s", "A_time_s_time_s", "Arm_percent", "Arm_A_percent", "A_time_s_percent", "Light_time_s"]
    assert got["Arm_A_latency_s"].sheet == "distance" and got["Arm_A_entries"].label == "Arm A – entries"


def test_families_of_names(spark):
    names = ["Trans_None_to_A", "Trans_A_to_B_c", "Trans_A_to_None", "North_arm_entries", "South_arm_entries", "South_time_s", "South_percent", "South_entries", "Cup_exploration_s", "Preference_index_A_vs_B_1", "Discrimination_ratio_A_vs_B", "Anxiety_index", "My_value_cm", "plain", "Total_transitions"]
    got = described(spark, names, "epm")
    assert got["Trans_None_to_A"].label == "(start / outside the zones) → A" and got["Trans_None_to_A"].sheet is None and got["Trans_A_to_None"].place is None
    assert got["Trans_A_to_B_c"].label == "A → B c" and got["Trans_A_to_B_c"].sheet == "entries"
    assert got["South_arm_entries"].sheet is None and got["North_arm_entries"].sheet == "entries" and got["North_arm_entries"].label == "North arm entries"
    assert got["Cup_exploration_s"].label == "Cup exploration (s)" and got["Cup_exploration_s"].sheet == "time"
    assert got["Preference_index_A_vs_B_1"].formula == "(A time - B 1 time) / (sum of both)" and got["Discrimination_ratio_A_vs_B"].formula == "A / (A + B)"
    assert "open arms" in got["Anxiety_index"].formula and "exposed" in described(spark, ["Anxiety_index"])["Anxiety_index"].formula
    assert (got["My_value_cm"].label, got["My_value_cm"].sheet, got["plain"].meaning) == ("My value (cm)", "other", "")
    assert described(spark, []) == {}


# --- classifiers ----------------------------------------------------------------------------------------------------


def test_balanced_draw_does_not_depend_on_layout(spark):
    df = spark.range(30_000).select((F.col("id") % 7).alias("session"), F.col("id").alias("frame"), (F.col("id") % 10 == 0).alias("truth"))
    got = classifier.drawn(df, "truth", 1000).collect()
    assert sum(r.truth for r in got) == 500 == sum(not r.truth for r in got)
    again = classifier.drawn(df.repartition(9, "frame"), "truth", 1000).collect()
    assert {r.frame for r in got} == {r.frame for r in again}
    few = classifier.drawn(df.filter("frame < 40"), "truth", 1000)
    assert few.count() == 40 and classifier.drawn(df.limit(0), "truth").count() == 0


def test_fits_do_not_grow_with_sessions(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(s, f, [float(f % 2 + rng.normal(0, 0.3)), float(rng.normal())], f % 2 == 1) for s in range(40) for f in range(12)]
    df = spark.createDataFrame(rows, "session int, frame int, features array<double>, truth boolean")
    folds = {}
    for r in classifier.with_folds(df, 10.0).select("session", "fold").distinct().collect():
        folds.setdefault(r.fold, []).append(r.session)
    assert sorted(folds) == list("01234") and {len(v) for v in folds.values()} == {8}
    fits, train = [], classifier.train
    monkeypatch.setattr(classifier, "train", lambda *a, **k: fits.append(1) or train(*a, **k))
    found = classifier.cross_validate(df, "truth", 10.0, trees=5).first()
    assert len(fits) == 5 == found.folds and found.f1 > 0.9


def test_behaviours_by_session(spark):
    bouts = spark.createDataFrame([(1, "rear", 2.0, 3.5), (1, "rear", 5.0, 5.5), (2, "groom", 1.25, 2.0)], "session int, behaviour string, start double, stop double")
    sessions = spark.createDataFrame([(1, 1.0, 10.0), (2, 0.0, 0.0), (3, 0.0, 4.0)], "session int, begin double, length double")
    got = {(r.session, r.behaviour): tuple(r)[2:] for r in classifier.behaviour_summary(bouts, sessions, ["rear", "groom"]).collect()}
    assert got[1, "rear"] == (10.0, 2.0, 20.0, 2, 1.0) and got[3, "groom"] == (4.0, 0.0, 0.0, 0, None) and got[2, "groom"][3:] == (1, 1.25) and len(got) == 6


# --- streams --------------------------------------------------------------------------------------------------------

LIVE = "session long, frame long, time_s double, x double, y double, zone string, command string"


def live_rows(n, session, start=0):
    return [(session, f, f * 0.5, float(f * 10), 0.0, "AB"[f // 4 % 2], None) for f in range(start, n)]


def test_sessions_with_timers_and_stop_rules(spark, tmp_path):
    sessions.use_rocksdb(spark)
    steps = [
        live_rows(6, 1) + live_rows(3, 2),
        live_rows(10, 1, 5) + [(2, 3, 1.5, None, None, None, "stop")] + [(3, f, float(f), float(f), 0.0, "A", None) for f in range(30)],  # frame 5 of 1 comes twice
        [(2, 9, 9.0, 1.0, 1.0, "A", None)] + live_rows(2, 4),
    ]
    for rows in steps:  # a batch each, in the order of writing
        spark.createDataFrame(rows, LIVE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LIVE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rules = sessions.StopRules(seconds=20.0, zone="A", entries=1, together=True)
    seen = []
    out = sessions.live_sessions(stream, 5.0, 8.0, rules)
    q = out.writeStream.foreachBatch(lambda b, i: seen.extend(b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).start()
    ends = {(1, "expired"), (2, "gone"), (3, "gone"), (4, "expired")}
    deadline = time.time() + 60
    while time.time() < deadline and not ends <= {(r.session, r.phase) for r in seen} and q.isActive:
        time.sleep(0.5)
    time.sleep(1)
    q.stop()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    last = {(r.session, r.phase, r.zone): r for r in seen}
    one = last[1, "expired", "A"]
    assert (one.frames, one.late, one.entries, one.distance) == (10, 1, 2, 90.0) and last[1, "expired", "B"].seconds == 2.0 and one.seconds == 2.5
    assert last[2, "stopped", "A"].frames == 3 and last[2, "gone", None].late == 1
    stopped = last[3, "stopped", "A"]
    assert stopped.frames == 21 and stopped.seconds == 20.0 and last[3, "gone", None].late == 9
    for name in ("walk", "ended"):
        assert spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "ck")).count() == 0


def test_delayed_tracker_with_replayed_batches(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for s in (1, 2):
        x = y = 50.0
        for f in range(100 + 30 * s):
            x, y = min(99.0, max(1.0, x + rng.uniform(-9, 9))), min(99.0, max(1.0, y + rng.uniform(-9, 9)))
            lost = rng.random() < 0.1
            rows.append((s, f, f / 10, None if lost else x, None if lost else y, "Lost" if lost else "Tracked"))
    places = spark.createDataFrame([(0, "Left", [(0.0, 0.0), (50.0, 0.0), (50.0, 100.0), (0.0, 100.0)]), (1, "Right", [(50.0, 0.0), (100.0, 0.0), (100.0, 100.0), (50.0, 100.0)])], "place int, zone string, polygon array<struct<x:double,y:double>>")
    analysis = delayed.Analysis(places, 10.0)
    tracker = delayed.DelayedTracker(str(tmp_path / "live"), analysis, 10.0, piece_s=2.0, pause=0.0)
    df = spark.createDataFrame(rows, delayed.FRAMES)
    key = lambda d: sorted((r.session, r.zone, r.entries, *(round(v, 6) for v in (r.time_s, r.percent, r.distance, r.tracked))) for r in d.collect())
    parts = [df.filter(F.col("frame").between(a, a + 39)) for a in (0, 40, 80, 120)]
    for i in (0, 1, 1, 0, 2, 3, 3):  # batches that run again
        tracker.keep(parts[i], i)
    tracker.keep(parts[2].filter("frame < 90"), 4)  # frames that come again
    assert key(tracker.final(spark)) == key(analysis(df))
    assert tracker.frames(spark).count() == len(rows)
    want = analysis(df.filter("(session = 1 AND frame < 120) OR (session = 2 AND frame < 140)"))  # the last frame begins no whole piece
    assert key(tracker.numbers(spark)) == key(want)
    assert key(spark.read.parquet(str(tmp_path / "live/numbers")).filter("batch = 4")) == key(want)
    assert {r.session: (r.recorded_s, r.processed_s, round(r.remaining_s, 6)) for r in tracker.status(spark).collect()} == {1: (13.0, 12.0, 1.0), 2: (16.0, 14.0, 2.0)}


def test_delayed_tracker_as_a_stream(spark, tmp_path):
    rows = [(1, f, f / 10, float(f % 60), 5.0, "Tracked") for f in range(90)]
    places = spark.createDataFrame([(0, "Left", [(0.0, 0.0), (30.0, 0.0), (30.0, 10.0), (0.0, 10.0)])], "place int, zone string, polygon array<struct<x:double,y:double>>")
    df = spark.createDataFrame(rows, delayed.FRAMES)
    for part in ("frame < 30", "frame BETWEEN 30 AND 59", "frame >= 60"):
        df.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    analysis = delayed.Analysis(places, 10.0)
    tracker = delayed.DelayedTracker(str(tmp_path / "live"), analysis, 10.0, piece_s=1.0, pause=0.0)
    stream = spark.readStream.schema(delayed.FRAMES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    tracker.start(stream, str(tmp_path / "ck"), availableNow=True).awaitTermination(120)
    assert tracker.final(spark).collect() == analysis(df).collect()
    assert sorted(r.batch for r in spark.read.parquet(str(tmp_path / "live/numbers")).select("batch").distinct().collect()) == [0, 1, 2]


# --- head and tail --------------------------------------------------------------------------------------------------


def whole_path(rows, fps):
    """The cheapest orientations of a session by one pass over all of its frames."""
    at = [i for i, r in enumerate(rows) if r[4] is not None]
    size = max(float(np.median([math.dist(rows[i][4:6], rows[i][6:8]) for i in at])), 4.0)
    k, n = max(1, round(0.2 * fps)), len(rows)
    cost, came, last = None, [], None
    for i in at:
        ends, lo, hi = rows[i][4:8], max(i - k, 0), min(i + k, n - 1)
        evidence = -1.5 * rows[i][8] + 0.5 * rows[i][9]
        if rows[lo][2] is not None and rows[hi][2] is not None:
            v = [(rows[hi][c] - rows[lo][c]) / ((hi - lo) / fps) for c in (2, 3)]
            along, speed = (ends[0] - ends[2], ends[1] - ends[3]), math.hypot(*v)
            if speed > 0:
                evidence += 1.2 * (along[0] * v[0] + along[1] * v[1]) / (math.hypot(*along) * speed) * min(1, speed / (1.5 * size))
        own = (-evidence, evidence)
        if cost is None:
            cost, here = list(own), [0, 1]
        else:
            a, b = rows[last][4:8], ends
            link = 2.0 / (1 + 0.5 * max(i - last - 1, 0)) / size
            kept = link * (math.dist(a[:2], b[:2]) + math.dist(a[2:], b[2:]))
            swapped = link * (math.dist(a[:2], b[2:]) + math.dist(a[2:], b[:2]))
            steps = [[cost[0] + kept, cost[1] + swapped], [cost[0] + swapped, cost[1] + kept]]
            here = [min((0, 1), key=lambda s: steps[t][s]) for t in (0, 1)]  # noqa: B023
            cost = [min(steps[t]) + own[t] for t in (0, 1)]
        came.append(here)
        last = i
    state, out = min((0, 1), key=lambda s: cost[s]), {}
    for i, here in zip(reversed(at), reversed(came)):
        e = rows[i][4:8]
        out[rows[i][1]] = e if state == 0 else (*e[2:], *e[:2])
        state = here[state]
    return out


@pytest.mark.parametrize("block", [1, 7, 64, 10_000])
def test_head_and_tail_by_blocks_is_that_of_the_whole_session(spark, block):
    rng = np.random.default_rng(17)
    rows = {}
    for s in (1, 2):
        centre, turn = rng.normal(0, 3, (200, 2)).cumsum(axis=0), rng.normal(0, 0.4, 200).cumsum()
        for i in range(200):
            half = np.array([math.cos(turn[i]), math.sin(turn[i])]) * 8 * (1 if rng.random() < 0.7 else -1)
            a, b = centre[i] + half, centre[i] - half
            gone = rng.random() < 0.15
            place = (None, None) if rng.random() < 0.05 else tuple(map(float, centre[i]))
            rows.setdefault(s, []).append((s, i, *place, *((None,) * 4 if gone else map(float, (*a, *b))), float(rng.normal(0, 0.3)), float(rng.normal())))
    ddl = "session long, frame long, x double, y double, ax double, ay double, bx double, by double, tail_ev double, shape_ev double"
    df = spark.createDataFrame([r for s in rows.values() for r in s], ddl)
    got = {(r.session, r.frame): tuple(r)[2:] for r in body.head_and_tail(df, 10.0, block=block).collect()}
    assert len(got) == 400
    for s, listed in rows.items():
        want = whole_path(listed, 10.0)
        assert sum(listed[f][4:8] != e for f, e in want.items()) > 10  # some are the other way round
        for r in listed:
            assert got[s, r[1]] == tuple(want.get(r[1], (None,) * 4))
    assert body.head_and_tail(df.limit(0), 10.0).count() == 0
