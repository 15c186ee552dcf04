"""Faults that came up on larger tables, in small."""

import itertools
import math
import random
import time

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from vivarium.operators import animals, geometry, identities, interactions, mazes, mixed, ranks, runs, summary, zones
from vivarium.operators import statistics as st
from vivarium.sources import tables as tb


def test_scoring_of_sessions_without_spread(spark):
    """Bins whose shares are all alike have no correlation, beside a session that has one."""
    rows = [(s, i, float(i), s == 1 or (i // 10 + i) % 3 == 0) for s in (1, 2) for i in range(60)]
    frames = spark.createDataFrame(rows, "session long, frame long, time_s double, auto boolean")
    bouts = spark.createDataFrame([(s, 10.0 * k, 10.0 * k + k) for s in (1, 2) for k in range(1, 6)], "session long, start double, stop double")
    got = {r.session: r for r in st.compare_scoring(frames, bouts, 1.0).collect()}
    assert got[1].bins == got[2].bins == 6 and got[1].bin_r is None
    a = [100 * sum(f[3] for f in rows if f[0] == 2 and f[1] // 10 == b) / 10 for b in range(6)]
    h = [10.0 * k for k in range(6)]
    ma, mh = sum(a) / 6, sum(h) / 6
    r = sum((x - ma) * (y - mh) for x, y in zip(a, h)) / math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mh) ** 2 for y in h))
    assert abs(got[2].bin_r - r) < 1e-9


def test_equal_sets_of_values_have_equal_means_and_ranks(spark):
    """Copies of subjects whose rows come in other orders are tied, and no row is lost."""
    values = [0.1, 0.7, 0.2, 1e9, 0.3, 0.6]
    rows = [(10 * c + g, "ab"[g], v + g) for c in range(6) for g in (0, 1) for v in values[c:] + values[:c]]
    df = spark.createDataFrame(rows, "subject long, group string, price double").coalesce(1)
    long = st.subject_means(df, ["price"])
    assert [(r.tied, r["rank"]) for r in ranks.value_ranks(long, ["metric"]).orderBy("value").collect()] == [(6, 3.5), (6, 9.5)]
    assert ranks.mann_whitney(long, "a", "b").first().u == 0
    sums = {r.group: (r.n, r["sum"]) for r in ranks.rank_sums(long).collect()}
    assert sums == {"a": (6, 21), "b": (6, 57)}


def test_raters_add_up_in_the_order_of_the_file(spark, tmp_path):
    """Means are those of a plain loop over the file, however it is split."""
    n = 4000
    discount = [(7 * i * i + i // 3) % 11 / 100 for i in range(n)]
    table = pa.table({"l_suppkey": [i % 3 for i in range(n)], "l_shipdate": pa.array([0] * n, pa.timestamp("us")), "l_quantity": [float(i % 50) for i in range(n)], "l_discount": discount})
    pq.write_table(table, tmp_path / "lineitem.parquet", row_group_size=100)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r.subject: r.b for r in tb.raters(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for s in range(3):
        total = 0.0
        for v in discount[s::3]:
            total += v
        assert got[s] == total / len(discount[s::3]) * 500


def test_outlines_are_judged_in_batches_as_column_by_column(spark):
    """No expression by row and side in the plan, the same answers, nulls and NaN too."""
    shapes = [(0, "L", [(0.0, 0.0), (9.0, 0.0), (9.0, 3.0), (4.0, 3.0), (4.0, 9.0), (0.0, 9.0)]), (1, "kite", [(5.0, 1.0), (9.0, 5.0), (5.0, 9.0), (5.0, 9.0), (2.0, 5.0)])]
    places = spark.createDataFrame(shapes, "place int, zone string, polygon array<struct<x:double,y:double>>")
    rows = [(x, y) for x in range(-1, 11) for y in range(-1, 11)] + [(None, 1), (1, None)]
    df = spark.createDataFrame([(None if x is None else float(x), None if y is None else float(y)) for x, y in rows] + [(math.nan, 1.0)], "x double, y double")
    flags = zones.zone_flags(df, places)
    got = sorted((str(r.x), str(r.y), r.zone, r.inside) for r in flags.collect())
    at = zones.in_polygon(F.col("x"), F.col("y"), F.col("polygon"))
    want = df.join(places).select("x", "y", "zone", F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), at).alias("inside"))
    assert got == sorted((str(r.x), str(r.y), r.zone, r.inside) for r in want.collect())
    assert "lambda" not in flags._jdf.queryExecution().toString()
    assert "lambda" not in geometry.disc_fractions(df, places, 3.0)._jdf.queryExecution().toString()
    near = interactions.near_objects(df.withColumns({"session": F.lit(1), "frame": F.lit(1)}), places, 2.0)
    assert "lambda" not in near._jdf.queryExecution().toString()


def test_debounced_states_need_one_order_of_rows(spark):
    flags = [i % 7 < 3 or i % 11 == 0 for i in range(60)]
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate(flags)], "session int, frame int, flag boolean")
    for least in (1, 2, 3, 4):
        out = runs.debounced(df, ["session"], "frame", "flag", least)
        state, want, at = None, [], 0
        for value, run in itertools.groupby(flags):
            n = len(list(run))
            state = value if n >= least or at == 0 else state
            want += [state] * n
            at += n
        assert [r.state for r in out.orderBy("frame").collect()] == want
        assert out._jdf.queryExecution().executedPlan().toString().count("Sort [session") == 1


def test_open_field_tells_zones_without_a_job(spark):
    table = spark.createDataFrame([(1, "Center", 2.0, 1, 3.0, 0.5), (1, "Rim", 5.0, 2, 4.0, 1.0), (2, "Rim", 5.0, 2, 4.0, None)], "session int, zone string, time_s double, entries long, distance double, latency_s double")
    parts = spark.createDataFrame([(1, 1, 2), (2, 0, 2)], "session int, a long, b long")
    totals = spark.createDataFrame([(1, 10.0, 8.0, 7.0), (2, 10.0, 8.0, 7.0)], "session int, total_s double, present_s double, distance double")
    spark.sparkContext.setJobGroup("open field", "")
    out = mazes.open_field(table, parts, totals)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("open field")
    got = {r.session: r for r in out.collect()}
    assert (got[1].centre_s, got[1].periphery_s, got[1].latency_to_centre_s) == (2.0, 5.0, 0.5) and (got[2].centre_s, got[2].periphery_s, got[2].centre_entries) == (0.0, 5.0, 0)


def test_wide_tables_rank_large_groups_in_all_tasks(spark, monkeypatch):
    """Values of few groups aren't gathered by group before they are ranked, and ties are cut where a block of rows ends."""
    monkeypatch.setattr(summary, "ROWS", 4)
    values = {"a": [2.0] * 11 + [1.0, 5.0], "b": [0.5 * (i // 3) for i in range(20)], "c": [3.0], "unlisted": [float(i) for i in range(30)]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in [*vs, None]], "g string, v double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.row: (r.a, r.b, r.c) for r in summary.prism(df, "g", "v", ["a", "b", "c"]).collect()}
        counts = df.dropna().groupBy("g", "v").agg(F.count("*").alias("tied"))
        plan = ranks.in_ranges(counts, ["g"], "v")._jdf.queryExecution().executedPlan().toString()
        joined = ranks.in_ranges(counts, ["g"], "v", few=False)
        assert "SortMergeJoin" not in plan and "lambda" not in plan
        assert sorted(joined.collect()) == sorted(ranks.in_ranges(counts, ["g"], "v").collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    at = lambda g, k: sorted(values[g])[k - 1] if k <= len(values[g]) else None
    assert got == {k: (at("a", k), at("b", k), at("c", k)) for k in range(1, 31)}


def test_passes_of_mixed_models_read_few_parts(spark, monkeypatch):
    """Sums by subject size are those of a plain loop, in one part however many the shuffle has, and so are litters."""
    monkeypatch.setattr(mixed, "HELD", 40)  # a matrix or two at a time
    rows = [(f"s{s}", f"d{s % 3}", "ab"[s % 2], str(t), float(s * 3 + t * t)) for s in range(25) for t in range(3) for _ in range((s + t) % 4)]
    df = spark.createDataFrame(rows, "subject string, block string, group string, timepoint string, value double")
    sums = mixed.design_sums(mixed.cell_sums(df), True)
    assert sums.sizes.rdd.getNumPartitions() == sums.blocks.rdd.getNumPartitions() == 1
    k, want = len(sums.cells), {}
    for s in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == s]
        n, total = [sum((r[2], r[3]) == c for r in own) for c in sums.cells], sum(r[4] for r in own)
        for place, v in [*((i * k + j, n[i] * n[j]) for i in range(k) for j in range(k)), *((k * k + i, n[i] * total) for i in range(k)), (k * k + k, total * total), (k * k + k + 1, 1)]:
            want[len(own), place] = want.get((len(own), place), 0) + v
    got = {(r["size"], r.place): r.s for r in sums.sizes.collect()}
    sums.release()
    assert got == {key: v for key, v in want.items() if v}


def test_rows_without_a_subject_do_not_mix_litters(spark):
    rows = [(f"s{s}", f"d{s % 4}", "ab"[s % 2], t, float((7 * s + 5 * t) % 11 + s % 4)) for s in range(16) for t in range(2)] + [(None, "d0", "a", 0, 1.0), (None, "d1", "a", 0, 2.0)]
    df = spark.createDataFrame(rows, "subject string, dam string, group string, timepoint int, value double")
    a, b = ([r.asDict() for r in mixed.nested_effects(x, "dam").collect()] for x in (df, df.filter("subject IS NOT NULL")))
    assert a == b and "several litters" not in a[0]["litters"]


def test_subjects_of_mixed_models_are_put_in_turn_once(spark, monkeypatch):
    """Sums by litter are those of a plain loop where subjects are cut by batches, whatever their type, and tell subjects in several litters."""
    rng = random.Random(3)
    rows = [(s, f"d{s % 3}", "ab"[s % 2], str(t), rng.random()) for s in range(40) for t in range(3) for _ in range((s + t) % 4)]
    kinds = {"long": int, "string": str, "double": lambda s: s / 4, "struct<a:int,b:string>": lambda s: (s // 5, str(s % 5))}
    want = {}
    for s in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == s]
        for place, v in [*((("a0", "a1", "a2", "b0", "b1", "b2").index(r[2] + r[3]), 1) for r in own), (6, 1), (7, sum(r[4] for r in own))]:
            key = (own[0][1], len(own), place)
            want[key] = want.get(key, 0) + v
    monkeypatch.setattr(mixed, "HELD", 40)
    monkeypatch.setattr(mixed, "PART", 20, raising=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        for kind, f in kinds.items():
            df = spark.createDataFrame([(f(r[0]), *r[1:]) for r in rows], f"subject {kind}, block string, group string, timepoint string, value double")
            sums = mixed.design_sums(mixed.cell_sums(df), True)
            got = {(r.block, p["size"], p.place): p.s for r in sums.blocks.collect() for p in r.parts}
            sums.release()
            assert not sums.shared and got.keys() == want.keys() and all(math.isclose(got[k], v) for k, v in want.items())
            crossed = mixed.design_sums(mixed.cell_sums(df.unionByName(df.limit(1).withColumn("block", F.lit("other")))), True)
            crossed.release()
            assert crossed.shared
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_litters_take_few_jobs(spark, monkeypatch):
    """Whether subjects nest in several litters comes with the sums, not from passes over all cells (13 jobs more before, now 5)."""
    monkeypatch.setattr(mixed, "best_ratios", lambda sums, litters: (0.5, 0.5 * litters))
    rows = [(f"s{s}", f"d{s % 4}", "ab"[s % 2], t, float((7 * s + 5 * t) % 11 + s % 4)) for s in range(16) for t in range(2)]
    df = spark.createDataFrame(rows, "subject string, dam string, group string, timepoint int, value double")
    jobs = []
    for dam in (None, "dam"):
        spark.sparkContext.setJobGroup(f"litters {dam}", "")
        got = mixed.nested_effects(df, dam).collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"litters {dam}")))
        assert any(r.term == "variance of litters" for r in got) == bool(dam)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] - jobs[0] <= 6


def test_frames_of_few_animals_take_little_time():
    """20,000 frames of three animals that meet all the time, with looks that tell them apart."""
    rng = random.Random(1)
    frames = [[{"x": rng.random() * 500, "y": rng.random() * 100, "look": 40.0 * a + f % 7} for a in range(3)] for f in range(20_000)]
    crew, began = identities.Crew(3, 60.0), time.process_time()
    out = [crew.step(f, spots) for f, spots in enumerate(frames)]
    assert time.process_time() - began < 5
    assert {len(rows) for rows in out} == {3}
    for kept, ordered in zip(crew.looks.seen, crew.looks.ordered):
        assert len(kept) == animals.LOOK_FRAMES and sorted(kept) == ordered
    spots = animals.Spots(2)
    spots.step(0, [{"x": 1.0, "y": 1.0}, {"x": 9.0, "y": 9.0}, {"x": None, "y": 3.0}])
    assert [r[-1] for r in spots.step(1, [{"x": 9.0, "y": 9.0}, {"x": math.nan, "y": 1.0}])] == ["lost", "ok"]
