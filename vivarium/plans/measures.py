"""Queries of the behavioural tests, time bins, freezing results and what follows from them, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vivarium.operators import bins as bn
from vivarium.operators import freezing_result as fr
from vivarium.operators import mazes as mz
from vivarium.operators import zones as zn
from vivarium.plans.catalogue import FL, FPS, FS, L, H, M, MIN_FRAMES, S, T, V, Z, ZT, _motion, _runs_sql, _states, query, rounded, with_
from vivarium.sources import tables as tb


def zone_sql(listed) -> str:
    return "z(place, zone, x0, y0, x1, y1) AS (VALUES " + ", ".join(f"({i}, '{n}', {a}, {b}, {c}, {e})" for i, (n, a, b, c, e) in enumerate(listed)) + ")"


def arms_sql(arms: str, hub: str) -> str:
    """Arm entries by the centre: runs of the first arm, the hub, or neither; seq has what counts."""
    return f"""a0 AS (SELECT session, frame, any_value(time_s) AS time_s, CASE WHEN any_value(status) <> 'Lost' THEN coalesce(arg_min(zone, place) FILTER (inside AND {arms}), {hub}) END AS label FROM fl GROUP BY session, frame),
a1 AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY session ORDER BY frame) OR frame = 0 THEN 1 ELSE 0 END AS new FROM a0),
a2 AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY frame) AS run FROM a1),
a3 AS (SELECT session, run, any_value(label) AS label, count(*) AS n, min(time_s) AS t0 FROM a2 GROUP BY session, run HAVING any_value(label) IS NOT NULL AND count(*) >= 2),
a4 AS (SELECT *, lag(label) OVER (PARTITION BY session ORDER BY run) AS was FROM a3),
seq AS (SELECT session, t0 AS time_s, label AS zone FROM a4 WHERE label IS DISTINCT FROM was AND label <> '__HUB__')"""


SH = f"""sh AS (SELECT session, frame, time_s, place, zone, greatest(least(x + {tb.BODY}, x1) - greatest(x - {tb.BODY}, x0), 0) * greatest(least(y + {tb.BODY}, y1) - greatest(y - {tb.BODY}, y0), 0) / {4 * tb.BODY**2} AS share FROM t, z WHERE x IS NOT NULL)"""
PAW = """b0 AS (SELECT session, frame, any_value(time_s) AS time_s, max(share) AS most FROM sh GROUP BY session, frame),
b1 AS (SELECT b0.session, b0.frame, b0.time_s, arg_min(zone, place) AS candidate FROM b0 JOIN sh ON sh.session = b0.session AND sh.frame = b0.frame AND sh.share = most WHERE most >= 0.8 - 1e-9 GROUP BY ALL),
b2 AS (SELECT *, CASE WHEN candidate IS DISTINCT FROM lag(candidate) OVER (PARTITION BY session ORDER BY frame) THEN 1 ELSE 0 END AS new FROM b1),
b3 AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY frame) AS run FROM b2),
b4 AS (SELECT session, run, any_value(candidate) AS zone, count(*) AS n, min(time_s) AS time_s FROM b3 GROUP BY session, run HAVING count(*) >= 2),
b5 AS (SELECT *, lag(zone) OVER (PARTITION BY session ORDER BY run) AS was FROM b4),
pe AS (SELECT session, zone, time_s FROM b5 WHERE zone IS DISTINCT FROM was)"""
TOT = "tot AS (SELECT session, count(*) / 1.0 AS total_s, count(*) FILTER (status <> 'Lost') / 1.0 AS present_s FROM t GROUP BY session)"


def _flags(spark: SparkSession, d: str, listed=tb.ZONES) -> DataFrame:
    return zn.zone_flags(tb.trajectory(spark, d), tb.zones(spark, listed))


def _totals(spark: SparkSession, d: str) -> DataFrame:
    w = zn.ordered(["session"], "frame")
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    rows = tb.trajectory(spark, d).withColumn("step", step)
    return rows.groupBy("session").agg((F.count("*") / FPS).alias("total_s"), (F.count(F.when(zn.present(), 1)) / FPS).alias("present_s"), F.sum(F.when(F.col("status") == "Tracked", F.col("step"))).alias("distance"))


# --- entries --------------------------------------------------------------------------------------------------------


@query(with_(T, Z, SH, PAW) + "SELECT * FROM pe")
def body_entries(spark: SparkSession, d: str) -> DataFrame:
    return mz.body_entries(tb.body_shares(tb.trajectory(spark, d)), 2)


@query(
    with_(T, Z, SH, PAW)
    + """SELECT t.session, t.frame, coalesce(last_value(pe.zone IGNORE NULLS) OVER (PARTITION BY t.session ORDER BY t.frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'None') AS label
FROM t LEFT JOIN pe ON pe.session = t.session AND pe.time_s = t.time_s"""
)
def body_labels(spark: SparkSession, d: str) -> DataFrame:
    return mz.body_labels(tb.body_shares(tb.trajectory(spark, d)), 2)


EPM_ARMS = arms_sql("zone <> 'Center'", "CASE WHEN bool_or(inside AND zone = 'Center') THEN '__HUB__' END")
NO_HUB = arms_sql("zone <> 'Centre'", "CASE WHEN bool_or(inside AND zone = 'Centre') THEN '__HUB__' END")
SIDES = arms_sql("true", "'__HUB__'")
ARMS = [n for n, *_ in tb.ZONES if n != "Center"]


@query(with_(T, Z, FL, EPM_ARMS) + "SELECT * FROM seq")
def arm_sequence(spark: SparkSession, d: str) -> DataFrame:
    return mz.arm_sequence(_flags(spark, d), ARMS, ["Center"], MIN_FRAMES)


TWO = """pf AS (SELECT session, frame, time_s, status, CASE WHEN zone = 'Center' THEN 'a' ELSE 'b' END AS zone, coalesce(bool_or(inside), false) AS inside FROM fl GROUP BY ALL),
pc AS (SELECT *, coalesce(last_value(CASE WHEN status <> 'Lost' THEN inside END IGNORE NULLS) OVER (PARTITION BY session, zone ORDER BY frame), false) AS flag FROM pf),
pc1 AS (SELECT *, CASE WHEN flag IS DISTINCT FROM lag(flag) OVER (PARTITION BY session, zone ORDER BY frame) OR frame = 0 THEN 1 ELSE 0 END AS new FROM pc),
pc2 AS (SELECT *, sum(new) OVER (PARTITION BY session, zone ORDER BY frame) AS run FROM pc1),
pc3 AS (SELECT *, count(*) OVER (PARTITION BY session, zone, run) AS n FROM pc2),
ps AS (SELECT *, last_value(CASE WHEN n >= 2 OR run = 1 THEN flag END IGNORE NULLS) OVER (PARTITION BY session, zone ORDER BY frame) AS state FROM pc3),
pv AS (SELECT *, CASE WHEN state AND NOT coalesce(lag(state) OVER (PARTITION BY session, zone ORDER BY frame), false) THEN 1 ELSE 0 END AS e FROM ps),
two AS (SELECT session, coalesce(sum(e) FILTER (zone = 'a'), 0) AS a, coalesce(sum(e) FILTER (zone = 'b'), 0) AS b FROM pv GROUP BY session)"""


@query(with_(T, Z, FL, TWO) + "SELECT session, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM two")
def two_part_entries(spark: SparkSession, d: str) -> DataFrame:
    return mz.two_part_entries(None, _flags(spark, d), ["Center"], MIN_FRAMES, FPS)


@query(
    with_(
        T,
        Z,
        "s0 AS (SELECT t.session, frame, time_s, CASE WHEN zone = 'Center' THEN 0 ELSE 1 END AS place, CASE WHEN zone = 'Center' THEN 'a' ELSE 'b' END AS zone, share FROM (SELECT session, frame, time_s, zone, greatest(least(x + 20, x1) - greatest(x - 20, x0), 0) * greatest(least(y + 20, y1) - greatest(y - 20, y0), 0) / 1600.0 AS share FROM t, z WHERE x IS NOT NULL) t)",
        "sh AS (SELECT session, frame, time_s, place, zone, least(sum(share), 1) AS share FROM s0 GROUP BY ALL)",
        PAW,
    )
    + "SELECT t.session, count(pe.zone) FILTER (pe.zone = 'a') AS a, count(pe.zone) FILTER (pe.zone = 'b') AS b FROM (SELECT DISTINCT session FROM t) t LEFT JOIN pe USING (session) GROUP BY t.session"
)
def two_part_body_entries(spark: SparkSession, d: str) -> DataFrame:
    return mz.two_part_entries(tb.body_shares(tb.trajectory(spark, d)), _flags(spark, d), ["Center"], 2, FPS)


# --- tests ----------------------------------------------------------------------------------------------------------

LD = """k AS (SELECT session, coalesce(sum(time_s) FILTER (zone = 'Light box'), 0) AS light_s, coalesce(sum(time_s) FILTER (zone = 'Dark box'), 0) AS dark_s,
 CAST(coalesce(sum(entries) FILTER (zone = 'Light box'), 0) AS BIGINT) AS light_entries, CAST(coalesce(sum(entries) FILTER (zone = 'Dark box'), 0) AS BIGINT) AS dark_entries FROM zt GROUP BY session),
q AS (SELECT *, CASE WHEN zone = 'Light box' THEN 'Light' ELSE 'Dark' END AS side FROM seq), q1 AS (SELECT *, lag(side) OVER (PARTITION BY session ORDER BY time_s) AS was FROM q),
q2 AS (SELECT session, count(*) FILTER (side <> was) AS transitions, arg_min(side, time_s) AS start_side, min(time_s) FILTER (side = 'Dark') AS d0, min(time_s) FILTER (side = 'Light') AS l0 FROM q1 GROUP BY session),
ld AS (SELECT k.session, light_s, dark_s, round(100 * light_s / nullif(light_s + dark_s, 0), 6) AS light_percent, coalesce(transitions, 0) AS transitions, light_entries, dark_entries, start_side,
 CASE WHEN start_side = 'Dark' THEN 0.0 ELSE d0 END AS latency_to_dark_s, CASE WHEN start_side = 'Light' THEN 0.0 ELSE l0 END AS latency_to_light_s,
 round(1 - (light_s / total_s + light_entries / nullif(light_entries + dark_entries, 0)) / 2, 6) AS anxiety FROM k LEFT JOIN q2 USING (session) JOIN tot USING (session))"""
LD_ALL = (T, zone_sql(tb.LIGHT_DARK), FL, S, V, ZT, SIDES, TOT, LD)


@query(with_(*LD_ALL) + "SELECT * FROM ld")
def light_dark(spark: SparkSession, d: str) -> DataFrame:
    flags = _flags(spark, d, tb.LIGHT_DARK)
    entries = mz.arm_entries(flags, None, [n for n, *_ in tb.LIGHT_DARK], [], MIN_FRAMES)
    return rounded(mz.light_dark(zn.zone_table(flags, MIN_FRAMES, FPS), entries, _totals(spark, d)))


OF = """st AS (SELECT session, status, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS step FROM t WINDOW w AS (PARTITION BY session ORDER BY frame)),
di AS (SELECT session, sum(step) FILTER (status = 'Tracked') AS distance FROM st GROUP BY session),
k AS (SELECT session, sum(time_s) FILTER (zone = 'Center') AS centre_s, sum(entries) FILTER (zone = 'Center') AS centre_entries, sum(time_s) FILTER (zone <> 'Center') AS periphery_s, sum(distance) FILTER (zone = 'Center') AS centre_distance,
 min(latency_s) FILTER (zone = 'Center') AS latency_to_centre_s FROM zt GROUP BY session),
op AS (SELECT k.session, centre_s, round(100 * centre_s / nullif(present_s, 0), 6) AS centre_percent, CAST(centre_entries AS BIGINT) AS centre_entries, periphery_s, CAST(b AS BIGINT) AS periphery_entries, round(centre_distance, 6) AS centre_distance,
 round(100 * centre_distance / nullif(distance, 0), 6) AS centre_distance_percent, latency_to_centre_s, round(1 - (centre_s / total_s + a / nullif(a + b, 0)) / 2, 6) AS anxiety
 FROM k JOIN tot USING (session) JOIN di USING (session) JOIN two USING (session))"""
OF_ALL = (T, Z, FL, S, V, ZT, TWO, TOT, OF)


@query(with_(*OF_ALL) + "SELECT * FROM op")
def open_field(spark: SparkSession, d: str) -> DataFrame:
    flags = _flags(spark, d)
    return rounded(mz.open_field(zn.zone_table(flags, MIN_FRAMES, FPS), mz.two_part_entries(None, flags, ["Center"], MIN_FRAMES, FPS), _totals(spark, d)))


SO = """so AS (SELECT session, coalesce(sum(time_s) FILTER (zone = 'Social side'), 0) AS social_s, coalesce(sum(time_s) FILTER (zone = 'Object side'), 0) AS object_s, coalesce(sum(time_s) FILTER (zone = 'Middle'), 0) AS centre_s,
 CAST(coalesce(sum(entries) FILTER (zone <> 'Middle'), 0) AS BIGINT) AS chamber_entries FROM zt GROUP BY session)"""
SO_ALL = (T, zone_sql(tb.SOCIAL), FL, S, V, ZT, SO)


@query(with_(*SO_ALL) + "SELECT *, round((social_s - object_s) / nullif(social_s + object_s, 0), 6) AS sociability FROM so")
def social(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mz.social(zn.zone_table(_flags(spark, d, tb.SOCIAL), MIN_FRAMES, FPS)))


TM = """al AS (SELECT session, zone AS a, lead(zone, 1) OVER w AS b, lead(zone, 2) OVER w AS c FROM seq WINDOW w AS (PARTITION BY session ORDER BY time_s)),
w AS (SELECT session, count(*) AS entries, count(*) FILTER (c IS NOT NULL AND a <> b AND b <> c AND a <> c) AS alternations, greatest(count(*) - 2, 0) AS possible FROM al GROUP BY session),
g0 AS (SELECT *, lag(zone) OVER (PARTITION BY session ORDER BY time_s) AS was FROM seq WHERE zone LIKE 'Goal%'),
g AS (SELECT session, count(*) AS goal_entries, count(*) FILTER (zone <> was) AS goal_alternations, arg_min(zone, time_s) AS first_choice FROM g0 GROUP BY session)"""


@query(
    with_(T, zone_sql(tb.T_MAZE), FL, NO_HUB, TM)
    + """SELECT w.session, entries, coalesce(goal_entries, 0) AS goal_entries, coalesce(goal_alternations, 0) AS goal_alternations, round(CASE WHEN goal_entries > 1 THEN 100.0 * goal_alternations / (goal_entries - 1) END, 6) AS goal_percent, first_choice,
 alternations, possible, round(100.0 * alternations / nullif(possible, 0), 6) AS percent FROM w LEFT JOIN g USING (session)"""
)
def t_maze(spark: SparkSession, d: str) -> DataFrame:
    arms = [n for n, *_ in tb.T_MAZE if n != "Centre"]
    return rounded(mz.t_maze(mz.arm_entries(_flags(spark, d, tb.T_MAZE), None, arms, ["Centre"], MIN_FRAMES), arms))


def _flat_sql(source: str, test: str, numbers: list[str], words: tuple[str, ...] = ()) -> str:
    return " UNION ALL ".join(
        [f"SELECT session, '{test}' AS test, '{c}' AS measure, CAST({c} AS DOUBLE) AS value, NULL AS text FROM {source}" for c in numbers] + [f"SELECT session, '{test}', '{c}', NULL, {c} FROM {source}" for c in words]
    )


@query(
    with_(*LD_ALL)
    + _flat_sql("ld", "light_dark", ["light_s", "dark_s", "light_percent", "transitions", "light_entries", "dark_entries", "latency_to_dark_s", "latency_to_light_s", "anxiety"], ("start_side",))
)
def test_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The kind of test by the zones' names, and its measures as one long table."""
    kind = mz.classify_test(None, [n for n, *_ in tb.LIGHT_DARK])
    measured = {"light_dark": light_dark, "epm": open_field}[kind](spark, d)
    return mz.flat(measured, kind)


@query(
    with_(T, Z, FL)
    + """, gf AS (SELECT session, CASE WHEN zone LIKE 'Open%' THEN 'open' ELSE 'closed' END AS "group", frame, any_value(time_s) AS time_s, any_value(status) AS status, coalesce(bool_or(inside), false) AS inside FROM fl WHERE zone <> 'Center' GROUP BY ALL),
sm AS (SELECT session, "group", count(*) FILTER (inside AND status <> 'Lost') / 1.0 AS time_s, 100.0 * count(*) FILTER (inside AND status <> 'Lost') / nullif(count(*) FILTER (status <> 'Lost'), 0) AS percent FROM gf GROUP BY ALL),
g0 AS (SELECT *, row_number() OVER (PARTITION BY session, "group" ORDER BY frame) AS i FROM gf WHERE status <> 'Lost'),
g1 AS (SELECT *, CASE WHEN inside IS DISTINCT FROM lag(inside) OVER (PARTITION BY session, "group" ORDER BY frame) OR i = 1 THEN 1 ELSE 0 END AS new FROM g0),
g2 AS (SELECT *, sum(new) OVER (PARTITION BY session, "group" ORDER BY frame) AS run FROM g1),
g3 AS (SELECT session, "group", run, any_value(inside) AS inside, count(*) AS n FROM g2 GROUP BY ALL),
g4 AS (SELECT *, lag(inside) OVER (PARTITION BY session, "group" ORDER BY run) AS was FROM g3 WHERE n >= 2 OR run = 1),
g5 AS (SELECT session, "group", count(*) AS entries FROM g4 WHERE inside AND NOT was GROUP BY ALL)
SELECT sm.session, sm."group", time_s, round(percent, 6) AS percent, coalesce(entries, 0) AS entries FROM sm LEFT JOIN g5 ON g5.session = sm.session AND g5."group" = sm."group" """
)
def zone_groups(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mz.zone_groups(_flags(spark, d), {"open": ["Open Arm 1", "Open Arm 2"], "closed": ["Closed Arm 1", "Closed Arm 2"]}, FPS, 2))


# --- time bins ------------------------------------------------------------------------------------------------------

EDGES = bn.bin_edges(0.0, 60.3, 20.0)  # the last 0.3 s join the third bin
EB = "eb(bin, a, b) AS (VALUES " + ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(zip(EDGES, EDGES[1:]))) + ")"
SB = """st AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS step FROM t WINDOW w AS (PARTITION BY session ORDER BY frame)),
sb AS (SELECT k.session, eb.bin, a, b, count(st.frame) FILTER (st.status <> 'Lost') AS frames, coalesce(sum(step) FILTER (st.status <> 'Lost'), 0) AS distance, coalesce(avg(step) FILTER (st.status = 'Tracked'), 0) AS speed
 FROM (SELECT DISTINCT session FROM t) k CROSS JOIN eb LEFT JOIN st ON st.session = k.session AND time_s >= a AND time_s < b GROUP BY ALL),
mb AS (SELECT m.session, eb.bin, count(*) AS moves FROM m JOIN eb ON m.time_s >= a AND m.time_s < b GROUP BY ALL),
bb AS (SELECT sb.session, sb.bin, a, b, frames, distance, speed, coalesce(moves, 0) AS moves FROM sb LEFT JOIN mb ON mb.session = sb.session AND mb.bin = sb.bin)"""


def _bins(spark: SparkSession, d: str, cumulative: bool) -> DataFrame:
    moved = zn.moves(zn.labelled(_flags(spark, d)), 2)
    return rounded(bn.session_bins(tb.trajectory(spark, d), moved, EDGES, 20.0, FPS, cumulative))


@query(
    with_(T, Z, FL, L, M, EB, SB)
    + "SELECT session, bin, a::DOUBLE AS start_s, b::DOUBLE AS end_s, printf('%.0f-%.0f s', a::DOUBLE, b::DOUBLE) AS label, frames, round(distance, 6) AS distance, round(speed, 6) AS speed, moves FROM bb"
)
def session_bins(spark: SparkSession, d: str) -> DataFrame:
    return _bins(spark, d, False)


@query(
    with_(T, Z, FL, L, M, EB, SB)
    + """SELECT session, bin, b::DOUBLE AS end_s, CAST(sum(frames) OVER w AS BIGINT) AS frames, round(sum(distance) OVER w, 6) AS distance, CAST(sum(moves) OVER w AS BIGINT) AS moves FROM bb
WINDOW w AS (PARTITION BY session ORDER BY bin)"""
)
def session_bins_cumulative(spark: SparkSession, d: str) -> DataFrame:
    return _bins(spark, d, True)


ZB = """zb AS (SELECT k.session, k.zone, eb.bin, a, b, count(fl.frame) / 1.0 AS time_s FROM (SELECT DISTINCT session, zone FROM fl) k CROSS JOIN eb
 LEFT JOIN fl ON fl.session = k.session AND fl.zone = k.zone AND fl.inside AND fl.status <> 'Lost' AND fl.time_s >= a AND fl.time_s < b GROUP BY ALL)"""


@query(with_(T, Z, FL, EB, ZB) + "SELECT session, zone, bin, time_s, round(time_s / (b - a) * 100, 6) AS percent FROM zb")
def zone_bins(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bn.zone_bins(_flags(spark, d), EDGES, 20.0, FPS))


@query(
    with_(T, Z, FL, EB, ZB)
    + "SELECT session, zone, bin, sum(time_s) OVER w AS time_s, round(sum(time_s) OVER w / b * 100, 6) AS percent FROM zb WINDOW w AS (PARTITION BY session, zone ORDER BY bin)"
)
def zone_bins_cumulative(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bn.zone_bins(_flags(spark, d), EDGES, 20.0, FPS, cumulative=True))


# --- freezing -------------------------------------------------------------------------------------------------------

FR = _runs_sql("fs", "freezing", "rc") + """, bo AS (SELECT session, min(frame) / 1.0 AS a, (max(frame) + 1) / 1.0 AS b, count(*) / 1.0 AS long FROM rc WHERE freezing GROUP BY session, run),
bg AS (SELECT *, lead(a) OVER (PARTITION BY session ORDER BY a) - b AS gap FROM bo),
ba AS (SELECT session, count(*) AS bouts, avg(long) AS mean_bout_s, median(long) AS median_bout_s, max(long) AS longest_bout_s, min(a) AS first, avg(gap) AS mean_gap_s, median(gap) AS median_gap_s FROM bg GROUP BY session),
wh AS (SELECT session, count(*) / 1.0 AS analysed_s, min(frame) / 1.0 AS start_s, (max(frame) + 1) / 1.0 AS end_s, 100.0 * count(*) FILTER (freezing) / count(*) AS percent, count(*) FILTER (freezing) / 1.0 AS freezing_s, avg(motion) AS mean_motion FROM fs GROUP BY session)
SELECT wh.session, analysed_s, start_s, end_s, round(percent, 6) AS percent, freezing_s, analysed_s - freezing_s AS active_s, coalesce(bouts, 0) AS bouts, round(coalesce(mean_bout_s, 0), 6) AS mean_bout_s, coalesce(median_bout_s, 0) AS median_bout_s,
 coalesce(longest_bout_s, 0) AS longest_bout_s, first - start_s AS latency_s, round(coalesce(bouts, 0) / (analysed_s / 60), 6) AS bouts_per_min, round(mean_gap_s, 6) AS mean_gap_s, median_gap_s, round(mean_motion, 6) AS mean_motion
FROM wh LEFT JOIN ba USING (session)"""


@query(with_(H, FS + ",\n" + FR))
def freezing_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fr.summary(_states(spark, d), FPS))


EPOCHS = (("Tone 1", 30.0, 50.0), ("Tone 2", 60.0, 75.5), ("Early", 10.0, 20.0))


def _period_sql(listed: str, out: str) -> str:
    return f"""{out}j AS (SELECT session, epoch, a, b, frame, motion, freezing, lag(freezing) OVER (PARTITION BY session, epoch ORDER BY frame) AS was FROM fs JOIN {listed} ON frame >= a - 1e-9 AND frame < b - 1e-9),
{out} AS (SELECT session, epoch, any_value(a) AS start_s, any_value(b) AS end_s, avg(CASE WHEN freezing THEN 1 ELSE 0 END) * 100 AS percent, count(*) FILTER (freezing) / 1.0 AS seconds, count(*) FILTER (freezing AND NOT coalesce(was, false)) AS bouts,
 avg(motion) AS mean_motion, count(*) / 1.0 AS length_s, coalesce(count(*) FILTER (freezing) / nullif(count(*) FILTER (freezing AND NOT coalesce(was, false)), 0), 0) AS mean_bout_s FROM {out}j GROUP BY session, epoch)"""


def _epochs(spark: SparkSession, d: str) -> DataFrame:
    sessions = tb.motion_histograms(spark, d).select("session").distinct()
    listed = F.array(*(F.struct(F.lit(n).alias("epoch"), F.lit(a).alias("start_s"), F.lit(b).alias("end_s")) for n, a, b in EPOCHS))
    return sessions.withColumn("e", F.explode(listed)).select("session", "e.*")


@query(
    with_(H, FS, "ep(epoch, a, b) AS (VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE)" for n, a, b in EPOCHS) + ")", "eq AS (SELECT epoch, a - 25 AS a, a AS b FROM ep WHERE a - 25 >= 0)", _period_sql("ep", "pe"), _period_sql("eq", "pq"))
    + """SELECT pe.session, pe.epoch, pe.start_s, pe.end_s, round(pe.percent, 6) AS percent, pe.seconds, pe.bouts, round(pe.mean_motion, 6) AS mean_motion, pe.length_s, round(pe.mean_bout_s, 6) AS mean_bout_s,
 round(pq.percent, 6) AS before_percent, round(pe.percent - pq.percent, 6) AS change, round(pe.mean_motion / nullif(pe.mean_motion + pq.mean_motion, 0), 6) AS suppression
FROM pe LEFT JOIN pq ON pq.session = pe.session AND pq.epoch = pe.epoch"""
)
def pre_epoch(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fr.with_baseline(_states(spark, d), _epochs(spark, d), FPS, 25.0))


FEDGES = bn.bin_edges(0.0, 100.0, 33.2)


@query(
    with_(H, FS, "ep(epoch, a, b) AS (VALUES " + ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(zip(FEDGES, FEDGES[1:]), 1)) + ")", _period_sql("ep", "pe"))
    + "SELECT session, epoch AS bin, start_s, end_s, round(percent, 6) AS percent, seconds, bouts, round(mean_motion, 6) AS mean_motion, length_s, round(mean_bout_s, 6) AS mean_bout_s FROM pe"
)
def freezing_bins(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fr.bins(_states(spark, d), 33.2, 0.0, 100.0, FPS))


@query(with_(H, FS) + "SELECT session, frame, CAST(count(*) FILTER (freezing) OVER (PARTITION BY session ORDER BY frame) AS DOUBLE) AS seconds FROM fs")
def cumulative_freezing(spark: SparkSession, d: str) -> DataFrame:
    return fr.cumulative(_states(spark, d), FPS)


@query(
    with_(H)
    + """, q AS (SELECT session, frame, list_sum(hist) AS every, list_sum(hist[13:]) AS over, list_transform(range(0, 64), lambda i: 0.5 - i / 200.0)[13] AS rate FROM h)
SELECT session, frame, round(100 * greatest(over - rate * every, 0) / greatest(0.025 * every, 1e-6), 6) AS motion FROM q"""
)
def body_motion(spark: SparkSession, d: str) -> DataFrame:
    df = tb.motion_histograms(spark, d).withColumn("rate", F.array(*(F.lit(0.5 - i / 200.0) for i in range(64))))
    none = F.lit(0.0)
    area = fr.body_area(none, none, none, F.aggregate("hist", F.lit(0).cast("long"), lambda a, x: a + x).cast("double"))
    return rounded(fr.body_motion(df, 12, area).select("session", "frame", "motion"))


@query(
    with_(H)
    + """, tl AS (SELECT session, frame // 4 AS frame, frame % 4 AS tile, hist FROM h), tq AS (SELECT *, row_number() OVER (PARTITION BY session, frame ORDER BY list_sum(hist[7:]), tile) AS i, count(*) OVER (PARTITION BY session, frame) AS n FROM tl),
tk AS (SELECT * FROM tq WHERE i <= greatest(1, floor(n * 0.75)))
SELECT session, frame, round(median(list_sum(hist[13:]) / list_sum(hist)), 6) AS rate12 FROM tk GROUP BY ALL"""
)
def tile_rates(spark: SparkSession, d: str) -> DataFrame:
    tiles = tb.motion_histograms(spark, d).select("session", F.floor(F.col("frame") / 4).alias("frame"), (F.col("frame") % 4).alias("tile"), "hist")
    return rounded(fr.tile_rates(tiles).select("session", "frame", F.element_at("rate", 13).alias("rate12")))
