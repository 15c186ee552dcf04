"""Queries that bind operators to the driver's tables, and DuckDB SQL for the same results.

Values are rounded to six digits once, in both, as sums of doubles differ in their last digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vivarium.functions.custom import add_variables
from vivarium.operators import events as ev
from vivarium.operators import freezing as fz
from vivarium.operators import body, classifier, comparison, mixed, runs
from vivarium.operators import ranks as rk
from vivarium.operators import statistics as st
from vivarium.operators import summary as sm
from vivarium.operators import trajectory as tr
from vivarium.operators import zones as zn
from vivarium.sources import imports as im
from vivarium.sources import tables as tb
from vivarium.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FPS, MIN_FRAMES, END = tb.FPS, 2, 40_000_000.0


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def flags(spark: SparkSession, d: str) -> DataFrame:
    return zn.zone_flags(tb.trajectory(spark, d), tb.zones(spark))


# --- shared SQL -----------------------------------------------------------------------------------------------------

T = """t AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
 (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 1.0 AS time_s,
 CASE WHEN event_type <> 'error' THEN value END AS x, CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS y,
 CASE event_type WHEN 'error' THEN 'Lost' WHEN 'signup' THEN 'Hidden' ELSE 'Tracked' END AS status FROM events)"""
Z = "z(place, zone, x0, y0, x1, y1) AS (VALUES " + ", ".join(f"({i}, '{n}', {a}, {b}, {c}, {e})" for i, (n, a, b, c, e) in enumerate(tb.ZONES)) + ")"
FL = "fl AS (SELECT t.*, place, zone, round_even(x, 0) BETWEEN x0 AND x1 AND round_even(y, 0) BETWEEN y0 AND y1 AS inside FROM t, z)"
L = "l AS (SELECT session, frame, time_s, any_value(status) AS status, arg_min(zone, place) FILTER (inside) AS label FROM fl GROUP BY ALL)"
#: Debounced zone states: carried flags, runs, and the last run that is long enough or the first.
S = """c AS (SELECT *, coalesce(last_value(CASE WHEN status IN ('Tracked', 'Hidden') THEN inside END IGNORE NULLS) OVER (PARTITION BY session, zone ORDER BY frame), false) AS flag FROM fl),
c1 AS (SELECT *, CASE WHEN flag IS DISTINCT FROM lag(flag) OVER (PARTITION BY session, zone ORDER BY frame) OR frame = 0 THEN 1 ELSE 0 END AS new FROM c),
c2 AS (SELECT *, sum(new) OVER (PARTITION BY session, zone ORDER BY frame) AS run FROM c1),
c3 AS (SELECT *, count(*) OVER (PARTITION BY session, zone, run) AS n FROM c2),
s AS (SELECT *, last_value(CASE WHEN n >= 2 OR run = 1 THEN flag END IGNORE NULLS) OVER (PARTITION BY session, zone ORDER BY frame) AS state FROM c3)"""
V = """s1 AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER (PARTITION BY session, zone ORDER BY frame) OR frame = 0 THEN 1 ELSE 0 END AS new2 FROM s),
s2 AS (SELECT *, sum(new2) OVER (PARTITION BY session, zone ORDER BY frame) AS run2 FROM s1),
v AS (SELECT session, zone, min(time_s) AS start, max(time_s) + 1 AS stop, count(*) AS n FROM s2 WHERE state GROUP BY session, zone, run2)"""
M = """m0 AS (SELECT session, frame, time_s, label, row_number() OVER (PARTITION BY session ORDER BY frame) AS i FROM l WHERE status <> 'Lost' AND label IS NOT NULL),
m1 AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY session ORDER BY frame) OR i = 1 THEN 1 ELSE 0 END AS new FROM m0),
m2 AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY frame) AS run FROM m1),
m3 AS (SELECT *, row_number() OVER (PARTITION BY session, run ORDER BY frame) AS k FROM m2),
m4 AS (SELECT session, run, any_value(label) AS label, count(*) AS n, max(CASE WHEN k = 2 THEN time_s END) AS time_s, min(time_s) AS t0 FROM m3 GROUP BY session, run),
m5 AS (SELECT *, lag(label) OVER (PARTITION BY session ORDER BY run) AS was FROM m4 WHERE n >= 2 OR run = 1),
m AS (SELECT session, was AS from_zone, label AS to_zone, time_s FROM m5 WHERE was IS NOT NULL AND was <> label),
e1 AS (SELECT *, lag(label) OVER (PARTITION BY session ORDER BY run) AS prev FROM m4 WHERE n >= 2),
en AS (SELECT session, label AS zone, t0 AS time_s FROM e1 WHERE prev IS NULL OR prev <> label)"""
ZT = """d AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS step FROM fl WINDOW w AS (PARTITION BY session, zone ORDER BY frame)),
su AS (SELECT session, zone, count(*) FILTER (inside AND status <> 'Lost') / 1.0 AS time_s, 100.0 * count(*) FILTER (inside AND status <> 'Lost') / nullif(count(*) FILTER (status <> 'Lost'), 0) AS percent,
 coalesce(sum(step) FILTER (inside AND status <> 'Lost'), 0) AS distance FROM d GROUP BY ALL),
vi AS (SELECT session, zone, count(*) AS entries, min(start) AS latency_s FROM v GROUP BY ALL),
zt AS (SELECT su.*, coalesce(entries, 0) AS entries, latency_s, time_s / nullif(entries, 0) AS mean_visit_s FROM su LEFT JOIN vi USING (session, zone))"""
E_ = """e AS (SELECT user_id AS session, event_id AS seq, event_type AS behaviour, CASE WHEN event_type IN ('signup', 'purchase') THEN 'point' ELSE 'state' END AS kind,
 (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS start, value FROM events),
b AS (SELECT session, seq, behaviour, kind, start, CASE WHEN kind = 'state' THEN start + value END AS stop FROM e),
cl AS (SELECT session, seq, behaviour, kind, CASE WHEN kind = 'state' THEN greatest(start, 0) ELSE start END AS start, CASE WHEN kind = 'state' THEN least(stop, 40000000.0) END AS stop
 FROM b WHERE (kind = 'state' AND stop > 0 AND start < 40000000.0) OR (kind = 'point' AND start BETWEEN 0 AND 40000000.0)),
inv AS (SELECT DISTINCT behaviour FROM e)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# --- zones ----------------------------------------------------------------------------------------------------------


@query(with_(T, Z, FL, S, V, ZT) + "SELECT session, zone, time_s, round(percent, 6) AS percent, round(distance, 6) AS distance, entries, latency_s, round(mean_visit_s, 6) AS mean_visit_s FROM zt")
def zone_table(spark: SparkSession, d: str) -> DataFrame:
    return rounded(zn.zone_table(flags(spark, d), MIN_FRAMES, FPS))


@query(with_(T, Z, FL) + "SELECT session, frame, zone, inside FROM fl")
def zone_flags(spark: SparkSession, d: str) -> DataFrame:
    return flags(spark, d).select("session", "frame", "zone", "inside")


@query(with_(T, Z, FL, S) + "SELECT session, zone, frame, state FROM s")
def debounce(spark: SparkSession, d: str) -> DataFrame:
    return zn.zone_states(flags(spark, d), MIN_FRAMES).select("session", "zone", "frame", "state")


@query(with_(T, Z, FL, S, V) + "SELECT * FROM v")
def zone_visits(spark: SparkSession, d: str) -> DataFrame:
    return zn.zone_visits(flags(spark, d), MIN_FRAMES, FPS)


def _moves(spark: SparkSession, d: str) -> DataFrame:
    return zn.moves(zn.labelled(flags(spark, d)), 2)


@query(with_(T, Z, FL, L, M) + "SELECT * FROM m")
def zone_moves(spark: SparkSession, d: str) -> DataFrame:
    return _moves(spark, d)


@query(with_(T, Z, FL, L, M) + "SELECT from_zone, to_zone, count(*) AS n FROM m GROUP BY ALL")
def transitions_from_to(spark: SparkSession, d: str) -> DataFrame:
    return zn.transition_counts(_moves(spark, d))


@query(with_(T, Z, FL, L, M) + "SELECT z.zone, count(m.to_zone) AS entries FROM z LEFT JOIN m ON m.to_zone = z.zone GROUP BY z.zone")
def arm_entries(spark: SparkSession, d: str) -> DataFrame:
    counts = _moves(spark, d).groupBy(F.col("to_zone").alias("zone")).agg(F.count("*").alias("entries"))
    return tb.zones(spark).select("zone").join(counts, "zone", "left").withColumn("entries", F.coalesce("entries", F.lit(0)))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    rows = zn.labelled(flags(spark, d)).filter(zn.present()).withColumnRenamed("label", "candidate")
    return zn.entries_by_candidate(rows, 2)


@query(with_(T, Z, FL, L, M) + "SELECT * FROM en")
def paw_entries(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d)


@query(
    with_(T, Z, FL, L, M)
    + """, a AS (SELECT session, zone AS a, lead(zone, 1) OVER w AS b, lead(zone, 2) OVER w AS c FROM en WINDOW w AS (PARTITION BY session ORDER BY time_s))
SELECT session, count(*) AS entries, count(*) FILTER (c IS NOT NULL AND a <> b AND b <> c AND a <> c) AS alternations, count(*) FILTER (c IS NOT NULL AND b = c) AS same_arm,
 count(*) FILTER (c IS NOT NULL AND a = c AND a <> b) AS alternate_arm, round(100.0 * count(*) FILTER (c IS NOT NULL AND a <> b AND b <> c AND a <> c) / nullif(count(c), 0), 6) AS percent FROM a GROUP BY session"""
)
def arm_alternation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(zn.alternation(_entries(spark, d)))


@query(
    with_(T, Z, FL, S, V, ZT)
    + """, k AS (SELECT session, coalesce(sum(time_s) FILTER (zone LIKE 'Open%'), 0) AS open_s, coalesce(sum(time_s) FILTER (zone LIKE 'Closed%'), 0) AS closed_s, coalesce(sum(entries) FILTER (zone LIKE 'Open%'), 0) AS open_n,
 coalesce(sum(entries) FILTER (zone LIKE 'Closed%'), 0) AS closed_n, min(latency_s) FILTER (zone LIKE 'Open%') AS open_latency_s FROM zt GROUP BY session), tot AS (SELECT session, count(*) / 1.0 AS total_s FROM t GROUP BY session)
SELECT session, open_s, closed_s, CAST(open_n AS BIGINT) AS open_n, CAST(closed_n AS BIGINT) AS closed_n, open_latency_s, round(open_s / nullif(open_s + closed_s, 0), 6) AS open_share, round(open_n / nullif(open_n + closed_n, 0), 6) AS entry_share,
 round(1 - (open_s / total_s + open_n / nullif(open_n + closed_n, 0)) / 2, 6) AS anxiety FROM k JOIN tot USING (session)"""
)
def epm_metrics(spark: SparkSession, d: str) -> DataFrame:
    totals = tb.trajectory(spark, d).groupBy("session").agg((F.count("*") / FPS).alias("total_s"))
    return rounded(zn.plus_maze(zn.zone_table(flags(spark, d), MIN_FRAMES, FPS), totals))


@query(
    with_(T, Z, FL, S, V, ZT)
    + """, k AS (SELECT session, coalesce(sum(time_s) FILTER (zone = 'Open Arm 1'), 0) AS a, coalesce(sum(time_s) FILTER (zone = 'Open Arm 2'), 0) AS b FROM zt GROUP BY session)
SELECT session, round((a - b) / nullif(a + b, 0), 6) AS discrimination, round(a / nullif(a + b, 0), 6) AS preference FROM k"""
)
def nor_index(spark: SparkSession, d: str) -> DataFrame:
    return rounded(zn.preference(zn.zone_table(flags(spark, d), MIN_FRAMES, FPS), "Open Arm 1", "Open Arm 2"))


BINS = ", k AS (SELECT session, zone, CAST(floor(time_s / 20) AS BIGINT) AS bin, count(*) FILTER (inside AND status <> 'Lost') / 1.0 AS time_s FROM fl GROUP BY ALL)\n"


@query(with_(T, Z, FL) + BINS + "SELECT *, round(time_s / 20 * 100, 6) AS percent FROM k")
def time_bins(spark: SparkSession, d: str) -> DataFrame:
    return rounded(zn.time_bins(flags(spark, d), 20.0, FPS))


@query(with_(T, Z, FL) + BINS + "SELECT session, zone, bin, sum(time_s) OVER (PARTITION BY session, zone ORDER BY bin) AS time_s FROM k")
def time_bins_cumulative(spark: SparkSession, d: str) -> DataFrame:
    return zn.time_bins(flags(spark, d), 20.0, FPS, cumulative=True)


# --- trajectories ---------------------------------------------------------------------------------------------------

GAP = """g AS (SELECT *, frame + 1 AS i FROM t),
g1 AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ia, last_value(x IGNORE NULLS) OVER b AS xa, last_value(y IGNORE NULLS) OVER b AS ya,
 first_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER f AS ib, first_value(x IGNORE NULLS) OVER f AS xb, first_value(y IGNORE NULLS) OVER f AS yb
 FROM g WINDOW b AS (PARTITION BY session ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY session ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
g2 AS (SELECT session, frame, time_s, status, coalesce(x IS NULL AND ia IS NOT NULL AND ib IS NOT NULL AND ib - ia - 1 <= 2, false) AS interpolated, x, y, ia, ib, xa, xb, ya, yb, i FROM g1),
gf AS (SELECT session, frame, time_s, status, CASE WHEN interpolated THEN xa + (xb - xa) * (i - ia) / (ib - ia) ELSE x END AS x, CASE WHEN interpolated THEN ya + (yb - ya) * (i - ia) / (ib - ia) ELSE y END AS y, interpolated FROM g2)"""


@query(with_(T, GAP) + "SELECT session, frame, round(x, 6) AS x, round(y, 6) AS y, interpolated FROM gf")
def gap_fill(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tr.gap_fill(tb.trajectory(spark, d), 2).select("session", "frame", "x", "y", "interpolated"))


@query(
    with_(T)
    + """SELECT session, frame, coalesce(last_value(x IGNORE NULLS) OVER b, first_value(x IGNORE NULLS) OVER f) AS x, coalesce(last_value(y IGNORE NULLS) OVER b, first_value(y IGNORE NULLS) OVER f) AS y, x IS NULL AS held
FROM t WINDOW b AS (PARTITION BY session ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY session ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""
)
def hold_last(spark: SparkSession, d: str) -> DataFrame:
    return tr.hold_last(tb.trajectory(spark, d)).select("session", "frame", "x", "y", "held")


def _smooth_sql(c: str) -> str:
    w = "OVER (PARTITION BY session ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
    return f"""{c}1 AS (SELECT session, frame, {c}, median({c}) {w} AS m FROM t WHERE x IS NOT NULL),
{c}2 AS (SELECT *, greatest(median(abs({c} - m)) {w}, 0.5) AS mad FROM {c}1),
{c}3 AS (SELECT session, frame, avg(CASE WHEN abs({c} - m) > 3.5 * mad THEN m ELSE {c} END) {w} AS {c}_smooth FROM {c}2)"""


@query(with_(T, _smooth_sql("x"), _smooth_sql("y")) + "SELECT t.session, t.frame, round(x_smooth, 6) AS x_smooth, round(y_smooth, 6) AS y_smooth FROM t LEFT JOIN x3 USING (session, frame) LEFT JOIN y3 USING (session, frame)")
def smooth_trajectory(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tr.smooth(tb.trajectory(spark, d), 5).select("session", "frame", "x_smooth", "y_smooth"))


@query(
    "WITH RECURSIVE "
    + T
    + """, p AS (SELECT session, x, y, row_number() OVER (PARTITION BY session ORDER BY frame) AS i FROM t WHERE x IS NOT NULL),
r AS (SELECT session, i, x, y, 0.0::DOUBLE AS total, 0 AS steps FROM p WHERE i = 1 UNION ALL
 SELECT r.session, p.i, CASE WHEN d >= 30 THEN p.x ELSE r.x END, CASE WHEN d >= 30 THEN p.y ELSE r.y END, CASE WHEN d >= 30 THEN total + d ELSE total END, CASE WHEN d >= 30 THEN steps + 1 ELSE steps END
 FROM r JOIN p ON p.session = r.session AND p.i = r.i + 1, LATERAL (SELECT sqrt((p.x - r.x) ** 2 + (p.y - r.y) ** 2) AS d))
SELECT session, round(arg_max(total, i), 6) AS distance, CAST(arg_max(steps, i) AS BIGINT) AS steps FROM r GROUP BY session"""
)
def path_distance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tr.path_distance(tb.trajectory(spark, d), 30.0))


STEP = "st AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step, time_s - lag(time_s) OVER w AS dt FROM t WINDOW w AS (PARTITION BY session ORDER BY frame))"


@query(with_(T, STEP) + "SELECT session, frame, round(sum(coalesce(step, 0)) OVER (PARTITION BY session ORDER BY frame), 6) AS cumulative, round(CASE WHEN dt > 0 THEN step / dt END, 6) AS speed FROM st")
def time_course(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tr.time_course(tb.trajectory(spark, d)))


@query(
    with_(T)
    + """, a AS (SELECT *, x < 60 OR x > 440 OR y < 15 OR y > 85 AS near FROM t WHERE status = 'Tracked'),
b AS (SELECT *, lag(near) OVER w AS was, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step FROM (SELECT *, CASE WHEN near THEN 1 ELSE 0 END AS k FROM a) WINDOW w AS (PARTITION BY session ORDER BY frame))
SELECT session, sum(k) / 1.0 AS border_s, round(avg(k) * 100, 6) AS border_percent, round(coalesce(sum(step) FILTER (near AND was), 0), 6) AS border_distance, count(*) FILTER (near AND NOT coalesce(was, true)) AS border_entries FROM b GROUP BY session"""
)
def thigmotaxis(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tr.thigmotaxis(tb.trajectory(spark, d), tr.border_band(tb.WIDTH, tb.HEIGHT, 60, 15), FPS))


@query(with_(T) + "SELECT least(CAST(floor(x / 500 * 50) AS BIGINT), 49) AS bin_x, least(CAST(floor(y / 100 * 50) AS BIGINT), 49) AS bin_y, count(*) AS frames FROM t WHERE x IS NOT NULL GROUP BY ALL")
def heat_map(spark: SparkSession, d: str) -> DataFrame:
    return tr.heat_map(tb.trajectory(spark, d), tb.WIDTH, tb.HEIGHT)


@query(
    with_(T)
    + """, a AS (SELECT *, frame - row_number() OVER (PARTITION BY session ORDER BY frame) AS island FROM t WHERE status = 'Lost'),
k AS (SELECT session, frame, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step FROM t WHERE x IS NOT NULL WINDOW w AS (PARTITION BY session ORDER BY frame)),
md AS (SELECT session, median(step) AS median FROM k GROUP BY session)
SELECT session, 'lost' AS problem, min(frame) AS first, max(frame) AS last FROM a GROUP BY session, island
UNION ALL SELECT session, 'jump', frame, frame FROM k JOIN md USING (session) WHERE step > greatest(4 * 100.0, 8 * median)"""
)
def problem_finder(spark: SparkSession, d: str) -> DataFrame:
    return tr.problems(tb.trajectory(spark, d), 100.0)


@query(
    with_(T)
    + """, a AS (SELECT *, frame - row_number() OVER (PARTITION BY session ORDER BY frame) AS island FROM t WHERE status = 'Lost'),
b AS (SELECT session, min(frame) AS a, max(frame) AS z FROM a GROUP BY session, island)
SELECT session, string_agg(CASE WHEN a = z THEN CAST(a AS VARCHAR) ELSE a || '-' || z END, ', ' ORDER BY a) AS ranges FROM b GROUP BY session"""
)
def lost_ranges(spark: SparkSession, d: str) -> DataFrame:
    return runs.ranges(tb.trajectory(spark, d).filter("status = 'Lost'"), ["session"], "frame")


@query(
    with_(T)
    + """SELECT session, count(*) AS frames, count(*) FILTER (status = 'Tracked') AS tracked, count(*) FILTER (status = 'Hidden') AS hidden, count(*) FILTER (status = 'Lost') AS lost,
 round(count(*) FILTER (status = 'Tracked') / nullif(count(*) FILTER (status <> 'Hidden'), 0), 6) AS quality FROM t GROUP BY session"""
)
def tracking_quality(spark: SparkSession, d: str) -> DataFrame:
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    rows = tb.trajectory(spark, d).groupBy("session").agg(F.count("*").alias("frames"), n("Tracked").alias("tracked"), n("Hidden").alias("hidden"), n("Lost").alias("lost"))
    return rounded(rows.withColumn("quality", F.try_divide("tracked", F.col("frames") - F.col("hidden"))))


# --- events ---------------------------------------------------------------------------------------------------------


def _clipped(spark: SparkSession, d: str) -> DataFrame:
    return ev.clip(tb.scored_events(spark, d), 0.0, END)


def _inventory(spark: SparkSession, d: str) -> DataFrame:
    return tb.scored_events(spark, d).select("behaviour").distinct()


@query(with_(E_) + "SELECT session, seq, behaviour, kind, round(start, 6) AS start, round(stop, 6) AS stop FROM cl")
def clip_events(spark: SparkSession, d: str) -> DataFrame:
    return _clipped(spark, d).withColumns({"start": F.round("start", 6), "stop": F.round("stop", 6)})


@query(
    with_(E_)
    + """, x AS (SELECT *, lead(start) OVER (PARTITION BY session, behaviour ORDER BY start, seq) - coalesce(stop, start) AS gap, stop - start AS length FROM cl),
y AS (SELECT session, behaviour, count(*) AS n, sum(length) AS total_s, avg(length) AS mean_s, stddev_samp(length) AS sd_s, min(length) AS min_s, max(length) AS max_s, avg(gap) AS mean_gap_s, min(start) AS latency_s FROM x GROUP BY ALL)
SELECT k.session, inv.behaviour, coalesce(n, 0) AS n, round(total_s, 6) AS total_s, round(mean_s, 6) AS mean_s, round(sd_s, 6) AS sd_s, round(min_s, 6) AS min_s, round(max_s, 6) AS max_s, round(mean_gap_s, 6) AS mean_gap_s, round(latency_s, 6) AS latency_s,
 round(coalesce(total_s, 0) / 40000000.0 * 100, 6) AS percent, round(coalesce(n, 0) / (40000000.0 / 60), 9) AS rate_per_min FROM (SELECT DISTINCT session FROM cl) k CROSS JOIN inv LEFT JOIN y ON y.session = k.session AND y.behaviour = inv.behaviour"""
)
def time_budget(spark: SparkSession, d: str) -> DataFrame:
    out = ev.budget(_clipped(spark, d), _inventory(spark, d), 0.0, END)
    digits = {"percent": 6, "rate_per_min": 9}
    return out.select(*(F.round(c, digits.get(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


@query(
    with_(E_)
    + """, q AS (SELECT *, least(CAST(floor(start / 4000000) AS BIGINT), 9) AS first, greatest(least(CAST(floor(coalesce(stop, start) / 4000000) AS BIGINT), 9), least(CAST(floor(start / 4000000) AS BIGINT), 9)) AS last FROM cl),
r AS (SELECT *, unnest(generate_series(first, last)) AS bin FROM q)
SELECT session, behaviour, bin, count(*) FILTER (bin = first) AS n, round(sum(greatest(least(coalesce(stop, start), bin * 4000000.0 + 4000000) - greatest(start, bin * 4000000.0), 0)), 3) AS seconds FROM r GROUP BY ALL"""
)
def time_budget_bins(spark: SparkSession, d: str) -> DataFrame:
    return ev.budget_bins(_clipped(spark, d), 0.0, END, END / 10).withColumn("seconds", F.round("seconds", 3))


@query(
    with_(E_)
    + """, f AS (SELECT behaviour, lead(behaviour) OVER (PARTITION BY session ORDER BY start, seq) AS following FROM cl), c AS (SELECT behaviour, following, count(*) AS n FROM f WHERE following IS NOT NULL GROUP BY ALL)
SELECT a.behaviour, b.behaviour AS following, coalesce(n, 0) AS n, round(coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY a.behaviour), 0), 6) AS probability
FROM inv a CROSS JOIN inv b LEFT JOIN c ON c.behaviour = a.behaviour AND c.following = b.behaviour"""
)
def transition_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.transition_matrix(_clipped(spark, d), _inventory(spark, d)))


@query(
    """WITH m AS (SELECT user_id AS session, event_id AS seq, 'visit' AS behaviour, CASE WHEN event_type = 'signup' THEN 'STOP' ELSE 'START' END AS status, epoch_us(ts) / 1e6 AS time FROM events),
n AS (SELECT *, lead(status) OVER w AS after, lead(time) OVER w AS stop FROM m WINDOW w AS (PARTITION BY session, behaviour ORDER BY time, seq))
SELECT session, behaviour, round(time, 3) AS start, round(stop, 3) AS stop FROM n WHERE status = 'START' AND after = 'STOP'"""
)
def start_stop_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = tb.table(spark, d, "events")
    status = F.when(F.col("event_type") == "signup", "STOP").otherwise("START")
    m = e.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.lit("visit").alias("behaviour"), status.alias("status"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("time"))
    return ev.pair_markers(m).withColumns({"start": F.round("start", 3), "stop": F.round("stop", 3)})


@query("""WITH o AS (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS following FROM conversations), c AS (SELECT role AS behaviour, following, count(*) AS n FROM o WHERE following IS NOT NULL GROUP BY ALL)
SELECT behaviour, following, n, round(n / sum(n) OVER (PARTITION BY behaviour), 6) AS probability FROM c""")
def turn_transitions(spark: SparkSession, d: str) -> DataFrame:
    c = tb.table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.col("turn").alias("start"), F.col("role").alias("behaviour"))
    return rounded(ev.next_behaviour(c))


# --- freezing -------------------------------------------------------------------------------------------------------

H = "h AS (SELECT vec_id // 100 AS session, vec_id % 100 AS frame, list_transform(embedding, lambda v: CAST(floor(abs(v) * 1000) AS INT)) AS hist FROM embeddings)"
MO = "mo AS (SELECT session, frame, 100.0 * list_sum(hist[13:]) / nullif(list_sum(hist), 0) AS motion FROM h)"


def _runs_sql(source: str, value: str, out: str) -> str:
    return f"""{out}0 AS (SELECT *, CASE WHEN {value} IS DISTINCT FROM lag({value}) OVER (PARTITION BY session ORDER BY frame) OR row_number() OVER (PARTITION BY session ORDER BY frame) = 1 THEN 1 ELSE 0 END AS new FROM {source}),
{out}1 AS (SELECT * EXCLUDE new, sum(new) OVER (PARTITION BY session ORDER BY frame) AS run FROM {out}0),
{out} AS (SELECT *, count(*) OVER (PARTITION BY session, run) AS n, max(run) OVER (PARTITION BY session) AS top FROM {out}1)"""


FS = (
    MO
    + ", be AS (SELECT *, motion < 80 AS below FROM mo),\n"
    + _runs_sql("be", "below", "ra")
    + ", fi AS (SELECT session, frame, motion, below OR (n <= 1 AND run > 1 AND run < top) AS filled FROM ra),\n"
    + _runs_sql("fi", "filled", "rb")
    + ", fs AS (SELECT session, frame, motion, filled AND n >= 3 AS freezing FROM rb)"
)


def _motion(spark: SparkSession, d: str) -> DataFrame:
    return fz.motion_percent(tb.motion_histograms(spark, d), 12).select("session", "frame", "motion")


def _states(spark: SparkSession, d: str) -> DataFrame:
    return fz.states(_motion(spark, d).withColumn("usable", F.lit(True)), 80.0, 1, 3).drop("usable")


@query(with_(H, MO) + "SELECT session, frame, round(motion, 6) AS motion FROM mo")
def motion_pct(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_motion(spark, d))


@query(with_(H, FS) + "SELECT session, frame, freezing FROM fs")
def freezing_states(spark: SparkSession, d: str) -> DataFrame:
    return _states(spark, d).select("session", "frame", "freezing")


@query(with_(H, FS, _runs_sql("fs", "freezing", "rc")) + 'SELECT session, min(frame) / 1.0 AS start, (max(frame) + 1) / 1.0 AS "end", (max(frame) + 1 - min(frame)) / 1.0 AS duration FROM rc WHERE freezing GROUP BY session, run')
def freezing_bouts(spark: SparkSession, d: str) -> DataFrame:
    return fz.bouts(_states(spark, d), FPS)


PE = """ep(epoch, a, b) AS (VALUES ('Tone 1', 0, 20), ('Tone 2', 40, 60), ('Shock', 50, 90)),
pj AS (SELECT session, epoch, frame, motion, freezing, lag(freezing) OVER (PARTITION BY session, epoch ORDER BY frame) AS was FROM fs JOIN ep ON frame >= a AND frame < b),
pe AS (SELECT session, epoch, avg(CASE WHEN freezing THEN 1 ELSE 0 END) * 100 AS percent, count(*) FILTER (freezing) / 1.0 AS seconds, count(*) FILTER (freezing AND NOT coalesce(was, false)) AS bouts, avg(motion) AS mean_motion FROM pj GROUP BY ALL)"""


def _periods(spark: SparkSession, d: str) -> DataFrame:
    epochs = spark.createDataFrame([("Tone 1", 0.0, 20.0), ("Tone 2", 40.0, 60.0), ("Shock", 50.0, 90.0)], "epoch string, start double, end double")
    return fz.periods(_states(spark, d), epochs, FPS)


@query(with_(H, FS, PE) + "SELECT session, epoch, round(percent, 6) AS percent, seconds, bouts, round(mean_motion, 6) AS mean_motion FROM pe")
def freezing_epochs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_periods(spark, d))


@query(
    with_(H, FS, PE)
    + """, k AS (SELECT session, percent, coalesce(nullif(regexp_replace(epoch, '[\\s_\\-#]*\\d+\\s*$', ''), ''), epoch) AS kind, epoch FROM pe), i AS (SELECT *, row_number() OVER (PARTITION BY session, kind ORDER BY epoch) AS i FROM k)
SELECT session, kind, count(*) AS n, round(avg(percent), 6) AS mean, round(stddev_samp(percent), 6) AS sd, round(arg_min(percent, i), 6) AS first, round(arg_max(percent, i), 6) AS last, round(arg_max(percent, i) - arg_min(percent, i), 6) AS change,
 round(CASE WHEN count(*) > 1 THEN regr_slope(percent, i) END, 6) AS slope FROM i GROUP BY ALL"""
)
def epoch_kinds(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fz.epoch_kinds(_periods(spark, d)))


def _tail_sql(share: str) -> str:
    return f"""(SELECT session, frame, arg_min((i - 1) + (tot * (1 - {share}) - (cum - c)) / c, i) AS level FROM
 (SELECT session, frame, i, c, sum(c) OVER (PARTITION BY session, frame ORDER BY i) AS cum, sum(c) OVER (PARTITION BY session, frame) AS tot FROM
  (SELECT session, frame, unnest(hist)::DOUBLE AS c, generate_subscripts(hist, 1) AS i FROM h)) WHERE c > 0 AND cum >= tot * (1 - {share}) GROUP BY session, frame)"""


@query(
    with_(H)
    + f""", a AS (SELECT session, quantile_cont(level, 0.75) AS a FROM {_tail_sql("0.05")} GROUP BY session), b AS (SELECT session, quantile_cont(level, 0.75) AS b FROM {_tail_sql("0.2")} GROUP BY session)
SELECT session, round(least(a, 1.6 * b), 6) AS level, CAST(greatest(least(round_even(2 * least(a, 1.6 * b), 0), 40), 3) AS BIGINT) AS cutoff FROM a JOIN b USING (session)"""
)
def auto_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fz.auto_cutoff(tb.motion_histograms(spark, d), 0.05, 0.2))


# --- statistics -----------------------------------------------------------------------------------------------------

SU = """su AS (SELECT c_custkey AS subject, c_mktsegment AS grp, year(o_orderdate) AS timepoint, o_totalprice::DOUBLE AS price, c_acctbal::DOUBLE AS balance FROM orders JOIN customer ON o_custkey = c_custkey),
me AS (SELECT subject, grp, avg(price) AS price, avg(balance) AS balance FROM su GROUP BY ALL),
lo AS (SELECT subject, grp, 'price' AS metric, price AS value FROM me UNION ALL SELECT subject, grp, 'balance', balance FROM me)"""


def _long(spark: SparkSession, d: str) -> DataFrame:
    return st.subject_means(tb.subjects(spark, d), ["price", "balance"])


@query(with_(SU) + 'SELECT subject, grp AS "group", metric, round(value, 6) AS value FROM lo')
def subject_means(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_long(spark, d))


@query("SELECT o_orderpriority AS subject FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def conflicts_removed(spark: SparkSession, d: str) -> DataFrame:
    return st.conflicts(tb.table(spark, d, "orders").select(F.col("o_orderpriority").alias("subject"), F.col("o_orderstatus").alias("group")))


@query(with_(SU) + 'SELECT metric, grp AS "group", count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(stddev_samp(value) / sqrt(count(*)), 6) AS sem, round(median(value), 6) AS median FROM lo GROUP BY ALL')
def group_descriptives(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.descriptives(_long(spark, d)))


WELCH = """w AS (SELECT metric, count(*) FILTER (grp = 'BUILDING') AS n1, avg(value) FILTER (grp = 'BUILDING') AS m1, var_samp(value) FILTER (grp = 'BUILDING') AS v1, count(*) FILTER (grp = 'MACHINERY') AS n2, avg(value) FILTER (grp = 'MACHINERY') AS m2,
 var_samp(value) FILTER (grp = 'MACHINERY') AS v2 FROM lo GROUP BY metric)"""


@query(
    with_(SU, WELCH)
    + """SELECT metric, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t, round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 6) AS df,
 round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) AS cohen_d FROM w WHERE n1 > 1 AND n2 > 1"""
)
def welch_t(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.welch(_long(spark, d), "BUILDING", "MACHINERY").drop("p"))


@query(
    with_(SU)
    + """, g AS (SELECT metric, grp, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM lo GROUP BY ALL HAVING count(*) > 1), h AS (SELECT *, sum(n * m) OVER (PARTITION BY metric) / sum(n) OVER (PARTITION BY metric) AS grand FROM g),
a AS (SELECT metric, count(*) AS k, sum(n) AS n, sum(n * (m - grand) ** 2) AS b, sum((n - 1) * v) AS w FROM h GROUP BY metric)
SELECT metric, round((b / (k - 1)) / (w / (n - k)), 6) AS f, CAST(k - 1 AS BIGINT) AS df_between, CAST(n - k AS BIGINT) AS df_within, round(b / (b + w), 6) AS eta2 FROM a"""
)
def anova_f(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.anova(_long(spark, d)).drop("p"))


@query(
    with_(SU)
    + """, k AS (SELECT *, count(*) OVER (PARTITION BY metric, value) AS t, rank() OVER (PARTITION BY metric ORDER BY value) AS r FROM lo),
p AS (SELECT metric, grp, count(*)::DOUBLE AS n, sum(r + (t - 1) / 2.0) AS s, sum(t::DOUBLE ** 2 - 1) AS ties FROM k GROUP BY ALL),
q AS (SELECT metric, sum(n) AS n, count(*) AS k, sum(s * s / n) AS sq, sum(ties) AS ties FROM p GROUP BY metric)
SELECT metric, round((12 * sq / (n * (n + 1)) - 3 * (n + 1)) / (1 - ties / (n ** 3 - n)), 6) AS h, k - 1 AS df FROM q WHERE k > 1"""
)
def kruskal_h(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rk.kruskal(_long(spark, d)))


@query()
def group_tests(spark: SparkSession, d: str) -> DataFrame:
    """Welch and ANOVA with p and adjusted q; p-values are checked in the tests."""
    a = st.welch(_long(spark, d), "BUILDING", "MACHINERY").select("metric", F.lit("welch").alias("test"), "p")
    return st.bh_of_metrics(a.unionByName(st.anova(_long(spark, d)).select("metric", F.lit("anova").alias("test"), "p")))


@query(
    """WITH p AS (SELECT p_partkey AS item, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_partkey % 997 / 997.0 END AS p FROM part), r AS (SELECT *, row_number() OVER (ORDER BY p NULLS LAST, item) AS k, count(p) OVER () AS m FROM p),
q AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(p * m / k, 1.0) END AS raw FROM r), s AS (SELECT *, min(raw) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q1 FROM q)
SELECT p, round(CASE WHEN p IS NOT NULL THEN q1 END, 6) AS q, count(*) AS n FROM (SELECT round(p, 6) AS p, q1 FROM s) GROUP BY ALL"""
)
def bh_adjust(spark: SparkSession, d: str) -> DataFrame:
    part = tb.table(spark, d, "part")
    p = part.select(F.when(F.col("p_size") % 7 == 0, None).otherwise((F.col("p_partkey") % 997).cast("double") / 997.0).alias("p"))
    out = st.bh_adjust(p).groupBy(F.round("p", 6).alias("p"), F.round("q", 6).alias("q")).agg(F.count("*").alias("n"))
    return out


@query(
    with_(SU)
    + """, p AS (SELECT subject, avg(price) FILTER (timepoint = 1993) AS a, avg(price) FILTER (timepoint = 1996) AS b FROM su GROUP BY subject), q AS (SELECT b - a AS d FROM p WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT count(*) AS n, round(avg(d), 6) AS change, round(stddev_samp(d), 6) AS sd, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t FROM q"""
)
def paired_t(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.paired(tb.subjects(spark, d), "price", "1993", "1996").drop("p"))


@query("SELECT 'o_custkey' AS role, count(DISTINCT o_custkey) AS \"distinct\", count(*) - count(o_custkey) AS missing FROM orders UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus), count(*) - count(o_orderstatus) FROM orders")
def design_audit(spark: SparkSession, d: str) -> DataFrame:
    return st.design_audit(tb.table(spark, d, "orders"), ["o_custkey", "o_orderstatus"])


R = "r AS (SELECT l_suppkey AS subject, month(l_shipdate) AS month, avg(l_quantity::DOUBLE) AS a, avg(l_discount::DOUBLE) * 500 AS b FROM lineitem GROUP BY ALL)"


@query(with_(R) + "SELECT count(*) AS n, round(avg(a - b), 6) AS bias, round(avg(a - b) - 1.96 * stddev_samp(a - b), 6) AS lower, round(avg(a - b) + 1.96 * stddev_samp(a - b), 6) AS upper, round(corr(a, b), 6) AS r FROM r")
def bland_altman(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.bland_altman(tb.raters(spark, d)))


@query(
    with_(R)
    + """, g AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, (avg(a) + avg(b)) / 2 AS m FROM r), s AS (SELECT any_value(n) AS n, sum(2 * ((a + b) / 2 - m) ** 2) AS rs, any_value(n * ((ma - m) ** 2 + (mb - m) ** 2)) AS cs, sum((a - m) ** 2 + (b - m) ** 2) AS ts FROM r, g),
q AS (SELECT n, rs / (n - 1) AS msr, cs AS msc, (ts - rs - cs) / (n - 1) AS mse FROM s) SELECT n, round((msr - mse) / (msr + mse + 2 * (msc - mse) / n), 6) AS icc FROM q"""
)
def icc_a1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.icc(tb.raters(spark, d)))


@query(
    with_(R)
    + """, f AS (SELECT a > 25 AS t, b > 25 AS g FROM r), s AS (SELECT count(*) FILTER (t AND g)::DOUBLE AS tp, count(*) FILTER (NOT t AND g)::DOUBLE AS fp, count(*) FILTER (t AND NOT g)::DOUBLE AS fn, count(*) FILTER (NOT t AND NOT g)::DOUBLE AS tn, count(*)::DOUBLE AS n FROM f),
q AS (SELECT *, (tp + tn) / n AS po, (tp + fn) / n * ((tp + fp) / n) + (1 - (tp + fn) / n) * (1 - (tp + fp) / n) AS pe, tp / (tp + fp) AS p, tp / (tp + fn) AS rc FROM s)
SELECT round(p, 6) AS precision, round(rc, 6) AS recall, round(2 * p * rc / (p + rc), 6) AS f1, round(po * 100, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM q"""
)
def scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.binary_scores(tb.raters(spark, d), F.col("a") > 25, F.col("b") > 25))


@query(
    with_(R)
    + """, f AS (SELECT CAST(floor(a / 5) AS BIGINT) AS x, CAST(floor(b / 5) AS BIGINT) AS y FROM r), c AS (SELECT x, y, count(*)::DOUBLE AS n FROM f GROUP BY ALL), t AS (SELECT sum(n) AS t FROM c),
po AS (SELECT sum(CASE WHEN x = y THEN n ELSE 0 END) / any_value(t) AS po FROM c, t), pe AS (SELECT coalesce(sum(a.n * b.n), 0) / any_value(t * t) AS pe FROM (SELECT x, sum(n) AS n FROM c GROUP BY x) a JOIN (SELECT y, sum(n) AS n FROM c GROUP BY y) b ON a.x = b.y, t)
SELECT round(po, 6) AS po, round(pe, 6) AS pe, round((po - pe) / (1 - pe), 6) AS kappa FROM po, pe"""
)
def kappa_sets(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.kappa_sets(tb.raters(spark, d).select(F.floor(F.col("a") / 5).alias("x"), F.floor(F.col("b") / 5).alias("y")), "x", "y"))


# --- tables ---------------------------------------------------------------------------------------------------------


@query(
    """SELECT s_suppkey AS subject, 'Balance' AS measure, 'usd' AS unit, s_acctbal::DOUBLE AS value FROM supplier WHERE s_acctbal IS NOT NULL
UNION ALL SELECT s_suppkey, 'nation', '', s_nationkey::DOUBLE FROM supplier WHERE s_nationkey IS NOT NULL"""
)
def tidy_unpivot(spark: SparkSession, d: str) -> DataFrame:
    rows = tb.table(spark, d, "supplier").select(F.col("s_suppkey").alias("subject"), F.col("s_acctbal").alias("Balance (usd)"), F.col("s_nationkey").alias("nation"))
    return sm.tidy(rows, ["subject"], ["Balance (usd)", "nation"])


@query(
    """WITH r AS (SELECT o_orderstatus, o_totalprice::DOUBLE AS v, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) AS row FROM orders)
SELECT row, max(v) FILTER (o_orderstatus = 'F') AS "F", max(v) FILTER (o_orderstatus = 'O') AS "O", max(v) FILTER (o_orderstatus = 'P') AS "P" FROM r GROUP BY row"""
)
def prism_pivot(spark: SparkSession, d: str) -> DataFrame:
    o = tb.table(spark, d, "orders").select("o_orderstatus", F.col("o_totalprice").cast("double").alias("v"))
    return sm.prism(o, "o_orderstatus", "v", ["F", "O", "P"])


@query("SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal::DOUBLE END, CASE WHEN c_custkey % 2 = 1 THEN -c_acctbal::DOUBLE END) AS \"Score\" FROM customer")
def case_merge(spark: SparkSession, d: str) -> DataFrame:
    odd, v = F.col("c_custkey") % 2 == 1, F.col("c_acctbal").cast("double")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        rows = tb.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(~odd, v).alias("Score"), F.when(odd, -v).alias("score"))
        return sm.merge_case_duplicates(rows, ["id", "Score", "score"])
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


@query(
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice::DOUBLE / nullif(l_quantity::DOUBLE, 0), 9) AS unit_price, round(l_extendedprice::DOUBLE / nullif(l_quantity::DOUBLE, 0) * (1 - l_discount::DOUBLE), 9) AS net,
 (l_linenumber - 5) - 3 * floor((l_linenumber - 5) / 3.0) AS wrapped, l_tax::DOUBLE > 0.02 AND NOT (l_quantity::DOUBLE < 10) AS flag FROM lineitem"""
)
def custom_vars(spark: SparkSession, d: str) -> DataFrame:
    li = tb.table(spark, d, "lineitem")
    rows = li.select("l_orderkey", "l_linenumber", *(F.col(c).cast("double").alias(c) for c in ("l_extendedprice", "l_quantity", "l_discount", "l_tax")))
    text = "unit_price = l_extendedprice / l_quantity\nnet = unit_price * (1 - l_discount)\nwrapped = (l_linenumber - 5) % 3\nflag = l_tax > 0.02 and not l_quantity < 10"
    out, _ = add_variables(rows, text)
    return out.select("l_orderkey", "l_linenumber", F.round("unit_price", 9).alias("unit_price"), F.round("net", 9).alias("net"), F.col("wrapped").cast("double").alias("wrapped"), "flag")


@query(
    with_(T)
    + """SELECT session, frame, round(avg(x) OVER w, 6) AS x_mean, round(stddev_pop(x) OVER w, 6) AS x_sd, min(x) OVER w AS x_min, max(x) OVER w AS x_max
FROM t WINDOW w AS (PARTITION BY session ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"""
)
def window_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sm.window_features(tb.trajectory(spark, d), ["session"], "frame", ["x"], 5))


PB = "pb AS (SELECT session, frame, CASE WHEN avg(y / 99) OVER (PARTITION BY session ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) >= 0.5 THEN true ELSE false END AS below FROM t WHERE y IS NOT NULL)"


@query(
    with_(T, PB, _runs_sql("pb", "below", "ra"))
    + ", fi AS (SELECT session, frame, below OR (n <= 1 AND run > 1 AND run < top) AS filled FROM ra), "
    + _runs_sql("fi", "filled", "rb")
    + " SELECT session, min(frame) AS first, max(frame) AS last FROM rb WHERE filled AND n >= 2 GROUP BY session, run"
)
def probability_bouts(spark: SparkSession, d: str) -> DataFrame:
    rows = tb.trajectory(spark, d).filter("y IS NOT NULL").select("session", "frame", (F.col("y") / 99).alias("p"))
    return fz.probability_bouts(rows, 3, 1, 2)


# --- cover, body and imports ----------------------------------------------------------------------------------------


@query(
    with_(T, Z)
    + """, q AS (SELECT session, frame, status = 'Tracked' AS seen, round_even(x, 0) AS x, round_even(y, 0) AS y FROM t),
di AS (SELECT q.*, place, zone, sqrt(greatest(x0 - x, x - x1, 0) ** 2 + greatest(y0 - y, y - y1, 0) ** 2) AS d FROM q, z WHERE zone LIKE 'Closed%'),
ne AS (SELECT session, frame, any_value(seen) AS seen, CASE WHEN any_value(seen) AND min(d) <= 20 THEN arg_min(zone, d * 1000 + place) END AS near FROM di GROUP BY ALL),
si AS (SELECT *, last_value(CASE WHEN seen THEN coalesce(near, '-') END IGNORE NULLS) OVER (PARTITION BY session ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
 first_value(CASE WHEN seen THEN coalesce(near, '-') END IGNORE NULLS) OVER (PARTITION BY session ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM ne)
SELECT session, frame, CASE WHEN NOT seen THEN nullif(CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN a = b THEN a END, '-') END AS hidden_zone FROM si"""
)
def hidden_in_covered(spark: SparkSession, d: str) -> DataFrame:
    covered = tb.zones(spark).filter("zone LIKE 'Closed%'")
    return body.hidden_in_covered(tb.trajectory(spark, d), covered, 20.0).select("session", "frame", "hidden_zone")


@query()
def head_and_tail(spark: SparkSession, d: str) -> DataFrame:
    """Ends 20 apart around each position, at an angle from the row; compared with a search over all orientations in the tests."""
    angle = F.col("frame") % 7 / 3
    end = lambda c, f, s: (F.col(c) + s * 10 * f(angle))
    rows = tb.trajectory(spark, d).withColumns({"ax": end("x", F.cos, 1), "ay": end("y", F.sin, 1), "bx": end("x", F.cos, -1), "by": end("y", F.sin, -1), "tail_ev": F.sin("x"), "shape_ev": F.cos("y")})
    return rounded(body.head_and_tail(rows, FPS))


@query(
    with_(T)
    + """, u AS (SELECT session, frame, 'right' AS behaviour, coalesce(x > 250, false) AS f FROM t UNION ALL SELECT session, frame, 'low', coalesce(y < 50, false) FROM t),
i AS (SELECT *, frame - row_number() OVER (PARTITION BY session, behaviour ORDER BY frame) AS island FROM u WHERE f)
SELECT session, behaviour, 'state' AS kind, round(min(frame) / 25.0, 4) AS start, round((max(frame) + 1) / 25.0, 4) AS stop FROM i GROUP BY session, behaviour, island"""
)
def flag_events(spark: SparkSession, d: str) -> DataFrame:
    rows = tb.trajectory(spark, d).select("session", "frame", (F.col("x") > 250).cast("int").alias("right"), (F.col("y") < 50).cast("int").alias("low"))
    return im.flag_events(rows, ["right", "low"], 25.0)


@query(
    """WITH m AS (SELECT user_id AS session, event_id AS seq, CASE WHEN event_type = 'signup' THEN 'STOP' WHEN event_type = 'error' THEN 'POINT' ELSE 'START' END AS status, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 + 2.5 AS time FROM events),
n AS (SELECT *, lead(status) OVER w AS after, lead(time) OVER w AS stop FROM m WHERE status <> 'POINT' WINDOW w AS (PARTITION BY session ORDER BY time, seq))
SELECT session, 'visit' AS behaviour, 'state' AS kind, round(time, 4) AS start, round(stop, 4) AS stop FROM n WHERE status = 'START' AND after = 'STOP'
UNION ALL SELECT session, 'visit', 'point', round(time, 4), NULL FROM m WHERE status = 'POINT'"""
)
def marker_events(spark: SparkSession, d: str) -> DataFrame:
    e = tb.scored_events(spark, d)
    status = F.when(F.col("behaviour") == "signup", " stop ").when(F.col("behaviour") == "error", "POINT").otherwise("Start")
    return im.marker_events(e.select("session", "seq", F.lit("visit").alias("behaviour"), status.alias("status"), F.col("start").alias("time")), 2.5)


@query(with_(E_) + "SELECT session, behaviour, CASE WHEN stop > start THEN 'state' ELSE 'point' END AS kind, round(start - 1, 4) AS start, round(CASE WHEN stop > start THEN stop - 1 END, 4) AS stop FROM b")
def span_events(spark: SparkSession, d: str) -> DataFrame:
    return im.span_events(tb.scored_events(spark, d), -1.0)


@query(
    with_(E_)
    + """SELECT session, 'Tone ' || row_number() OVER (PARTITION BY session ORDER BY start) AS name, round(5 + start * 0.5, 4) AS start, round(5 + start * 0.5 + 30, 4) AS "end" FROM b WHERE behaviour = 'signup'"""
)
def epochs_from_times(spark: SparkSession, d: str) -> DataFrame:
    times = tb.scored_events(spark, d).filter("behaviour = 'signup'").select("session", F.col("start").alias("time"))
    return im.epochs_from_times(times, 30.0, "Tone", 5.0, 0.5)


@query(
    """WITH p AS (SELECT vec_id, unnest(range(1, 61, 3)) AS i, embedding AS e FROM embeddings), q AS (SELECT vec_id, e[i]::DOUBLE AS x, e[i + 1]::DOUBLE AS y, abs(e[i + 2]::DOUBLE) * 5 AS p FROM p)
SELECT CAST(0 AS BIGINT) AS session, vec_id AS frame, round(avg(x) FILTER (p >= 0.6), 6) AS x, round(avg(y) FILTER (p >= 0.6), 6) AS y, CASE WHEN count(*) FILTER (p >= 0.6) > 0 THEN 'Tracked' ELSE 'Lost' END AS status FROM q GROUP BY vec_id"""
)
def pose_positions(spark: SparkSession, d: str) -> DataFrame:
    parts = F.transform(F.sequence(F.lit(0), F.lit(57), F.lit(3)), lambda i: F.struct(*(F.get("embedding", i + k).cast("double").alias(n) for k, n in enumerate("xyp"))))
    points = tb.table(spark, d, "embeddings").select(F.lit(0).cast("long").alias("session"), F.col("vec_id").alias("frame"), F.explode(parts).alias("at"))
    points = points.select("session", "frame", "at.x", "at.y", (F.abs("at.p") * 5).alias("p"))
    return rounded(im.pose_positions(points, F.lit(True)))


# --- choice of tests, models and checks -----------------------------------------------------------------------------


@query(with_(SU) + "SELECT metric, round(value, 6) AS value, tied, round(rank, 6) AS rank FROM (SELECT metric, value, count(*) AS tied, any_value(r) + (count(*) - 1) / 2.0 AS rank FROM (SELECT *, rank() OVER (PARTITION BY metric ORDER BY value) AS r FROM lo) GROUP BY metric, value)")
def value_ranks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rk.value_ranks(_long(spark, d), ["metric"]))


@query(
    with_(SU)
    + """, k AS (SELECT *, count(*) OVER (PARTITION BY metric, value) AS t, rank() OVER (PARTITION BY metric ORDER BY value) AS r FROM lo WHERE grp IN ('BUILDING', 'MACHINERY')),
p AS (SELECT metric, count(*) FILTER (grp = 'BUILDING')::DOUBLE AS n1, count(*) FILTER (grp = 'MACHINERY')::DOUBLE AS n2, sum(r + (t - 1) / 2.0) FILTER (grp = 'BUILDING') AS r1, sum(t::DOUBLE ** 2 - 1) AS ties FROM k GROUP BY metric),
q AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u FROM p)
SELECT metric, u, round(greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z FROM q"""
)
def mann_whitney_u(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rk.mann_whitney(_long(spark, d), "BUILDING", "MACHINERY").drop("p"))


@query(
    with_(SU)
    + """, y AS (SELECT subject, timepoint, avg(price) AS v FROM su WHERE timepoint BETWEEN 1993 AND 1996 GROUP BY ALL), w AS (SELECT *, count(*) OVER (PARTITION BY subject) AS c FROM y),
r AS (SELECT subject, timepoint, rank() OVER (PARTITION BY subject ORDER BY v) AS r, count(*) OVER (PARTITION BY subject, v) AS t FROM w WHERE c = 4),
s AS (SELECT timepoint, sum(r + (t - 1) / 2.0) AS s, sum(t * t - 1) AS ties, count(*) AS n FROM r GROUP BY timepoint)
SELECT coalesce(max(n), 0) AS n, round(CASE WHEN max(n) >= 2 THEN (12 * sum(s * s) / (max(n) * 20) - 15 * max(n)) / (1 - sum(ties) / (max(n) * 60)) END, 6) AS chi2, 3 AS df FROM s"""
)
def friedman_chi2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rk.friedman(tb.subjects(spark, d), "price", [1993, 1994, 1995, 1996]).drop("p"))


@query(
    with_(SU)
    + """, dv AS (SELECT metric, grp, abs(value - median(value) OVER (PARTITION BY metric, grp)) AS value FROM lo), g AS (SELECT metric, grp, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM dv GROUP BY ALL HAVING count(*) > 1),
h AS (SELECT *, sum(n * m) OVER (PARTITION BY metric) / sum(n) OVER (PARTITION BY metric) AS grand FROM g), a AS (SELECT metric, count(*) AS k, sum(n) AS n, sum(n * (m - grand) ** 2) AS b, sum((n - 1) * v) AS w FROM h GROUP BY metric)
SELECT metric, round((b / (k - 1)) / (w / (n - k)), 6) AS f, CAST(k - 1 AS BIGINT) AS df_between, CAST(n - k AS BIGINT) AS df_within FROM a"""
)
def levene_f(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.anova(rk.levene(_long(spark, d))).drop("p", "eta2"))


@query()
def compare_groups(spark: SparkSession, d: str) -> DataFrame:
    """Tests chosen by Shapiro-Wilk, which SQL doesn't express; the parts have SQL of their own."""
    return rounded(comparison.compare_groups(_long(spark, d)))


@query()
def mixed_effects(spark: SparkSession, d: str) -> DataFrame:
    """Prices by market segment and year with an intercept for each customer; compared with dense matrices in the tests."""
    s = tb.subjects(spark, d)
    return rounded(mixed.mixed_effects(s.select("subject", "group", "timepoint", F.col("price").alias("value"))))


@query()
def classifier_scores(spark: SparkSession, d: str) -> DataFrame:
    """Forests on five blocks of the vectors, for label 1."""
    e = tb.table(spark, d, "embeddings")
    rows = e.select(F.lit(0).alias("session"), F.col("vec_id").alias("frame"), F.col("embedding").cast("array<double>").alias("features"), (F.col("label") == 1).alias("truth"))
    return rounded(classifier.cross_validate(rows, "truth", FPS))


@query(
    with_(T)
    + """, m AS (SELECT session, count(x) AS n, quantile_cont(x, 0.05) AS floor, count(*) AS frames, avg(CASE WHEN status = 'Tracked' THEN 100.0 ELSE 0 END) AS found, avg(CASE WHEN y > 95 THEN 100.0 WHEN y <= 95 THEN 0 END) AS light FROM t GROUP BY session)
SELECT session, 'warn' AS level, 'noise' AS code, round(floor, 6) AS value FROM m WHERE n >= 30 AND floor >= 20
UNION ALL SELECT session, CASE WHEN found < 60 THEN 'error' ELSE 'warn' END, 'found', round(found, 6) FROM m WHERE found < 90
UNION ALL SELECT session, CASE WHEN light > 10 THEN 'warn' ELSE 'info' END, 'light', round(light / 100 * frames, 6) FROM m WHERE light > 10 OR light / 100 * frames >= 0.1"""
)
def freezing_checks(spark: SparkSession, d: str) -> DataFrame:
    rows = tb.trajectory(spark, d).select("session", "frame", F.col("x").alias("motion"), (F.col("status") != "Lost").alias("usable"), (F.col("status") == "Tracked").alias("found"), (F.col("y") > 95).alias("light_change"))
    return rounded(fz.quality_checks(rows, 20.0, FPS))


@query(
    with_(T)
    + """, m AS (SELECT session, median(y) AS md FROM t GROUP BY session), b AS (SELECT t.session, frame, md, coalesce(y BETWEEN 0.55 * md AND 1.8 * md, false) AS good, y FROM t JOIN m USING (session)),
e AS (SELECT *, min(frame) FILTER (good) OVER (PARTITION BY session) AS g, max(frame) FILTER (good) OVER (PARTITION BY session) AS h FROM b),
s AS (SELECT session, any_value(md) AS md, any_value(g) AS g, any_value(h) AS h, min(frame) AS a, max(frame) AS z, count(*) FILTER (NOT good AND y IS NOT NULL AND frame < g) AS nb, count(*) FILTER (NOT good AND y IS NOT NULL AND frame > h) AS na FROM e GROUP BY session),
f AS (SELECT *, CASE WHEN nb >= 2 THEN g ELSE a END AS f1 FROM s), l AS (SELECT *, CASE WHEN na >= 2 THEN greatest(h, f1 - 1) ELSE z END AS l1 FROM f), k AS (SELECT *, md > 1 AND g IS NOT NULL AND l1 - f1 + 1 >= 2 AS ok FROM l)
SELECT session, CASE WHEN ok THEN f1 ELSE a END AS first, CASE WHEN ok THEN l1 ELSE z END AS last FROM k"""
)
def lights_trim(spark: SparkSession, d: str) -> DataFrame:
    return fz.lights_trim(tb.trajectory(spark, d).select("session", "frame", F.col("y").alias("bright")), FPS)


@query(
    with_(T)
    + """, f AS (SELECT session, frame, time_s, coalesce(y > 40, false) AS auto FROM t), b AS (SELECT session, time_s AS start, time_s + 2.5 AS stop FROM t WHERE status = 'Hidden'),
h AS (SELECT f.*, EXISTS (SELECT 1 FROM b WHERE b.session = f.session AND f.time_s + 0.5 > b.start AND f.time_s + 0.5 <= b.stop) AS hand FROM f),
s AS (SELECT session, count(*) AS frames, avg(auto::INT) AS a, avg(hand::INT) AS h, avg((auto = hand)::INT) AS same, min(time_s) AS t0 FROM h GROUP BY session),
q AS (SELECT h.session, floor((time_s - t0) / 10) AS bin, count(*) AS n, avg(auto::INT) * 100 AS a, avg(hand::INT) * 100 AS h FROM h JOIN s USING (session) GROUP BY ALL HAVING count(*) >= 5),
r AS (SELECT session, count(*) AS bins, CASE WHEN count(*) >= 3 AND max(a) > min(a) AND max(h) > min(h) THEN corr(a, h) END AS bin_r, avg(a - h) AS bias, stddev_samp(a - h) AS sd FROM q GROUP BY session)
SELECT s.session, frames, round(a * 100, 6) AS auto_percent, round(h * 100, 6) AS hand_percent, round(same * 100, 6) AS agreement,
 round(CASE WHEN a * h + (1 - a) * (1 - h) = 1 THEN CASE WHEN same = 1 THEN 1 END ELSE (same - (a * h + (1 - a) * (1 - h))) / (1 - (a * h + (1 - a) * (1 - h))) END, 6) AS kappa,
 coalesce(bins, 0) AS bins, round(bin_r, 6) AS bin_r, round(bias, 6) AS bin_bias, round(bias - 1.96 * sd, 6) AS bin_lower, round(bias + 1.96 * sd, 6) AS bin_upper FROM s LEFT JOIN r ON r.session = s.session"""
)
def compare_scoring(spark: SparkSession, d: str) -> DataFrame:
    rows = tb.trajectory(spark, d)
    frames = rows.select("session", "frame", "time_s", F.coalesce(F.col("y") > 40, F.lit(False)).alias("auto"))
    bouts = rows.filter("status = 'Hidden'").select("session", F.col("time_s").alias("start"), (F.col("time_s") + 2.5).alias("stop"))
    return rounded(st.compare_scoring(frames, bouts, FPS))


# --- streams --------------------------------------------------------------------------------------------------------


@query("SELECT user_id, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    """The streaming operator on a bounded table: the same plan runs on a stream."""
    e = tb.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return live.windowed_counts(e, "ts", "user_id").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM b GROUP BY user_id, k"""
)
def bout_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = tb.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = live.bouts_by_gap(e, "ts", "user_id")
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})
