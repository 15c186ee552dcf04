"""Queries of several animals with looks, geometry, nested models, bootstraps, catalogues and streams, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vivarium.functions import text as tx
from vivarium.operators import advanced as adv
from vivarium.operators import classifier as cl
from vivarium.operators import freezing_result as fr
from vivarium.operators import geometry as geo
from vivarium.operators import glossary as gl
from vivarium.operators import identities as ids
from vivarium.operators import interactions as ia
from vivarium.operators import trajectory as tr
from vivarium.operators import zones as zn
from vivarium.plans.catalogue import FL, FPS, MIN_FRAMES, ORACLES, T, Z, _motion, query, rounded, with_
from vivarium.plans.measures import EPOCHS, _epochs
from vivarium.plans.tracks import _tracks
from vivarium.sources import freezing_tables as ft
from vivarium.sources import tables as tb

# --- several animals ------------------------------------------------------------------------------------------------


@query()
def animal_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Three users at a time as the spots of a frame, each with a look of its own, a little different from event to event."""
    look = F.col("session") % 3 * 40 + F.col("frame") % 7
    spots = tb.trajectory(spark, d).filter("x IS NOT NULL").groupBy(F.floor(F.col("session") / 3).alias("session"), "frame")
    listed = spots.agg(F.array_sort(F.collect_list(F.struct("x", "y", look.cast("double").alias("look")))).alias("spots"))
    return ids.track_animals(listed, 3, 60.0)


@query("SELECT session // 10 AS session, session % 10 AS animal, * EXCLUDE (session) FROM (" + ORACLES["zone_table"] + ")")
def animal_zones(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ids.animal_zones(_tracks(spark, d), tb.zones(spark), MIN_FRAMES, FPS))


# --- statistics in one call -----------------------------------------------------------------------------------------


def _design(spark: SparkSession, d: str) -> DataFrame:
    """Orders as rows of customers, nations as dams, with the names that a study's sheet has."""
    o, c = tb.table(spark, d, "orders"), tb.table(spark, d, "customer")
    columns = [F.col("c_custkey").alias("Animal ID"), F.col("c_mktsegment").alias("Group"), F.when(F.col("c_nationkey") > 2, F.col("c_nationkey")).alias("Dam ID"), F.year("o_orderdate").alias("Timepoint")]
    return o.join(c, o.o_custkey == c.c_custkey).select(*columns, F.col("o_orderstatus").alias("note"), F.col("o_totalprice").cast("double").alias("price"), F.length("o_orderpriority").alias("priority"))


DE = """de AS (SELECT c_custkey::VARCHAR AS a, c_mktsegment AS g, CASE WHEN c_nationkey > 2 THEN c_nationkey END::VARCHAR AS n, year(o_orderdate)::VARCHAR AS t, o_totalprice::DOUBLE AS price, length(o_orderpriority) AS priority
 FROM orders JOIN customer ON c_custkey = o_custkey)"""


@query(with_(DE) + 'SELECT a AS "Animal ID", g AS "Group", n AS "Dam ID", t AS "Timepoint", round(avg(price), 6) AS price, round(avg(priority), 6) AS priority FROM de GROUP BY ALL')
def subject_levels(spark: SparkSession, d: str) -> DataFrame:
    return rounded(adv.subject_levels(_design(spark, d)))


@query(
    with_(DE)
    + """, w AS (SELECT a, avg(price) FILTER (t = '1995') AS p, avg(price) FILTER (t = '1996') AS q FROM (SELECT a, g, n, t, avg(price) AS price FROM de GROUP BY ALL) GROUP BY a HAVING p IS NOT NULL AND q IS NOT NULL)
SELECT 'price' AS metric, '1995' AS "from", '1996' AS "to", count(*) AS n, round(avg(q - p), 6) AS change, 'paired t' AS test, round(avg(q - p) / (stddev_samp(q - p) / sqrt(count(*))), 6) AS statistic FROM w"""
)
def repeated_results(spark: SparkSession, d: str) -> DataFrame:
    rows = _design(spark, d).filter("Timepoint IN (1995, 1996)")
    return rounded(adv.repeated_measures(rows, ["price"]).select("metric", "from", "to", "n", "change", "test", "statistic"))


@query()
def litter_effects(spark: SparkSession, d: str) -> DataFrame:
    """Prices by segment and year, with intercepts for customers and nations; compared with dense matrices in the tests."""
    return rounded(adv.mixed_models(_design(spark, d), ["price"]))


@query()
def group_results(spark: SparkSession, d: str) -> DataFrame:
    """Two segments compared, with the bootstrap interval of the effect; compared with a loop in the tests."""
    return rounded(adv.between_groups(_design(spark, d).filter("Group IN ('BUILDING', 'MACHINERY')"), ["price"]))


# --- discs and smoothed maps ----------------------------------------------------------------------------------------

#: The signed area, within a disc of radius 20, of the triangle of the centre and the side from a to b.
DISC = """dc AS (SELECT t.*, place, zone, unnest([{'ax': x0, 'ay': y0, 'ex': x1, 'ey': y0}, {'ax': x1, 'ay': y0, 'ex': x1, 'ey': y1}, {'ax': x1, 'ay': y1, 'ex': x0, 'ey': y1}, {'ax': x0, 'ay': y1, 'ex': x0, 'ey': y0}]) AS s FROM t, z),
d1 AS (SELECT session, frame, status, place, zone, x, s.ax - x AS ax, s.ay - y AS ay, s.ex - x AS ex, s.ey - y AS ey FROM dc),
d2 AS (SELECT *, (ex - ax) ** 2 + (ey - ay) ** 2 AS qa, ax * (ex - ax) + ay * (ey - ay) AS qb, ax ** 2 + ay ** 2 - 400 AS qc FROM d1),
d3 AS (SELECT *, qb ** 2 - qa * qc AS root, least(greatest((-qb - sqrt(greatest(qb ** 2 - qa * qc, 0))) / qa, 0), 1) AS u, least(greatest((-qb + sqrt(greatest(qb ** 2 - qa * qc, 0))) / qa, 0), 1) AS v FROM d2),
d4 AS (SELECT *, ax + u * (ex - ax) AS px, ay + u * (ey - ay) AS py, ax + v * (ex - ax) AS qx, ay + v * (ey - ay) AS qy FROM d3),
d5 AS (SELECT *, CASE WHEN root > 0 AND u < v THEN 200 * atan2(ax * py - ay * px, ax * px + ay * py) + (px * qy - py * qx) / 2 + 200 * atan2(qx * ey - qy * ex, qx * ex + qy * ey) ELSE 200 * atan2(ax * ey - ay * ex, ax * ex + ay * ey) END AS part FROM d4),
df AS (SELECT session, frame, any_value(status) AS status, place, zone, CASE WHEN any_value(x) IS NOT NULL THEN least(abs(sum(part)) / (pi() * 400), 1) END AS fraction FROM d5 GROUP BY session, frame, place, zone)"""


@query(with_(T, Z, DISC) + "SELECT session, frame, zone, round(fraction, 6) + 0 AS fraction FROM df")
def disc_fractions(spark: SparkSession, d: str) -> DataFrame:
    found = geo.disc_fractions(tb.trajectory(spark, d), tb.zones(spark), tb.BODY)
    return rounded(found.select("session", "frame", "zone", "fraction")).withColumn("fraction", F.col("fraction") + 0)


@query(
    with_(T, Z, DISC)
    + "SELECT session, frame, zone, round(CASE status WHEN 'Tracked' THEN fraction WHEN 'Hidden' THEN (zone = 'Center')::INT END, 6) + 0 AS share FROM df"
)
def body_columns(spark: SparkSession, d: str) -> DataFrame:
    """Hidden frames are taken to be hidden in the centre."""
    rows = tb.trajectory(spark, d).withColumn("hidden_zone", F.when(F.col("status") == "Hidden", "Center"))
    found = geo.body_shares(rows, tb.zones(spark), tb.BODY)
    return rounded(found.select("session", "frame", "zone", "share")).withColumn("share", F.col("share") + 0)


@query(
    with_(T)
    + """, hc AS (SELECT least(floor(x / 500 * 50), 49)::BIGINT AS i, least(floor(y / 100 * 50), 49)::BIGINT AS j, count(*) AS n FROM t WHERE x IS NOT NULL GROUP BY ALL),
kr AS (SELECT k, exp(-k * k / 2.88) / (SELECT sum(exp(-r * r / 2.88)) FROM range(-5, 6) q(r)) AS w FROM range(-5, 6) s(k)),
im AS (SELECT i, m, CASE WHEN m < 0 THEN -1 - m WHEN m > 49 THEN 99 - m ELSE m END AS back FROM (SELECT i, i + k AS m FROM range(0, 50) t(i), range(-5, 6) s(k))),
hx AS (SELECT im.i, j, sum(n * w) AS h FROM im JOIN kr ON kr.k = m - im.i JOIN hc ON hc.i = back GROUP BY ALL),
hy AS (SELECT hx.i AS bin_x, im.i AS bin_y, sum(h * w) AS heat FROM im JOIN kr ON kr.k = m - im.i JOIN hx ON hx.j = back GROUP BY ALL)
SELECT bin_x, bin_y, round(heat, 6) AS heat, round(heat / (SELECT max(heat) FROM hy), 6) AS share FROM hy"""
)
def smoothed_heat_map(spark: SparkSession, d: str) -> DataFrame:
    cells = tr.heat_map(tb.trajectory(spark, d), tb.WIDTH, tb.HEIGHT)
    return rounded(geo.smoothed_counts(cells, 50))


# --- names of measures ----------------------------------------------------------------------------------------------


@query(
    with_(Z, "f(field, i, sheet, label, meaning, formula) AS (VALUES " + ", ".join(f"('{a}', {i}, '{b}', '{c}', '{e}', '{g}')" for i, (a, b, c, e, g) in enumerate(gl.FIELDS)) + ")")
    + ", mv AS (SELECT from_zone AS a, to_zone AS b FROM (" + ORACLES["transitions_from_to"] + """)),
al AS (SELECT replace(zone, ' ', '_') || '_' || field AS measure, replace(zone, ' ', '_') AS zone, field, sheet, zone || ' – ' || label AS label, CASE WHEN zone = 'Center' AND field = 'time_s' THEN 'Seconds in the centre.' ELSE meaning END AS meaning, formula, 0 AS block, i, place AS j FROM z, f
 UNION ALL SELECT 'Trans_' || replace(a, ' ', '_') || '_to_' || replace(b, ' ', '_'), NULL, NULL, 'entries', a || ' → ' || b, 'Moves from the first zone straight into the second.', 'moves counted', 2, 0, row_number() OVER (ORDER BY a, b) FROM mv)
SELECT measure, zone, field, sheet, row_number() OVER (PARTITION BY sheet ORDER BY CASE WHEN field = 'latency_s' THEN 1 ELSE block END, i, j, measure) AS place, label, meaning, formula FROM al"""
)
def measure_names(spark: SparkSession, d: str) -> DataFrame:
    """The names that a wide report of zones and moves between them has."""
    zone = F.regexp_replace("zone", " ", "_")
    fields = F.explode(F.array(*(F.lit(f) for f, *_ in gl.FIELDS))).alias("field")
    table = zn.zone_flags(tb.trajectory(spark, d), tb.zones(spark)).groupBy("zone").agg(F.min("place").alias("seq"))
    of_zones = table.select(zone.alias("zone"), "seq", fields).select(F.concat_ws("_", "zone", "field").alias("measure"), F.col("seq").cast("long").alias("seq"))
    moved = zn.transition_counts(zn.moves(zn.labelled(zn.zone_flags(tb.trajectory(spark, d), tb.zones(spark))), MIN_FRAMES)).select("from_zone", "to_zone")
    name = F.regexp_replace(F.concat(F.lit("Trans_"), "from_zone", F.lit("_to_"), "to_zone"), " ", "_")
    numbered = moved.select(name.alias("measure"), (100 + F.row_number().over(Window.orderBy("from_zone", "to_zone"))).cast("long").alias("seq"))  # pairs of zones
    return gl.describe(of_zones.unionByName(numbered)).withColumn("place", F.col("place").cast("long"))


# --- behaviours by session ------------------------------------------------------------------------------------------


@query(
    "WITH bo AS ("
    + ORACLES["zone_visits"]
    + "), "
    + T
    + ", "
    + Z
    + """, se AS (SELECT session, min(time_s) AS a, count(*) / 1.0 AS n FROM t GROUP BY session),
su AS (SELECT session, zone, sum(stop - start) AS s, count(*) AS k, min(start) AS f FROM bo GROUP BY ALL)
SELECT se.session, z.zone AS behaviour, round(se.n, 1) AS analysed_s, round(coalesce(s, 0), 2) AS time_s, round(100 * coalesce(s, 0) / se.n, 2) AS percent, coalesce(k, 0) AS bouts, round(f - a, 2) AS latency_s
FROM se CROSS JOIN z LEFT JOIN su ON su.session = se.session AND su.zone = z.zone"""
)
def behaviour_summary(spark: SparkSession, d: str) -> DataFrame:
    """Visits of zones as bouts of behaviours."""
    df = tb.trajectory(spark, d)
    bouts = zn.zone_visits(zn.zone_flags(df, tb.zones(spark)), MIN_FRAMES, FPS).withColumnRenamed("zone", "behaviour")
    sessions = df.groupBy("session").agg(F.min("time_s").alias("begin"), (F.count("*") / FPS).alias("length"))
    return cl.behaviour_summary(bouts, sessions, [n for n, *_ in tb.ZONES])


# --- freezing as a whole --------------------------------------------------------------------------------------------


def _analysed(spark: SparkSession, d: str) -> fr.Result:
    rows = _motion(spark, d).withColumn("usable", F.lit(True))
    return fr.analyse(rows, _epochs(spark, d), FPS, 80.0, 3 / FPS, 1 / FPS, 25.0, 33.2, 100.0)


def _tidied(source: str, period: str, name: str, skip: str) -> str:
    columns = f"* EXCLUDE ({skip})"
    return f"""SELECT session, '{period}' AS period, {name} AS name, measure, value FROM (UNPIVOT (SELECT session, {name} AS name, COLUMNS({columns})::DOUBLE FROM ({ORACLES[source]})) ON COLUMNS(* EXCLUDE (session, name)) INTO NAME measure VALUE value)"""


@query(
    "SELECT session, period, name::VARCHAR AS name, measure, round(value, 6) AS value FROM ("
    + _tidied("freezing_summary", "whole", "'whole'", "session").replace("'whole' AS name, measure", "name, measure")
    + " UNION ALL "
    + _tidied("pre_epoch", "epoch", "epoch", "session, epoch").replace("epoch AS name, measure", "name, measure")
    + " UNION ALL "
    + _tidied("freezing_bins", "bin", "bin::VARCHAR", "session, bin").replace("bin::VARCHAR AS name, measure", "name, measure")
    + ")"
)
def freezing_result(spark: SparkSession, d: str) -> DataFrame:
    """All measures of sessions, epochs and bins that one analysis gives."""
    return rounded(ft.study_tables(_analysed(spark, d))["tidy"])


def _wide(name: str, columns) -> str:
    return ", ".join(f"""max({c}) FILTER (epoch = '{name}') AS "{name} – {text}" """ for c, text in columns)


@query("SELECT session, " + ", ".join(_wide(n, ft.EPOCH) for n, *_ in sorted(EPOCHS, key=lambda e: e[1])) + " FROM (" + ORACLES["pre_epoch"] + ") GROUP BY session")
def freezing_batch(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ft.study_tables(_analysed(spark, d))["epochs"])


#: A view with a vanishing point: u = (1.2 x + 0.1 y + 10) / w, v = (0.9 y - 0.05 x + 5) / w, w = 0.001 x + 0.002 y + 1.
SEEN = (1.2, 0.1, 10.0, -0.05, 0.9, 5.0, 0.001, 0.002)


@query(
    with_(T)
    + "SELECT session, frame, round((1.2 * x + 0.1 * y + 10) / (0.001 * x + 0.002 * y + 1), 6) AS u, round((0.9 * y - 0.05 * x + 5) / (0.001 * x + 0.002 * y + 1), 6) AS v FROM t"
)
def seen_in_perspective(spark: SparkSession, d: str) -> DataFrame:
    """The view is known by where it takes the arena's corners."""
    a, b, c, p, q, r, g, h = SEEN
    source = tx.corners([(500.0, 100.0), (0.0, 0.0), (500.0, 0.0), (0.0, 100.0)])
    target = [((a * x + b * y + c) / (g * x + h * y + 1), (p * x + q * y + r) / (g * x + h * y + 1)) for x, y in source]
    u, v = tx.warped(F.col("x"), F.col("y"), tx.homography(source, target))
    return rounded(tb.trajectory(spark, d).select("session", "frame", u.alias("u"), v.alias("v")))


# --- zones and objects ----------------------------------------------------------------------------------------------


@query(with_(T, Z, FL) + "SELECT session, frame, coalesce(string_agg(zone, '_' ORDER BY place) FILTER (inside), 'None') AS roi FROM fl GROUP BY session, frame")
def joined_zones(spark: SparkSession, d: str) -> DataFrame:
    return ia.joined_labels(zn.zone_flags(tb.trajectory(spark, d), tb.zones(spark)))


@query(
    with_(T, Z, FL)
    + """, st AS (SELECT session, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step FROM t WINDOW w AS (PARTITION BY session ORDER BY frame)),
zs AS (SELECT session, replace(zone, ' ', '_') AS zone, count(*) FILTER (inside) AS n, count(*) AS m FROM fl GROUP BY ALL),
dd AS (SELECT session, frame, zone, x IS NOT NULL AND greatest(x0 - round_even(x, 0), round_even(x, 0) - x1, 0) ** 2 + greatest(y0 - round_even(y, 0), round_even(y, 0) - y1, 0) ** 2 <= 64 AS near FROM fl JOIN z USING (zone) WHERE zone LIKE 'Open%'),
di AS (SELECT *, frame - row_number() OVER (PARTITION BY session, zone ORDER BY frame) AS island FROM dd WHERE near),
db AS (SELECT session, zone, count(*) AS n FROM di GROUP BY session, zone, island HAVING count(*) >= 2),
ds AS (SELECT dd.session, replace(dd.zone, ' ', '_') AS zone, count(*) FILTER (near) AS s, (SELECT count(*) FROM db WHERE db.session = dd.session AND db.zone = dd.zone) AS n FROM dd GROUP BY dd.session, dd.zone)
SELECT session, 'Total_distance_pixels' AS measure, round(coalesce(sum(step), 0), 6) AS value FROM st GROUP BY session UNION ALL SELECT session, 'Total_distance_cm', round(coalesce(sum(step), 0) * 0.25, 6) FROM st GROUP BY session
UNION ALL SELECT session, zone || '_time_s', n FROM zs UNION ALL SELECT session, zone || '_percent', round(100 * n / m, 6) FROM zs UNION ALL SELECT session, zone || '_near_time_s', s FROM ds UNION ALL SELECT session, zone || '_bout_count', n FROM ds"""
)
def zone_interactions(spark: SparkSession, d: str) -> DataFrame:
    """The open arms as objects, with 8 pixels around them."""
    zones = tb.zones(spark)
    found, _ = ia.interaction_stats(tb.trajectory(spark, d), zones, zones.filter("zone LIKE 'Open%'"), FPS, 2.0, 8.0, 0.25)
    return rounded(found)
