"""Queries of corrections, features, several animals, tables in and out, and paired statistics, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vivarium.functions import text as tx
from vivarium.operators import animals as an
from vivarium.operators import bins as bn
from vivarium.operators import corrections as co
from vivarium.operators import features as ft
from vivarium.operators import freezing_result as fr
from vivarium.operators import ranks as rk
from vivarium.operators import stops as st
from vivarium.operators.statistics import steady_means
from vivarium.operators import zones as zn
from vivarium.plans.catalogue import E_, FL, FPS, FS, L, H, M, SU, T, Z, _moves, _states, flags, query, rounded, with_
from vivarium.plans.measures import EPOCHS, _epochs, _flags, _period_sql
from vivarium.sources import sinks
from vivarium.sources import tables as tb

# --- corrections ----------------------------------------------------------------------------------------------------


def _corrections(spark: SparkSession, d: str) -> DataFrame:
    rows = tb.trajectory(spark, d).filter("frame % 7 = 3")
    kind = F.when(F.col("frame") % 2 == 0, "absent").otherwise("set")
    return rows.select("session", "frame", F.col("frame").alias("seq"), kind.alias("kind"), (F.col("frame") * 5.0).alias("x"), (F.col("frame") * 0.5).alias("y"))


CO = """co AS (SELECT session, frame, CASE WHEN frame % 2 = 0 THEN 'absent' ELSE 'set' END AS kind, frame * 5.0 AS cx, frame * 0.5 AS cy FROM t WHERE frame % 7 = 3),
cr AS (SELECT t.session, t.frame, CASE WHEN kind = 'set' THEN cx WHEN kind IS NULL THEN x END AS x, CASE WHEN kind = 'set' THEN cy WHEN kind IS NULL THEN y END AS y,
 CASE WHEN kind = 'set' THEN 'Tracked' WHEN kind = 'absent' THEN 'Lost' ELSE status END AS status, coalesce(kind = 'set', false) AS corrected, coalesce(kind = 'absent', false) AS absent FROM t LEFT JOIN co ON co.session = t.session AND co.frame = t.frame)"""


@query(with_(T, CO) + "SELECT session, frame, x, y, status, corrected, absent FROM cr")
def corrections(spark: SparkSession, d: str) -> DataFrame:
    return co.corrected(tb.trajectory(spark, d), _corrections(spark, d)).drop("time_s")


@query(
    with_(T, CO)
    + """, g AS (SELECT *, last_value(CASE WHEN status = 'Tracked' THEN frame END IGNORE NULLS) OVER (PARTITION BY session ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
 first_value(CASE WHEN status = 'Tracked' THEN frame END IGNORE NULLS) OVER (PARTITION BY session ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM cr)
SELECT session, frame, CASE WHEN corrected THEN 'Corrected' WHEN status = 'Tracked' THEN 'Detected' WHEN a IS NOT NULL AND b IS NOT NULL AND b - a - 1 <= 2 AND NOT absent THEN 'Interpolated'
 WHEN status = 'Hidden' THEN 'Hidden' WHEN absent THEN 'Not visible' ELSE 'Lost' END AS shown FROM g"""
)
def effective_status(spark: SparkSession, d: str) -> DataFrame:
    rows = co.corrected(tb.trajectory(spark, d), _corrections(spark, d)).withColumn("hidden", F.col("status") == "Hidden")
    return co.effective_status(rows, 2).select("session", "frame", "shown")


@query(
    with_(T, CO)
    + """, w AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY frame DESC) AS i FROM co WHERE kind = 'set'), e AS (SELECT session, min(frame) AS a, max(frame) AS b FROM w WHERE i <= 2 GROUP BY session HAVING count(*) = 2)
SELECT session, f AS frame, round(f * 5.0, 2) AS x, round(f * 0.5, 2) AS y FROM (SELECT session, unnest(range(a + 1, b)) AS f FROM e)"""
)
def fill_between(spark: SparkSession, d: str) -> DataFrame:
    return co.fill_between(_corrections(spark, d))


@query(
    """SELECT user_id AS session, event_id AS seq, CASE WHEN count(*) OVER (PARTITION BY user_id, event_type) > 1
 THEN event_type || ' ' || row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) ELSE event_type END AS name FROM events"""
)
def numbered_names(spark: SparkSession, d: str) -> DataFrame:
    return co.numbered_names(tb.scored_events(spark, d).select("session", "seq", F.col("behaviour").alias("name")))


@query(
    """SELECT o_custkey AS subject, arg_min(coalesce(nullif(trim(CASE WHEN o_orderstatus = 'O' THEN ' ' ELSE o_orderstatus END), ''), o_orderpriority), o_orderkey) AS "group" FROM orders GROUP BY 1"""
)
def subject_groups(spark: SparkSession, d: str) -> DataFrame:
    o = tb.table(spark, d, "orders")
    group = F.when(F.col("o_orderstatus") == "O", " ").otherwise(F.col("o_orderstatus"))
    return co.subject_groups(o.select("o_custkey", F.col("o_orderkey").alias("seq"), group.alias("Group"), F.col("o_orderpriority").alias("Treatment")), "o_custkey")


ZN = [n for n, *_ in tb.ZONES]


@query(with_(T, Z, FL, L, M) + "SELECT from_zone, " + ", ".join(f"count(*) FILTER (to_zone = '{z}') AS \"{z}\"" for z in ZN) + ', count(*) AS "Total" FROM m GROUP BY from_zone')
def transition_table(spark: SparkSession, d: str) -> DataFrame:
    return co.transition_table(_moves(spark, d), ZN)


@query(with_(T, Z, FL, L, M) + "SELECT *, row_number() OVER (PARTITION BY session ORDER BY time_s) AS move FROM m")
def numbered_moves(spark: SparkSession, d: str) -> DataFrame:
    return co.numbered_moves(_moves(spark, d))


# --- features -------------------------------------------------------------------------------------------------------


def _points(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    made = {"nose_x": x + 10, "nose_y": y * 2 - 50, "centre_x": x, "centre_y": y, "tail_base_x": x - 15, "tail_base_y": y + 5, "head_motion": y / 10}
    return tb.trajectory(spark, d).select("session", "frame", "x", "y", *(c.alias(n) for n, c in made.items()), (F.col("status") == "Tracked").alias("seen"))


BF = """s3 AS (SELECT *, avg(x) OVER w AS sx, avg(y) OVER w AS sy, atan2(y - 50, 10) AS h FROM t WINDOW w AS (PARTITION BY session ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
gr AS (SELECT *, lag(frame) OVER w IS NULL AS f, lead(frame) OVER w IS NULL AS l, lag(sx) OVER w AS px, lead(sx) OVER w AS nx, lag(sy) OVER w AS py, lead(sy) OVER w AS ny, h - coalesce(lag(h) OVER w, h) AS turn FROM s3 WINDOW w AS (PARTITION BY session ORDER BY frame)),
bf AS (SELECT session, frame, sqrt((CASE WHEN f THEN nx - sx WHEN l THEN sx - px ELSE (nx - px) / 2 END) ** 2 + (CASE WHEN f THEN ny - sy WHEN l THEN sy - py ELSE (ny - py) / 2 END) ** 2) / 40 AS speed, y / 10 AS head_motion,
 (25 + CASE WHEN x IS NOT NULL THEN greatest(y * 2 - 50, y, y + 5) - least(y * 2 - 50, y, y + 5) END) / 40 AS spread, sqrt(25 ** 2 + (y - 55) ** 2) / 40 AS length, sqrt(10 ** 2 + (y - 50) ** 2) / 40 AS nose_distance,
 abs(atan2(sin(turn), cos(turn))) AS turning, CASE WHEN status = 'Tracked' THEN 1.0 ELSE 0.0 END AS seen FROM gr)"""


@query(with_(T, BF) + "SELECT session, frame, round(speed, 6) AS speed, head_motion, round(spread, 6) AS spread, round(length, 6) AS length, round(nose_distance, 6) AS nose_distance, round(turning, 6) AS turning, seen::DOUBLE AS seen FROM bf")
def base_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ft.base_features(_points(spark, d), FPS, 40.0).select("session", "frame", "speed", "head_motion", "spread", "length", "nose_distance", "turning", "seen"))


SHOWN = ("speed", "speed_mean3s", "speed_sd3s", "turning_mean0.33s", "turning_min1s", "head_motion_sd1s", "seen")


@query(
    with_(T, BF)
    + """SELECT session, frame, 100 AS n, round(speed, 6) AS speed, round(avg(speed) OVER w5, 6) AS speed_mean3s, round(stddev_pop(speed) OVER w5, 6) AS speed_sd3s, round(avg(turning) OVER w1, 6) AS turning_mean033s, round(min(turning) OVER w2, 6) AS turning_min1s,
 round(stddev_pop(head_motion) OVER w2, 6) AS head_motion_sd1s, seen::DOUBLE AS seen FROM bf
WINDOW w1 AS (PARTITION BY session ORDER BY frame ROWS BETWEEN 0 PRECEDING AND 0 FOLLOWING), w2 AS (PARTITION BY session ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 0 FOLLOWING), w5 AS (PARTITION BY session ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)"""
)
def context_features(spark: SparkSession, d: str) -> DataFrame:
    """All 100 features at two frames a second; some of them named."""
    base = ft.base_features(_points(spark, d), FPS, 40.0)
    names = ft.feature_names()
    found = ft.context_features(base, 2.0)
    return rounded(found.select("session", "frame", F.size("features").alias("n"), *(F.col("features")[names.index(c)].alias(c.replace(".", "")) for c in SHOWN)))


@query(with_(T, E_) + "SELECT t.session, t.frame, EXISTS (SELECT 1 FROM cl WHERE cl.session = t.session AND behaviour = 'click' AND kind = 'state' AND t.frame * 400000.0 >= start AND t.frame * 400000.0 < stop) AS truth FROM t")
def label_frames(spark: SparkSession, d: str) -> DataFrame:
    from vivarium.plans.catalogue import _clipped

    frames = tb.trajectory(spark, d).select("session", "frame")
    return ft.label_frames(frames, _clipped(spark, d), "click", 1 / 400000.0)


# --- several animals ------------------------------------------------------------------------------------------------


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of ten users, each of them an animal."""
    rows = tb.trajectory(spark, d)
    status = F.when(F.col("status") == "Lost", "lost").when(F.col("status") == "Hidden", "partial").otherwise("ok")
    return rows.select(F.floor(F.col("session") / 10).alias("session"), (F.col("session") % 10).alias("animal"), "frame", "time_s", "x", "y", status.alias("status"))


TK = """tk AS (SELECT session // 10 AS session, session % 10 AS animal, frame, time_s, x, y, CASE status WHEN 'Lost' THEN 'lost' WHEN 'Hidden' THEN 'partial' ELSE 'ok' END AS status FROM t),
ts AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS step FROM tk WINDOW w AS (PARTITION BY session, animal ORDER BY frame))"""


@query(
    with_(T, TK)
    + """, se AS (SELECT session, animal, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step FROM tk WHERE status <> 'lost' AND x IS NOT NULL WINDOW w AS (PARTITION BY session, animal ORDER BY frame)),
le AS (SELECT session, animal, coalesce(sum(step), 0) AS distance FROM se GROUP BY ALL)
SELECT tk.session, tk.animal, count(*) FILTER (status <> 'lost' AND x IS NOT NULL) AS tracked, count(*) FILTER (status = 'lost') AS lost, count(*) FILTER (status = 'partial') AS partial,
 round(100.0 * count(*) FILTER (status <> 'lost' AND x IS NOT NULL) / count(*), 6) AS quality, round(coalesce(any_value(distance), 0), 6) AS distance FROM tk LEFT JOIN le ON le.session = tk.session AND le.animal = tk.animal GROUP BY tk.session, tk.animal"""
)
def animal_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(an.animal_summary(_tracks(spark, d)))


AE = bn.bin_edges(0.0, 60.3, 20.0)


@query(
    with_(T, TK, "eb(bin, a, b) AS (VALUES " + ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(zip(AE, AE[1:]))) + ")")
    + """SELECT k.session, k.animal, eb.bin, eb.a::DOUBLE AS start_s, eb.b::DOUBLE AS end_s, round(coalesce(sum(step), 0), 6) AS distance, count(*) FILTER (status <> 'lost') AS frames FROM (SELECT DISTINCT session, animal FROM tk) k CROSS JOIN eb
LEFT JOIN ts ON ts.session = k.session AND ts.animal = k.animal AND time_s >= eb.a AND time_s < eb.b GROUP BY ALL"""
)
def animal_bins(spark: SparkSession, d: str) -> DataFrame:
    return rounded(an.animal_bins(_tracks(spark, d), AE, 20.0)).drop("label")


@query(with_(T, TK) + "SELECT session, animal, frame, CASE status WHEN 'lost' THEN 'Lost' WHEN 'partial' THEN 'Partial' ELSE 'Tracked' END AS status, round(CASE WHEN x IS NULL THEN 0 ELSE step END, 6) AS distance FROM ts")
def animal_bridge(spark: SparkSession, d: str) -> DataFrame:
    return rounded(an.bridge(_tracks(spark, d)).select("session", "animal", "frame", "status", "distance"))


@query()
def animal_identities(spark: SparkSession, d: str) -> DataFrame:
    """Three users at a time as the spots of a frame."""
    spots = tb.trajectory(spark, d).filter("x IS NOT NULL").groupBy(F.floor(F.col("session") / 3).alias("session"), "frame").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("spots"))
    return an.identities(spots, 3)


@query(
    with_(T, Z, FL)
    + """, o AS (SELECT session, zone AS object, frame, coalesce(inside, false) AS near FROM fl), o1 AS (SELECT *, frame - row_number() OVER (PARTITION BY session, object ORDER BY frame) AS island FROM o WHERE near)
SELECT session, object, min(frame) AS first, max(frame) AS last, min(frame) / 1.0 AS start, max(frame) / 1.0 AS "end", count(*) / 1.0 AS duration FROM o1 GROUP BY session, object, island HAVING count(*) >= 2"""
)
def object_bouts(spark: SparkSession, d: str) -> DataFrame:
    return an.object_bouts(_flags(spark, d).select("session", F.col("zone").alias("object"), "frame", F.col("inside").alias("near")), FPS, 2.0)


@query(
    "WITH "
    + T.replace("value END AS x", "value + 10 END AS x")
    + ", "
    + Z
    + ", "
    + FL
    + """, k AS (SELECT session, count(*) FILTER (zone = 'Open Arm 1' AND inside) / 1.0 AS novel_s, count(*) FILTER (zone = 'Open Arm 2' AND inside) / 1.0 AS familiar_s FROM fl GROUP BY session)
SELECT *, novel_s + familiar_s AS total_s, round((novel_s - familiar_s) / nullif(novel_s + familiar_s, 0), 6) AS discrimination, round(novel_s / nullif(novel_s + familiar_s, 0), 6) AS ratio, round(100 * novel_s / nullif(novel_s + familiar_s, 0), 6) AS recognition_percent FROM k"""
)
def nose_exploration(spark: SparkSession, d: str) -> DataFrame:
    nose = tb.trajectory(spark, d).withColumn("x", F.col("x") + 10)
    return rounded(an.nose_exploration(zn.zone_flags(nose, tb.zones(spark)), FPS, "Open Arm 1", "Open Arm 2"))


# --- tables in and out ----------------------------------------------------------------------------------------------


@query(
    """SELECT o_orderkey AS "Video", o_orderstatus AS status, CAST(s.q AS DOUBLE) AS quantity, s.n AS lines FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1) s ON l_orderkey = o_orderkey"""
)
def merged_sheets(spark: SparkSession, d: str) -> DataFrame:
    info = tb.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("Video"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("left_out"))
    sheet = tb.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("Video")).agg(F.sum("l_quantity").cast("double").alias("quantity"), F.count("*").alias("lines"))
    return sinks.merge_sheets(info, [sheet, sheet.select("Video", "lines")]).withColumn("Video", F.col("Video").cast("long"))


@query("SELECT * FROM (VALUES ('o_orderkey'), ('o_custkey'), ('o_totalprice')) t(metric)")
def metric_columns(spark: SparkSession, d: str) -> DataFrame:
    names = sinks.numeric_metric_columns(tb.table(spark, d, "orders"))
    return spark.createDataFrame([(n,) for n in names], "metric string")


TIDY_EPOCHS = "ep(epoch, a, b) AS (VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE)" for n, a, b in EPOCHS) + ")"


@query(
    with_(H, FS, TIDY_EPOCHS, _period_sql("ep", "pe"))
    + """SELECT session, 'epoch' AS period, epoch AS name, measure, round(value, 6) AS value FROM (UNPIVOT (SELECT session, epoch, start_s::DOUBLE AS start_s, end_s::DOUBLE AS end_s, percent::DOUBLE AS percent, seconds::DOUBLE AS seconds, bouts::DOUBLE AS bouts,
 mean_motion, length_s::DOUBLE AS length_s, mean_bout_s::DOUBLE AS mean_bout_s FROM pe) ON COLUMNS(* EXCLUDE (session, epoch)) INTO NAME measure VALUE value)"""
)
def freezing_tidy(spark: SparkSession, d: str) -> DataFrame:
    states = _states(spark, d)
    out = sinks.freezing_tidy(fr.summary(states, FPS), fr.periods(states, _epochs(spark, d), FPS), fr.bins(states, 33.2, 0.0, 100.0, FPS))
    return rounded(out.filter("period = 'epoch'"))


# --- statistics -----------------------------------------------------------------------------------------------------


@query(
    with_(SU)
    + """, pa AS (SELECT subject, m AS metric, avg(v) FILTER (timepoint = 1996) - avg(v) FILTER (timepoint = 1995) AS d FROM (SELECT subject, timepoint, 'price' AS m, price AS v FROM su UNION ALL SELECT subject, timepoint, 'cents', (price * 100) % 97 FROM su) GROUP BY ALL),
q AS (SELECT metric, abs(d) AS v, d FROM pa WHERE d <> 0), r AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY v) + (count(*) OVER (PARTITION BY metric, v) - 1) / 2.0 AS rank FROM q)
SELECT metric, count(*) AS n, round(least(coalesce(sum(rank) FILTER (d > 0), 0), sum(rank) - coalesce(sum(rank) FILTER (d > 0), 0)), 6) AS w FROM r GROUP BY metric"""
)
def signed_ranks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rk.signed_ranks(_pairs(spark, d)).select("metric", F.col("n").cast("long").alias("n"), "w"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    s = tb.subjects(spark, d)
    both = s.withColumn("m", F.explode(F.array(F.struct(F.lit("price").alias("metric"), F.col("price").alias("value")), F.struct(F.lit("cents").alias("metric"), (F.col("price") * 100 % 97).alias("value")))))
    times = both.filter(F.col("timepoint").isin(1995, 1996)).select("subject", "timepoint", "m.metric", "m.value")
    at = lambda t: F.max(F.when(F.col("timepoint") == t, F.col("value")))
    return steady_means(times, ["subject", "metric", "timepoint"], ["value"]).groupBy("subject", "metric").agg((at(1996) - at(1995)).alias("d"))


@query(
    with_(SU)
    + """, pa AS (SELECT subject, avg(price) FILTER (timepoint = 1996) - avg(price) FILTER (timepoint = 1995) AS d FROM su GROUP BY ALL)
SELECT 'price' AS metric, count(d) AS n, round(avg(d), 6) AS change, 'paired t' AS test, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) AS statistic FROM pa"""
)
def change_over_time(spark: SparkSession, d: str) -> DataFrame:
    long = tb.subjects(spark, d).select("subject", F.lit("price").alias("metric"), "timepoint", F.col("price").alias("value"))
    return rounded(rk.change_over_time(long, "1995", "1996").select("metric", "n", "change", "test", "statistic"))


@query(
    """SELECT l_partkey AS part, k AS kappa, CASE WHEN k <= 0 THEN 'poor' WHEN k <= 0.2 THEN 'slight' WHEN k <= 0.4 THEN 'fair' WHEN k <= 0.6 THEN 'moderate' WHEN k <= 0.8 THEN 'substantial' ELSE 'almost perfect' END AS word
FROM (SELECT l_partkey, round(avg(l_discount::DOUBLE) * 12 - 0.1, 6) AS k FROM lineitem GROUP BY 1)"""
)
def kappa_words(spark: SparkSession, d: str) -> DataFrame:
    k = tb.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.round(F.avg(F.col("l_discount").cast("double")) * 12 - 0.1, 6).alias("kappa"))
    return k.withColumn("word", tx.agreement_word(F.col("kappa")))


@query(with_(T) + "SELECT session, frame, round(u, 6) AS u, round(v, 6) AS v FROM (SELECT session, frame, (x * 2 + 10) AS u, (y * 3 - 5) AS v FROM t)")
def seen_from_above(spark: SparkSession, d: str) -> DataFrame:
    source = tx.corners([(500.0, 100.0), (0.0, 0.0), (500.0, 0.0), (0.0, 100.0)])
    u, v = tx.warped(F.col("x"), F.col("y"), tx.homography(source, [(2 * x + 10, 3 * y - 5) for x, y in source]))
    return rounded(tb.trajectory(spark, d).select("session", "frame", u.alias("u"), v.alias("v")))


STOPS = """sm AS (SELECT *, coalesce(status = 'Tracked', false) AS tr, row_number() OVER (PARTITION BY session ORDER BY frame) AS place FROM t),
sl AS (SELECT *, last_value(CASE WHEN tr THEN {'x': x, 'y': y} END IGNORE NULLS) OVER (PARTITION BY session ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM sm),
sd AS (SELECT *, CASE WHEN tr THEN coalesce(sqrt((x - seen.x) ** 2 + (y - seen.y) ** 2), 0) ELSE 0 END AS moved FROM sl),
sr AS (SELECT *, place - coalesce(max(CASE WHEN NOT (tr AND moved < 200) THEN place END) OVER (PARTITION BY session ORDER BY frame), 0) AS n, sum(moved) OVER (PARTITION BY session ORDER BY frame) AS far FROM sd),
se AS (SELECT session, frame, coalesce(status = 'Tracked', false) AND coalesce(inside, false) AS here FROM fl WHERE place = 0),
sn AS (SELECT *, here AND NOT coalesce(lag(here) OVER (PARTITION BY session ORDER BY frame), false) AS new FROM se),
sc AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY session ORDER BY frame) AS entries FROM sn)"""


@query(
    with_(T, Z, FL, STOPS)
    + """SELECT 'rested' AS rule, session, min(frame) AS frame FROM sr WHERE n >= 3 GROUP BY session UNION ALL
SELECT 'walked', session, min(frame) FROM sr WHERE far >= 1000.5 GROUP BY session UNION ALL SELECT 'entered', session, min(frame) FROM sc WHERE entries >= 2 GROUP BY session"""
)
def stop_rules(spark: SparkSession, d: str) -> DataFrame:
    df = tb.trajectory(spark, d)
    found = [("rested", st.rested(df, 3 / FPS, FPS, 200.0)), ("walked", st.walked(df, 1000.5)), ("entered", st.entered(flags(spark, d).filter(F.col("zone") == tb.ZONES[0][0]), 2))]
    rested, walked, entered = (x.select(F.lit(name).alias("rule"), "session", "frame") for name, x in found)
    return rested.unionByName(walked).unionByName(entered)
