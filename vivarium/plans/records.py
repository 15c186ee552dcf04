"""Queries of chambers, protocols, reports and audit trails, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vivarium.operators import animals as an
from vivarium.operators import chambers as ch
from vivarium.operators import events as ev
from vivarium.operators import statistics as st
from vivarium.operators import summary as sm
from vivarium.plans.catalogue import T, query, rounded, with_
from vivarium.sources import imports as im
from vivarium.sources import tables as tb

#: The arena as two chambers that overlap a little.
LAYOUT = [ch.Chamber(1, 0, 0, 260, 100, "Ada"), ch.Chamber(2, 240, 0, 500, 100)]
#: Zones with and without a chamber in their names; the last but one lies in no chamber.
NAMED = (*tb.ZONES, ("C2 · Nest", 0, 0, 10, 10), ("C1 · Closed Arm 2", 0, 0, 10, 10), ("C3 · Nest", 0, 0, 10, 10), ("Outside", 500, 0, 700, 100), ("Nest", 300, 0, 310, 10))

K = "k(n, x0, y0, x1, y1, animal) AS (VALUES " + ", ".join(f"({c.number}, {c.x0}, {c.y0}, {c.x1}, {c.y1}, '{c.animal}')" for c in LAYOUT) + ")"
ZN = "zn(place, name, x0, y0, x1, y1) AS (VALUES " + ", ".join(f"({i}, '{n}', {a}, {b}, {c}, {e})" for i, (n, a, b, c, e) in enumerate(NAMED)) + ")"


@query(
    with_(K, ZN)
    + """, zc AS (SELECT *, (x0 + x1) / 2.0 AS cx, (y0 + y1) / 2.0 AS cy, TRY_CAST(regexp_extract(name, 'C([0-9]+) · ', 1) AS INT) AS told FROM zn),
de AS (SELECT zc.place, k.n, least(cx - k.x0, k.x1 - cx, cy - k.y0, k.y1 - cy) AS depth FROM zc JOIN k ON cx BETWEEN k.x0 AND k.x1 AND cy BETWEEN k.y0 AND k.y1),
fi AS (SELECT place, n FROM de QUALIFY row_number() OVER (PARTITION BY place ORDER BY depth DESC, n) = 1),
fo AS (SELECT zc.place, CASE WHEN told IS NOT NULL THEN CASE WHEN told <= 2 THEN told END ELSE n END AS chamber, regexp_replace(name, 'C[0-9]+ · ', '') AS bare FROM zc LEFT JOIN fi ON fi.place = zc.place)
SELECT chamber, place, bare || repeat('''', row_number() OVER (PARTITION BY chamber, bare ORDER BY place) - 1) AS zone FROM fo WHERE chamber IS NOT NULL"""
)
def chamber_zones(spark: SparkSession, d: str) -> DataFrame:
    return ch.chamber_zones(tb.zones(spark, NAMED), LAYOUT).select("chamber", "place", "zone")


CT = """dp AS (SELECT t.*, n, animal, CASE WHEN x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 THEN least(x - x0, x1 - x, y - y0, y1 - y) END AS depth FROM t, k),
dk AS (SELECT *, depth IS NOT NULL AND row_number() OVER (PARTITION BY session, frame ORDER BY depth DESC NULLS LAST, n) = 1 AS own FROM dp),
ct AS (SELECT session || ' C' || n AS session, n AS chamber, CASE WHEN animal = '' THEN session || ' C' || n ELSE animal END AS subject, frame, time_s,
 CASE WHEN own THEN x END AS x, CASE WHEN own THEN y END AS y, CASE WHEN own THEN status ELSE 'Lost' END AS status FROM dk)"""


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    return ch.chamber_tracks(tb.trajectory(spark, d).withColumn("area", F.lit(1.0)), LAYOUT)


@query(with_(T, K, CT) + "SELECT session, chamber, subject, frame, x, y, status FROM ct")
def chamber_tracks(spark: SparkSession, d: str) -> DataFrame:
    return _tracks(spark, d).drop("time_s")


@query(
    with_(T, K, CT)
    + """, cs AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step FROM ct WINDOW w AS (PARTITION BY session ORDER BY frame))
SELECT session, chamber, subject, count(*) AS frames, round(100.0 * count(*) FILTER (status = 'Lost') / count(*), 6) AS lost_percent, round(coalesce(sum(step), 0), 6) AS distance FROM cs GROUP BY ALL"""
)
def chamber_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ch.chamber_summary(_tracks(spark, d)))


# --- protocols, reports, trails -------------------------------------------------------------------------------------


def _tones(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("r_regionkey") * 20.0 + 10.0
    return tb.table(spark, d, "region").select(F.col("r_name").alias("name"), start.alias("start"), (start + 10.0 + F.col("r_regionkey")).alias("end"))


TN = "tn AS (SELECT r_name AS name, r_regionkey * 20.0::DOUBLE + 10 AS start, r_regionkey * 20.0::DOUBLE + 20 + r_regionkey AS stop, r_regionkey AS i FROM region)"


@query(
    with_(TN)
    + """SELECT name, start, stop AS "end" FROM tn UNION ALL
SELECT CASE WHEN i = 0 THEN 'Baseline' ELSE 'ITI ' || i END, coalesce(was, 0), start FROM (SELECT *, lag(stop) OVER (ORDER BY start) AS was FROM tn) WHERE coalesce(was, 0) < start"""
)
def tone_protocol(spark: SparkSession, d: str) -> DataFrame:
    return ev.tone_protocol(_tones(spark, d))


@query(with_(TN) + """SELECT name, round(1.5 + start * 2, 4) AS start, round(1.5 + stop * 2, 4) AS "end" FROM tn""")
def shift_epochs(spark: SparkSession, d: str) -> DataFrame:
    return im.shift_epochs(_tones(spark, d), 1.5, 2.0)


@query("SELECT s_suppkey, s_nationkey, s_acctbal::DOUBLE AS s_acctbal FROM supplier")
def report_columns(spark: SparkSession, d: str) -> DataFrame:
    wide = tb.table(spark, d, "supplier").withColumn("s_acctbal", F.col("s_acctbal").cast("double"))
    return sm.report_columns(wide, ["s_suppkey"], ["s_acctbal", "s_nationkey", "no such column"])


@query("SELECT n_nationkey AS seq, n_nationkey = 0 OR n_nationkey % 2 = 1 AS valid FROM nation")
def audit_trail(spark: SparkSession, d: str) -> DataFrame:
    """Every second entry begins a chain of its own, so that only the first of these stands in its place."""
    hashed = lambda previous: F.sha2(F.concat_ws("|", previous, "n_name"), 256)
    rows = tb.table(spark, d, "nation").withColumn("alone", hashed(F.lit("")))
    before = F.lag("alone").over(Window.orderBy("n_nationkey"))  # 25 rows
    rows = rows.withColumn("previous", F.when(F.col("n_nationkey") % 2 == 1, before))
    trail = rows.select(F.col("n_nationkey").alias("seq"), F.col("n_name").alias("entry"), hashed(F.coalesce("previous", F.lit(""))).alias("hash"), "previous")
    return sm.audit_chain(trail).select("seq", "valid")


# --- looks of two animals -------------------------------------------------------------------------------------------


def _looks(spark: SparkSession, d: str) -> DataFrame:
    """A look of each of two animals by frame; those of odd sessions look alike."""
    e = tb.table(spark, d, "embeddings").withColumn("session", F.floor(F.col("vec_id") / 100))
    rows = e.select("session", (F.col("vec_id") % 100).alias("frame"), F.posexplode(F.slice("embedding", 1, 2)).alias("animal", "v"))
    return rows.select("session", "frame", "animal", (F.col("v").cast("double") * 10 + F.col("animal") * F.when(F.col("session") % 2 == 0, 100).otherwise(0)).alias("look"))


LK = """lk AS (SELECT vec_id // 100 AS session, vec_id % 100 AS frame, a AS animal, embedding[a + 1]::DOUBLE * 10 + a * CASE WHEN vec_id // 100 % 2 = 0 THEN 100 ELSE 0 END AS look FROM embeddings, (VALUES (0), (1)) t(a)),
md AS (SELECT session, animal, median(look) AS m, count(*) AS n FROM lk GROUP BY ALL),
mo AS (SELECT lk.session, lk.animal, any_value(m) AS look, greatest(1.5, 1.4826 * median(abs(look - m))) AS spread FROM lk JOIN md ON md.session = lk.session AND md.animal = lk.animal WHERE n >= 15 GROUP BY ALL)"""


@query(with_(LK) + "SELECT session, animal, round(look, 6) AS look, round(spread, 6) AS spread FROM mo")
def animal_looks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(an.looks(_looks(spark, d)))


@query(
    with_(LK)
    + """, ml AS (SELECT session, frame, max(look) FILTER (animal = frame % 2) AS p, max(look) FILTER (animal <> frame % 2) AS q FROM lk GROUP BY ALL),
tw AS (SELECT x.session, x.look AS lx, x.spread AS sx, y.look AS ly, y.spread AS sy FROM mo x JOIN mo y ON x.session = y.session AND x.animal = 0 AND y.animal = 1 WHERE abs(x.look - y.look) >= 4 * sqrt((x.spread ** 2 + y.spread ** 2) / 2))
SELECT ml.session, frame, CASE WHEN ((p - lx) / sx) ** 2 + ((q - ly) / sy) ** 2 <= ((q - lx) / sx) ** 2 + ((p - ly) / sy) ** 2 THEN '01' ELSE '10' END AS detections FROM ml JOIN tw ON tw.session = ml.session"""
)
def look_order(spark: SparkSession, d: str) -> DataFrame:
    """Of frames in which the detections of odd ones are listed the other way round."""
    rows = _looks(spark, d)
    at = lambda same: F.max(F.when((F.col("animal") == F.col("frame") % 2) == same, F.col("look")))
    met = rows.groupBy("session", "frame").agg(F.array(at(True), at(False)).alias("looks"))
    return an.look_order(met, an.looks(rows), 2).select("session", "frame", F.concat_ws("", F.col("order").cast("array<string>")).alias("detections"))


# --- studies --------------------------------------------------------------------------------------------------------


@query(
    """WITH c AS (SELECT l_suppkey AS session, avg((l_quantity > 25)::INT) * 100.0 AS a, avg((l_linenumber > 3)::INT) * 100.0 AS b, avg(((l_quantity > 25) = (l_linenumber > 3))::INT) AS same FROM lineitem GROUP BY 1),
k AS (SELECT *, a / 100 * b / 100 + (1 - a / 100) * (1 - b / 100) AS pe FROM c), g AS (SELECT count(*)::DOUBLE AS n, avg(a) AS ma, avg(b) AS mb, (avg(a) + avg(b)) / 2 AS m FROM k),
s AS (SELECT any_value(n) AS n, sum(2 * ((a + b) / 2 - m) ** 2) AS ss, any_value(n * ((ma - m) ** 2 + (mb - m) ** 2)) AS sc, sum((a - m) ** 2 + (b - m) ** 2) AS tot FROM k, g),
q AS (SELECT n, ss / (n - 1) AS msr, sc AS msc, (tot - ss - sc) / (n - 1) AS mse FROM s)
SELECT count(*) AS sessions, round(avg((same - pe) / (1 - pe)), 6) AS mean_kappa, round(avg(same) * 100, 6) AS mean_agreement, round(avg(a - b), 6) AS bias, round(avg(a - b) - 1.96 * stddev_samp(a - b), 6) AS lower,
 round(avg(a - b) + 1.96 * stddev_samp(a - b), 6) AS upper, round(corr(a, b), 6) AS r, (SELECT round((msr - mse) / (msr + mse + 2 * (msc - mse) / n), 6) FROM q) AS icc FROM k"""
)
def study_summary(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as sessions and their lines as frames, large quantities scored by machine and late lines by hand."""
    li = tb.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("session"), (F.col("l_quantity") > 25).alias("auto"), (F.col("l_linenumber") > 3).alias("hand"))
    a, h = F.avg(F.col("auto").cast("double")), F.avg(F.col("hand").cast("double"))
    c = li.groupBy("session").agg(a.alias("a"), h.alias("h"), F.avg((F.col("auto") == F.col("hand")).cast("double")).alias("same"))
    kappa = st.kappa(F.col("same"), F.col("a") * F.col("h") + (1 - F.col("a")) * (1 - F.col("h")), None)
    compared = c.select((F.col("a") * 100).alias("auto_percent"), (F.col("h") * 100).alias("hand_percent"), (F.col("same") * 100).alias("agreement"), kappa.alias("kappa"))
    return rounded(st.study_summary(compared))


@query(
    """WITH r AS (SELECT p_brand || ' ' || p_size AS metric, p_type AS "group", p_retailprice::DOUBLE AS value FROM part)
SELECT metric, "group", value FROM r WHERE metric IN (SELECT metric FROM r GROUP BY metric HAVING count(DISTINCT "group") >= 2 AND count(*) >= 4)"""
)
def plottable(spark: SparkSession, d: str) -> DataFrame:
    """Brands and sizes as metrics, types as groups."""
    metric = F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")).alias("metric")
    return st.plottable(tb.table(spark, d, "part").select(metric, F.col("p_type").alias("group"), F.col("p_retailprice").cast("double").alias("value")))
