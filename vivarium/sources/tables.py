"""Views of the driver's tables in the engine's own schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vivarium.operators.statistics import steady_means

FPS, WIDTH, HEIGHT = 1.0, 500, 100
#: name, x0, y0, x1, y1 of rectangular zones in the 500 x 100 arena; the first of overlapping zones names a frame.
ZONES = (
    ("Center", 150, 30, 350, 70),
    ("Open Arm 1", 0, 0, 150, 100),
    ("Open Arm 2", 350, 0, 500, 100),
    ("Closed Arm 1", 150, 70, 350, 100),
    ("Closed Arm 2", 150, 0, 350, 30),
)
#: The same arena divided for other tests.
LIGHT_DARK = (("Light box", 0, 0, 250, 100), ("Dark box", 250, 0, 500, 100))
T_MAZE = (("Stem", 0, 0, 200, 100), ("Centre", 200, 0, 300, 100), ("Goal left", 300, 0, 500, 45), ("Goal right", 300, 55, 500, 100))
SOCIAL = (("Social side", 0, 0, 150, 100), ("Middle", 150, 0, 350, 100), ("Object side", 350, 0, 500, 100))
#: Half the side of the square that stands for an animal's body.
BODY = 20.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, frame, time_s, x, y, status: a user's events in order; position unknown where Lost."""
    e = table(spark, sf_dir, "events")
    frame = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    status = F.when(F.col("event_type") == "error", "Lost").when(F.col("event_type") == "signup", "Hidden").otherwise("Tracked")
    seen = F.col("status") != "Lost"
    rows = e.select(F.col("user_id").alias("session"), frame.alias("frame"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), status.alias("status"))
    return rows.select("session", "frame", (F.col("frame") / FPS).alias("time_s"), F.when(seen, F.col("x")).alias("x"), F.when(seen, F.col("y")).alias("y"), "status")


def zones(spark: SparkSession, listed=ZONES) -> DataFrame:
    """place, zone, polygon."""
    rows = [(i, n, [(float(a), float(b)), (float(c), float(b)), (float(c), float(d)), (float(a), float(d))]) for i, (n, a, b, c, d) in enumerate(listed)]
    return spark.createDataFrame(rows, "place int, zone string, polygon array<struct<x:double,y:double>>")


def body_shares(rows: DataFrame, listed=ZONES) -> DataFrame:
    """session, frame, time_s, status, place, zone, share: how much of a square body around (x, y) lies in each zone."""
    each = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(n).alias("zone"), *(F.lit(float(v)).alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), box))) for i, (n, *box) in enumerate(listed)))
    over = lambda c: F.greatest(F.least(F.col(c) + BODY, F.col(f"z.{c}1")) - F.greatest(F.col(c) - BODY, F.col(f"z.{c}0")), F.lit(0.0))
    share = F.when(F.col("x").isNotNull(), over("x") * over("y") / (4 * BODY * BODY))
    return rows.withColumn("z", F.explode(each)).select("session", "frame", "time_s", "status", "z.place", "z.zone", share.alias("share"))


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, seq, behaviour, kind, start, stop: point events have no stop."""
    e = table(spark, sf_dir, "events")
    start = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 1e6
    point = F.col("event_type").isin("signup", "purchase")
    rows = e.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("behaviour"), F.when(point, "point").otherwise("state").alias("kind"), start.alias("start"), "value")
    return rows.select("session", "seq", "behaviour", "kind", "start", F.when(F.col("kind") == "state", F.col("start") + F.col("value")).alias("stop"))


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, group, timepoint, price: orders as repeated measurements of customers."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("group"), F.year("o_orderdate").alias("timepoint"), F.col("o_totalprice").cast("double").alias("price"), F.col("c_acctbal").cast("double").alias("balance"))


def raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, month, a, b: two measurements of the same thing; means are added up in the order of the file's rows."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(
        F.col("l_suppkey").alias("subject"), F.month("l_shipdate").alias("month"), F.col("l_quantity").cast("double").alias("a"), F.col("l_discount").cast("double").alias("b"),
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("place"),
    )
    return steady_means(rows, ["subject", "month"], ["a", "b"], ["path", "place"]).withColumn("b", F.col("b") * 500)


def motion_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, frame, hist: 64 grey levels counted; sessions of 100 frames."""
    e = table(spark, sf_dir, "embeddings")
    return e.select((F.floor(F.col("vec_id") / 100)).alias("session"), (F.col("vec_id") % 100).alias("frame"), F.transform("embedding", lambda v: F.floor(F.abs(v) * 1000).cast("int")).alias("hist"))
