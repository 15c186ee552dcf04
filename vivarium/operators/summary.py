"""Summary tables: long and wide forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vivarium.operators.ranks import value_ranks

UNIT = r"\(([^()]*)\)\s*$"
#: Rows of a wide table that are put together in one place.
ROWS = 4096


def tidy(df: DataFrame, ids: list[str], measures: list[str]) -> DataFrame:
    """(ids, measure, unit, value): a unit in brackets at the end of a name is split off; missing values are left out."""
    long = df.select(*ids, *(F.col(f"`{m}`").cast("double").alias(m) for m in measures)).unpivot(ids, [F.col(f"`{m}`") for m in measures], "name", "value")
    long = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return long.select(*ids, F.trim(F.regexp_replace("name", UNIT, "")).alias("measure"), F.regexp_extract("name", UNIT, 1).alias("unit"), "value")


def prism(df: DataFrame, group: str, value: str, groups: list[str]) -> DataFrame:
    """One column per group, the k-th value of a group on row k; null values are left out. Values are ranked by ranges.

    Equal values travel as one, cut where a block of ROWS rows ends, and become rows where their block is put together. The
    number of parts is told, as a few values can stand for many rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = value_ranks(df, [group], value)
    first = (F.col("rank") - (F.col("tied") - 1) / 2).cast("long")
    runs = ranked.select(group, value, first.alias("first"), (first + F.col("tied") - 1).alias("last"))
    cut = runs.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / ROWS), F.floor(F.col("last") / ROWS)))).repartition(parts, "block")
    rows = cut.withColumn("row", F.explode(F.sequence(F.greatest("first", F.col("block") * ROWS), F.least("last", F.col("block") * ROWS + (ROWS - 1)))))
    return rows.groupBy("block", "row").agg(*(F.max(F.when(F.col(group) == g, F.col(value))).alias(g) for g in groups)).drop("block")


def merge_case_duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that are one but for their case become one, the first with a value winning."""
    by: dict[str, list[str]] = {}
    for c in columns:
        by.setdefault(c.lower(), []).append(c)
    return df.select(*(F.coalesce(*(F.col(f"`{c}`") for c in cs)).alias(cs[0]) for cs in by.values()))


def report_columns(df: DataFrame, ids: list[str], wanted: list[str]) -> DataFrame:
    """Ids and the wanted columns in the table's order; unknown names are ignored."""
    return df.select(*(c for c in df.columns if c in ids or c in wanted))


def window_features(df: DataFrame, keys: list[str], order: str, columns: list[str], width: int) -> DataFrame:
    """Rolling mean, population sd, least and greatest of each column over a centred window that shrinks at the ends."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(width // 2), width - 1 - width // 2)
    stats = (("mean", F.avg), ("sd", F.stddev_pop), ("min", F.min), ("max", F.max))
    return df.select(*keys, order, *(f(c).over(w).alias(f"{c}_{n}") for c in columns for n, f in stats))


def audit_chain(df: DataFrame) -> DataFrame:
    """(seq, entry, hash, previous): `valid` where previous is the hash of the row before."""
    w = Window.orderBy("seq")  # one trail
    return df.withColumn("valid", F.col("previous").eqNullSafe(F.lag("hash").over(w)) & (F.col("hash") == F.sha2(F.concat_ws("|", F.coalesce("previous", F.lit("")), "entry"), 256)))
