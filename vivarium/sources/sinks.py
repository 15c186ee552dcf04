"""Summary tables in and out. Writers take a folder that all executors reach; Spark writes the parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words in the names of columns that are no measures.
NO_METRIC = ("video", "subject", "file", "path", "folder", "group", "status", "date")
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def write_csv(df: DataFrame, folder: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(folder)
    return folder


def read_csv(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(folder)


def merge_sheets(info: DataFrame, sheets: list[DataFrame]) -> DataFrame:
    """One row per row of info: its columns that are no numbers, and the new columns of each sheet by Video, and by Chamber
    where both tables have it. Of a sheet's rows of equal key one counts, that of the least values."""
    low = {"Video", "Chamber"}
    out = info.select(*(c for c, t in info.dtypes if c in low or not (t in NUMBERS or t.startswith("decimal"))))
    for sheet in sheets:
        key = [c for c in ("Video", "Chamber") if c in sheet.columns and c in out.columns]
        new = [c for c in sheet.columns if c not in out.columns]
        one = sheet.groupBy(*key).agg(F.min(F.struct(*new)).alias("s")).select(*key, *(F.col("s").getField(c).alias(c) for c in new))
        out = out.join(one, key, "left")
    return out


def read_batch_summary(spark: SparkSession, folder: str, sheets: list[str]) -> DataFrame:
    """The tables of a batch, each a folder of CSV parts: `info` and the named sheets, as one table."""
    return merge_sheets(read_csv(spark, f"{folder}/info"), [read_csv(spark, f"{folder}/{s}") for s in sheets])


def numeric_metric_columns(df: DataFrame, group: str = "Group") -> list[str]:
    """Columns of numbers with two values or more whose names speak of a measure; one pass over df."""
    names = [c for c, t in df.dtypes if (t in NUMBERS or t.startswith("decimal")) and c != group and not any(w in c.lower() for w in NO_METRIC)]
    if not names:
        return []
    counts = df.agg(*(F.count(F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`"))).alias(c) for c in names)).first()
    return [c for c in names if counts[c] >= 2]


def batch_sheets(long: DataFrame, measures: dict[str, list[str]]) -> dict[str, DataFrame]:
    """A wide table per kind of measure from (video, measure, value): a row per video, a column per listed measure."""
    return {kind: long.filter(F.col("measure").isin(*names)).groupBy("video").pivot("measure", names).agg(F.first("value")) for kind, names in measures.items()}


def write_batch_summary(long: DataFrame, measures: dict[str, list[str]], folder: str) -> list[str]:
    return [write_csv(sheet, f"{folder}/{kind}") for kind, sheet in batch_sheets(long, measures).items()]


def freezing_tidy(summary: DataFrame, epochs: DataFrame, bins: DataFrame) -> DataFrame:
    """(session, period, name, measure, value): measures of whole sessions, of epochs and of bins in one long table."""

    def long(df: DataFrame, period: str, name) -> DataFrame:
        skip = {"session", "epoch", "bin"}
        measures = [c for c, t in df.dtypes if c not in skip and t != "string"]
        each = F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in measures))
        rows = df.select("session", F.lit(period).alias("period"), name.cast("string").alias("name"), F.explode(each).alias("m"))
        return rows.select("session", "period", "name", "m.*").filter("value IS NOT NULL AND NOT isnan(value)")

    return long(summary, "whole", F.lit("whole")).unionByName(long(epochs, "epoch", F.col("epoch"))).unionByName(long(bins, "bin", F.col("bin")))


def frame_table(df: DataFrame, fps: float) -> DataFrame:
    """Frames for a report: number, time, motion and freezing as 0 or 1."""
    return df.select("session", F.col("frame").alias("Frame"), F.round(F.col("frame") / fps, 4).alias("Time_s"), F.round("motion", 4).alias("Motion_pct"), F.col("freezing").cast("int").alias("Freezing"))


def chamber_summary(df: DataFrame) -> DataFrame:
    """One row per chamber: the columns that hold one value."""
    return df.select(*(c for c, t in df.dtypes if not t.startswith(("array", "map", "struct", "binary"))))


def write_predictions(frames: DataFrame, bouts: DataFrame, folder: str) -> list[str]:
    return [write_csv(frames.select("session", "frame", F.round("p", 4).alias("p")), f"{folder}/frames"), write_csv(bouts, f"{folder}/bouts")]


def audit_append(trail: DataFrame, entries: DataFrame) -> DataFrame:
    """A trail (seq, entry, hash, previous) with entries (seq, entry) of greater seq added, each hash over the hash before.

    One trail is a short list: its new entries are chained by one aggregate.
    """
    last = trail.agg(F.max_by("hash", "seq").alias("h"))
    listed = entries.agg(F.array_sort(F.collect_list(F.struct("seq", "entry"))).alias("e")).join(last)  # two single rows
    kind = "array<struct<seq:bigint,entry:string,hash:string,previous:string>>"

    def step(a, x):
        previous = F.when(F.size(a) > 0, F.element_at(a, -1)["hash"]).otherwise(F.col("h"))
        made = F.sha2(F.concat_ws("|", F.coalesce(previous, F.lit("")), x["entry"]), 256)
        return F.concat(a, F.array(F.struct(x["seq"].cast("long").alias("seq"), x["entry"].alias("entry"), made.alias("hash"), previous.alias("previous"))).cast(kind))

    start = F.filter(F.array(F.struct(F.lit(0).cast("long").alias("seq"), F.lit("").alias("entry"), F.lit("").alias("hash"), F.lit("").alias("previous"))).cast(kind), lambda x: x["seq"] > 0)
    added = listed.select(F.explode(F.aggregate("e", start, step)).alias("r")).select("r.*")
    return trail.select("seq", "entry", "hash", "previous").unionByName(added)


def case_conflicts(df: DataFrame, columns: list[str]) -> list[tuple[str, str]]:
    """Pairs of columns, equal but for case, that are both filled in some row: these aren't one column."""
    by: dict[str, list[str]] = {}
    for c in columns:
        by.setdefault(c.lower(), []).append(c)
    pairs = [(a, b) for cs in by.values() for i, a in enumerate(cs) for b in cs[i + 1 :]]
    if not pairs:
        return []
    filled = df.agg(*(F.bool_or(F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull()).alias(str(i)) for i, (a, b) in enumerate(pairs))).first()
    return [p for i, p in enumerate(pairs) if filled[str(i)]]


def first_seen(df: DataFrame, value: str, order: str = "seq") -> DataFrame:
    """(value, place): distinct values by where they first occur."""
    return df.groupBy(value).agg(F.min(order).alias("first")).withColumn("place", F.row_number().over(Window.orderBy("first", value))).drop("first")  # a short list of names
