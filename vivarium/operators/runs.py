"""Runs of equal values along a sequence: the base of all debounced state machines here."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def with_runs(df: DataFrame, keys: list[str], order: str, value: Column | str, run: str = "run") -> DataFrame:
    """Adds `run`: 1, 2, ... along each sequence, a new number wherever the value changes (null is a value of its own)."""
    v = F.col(value) if isinstance(value, str) else value
    w = ordered(keys, order)
    changed = (~v.eqNullSafe(F.lag(v).over(w))) | (F.row_number().over(w) == 1)
    return df.withColumn("__new", changed.cast("int")).withColumn(run, F.sum("__new").over(w)).drop("__new")


def run_table(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """A row for each run: its value, first and last place, number of rows, and first and last time_s."""
    named = with_runs(df, keys, order, value)
    return named.groupBy(*keys, "run").agg(
        F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), F.min("time_s").alias("t_first"), F.max("time_s").alias("t_last")
    )


def debounced(df: DataFrame, keys: list[str], order: str, flag: str, min_frames: int, out: str = "state") -> DataFrame:
    """Adds the state that changes only with a run of min_frames or more; the first run counts whatever its length."""
    named = with_runs(df, keys, order, flag)
    w = ordered(keys, order)
    # a run is told by its first row, with a look ahead, so that all windows share one order of rows
    first = ~F.col("run").eqNullSafe(F.lag("run").over(w))
    long = F.lead("run", max(math.ceil(min_frames) - 1, 0)).over(w) == F.col("run")
    kept = named.withColumns({"__first": first, "__long": long}).withColumn("__kept", F.when(F.col("__first") & (F.col("__long") | (F.col("run") == 1)), F.col(flag)))
    return kept.withColumn(out, F.last("__kept", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__first", "__long", "__kept", "run")


def ranges(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Consecutive numbers as texts: '3-5, 9' for each key."""
    w = ordered(keys, number)
    islands = df.select(*keys, number).distinct().withColumn("__island", F.col(number) - F.row_number().over(w))
    parts = islands.groupBy(*keys, "__island").agg(F.min(number).alias("a"), F.max(number).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string")))
    listed = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("a", text.alias("text")))).alias("parts"))
    return listed.select(*keys, F.array_join(F.col("parts")["text"], ", ").alias("ranges"))
