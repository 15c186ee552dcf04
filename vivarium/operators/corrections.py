"""Corrections by hand, the status a frame ends up with, and epochs and subjects named from a design."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vivarium.operators.trajectory import gap_fill


def corrected(df: DataFrame, corrections: DataFrame) -> DataFrame:
    """Positions with corrections (session, frame, kind, x, y) in place: 'set' is Tracked there, 'absent' is Lost and never
    filled. Adds corrected and absent; of several corrections of a frame, that of the greatest seq counts."""
    last = corrections.groupBy("session", "frame").agg(F.max_by(F.struct("kind", "x", "y"), "seq").alias("c"))
    rows = df.join(last, ["session", "frame"], "left")
    gone, placed = F.coalesce(F.col("c.kind") == "absent", F.lit(False)), F.coalesce(F.col("c.kind") == "set", F.lit(False))
    pick = lambda a: F.when(placed, F.col(f"c.{a}")).when(~gone, F.col(a))
    status = F.when(placed, "Tracked").when(gone, "Lost").otherwise(F.col("status"))
    return rows.withColumns({"x": pick("x"), "y": pick("y"), "status": status, "corrected": placed, "absent": gone}).drop("c")


def effective_status(df: DataFrame, max_gap: int) -> DataFrame:
    """Adds `shown` to corrected rows (hidden: boolean, optional): Corrected, Detected, Interpolated, Hidden, Not visible
    or Lost, the first that holds. A gap is filled if it is short, but not where the animal is known to be absent."""
    seen = df.withColumns({c: F.when(F.col("status") == "Tracked", F.col(c)) for c in ("x", "y")})
    filled = gap_fill(seen, max_gap)
    inside = F.coalesce(F.col("hidden"), F.lit(False)) if "hidden" in df.columns else F.lit(False)
    shown = F.when(F.col("corrected"), "Corrected").when(F.col("status") == "Tracked", "Detected").when(F.col("interpolated") & ~F.col("absent"), "Interpolated")
    return filled.withColumn("shown", shown.when(inside, "Hidden").when(F.col("absent"), "Not visible").otherwise("Lost"))


def fill_between(corrections: DataFrame) -> DataFrame:
    """(session, frame, x, y) of the frames between the two latest 'set' corrections of a session, on a straight line."""
    w = Window.partitionBy("session").orderBy(F.desc("seq"))
    two = corrections.filter("kind = 'set'").withColumn("i", F.row_number().over(w)).filter("i <= 2")
    at = F.array_sort(F.collect_list(F.struct("frame", "x", "y")))
    ends = two.groupBy("session").agg(at.alias("p")).filter(F.size("p") == 2).select("session", F.col("p")[0].alias("a"), F.col("p")[1].alias("b")).filter("b.frame - a.frame > 1")
    rows = ends.withColumn("frame", F.explode(F.sequence(F.col("a.frame") + 1, F.col("b.frame") - 1)))
    t = (F.col("frame") - F.col("a.frame")) / (F.col("b.frame") - F.col("a.frame"))
    line = lambda c: F.round(F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * t, 2).alias(c)
    return rows.select("session", "frame", line("x"), line("y"))


def numbered_names(epochs: DataFrame) -> DataFrame:
    """Epochs (session, seq, name, ...) of equal names in a session become name 1, name 2, ... in order."""
    same = Window.partitionBy("session", "name")
    n, i = F.count("*").over(same), F.row_number().over(same.orderBy("seq"))
    numbered = epochs.withColumns({"__n": n, "__i": i})
    return numbered.withColumn("name", F.when(F.col("__n") > 1, F.concat("name", F.lit(" "), F.col("__i").cast("string"))).otherwise(F.col("name"))).drop("__n", "__i")


def subject_groups(design: DataFrame, subject: str, columns: tuple[str, ...] = ("Group", "group", "Treatment")) -> DataFrame:
    """(subject, group): of a subject's first design row (by seq), the first of the columns that isn't empty."""
    low = [c for c in columns if c in design.columns]
    given = F.coalesce(*(F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in low), F.lit(None).cast("string"))
    return design.groupBy(F.col(subject).alias("subject")).agg(F.min_by(F.struct(given.alias("g")), "seq")["g"].alias("group"))


def transition_table(moves: DataFrame, zones: list[str]) -> DataFrame:
    """Counts of moves from each zone (rows) to each (columns) with a Total; moves without an origin are left out."""
    known = moves.filter(F.col("from_zone").isNotNull() & ~F.lower(F.trim("from_zone")).isin("", "none", "nan"))
    wide = known.groupBy("from_zone").pivot("to_zone", zones).agg(F.count(F.lit(1)))
    zero = [F.coalesce(F.col(f"`{z}`"), F.lit(0)).alias(z) for z in zones]
    total: Column = F.lit(0)
    for z in zones:
        total = total + F.coalesce(F.col(f"`{z}`"), F.lit(0))
    return wide.select("from_zone", *zero, total.alias("Total"))


def numbered_moves(moves: DataFrame) -> DataFrame:
    """Adds move, 1, 2, ... by session in order of time."""
    return moves.withColumn("move", F.row_number().over(Window.partitionBy("session").orderBy("time_s")))
