"""Delayed live tracking: detections are kept in pieces as they come, with interim numbers, and analysed whole at the end."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vivarium.operators import trajectory, zones

FRAMES = "session long, frame long, time_s double, x double, y double, status string"
#: Seconds of a piece, and how many times its cost must pass before interim numbers are made again (fixed values).
PIECE_S, PAUSE = 10.0, 9.0


@dataclass
class Analysis:
    """What is made of a session's frames; interim numbers and final results are made the same way."""

    places: DataFrame
    fps: float
    max_gap: int = 5
    min_frames: int = 3
    min_move: float = 1.0

    def __call__(self, frames: DataFrame) -> DataFrame:
        """(session, zone, time_s, percent, entries, distance, tracked): short gaps are filled first."""
        filled = trajectory.gap_fill(frames, self.max_gap)
        filled = filled.withColumn("status", F.when(F.col("interpolated"), "Tracked").otherwise(F.col("status")))
        table = zones.zone_table(zones.zone_flags(filled, self.places), self.min_frames, self.fps).select("session", "zone", "time_s", "percent", "entries")
        way = trajectory.path_distance(filled, self.min_move).select("session", "distance")
        seen = frames.groupBy("session").agg((100 * F.avg(F.col("x").isNotNull().cast("int"))).alias("tracked"))
        return table.join(way, "session", "left").join(seen, "session", "left").withColumn("distance", F.coalesce("distance", F.lit(0.0)))


@dataclass
class DelayedTracker:
    """Pieces of a running recording below `folder`, which all machines share.

    `keep` is a foreachBatch function: a micro-batch is written to a folder of its own number, in place of what an attempt before
    it may have left there, so a batch that is run again changes nothing. `numbers` analyses the pieces that are whole: those that
    a later frame of their session has followed; `final` analyses everything.
    """

    folder: str
    analysis: Callable[[DataFrame], DataFrame]
    fps: float
    piece_s: float = PIECE_S
    pause: float = PAUSE
    _due: float = field(default=0.0, repr=False)

    @property
    def piece_frames(self) -> int:
        return max(2, round(self.piece_s * self.fps))

    def keep(self, batch: DataFrame, number: int) -> None:
        rows = batch.select(*(F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in FRAMES.split(", ")))
        rows.write.mode("overwrite").parquet(f"{self.folder}/pieces/batch={number}")
        if time.time() >= self._due:
            began = time.time()
            self.numbers(batch.sparkSession).write.mode("overwrite").parquet(f"{self.folder}/numbers/batch={number}")
            self._due = time.time() + self.pause * (time.time() - began)

    def frames(self, spark: SparkSession) -> DataFrame:
        """All frames kept so far; a frame that came twice counts once, as it came first."""
        kept = spark.read.schema(FRAMES + ", batch long").parquet(f"{self.folder}/pieces")
        rest = [c.split()[0] for c in FRAMES.split(", ")[2:]]
        one = F.min(F.struct("batch", *rest)).alias("one")
        return kept.groupBy("session", "frame").agg(one).select("session", "frame", *(F.col("one").getField(c).alias(c) for c in rest))

    def whole(self, spark: SparkSession) -> DataFrame:
        """Frames of the pieces that later frames have followed."""
        frames = self.frames(spark)
        ends = frames.groupBy("session").agg((F.floor(F.max("frame") / self.piece_frames) * self.piece_frames).alias("end"))
        return frames.join(ends, "session").filter(F.col("frame") < F.col("end")).drop("end")

    def numbers(self, spark: SparkSession) -> DataFrame:
        return self.analysis(self.whole(spark))

    def status(self, spark: SparkSession) -> DataFrame:
        """(session, recorded_s, processed_s, remaining_s): all that has come, and what the interim numbers hold."""
        n = self.piece_frames
        ends = self.frames(spark).groupBy("session").agg(F.count("*").alias("n"), F.max("frame").alias("last"))
        done = (F.floor(F.col("last") / n) * n) / self.fps
        recorded = (F.col("last") + 1) / self.fps
        return ends.select("session", recorded.alias("recorded_s"), done.alias("processed_s"), (recorded - done).alias("remaining_s"))

    def final(self, spark: SparkSession) -> DataFrame:
        return self.analysis(self.frames(spark))

    def start(self, frames: DataFrame, checkpoint: str, **trigger):
        """A streaming query over (session, frame, time_s, x, y, status) that keeps pieces and numbers as they come."""
        return frames.writeStream.foreachBatch(self.keep).option("checkpointLocation", checkpoint).trigger(**trigger).start()
