"""Bootstrap intervals whose draws are weights of values, so that Spark sums them up wherever the values are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DRAWS, SEED, SHARE = 2000, 1234, 95.0
#: Groups whose sums a task holds before it hands them on.
GROUPS_HELD = 500


def weights(key: int, tied: int, draws: int, seed: int) -> np.ndarray:
    """How often a value that occurs `tied` times is in each draw: a Poisson number of mean `tied`, by seed and key alone."""
    return np.random.Generator(np.random.Philox(key=[seed, key & (2**64 - 1)])).poisson(tied, draws).astype(float)


def drawn_moments(long: DataFrame, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(metric, group, moments) of (metric, group, value, middle): for each draw the sums of weights, of weighted values less
    middle and of their squares, as 3 x draws doubles.

    Equal values of a group are counted first and drawn together. A value's weights follow from the seed and a hash of metric,
    group and value, so they don't depend on where it is or how often a task runs.
    """
    counts = long.filter("value IS NOT NULL AND NOT isnan(value)").groupBy("metric", "group", "value").agg(F.count("*").alias("tied"), F.first("middle").alias("middle"))
    keyed = counts.select("metric", "group", (F.col("value") - F.col("middle")).alias("off"), "tied", F.xxhash64("metric", "group", "value").alias("key"))
    kinds = dict(long.dtypes)
    ddl = f"metric {kinds['metric']}, group {kinds['group']}, moments binary"

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def table(like: pa.RecordBatch) -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in held], like.column(i).type) for i in (0, 1)]
            out = pa.RecordBatch.from_arrays([*columns, pa.array([m.tobytes() for m in held.values()], pa.binary())], names=["metric", "group", "moments"])
            held.clear()
            return out

        last = None
        for batch in batches:
            last = batch
            for metric, group, value, tied, key in zip(*(c.to_pylist() for c in batch.columns)):
                w = weights(key, tied, draws, seed)
                if (metric, group) not in held:
                    if len(held) >= GROUPS_HELD:
                        yield table(batch)
                    held[metric, group] = np.zeros((3, draws))
                held[metric, group] += np.stack((w, w * value, w * value * value))
        if held:
            yield table(last)

    def added(parts: pa.Table) -> pa.Table:
        total = np.zeros(3 * draws)
        for moments in parts["moments"].to_pylist():
            total += np.frombuffer(moments)
        one = parts.slice(0, 1)
        return pa.table({"metric": one["metric"], "group": one["group"], "moments": pa.array([total.tobytes()], pa.binary())})

    parts = keyed.mapInArrow(draw, ddl)  # a row for each task and group
    return parts.groupBy("metric", "group").applyInArrow(added, ddl)


def d_interval(long: DataFrame, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(metric, low, high): the 95 % bootstrap interval of Cohen's d, for metrics of exactly two groups of two values or more.

    Each draw weighs all values of both groups by Poisson numbers; d is the difference of the weighted means, that of the
    group whose name sorts first minus the other, over the pooled spread. Values are centred on their metric's mean before. Draws
    without a spread don't count; without any that do, low and high are null.
    """
    sizes = long.filter("value IS NOT NULL AND NOT isnan(value)").groupBy("metric", "group").agg(F.count("*").alias("n"), F.sum("value").alias("s")).filter("n > 1")
    middle = sizes.groupBy("metric").agg(F.count("*").alias("k"), (F.sum("s") / F.sum("n")).alias("middle")).filter("k = 2").select("metric", "middle")
    used = long.join(sizes.select("metric", "group"), ["metric", "group"], "left_semi").join(middle, "metric")
    pairs = drawn_moments(used, draws, seed).groupBy("metric").agg(F.sort_array(F.collect_list(F.struct("group", "moments"))).alias("m"))  # two rows each

    @F.pandas_udf("low double, high double")
    def reach(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([interval(np.frombuffer(x).reshape(3, -1), np.frombuffer(y).reshape(3, -1)) for x, y in zip(a, b)], columns=["low", "high"])

    return pairs.select("metric", reach(F.col("m")[0]["moments"], F.col("m")[1]["moments"]).alias("r")).select("metric", "r.low", "r.high")


def interval(a: np.ndarray, b: np.ndarray) -> tuple[float | None, float | None]:
    with np.errstate(all="ignore"):
        spread = lambda m: m[2] - m[1] * m[1] / m[0]
        pooled = np.sqrt((spread(a) + spread(b)) / (a[0] + b[0] - 2))
        d = (a[1] / a[0] - b[1] / b[0]) / pooled
    d = d[np.isfinite(d) & (pooled > 0)]
    if not len(d):
        return None, None
    low, high = np.percentile(d, [(100 - SHARE) / 2, (100 + SHARE) / 2])
    return float(low), float(high)
