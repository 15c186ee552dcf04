"""Rank tests. Equal values are counted before anything is ranked, and ranks are summed within ranges of values, so no
task sees all values of a metric."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vivarium.operators.statistics import bh_of_metrics, gamma_share, p_column, steady_means, t_p

#: Least and most ranges of values by metric. Shapiro-Wilk is only defined for samples of 3 to 5,000 values.
RANGES, MOST_RANGES, SHAPIRO_MOST = 64, 4096, 5000
#: U is tested exactly if the smaller sample has at most so many values, and the pairs of values are so few.
EXACT_SMALL, EXACT_PAIRS, EXACT_PAIRED = 8, 100_000, 50
#: Fixed values of Royston's approximation (1995), lowest power first.
LAST, SECOND = (0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056), (0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_G, SMALL_M, SMALL_S = (-2.273, 0.459), (0.544, -0.39978, 0.025054, -6.714e-4), (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_M, LARGE_S = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)


def in_ranges(counts: DataFrame, keys: list[str], value: str, few: bool = True) -> DataFrame:
    """Adds __range to distinct values: approximate quantiles deal them to as many ranges as there are shuffle partitions
    (RANGES at least), so that what one task sorts stays the same size when data and partitions grow together.

    The cuts of few keys, a row for each metric or group, are broadcast, so that values stay spread as they are and don't
    meet in a task for each key. Many keys (sessions) are joined.
    """
    n = min(max(RANGES, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))), MOST_RANGES)
    each = F.when(F.col("tied") > 0, F.col(value)) if "tied" in counts.columns else value  # reads what the join reads: one shuffle of counts
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(each, F.array(*(F.lit(i / n) for i in range(1, n))), max(1000, 10 * n)).alias("__cuts"))
    cuts = F.broadcast(cuts) if few else cuts
    placed = counts.join(cuts, keys) if keys else counts.join(cuts)  # without keys: one row of cuts
    placed = placed.withColumn("__range", F.lit(0))
    for step in (2**b for b in reversed(range(n.bit_length()))):  # how many cuts are less, found by halves
        placed = placed.withColumn("__range", F.col("__range") + F.when(F.get("__cuts", F.col("__range") + (step - 1)) < F.col(value), step).otherwise(0))
    return placed.drop("__cuts")


def value_ranks(df: DataFrame, keys: list[str], value: str = "value", few: bool = True) -> DataFrame:
    """(*keys, value, tied, rank): each distinct value with how often it occurs and the mean rank of its ties.

    Values are ranked within ranges; a rank is the number of rows in the ranges before plus the rank within the range, so
    it is exact whatever the ranges are.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("tied"))
    return counts_ranked(counts, keys, value, few)


def counts_ranked(counts: DataFrame, keys: list[str], value: str, few: bool = True) -> DataFrame:
    """Adds rank to distinct values and how often each occurs, `tied`; other columns of counts are kept."""
    placed = in_ranges(counts, keys, value, few)
    sums = placed.groupBy(*keys, "__range").agg(F.sum("tied").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*keys, "__range", before.alias("__before"))
    inside = F.sum("tied").over(Window.partitionBy(*keys, "__range").orderBy(value))
    rank = F.col("__before") + inside - (F.col("tied") - 1) / 2
    return placed.join(starts, [*keys, "__range"]).select(*counts.columns, rank.alias("rank"))


def medians(long: DataFrame, keys: list[str], value: str = "value", few: bool = True) -> DataFrame:
    """(*keys, median): the mean of the values at the middle places."""
    ranked = value_ranks(long, keys, value, few)
    n = long.groupBy(*keys).agg(F.count(value).alias("__n"))
    half = (F.col("tied") - 1) / 2
    holds = lambda place: place.between(F.col("rank") - half, F.col("rank") + half)
    low, high = F.floor((F.col("__n") + 1) / 2), F.ceil((F.col("__n") + 1) / 2)
    of = lambda place: F.max(F.when(holds(place), F.col(value)))
    return ranked.join(n, keys).groupBy(*keys).agg(((of(low) + of(high)) / 2).alias("median"))


def bh_adjust(df: DataFrame, p: str = "p") -> DataFrame:
    """Adds q: the least of p x m / rank from the largest p down, at most 1; null p stay null and don't count in m.

    Equal p are counted first and ranked by ranges; the least of the ranges above is added to that within a range.
    """
    known = df.filter(F.col(p).isNotNull())
    ranked = value_ranks(known, [], p)
    total = known.agg(F.count("*").alias("__m"))
    last = F.col("rank") + (F.col("tied") - 1) / 2
    raw = ranked.join(F.broadcast(total)).select(p, F.least(F.col(p) * F.col("__m") / last, F.lit(1.0)).alias("__raw"))  # one row
    placed = in_ranges(raw, [], p)
    above = Window.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    least = placed.groupBy("__range").agg(F.min("__raw").alias("__least")).select("__range", F.min("__least").over(above).alias("__above"))  # a row per range
    within = F.min("__raw").over(Window.partitionBy("__range").orderBy(F.desc(p)))
    q = placed.join(least, "__range").select(p, F.least(within, F.col("__above")).alias("q"))
    return df.join(q, p, "left")


def signed_ranks(pairs: DataFrame) -> DataFrame:
    """Wilcoxon's signed ranks by metric, of (metric, d): n pairs that differ, w the lesser sum, z and p.

    p is exact for at most EXACT_PAIRED pairs without ties, else by the normal curve with the correction for ties.
    """
    rows = pairs.filter("d IS NOT NULL AND d <> 0").withColumn("value", F.abs("d"))
    own = rows.groupBy("metric", "value").agg(F.count("*").alias("tied"), F.count(F.when(F.col("d") > 0, 1)).alias("up"))
    t = F.col("tied").cast("double")
    s = counts_ranked(own, ["metric"], "value").groupBy("metric").agg(F.sum("tied").alias("n"), F.sum(F.col("up") * F.col("rank")).alias("plus"), F.sum(t**3 - t).alias("ties"))
    n = F.col("n")
    w = F.least("plus", n * (n + 1) / 2 - F.col("plus"))
    z = F.try_divide(w - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48))
    return s.select("metric", "n", w.alias("w"), z.alias("z"), w_p(w, z, n, (n <= EXACT_PAIRED) & (F.col("ties") == 0)).alias("p"))


def w_tail(w: float, n: int) -> float:
    """Two-sided exact p: the share of the 2**n choices of signs whose sum of ranks is at most w, twice."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for i in range(1, n + 1):
        ways[i:] = ways[i:] + ways[:-i]
    return min(1.0, 2 * float(ways[: int(w) + 1].sum() / ways.sum()))


def w_p(*columns: Column) -> Column:
    @F.pandas_udf("double")
    def run(w: pd.Series, z: pd.Series, n: pd.Series, exact: pd.Series) -> pd.Series:
        return pd.Series([w_tail(a, int(c)) if e else (None if pd.isna(b) else math.erfc(abs(b) / math.sqrt(2))) for a, b, c, e in zip(w, z, n, exact)], dtype=float)

    return run(*columns)


def t_quantile(share: float, df: float) -> float:
    """The t that a two-sided test of so many degrees of freedom reaches with p = 1 - share, by bisection."""
    low, high = 0.0, 1.0
    while t_p(high, df) > 1 - share:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if t_p(middle, df) > 1 - share else (low, middle)
    return (low + high) / 2


def change_over_time(means: DataFrame, first: str, second: str) -> DataFrame:
    """By metric of (subject, metric, timepoint, value), for subjects with both time points: n, change, its 95 % interval,
    test, statistic, p, and q over the metrics.

    A paired t; Wilcoxon's signed ranks with fewer than three pairs or where t isn't defined. Metrics with fewer than two
    pairs have no row.
    """
    at = lambda t: F.max(F.when(F.col("timepoint") == t, F.col("value")))
    times = means.withColumn("timepoint", F.col("timepoint").cast("string")).filter(F.col("timepoint").isin(first, second))
    pairs = steady_means(times, ["metric", "subject", "timepoint"], ["value"]).groupBy("metric", "subject").agg(at(first).alias("a"), at(second).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").select("metric", (F.col("b") - F.col("a")).alias("d"))
    s = pairs.groupBy("metric").agg(F.count("*").alias("n"), F.avg("d").alias("change"), F.stddev_samp("d").alias("sd")).filter("n > 1")
    se = F.col("sd") / F.sqrt("n")

    @F.pandas_udf("double")
    def reach(df: pd.Series) -> pd.Series:
        return df.map(lambda x: t_quantile(0.95, x))

    margin = reach((F.col("n") - 1).cast("double")) * se
    rows = s.withColumns({"t": F.try_divide("change", se), "margin": margin}).withColumn("p_t", p_column("t", F.col("t"), F.col("n") - 1))
    both = rows.join(signed_ranks(pairs).select("metric", "w", F.col("p").alias("p_w")), "metric", "left")
    ranked = (F.col("p_t").isNull() | (F.col("n") < 3)) & F.col("p_w").isNotNull()
    out = both.select(
        "metric", "n", "change", (F.col("change") - F.col("margin")).alias("low"), (F.col("change") + F.col("margin")).alias("high"), F.when(ranked, "Wilcoxon").otherwise("paired t").alias("test"),
        F.when(ranked, F.col("w")).otherwise(F.col("t")).alias("statistic"), F.when(ranked, F.col("p_w")).otherwise(F.col("p_t")).alias("p"),
    )
    return bh_of_metrics(out)


def rank_sums(long: DataFrame) -> DataFrame:
    """(metric, group, n, sum, ties): rows, sum of ranks, and sum of t**3 - t shared out over the groups' rows."""
    own = long.filter("value IS NOT NULL").groupBy("metric", "group", "value").agg(F.count("*").alias("own"))
    # groups go along with the values they share: no value is looked up again, as computed doubles can come out otherwise
    counts = own.groupBy("metric", "value").agg(F.sum("own").alias("tied"), F.collect_list(F.struct("group", "own")).alias("groups"))
    rows = counts_ranked(counts, ["metric"], "value").select("tied", "rank", "metric", F.inline("groups"))
    t = F.col("tied").cast("double")
    return rows.groupBy("metric", "group").agg(F.sum("own").cast("double").alias("n"), F.sum(F.col("own") * F.col("rank")).alias("sum"), F.sum(F.col("own") * (t * t - 1)).alias("ties"))


def kruskal(long: DataFrame) -> DataFrame:
    """Kruskal-Wallis H, corrected for ties, and its degrees of freedom, by metric; ties share their mean rank."""
    s = rank_sums(long).groupBy("metric").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("sum") * F.col("sum") / F.col("n")).alias("squares"), F.sum("ties").alias("ties"))
    n = F.col("n")
    h = F.try_divide(12 * F.col("squares"), n * (n + 1)) - 3 * (n + 1)
    return s.filter("k > 1").select("metric", F.try_divide(h, 1 - F.try_divide(F.col("ties"), n**3 - n)).alias("h"), (F.col("k") - 1).alias("df"))


def mann_whitney(long: DataFrame, a: str, b: str) -> DataFrame:
    """(metric, u, z, p) of the values of group a against b, two-sided: u counts pairs won by a, ties half.

    p is exact for a sample of at most EXACT_SMALL values, EXACT_PAIRS pairs and no ties, else by the normal curve with the corrections for
    ties and for continuity.
    """
    s = rank_sums(long.filter(F.col("group").isin(a, b)))
    of = lambda g, c: F.max(F.when(F.col("group") == g, F.col(c)))
    s = s.groupBy("metric").agg(of(a, "n").alias("n1"), of(b, "n").alias("n2"), of(a, "sum").alias("r1"), F.sum("ties").alias("ties")).filter("n1 IS NOT NULL AND n2 IS NOT NULL")
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    rows = s.select("metric", u.alias("u"), F.try_divide(F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)), sd).alias("z"), "n1", "n2", "ties")
    exact = (F.least("n1", "n2") <= EXACT_SMALL) & (n1 * n2 <= EXACT_PAIRS) & (F.col("ties") == 0)
    return rows.withColumn("p", u_p(F.col("u"), F.col("z"), F.col("n1"), F.col("n2"), exact)).select("metric", "u", "z", "p")


def u_tail(u: float, n1: int, n2: int) -> float:
    """Two-sided exact p of U without ties: the share of orders whose U is at least max(u, n1 n2 - u).

    The numbers of orders by U are the coefficients of the product of (1 - q**(large + i)) / (1 - q**i), i = 1 .. small.
    """
    small, large = min(n1, n2), max(n1, n2)
    ways = np.zeros(n1 * n2 + 1)
    ways[0] = 1
    for i in range(1, small + 1):
        shifted = np.zeros_like(ways)
        shifted[large + i :] = ways[: max(len(ways) - large - i, 0)]
        ways = ways - shifted
        for r in range(i):
            ways[r::i] = np.cumsum(ways[r::i])
    return min(1.0, 2 * float(ways[math.ceil(max(u, n1 * n2 - u)) :].sum() / ways.sum()))


def u_p(*columns: Column) -> Column:
    @F.pandas_udf("double")
    def run(u: pd.Series, z: pd.Series, n1: pd.Series, n2: pd.Series, exact: pd.Series) -> pd.Series:
        each = zip(u, z, n1, n2, exact)
        return pd.Series([u_tail(a, int(c), int(d)) if e else (None if pd.isna(b) else math.erfc(b / math.sqrt(2))) for a, b, c, d, e in each], dtype=float)

    return run(*columns)


def chi2_p(statistic: Column, df: Column) -> Column:
    """Upper tail of chi squared."""

    @F.pandas_udf("double")
    def run(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) else 1 - gamma_share(b / 2, a / 2) for a, b in zip(x, k)], dtype=float)

    return run(statistic, df)


def friedman(df: DataFrame, metric: str, levels: list) -> DataFrame:
    """(n, chi2, df, p) over subjects with a mean at every time point; ties within a subject share their mean rank."""
    k, names = len(levels), [f"t{i}" for i in range(len(levels))]
    time = F.col("timepoint")
    wide = df.groupBy("subject").agg(*(F.avg(F.when(time == v, F.col(metric))).alias(c) for v, c in zip(levels, names))).dropna(subset=names)
    values = F.array(*names)
    ranks = F.transform(values, lambda v: F.size(F.filter(values, lambda o: o < v)) + (F.size(F.filter(values, lambda o: o == v)) + 1) / 2)
    ties = F.aggregate(values, F.lit(0.0), lambda s, v: s + F.pow(F.size(F.filter(values, lambda o: o == v)).cast("double"), 2) - 1)
    rows = wide.select(ranks.alias("r"), ties.alias("ties"))
    s = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("ties"), F.lit(0.0)).alias("ties"), *(F.sum(F.col("r")[i]).alias(c) for i, c in enumerate(names)))
    squares = sum((F.col(c) * F.col(c) for c in names[1:]), F.col(names[0]) * F.col(names[0]))
    plain = F.try_divide(12 * squares, F.col("n") * k * (k + 1)) - 3 * F.col("n") * (k + 1)
    chi2 = F.try_divide(plain, 1 - F.try_divide(F.col("ties"), F.col("n") * k * (k * k - 1)))
    out = s.select("n", F.when(F.col("n") >= 2, chi2).alias("chi2"), F.lit(k - 1).alias("df"))
    return out.withColumn("p", chi2_p(F.col("chi2"), F.col("df")))


def levene(long: DataFrame) -> DataFrame:
    """Deviations from the group's median as values of their own: `anova` of them is Levene's test."""
    middle = medians(long, ["metric", "group"]).withColumnRenamed("median", "__median")
    return long.join(middle, ["metric", "group"]).select("metric", "group", F.abs(F.col("value") - F.col("__median")).alias("value"))


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """W and p of Royston's approximation; nan outside 3 to 5,000 values or without any spread."""
    n, x = len(x), np.sort(np.asarray(x, float))
    if not 3 <= n <= SHAPIRO_MOST or x[0] == x[-1]:
        return math.nan, math.nan
    poly = lambda c, v: float(np.polynomial.polynomial.polyval(v, c))
    normal = NormalDist()
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0, math.sqrt(0.5)])
    else:
        m = np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
        total, u = float(m @ m), 1 / math.sqrt(n)
        ends = [poly(LAST, u) + m[-1] / math.sqrt(total)]
        if n > 5:
            ends.append(poly(SECOND, u) + m[-2] / math.sqrt(total))
        k = len(ends)
        a = m * math.sqrt((1 - 2 * sum(e * e for e in ends)) / (total - 2 * float(m[n - k :] @ m[n - k :])))
        for i, e in enumerate(ends):
            a[i], a[n - 1 - i] = -e, e
    w = min(1.0, float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum()))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        top = poly(SMALL_G, n)
        if y >= top:
            return w, 0.0
        z = (-math.log(top - y) - poly(SMALL_M, n)) / math.exp(poly(SMALL_S, n))
    else:
        z = (y - poly(LARGE_M, math.log(n))) / math.exp(poly(LARGE_S, math.log(n)))
    return w, 0.5 * math.erfc(z / math.sqrt(2))


def normality(long: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(metric, group, n, w, p, normal). Samples under 3, over 5,000 or without spread count as normal and have no w;
    the others are at most 5,000 values each, which come to a task together."""
    sizes = long.groupBy("metric", "group").agg(F.count("value").alias("n"), F.stddev_samp("value").alias("sd"))
    tested = F.col("n").between(3, SHAPIRO_MOST) & (F.col("sd") > 0)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro_wilk(pdf["value"].to_numpy())
        return pd.DataFrame({"metric": [key[0]], "group": [key[1]], "w": [w], "p": [p]})

    small = long.filter("value IS NOT NULL").join(sizes.filter(tested).select("metric", "group"), ["metric", "group"])
    found = small.select("metric", "group", "value").groupBy("metric", "group").applyInPandas(run, "metric string, group string, w double, p double")
    out = sizes.drop("sd").join(found, ["metric", "group"], "left")
    return out.withColumn("normal", F.coalesce(F.col("p") >= alpha, F.lit(True)))
