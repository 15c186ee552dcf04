"""Group statistics and agreement. Statistics are SQL aggregates; p-values come from numeric distribution functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- distributions --------------------------------------------------------------------------------------------------


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny) if abs(1 - (a + b) * x / (a + 1)) > tiny else 1 / tiny
    f = d
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + k / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def t_p(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return beta_share(df / 2, 0.5, df / (df + t * t))


def f_p(f: float, d1: float, d2: float) -> float:
    """Upper tail of F."""
    return beta_share(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def gamma_share(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function: the series up to a + 1, a continued fraction beyond."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return front * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    f = d
    for i in range(1, 500):
        b += 2
        d = 1 / (b - i * (i - a) * d)
        c = b - i * (i - a) / c
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 - front * f


def p_column(kind: str, *columns: Column) -> Column:
    """p-values of a small result table, in Arrow batches."""
    fn = {"t": t_p, "f": f_p}[kind]

    @F.pandas_udf("double")
    def run(*values: pd.Series) -> pd.Series:
        return pd.Series([fn(*v) if not any(pd.isna(x) for x in v) else None for v in zip(*values)], dtype=float)

    return run(*columns)


# --- groups ---------------------------------------------------------------------------------------------------------


def conflicts(df: DataFrame) -> DataFrame:
    """Subjects that occur in more than one group."""
    return df.groupBy("subject").agg(F.count_distinct("group").alias("groups")).filter("groups > 1").select("subject")


def steady_means(df: DataFrame, keys: list[str], values: list[str], order: list[str] | None = None) -> DataFrame:
    """(*keys, *values): means added up in a fixed order of rows, so that the last digits of a mean, and with them ties and
    thresholds, don't depend on how rows are dealt to tasks. Without an order, there is one column of values, in its own order."""
    w = Window.partitionBy(*keys).orderBy(*(order or values))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = df.select(*keys, *(F.avg(v).over(whole).alias(v) for v in values), F.row_number().over(w).alias("__row"))
    return rows.filter("__row = 1").drop("__row")


def subject_means(df: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per subject and group, long: (metric, subject, group, value); subjects in several groups are left out."""
    kept = df.join(conflicts(df), "subject", "left_anti").select("subject", "group", *(F.col(m).cast("double").alias(m) for m in metrics))
    long = kept.unpivot(["subject", "group"], metrics, "metric", "value").filter("value IS NOT NULL")
    return steady_means(long, ["subject", "group", "metric"], ["value"])


def descriptives(long: DataFrame) -> DataFrame:
    """n, mean, sd, sem and median by metric and group."""
    from vivarium.operators.ranks import medians

    of = long.groupBy("metric", "group").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("sem"))
    return of.join(medians(long, ["metric", "group"]), ["metric", "group"], "left")


def welch(long: DataFrame, a: str, b: str) -> DataFrame:
    """t, degrees of freedom, Cohen's d (pooled) and p for two groups, by metric."""
    of = lambda g, f: f(F.when(F.col("group") == g, F.col("value")))
    s = long.groupBy("metric").agg(*(of(g, f).alias(f"{n}{i}") for i, g in ((1, a), (2, b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    v1, v2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(v1 + v2))
    df = F.try_divide((v1 + v2) * (v1 + v2), v1 * v1 / (F.col("n1") - 1) + v2 * v2 / (F.col("n2") - 1))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))
    rows = s.filter("n1 > 1 AND n2 > 1").select("metric", t.alias("t"), df.alias("df"), F.try_divide(F.col("m1") - F.col("m2"), pooled).alias("cohen_d"))
    return rows.withColumn("p", p_column("t", F.col("t"), F.col("df")))


def anova(long: DataFrame) -> DataFrame:
    """F, degrees of freedom, eta squared and p over all groups with two values or more, by metric."""
    g = long.groupBy("metric", "group").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v")).filter("n > 1")
    g = g.withColumn("grand", F.sum(F.col("n") * F.col("m")).over(Window.partitionBy("metric")) / F.sum("n").over(Window.partitionBy("metric")))
    s = g.groupBy("metric").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("m") - F.col("grand")) ** 2).alias("between"), F.sum((F.col("n") - 1) * F.col("v")).alias("within"))
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    rows = s.filter("k > 1").select("metric", F.try_divide(F.col("between") / d1, F.col("within") / d2).alias("f"), d1.alias("df_between"), d2.alias("df_within"), F.try_divide(F.col("between"), F.col("between") + F.col("within")).alias("eta2"))
    return rows.withColumn("p", p_column("f", F.col("f"), F.col("df_between"), F.col("df_within")))


def bh_adjust(df: DataFrame, p: str = "p") -> DataFrame:
    """Adds q, Benjamini and Hochberg's adjusted p; see ranks.bh_adjust."""
    from vivarium.operators.ranks import bh_adjust

    return bh_adjust(df, p)


def bh_of_metrics(df: DataFrame, p: str = "p") -> DataFrame:
    """The same for a result with one row per metric, which one task sorts: ranges would repeat the plan behind it."""
    known = F.col(p).isNotNull()
    down = Window.orderBy(F.col(p).desc_nulls_first())
    rows = df.withColumn("__m", F.count(F.when(known, 1)).over(Window.partitionBy()))
    rows = rows.withColumn("__rank", F.row_number().over(Window.orderBy(F.col(p).asc_nulls_last())))
    raw = F.when(known, F.least(F.col(p) * F.col("__m") / F.col("__rank"), F.lit(1.0)))
    return rows.withColumn("q", F.when(known, F.min(raw).over(down))).drop("__m", "__rank")


def paired(df: DataFrame, metric: str, first: str, second: str) -> DataFrame:
    """Paired t between two time points of subjects that have both: n, mean change, sd, t and p."""
    time = F.col("timepoint").cast("string")
    per = df.groupBy("subject").agg(F.avg(F.when(time == first, F.col(metric))).alias("a"), F.avg(F.when(time == second, F.col(metric))).alias("b"))
    d = F.col("b") - F.col("a")
    s = per.filter("a IS NOT NULL AND b IS NOT NULL").agg(F.count("*").alias("n"), F.avg(d).alias("change"), F.stddev_samp(d).alias("sd"))
    rows = s.withColumn("t", F.try_divide(F.col("change"), F.col("sd") / F.sqrt("n")))
    return rows.withColumn("p", p_column("t", F.col("t"), F.col("n") - 1))


def design_audit(df: DataFrame, roles: list[str]) -> DataFrame:
    """(role, distinct, missing) of design columns."""
    counts = df.agg(*(F.count_distinct(r).alias(f"d_{r}") for r in roles), *(F.count(F.when(F.col(r).isNull(), 1)).alias(f"m_{r}") for r in roles))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.col(f"d_{r}").alias("distinct"), F.col(f"m_{r}").alias("missing")) for r in roles))).alias("x")).select("x.*")


# --- agreement ------------------------------------------------------------------------------------------------------


def kappa(po: Column, pe: Column, when_certain: float | None) -> Column:
    """(po - pe) / (1 - pe); if pe is 1: 1 for full agreement, else when_certain."""
    return F.when(pe == 1, F.when(po == 1, 1.0).otherwise(F.lit(when_certain).cast("double"))).otherwise(F.try_divide(po - pe, 1 - pe))


def binary_scores(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """Precision, recall, F1, agreement and kappa of two flags over all rows."""
    rows = df.select(truth.alias("t"), guess.alias("g"))
    n = lambda c: F.count(F.when(c, 1)).cast("double")
    s = rows.agg(n(F.col("t") & F.col("g")).alias("tp"), n(~F.col("t") & F.col("g")).alias("fp"), n(F.col("t") & ~F.col("g")).alias("fn"), F.count("*").cast("double").alias("n"))
    tn = F.col("n") - F.col("tp") - F.col("fp") - F.col("fn")
    po = F.try_divide(F.col("tp") + tn, F.col("n"))
    t, g = F.try_divide(F.col("tp") + F.col("fn"), F.col("n")), F.try_divide(F.col("tp") + F.col("fp"), F.col("n"))
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return s.select(precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * precision * recall, precision + recall).alias("f1"), (po * 100).alias("agreement"), kappa(po, t * g + (1 - t) * (1 - g), None).alias("kappa"))


def bland_altman(df: DataFrame) -> DataFrame:
    """Bias and limits of a - b, with the correlation."""
    d = F.col("a") - F.col("b")
    s = df.filter("a IS NOT NULL AND b IS NOT NULL").agg(F.count("*").alias("n"), F.avg(d).alias("bias"), F.stddev_samp(d).alias("sd"), F.corr("a", "b").alias("r"))
    return s.select("n", "bias", (F.col("bias") - 1.96 * F.col("sd")).alias("lower"), (F.col("bias") + 1.96 * F.col("sd")).alias("upper"), "r")


def icc(df: DataFrame) -> DataFrame:
    """ICC(2,1) for absolute agreement of two raters, from mean squares over subjects (n >= 3)."""
    rows = df.filter("a IS NOT NULL AND b IS NOT NULL")
    grand = rows.agg(F.count("*").alias("n"), F.avg("a").alias("ma"), F.avg("b").alias("mb")).withColumn("m", (F.col("ma") + F.col("mb")) / 2)
    rows = rows.join(F.broadcast(grand))  # one row
    s = rows.agg(
        F.first("n").alias("n"), F.sum(2 * ((F.col("a") + F.col("b")) / 2 - F.col("m")) ** 2).alias("rows"), F.first(F.col("n") * ((F.col("ma") - F.col("m")) ** 2 + (F.col("mb") - F.col("m")) ** 2)).alias("cols"),
        F.sum((F.col("a") - F.col("m")) ** 2 + (F.col("b") - F.col("m")) ** 2).alias("total"),
    )
    msr, msc = F.col("rows") / (F.col("n") - 1), F.col("cols")
    mse = (F.col("total") - F.col("rows") - F.col("cols")) / (F.col("n") - 1)
    return s.select("n", F.when(F.col("n") >= 3, F.try_divide(msr - mse, msr + mse + 2 * (msc - mse) / F.col("n"))).alias("icc"))


def kappa_sets(slices: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa over categories a and b, one row per slice."""
    n = slices.count()
    both = slices.groupBy(a, b).agg(F.count("*").alias("n"))
    left, right = both.groupBy(a).agg(F.sum("n").alias("na")), both.groupBy(b).agg(F.sum("n").alias("nb"))
    pe = left.join(right, left[a].eqNullSafe(right[b])).agg((F.sum(F.col("na") * F.col("nb")) / F.lit(float(n) * n if n else 1.0)).alias("pe"))
    po = both.agg((F.sum(F.when(F.col(a).eqNullSafe(F.col(b)), F.col("n")).otherwise(0)) / F.lit(float(n or 1))).alias("po"))
    rows = po.join(F.broadcast(pe)).withColumn("pe", F.coalesce("pe", F.lit(0.0)))  # one row each
    return rows.select("po", "pe", kappa(F.col("po"), F.col("pe"), 0.0).alias("kappa"))


def bootstrap_d(a: np.ndarray, b: np.ndarray, draws: int = 2000, seed: int = 1234) -> tuple[float, float]:
    """95 % interval of Cohen's d by resampling both groups; nan if either has fewer than two values."""
    if len(a) < 2 or len(b) < 2:
        return math.nan, math.nan
    rng = np.random.default_rng(seed)
    x = rng.choice(a, (draws, len(a)))
    y = rng.choice(b, (draws, len(b)))
    pooled = np.sqrt(((len(a) - 1) * x.var(axis=1, ddof=1) + (len(b) - 1) * y.var(axis=1, ddof=1)) / (len(a) + len(b) - 2))
    d = (x.mean(axis=1) - y.mean(axis=1)) / np.where(pooled > 0, pooled, np.nan)
    return tuple(np.nanpercentile(d, [2.5, 97.5]))


def compare_scoring(frames: DataFrame, bouts: DataFrame, fps: float, bin_s: float = 10.0) -> DataFrame:
    """One row per session: automatic flags (session, frame, time_s, auto) against hand-scored bouts (session, start, stop).

    A frame is hand-scored if its middle lies in a bout (start, stop]; bouts without a stop don't count. Also the
    correlation, bias and limits of the shares by bin of bin_s seconds from the session's first frame, for bins with at
    least two and at least half of their frames. Bouts meet frames by bin, so the join is on equal keys.
    """
    half = 0.5 / fps
    cell = lambda c: F.floor(c / bin_s).cast("long")
    named = bouts.filter("stop IS NOT NULL").select("session", "start", "stop", F.explode(F.sequence(cell(F.col("start")), cell(F.col("stop")))).alias("__cell"))
    rows = frames.withColumn("__middle", F.col("time_s") + half).withColumn("__cell", cell(F.col("__middle")))
    scored = rows.join(named, ["session", "__cell"]).filter((F.col("__middle") > F.col("start")) & (F.col("__middle") <= F.col("stop"))).select("session", "frame").distinct().withColumn("hand", F.lit(True))
    both = rows.join(scored, ["session", "frame"], "left").withColumn("hand", F.coalesce("hand", F.lit(False)))
    a, h = F.col("auto").cast("double"), F.col("hand").cast("double")
    s = both.groupBy("session").agg(F.count("*").alias("frames"), F.avg(a).alias("a"), F.avg(h).alias("h"), F.avg((F.col("auto") == F.col("hand")).cast("double")).alias("same"), F.min("time_s").alias("t0"))
    pe = F.col("a") * F.col("h") + (1 - F.col("a")) * (1 - F.col("h"))
    whole = s.select("session", "frames", (F.col("a") * 100).alias("auto_percent"), (F.col("h") * 100).alias("hand_percent"), (F.col("same") * 100).alias("agreement"), kappa(F.col("same"), pe, None).alias("kappa"))
    bins = both.join(s.select("session", "t0"), "session").groupBy("session", F.floor((F.col("time_s") - F.col("t0")) / bin_s).alias("bin")).agg(F.count("*").alias("n"), (F.avg(a) * 100).alias("a"), (F.avg(h) * 100).alias("h"))
    d = F.col("a") - F.col("h")
    # no spread, no correlation; F.corr would divide by zero there, whatever stands around it
    spread = (F.count("*") >= 3) & (F.max("a") > F.min("a")) & (F.max("h") > F.min("h"))
    r = F.try_divide(F.covar_pop("a", "h"), F.stddev_pop("a") * F.stddev_pop("h"))
    by_bin = bins.filter(F.col("n") >= max(2.0, 0.5 * bin_s * fps)).groupBy("session").agg(
        F.count("*").alias("bins"), F.when(spread, r).alias("bin_r"), F.avg(d).alias("bin_bias"),
        (F.avg(d) - 1.96 * F.stddev_samp(d)).alias("bin_lower"), (F.avg(d) + 1.96 * F.stddev_samp(d)).alias("bin_upper"),
    )
    return whole.join(by_bin, "session", "left").withColumn("bins", F.coalesce("bins", F.lit(0)))


def study_summary(compared: DataFrame) -> DataFrame:
    """One row over the sessions of compare_scoring: how far automatic and hand-scored shares agree, and the means by session."""
    pairs = compared.select(F.col("auto_percent").alias("a"), F.col("hand_percent").alias("b"))
    means = compared.agg(F.count("*").alias("sessions"), F.avg("kappa").alias("mean_kappa"), F.avg("agreement").alias("mean_agreement"))
    of_pairs = bland_altman(pairs).select("bias", "lower", "upper", "r").join(F.broadcast(icc(pairs).select("icc")))  # one row each
    return means.join(F.broadcast(of_pairs))


def plottable(long: DataFrame) -> DataFrame:
    """(metric, group, value) of metrics with values in two groups or more and four values or more, for plots by group."""
    known = long.filter("value IS NOT NULL AND group IS NOT NULL")
    kept = known.groupBy("metric").agg(F.count_distinct("group").alias("groups"), F.count("*").alias("n")).filter("groups >= 2 AND n >= 4")
    return known.join(kept.select("metric"), "metric", "left_semi").select("metric", "group", "value")
