"""Group comparison: the test of each metric is chosen by the normality of its groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vivarium.operators import ranks, resampling, statistics


def compare_groups(long: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row per metric of (metric, group, value): test, statistic, p, q over the metrics, effect, its interval (effect_low,
    effect_high) and levene_p.

    Groups with fewer than two values don't take part. Two groups: Welch's t (or Mann-Whitney's U if a group isn't
    normal) and Cohen's d with its 95 % bootstrap interval, the group whose name sorts first minus the other. More: ANOVA's F (or Kruskal-Wallis's H) and
    eta squared. A metric with fewer than two groups has the test 'insufficient data' and nulls.
    """
    values = long.filter("value IS NOT NULL")
    sizes = values.groupBy("metric", "group").agg(F.count("*").alias("n")).filter("n > 1")
    used = values.join(sizes.select("metric", "group"), ["metric", "group"], "left_semi")
    plan = ranks.normality(used, alpha).groupBy("metric").agg(F.count("*").alias("k"), F.bool_and("normal").alias("normal"), F.min("group").alias("a"))
    pair = used.join(plan.filter("k = 2").select("metric", "a"), "metric").withColumn("group", F.when(F.col("group") == F.col("a"), "a").otherwise("b"))
    many = used.join(plan.filter("k > 2").select("metric"), "metric", "left_semi")
    welch, anova, h = statistics.welch(pair, "a", "b"), statistics.anova(many), ranks.kruskal(many)
    as_result = lambda df, test, statistic: df.select("metric", F.lit(test).alias("test"), F.col(statistic).alias("statistic"), "p")
    tests = as_result(welch, "Welch t-test", "t").unionByName(as_result(ranks.mann_whitney(pair, "a", "b"), "Mann-Whitney U", "u"))
    tests = tests.unionByName(as_result(anova, "One-way ANOVA", "f")).unionByName(as_result(h.withColumn("p", ranks.chi2_p(F.col("h"), F.col("df"))), "Kruskal-Wallis", "h"))
    effects = welch.select("metric", F.col("cohen_d").alias("effect")).unionByName(anova.select("metric", F.col("eta2").alias("effect")))
    reach = resampling.d_interval(used).select("metric", F.col("low").alias("effect_low"), F.col("high").alias("effect_high"))
    spread = statistics.anova(ranks.levene(used)).select("metric", F.col("p").alias("levene_p"))
    name = F.when(F.col("k") == 2, F.when(F.col("normal"), "Welch t-test").otherwise("Mann-Whitney U")).when(F.col("k") > 2, F.when(F.col("normal"), "One-way ANOVA").otherwise("Kruskal-Wallis"))
    chosen = plan.withColumn("test", F.coalesce(name, F.lit("insufficient data"))).select("metric", "k", "normal", "test")
    every = values.select("metric").distinct().join(chosen, "metric", "left").withColumn("test", F.coalesce("test", F.lit("insufficient data")))
    found = every.join(tests, ["metric", "test"], "left").join(effects, "metric", "left").join(reach, "metric", "left").join(spread, "metric", "left")
    out = statistics.bh_of_metrics(found)  # a row for each metric
    return out.select("metric", F.coalesce("k", F.lit(0)).alias("groups"), "normal", "test", "statistic", "p", "q", "effect", "effect_low", "effect_high", "levene_p", (F.col("q") < alpha).alias("significant"))
