"""All statistics of a study in one call: design audit, subject means, repeated measures, mixed models, groups, and methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vivarium.operators import comparison, mixed, ranks, statistics
from vivarium.sources.sinks import NUMBERS, write_csv

#: Names that a column of each role may have, the first that a table has counts.
ROLES = {
    "subject": ("Animal ID", "Animal_ID", "Animal", "animal_id", "animal", "Subject", "Subject_ID", "subject_id", "subject"),
    "group": ("Group", "group"),
    "timepoint": ("Timepoint", "timepoint", "Session", "session"),
    "dam": ("Dam ID", "Dam/Cage", "Dam_Cage", "Dam", "dam", "dam_id"),
    "cage": ("Cage ID", "Cage", "cage", "cage_id"),
}
#: A study has at most so many time points; more is refused.
MOST_TIMES = 100


def roles(df: DataFrame) -> dict[str, str]:
    """Role to column, of the roles that df has a column for."""
    found = {role: next((n for n in names if n in df.columns), None) for role, names in ROLES.items()}
    return {role: name for role, name in found.items() if name}


def metric_names(df: DataFrame) -> list[str]:
    """Columns of numbers with two values or more that have no role; one pass over df."""
    taken = set(roles(df).values())
    names = [c for c, t in df.dtypes if c not in taken and (t in NUMBERS or t.startswith("decimal"))]
    if not names:
        return []
    known = df.agg(*(F.count(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None))).alias(str(i)) for i, c in enumerate(names))).first()
    return [c for i, c in enumerate(names) if known[str(i)] >= 2]


def named(df: DataFrame, metrics: list[str]) -> DataFrame:
    """df with its role columns by role, as texts, and its metrics as doubles (nan counts as null)."""
    parts = [F.col(f"`{c}`").cast("string").alias(role) for role, c in roles(df).items()]
    return df.select(*parts, *(F.nanvl(F.col(f"`{m}`").cast("double"), F.lit(None)).alias(m) for m in metrics))


def subject_levels(df: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Means of the metrics by subject, and by group, dam, cage and time point where df has them; null keys are keys of their own."""
    found = roles(df)
    if "subject" not in found:
        raise ValueError("subject means need a column of subjects")
    metrics = metric_names(df) if metrics is None else metrics
    keys = [r for r in ("subject", "group", "dam", "cage", "timepoint") if r in found]
    means = named(df, metrics).groupBy(*keys).agg(*(F.avg(f"`{m}`").alias(m) for m in metrics)) if metrics else named(df, []).select(*keys).distinct()
    return means.select(*(F.col(r).alias(found[r]) for r in keys), *(F.col(f"`{m}`") for m in metrics))


def repeated_measures(df: DataFrame, metrics: list[str]) -> DataFrame | None:
    """By metric: time points, n subjects with all of them, change and its interval, test, statistic, p and q.

    Two time points: a paired t or Wilcoxon's signed ranks; more: Friedman's test. None without subjects or with one time point.
    """
    if not {"subject", "timepoint"} <= set(roles(df)):
        return None
    means = named(subject_levels(df, metrics), metrics)
    times = sorted(r[0] for r in means.select("timepoint").dropna().distinct().limit(MOST_TIMES + 1).collect())
    if len(times) > MOST_TIMES:
        raise ValueError(f"over {MOST_TIMES} time points")
    if len(times) < 2 or not metrics:
        return None
    if len(times) == 2:
        long = means.unpivot(["subject", "timepoint"], [f"`{m}`" for m in metrics], "metric", "value").filter("value IS NOT NULL")
        found = ranks.change_over_time(long, *times)
        return found.select("metric", F.lit(times[0]).alias("from"), F.lit(times[1]).alias("to"), "n", "change", "low", "high", "test", "statistic", "p", "q")
    none = F.lit(None).cast("double")
    each = []
    for m in metrics:
        f = ranks.friedman(means.select("subject", "timepoint", F.col(f"`{m}`").alias("value")), "value", times).filter("n > 1")
        each.append(f.select(F.lit(m).alias("metric"), F.lit("all").alias("from"), F.lit("all").alias("to"), "n", none.alias("change"), none.alias("low"), none.alias("high"), F.lit("Friedman").alias("test"), F.col("chi2").alias("statistic"), "p"))
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return statistics.bh_of_metrics(out)


def mixed_models(df: DataFrame, metrics: list[str]) -> DataFrame | None:
    """`mixed.nested_effects` of each metric, with its name; None without subjects, or without groups and time points."""
    found = roles(df)
    if "subject" not in found or not {"group", "timepoint"} & set(found):
        return None
    rows = named(df, metrics)
    for role in ("group", "timepoint"):
        if role not in found:
            rows = rows.withColumn(role, F.lit("all"))
    litters = {r: r for r in ("dam", "cage") if r in found and "dam" in found}
    out = None
    for m in metrics:  # a model each
        one = mixed.nested_effects(rows.withColumn("value", F.col(f"`{m}`")), **litters).select(F.lit(m).alias("metric"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def between_groups(df: DataFrame, metrics: list[str], alpha: float = 0.05) -> DataFrame | None:
    """`comparison.compare_groups` of subject means (of rows, without subjects); None without groups."""
    found = roles(df)
    if "group" not in found or not metrics:
        return None
    rows = named(df, metrics)
    if "subject" in found:
        return comparison.compare_groups(statistics.subject_means(rows.filter("subject IS NOT NULL AND `group` IS NOT NULL"), metrics), alpha)
    return comparison.compare_groups(rows.unpivot(["group"], [f"`{m}`" for m in metrics], "metric", "value").filter("value IS NOT NULL AND `group` IS NOT NULL"), alpha)


def methods(df: DataFrame, alpha: float = 0.05) -> list[tuple[str, str]]:
    """What was done, in words: (item, text) by the roles that df has."""
    found = roles(df)
    columns = ", ".join(f"{role}: {found.get(role, 'none')}" for role in ROLES)
    unit = f"One {found['subject']}; its rows are averaged before groups are compared." if "subject" in found else "One row, as no column names subjects."
    return [
        ("Experimental unit", unit),
        ("Columns", columns),
        ("Two groups", f"Welch's t where Shapiro and Wilk's test finds both normal (p of {alpha:g} or more), else Mann and Whitney's U. Effect: Cohen's d, pooled, with a 95 % bootstrap interval."),
        ("More groups", f"One-way analysis of variance where all groups are normal (p of {alpha:g} or more), else Kruskal and Wallis's H. Effect: eta squared. Levene's test of equal spread stands beside."),
        ("Several metrics", "Benjamini and Hochberg's false discovery rate over all metrics; within a mixed model, over its terms."),
        ("Repeated measures", "Two time points: paired t, or Wilcoxon's signed ranks with fewer than three pairs. More: Friedman's test of subjects that have all."),
        ("Mixed model", "value ~ group * time point with an intercept for each subject, by maximum likelihood, and for litters where dams (and cages within them) are named and differ. Where subjects don't differ: least squares with errors clustered by subject."),
        ("Level", f"{alpha:g}, two-sided"),
    ]


def run(df: DataFrame, folder: str | None = None, metrics: list[str] | None = None, alpha: float = 0.05) -> dict[str, DataFrame]:
    """All tables that df has the columns for, by name: audit, subjects, repeated, mixed, between, methods; written as CSV below
    `folder`, if told."""
    found = roles(df)
    metrics = metric_names(df) if metrics is None else metrics
    tables = {"audit": statistics.design_audit(named(df, []), list(found)) if found else None, "subjects": subject_levels(df, metrics) if "subject" in found else None}
    tables |= {"repeated": repeated_measures(df, metrics), "mixed": mixed_models(df, metrics), "between": between_groups(df, metrics, alpha)}
    tables["methods"] = df.sparkSession.createDataFrame(methods(df, alpha), "item string, text string")
    out = {name: table for name, table in tables.items() if table is not None}
    if folder:
        for name, table in out.items():
            write_csv(table, f"{folder}/{name}")
    return out
