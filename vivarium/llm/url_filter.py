"""URL filters: rules by host and path, and gradient-boosted trees over lexical features for what no rule decides.

The trees are trained on labelled URLs: those that a rule decides, with the rule's verdict as label. No feature is made from
labels, so none can repeat a rule: suffix statistics (how often a host's suffix occurs, and what its URLs look like) are
counted over all URLs.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vivarium.llm.common import stage

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: The trees are fitted on about so many labelled URLs, chosen by a hash of page_id, URL and place. Suffix statistics are
#: those of all URLs; those of so many of the most frequent suffixes are broadcast, the others joined by a shuffle.
TRAIN_ROWS, SUFFIXES = 20_000, 2000
TREES, DEPTH, SEED = 12, 4, 7
LEXICAL = ("length", "depth", "digit_ratio", "entropy", "params", "host_length", "labels", "dashes")
STATISTICS = ("suffix_seen", "suffix_length", "suffix_depth", "suffix_params")
FEATURES = LEXICAL + STATISTICS


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A to Z lower-cased; empty without ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def deciding_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as host + path, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is tried last and so outermost
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def lexical(judged: DataFrame) -> DataFrame:
    """Adds length, depth, digit ratio, entropy of the characters, parameter counts, measures of the host and its suffix (the last two labels)."""
    url = F.coalesce("url", F.lit(""))
    size = F.length(url)
    letters = F.array_sort(F.split(url, ""))
    # sorted characters: each run ends where the next character differs, so its length needs one pass
    runs = F.aggregate(
        letters,
        F.struct(F.lit("").alias("c"), F.lit(0).alias("n"), F.lit(0.0).alias("sum")),
        lambda a, x: F.when(x == a["c"], F.struct(a["c"].alias("c"), (a["n"] + 1).alias("n"), a["sum"].alias("sum"))).otherwise(
            F.struct(x.alias("c"), F.lit(1).alias("n"), (a["sum"] + _nlogn(a["n"])).alias("sum"))
        ),
        lambda a: a["sum"] + _nlogn(a["n"]),
    )
    parts = F.split("host", r"\.")
    suffix = F.concat_ws(".", F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2))
    return judged.select(
        "*",
        size.cast("double").alias("length"),
        F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double").alias("depth"),
        F.coalesce(F.try_divide(F.length(F.regexp_replace(url, r"[^0-9]", "")), size), F.lit(0.0)).cast("double").alias("digit_ratio"),
        F.coalesce(F.log2(F.nullif(size.cast("double"), F.lit(0.0))) - F.try_divide(runs, size), F.lit(0.0)).alias("entropy"),
        F.size(F.filter(F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&"), lambda x: x != "")).cast("double").alias("params"),
        F.length("host").cast("double").alias("host_length"),
        F.size(parts).cast("double").alias("labels"),
        F.length(F.regexp_replace("host", r"[^-]", "")).cast("double").alias("dashes"),
        suffix.alias("suffix"),
    )


def _nlogn(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(F.greatest(n, F.lit(1)).cast("double"))).otherwise(F.lit(0.0))


def suffix_statistics(rows: DataFrame) -> DataFrame:
    """For each suffix of rows: ln(1 + its URLs), and the mean length, depth and number of parameters of these."""
    means = (F.avg(c).alias(f"suffix_{c}") for c in ("length", "depth", "params"))
    return rows.groupBy("suffix").agg(F.log1p(F.count("*").cast("double")).alias("suffix_seen"), *means)


def with_suffix_statistics(rows: DataFrame, statistics: DataFrame) -> DataFrame:
    """Adds the statistics of its suffix to each row; zeros for a suffix without any.

    The most frequent suffixes are broadcast, and their rows dealt anywhere in the join with all others.
    """
    cut = statistics.count() > SUFFIXES
    frequent = statistics.orderBy(F.desc("suffix_seen"), "suffix").limit(SUFFIXES) if cut else statistics
    rows = rows.join(F.broadcast(frequent), "suffix", "left")
    if cut:
        rows = rows.withColumn("__salt", F.when(F.col("suffix_seen").isNull(), -1).otherwise(F.pmod(F.xxhash64("url"), F.lit(4096)).cast("int")))
        other = statistics.select("suffix", F.lit(-1).alias("__salt"), *(F.col(c).alias(f"__{c}") for c in STATISTICS))
        found = rows.join(other, ["suffix", "__salt"], "left")
        rows = found.withColumns({c: F.coalesce(c, f"__{c}") for c in STATISTICS}).drop("__salt", *(f"__{c}" for c in STATISTICS))
    return rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in STATISTICS})


def train(labelled: DataFrame, statistics: DataFrame, train_rows: int = TRAIN_ROWS):
    """(assembler, model) from rows of lexical features and verdicts, or the only verdict there is, or None without rows.

    About train_rows rows are drawn by a hash of page_id and url; rows that have both alike count as one of their number's
    weight. The sample lies in the same order however the files are cut, and so do the trees' bins.
    """
    sizes = {r["verdict"]: r["count"] for r in labelled.groupBy("verdict").count().collect()}
    if len(sizes) < 2:
        return next(iter(sizes), None)
    share = min(1.0, train_rows / sum(sizes.values()))
    place = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30))
    chosen = labelled.filter(place < int(share * (1 << 30))) if share < 1 else labelled
    others = [F.first(c).alias(c) for c in labelled.columns if c not in ("page_id", "url")]
    chosen = chosen.groupBy("page_id", "url").agg(F.count("*").cast("double").alias("weight"), *others)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    rows = with_suffix_statistics(chosen, statistics).withColumn("label", (F.col("verdict") == "block").cast("double"))
    dealt = rows.repartition(4, "page_id", "url").sortWithinPartitions("page_id", "url")
    sample = stage(dealt.select("label", "weight", *FEATURES), "labelled-urls")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label", weightCol="weight").fit(assembler.transform(sample))
    return assembler, model


def judge(pages: DataFrame, rules=RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, block_score.

    A URL that a rule fits has its verdict; any other gets that of the trees (block_score, the probability of block, is
    null where a rule decides). Null URLs and those without :// have an empty host and path and are judged by their
    features too. If the rules decide no URL, others are allowed; if they decide all labelled ones alike, others get that
    verdict. Repeated rows get equal results; very long URLs are used whole; other columns, whatever their names, are left
    out; an empty table gives no rows.
    """
    name, verdict = deciding_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    features = lexical(rows.withColumns({"rule": name, "verdict": verdict}))
    statistics = stage(suffix_statistics(features), "suffixes")
    model = train(features.filter("verdict IS NOT NULL"), statistics, train_rows)
    if model is None or isinstance(model, str):
        return features.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(model or "allow")).alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    assembler, trees = model
    scored = trees.transform(assembler.transform(with_suffix_statistics(features, statistics)))
    chance = F.when(F.col("rule").isNull(), vector_to_array("probability")[1])
    own = F.when(F.col("prediction") == 1, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), chance.alias("block_score"))
