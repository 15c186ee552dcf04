"""Behaviour classifiers: a random forest of Spark ML on frame features, tested on blocks of time or left-out sessions."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vivarium.operators.statistics import binary_scores

#: Frames within so many seconds of a tested block aren't trained on; folds; rows of each class that a fold needs.
GUARD_S, BLOCKS, LEAST = 3.0, 5, 5
#: A forest is grown on at most so many rows, half of them (20,000) of either class.
DRAWN = 40_000
#: Frames of a behaviour below which it gets no model.
FEWEST = 10


def weighted(df: DataFrame, truth: str) -> DataFrame:
    """Adds `weight`: both classes weigh the same in total."""
    n = df.agg(F.count("*").alias("n"), F.count(F.when(F.col(truth), 1)).alias("yes")).first()
    yes, no = max(n["yes"], 1), max(n["n"] - n["yes"], 1)
    return df.withColumn("weight", F.when(F.col(truth), F.lit(n["n"] / (2 * yes))).otherwise(n["n"] / (2 * no)))


def drawn(df: DataFrame, truth: str, most: int = DRAWN, seed: int = 3) -> DataFrame:
    """At most half of `most` rows of each class of df: those of the least hash of session and frame, however df is dealt.

    Hashes below a share that leaves a little more than enough are kept first, so that only about `most` rows are ranked.
    """
    half = most // 2
    n = df.groupBy(F.col(truth).alias("__class")).count().collect()  # two rows
    span = 1 << 40
    share = {bool(r["__class"]): (half + 8 * half**0.5 + 100) / r["count"] for r in n}
    below = F.when(F.col(truth), F.lit(int(min(1.0, share.get(True, 1.0)) * span))).otherwise(F.lit(int(min(1.0, share.get(False, 1.0)) * span)))
    rows = df.withColumn("__hash", F.pmod(F.xxhash64(F.lit(seed), "session", "frame"), F.lit(span))).filter(F.col("__hash") < below)
    place = F.row_number().over(Window.partitionBy(truth).orderBy("__hash", "session", "frame"))  # about `most` rows
    return rows.withColumn("__place", place).filter(F.col("__place") <= half).drop("__hash", "__place")


def train(df: DataFrame, truth: str, trees: int = 40, depth: int = 10, leaf: int = 15, seed: int = 3, most: int = DRAWN) -> RandomForestClassificationModel:
    """A forest on `features` (array<double>) for the flag `truth`, of a balanced draw of at most `most` rows by session and frame."""
    known = drawn(df.filter(F.col(truth).isNotNull()), truth, most, seed)
    rows = weighted(known, truth).select(array_to_vector("features").alias("vector"), F.col(truth).cast("double").alias("label"), "weight")
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, maxBins=33, featureSubsetStrategy="sqrt", seed=seed)
    return forest.fit(rows)


def predict(model: RandomForestClassificationModel, df: DataFrame) -> DataFrame:
    """Adds p, the probability of the behaviour."""
    out = model.setProbabilityCol("__probability").setRawPredictionCol("").setPredictionCol("").transform(df.withColumn("vector", array_to_vector("features")))
    return out.withColumn("p", vector_to_array("__probability")[1]).drop("vector", "__probability")


def dealt(df: DataFrame, folds: int) -> DataFrame:
    """(session, fold): sessions in the order of their hashes, dealt one after the other to so many folds.

    They are numbered within 64 parts of the hashes' range, and the parts' sizes are added up.
    """
    hashed = df.select("session").distinct().withColumn("h", F.xxhash64("session")).withColumn("part", F.pmod("h", F.lit(64)))
    sizes = hashed.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 64 rows
    starts = sizes.select("part", before.alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("h", "session")) - 1
    return hashed.join(F.broadcast(starts), "part").select("session", F.pmod(place, F.lit(folds)).cast("string").alias("fold"))


def with_folds(df: DataFrame, fps: float, blocks: int = BLOCKS) -> DataFrame:
    """Adds `fold` and `guards`: whole sessions in at most so many folds, or for one session blocks of frames with guards around them."""
    ends = df.agg(F.count_distinct("session").alias("sessions"), F.min("frame").alias("a"), F.max("frame").alias("z")).first()
    none = F.array().cast("array<int>")
    if ends["sessions"] != 1:
        return df.join(dealt(df, blocks), "session").withColumn("guards", none.cast("array<string>"))
    width = (ends["z"] - ends["a"] + 1) / blocks
    of = lambda c: F.least(F.greatest(F.floor((c - ends["a"]) / width), F.lit(0)), F.lit(blocks - 1)).cast("int")
    gap = round(GUARD_S * fps)
    near = F.transform(F.sequence(of(F.col("frame") - gap), of(F.col("frame") + gap)), lambda k: k.cast("string"))
    return df.withColumn("fold", of(F.col("frame")).cast("string")).withColumn("guards", near)


def cross_validate(df: DataFrame, truth: str, fps: float, trees: int = 20, level: float = 0.5, blocks: int = BLOCKS) -> DataFrame:
    """Scores over all tested folds of (session, frame, features, truth): precision, recall, f1, agreement, kappa, folds.

    There are at most `blocks` folds and forests, however many sessions. Folds that leave fewer than LEAST rows of a class for
    training are left out; without any fold all scores are null.
    """
    rows = with_folds(df, fps, blocks).persist()
    names = [str(k) for k in range(blocks)]
    rest = {k: (F.col("fold") != k) & ~F.array_contains("guards", F.lit(k)) for k in names}
    n = rows.agg(*(F.count(F.when(c & (F.col(truth) == v), 1)).alias(f"{k}{v}") for k, c in rest.items() for v in (True, False)), *(F.count(F.when(F.col("fold") == k, 1)).alias(k) for k in names)).first()
    used = [k for k in names if n[k] and n[f"{k}True"] >= LEAST and n[f"{k}False"] >= LEAST]
    tested = rows.filter(F.lit(False)).select(truth, F.lit(0.0).alias("p"))
    for k in used:  # a forest each
        tested = tested.unionByName(predict(train(rows.filter(rest[k]), truth, trees), rows.filter(F.col("fold") == k)).select(truth, "p"))
    return binary_scores(tested, F.col(truth), F.col("p") >= level).withColumn("folds", F.lit(len(used)))


def behaviour_summary(bouts: DataFrame, sessions: DataFrame, behaviours: list[str]) -> DataFrame:
    """A row for each session and behaviour: analysed_s, time_s, percent, bouts and latency_s, from (session, behaviour, start, stop)
    and (session, begin, length), all in seconds. Sessions without bouts have zeros and no latency."""
    each = sessions.withColumn("behaviour", F.explode(F.array(*(F.lit(b) for b in behaviours))))
    sums = bouts.groupBy("session", "behaviour").agg(F.sum(F.col("stop") - F.col("start")).alias("time"), F.count("*").alias("n"), F.min("start").alias("first"))
    rows = each.join(sums, ["session", "behaviour"], "left")
    time = F.coalesce("time", F.lit(0.0))
    return rows.select(
        "session", "behaviour", F.round("length", 1).alias("analysed_s"), F.round(time, 2).alias("time_s"), F.round(100 * time / F.greatest(F.col("length"), F.lit(1e-9)), 2).alias("percent"),
        F.coalesce("n", F.lit(0)).cast("long").alias("bouts"), F.round(F.col("first") - F.col("begin"), 2).alias("latency_s"),
    )


def important(model: RandomForestClassificationModel, names: list[str], n: int = 5) -> list[tuple[str, float]]:
    """The n features that matter most."""
    weights = sorted(zip(model.featureImportances.toArray().tolist(), names), key=lambda x: (-x[0], x[1]))
    return [(name, w) for w, name in weights[:n]]


@dataclass
class BehaviourModels:
    """A forest for each behaviour, the names of the features they were made with, and a report of each behaviour."""

    names: list[str]
    forests: dict[str, RandomForestClassificationModel] = field(default_factory=dict)
    report: dict[str, dict] = field(default_factory=dict)

    def predict(self, df: DataFrame, names: list[str]) -> DataFrame:
        """(session, frame, behaviour, p) of (session, frame, features); other features than those of the training are refused."""
        if list(names) != self.names:
            raise ValueError("these features are not those that the models were trained on")
        out = df.sparkSession.createDataFrame([], f"session {df.schema['session'].dataType.simpleString()}, frame long, behaviour string, p double")
        for behaviour, forest in self.forests.items():
            out = out.unionByName(predict(forest, df).select("session", F.col("frame").cast("long").alias("frame"), F.lit(behaviour).alias("behaviour"), "p"))
        return out

    def save(self, spark: SparkSession, folder: str) -> None:
        """Write the forests and one line of JSON under a folder that all machines share."""
        order = list(self.forests)
        for i, behaviour in enumerate(order):
            self.forests[behaviour].write().overwrite().save(f"{folder}/forest-{i}")
        head = json.dumps({"names": self.names, "behaviours": order, "report": self.report})
        spark.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/models")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> BehaviourModels:
        head = json.loads(spark.read.text(f"{folder}/models").first().value)
        forests = {b: RandomForestClassificationModel.load(f"{folder}/forest-{i}") for i, b in enumerate(head["behaviours"])}
        return cls(head["names"], forests, head["report"])


def train_behaviours(df: DataFrame, behaviours: list[str], names: list[str], fps: float, trees: int = 40, validate: bool = True) -> BehaviourModels:
    """Models of (session, frame, features, a flag column for each behaviour); null flags count as absent.

    A behaviour of fewer than FEWEST frames gets an error in its report and no forest. The report of the others holds the
    seconds scored by hand, the five features that matter most and, if asked for, the scores over left-out parts.
    """
    rows = df.select("session", "frame", "features", *(F.coalesce(F.col(f"`{b}`"), F.lit(False)).alias(b) for b in behaviours))
    n = rows.agg(*(F.count(F.when(F.col(f"`{b}`"), 1)).alias(str(i)) for i, b in enumerate(behaviours))).first()
    out = BehaviourModels(list(names))
    for i, b in enumerate(behaviours):
        if n[str(i)] < FEWEST:
            out.report[b] = {"error": f"fewer than {FEWEST} frames scored"}
            continue
        one = rows.select("session", "frame", "features", F.col(f"`{b}`").alias("truth"))
        found = out.report[b] = {"hand_s": round(n[str(i)] / fps, 1)}
        if validate:
            scores = cross_validate(one, "truth", fps, max(10, trees // 2)).first().asDict()
            found |= scores if scores["folds"] else {"error": "not enough scored frames to test"}
        out.forests[b] = train(one, "truth", trees, seed=7)
        found["top_features"] = [name for name, _ in important(out.forests[b], out.names)]
    return out
