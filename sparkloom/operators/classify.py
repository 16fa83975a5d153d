"""Online logistic regression: training by stochastic gradient steps, scoring, ensembles.

Samples have doc_id, label ('spam' is the positive class) and features, an
array whose repeated entries count as often as they stand there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sparkloom.plans.lineage import own_path

#: Words of the samples that one task trains on; weights in a row between tasks.
SEGMENT, CHUNK = 1 << 24, 1 << 14


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def _train(delta: float):
    """For mapInPandas over rows in order: rows with weights are what earlier samples have left, the others samples; yields what all have left."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w: dict = {}
        for part in parts:
            for label, features, weights in zip(part["label"], part["features"], part["weights"], strict=True):
                if features is None:
                    continue
                features = features.tolist()
                if weights is not None:
                    w.update(zip(features, weights.tolist(), strict=True))
                    continue
                score = sum(w.get(f, 0.0) for f in features)
                step = ((label == "spam") - sigmoid(score)) * delta
                for f in features:
                    w[f] = w.get(f, 0.0) + step
        names, values = list(w), list(w.values())
        for k in range(0, len(names), CHUNK):
            yield pd.DataFrame({"features": [names[k : k + CHUNK]], "weights": [values[k : k + CHUNK]]})

    return run


def train_sgd(samples: DataFrame, order_col: str, delta: float = 0.002, shuffle_seed: int | None = None) -> DataFrame:
    """feature, weight after one pass over the samples in order, or in the order of the md5 of 'key:seed'.

    Every step uses the weights that all samples before have left, so a pass is
    one sequence.  It is cut into segments of about ``SEGMENT`` words in that
    order: a task streams the rows of one segment and holds the weights alone,
    which it takes over from the task before and leaves to the next.
    """
    spark = samples.sparkSession
    kind = dict(samples.select(F.explode("features").alias("f")).dtypes)["f"]
    order = F.col(order_col) if shuffle_seed is None else F.md5(F.concat_ws(":", F.col(order_col).cast("string"), F.lit(str(shuffle_seed))))
    seen, path = Observation(), own_path(spark, "samples")
    rows = samples.select(order.alias("_o"), F.col(order_col).alias("_t"), "label", "features")
    rows.observe(seen, F.sum(F.size("features").cast("long")).alias("words")).write.parquet(f"{path}/all")
    count = max(1, -(-(seen.get["words"] or 0) // SEGMENT))
    rows = spark.read.schema(rows.schema).parquet(f"{path}/all")
    segments: list[DataFrame] = [rows]
    if count > 1:
        dealt = rows.repartitionByRange(count, "_o", "_t").withColumn("_s", F.spark_partition_id())
        dealt.write.partitionBy("_s").parquet(f"{path}/segments")
        dealt = spark.read.schema(dealt.schema).parquet(f"{path}/segments")
        segments = [dealt.where(F.col("_s") == r[0]) for r in dealt.select("_s").distinct().sort("_s").collect()]
    left = spark.createDataFrame([], f"features array<{kind}>, weights array<double>")
    for k, segment in enumerate(segments):
        new = segment.select(F.lit(1).alias("_k"), "_o", "_t", "label", "features", F.lit(None).cast("array<double>").alias("weights"))
        old = left.select(F.lit(0).alias("_k"), *[F.lit(None).cast(new.schema[c].dataType).alias(c) for c in ("_o", "_t", "label")], "features", "weights")
        one = old.union(new).repartition(1).sortWithinPartitions("_k", "_o", "_t").select("label", "features", "weights")
        one.mapInPandas(_train(delta), left.schema).write.parquet(f"{path}/weights-{k}")
        left = spark.read.schema(left.schema).parquet(f"{path}/weights-{k}")
    return left.select(F.explode(F.arrays_zip("features", "weights")).alias("w")).select(F.col("w.features").alias("feature"), F.col("w.weights").alias("weight"))


def batch_weights(samples: DataFrame, delta: float = 0.002, keys: Sequence[str] = ()) -> DataFrame:
    """keys, feature, weight of one full gradient step from zero: delta * sum(y - 1/2) over occurrences, for each value of the keys in one pass."""
    y = F.when(F.col("label") == "spam", 0.5).otherwise(-0.5)
    return samples.select(*keys, F.explode("features").alias("feature"), y.alias("y")).groupBy(*keys, "feature").agg((F.sum("y") * delta).alias("weight"))


def _scores(samples: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """doc_id, label, keys, score: weights of all occurrences added up, a missing weight being 0."""
    counts = samples.select("doc_id", "label", F.explode("features").alias("feature")).groupBy("doc_id", "label", "feature").agg(F.count("*").alias("n"))
    return counts.join(weights, "feature").groupBy("doc_id", "label", *keys).agg(F.sum(F.col("n") * F.col("weight")).alias("score"))


def _labelled(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "label", "score", F.when(F.col("score") > 0, "spam").otherwise("ham").alias("prediction"))


def apply_classifier(samples: DataFrame, weights: DataFrame) -> DataFrame:
    """doc_id, label, score, prediction: spam where the score is above 0."""
    found = _scores(samples, weights.select("feature", "weight"), [])
    all_ = samples.select("doc_id", "label").distinct().join(found, ["doc_id", "label"], "left")
    return _labelled(all_.withColumn("score", F.coalesce("score", F.lit(0.0))))


def apply_ensemble(samples: DataFrame, models: DataFrame, method: str = "average") -> DataFrame:
    """As apply_classifier, by the mean score of all models, or, for any other method, by a vote of +1 and -1 each."""
    names = models.select("model").distinct()
    found = _scores(samples, models.select("model", "feature", "weight"), ["model"])
    grid = samples.select("doc_id", "label").distinct().crossJoin(F.broadcast(names))
    each = grid.join(found, ["doc_id", "label", "model"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    if method == "average":
        score = F.avg("score")
    else:
        score = F.sum(F.when(F.col("score") > 0, 1.0).otherwise(-1.0))
    return _labelled(each.groupBy("doc_id", "label").agg(score.alias("score")))
