"""Calibration error, calibrators and ensembles."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.rng import draw
from weftgraph.functions.vectors import array_sum


def reliability(df: DataFrame, *, prob: str = "prob", label: str = "label", bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy) over equal widths of [0, 1], the last closed."""
    bin_of = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("confidence"), F.avg(F.col(label).cast("double")).alias("accuracy"))


def expected_calibration_error(df: DataFrame, *, prob: str = "prob", label: str = "label", bins: int = 10) -> DataFrame:
    """One row (ece): Σ n/N · |accuracy − confidence|."""
    r = reliability(df, prob=prob, label=label, bins=bins)
    return r.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


def temperature(df: DataFrame, *, logits: str = "logits", label: str = "label", low: float = 0.05, high: float = 20.0, rounds: int = 30) -> float:
    """The temperature of least cross-entropy, by golden-section search; a round is one aggregate."""
    def loss(t: float) -> float:
        scaled = F.transform(F.col(logits), lambda v: v / t)
        lse = F.log(array_sum(F.transform(scaled, lambda v: F.exp(v - F.array_max(scaled))))) + F.array_max(scaled)
        return df.agg(F.avg(lse - F.get(scaled, F.col(label).cast("int")))).first()[0]

    a, b = math.log(low), math.log(high)
    g = (math.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = loss(math.exp(c)), loss(math.exp(d))
    for _ in range(rounds):
        if b - a < 1e-3:
            break
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = loss(math.exp(c))
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = loss(math.exp(d))
    return math.exp((a + b) / 2)


def platt(df: DataFrame, *, score: str = "score", label: str = "label") -> tuple[float, float]:
    """(slope, intercept) of the logistic regression of the label on the score."""
    rows = df.select(array_to_vector(F.array(F.col(score).cast("double"))).alias("x"), F.col(label).cast("double").alias("y"))
    model = LogisticRegression(featuresCol="x", labelCol="y").fit(rows)
    return float(model.coefficients[0]), float(model.intercept)


def isotonic(train: DataFrame, df: DataFrame, *, classes: int) -> DataFrame:
    """df(probs, …) with calibrated: one isotonic fit a class on train(probs, label), renormalised."""
    out, names = df, []
    for k in range(classes):
        rows = train.select(F.get("probs", F.lit(k)).alias("x"), (F.col("label") == k).cast("double").alias("y"))
        model = IsotonicRegression(featuresCol="x", labelCol="y", predictionCol=f"__c{k}").fit(rows)
        out = model.transform(out.withColumn("x", F.get("probs", F.lit(k)))).drop("x")
        names.append(f"__c{k}")
    total = array_sum(F.array(*names))
    return out.withColumn("calibrated", F.transform(F.array(*names), lambda v: F.when(total > 0, v / total).otherwise(F.lit(1.0 / classes)))).drop(*names)


def bagged(rows: DataFrame, models: int, size: int, *, seed: int = 42) -> DataFrame:
    """(model, …): ``size`` rows drawn with replacement for each model; rows(n, …) numbered from 0."""
    total = rows.count()
    drawn = rows.sparkSession.range(models * size).select((F.col("id") % models).alias("model"), F.floor(draw(seed, "id") * total).cast("long").alias("n"))
    return drawn.join(rows, "n")


def ensemble_summary(predictions: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Mean and population deviation over models and repeated predictions."""
    return predictions.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(F.lit(1)).alias("n"))
