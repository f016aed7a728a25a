"""Learning on graphs with Spark ML and bounded driver-side models."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.vectors import dense, leaky_clipped
from weftgraph.graph import GraphError
from weftgraph.operators import linalg
from weftgraph.operators.links import embedded_pairs
from weftgraph.operators.walks import as_arrays


def walk_embeddings(walks: DataFrame, *, size: int = 64, window: int = 5, epochs: int = 1, seed: int = 42) -> DataFrame:
    """(id, features): skip-gram embeddings of the nodes of a walk table."""
    model = Word2Vec(vectorSize=size, windowSize=window, maxIter=epochs, minCount=0, seed=seed, inputCol="nodes", outputCol="v").fit(as_arrays(walks))
    return model.getVectors().select(F.col("word").alias("id"), vector_to_array("vector").alias("features"))


def link_classifier(pairs: DataFrame, table: DataFrame, method: str = "hadamard") -> tuple[LogisticRegressionModel, DataFrame]:
    """A logistic regression on link embeddings, and the rows it was fitted to."""
    rows = embedded_pairs(pairs, table, method).select("src", "dst", F.col("label").cast("double").alias("label"), array_to_vector("embedding").alias("x"))
    return LogisticRegression(featuresCol="x", labelCol="label", regParam=1e-3).fit(rows), rows


def link_regressor(pairs: DataFrame, table: DataFrame, method: str = "hadamard", *, low: float | None = None, high: float | None = None) -> tuple[LinearRegressionModel, DataFrame]:
    """A linear regression of the label on link embeddings, and its predictions, softly kept
    within [low, high] if given."""
    rows = embedded_pairs(pairs, table, method).select("src", "dst", F.col("label").cast("double").alias("label"), array_to_vector("embedding").alias("x"))
    model = LinearRegression(featuresCol="x", labelCol="label", regParam=1e-3).fit(rows)
    out = model.transform(rows)
    if low is not None and high is not None:
        out = out.withColumn("prediction", leaky_clipped(F.col("prediction"), low, high))
    return model, out.select("src", "dst", "label", "prediction")


def link_auc(model: LogisticRegressionModel, pairs: DataFrame, table: DataFrame, method: str = "hadamard") -> float:
    rows = embedded_pairs(pairs, table, method).select(F.col("label").cast("double").alias("label"), array_to_vector("embedding").alias("x"))
    return BinaryClassificationEvaluator(labelCol="label").evaluate(model.transform(rows))


def sgc_classifier(matrix: DataFrame, features: DataFrame, labels: DataFrame, size: int, *, k: int = 2) -> tuple[LogisticRegressionModel, DataFrame]:
    """Simplified graph convolution: a logistic regression on A^k X; labels(id, label)."""
    x = linalg.propagate_k(matrix, features, size, k).select("id", array_to_vector("features").alias("x"))
    rows = x.join(labels.select("id", F.col("label").cast("double").alias("label")), "id")
    return LogisticRegression(featuresCol="x", labelCol="label", regParam=1e-3).fit(rows), x


@dataclass(frozen=True)
class KgModel:
    entities: dict[str, np.ndarray]
    relations: dict[str, np.ndarray]


def fit_distmult(triples: DataFrame, *, size: int = 16, epochs: int = 20, negatives: int = 4, rate: float = 0.1, seed: int = 42, most_triples: int = 20_000_000) -> KgModel:
    """DistMult by AdaGrad on the driver, on all triples; it raises for more than
    ``most_triples``, for which embeddings need a parameter server."""
    # one more than the bound tells that it is passed
    n = triples.limit(most_triples + 1).count()
    if not n:
        raise GraphError("expected triples to learn from")
    if n > most_triples:
        raise GraphError(f"expected at most {most_triples} triples to learn from on the driver")
    rows = triples.select("src", "type", "dst").orderBy(F.md5(F.concat_ws("|", "src", "type", "dst")), "src", "type", "dst").toArrow()
    src, kind, dst = (rows.column(c).combine_chunks().dictionary_encode() for c in ("src", "type", "dst"))
    names = [c.dictionary.to_pylist() for c in (src, kind, dst)]
    ids, kinds = sorted({*names[0], *names[2]}), sorted(names[1])
    at, of = {x: k for k, x in enumerate(ids)}, {x: k for k, x in enumerate(kinds)}
    s, p, o = (np.array([where[x] for x in own])[c.indices.to_numpy()] for c, own, where in zip((src, kind, dst), names, (at, of, at)))
    rng = np.random.default_rng(seed)
    e, q = rng.normal(0, 0.3, (len(ids), size)), rng.normal(0, 0.3, (len(kinds), size))
    ge, gq = np.full_like(e, 1e-8), np.full_like(q, 1e-8)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(n), max(1, n // 1024)):
            ss, pp, oo = (np.repeat(x[part], negatives + 1) for x in (s, p, o))
            y = np.tile([1.0] + [0.0] * negatives, len(part))
            bad = y == 0
            side = rng.random(len(y)) < 0.5
            new = rng.integers(0, len(ids), len(y))
            ss, oo = np.where(bad & side, new, ss), np.where(bad & ~side, new, oo)
            a, b, c = e[ss], q[pp], e[oo]
            d = (1 / (1 + np.exp(-(a * b * c).sum(1))) - y)[:, None]
            for table, acc, index, g in ((e, ge, ss, d * b * c), (q, gq, pp, d * a * c), (e, ge, oo, d * a * b)):
                total = np.zeros_like(table)
                np.add.at(total, index, g)
                acc += total**2
                table -= rate * total / np.sqrt(acc)
    return KgModel(dict(zip(ids, e)), dict(zip(kinds, q)))


def label_propagation(half: DataFrame, nodes: DataFrame, *, rounds: int = 5) -> DataFrame:
    """(id, cluster): each round a node takes the commonest label of its neighbours (ties to the
    least), standing in for the database's community detection."""
    from weftgraph.plans.staging import stored

    label = nodes.select("id", F.col("id").alias("cluster"))
    for _ in range(rounds):
        votes = half.select("node", "nbr").join(label.select(F.col("id").alias("nbr"), "cluster"), "nbr").groupBy("node", "cluster").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "cluster")).alias("m")).select(F.col("node").alias("id"), F.col("m.cluster").alias("new"))
        label = stored(label.join(best, "id", "left").select("id", F.coalesce("new", "cluster").alias("cluster")), "labels")
    return label


def fit_attri2vec(pairs: DataFrame, features: DataFrame, *, size: int = 16, epochs: int = 5, rate: float = 0.5, seed: int = 42, most_pairs: int = 20_000_000) -> np.ndarray:
    """The matrix W of attribute embeddings sigmoid(x W): trained on the driver so that the source's
    embedding tells context targets from others; pairs(src, dst, label), features(id, features).
    More than ``most_pairs`` pairs raise."""
    if pairs.limit(most_pairs + 1).count() > most_pairs:
        raise GraphError(f"expected at most {most_pairs} pairs to learn from on the driver")
    rows = pairs.select("src", "dst", "label").orderBy(F.md5(F.concat_ws("|", "src", "dst", "label")), "src", "dst", "label").toArrow()
    src, dst = (rows.column(c).combine_chunks().dictionary_encode() for c in ("src", "dst"))
    vectors = {r.id: r.features for r in features.join(pairs.select(F.col("src").alias("id")).distinct(), "id", "left_semi").select("id", "features").toLocalIterator()}
    if not len(rows) or not vectors:
        raise GraphError("expected pairs whose sources have features")
    x = np.array([vectors[k] for k in src.dictionary.to_pylist()], float)
    s, o, y = src.indices.to_numpy(), dst.indices.to_numpy(), np.array(rows.column("label").to_pylist(), float)
    rng = np.random.default_rng(seed)
    w, out = rng.normal(0, 0.3, (x.shape[1], size)), rng.normal(0, 0.3, (len(dst.dictionary), size))
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 1024)):
            h = 1 / (1 + np.exp(-x[s[part]] @ w))
            c = out[o[part]]
            d = (1 / (1 + np.exp(-(h * c).sum(1))) - y[part])[:, None] / len(part)
            w -= rate * x[s[part]].T @ (d * c * h * (1 - h))
            np.add.at(out, o[part], -rate * d * h)
    return w


def attri2vec_embeddings(features: DataFrame, w: np.ndarray) -> DataFrame:
    """(id, features): sigmoid(x W) of each row."""
    return features.select("id", dense("features", w.tolist(), activation="sigmoid").alias("features"))
