"""Forward passes of graph layers, given their weights.

Neighbour sums are joins and aggregates over array columns; weight matrices are
literals, as they have the size of the model, not of the data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions import vectors as V
from weftgraph.graph import Graph, GraphError
from weftgraph.operators import linalg
from weftgraph.plans.staging import stored

Matrix = Sequence[Sequence[float]]


def gcn_layer(matrix: DataFrame, features: DataFrame, weights: Matrix, bias: Sequence[float] | None = None, activation: str = "relu") -> DataFrame:
    """act(A X W + b): the narrower of X and X W is what the join carries."""
    narrow = features.select("id", V.dense("features", weights).alias("features"))
    out = linalg.propagate(matrix, narrow, len(weights[0]))
    x = F.col("features") if bias is None else V.plus("features", F.array(*(F.lit(float(b)) for b in bias)))
    return out.select("id", V.activate(x, activation).alias("features"))


def gcn(matrix: DataFrame, features: DataFrame, layers: Sequence[tuple[Matrix, Sequence[float] | None, str]]) -> DataFrame:
    out = features
    for weights, bias, activation in layers:
        out = gcn_layer(matrix, out, weights, bias, activation)
    return out


def gat_head(adj: DataFrame, features: DataFrame, weights: Matrix, own: Sequence[float], other: Sequence[float], activation: str = "elu", slope: float = 0.2) -> DataFrame:
    """One attention head: softmax over a node's entries of LeakyReLU(own·h_i + other·h_j)."""
    size = len(weights[0])
    h = features.select("id", V.dense("features", weights).alias("h"))
    left, right = (F.array(*(F.lit(float(x)) for x in v)) for v in (own, other))
    e = adj.select("i", "j").join(h.select(F.col("id").alias("i"), V.dot("h", left).alias("si")), "i").join(
        h.select(F.col("id").alias("j"), V.dot("h", right).alias("sj"), "h"), "j"
    )
    s = F.col("si") + F.col("sj")
    logit = F.when(s >= 0, s).otherwise(s * slope)
    rows = e.withColumn("l", logit).withColumn("e", F.exp(F.col("l") - F.max("l").over(W.partitionBy("i"))))
    rows = rows.select("i", "e", F.transform("h", lambda v: v * F.col("e")).alias("w"))
    out = rows.groupBy(F.col("i").alias("id")).agg(F.sum("e").alias("t"), linalg.sum_arrays("w", size).alias("f"))
    return out.select("id", V.activate(V.scaled("f", 1 / F.col("t")), activation).alias("features"))


def gat_layer(adj: DataFrame, features: DataFrame, heads: Sequence[tuple[Matrix, Sequence[float], Sequence[float]]], *, combine: str = "concat", activation: str = "elu") -> DataFrame:
    if combine not in ("concat", "average"):
        raise GraphError(f"expected 'concat' or 'average', found {combine!r}")
    out = None
    for k, (w, a, b) in enumerate(heads):
        one = gat_head(adj, features, w, a, b, activation).withColumnRenamed("features", f"h{k}")
        out = one if out is None else out.join(one, "id")
    cols = [F.col(f"h{k}") for k in range(len(heads))]
    if combine == "concat":
        return out.select("id", F.concat(*cols).alias("features"))
    total = cols[0]
    for c in cols[1:]:
        total = V.plus(total, c)
    return out.select("id", V.scaled(total, F.lit(1.0 / len(cols))).alias("features"))


def sage_layer(
    adj: DataFrame, features: DataFrame, own: Matrix, nbr: Matrix, *, aggregator: str | Callable[[Column], Column] = "mean", pool: Matrix | None = None, activation: str = "relu", normalize: bool = False,
) -> DataFrame:
    """GraphSAGE: concat(x W_own, agg(neighbours) W_nbr).  Aggregators: 'mean', and 'meanpool' and
    'maxpool' after a dense layer ``pool``, or a function from a component's column to its
    aggregate.  A node without neighbours aggregates zeros."""
    size = len(own)
    x = features.select(F.col("id").alias("j"), (V.dense("features", pool, activation="relu") if pool is not None else F.col("features")).alias("f"))
    width = len(pool[0]) if pool is not None else size
    agg = aggregator if callable(aggregator) else F.max if aggregator == "maxpool" else F.avg
    if not callable(aggregator) and aggregator not in ("mean", "meanpool", "maxpool"):
        raise GraphError(f"expected 'mean', 'meanpool' or 'maxpool', found {aggregator!r}")
    met = adj.select("i", "j").join(x, "j")
    if agg is F.avg and x.where(F.col("f").isNull() | (F.size("f") != width) | F.exists("f", lambda v: v.isNull())).isEmpty():
        # neighbours whose vectors are 0 count, but move no vectors
        sums = linalg.propagated_sums(adj.select("i", "j", F.lit(1.0).alias("v")), x.select(F.col("j").alias("id"), F.col("f").alias("features")), width)
        count = adj.select("i", "j").join(x.select("j"), "j").groupBy(F.col("i").alias("id")).agg(F.count(F.lit(1)).alias("__c"))
        near = sums.join(count, "id").select("id", F.transform("features", lambda v: v / F.col("__c")).alias("n"))
    else:
        near = met.groupBy(F.col("i").alias("id")).agg(F.array(*(agg(F.col("f")[k]) for k in range(width))).alias("n"))
    rows = features.join(near, "id", "left").withColumn("n", F.coalesce("n", V.zeros(width)))
    out = F.concat(V.dense("features", own), V.dense("n", nbr))
    found = rows.select("id", V.activate(out, activation).alias("features"))
    return found.select("id", V.unit("features").alias("features")) if normalize else found


def sage_attention_layer(adj: DataFrame, features: DataFrame, own: Matrix, nbr: Matrix, a_own: Sequence[float], a_nbr: Sequence[float], *, activation: str = "relu", slope: float = 0.2) -> DataFrame:
    """GraphSAGE with attention: concat(x W_own, Σ softmax(LeakyReLU(a·x W_own + b·n W_nbr)) n W_nbr)
    over a node's distinct neighbours; a node without any gets zeros."""
    width = len(nbr[0])
    left, right = (F.array(*(F.lit(float(x)) for x in v)) for v in (a_own, a_nbr))
    h = features.select("id", V.dense("features", own).alias("h"), V.dense("features", nbr).alias("n"))
    e = adj.select("i", "j").join(h.select(F.col("id").alias("i"), V.dot("h", left).alias("si")), "i").join(h.select(F.col("id").alias("j"), V.dot("n", right).alias("sj"), "n"), "j")
    s = F.col("si") + F.col("sj")
    rows = e.withColumn("l", F.when(s >= 0, s).otherwise(s * slope)).withColumn("e", F.exp(F.col("l") - F.max("l").over(W.partitionBy("i"))))
    near = rows.select("i", "e", F.transform("n", lambda v: v * F.col("e")).alias("w")).groupBy(F.col("i").alias("id")).agg(F.sum("e").alias("t"), linalg.sum_arrays("w", width).alias("f"))
    found = h.join(near.select("id", V.scaled("f", 1 / F.col("t")).alias("m")), "id", "left")
    return found.select("id", V.activate(F.concat("h", F.coalesce("m", V.zeros(width))), activation).alias("features"))


def directed_sage_layer(graph: Graph, features: DataFrame, own: Matrix, inward: Matrix, outward: Matrix, *, activation: str = "relu") -> DataFrame:
    """concat(x W, mean of in-neighbours W_in, mean of out-neighbours W_out)."""
    size = len(own)
    out = features
    for name, node, other in (("in", "dst", "src"), ("out", "src", "dst")):
        x = features.select(F.col("id").alias(other), F.col("features").alias("f"))
        near = graph.edges.select(node, other).join(x, other).groupBy(F.col(node).alias("id")).agg(F.array(*(F.avg(F.col("f")[k]) for k in range(size))).alias(name))
        out = out.join(near, "id", "left").withColumn(name, F.coalesce(name, V.zeros(size)))
    return out.select("id", V.activate(F.concat(V.dense("features", own), V.dense("in", inward), V.dense("out", outward)), activation).alias("features"))


def hinsage_layer(graph: Graph, features: DataFrame, own: dict[str, Matrix], nbr: dict[tuple[str, str, str], Matrix], *, activation: str = "relu") -> DataFrame:
    """For each node type concat(x W_own, mean over the type's triples of mean neighbours W_triple)."""
    half = graph.edges.select(F.col("src").alias("node"), F.col("dst").alias("nbr"), "type")
    if not graph.directed:
        half = half.unionByName(graph.edges.where("src <> dst").select(F.col("dst").alias("node"), F.col("src").alias("nbr"), "type"))
    kinds = graph.nodes.select("id", "type")
    half = half.join(kinds.select(F.col("id").alias("node"), F.col("type").alias("a")), "node").join(kinds.select(F.col("id").alias("nbr"), F.col("type").alias("b")), "nbr")
    parts = None
    for (a, r, b), w in nbr.items():
        rows = half.where((F.col("a") == a) & (F.col("type") == r) & (F.col("b") == b)).select("node", "nbr")
        x = features.select(F.col("id").alias("nbr"), F.col("features").alias("f"))
        mean = rows.join(x, "nbr").groupBy(F.col("node").alias("id")).agg(F.array(*(F.avg(F.col("f")[k]) for k in range(len(w)))).alias("f"))
        part = mean.select("id", V.dense("f", w).alias("f"))
        parts = part if parts is None else parts.unionByName(part)
    width = len(next(iter(nbr.values()))[0])
    near = parts.groupBy("id").agg(F.array(*(F.avg(F.col("f")[k]) for k in range(width))).alias("n"))
    out = None
    for kind, w in own.items():
        rows = features.join(kinds.where(F.col("type") == kind).select("id"), "id", "left_semi").join(near, "id", "left").withColumn("n", F.coalesce("n", V.zeros(width)))
        one = rows.select("id", V.activate(F.concat(V.dense("features", w), F.col("n")), activation).alias("features"))
        out = one if out is None else out.unionByName(one)
    return out


def rgcn_layer(edges: DataFrame, features: DataFrame, own: Matrix, relations: dict[str, Matrix], *, bias: Sequence[float] | None = None, activation: str = "relu") -> DataFrame:
    """act(x W_own + Σ over relations of A_r X W_r), rows of A_r divided by their sum."""
    width = len(own[0])
    adj = linalg.relational_adjacency(edges)
    terms = features.select("id", V.dense("features", own).alias("f"))
    for r, w in relations.items():
        part = linalg.propagate(adj.where(F.col("type") == r).select("i", "j", "v"), features.select("id", V.dense("features", w).alias("features")), width)
        terms = terms.unionByName(part.select("id", F.col("features").alias("f")))
    out = terms.groupBy("id").agg(linalg.sum_arrays("f", width).alias("f"))
    x = F.col("f") if bias is None else V.plus("f", F.array(*(F.lit(float(b)) for b in bias)))
    return out.select("id", V.activate(x, activation).alias("features"))


def basis_relations(bases: Sequence[Matrix], coefficients: dict[str, Sequence[float]]) -> dict[str, Matrix]:
    """Relation weights as combinations of shared bases."""
    return {
        r: [[sum(c * b[i][j] for c, b in zip(cs, bases)) for j in range(len(bases[0][0]))] for i in range(len(bases[0]))]
        for r, cs in coefficients.items()
    }


def infomax_scores(features: DataFrame, corrupted: DataFrame, weights: Matrix) -> DataFrame:
    """(id, real, logit): each row's bilinear agreement with the sigmoid of the real rows' mean."""
    size = len(weights)
    summary = features.agg(F.array(*(F.avg(F.col("features")[k]) for k in range(size))).alias("m")).select(V.activate("m", "sigmoid").alias("s"))
    both = features.select("id", "features", F.lit(True).alias("real")).unionByName(corrupted.select("id", "features", F.lit(False).alias("real")))
    return both.join(F.broadcast(summary)).select("id", "real", V.dot(V.dense("features", weights), "s").alias("logit"))


def attention_over_powers(powers: DataFrame, logits: Sequence[float]) -> DataFrame:
    """(i, j, v): powers(power, i, j, v) mixed by the softmax of the logits."""
    import math

    top = max(logits)
    e = [math.exp(x - top) for x in logits]
    share = F.element_at(F.array(*(F.lit(x / sum(e)) for x in e)), F.col("power").cast("int"))
    return powers.groupBy("i", "j").agg(F.sum(F.col("v") * share).alias("v"))


def mean_pool(features: DataFrame, graphs: DataFrame, size: int, pool: Callable[[Column], Column] = F.avg) -> DataFrame:
    """(graph_id, features): the mean row of each graph, or another aggregate of each component;
    graphs(id, graph_id)."""
    return features.join(graphs, "id").groupBy("graph_id").agg(F.array(*(pool(F.col("features")[k]) for k in range(size))).alias("features"))


def deep_graph_cnn(matrix: DataFrame, features: DataFrame, graphs: DataFrame, layers: Sequence[tuple[Matrix, Sequence[float] | None, str]], k: int) -> DataFrame:
    """(graph_id, features): the outputs of all convolutions side by side, sort-pooled to k rows;
    graphs(id, graph_id)."""
    from weftgraph.operators.batches import sort_pooling

    now, out, width = features.select("id", "features"), None, 0
    for weights, bias, activation in layers:
        now = stored(gcn_layer(matrix, now, weights, bias, activation), "layer")
        out = now if out is None else out.join(now.select("id", F.col("features").alias("more")), "id").select("id", F.concat("features", "more").alias("features"))
        width += len(weights[0])
    return sort_pooling(out.join(graphs, "id").select("graph_id", "id", "features"), k, width)


def integrated_gradients(matrix: DataFrame, features: DataFrame, target: str, weights: Matrix, klass: int, k: int, size: int) -> DataFrame:
    """(id, importance) of each node's features for one class of a linear model A^k X W at the
    target: the gradient is constant, so the integral is exact: Σ_f (A^k)_(t,i) · x_if · W_f,class."""
    row = matrix.where(F.col("i") == target).select(F.col("j").alias("i"), "v")
    for _ in range(k - 1):
        step = row.join(matrix.select("i", "j", F.col("v").alias("w")), "i").groupBy(F.col("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
        row = step.withColumnRenamed("j", "i")
    w = F.array(*(F.lit(float(r[klass])) for r in weights))
    return features.join(row.withColumnRenamed("i", "id"), "id").select("id", (F.col("v") * V.dot("features", w)).alias("importance"))
