"""Link embeddings, knowledge-graph scores and ranks, and their losses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions import hyperbolic as H
from weftgraph.functions import vectors as V
from weftgraph.graph import GraphError
from weftgraph.plans.staging import stored

#: Test triples that meet the entities in one pass.
HEADS_AT_ONCE = 4096
#: Test triples that a worker scores at once, and entities of a batch.
HEADS_A_BLOCK, ENTITIES_A_BLOCK = 64, 1024


def link_embedding(u: Column | str, v: Column | str, method: str = "ip", activation: str = "linear") -> Column:
    """An array: the inner product ('ip', 'dot'), |u−v| ('l1'), (u−v)² ('l2'), u·v ('mul',
    'hadamard'), both joined ('concat') or their mean ('avg')."""
    u, v = V.col(u), V.col(v)
    makers: dict[str, Callable[[], Column]] = {
        "ip": lambda: F.array(V.dot(u, v)), "dot": lambda: F.array(V.dot(u, v)),
        "l1": lambda: F.zip_with(u, v, lambda a, b: F.abs(a - b)), "l2": lambda: F.zip_with(u, v, lambda a, b: (a - b) * (a - b)),
        "mul": lambda: V.times(u, v), "hadamard": lambda: V.times(u, v),
        "concat": lambda: F.concat(u, v), "avg": lambda: F.zip_with(u, v, lambda a, b: (a + b) / 2),
    }
    if method not in makers:
        raise GraphError(f"expected a link method of {sorted(makers)}, found {method!r}")
    return V.activate(makers[method](), activation)


def embedded_pairs(pairs: DataFrame, table: DataFrame, method: str) -> DataFrame:
    """pairs(src, dst, …) with their link embedding; pairs whose ends lack features fall out."""
    a = table.select(F.col("id").alias("src"), F.col("features").alias("__u"))
    b = table.select(F.col("id").alias("dst"), F.col("features").alias("__v"))
    return pairs.join(a, "src").join(b, "dst").withColumn("embedding", link_embedding("__u", "__v", method)).drop("__u", "__v")


def distmult(s: Column, r: Column, o: Column) -> Column:
    return V.array_sum(V.times(V.times(s, r), o))


def complex_score(s: Column, r: Column, o: Column) -> Column:
    """Structs of re and im: the real part of Σ s · r · conj(o)."""
    rr = V.minus(V.times(s["re"], r["re"]), V.times(s["im"], r["im"]))
    ri = V.plus(V.times(s["re"], r["im"]), V.times(s["im"], r["re"]))
    return V.dot(rr, o["re"]) + V.dot(ri, o["im"])


def rotate(s: Column, phase: Column, o: Column, margin: float = 12.0) -> Column:
    """margin − Σ |s · e^(i phase) − o|."""
    c, d = F.transform(phase, F.cos), F.transform(phase, F.sin)
    re = V.minus(V.minus(V.times(s["re"], c), V.times(s["im"], d)), o["re"])
    im = V.minus(V.plus(V.times(s["re"], d), V.times(s["im"], c)), o["im"])
    return F.lit(margin) - V.array_sum(F.zip_with(re, im, lambda a, b: F.sqrt(a * a + b * b)))


def rotated(x: Column, angle: Column) -> Column:
    """Pairs of components turned by an angle each."""
    def turned(v: Column, t: Column) -> Column:
        even = F.transform(t, lambda a, k: F.cos(a) * F.get(v, k * 2) - F.sin(a) * F.get(v, k * 2 + 1))
        odd = F.transform(t, lambda a, k: F.sin(a) * F.get(v, k * 2) + F.cos(a) * F.get(v, k * 2 + 1))
        return F.flatten(F.zip_with(even, odd, lambda a, b: F.array(a, b)))

    return V.let(x, lambda v: V.let(angle, lambda t: turned(v, t)))


def rote(s: Column, r: Column, o: Column) -> Column:
    """Euclidean: bias of both ends − |rot(s) + t − o|²; r has angle and shift, ends have x and bias."""
    gap = V.minus(V.plus(rotated(s["x"], r["angle"]), r["shift"]), o["x"])
    return s["bias"] + o["bias"] - V.square(gap)


def roth(s: Column, r: Column, o: Column, c: float = 1.0) -> Column:
    """Hyperbolic: bias of both ends − d(rot(exp s) ⊕ exp t, exp o)²."""
    left = H.mobius_add(rotated(H.exp_map(s["x"], c), r["angle"]), H.exp_map(r["shift"], c), c)
    d = H.distance(left, H.exp_map(o["x"], c), c)
    return s["bias"] + o["bias"] - F.pow(d, F.lit(2.0))


SCORES: dict[str, Callable[[Column, Column, Column], Column]] = {"distmult": distmult, "complex": complex_score, "rotate": rotate, "rote": rote, "roth": roth}


def score_triples(triples: DataFrame, entities: DataFrame, relations: DataFrame, score: str | Callable = "distmult") -> DataFrame:
    """triples(src, type, dst) with score; entities(id, e), relations(type, r)."""
    f = SCORES[score] if isinstance(score, str) else score
    rows = triples.join(entities.select(F.col("id").alias("src"), F.col("e").alias("__s")), "src").join(entities.select(F.col("id").alias("dst"), F.col("e").alias("__o")), "dst").join(relations.select("type", F.col("r").alias("__r")), "type")
    return rows.withColumn("score", f(F.col("__s"), F.col("__r"), F.col("__o"))).drop("__s", "__r", "__o")


def product_counts(heads: np.ndarray, true_score: np.ndarray, true: np.ndarray, ids: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each head the entities of a higher score, and the others of an equal one.  Products are
    added one component after another, as ``distmult`` does, so equal vectors tie."""
    columns = np.ascontiguousarray(e.T)
    more, same = np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int64)
    for a in range(0, len(heads), HEADS_A_BLOCK):
        part = slice(a, a + HEADS_A_BLOCK)
        score, product = np.zeros((len(heads[part]), len(e))), np.empty((len(heads[part]), len(e)))
        for k in range(e.shape[1]):
            np.multiply(heads[part, k, None], columns[k], out=product)
            score += product
        truth = true_score[part, None]
        more[part] = (score > truth).sum(1)
        row, other = np.nonzero(score == truth)
        np.add.at(same[part], row, ids[other] != true[part][row])
    return more, same


def rank_triples(test: DataFrame, known: DataFrame, entities: DataFrame, relations: DataFrame, score: str | Callable = "distmult", *, tie: str = "top", side: str = "dst") -> DataFrame:
    """(src, type, dst, raw_rank, filtered_rank): the rank of the true end among all entities in
    its place.  Filtered ranks leave out other known edges.  Ties: 'top' ranks before equals,
    'bottom' after, 'random' half-way between by the triple's hash.

    Test triples are a stated set, and each meets every entity."""
    if tie not in ("top", "bottom", "random"):
        raise GraphError(f"expected ties 'top', 'bottom' or 'random', found {tie!r}")
    f = SCORES[score] if isinstance(score, str) else score
    fixed = "src" if side == "dst" else "dst"
    e = entities.select("id", "e")
    truth = score_triples(test.select("src", "type", "dst").distinct(), entities, relations, f).withColumnRenamed("score", "true_score").withColumnRenamed(side, "__true")
    heads = truth.join(e.select(F.col("id").alias(fixed), F.col("e").alias("__f")), fixed).join(relations.select("type", F.col("r").alias("__r")), "type")
    heads = stored(heads, "heads")
    more, same = F.col("score") > F.col("true_score"), (F.col("score") == F.col("true_score")) & (F.col(side) != F.col("__true"))

    def counted(rows: DataFrame, first: str, second: str) -> DataFrame:
        return rows.groupBy(fixed, "type", "__true").agg(*(F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in ((first, more), (second, same))))

    size = distmult_size(heads, e) if f is distmult and side == "dst" else None
    # a stated query set against all rows, a bounded block of it at a time; counts combine before they are shuffled
    blocks = max(1, -(-heads.count() // HEADS_AT_ONCE))
    agg = None
    for k in range(blocks):
        part = heads if blocks == 1 else heads.where(F.pmod(F.xxhash64(fixed, "type", "__true"), F.lit(blocks)) == k)
        if size:
            one = counted_products(part, e, size)
            agg = one if agg is None else agg.unionByName(one)
            continue
        pairs = e.join(F.broadcast(part), F.lit(True))
        value = f(F.col("__f"), F.col("__r"), F.col("e")) if side == "dst" else f(F.col("e"), F.col("__r"), F.col("__f"))
        one = counted(pairs.select(fixed, "type", "__true", "true_score", F.col("id").alias(side), value.alias("score")), "rm", "rs")
        agg = one if agg is None else agg.unionByName(one)
    # known edges of the same heads are scored apart and taken off
    other = known.select("src", "type", "dst").distinct().join(heads.select(fixed, "type").distinct(), [fixed, "type"], "left_semi")
    met = score_triples(other, entities, relations, f).join(heads.select(fixed, "type", "__true", "true_score"), [fixed, "type"])
    agg = agg.join(counted(met, "km", "ks"), [fixed, "type", "__true"], "left")
    agg = agg.withColumns({"fm": F.col("rm") - F.coalesce("km", F.lit(0)), "fs": F.col("rs") - F.coalesce("ks", F.lit(0))})
    share = {"top": F.lit(0.0), "bottom": F.lit(1.0), "random": F.pmod(F.xxhash64(fixed, "type", "__true"), F.lit(1000)) / 1000}[tie]
    extra = 1 if tie == "random" else 0

    def rank(more_of: str, same_of: str) -> Column:
        return (1 + F.col(more_of) + F.floor(share * (F.col(same_of) + extra))).cast("long")

    out = agg.select(fixed, "type", F.col("__true").alias(side), rank("rm", "rs").alias("raw_rank"), rank("fm", "fs").alias("filtered_rank"))
    return out.select("src", "type", "dst", "raw_rank", "filtered_rank")


def distmult_size(heads: DataFrame, entities: DataFrame) -> int | None:
    """The one size of all vectors, if they are whole; otherwise, as null and missing components
    make null scores and those that aren't finite scores without an order, None."""
    sizes = []
    for df, names in ((heads, ("__f", "__r")), (entities, ("e",))):
        for c in names:
            whole = F.col(c).isNotNull() & ~F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > 1e90))
            least, most, bad = df.agg(F.min(F.size(c)), F.max(F.size(c)), F.sum(F.when(whole, 0).otherwise(1))).first()
            if bad or least != most:
                return None
            sizes.append(most)
    return sizes[0] if len(set(sizes)) == 1 else None


def counted_products(heads: DataFrame, entities: DataFrame, size: int) -> DataFrame:
    """(src, type, __true, rm, rs) of a bounded block of heads against all entities, whose scores
    are computed in numpy and don't leave the worker."""
    few = heads.select("src", "type", "__true", "true_score", "__f", "__r").toPandas()  # HEADS_AT_ONCE rows or so
    left = np.stack(few["__f"].to_numpy()) * np.stack(few["__r"].to_numpy()) if len(few) else np.zeros((0, size))
    names, truth = few[["src", "type", "__true"]], few["true_score"].to_numpy(float)
    true = few["__true"].to_numpy(object)
    sent = heads.sparkSession.sparkContext.broadcast((left, truth, true, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, truth, true, names = sent.value
        more, same = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        for batch in batches:
            for at in range(0, len(batch), ENTITIES_A_BLOCK):
                piece = batch.slice(at, ENTITIES_A_BLOCK)
                found = product_counts(left, truth, true, np.array(piece.column("id").to_pylist(), object), piece.column("e").flatten().to_numpy(zero_copy_only=False).reshape(-1, size))
                more, same = more + found[0], same + found[1]
        yield pa.RecordBatch.from_arrays([*(pa.array(names[c], pa.string()) for c in names), pa.array(more), pa.array(same)], ["src", "type", "__true", "m", "s"])

    n = heads.sparkSession.sparkContext.defaultParallelism
    counts = entities.repartition(n).mapInArrow(run, "src string, type string, __true string, m long, s long")
    return counts.groupBy("src", "type", "__true").agg(F.sum("m").alias("rm"), F.sum("s").alias("rs"))


def rank_summary(ranks: DataFrame, at: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    """Mean reciprocal rank and hits, raw and filtered."""
    cols = []
    for name in ("raw", "filtered"):
        r = F.col(f"{name}_rank")
        cols.append(F.avg(1 / r).alias(f"{name}_mrr"))
        cols += [F.avg((r <= k).cast("double")).alias(f"{name}_hits_at_{k}") for k in at]
    return ranks.agg(*cols)


def self_adversarial_weights(scores: DataFrame, *, temperature: float = 1.0) -> DataFrame:
    """Negatives' softmax weights within each positive: scores(eid, copy, label, score) with weight;
    positives weigh 1."""
    group = W.partitionBy("eid")
    bad = F.col("label") != 1
    top = F.max(F.when(bad, F.col("score") * temperature)).over(group)
    e = F.when(bad, F.exp(F.col("score") * temperature - top))
    return scores.withColumn("weight", F.when(bad, e / F.sum(e).over(group)).otherwise(1.0))


def log_sigmoid(x: Column) -> Column:
    return F.when(x >= 0, -F.log1p(F.exp(-x))).otherwise(x - F.log1p(F.exp(x)))


def graph_log_likelihood(expected: DataFrame, adj: DataFrame, scores: DataFrame) -> DataFrame:
    """One row (loss): −Σ E·log σ(s) over expected walks(i, j, v) and −Σ log(1 − σ(s)) where the
    adjacency has no entry; scores(i, j, s)."""
    rows = scores.join(expected.select("i", "j", F.col("v").alias("e")), ["i", "j"], "left").join(adj.select("i", "j", F.lit(1).alias("a")), ["i", "j"], "left")
    s = F.col("s")
    gain = F.coalesce("e", F.lit(0.0)) * log_sigmoid(s) + F.when(F.col("a").isNull(), log_sigmoid(-s)).otherwise(0.0)
    return rows.agg((-F.sum(gain)).alias("loss"))
