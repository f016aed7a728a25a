"""Train and test splits of edges, with as many negative pairs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.rng import draw
from weftgraph.graph import Graph, GraphError
from weftgraph.operators.components import spanning_forest
from weftgraph.operators.sampling import numbered
from weftgraph.operators.walks import simple_ends, step_table
from weftgraph.plans.staging import dropped, stored

ROUNDS = 20
#: Rows of a top-k; more are ranked by leading digits first.
AT_ONCE = 100_000


def hash_order(seed: int, *key: str):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k) for k in key]))


def first_in_hash_order(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """The n rows least in hash order, then by key: a distributed top-k of AT_ONCE rows at most.
    For a larger n the hashes' leading digits are counted first: rows below the digits at which
    the n-th row lies are taken whole, and the top-k runs among the rows at those digits."""
    rows, taken = df.withColumn("__h", hash_order(seed, *key)), None
    at = ""
    while n > AT_ONCE and len(at) < 30:
        digits = F.substring("__h", 1, len(at) + 3)
        counts = sorted(tuple(r) for r in rows.groupBy(digits.alias("p")).count().collect())  # 4096 rows at most
        if sum(c for _, c in counts) <= n:
            return (rows if taken is None else taken.unionByName(rows)).drop("__h")
        for at, c in counts:
            if c > n:
                break
            n -= c
        below = rows.where(digits < at)
        taken, rows = below if taken is None else taken.unionByName(below), rows.where(digits == at)
    found = rows.orderBy("__h", *key).limit(n)
    return (found if taken is None else taken.unionByName(found)).drop("__h")


def positive_edges(graph: Graph, p: float, *, seed: int = 42, edge_type: str | None = None, only: DataFrame | None = None, keep_connected: bool = False) -> DataFrame:
    """int(p·n) edges, n being those that qualify: of the type, among the ids in ``only``, and,
    to keep the graph connected, outside a minimum spanning forest."""
    if not 0 < p < 1:
        raise GraphError(f"expected 0 < p < 1, found {p!r}")
    edges = graph.edges if edge_type is None else graph.edges.where(F.col("type") == edge_type)
    if only is not None:
        edges = edges.join(only.select("eid"), "eid", "left_semi")
    n = int(p * edges.count())
    free = edges.join(spanning_forest(graph).select("eid"), "eid", "left_anti") if keep_connected else edges
    found = stored(first_in_hash_order(free, n, seed, "eid"), "positives")
    if n == 0 or found.count() < n:
        raise GraphError(f"could not sample {n} edges" + (" without disconnecting the graph" if keep_connected else ""))
    return found


def adjacent_pairs(graph: Graph) -> DataFrame:
    """(a, b): distinct end pairs, the lesser id first."""
    return graph.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def fresh_pairs(candidates: DataFrame, graph: Graph, n: int, master: Graph | None, seed: int) -> DataFrame:
    """Up to n distinct candidates (src, dst) that are neither loops nor adjacent, written out."""
    pairs = candidates.where("src <> dst").select("src", "dst", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    pairs = pairs.groupBy("a", "b").agg(F.min(F.struct("src", "dst")).alias("m")).select("a", "b", "m.src", "m.dst")
    pairs = pairs.join(adjacent_pairs(graph), ["a", "b"], "left_anti")
    if master is not None:
        pairs = pairs.join(adjacent_pairs(master), ["a", "b"], "left_anti")
    pairs = pairs.select("src", "dst")
    if n > AT_ONCE:
        pairs = stored(pairs, "fresh")  # which is read three times
    got = stored(first_in_hash_order(pairs, n, seed, "src", "dst"), "negatives")
    dropped(pairs)
    return got


def global_negatives(graph: Graph, n: int, *, seed: int = 42, master: Graph | None = None, sources: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """n pairs of nodes (src, dst) that no edge joins, each end drawn evenly from all nodes, or
    from ``sources`` and ``targets``; raises if a bounded number of rounds finds fewer."""
    left = numbered(sources if sources is not None else graph.nodes.select("id"), "id")
    right = numbered(targets if targets is not None else graph.nodes.select("id"), "id")
    left, right = stored(left, "sources"), stored(right, "targets")
    nl, nr = left.count(), right.count()
    found = None
    for r in range(ROUNDS):
        tries = graph.spark.range(int(1.5 * n * (r + 1)) + 16).select(
            F.floor(draw(seed, F.lit("s"), F.lit(r), "id") * nl).cast("long").alias("ns"), F.floor(draw(seed, F.lit("t"), F.lit(r), "id") * nr).cast("long").alias("nt")
        )
        met = tries.join(left.select(F.col("id").alias("src"), F.col("n").alias("ns")), "ns").join(right.select(F.col("id").alias("dst"), F.col("n").alias("nt")), "nt").select("src", "dst")
        found = met if found is None else found.unionByName(met)
        got = fresh_pairs(found, graph, n, master, seed)
        if got.count() == n:
            return got
        dropped(got)
    raise GraphError(f"could not sample {n} negative pairs in {ROUNDS} rounds")


def local_negatives(
    graph: Graph, n: int, *, seed: int = 42, probs: Sequence[float] = (0.0, 0.25, 0.5, 0.25), master: Graph | None = None,
    sources: DataFrame | None = None, targets: DataFrame | None = None,
) -> DataFrame:
    """n pairs that no edge joins, the target at the end of a walk from the source, which visits no
    node twice and whose number of steps is drawn from probs (index + 1); ends among ``sources``
    and ``targets`` if given."""
    if abs(sum(probs) - 1) > 1e-9 or any(x < 0 for x in probs):
        raise GraphError("expected probs to be at least 0 and to add up to 1")
    onward, found, rounds = step_table(graph), None, []
    for r in range(ROUNDS):
        u = draw(seed + r, F.lit("depth"), "root", "walk")
        depth = F.lit(len(probs))
        for k in range(len(probs) - 1, -1, -1):
            depth = F.when(u < sum(probs[: k + 1]), F.lit(k + 1)).otherwise(depth)
        met = simple_ends(onward, sources if sources is not None else graph.nodes.select("id"), depth, len(probs), n=1 + r, seed=seed + r)
        met = met.select(F.col("root").alias("src"), F.col("node").alias("dst"), "degree")  # degrees, too, so that each step reads the same shuffle
        if targets is not None:
            met = met.join(targets.select(F.col("id").alias("dst")), "dst", "left_semi")
        rounds.append(stored(met, "ends"))
        met = rounds[-1].select("src", "dst")
        found = met if found is None else found.unionByName(met)
        got = fresh_pairs(found, graph, n, master, seed)
        if got.count() == n:
            dropped(onward, *rounds)
            return got
        dropped(got)
    raise GraphError(f"could not sample {n} negative pairs in {ROUNDS} rounds")


def train_test_split(
    graph: Graph, p: float = 0.5, *, method: str = "global", probs: Sequence[float] = (0.0, 0.25, 0.5, 0.25), keep_connected: bool = False,
    edge_type: str | None = None, only: DataFrame | None = None, master: Graph | None = None, seed: int = 42,
) -> tuple[Graph, DataFrame]:
    """(the graph without the positives, pairs(src, dst, label)), with as many 0 as 1."""
    if method not in ("global", "local"):
        raise GraphError(f"expected a method 'global' or 'local', found {method!r}")
    good = positive_edges(graph, p, seed=seed, edge_type=edge_type, only=only, keep_connected=keep_connected)
    n = good.count()
    pools: dict[str, DataFrame] = {}
    if edge_type is not None:
        for name, end in (("sources", "src"), ("targets", "dst")):
            kinds = good.select(F.col(end).alias("id")).join(graph.nodes.select("id", "type"), "id").select("type").distinct()
            pools[name] = graph.nodes.join(F.broadcast(kinds), "type", "left_semi").select("id")  # kinds has a row a node type
    if method == "local":
        bad = local_negatives(graph, n, seed=seed, probs=probs, master=master, **pools)
    else:
        bad = global_negatives(graph, n, seed=seed, master=master, **pools)
    pairs = good.select("src", "dst", F.lit(1).alias("label")).unionByName(bad.select("src", "dst", F.lit(0).alias("label")))
    return replace(graph, edges=graph.edges.join(good.select("eid"), "eid", "left_anti")), pairs
