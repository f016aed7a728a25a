"""Random walks, one equi-join a step for all roots and repetitions together.

A walk table is long: (root, walk, step, node), step 0 being the root.  Draws
are hashes of (seed, root, walk, step), so the same seed gives the same walks
on any partitioning.  Walks ignore direction unless ``direction`` says
otherwise, and end early where there is nowhere to go.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions.rng import draw, slot
from weftgraph.graph import Graph, GraphError
from weftgraph.operators.adjacency import half_edges, positioned
from weftgraph.plans.staging import dropped, stored

#: Steps planned together before the walkers are written out.
STEPS_PER_PLAN = 6


def check_run(n: int, length: int, seed: int) -> None:
    for name, value, least in (("n", n, 1), ("length", length, 1), ("seed", seed, 0)):
        if not isinstance(value, int) or isinstance(value, bool) or value < least:
            raise GraphError(f"expected {name} to be a whole number of at least {least}, found {value!r}")


def starts(roots: DataFrame, n: int) -> DataFrame:
    """(root, walk, node) for n walks from each distinct root."""
    ids = roots.select(F.col("id").cast("string").alias("root")).distinct()
    return ids.select("root", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("walk"), F.col("root").alias("node"))


def gathered(now: DataFrame, later: list[DataFrame]) -> DataFrame:
    out = now
    for df in later:
        out = out.unionByName(df)
    return out


def by_step(walkers: DataFrame) -> DataFrame:
    """(root, walk, step, node) of walkers with their path."""
    return walkers.select("root", "walk", F.posexplode("path").alias("step", "node"))


def resting() -> Column:
    """A node id of its own for a walker that has ended: it meets nothing, and ended walkers
    don't gather in one task."""
    return F.concat_ws("|", F.lit("\0"), "root", "walk")


def stepped(walkers: DataFrame, next_degree: str | None = None) -> DataFrame:
    """Walkers after a join that gave them ``nbr``, or null where the walk ends."""
    return walkers.select(
        "root", "walk", F.when(F.col("nbr").isNotNull(), F.concat("path", F.array("nbr"))).otherwise(F.col("path")).alias("path"),
        F.coalesce(F.col("nbr"), resting()).alias("node"), *([F.col(next_degree).alias("degree")] if next_degree else []),
    )


def as_arrays(walks: DataFrame) -> DataFrame:
    """(root, walk, nodes): each walk's nodes in order."""
    steps = F.array_sort(F.collect_list(F.struct("step", "node")))
    return walks.groupBy("root", "walk").agg(steps.alias("s")).select("root", "walk", F.col("s.node").alias("nodes"))


def step_table(graph: Graph, direction: str = "both") -> DataFrame:
    """(node, pos, nbr, degree, next_degree): positioned neighbours, written out, with the degrees of both
    ends.  Degrees are joined after the first write, which drops its shuffle files."""
    at = stored(positioned(graph, direction).select("node", "pos", "nbr", "degree"), "neighbours")
    count = at.where("pos = 0").select(F.col("node").alias("nbr"), F.col("degree").alias("next_degree"))
    out = stored(at.join(count, "nbr", "left").select("node", "pos", "nbr", "degree", "next_degree"), "positions")
    dropped(at)
    return out


def simple_ends(onward: DataFrame, roots: DataFrame, depth: Column, longest: int, *, n: int = 1, seed: int = 42) -> DataFrame:
    """(root, node, degree): where the walks of uniform_walks, over step_table(…), are after ``depth``
    steps, a column of root and walk of at most ``longest``, if they have visited no node twice."""
    check_run(n, longest, seed)
    count, onward = onward.where("pos = 0").select("node", "degree"), onward.drop("degree")
    now = starts(roots, n).withColumns({"depth": depth, "path": F.array("node")}).join(count, "node")
    for step in range(1, longest + 1):
        live = F.col("depth") >= step
        pos = F.when(live, slot(seed, F.col("degree"), "root", "walk", step)).otherwise(F.lit(-1))
        met = now.withColumns({"pos": pos, "last": F.col("node"), "node": F.when(live, F.col("node")).otherwise(resting())}).join(onward, ["node", "pos"], "left")
        met = met.where(~live | ~F.array_contains("path", F.col("nbr")))
        # a walk that has ended needs its last node only
        now = met.select(
            "root", "walk", "depth", F.when(F.col("depth") > step, F.concat("path", F.array("nbr"))).otherwise(F.array().cast("array<string>")).alias("path"),
            F.when(live, F.col("nbr")).otherwise(F.col("last")).alias("node"), F.when(live, F.col("next_degree")).otherwise(F.col("degree")).alias("degree"),
        )
        if step % STEPS_PER_PLAN == 0:
            now = stored(now, "walkers")
    return now.select("root", "node", "degree")


def uniform_walks(graph: Graph, roots: DataFrame, *, n: int = 1, length: int = 5, seed: int = 42, direction: str = "both") -> DataFrame:
    """n walks of up to ``length`` nodes from each root, next nodes drawn evenly by edge."""
    check_run(n, length, seed)
    count = half_edges(graph, direction).groupBy("node").agg(F.count(F.lit(1)).cast("int").alias("degree"))
    onward = positioned(graph, direction).select("node", "pos", "nbr").join(count.select(F.col("node").alias("nbr"), F.col("degree").alias("next_degree")), "nbr", "left")
    onward = stored(onward.select("node", "pos", "nbr", "next_degree"), "positions")
    now = starts(roots, n).join(count, "node", "left").select("root", "walk", F.array("node").alias("path"), "node", "degree")
    for step in range(1, length):
        pos = F.when(F.col("degree") > 0, slot(seed, F.col("degree"), "root", "walk", step)).otherwise(F.lit(-1))
        at = F.when(F.col("degree") > 0, F.col("node")).otherwise(resting())
        now = stepped(now.withColumns({"pos": pos, "node": at}).join(onward, ["node", "pos"], "left"), "next_degree")
        if step % STEPS_PER_PLAN == 0:
            now = stored(now, "walkers")
    return by_step(now)


def weight_cells(adj: DataFrame, by: Sequence[str] = ("node",)) -> DataFrame:
    """Neighbours of positioned(…) addressed by cell: the total weight of a node is cut into as
    many equal cells as it has neighbours, and a neighbour is listed in the cells its share of the
    running weight meets (and one to either side, for rounding): at most four times the edges.
    A draw u needs the neighbours of cell floor(u × degree) only."""
    a = adj.where("weight > 0")
    low, high = (F.col("cum") - F.col("weight")) / F.col("total") * F.col("degree"), F.col("cum") / F.col("total") * F.col("degree")
    cells = F.sequence(F.greatest(F.floor(low).cast("int") - 1, F.lit(0)), F.least(F.floor(high).cast("int") + 1, F.col("degree") - 1))
    return a.select(*by, F.explode(cells).alias("cell"), "nbr", "weight", "cum", "total")


def cell_of(u: Column, degree: Column) -> Column:
    return F.least(F.floor(u * degree).cast("int"), degree - 1)


def drawn_by_weight(u: Column) -> Column:
    """Whether a neighbour is the draw's: the weights before it fall short of the target, its own
    reaches it; a draw of 0 takes the first."""
    target = u * F.col("total")
    return (F.col("cum") >= target) & ((F.col("cum") - F.col("weight") < target) | ((u == 0) & (F.col("cum") == F.col("weight"))))


def weighted_walks(graph: Graph, roots: DataFrame, *, n: int = 1, length: int = 5, seed: int = 42, direction: str = "both") -> DataFrame:
    """Like uniform_walks, with next nodes drawn by edge weight: the first neighbour whose
    running weight reaches draw × total.  Nodes whose weights are all 0 end a walk."""
    check_run(n, length, seed)
    count = half_edges(graph, direction).groupBy("node").agg(F.count(F.lit(1)).cast("int").alias("degree"))
    onward = weight_cells(positioned(graph, direction)).join(count.select(F.col("node").alias("nbr"), F.col("degree").alias("next_degree")), "nbr", "left")
    onward = stored(onward, "cells")
    now = starts(roots, n).join(count, "node", "left").select("root", "walk", F.array("node").alias("path"), "node", "degree")
    for step in range(1, length):
        live = F.col("degree") > 0
        u = now.withColumn("u", draw(seed, "root", "walk", step))
        u = u.withColumns({"at": F.when(live, F.col("node")).otherwise(resting()), "c": F.when(live, cell_of(F.col("u"), F.col("degree"))).otherwise(F.lit(-1))}).drop("node", "degree")
        on = (F.col("at") == F.col("node")) & (F.col("c") == F.col("cell")) & drawn_by_weight(F.col("u"))
        now = stepped(u.join(onward, on, "left"), "next_degree")
        if step % STEPS_PER_PLAN == 0:
            now = stored(now, "walkers")
    return by_step(now)


def biased_walks(
    graph: Graph, roots: DataFrame, *, n: int = 1, length: int = 5, p: float = 1.0, q: float = 1.0, weighted: bool = False, seed: int = 42,
) -> DataFrame:
    """Second-order walks: a step back weighs 1/p, one to a neighbour of the previous node 1,
    any other 1/q, times the edge weight if ``weighted``.  Parallel edges add up."""
    check_run(n, length, seed)
    for name, value in (("p", p), ("q", q)):
        if not (value > 0 and math.isfinite(1 / value)):
            raise GraphError(f"expected 1/{name} to be positive and finite, found {name} = {value!r}")
    adj = stored(positioned(graph).select("node", "pos", "nbr", (F.col("weight") if weighted else F.lit(1.0)).alias("weight")), "positions")
    if weighted and not graph.edges.where("weight < 0 or isnan(weight) or weight = double('infinity')").limit(1).isEmpty():
        raise GraphError("expected weights to be at least 0 and finite")
    near = half_edges(graph).select(F.col("node").alias("prev"), F.col("nbr")).distinct().withColumn("shared", F.lit(True))
    now = starts(roots, n).withColumn("prev", F.lit(None).cast("string"))
    done = [now.select("root", "walk", F.lit(0).alias("step"), "node")]
    for step in range(1, length):
        options = now.join(adj, "node").join(near, ["prev", "nbr"], "left")
        bias = F.when(F.col("prev").isNull(), 1.0).when(F.col("nbr") == F.col("prev"), 1.0 / p).when(F.col("shared"), 1.0).otherwise(1.0 / q)
        options = options.select("root", "walk", "node", "pos", "nbr", (bias * F.col("weight")).alias("w"))
        group = W.partitionBy("root", "walk")
        running = options.select(
            "root", "walk", "node", "nbr", "w",
            F.sum("w").over(group.orderBy("pos").rowsBetween(W.unboundedPreceding, 0)).alias("cum"), F.sum("w").over(group).alias("total"),
        )
        u = draw(seed, "root", "walk", step)
        pick = (F.col("w") > 0) & (F.col("cum") >= u * F.col("total"))
        now = running.where(pick).groupBy("root", "walk").agg(F.min(F.struct("cum", "nbr", "node")).alias("m")).select("root", "walk", F.col("m.nbr").alias("node"), F.col("m.node").alias("prev"))
        now = stored(now, "walkers")  # read by the result and by the next step
        done.append(now.select("root", "walk", F.lit(step).alias("step"), "node"))
    return gathered(done[0], done[1:])


def metapath_walks(graph: Graph, roots: DataFrame, metapath: Sequence[str] | Sequence[Sequence[str]], *, n: int = 1, length: int = 5, seed: int = 42) -> DataFrame:
    """Walks whose node types follow the metapath, cyclically; its first and last types are
    equal.  Roots of another type start no walk.  For several metapaths each gives its own n
    walks, numbered on from those of the one before."""
    check_run(n, length, seed)
    paths = [metapath] if metapath and isinstance(metapath[0], str) else list(metapath)
    if not paths or any(len(p) < 2 or p[0] != p[-1] for p in paths):
        raise GraphError("expected a metapath of two types at least, the first equal to the last")
    adj = positioned(graph, by=("nbr_type",)).select("node", F.col("nbr_type").alias("kind"), "pos", "nbr", "degree")
    adj = stored(adj, "positions")
    count = adj.where("pos = 0").select("node", "kind", "degree")
    out = None
    for k, path in enumerate(paths):
        kind = graph.nodes.where(F.col("type") == path[0]).select(F.col("id").alias("root"))
        now = starts(roots, n).join(kind, "root", "left_semi").select("root", (F.col("walk") + k * n).alias("walk"), F.array("node").alias("path"), "node")
        cycle = list(path[1:])
        for step in range(1, length):
            want = cycle[(step - 1) % len(cycle)]
            # the type drawn has to be there: a node without a neighbour of it ends the walk
            here = now.join(count.where(F.col("kind") == want).select("node", "degree"), "node", "left")
            here = here.withColumn("pos", F.coalesce(slot(seed, F.col("degree"), "root", "walk", step), F.lit(-1))).drop("degree")
            here = here.withColumn("node", F.when(F.col("pos") < 0, resting()).otherwise(F.col("node")))
            now = stepped(here.join(adj.where(F.col("kind") == want).select("node", "pos", "nbr"), ["node", "pos"], "left"))
            if step % STEPS_PER_PLAN == 0:
                now = stored(now, "walkers")
        out = by_step(now) if out is None else out.unionByName(by_step(now))
    return out


def weighted_pick(options: DataFrame, keys: Sequence[str], order: Sequence[str], weight: Column, u: Column, keep: Sequence[str]) -> DataFrame:
    """One row of each group, by weight: the first in order whose running weight reaches
    u × total; groups whose weights are all 0 give none."""
    group = W.partitionBy(*keys)
    rows = options.withColumn("__w", weight).where("__w > 0")
    rows = rows.withColumn("__cum", F.sum("__w").over(group.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))).withColumn("__total", F.sum("__w").over(group))
    first = rows.where(F.col("__cum") >= u * F.col("__total"))
    return first.groupBy(*keys).agg(F.min(F.struct("__cum", *order, *keep)).alias("__m")).select(*keys, *(F.col(f"__m.{c}").alias(c) for c in keep))


def temporal_walks(
    graph: Graph, *, num_cw: int, cw_size: int, max_length: int = 80, initial_bias: str | None = None, walk_bias: str | None = None,
    success: float = 0.01, seed: int = 42, attempts: int | None = None,
) -> DataFrame:
    """(walk, step, node, time): walks along edges of rising time (the edge weight), kept in
    order of attempt until ``num_cw`` windows of ``cw_size`` nodes are covered.

    A walk starts with an edge from its source, drawn evenly or ('exponential') by recency;
    each next edge is later than the last, drawn evenly or by nearness in time.  Walks of
    fewer than cw_size nodes are dropped.  Attempts grow by rounds; a round after which the
    share of walks kept is below ``success`` raises.
    """
    if cw_size < 2 or max_length < cw_size:
        raise GraphError("expected cw_size of 2 at least and max_length no less")
    for bias in (initial_bias, walk_bias):
        if bias not in (None, "exponential"):
            raise GraphError(f"expected a bias of None or 'exponential', found {bias!r}")
    e = graph.edges.select("eid", "src", "dst", F.col("weight").alias("time"))
    half = half_edges(graph).select("node", "nbr", "eid", F.col("weight").alias("time"))
    # edges by a hash of their id, so that a draw over the running weight is a range look-up
    last = e.agg(F.max("time").alias("last"))
    weight = F.exp(F.col("time") - F.col("last")) if initial_bias else F.lit(1.0)
    ranked = stored(e.join(F.broadcast(last)).select("eid", "src", "dst", "time", weight.alias("w"), F.pmod(F.xxhash64("eid"), F.lit(1024)).alias("bin")), "edges")
    bins = ranked.groupBy("bin").agg(F.sum("w").alias("w"))
    bins = F.broadcast(bins.withColumn("hi", F.sum("w").over(W.orderBy("bin"))).withColumn("lo", F.col("hi") - F.col("w")).withColumn("all", F.sum("w").over(W.partitionBy())))  # 1024 rows
    inner = W.partitionBy("bin").orderBy("eid")
    ranked = ranked.withColumn("ihi", F.sum("w").over(inner.rowsBetween(W.unboundedPreceding, 0))).withColumn("ilo", F.col("ihi") - F.col("w"))
    size, first, kept = attempts or max(2 * num_cw, 16), 0, None
    while True:
        tries = graph.spark.range(first, first + size).select(F.col("id").alias("walk")).withColumn("u", draw(seed, "walk", 0))
        at = tries.join(bins, (F.col("u") * F.col("all") >= F.col("lo")) & (F.col("u") * F.col("all") < F.col("hi")))
        at = at.select("walk", "bin", (F.col("u") * F.col("all") - F.col("lo")).alias("v"))
        begin = at.join(ranked, "bin").where((F.col("v") >= F.col("ilo")) & (F.col("v") < F.col("ihi"))).select("walk", "src", "dst", "time")
        now = stored(begin.select("walk", F.col("dst").alias("node"), "time"), "walkers")
        steps = [begin.select("walk", F.lit(0).alias("step"), F.col("src").alias("node"), "time"), begin.select("walk", F.lit(1).alias("step"), F.col("dst").alias("node"), "time")]
        for step in range(2, max_length):
            options = now.withColumnRenamed("time", "was").join(half, "node").where("time > was")
            near = F.exp(F.col("was") - F.col("time")) if walk_bias else F.lit(1.0)
            now = stored(weighted_pick(options, ["walk"], ["eid"], near, draw(seed, "walk", step), ["nbr", "time"]).withColumnRenamed("nbr", "node"), "walkers")
            if now.isEmpty():
                break
            steps.append(now.select("walk", F.lit(step).alias("step"), "node", "time"))
        made = stored(gathered(steps[0], steps[1:]), "walks")
        long = made.groupBy("walk").agg((F.max("step") + 2 - cw_size).alias("windows")).where("windows >= 1")
        kept = stored(made.join(long, "walk") if kept is None else kept.unionByName(made.join(long, "walk")), "kept")
        first += size
        # walks number num_cw windows or little more, whatever the graph's size
        got = kept.select("walk", "windows").distinct().withColumn("before", F.sum("windows").over(W.orderBy("walk")) - F.col("windows"))
        use = stored(got.where(F.col("before") < num_cw), "enough")
        total = use.agg(F.sum("windows")).first()[0] or 0
        if total >= num_cw:
            # the last walk ends with the last window asked for
            upto = use.select("walk", (num_cw - F.col("before") + cw_size - 2).alias("upto"))
            return kept.join(upto, "walk").where("step <= upto").drop("windows", "upto")
        if kept.select("walk").distinct().count() < success * first:
            raise GraphError(f"expected temporal walks of {cw_size} nodes; fewer than {success:.2%} of {first} attempts gave one")
        size *= 2
