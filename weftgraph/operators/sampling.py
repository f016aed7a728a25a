"""Sampled breadth-first neighbourhoods, negative samples and context pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions.rng import draw, slot
from weftgraph.graph import Graph, GraphError
from weftgraph.operators.adjacency import half_edges, positioned
from weftgraph.operators.walks import cell_of, drawn_by_weight, weight_cells
from weftgraph.plans.staging import BROADCAST_ROWS, dropped, if_small, stored

#: Nodes whose hashes, 8 bytes each, are broadcast at most.
HASHED_ROWS = 2_000_000


def sampled_bfs(graph: Graph, heads: DataFrame, sizes: Sequence[int], *, n: int = 1, weighted: bool = False, seed: int = 42, direction: str = "both") -> DataFrame:
    """(root, rep, hop, slot, node): sizes[d] draws with replacement from each node of hop d.

    Slots of hop d are numbered breadth first: child k of slot s is s × size + k.  Where there
    is nothing to draw, node is null, and so are all below it.
    """
    check_sizes(sizes, n)
    adj = Neighbours(positioned(graph, direction), weighted)
    ids = heads.select(F.col("id").cast("string").alias("root")).distinct()
    now = ids.select("root", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("rep"), F.lit(0).cast("long").alias("slot"), F.col("root").alias("node"))
    out = now.select("root", "rep", F.lit(0).alias("hop"), "slot", "node")
    for hop, size in enumerate(sizes, 1):
        if size == 0:
            now = now.where(F.lit(False))
            continue
        child = now.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).select(
            "root", "rep", (F.col("slot") * size + F.col("k")).alias("slot"), "node"
        )
        # read by the result and by the next hop
        now = stored(adj.drawn(child, ("root", "rep", F.lit(hop), "slot"), seed), "hop")
        out = out.unionByName(now.select("root", "rep", F.lit(hop).alias("hop"), "slot", "node"))
    return out


def check_sizes(sizes: Sequence[int], n: int) -> None:
    if not sizes or any(not isinstance(s, int) or s < 0 for s in sizes):
        raise GraphError(f"expected sizes to be whole numbers of at least 0, found {list(sizes)!r}")
    if not isinstance(n, int) or n < 1:
        raise GraphError(f"expected n to be a whole number of at least 1, found {n!r}")


class Neighbours:
    """The neighbours of positioned(…), written out once, from which draws are made."""

    def __init__(self, adj: DataFrame, weighted: bool = False, on: Sequence[str] = ("node",)):
        self.on, self.weighted = list(on), weighted
        self.adj = stored(weight_cells(adj, on) if weighted else adj.select(*on, "pos", "nbr"), "neighbours")
        self.count = stored(adj.where("pos = 0").select(*on, "degree"), "degrees")

    def drawn(self, rows: DataFrame, key: Sequence, seed: int) -> DataFrame:
        """The rows with node replaced by a drawn neighbour, or null.  Rows without a node, or whose
        node has no neighbours, are looked up under keys of their own, so they don't gather in one task."""
        keep = [c for c in rows.columns if c != "node"]
        alone = F.concat_ws("|", F.lit("\0"), *(F.col(c).cast("string") for c in keep))
        put = rows.withColumn("node", F.coalesce("node", alone)).join(self.count, self.on, "left")
        put = put.withColumn("node", F.when(F.col("degree").isNull(), alone).otherwise(F.col("node")))
        if not self.weighted:
            put = put.withColumn("pos", F.coalesce(slot(seed, F.col("degree"), *key), F.lit(-1)))
            return put.drop("degree").join(self.adj, [*self.on, "pos"], "left").select(*keep, F.col("nbr").alias("node"))
        put = put.withColumn("__u", draw(seed, *key)).withColumn("__c", F.coalesce(cell_of(F.col("__u"), F.col("degree")), F.lit(-1))).drop("degree")
        side = self.adj.select(*(F.col(c).alias(f"__{c}") for c in self.on), "cell", "nbr", "weight", "cum", "total")
        same = F.col("__c") == F.col("cell")
        for c in self.on:
            same = same & (F.col(c) == F.col(f"__{c}"))
        return put.join(side, same & drawn_by_weight(F.col("__u")), "left").select(*keep, F.col("nbr").alias("node"))


def hin_bfs(graph: Graph, heads: DataFrame, sizes: Sequence[int], *, n: int = 1, seed: int = 42) -> DataFrame:
    """(root, rep, hop, path, slot, node_type, node): for each type triple that leaves a node's
    type, sizes[d] draws from the neighbours over it; path names the triples taken, by '/'."""
    check_sizes(sizes, n)
    kinds = graph.nodes.select("id", "type")
    triples = stored(type_triples(graph), "triples")
    ids = heads.select(F.col("id").cast("string").alias("id")).join(kinds, "id").distinct()
    now = ids.select(
        F.col("id").alias("root"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("rep"), F.lit("").alias("path"),
        F.lit(0).cast("long").alias("slot"), F.col("type").alias("node_type"), F.col("id").alias("node"),
    )
    out = now.select("root", "rep", F.lit(0).alias("hop"), "path", "slot", "node_type", "node")
    group = W.partitionBy("node", "triple")
    for hop, size in enumerate(sizes, 1):
        # only edges at nodes reached so far, and of triples that leave their types, are numbered
        reached = stored(now.where("node is not null").select("node", "node_type").distinct(), "reached")
        half = typed_halves(graph, triples, reached, kinds)
        adj = Neighbours(half.select("node", "triple", (F.row_number().over(group.orderBy("eid", "nbr")) - 1).alias("pos"), "nbr", F.count(F.lit(1)).over(group).cast("int").alias("degree")), on=("node", "triple"))
        leaving = now.join(F.broadcast(triples.select("node_type", "triple", "nbr_type")), "node_type")  # one row a type triple
        child = leaving.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))) if size else leaving.withColumn("k", F.lit(0)).where(F.lit(False))
        child = child.select("root", "rep", F.concat_ws("/", F.when(F.col("path") != "", F.col("path")), "triple").alias("path"), (F.col("slot") * size + F.col("k")).alias("slot"), F.col("nbr_type").alias("node_type"), "triple", "node")
        now = stored(adj.drawn(child, ("root", "rep", F.lit(hop), "path", "slot"), seed).drop("triple"), "hop")
        dropped(reached, adj.adj, adj.count)
        out = out.unionByName(now.select("root", "rep", F.lit(hop).alias("hop"), "path", "slot", "node_type", "node"))
    return out


def type_triples(graph: Graph) -> DataFrame:
    """(node_type, kind, nbr_type, triple, way): the type triples by which edges leave a node type; edges
    shrink to their targets' distinct ones before the second join, and carry no ids."""
    kinds = graph.nodes.select("id", "type")
    far = graph.edges.select("src", "dst", F.col("type").alias("kind"), (F.col("src") == F.col("dst")).alias("loop"))
    far = far.join(kinds.select(F.col("id").alias("src"), F.col("type").alias("a")), "src").select("a", "kind", "dst", "loop").distinct()
    met = far.join(kinds.select(F.col("id").alias("dst"), F.col("type").alias("b")), "dst").select("a", "kind", "b", "loop").distinct()
    out = met.select(F.col("a").alias("node_type"), "kind", F.col("b").alias("nbr_type"), F.concat_ws("-", "a", "kind", "b").alias("triple"), F.lit("out").alias("way"))
    if not graph.directed:
        back = met.where(~F.col("loop")).select(F.col("b").alias("node_type"), "kind", F.col("a").alias("nbr_type"), F.concat_ws("-", "b", "kind", "a").alias("triple"), F.lit("back").alias("way"))
        out = out.unionByName(back)
    return out.distinct()


def typed_halves(graph: Graph, triples: DataFrame, reached: DataFrame, kinds: DataFrame) -> DataFrame:
    """(node, triple, nbr, eid): half edges of the nodes reached(node, node_type)."""
    few = triples.join(F.broadcast(reached.select("node_type").distinct()), "node_type", "left_semi")  # a row a type triple
    out = None
    # most edges at other nodes go by a hash, so that they aren't moved; the join is exact
    hashed = BROADCAST_ROWS < reached.limit(HASHED_ROWS + 1).count() <= HASHED_ROWS
    hashes = F.broadcast(reached.select(F.xxhash64("node").alias("__x")).distinct())
    for way, node, nbr in (("out", "src", "dst"), ("back", "dst", "src")):
        names = [r.kind for r in few.where(F.col("way") == way).select("kind").distinct().collect()]
        if not names:
            continue
        one = graph.edges.where(F.col("type").isin(names)).select(F.col(node).alias("node"), F.col(nbr).alias("nbr"), "eid", F.col("type").alias("kind"))
        if way == "back":
            one = one.where("node <> nbr")
        if hashed:
            one = one.withColumn("__x", F.xxhash64("node")).join(hashes, "__x", "left_semi").drop("__x")
        one = one.join(if_small(reached), "node").withColumn("way", F.lit(way))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return graph.spark.createDataFrame([], "node string, triple string, nbr string, eid string")
    out = out.join(kinds.select(F.col("id").alias("nbr"), "type"), "nbr")
    few = F.broadcast(few.select("node_type", "kind", F.col("nbr_type").alias("type"), "way"))
    out = out.join(few, ["node_type", "kind", "type", "way"], "left_semi")
    return out.select("node", F.concat_ws("-", "node_type", "kind", "type").alias("triple"), "nbr", "eid")


def directed_bfs(graph: Graph, heads: DataFrame, in_sizes: Sequence[int], out_sizes: Sequence[int], *, n: int = 1, weighted: bool = False, seed: int = 42) -> DataFrame:
    """(root, rep, hop, part, slot, node): a binary tree of parts, 2i+1 for in-neighbours of part
    i and 2i+2 for out-neighbours, each with the hop's draws."""
    if not graph.directed:
        raise GraphError("expected a directed graph")
    if len(in_sizes) != len(out_sizes):
        raise GraphError("expected as many in sizes as out sizes")
    check_sizes([*in_sizes, *out_sizes], n)
    adj = {"in": Neighbours(positioned(graph, "in"), weighted), "out": Neighbours(positioned(graph, "out"), weighted)}
    ids = heads.select(F.col("id").cast("string").alias("root")).distinct()
    now = ids.select("root", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("rep"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("slot"), F.col("root").alias("node"))
    out = now.select("root", "rep", F.lit(0).alias("hop"), "part", "slot", "node")
    for hop, both in enumerate(zip(in_sizes, out_sizes), 1):
        sides = []
        for side, size, way in ((1, both[0], "in"), (2, both[1], "out")):
            if size:
                child = now.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).select(
                    "root", "rep", (F.col("part") * 2 + side).alias("part"), (F.col("slot") * size + F.col("k")).alias("slot"), "node"
                )
                sides.append(adj[way].drawn(child, ("root", "rep", "part", "slot"), seed))
        if not sides:
            break
        now = stored(sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1]), "hop")
        out = out.unionByName(now.select("root", "rep", F.lit(hop).alias("hop"), "part", "slot", "node"))
    return out


def context_pairs(walks: DataFrame) -> DataFrame:
    """(src, dst): each walk's root with every later node of it."""
    return walks.where("step > 0").select("root", "walk", "step", F.col("root").alias("src"), F.col("node").alias("dst"))


def node_bins(graph: Graph, power: float, bins: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Nodes with weight degree^power in hashed bins: (bins with running weight, nodes with
    running weight inside their bin).  A draw then needs two range look-ups, the first
    against a table of fixed size."""
    count = half_edges(graph).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    bin_of = F.conv(F.substring(F.md5("node"), 1, 3), 16, 10).cast("int") % bins
    w = count.select("node", F.round(F.pow(F.col("degree").cast("double"), F.lit(power)), 6).cast("decimal(18,6)").alias("w"), bin_of.alias("bin"))
    inside = W.partitionBy("bin").orderBy("node")
    nodes = w.select("bin", "node", (F.sum("w").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("w")).cast("decimal(24,6)").alias("lo"), F.sum("w").over(inside.rowsBetween(W.unboundedPreceding, 0)).cast("decimal(24,6)").alias("hi"))
    total = w.groupBy("bin").agg(F.sum("w").cast("decimal(24,6)").alias("w"))
    run = F.sum("w").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)).cast("decimal(24,6)")
    table = total.select("bin", (run - F.col("w")).cast("decimal(24,6)").alias("blo"), run.alias("bhi"), F.sum("w").over(W.partitionBy()).cast("decimal(24,6)").alias("all"))
    return F.broadcast(table), nodes


def cells_between(low, high, count):
    """The cells, of ``count`` of width 1 / count of the whole, that a stretch of shares [low, high)
    meets, and one to either side, for rounding."""
    return F.sequence(F.greatest(F.floor(low * count).cast("long") - 1, F.lit(0)), F.least(F.floor(high * count).cast("long") + 1, count - 1))


def draw_by_degree(graph: Graph, rows: DataFrame, u, power: float = 0.75) -> DataFrame:
    """The rows with a node ``drawn`` from the distribution ∝ degree^power, by the draw u: a
    look-up by cell among the bins, and one by cell among the nodes of the bin."""
    bins, nodes = node_bins(graph, power)
    nodes = stored(nodes, "weighted-nodes")
    number = F.lit(4096).cast("long")
    share = lambda c: F.col(c).cast("double") / F.col("all").cast("double")
    sizes = nodes.groupBy("bin").agg(F.count(F.lit(1)).alias("nodes"), F.max(F.col("hi")).cast("double").alias("sum"))
    table = bins.select("*", F.explode(cells_between(share("blo"), share("bhi"), number)).alias("cell")).join(sizes, "bin")
    table = F.broadcast(stored(table, "bin-cells"))  # each of 4096 bins in four cells or so
    at = rows.withColumn("__u", u).withColumn("cell", F.least(F.floor(F.col("__u") * number).cast("long"), number - 1)).join(table, "cell")
    point = F.col("__u") * F.col("all").cast("double")
    at = at.where((point >= F.col("blo").cast("double")) & (point < F.col("bhi").cast("double"))).withColumn("__v", point - F.col("blo").cast("double"))
    at = at.withColumn("cell", F.least(F.greatest(F.floor(F.col("__v") / F.col("sum") * F.col("nodes")).cast("long"), F.lit(0)), F.col("nodes") - 1)).drop("__u", "all", "blo", "bhi", "sum", "nodes")
    inner = nodes.join(F.broadcast(stored(sizes, "bins")), "bin")  # a row a bin
    inner = inner.select("bin", "node", "lo", "hi", F.explode(cells_between(F.col("lo").cast("double") / F.col("sum"), F.col("hi").cast("double") / F.col("sum"), F.col("nodes"))).alias("cell"))
    found = at.join(inner, ["bin", "cell"]).where((F.col("__v") >= F.col("lo").cast("double")) & (F.col("__v") < F.col("hi").cast("double")))
    return found.withColumnRenamed("node", "drawn").drop("bin", "cell", "__v", "lo", "hi")


def unsupervised_samples(graph: Graph, walks: DataFrame, *, seed: int = 42, power: float = 0.75) -> DataFrame:
    """(src, dst, label): context pairs as 1, and as many pairs of the same roots with nodes
    drawn by degree^power as 0; negatives aren't checked against edges."""
    pairs = stored(context_pairs(walks), "pairs")
    drawn = draw_by_degree(graph, pairs.select("root", "walk", "step", "src"), draw(seed, F.lit("negative"), "root", "walk", "step"), power)
    return pairs.select("src", "dst", F.lit(1).alias("label")).unionByName(drawn.select("src", F.col("drawn").alias("dst"), F.lit(0).alias("label")))


def kg_negatives(edges: DataFrame, entities: DataFrame, k: int, *, seed: int = 42, labels: str = "uniform") -> DataFrame:
    """(eid, copy, src, type, dst, label): each triple and k corruptions of it, with one end
    replaced by a uniform entity; 'self-adversarial' labels negatives -copy.

    entities(id, n): ids numbered from 0; (see ``numbered``)."""
    if labels not in ("uniform", "self-adversarial"):
        raise GraphError(f"expected labels 'uniform' or 'self-adversarial', found {labels!r}")
    entities, base = stored(entities, "entities"), stored(edges.select("eid", "src", "type", "dst"), "triples")
    total = entities.count()
    copies = base.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(k))))
    copies = copies.withColumn("n", F.floor(draw(seed, F.lit("entity"), "eid", "copy") * total).cast("long")).withColumn("head", draw(seed, F.lit("side"), "eid", "copy") < 0.5)
    bad = copies.join(if_small(entities.select(F.col("id").alias("new"), "n")), "n").select(
        "eid", "copy", F.when(F.col("head"), F.col("new")).otherwise(F.col("src")).alias("src"), "type", F.when(F.col("head"), F.col("dst")).otherwise(F.col("new")).alias("dst"),
        (F.lit(0) if labels == "uniform" else -F.col("copy")).cast("int").alias("label"),
    )
    return base.select("eid", F.lit(0).alias("copy"), "src", "type", "dst", F.lit(1).alias("label")).unionByName(bad)


def numbered(df: DataFrame, key: str, bins: int = 1024) -> DataFrame:
    """The rows with n, dense from 0 in an order of hashed bins: counted by bin first, so no
    single task sorts all rows."""
    bin_of = F.conv(F.substring(F.md5(F.col(key)), 1, 3), 16, 10).cast("int") % bins
    rows = df.withColumn("__bin", bin_of)
    count = rows.groupBy("__bin").agg(F.count(F.lit(1)).alias("__c"))
    offset = F.broadcast(count.select("__bin", (F.sum("__c").over(W.orderBy("__bin")) - F.col("__c")).alias("__o")))
    return rows.withColumn("__r", F.row_number().over(W.partitionBy("__bin").orderBy(key)) - 1).join(offset, "__bin").withColumn("n", F.col("__o") + F.col("__r")).drop("__bin", "__r", "__o")


def ordered(df: DataFrame, key: str) -> DataFrame:
    """The rows with n, dense from 0 in the order of ``key``: range partitions are written
    out, counted, and numbered within themselves."""
    parts = stored(df.repartitionByRange(key).withColumn("__part", F.spark_partition_id()), "ranges")
    count = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__c"))
    offset = F.broadcast(count.select("__part", (F.sum("__c").over(W.orderBy("__part")) - F.col("__c")).alias("__o")))  # a row a partition
    run = parts.withColumn("__r", F.row_number().over(W.partitionBy("__part").orderBy(key)) - 1).join(offset, "__part")
    return run.withColumn("n", F.col("__o") + F.col("__r")).drop("__part", "__r", "__o")


def batches(ids: DataFrame, size: int, *, key: str = "id", shuffle_seed: int | None = None) -> DataFrame:
    """(…, n, batch): rows in batches of ``size`` by key; with a seed in hash order (a new seed an epoch)."""
    if size < 1:
        raise GraphError(f"expected a batch size of 1 at least, found {size}")
    if shuffle_seed is None:
        return ordered(ids, key).withColumn("batch", F.floor(F.col("n") / size).cast("long"))
    # md5 text begins with its bin, so bins are in hash order themselves
    rows = ids.withColumn("__k", F.md5(F.concat_ws("|", F.lit(str(shuffle_seed)), F.col(key))))
    rows = rows.withColumn("__bin", F.substring("__k", 1, 3))
    count = rows.groupBy("__bin").agg(F.count(F.lit(1)).alias("__c"))
    offset = F.broadcast(count.select("__bin", (F.sum("__c").over(W.orderBy("__bin")) - F.col("__c")).alias("__o")))  # 4096 rows
    run = rows.withColumn("__r", F.row_number().over(W.partitionBy("__bin").orderBy("__k", key)) - 1).join(offset, "__bin")
    return run.withColumn("n", F.col("__o") + F.col("__r")).withColumn("batch", F.floor(F.col("n") / size).cast("long")).drop("__bin", "__r", "__o", "__k")
