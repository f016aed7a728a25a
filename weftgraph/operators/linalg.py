"""Sparse graph algebra on (i, j, v) frames.

Products are joins on the inner index with sums that combine before the
shuffle; a dense feature matrix is (i, features) with array rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.graph import Graph, GraphError
from weftgraph.operators.adjacency import adjacency_matrix
from weftgraph.plans.staging import BROADCAST_ROWS, dropped, if_small, stored

#: Entries of a list that a product moves, and products that a task adds up.
LIST_ENTRIES, TASK_PRODUCTS = 512, 2_000_000
#: Numbers of the vectors that are broadcast at most.
SMALL_VECTORS = 1_000_000
#: Numbers of the starting vectors by whose coefficients rounds are kept, and hashes of ids that are broadcast, at most.
START_NUMBERS, ID_HASHES = 4_000_000, 1_000_000


def with_self_loops(adj: DataFrame, nodes: DataFrame) -> DataFrame:
    """The diagonal set to 1, whatever it was."""
    return adj.where("i <> j").select("i", "j", "v").unionByName(nodes.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v")))


def symmetrised(adj: DataFrame) -> DataFrame:
    """Elementwise maximum of the matrix and its transpose."""
    both = adj.select("i", "j", "v").unionByName(adj.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    return both.groupBy("i", "j").agg(F.max("v").alias("v"))


def row_sums(adj: DataFrame) -> DataFrame:
    return adj.groupBy("i").agg(F.sum("v").alias("d"))


def normalized(adj: DataFrame, *, symmetric: bool = True) -> DataFrame:
    """D^-½ A D^-½, or D⁻¹ A; rows that sum to 0 have no entries."""
    d = row_sums(adj).where("d > 0")
    left = adj.join(d, "i")
    if not symmetric:
        return left.select("i", "j", (F.col("v") / F.col("d")).alias("v"))
    return left.join(d.select(F.col("i").alias("j"), F.col("d").alias("dj")), "j").select("i", "j", (F.col("v") / F.sqrt(F.col("d") * F.col("dj"))).alias("v"))


def gcn_matrix(adj: DataFrame, nodes: DataFrame) -> DataFrame:
    """The graph-convolution operator: symmetrised, diagonal 1, normalised symmetrically."""
    return normalized(with_self_loops(symmetrised(adj), nodes))


def laplacian(adj: DataFrame, nodes: DataFrame) -> DataFrame:
    """I − D^-½ A D^-½."""
    one = nodes.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))
    minus = normalized(adj).select("i", "j", (-F.col("v")).alias("v"))
    return one.unionByName(minus).groupBy("i", "j").agg(F.sum("v").alias("v"))


def plain_laplacian(adj: DataFrame) -> DataFrame:
    """D − A."""
    d = row_sums(adj).select("i", F.col("i").alias("j"), F.col("d").alias("v"))
    return d.unionByName(adj.select("i", "j", (-F.col("v")).alias("v"))).groupBy("i", "j").agg(F.sum("v").alias("v"))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """A · B.  What moves to a row's task are its entries with the lists of B they meet, of
    LIST_ENTRIES at most; products are made and added up there."""
    spark = a.sparkSession
    met = a.groupBy(F.col("j").alias("k")).count().join(b.groupBy(F.col("i").alias("k")).agg(F.count(F.lit(1)).alias("n")), "k")
    products = met.agg(F.coalesce(F.sum(F.col("count") * F.col("n")), F.lit(0)).alias("n")).first().n
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), products // TASK_PRODUCTS + 1)
    block = F.floor((F.row_number().over(W.partitionBy("i").orderBy("j")) - 1) / LIST_ENTRIES)
    lists = b.select("i", "j", "v", block.alias("block")).groupBy("i", "block").agg(F.collect_list(F.struct("j", F.col("v").alias("w"))).alias("l"))
    lists = lists.select(F.col("i").alias("k"), F.col("l.j").alias("js"), F.col("l.w").alias("ws"))
    moved = a.join(lists, a["j"] == lists["k"]).select("i", "v", "js", "ws").repartition(tasks, "i")
    each = moved.select("i", "v", F.explode(F.arrays_zip("js", "ws")).alias("e")).select("i", F.col("e.js").alias("j"), (F.col("v") * F.col("e.ws")).alias("v"))
    return each.groupBy("i", "j").agg(F.sum("v").alias("v"))


def power(a: DataFrame, k: int) -> DataFrame:
    if k < 1:
        raise GraphError(f"expected a power of 1 at least, found {k}")
    out = a.select("i", "j", "v")
    for _ in range(k - 1):
        out = stored(multiply(out, a), "power")
    return out


def adjacency_powers(adj: DataFrame, k: int) -> DataFrame:
    """(power, i, j, v): the transition matrix D⁻¹ A to the powers 1 to k."""
    t = stored(normalized(adj, symmetric=False), "transition")
    now, out = t, t.withColumn("power", F.lit(1))
    for n in range(2, k + 1):
        now = multiply(now, t)
        if n < k:
            now = stored(now, "power")  # which the next one reads too
        out = out.unionByName(now.withColumn("power", F.lit(n)))
    return out.select("power", "i", "j", "v")


def sum_arrays(x: Column | str, size: int) -> Column:
    """Elementwise sum of an array column over a group: one sum an element, combined
    before the shuffle.  For sizes of a few hundred at most."""
    c = F.col(x) if isinstance(x, str) else x
    return F.array(*(F.sum(c[k]) for k in range(size)))


def nonzero(features: DataFrame) -> DataFrame:
    """The rows that have a component other than 0."""
    return features.where(F.exists("features", lambda v: v.isNull() | (v != 0)))


def propagated_sums(adj: DataFrame, features: DataFrame, size: int) -> DataFrame:
    """(id, features): A · X in the rows that meet a row of X other than 0; A is finite."""
    x = if_small(nonzero(features).select(F.col("id").alias("j"), "features"), SMALL_VECTORS // max(size, 1))
    out = adj.join(x, "j").select("i", F.transform("features", lambda f: f * F.col("v")).alias("f"))
    return out.groupBy(F.col("i").alias("id")).agg(sum_arrays("f", size).alias("features"))


def propagate(adj: DataFrame, features: DataFrame, size: int) -> DataFrame:
    """A · X: (id, features), for the rows of A that have entries.  Rows of X that are 0
    move no vectors."""
    rows = adj.join(features.select(F.col("id").alias("j")), "j", "left_semi").select(F.col("i").alias("id")).distinct()
    found = rows.join(propagated_sums(adj, features, size), "id", "left")
    return found.select("id", F.coalesce("features", F.array_repeat(F.lit(0.0), size)).alias("features"))


def propagate_k(adj: DataFrame, features: DataFrame, size: int, k: int) -> DataFrame:
    """A^k · X without the power of the matrix (simplified graph convolution)."""
    adj = stored(adj.select("i", "j", "v"), "matrix")
    out = features.select("id", "features")
    for _ in range(k):
        last, out = out, stored(propagate(adj, out, size), "propagated")
        dropped(last)
    dropped(adj)
    return out


def appnp(adj: DataFrame, features: DataFrame, size: int, *, k: int = 10, alpha: float = 0.1) -> DataFrame:
    """Personalised propagation: k rounds of (1 − α) A H + α X."""
    if not 0 <= alpha <= 1:
        raise GraphError(f"expected 0 <= alpha <= 1, found {alpha!r}")
    adj = stored(adj.select("i", "j", "v"), "matrix")
    x = features.select("id", F.col("features").alias("x0"))
    now = features.select("id", "features")
    for _ in range(k):
        far = propagated_sums(adj, now, size).withColumnRenamed("features", "f")
        mixed = F.when(F.col("f").isNull(), F.transform("x0", lambda v: v * alpha)).otherwise(F.zip_with("f", "x0", lambda a, b: a * (1 - alpha) + b * alpha))
        last, now = now, stored(x.join(far, "id", "left").select("id", mixed.alias("features")), "propagated")
        dropped(last)
    dropped(adj)
    return now


class GcnColumns:
    """``gcn_matrix`` of an undirected graph's adjacency, of which only the columns asked for are
    made; degrees are all that is stored."""

    def __init__(self, graph: Graph, stored_degrees: DataFrame):
        self.edges, self.stored = graph.edges.select("src", "dst"), stored_degrees
        self.degrees = stored_degrees.select("id", "d")

    @staticmethod
    def of(graph: Graph) -> GcnColumns | None:
        """None for directed graphs, ends that are no nodes and repeated nodes, which take the matrix."""
        if graph.directed:
            return None
        other = (F.col("src") != F.col("dst")).cast("int").alias("d")
        src, dst = (graph.edges.select(F.col(end).alias("id"), F.lit(0).alias("nodes"), other) for end in ("src", "dst"))
        ends = stored(dst.groupBy("id").agg(F.max("nodes").alias("nodes"), F.sum("d").alias("d")), "ends")  # by itself: its shuffle files go before the next come
        rows = graph.nodes.select("id", F.lit(1).alias("nodes"), F.lit(1).alias("d")).unionByName(src).unionByName(ends)
        degrees = stored(rows.groupBy("id").agg(F.sum("nodes").alias("nodes"), F.sum("d").cast("double").alias("d")), "degrees")
        dropped(ends)
        if not degrees.where("nodes <> 1 or id is null or d is null").isEmpty():
            dropped(degrees)
            return None
        return GcnColumns(graph, degrees)

    def columns(self, x: DataFrame) -> DataFrame:
        """(i, j, v): the entries in the columns of x(id)."""
        ids = if_small(x.select(F.col("id").alias("j")))
        rest = self.edges.where("src <> dst")
        out = rest.select(F.col("src").alias("i"), F.col("dst").alias("j")).unionByName(rest.select(F.col("dst").alias("i"), F.col("src").alias("j"))).join(ids, "j", "left_semi")
        a = out.groupBy("i", "j").agg(F.count(F.lit(1)).cast("double").alias("a")).unionByName(x.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("a")))
        own = x.select(F.col("id").alias("j")).join(self.degrees.select(F.col("id").alias("j"), F.col("d").alias("dj")), "j")
        return a.join(own, "j").join(self.degrees.select(F.col("id").alias("i"), "d"), "i").select("i", "j", (F.col("a") / F.sqrt(F.col("d") * F.col("dj"))).alias("v"))

    def sums(self, x: DataFrame, size: int) -> DataFrame:
        return propagated_sums(self.columns(x), x, size)


def with_zeros(nodes: DataFrame, found: DataFrame, size: int) -> DataFrame:
    """(id, features) of all nodes; those that ``found`` lacks have zeros."""
    rows = nodes.select("id").join(found, "id", "left")
    return rows.select("id", F.coalesce("features", F.array_repeat(F.lit(0.0), size)).alias("features"))


def gcn_propagate_k(graph: Graph, size: int, k: int) -> DataFrame:
    """``propagate_k`` by the graph-convolution operator; rounds hold the nodes reached only."""
    matrix = GcnColumns.of(graph)
    if matrix is None:
        return propagate_k(gcn_matrix(adjacency_matrix(graph), graph.nodes), graph.nodes, size, k)
    out = stored(nonzero(graph.nodes.select("id", "features")), "propagated")
    for _ in range(k):
        last, out = out, stored(matrix.sums(out, size), "propagated")
        dropped(last)
    dropped(matrix.stored)
    return with_zeros(graph.nodes, out, size)


class Coefficients:
    """Rounds of ``gcn_appnp`` for alpha below 1, in which a node's vector is a sum of starting vectors: what is stored
    and moved are their numbers ``ss`` and coefficients ``cs``."""

    def __init__(self, matrix: GcnColumns, start: DataFrame, size: int, alpha: float):
        self.matrix, self.size, self.alpha = matrix, size, alpha
        numbers = start.select("id", F.row_number().over(W.orderBy("id")).alias("s"), "features")  # START_NUMBERS / size rows at most
        self.seeds = stored(numbers.join(matrix.degrees, "id"), "seeds")
        self.now = self.seeds.select("id", "d", F.array("s").alias("ss"), F.array(F.lit(1.0)).alias("cs"))
        self.nodes = matrix.degrees.count()

    @staticmethod
    def fit(start: DataFrame, size: int) -> bool:
        """Whether the starting vectors are few, of the size given and finite."""
        most = START_NUMBERS // max(size, 1)
        odd = (F.size("features") != size) | F.exists("features", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        return 0 < start.limit(most + 1).count() <= most and start.where(odd).isEmpty()

    def lighter(self) -> bool:
        """Whether the next round moves less than vectors would: 12 bytes an entry and 24 a list."""
        n = F.size("ss")
        self.rows, self.entries, self.products, edges = self.now.agg(F.count(F.lit(1)), F.sum(n), F.sum(F.col("d") * n), F.sum("d")).first()
        return 12 * self.products + 24 * edges <= 8 * self.size * edges

    def tasks(self, numbers: int) -> int:
        """Partitions for the round's products and as many numbers a node."""
        least = int(self.now.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return max(least, int(max(self.products, self.nodes * numbers // 4)) // TASK_PRODUCTS + 1)

    def sums(self, tasks: int) -> DataFrame:
        """(i, s, c, d): sums to be multiplied by (1 − α) / √d, and of each node a row without s that has its d."""
        edges = self.matrix.edges.where("src <> dst")
        edges = edges.select(F.col("src").alias("i"), F.col("dst").alias("j")).unionByName(edges.select(F.col("dst").alias("i"), F.col("src").alias("j")))
        own = self.now.select(F.col("id").alias("i"), "ss", F.transform("cs", lambda c: (1 / F.sqrt("d")) * c).alias("cs"))
        sent = own.withColumnRenamed("i", "j")
        if self.rows <= BROADCAST_ROWS and self.entries <= SMALL_VECTORS:
            sent = F.broadcast(sent)
        elif self.rows <= ID_HASHES:  # equal hashes let an edge pass that the join drops
            edges = edges.join(F.broadcast(self.now.select(F.xxhash64("id").alias("h"))), F.xxhash64("j") == F.col("h"), "left_semi")
        again = self.seeds.select(F.col("id").alias("i"), F.array("s").alias("ss"), F.array(F.sqrt("d") * (self.alpha / (1 - self.alpha))).alias("cs"))
        rows = edges.join(sent, "j").select("i", "ss", "cs").unionByName(own).unionByName(again)
        rows = rows.unionByName(self.matrix.degrees.select(F.col("id").alias("i"), "d"), allowMissingColumns=True).repartition(tasks, "i")
        each = rows.select("i", "d", F.explode_outer(F.arrays_zip("ss", "cs")).alias("e")).select("i", "d", F.col("e.ss").alias("s"), F.col("e.cs").alias("c"))
        return each.groupBy("i", "s").agg(F.sum("c").alias("c"), F.max("d").alias("d"))

    def step(self) -> None:
        found = self.sums(self.tasks(1)).groupBy("i").agg(F.max("d").alias("d"), F.collect_list(F.when(F.col("s").isNotNull(), F.struct("s", "c"))).alias("l"))
        scaled = F.transform("l.c", lambda c: c * ((1 - self.alpha) / F.sqrt("d")))
        last, self.now = self.now, stored(found.where(F.size("l") > 0).select(F.col("i").alias("id"), "d", F.col("l.s").alias("ss"), scaled.alias("cs")), "coefficients")
        dropped(last)

    def added_up(self, rows: DataFrame, by: str) -> DataFrame:
        """(id, d, features) of rows (by, s, c, d) that are partitioned by node."""
        met = rows.join(F.broadcast(self.seeds.select("s", "features")), "s", "left")
        parts = F.array(*(F.coalesce(F.sum(F.col("features")[k] * F.col("c")), F.lit(0.0)) for k in range(self.size)))
        return met.groupBy(F.col(by).alias("id")).agg(F.max("d").alias("d"), parts.alias("features"))

    def vectors(self) -> DataFrame:
        """(id, features) of the nodes reached so far."""
        each = self.now.repartition(self.tasks(1), "id").select("id", "d", F.explode(F.arrays_zip("ss", "cs")).alias("e"))
        return self.added_up(each.select("id", "d", F.col("e.ss").alias("s"), F.col("e.cs").alias("c")), "id").select("id", "features")

    def last(self) -> DataFrame:
        """(id, features) of all nodes after one more round, as a query: its vectors are made where they are read and move nowhere."""
        found = self.added_up(self.sums(self.tasks(self.size)), "i")
        return found.select("id", F.transform("features", lambda v: v * ((1 - self.alpha) / F.sqrt("d"))).alias("features"))


def gcn_appnp(graph: Graph, size: int, *, k: int = 10, alpha: float = 0.1) -> DataFrame:
    """``appnp`` by the graph-convolution operator; rounds hold the nodes reached only, by their coefficients
    while those are lighter than vectors."""
    matrix = GcnColumns.of(graph) if 0 <= alpha <= 1 else None
    if matrix is None:
        return appnp(gcn_matrix(adjacency_matrix(graph), graph.nodes), graph.nodes, size, k=k, alpha=alpha)
    start = stored(nonzero(graph.nodes.select("id", "features")), "propagated")
    now, zeros, done = start, F.array_repeat(F.lit(0.0), size), 0
    if k and alpha < 1 and Coefficients.fit(start, size):
        light = Coefficients(matrix, start, size, alpha)
        while light.lighter():
            if done == k - 1:
                dropped(start)
                return light.last()
            light.step()
            done += 1
        if done:
            now = stored(light.vectors(), "propagated")
        dropped(light.now, light.seeds)
    for _ in range(k - done):
        far = matrix.sums(now, size).withColumnRenamed("features", "f")
        rows = far.join(start.select("id", F.col("features").alias("x0")), "id", "full")
        mixed = F.zip_with(F.coalesce("f", zeros), F.coalesce("x0", zeros), lambda a, b: a * (1 - alpha) + b * alpha)
        last, now = now, stored(rows.select("id", mixed.alias("features")), "propagated")
        if last is not start:
            dropped(last)
    dropped(matrix.stored)
    if k:
        dropped(start)
    return with_zeros(graph.nodes, now, size)


def ppr_matrix(adj: DataFrame, nodes: DataFrame, *, alpha: float = 0.1, tolerance: float = 1e-9, max_rounds: int = 200) -> DataFrame:
    """α (I − (1 − α) A)⁻¹ for a symmetric normalised A, by the series α Σ (1 − α)^k A^k, until
    a term's entries are all below the tolerance.  The result is dense: n² entries."""
    term = nodes.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(float(alpha)).alias("v"))
    total = term
    for _ in range(max_rounds):
        term = stored(multiply(term, adj).select("i", "j", (F.col("v") * (1 - alpha)).alias("v")).where(F.abs("v") > tolerance), "term")
        if term.isEmpty():
            break
        total = stored(total.unionByName(term).groupBy("i", "j").agg(F.sum("v").alias("v")), "series")
    return total


def largest_eigenvalue(matrix: DataFrame, *, rounds: int = 100, tolerance: float = 1e-7) -> float:
    """Of a symmetric positive semi-definite matrix, by power iteration from a fixed start."""
    start = F.conv(F.substring(F.md5("i"), 1, 8), 16, 10).cast("double") / 4294967296.0 - 0.5
    x = stored(matrix.select("i").distinct().select("i", start.alias("x")), "vector")
    last = 0.0
    for _ in range(rounds):
        y = stored(matrix.join(x.select(F.col("i").alias("j"), "x"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y")), "vector")
        yy, xx = y.join(x, "i").agg(F.sum(F.col("y") * F.col("x")), F.sum(F.col("x") * F.col("x"))).first()
        n = y.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).first()[0] or 0.0
        value = (yy or 0.0) / xx if xx else 0.0
        if n == 0 or abs(value - last) < tolerance * max(1.0, abs(value)):
            return value
        last = value
        x = y.select("i", (F.col("y") / n).alias("x"))
    return last


def rescaled_laplacian(lap: DataFrame, nodes: DataFrame) -> DataFrame:
    """2/λmax · L − I."""
    top = largest_eigenvalue(lap) or 2.0
    minus = nodes.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(-1.0).alias("v"))
    return lap.select("i", "j", (F.col("v") * (2.0 / top)).alias("v")).unionByName(minus).groupBy("i", "j").agg(F.sum("v").alias("v"))


def chebyshev_coefficients(scale: float, degree: int, top: float) -> list[float]:
    """Of exp(−scale · x) on [0, top]."""
    import numpy as np

    fit = np.polynomial.chebyshev.Chebyshev.interpolate(lambda x: np.exp(-scale * x), degree, domain=[0, top])
    return [float(c) for c in fit.coef]


def graphwave(adj: DataFrame, nodes: DataFrame, *, scales: list[float], sample_points: list[float], degree: int = 20) -> DataFrame:
    """(id, scale, t, re, im): each node's heat-wavelet coefficients summed up by their
    empirical characteristic function at the sample points.  Pairs a wavelet doesn't reach
    count as coefficient 0; reach grows with the degree."""
    lap = stored(plain_laplacian(adj), "laplacian")
    top = largest_eigenvalue(lap)
    n = nodes.count()
    one = nodes.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))
    # T of the Laplacian moved to [-1, 1]
    moved = lap.select("i", "j", (F.col("v") * (2.0 / top)).alias("v")).unionByName(one.withColumn("v", F.lit(-1.0))).groupBy("i", "j").agg(F.sum("v").alias("v")) if top else one.withColumn("v", F.lit(0.0))
    moved = stored(moved, "moved")
    terms = [one, moved]
    for _ in range(2, degree + 1):
        twice = multiply(moved, terms[-1]).withColumn("v", F.col("v") * 2)
        terms.append(stored(twice.unionByName(terms[-2].withColumn("v", -F.col("v"))).groupBy("i", "j").agg(F.sum("v").alias("v")), "chebyshev"))
    out = None
    for scale in scales:
        psi = None
        for c, t in zip(chebyshev_coefficients(scale, degree, top or 1.0), terms):
            part = t.withColumn("v", F.col("v") * c)
            psi = part if psi is None else psi.unionByName(part)
        psi = psi.groupBy("i", "j").agg(F.sum("v").alias("v"))
        points = F.explode(F.array(*(F.lit(float(t)) for t in sample_points))).alias("t")
        found = psi.select("j", "v", points).groupBy(F.col("j").alias("id"), "t").agg(
            ((F.sum(F.cos(F.col("t") * F.col("v"))) + (n - F.count(F.lit(1)))) / n).alias("re"), (F.sum(F.sin(F.col("t") * F.col("v"))) / n).alias("im")
        ).withColumn("scale", F.lit(float(scale)))
        out = found if out is None else out.unionByName(found)
    return out.select("id", "scale", "t", "re", "im")


def relational_adjacency(edges: DataFrame, *, weighted: bool = False) -> DataFrame:
    """(type, i, j, v): for each type the transpose, rows divided by their sum or 1 if that is more."""
    v = F.sum("weight" if weighted else F.lit(1.0))
    a = edges.groupBy("type", F.col("dst").alias("i"), F.col("src").alias("j")).agg(v.alias("v"))
    d = a.groupBy("type", "i").agg(F.greatest(F.sum("v"), F.lit(1.0)).alias("d"))
    return a.join(d, ["type", "i"]).select("type", "i", "j", (F.col("v") / F.col("d")).alias("v"))


def cluster_batches(adj: DataFrame, clusters: DataFrame, *, per_batch: int = 1, lam: float = 0.1) -> DataFrame:
    """(batch, i, j, v): clusters(id, cluster) merged ``per_batch`` at a time, the adjacency inside
    a batch divided by degree + 1, and its diagonal enhanced by λ."""
    if lam <= 0:
        raise GraphError(f"expected lam above 0, found {lam!r}")
    own = clusters.select("id", F.floor(F.col("cluster") / per_batch).cast("long").alias("batch"))
    inside = (
        adj.join(own.select(F.col("id").alias("i"), "batch"), "i").join(own.select(F.col("id").alias("j"), F.col("batch").alias("other")), "j")
        .where("batch = other").select("batch", "i", "j", "v")
    )
    d = inside.groupBy("batch", "i").agg(F.sum("v").alias("d"), F.sum(F.when(F.col("i") == F.col("j"), F.col("v")).otherwise(0.0)).alias("loop"))
    full = own.select("batch", F.col("id").alias("i")).join(d, ["batch", "i"], "left").select("batch", "i", F.coalesce("d", F.lit(0.0)).alias("d"), F.coalesce("loop", F.lit(0.0)).alias("loop"))
    off = inside.where("i <> j").join(full, ["batch", "i"]).select("batch", "i", "j", (F.col("v") / (F.col("d") + 1)).alias("v"))
    diagonal = full.select("batch", "i", F.col("i").alias("j"), (F.col("loop") / (F.col("d") + 1) + lam / (F.col("d") + 1) * (F.col("loop") + 1 + 1 / lam)).alias("v"))
    return off.unionByName(diagonal)


def random_clusters(nodes: DataFrame, k: int, *, seed: int = 42) -> DataFrame:
    """(id, cluster): k clusters of equal size in hash order, the rest in the last."""
    from weftgraph.operators.sampling import numbered

    ranked = numbered(nodes.select("id", F.md5(F.concat_ws("|", F.lit(str(seed)), "id")).alias("h")), "h")
    size = max(nodes.count() // k, 1)
    return ranked.select("id", F.least(F.floor(F.col("n") / size), F.lit(k - 1)).cast("long").alias("cluster"))
