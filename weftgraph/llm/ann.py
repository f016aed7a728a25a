"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: the signs after learned rotations (iterative
quantisation, several rotations side by side).  A code is cut into m substrings, and
each has a table from its values to the rows that have them.  By the pigeonhole
principle two codes within Hamming distance r = m a + b agree up to a in one of the
first b + 1 substrings, or up to a - 1 in one of the others.  So each table is
probed for the values present within that reach of the query's, which retrieves
every code within r; those are reranked by exact distances.  Wide substrings keep
the probed share small where neighbours are nearly as far as chance would have them.
Queries are a stated set; they meet the index, which is coded and written out once,
in blocks, and each block's queries are broadcast at a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_limits, fresh_worker, if_small, stored, table

ROTATIONS = 4
SAMPLE = 4000
SAMPLE_QUERIES = 200
ROUNDS = 25
#: The radius is where the sample's true neighbours lie with this share.
RADIUS_SHARE = 0.98
SUBSTRING_BYTES = 8
#: Queries of a block, and index rows that a task handles at once.
BLOCK_QUERIES = 2048
BLOCK_ROWS = 8192
POPCOUNT = np.array([bin(k).count("1") for k in range(256)], np.uint8)


@dataclass(frozen=True)
class Codebook:
    mean: np.ndarray
    rotations: np.ndarray  # (rotation, dim, dim)
    radius: int

    @property
    def bits(self) -> int:
        return self.rotations.shape[0] * self.rotations.shape[2]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(row, byte): each byte is a substring of 8 bits."""
        y = x - self.mean
        y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
        signs = np.concatenate([y @ r > 0 for r in self.rotations], axis=1)
        return np.packbits(signs, axis=1)


def learn(x: np.ndarray, k: int, seed: int = 5) -> Codebook:
    """Rotations that bring the sample's vectors near to their signs, and the radius that
    holds RADIUS_SHARE of the sample's k nearest neighbours."""
    rng = np.random.default_rng(seed)
    mean = x.mean(0)
    y = x - mean
    y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    rotations = []
    for _ in range(ROTATIONS):
        r, _ = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))
        for _ in range(ROUNDS):
            b = np.where(y @ r > 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(y.T @ b)
            r = u @ vt
        rotations.append(r)
    book = Codebook(mean, np.array(rotations), 0)
    codes = book.codes(x)
    distances = []
    for q in range(min(SAMPLE_QUERIES, len(x))):
        near = np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[1 : k + 1]
        distances.append(POPCOUNT[codes[near] ^ codes[q]].sum(1, dtype=np.int64))
    found = np.concatenate(distances) if distances else np.zeros(0)
    return replace(book, radius=int(np.ceil(np.quantile(found, RADIUS_SHARE))) if len(found) else book.bits)


class Tables:
    """The tables of a piece of the index: for each substring its values and the rows that have them."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.parts = []
        for column in substrings(codes).T:
            values, where = np.unique(column, return_inverse=True)
            self.parts.append((values, np.argsort(where, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(where, minlength=len(values)))])))

    def probed(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows, in order, that a probe of the tables retrieves: a superset of those within the radius."""
        a, b = divmod(radius, len(self.parts))
        hit = np.zeros(len(self.codes), bool)
        for s, ((values, order, begin), wanted) in enumerate(zip(self.parts, substrings(code[None, :])[0])):
            reach = a if s <= b else a - 1
            for v in np.flatnonzero(np.bitwise_count(values ^ wanted) <= reach) if reach >= 0 else ():
                hit[order[begin[v] : begin[v + 1]]] = True
        return np.flatnonzero(hit)


def substrings(codes: np.ndarray) -> np.ndarray:
    """(row, substring): each substring of a code as a number; the last one is padded."""
    n, size = codes.shape
    whole = np.zeros((n, -(-size // SUBSTRING_BYTES) * SUBSTRING_BYTES), np.uint8)
    whole[:, :size] = codes
    return whole.view("<u8")


def within(codes: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(query, rows of the index within the radius), by probing each substring's table."""
    tables = Tables(codes)
    for q, code in enumerate(queries):
        rows = tables.probed(code, radius)
        yield q, rows[POPCOUNT[codes[rows] ^ code].sum(1, dtype=np.int64) <= radius]


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector takes part: of the table's dimension, without null or non-finite
    components, and not all zero."""
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return vector.isNotNull() & (F.size(vector) == dim) & F.forall(vector, number) & F.exists(vector, lambda v: v != 0)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest of the vectors found.

    Both frames have vec_id and embedding.  A vector isn't its own neighbour.  Vectors that
    are null, zero, hold null or non-finite components or differ from the commonest
    dimension take no part.  Score is the Euclidean distance in double precision; ties go
    to the smaller vec_id.  Of rows with the same vec_id the one with the least vector
    counts.  A query that finds fewer than k within the radius is searched again with the
    radius of all codes, so it has k neighbours wherever there are as many vectors.  Other
    columns aren't read; empty tables give no rows.
    """
    spark = vectors.sparkSession
    arrow_limits(spark)
    sizes = vectors.groupBy(F.size("embedding").alias("n")).count().where("n > 0").orderBy(F.desc("count"), "n").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dim = sizes[0].n

    def clean(df: DataFrame) -> DataFrame:
        return df.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"), dim)).select(
            F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
        )

    def once(df: DataFrame) -> DataFrame:
        twice = stored(df.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id"), "repeated-vectors")
        if twice.isEmpty():
            return df
        twice = if_small(twice)
        least = df.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        return df.join(twice, "vec_id", "left_anti").unionByName(least)

    index = once(clean(vectors))
    sample = index.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    if not sample:
        return spark.createDataFrame([], schema)
    book = learn(np.array([r.embedding for r in sample]), k)
    index = stored(coded(index, book), "index")

    # the stated queries in blocks of BLOCK_QUERIES or so, by hash; one block is broadcast at a time
    wanted = stored(once(clean(queries)), "queries")
    count = wanted.count()
    blocks = max(1, -(-count // BLOCK_QUERIES))
    found = None
    for block in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect()
        if not part:
            continue
        near = stored(nearest(index, part, book, k), "near")
        short = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("query_id")
        have = {r.query_id for r in short.collect()}
        rest = [r for r in part if r.vec_id not in have]
        if rest:
            more = stored(nearest(index, rest, replace(book, radius=book.bits), k), "near-all")
            near = near.join(short, "query_id", "left_semi").unionByName(more)
        found = near if found is None else found.unionByName(near)
    return found if found is not None else spark.createDataFrame([], schema)


def coded(index: DataFrame, book: Codebook) -> DataFrame:
    """The index with each vector's code."""
    shared = index.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            if batch.num_rows:
                x = batch.column("embedding").flatten().to_numpy().reshape(batch.num_rows, -1)
                codes = [c.tobytes() for c in shared.value.codes(x)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary())], ["vec_id", "embedding", "code"])

    return index.select("vec_id", "embedding").mapInArrow(run, "vec_id long, embedding array<double>, code binary")


def nearest(index: DataFrame, queries: list, book: Codebook, k: int) -> DataFrame:
    """The k nearest within the book's radius, of one block of queries: each piece of the
    index gives its own k at most, and they are merged by query."""
    spark = index.sparkSession
    ids = np.array([r.vec_id for r in queries], np.int64)
    exact = np.array([r.embedding for r in queries], np.float64)
    shared = spark.sparkContext.broadcast((ids, exact, book))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, exact, book = shared.value
        wanted = book.codes(exact)

        def given(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            own = np.concatenate([p.column("vec_id").to_numpy() for p in parts])
            x = np.concatenate([p.column("embedding").flatten().to_numpy() for p in parts]).reshape(len(own), -1)
            codes = np.frombuffer(b"".join(c for p in parts for c in p.column("code").to_pylist()), np.uint8).reshape(len(own), -1)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for q, near in within(codes, wanted, book.radius):
                near = near[own[near] != ids[q]]
                d = np.sqrt(((x[near] - exact[q]) ** 2).sum(1))
                best = np.lexsort((own[near], d))[:k]
                out.append((np.full(len(best), ids[q]), own[near][best], d[best]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "vec_id", "score"])

        fresh_worker()
        parts, n = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append(batch)
                n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield given(parts)
                parts, n = [], 0
        if n:
            yield given(parts)

    local = index.select("vec_id", "embedding", "code").mapInArrow(run, "query_id long, vec_id long, score double")
    merged = local.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set(F.struct("score", "vec_id"))), 1, k).alias("best"))
    return merged.select("query_id", F.posexplode("best").alias("at", "b")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", "b.score"
    )


def op4_ann(spark, sf_dir: str) -> DataFrame:
    """The stated queries' ten nearest vectors; see ``search`` for what takes no part."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0))
