"""N-gram Jaccard join by MinHash banding.

Texts are sets of five-word shingles.  Band and row counts are chosen for a
target recall at the threshold.  Texts with equal shingle sets form one class,
named by 128 bits of the set's hash.  Band hashes are shuffled; classes that share
a bucket are candidates, verified on their full shingle sets in one of three places:

* classes whose buckets tie them into a component of one block meet there;
* in a larger component, classes that share a crowded bucket meet in the component
  of the crowded buckets, in blocks of bounded size, once for each pair of blocks;
* other pairs there meet in the first of the small buckets they share, of which one
  is kept where several hold the same classes.

So each pair that shares a bucket is verified once.  Neither pairs nor components
are collected: a block's task returns, for each class, the number of links it found
and the least class of its component there; a task of two blocks the numbers, and
edges between those components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_limits, dropped, fresh_worker, if_small, split_join, stored, table
from weftgraph.llm.substring_dedup import Words, batches_of, joined, mix

THRESHOLD = 0.8
SHINGLE = 5
TARGET_RECALL = 0.9999
#: Classes and shingles of a block; a task holds two blocks.
BLOCK_CLASSES = 1024
BLOCK_SHINGLES = 500_000
#: A bucket with more classes is crowded.
CROWDED = 64
#: Columns of the incidence matrix multiplied at once.
COLUMNS = 4096
MAX_ROUNDS = 60

U = np.uint64


def banding(threshold: float = THRESHOLD, recall: float = TARGET_RECALL, rows: int = 5) -> tuple[int, int]:
    """(bands, rows): the fewest bands that find a pair at the threshold with the
    probability ``recall``; ``rows`` keeps unlike pairs apart."""
    bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
    return bands, rows


BANDS, ROWS = banding()


def shingle_hashes(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, in order of row and hash.
    A text of fewer words than a shingle has its whole word sequence as its only
    shingle; a text without words has none."""
    n = len(w.hash)
    have = w.windows(SHINGLE) if n >= SHINGLE else np.zeros(0, np.uint64)
    ok = w.doc[: len(have)] == w.doc[SHINGLE - 1 :] if len(have) else np.zeros(0, bool)
    rows, hashes = [w.doc[: len(have)][ok]], [have[ok]]
    sizes = np.diff(w.first)
    for k in np.flatnonzero((sizes > 0) & (sizes < SHINGLE)):
        h = U(sizes[k])
        for x in w.hash[w.first[k] : w.first[k + 1]]:
            h = joined(np.array([h]), np.array([x]))[0]
        rows.append(np.array([k]))
        hashes.append(np.array([h], np.uint64))
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


SEEDS = np.random.default_rng(97).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | U(1)


def band_hashes(row: np.ndarray, h: np.ndarray, live: np.ndarray) -> np.ndarray:
    """(text, band) hashes of the texts in live, which have shingles."""
    begin = np.searchsorted(row, live)
    out = np.empty((len(live), BANDS), np.uint64)
    for b in range(BANDS):
        sig = np.full(len(live), U(b + 1))
        for r in range(ROWS):
            seed = SEEDS[b * ROWS + r]
            x = (h ^ (h >> U(29))) * seed
            x ^= x >> U(32)
            x *= U(0xD6E8FEB86659FD93)
            sig = joined(sig, np.minimum.reduceat(x, begin))
        out[:, b] = sig
    return out


def set_names(row: np.ndarray, h: np.ndarray, live: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name the shingle set of each text in live."""
    begin = np.searchsorted(row, live)
    one = mix(np.add.reduceat(mix(h), begin) + size[live].astype(np.uint64))
    return one, mix(np.add.reduceat(mix(h ^ U(0xA5A5A5A5A5A5A5A5)), begin))


def signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, size, c1, c2, bands): shingle count, the set's name and band hashes."""
    fresh_worker()
    for batch in batches:
        for first, texts in batches_of(batch, "text"):
            row, h = shingle_hashes(Words(texts))
            size = np.bincount(row, minlength=len(texts))
            live = np.flatnonzero(size)
            c1, c2 = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
            bands = np.zeros((len(texts), BANDS), np.uint64)
            if len(live):
                c1[live], c2[live] = set_names(row, h, live, size)
                bands[live] = band_hashes(row, h, live)
            own = batch.slice(first, len(texts))
            yield pa.RecordBatch.from_arrays(
                [
                    own.column("doc_id"), own.column("th"), pa.array(size, pa.int64()), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel())),
                ],
                ["doc_id", "th", "size", "c1", "c2", "bands"],
            )


def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c1, c2, shingles): the name and the sorted shingle set, as bytes, of each text with words."""
    fresh_worker()
    for batch in batches:
        for _, texts in batches_of(batch, "text"):
            row, h = shingle_hashes(Words(texts))
            size = np.bincount(row, minlength=len(texts))
            live = np.flatnonzero(size)
            if not len(live):
                continue
            c1, c2 = set_names(row, h, live, size)
            cut = np.searchsorted(row, [*live, len(texts)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), pa.array([h[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], ["c1", "c2", "shingles"]
            )


def verified(a: list[dict], b: list[dict], within: bool, threshold: float, place: tuple[int, int] = (0, 0)) -> np.ndarray:
    """Which of a × b are links: they share a band that counts at this place, and their sets'
    Jaccard similarity reaches the threshold; within one block only pairs above the diagonal.

    place: (0, 0), every band counts; (1, 0), those with crowded buckets; (2, k), band k, if no
    crowded bucket and no kept one of a lesser band is shared."""
    kind, band = place
    sa, sb = (np.array([x["bands"] for x in v], np.int64).reshape(len(v), -1) for v in (a, b))
    crowd, kept = (
        (np.array([x[c] for x in a], np.int64)[:, None], np.array([x[c] for x in b], np.int64)[None, :]) if kind else (None, None) for c in ("crowded", "kept")
    )
    near, barred = np.zeros((len(a), len(b)), bool), np.zeros((len(a), len(b)), bool)
    for k in range(sa.shape[1]):
        same = sa[:, k, None] == sb[None, :, k]
        if kind == 0:
            near |= same
        elif kind == 1:
            near |= same & ((crowd[0] & crowd[1]) >> k & 1 > 0)
        else:
            barred |= same & ((crowd[0] & crowd[1]) >> k & 1 > 0)
            if k < band:
                barred |= same & ((kept[0] & kept[1]) >> k & 1 > 0)
            elif k == band:
                near |= same
    near &= ~barred
    if within:
        near = np.triu(near, 1)
    sets = [np.frombuffer(x["shingles"], np.uint64) for x in a + ([] if within else b)]
    sizes = np.array([len(s) for s in sets], float)
    na, nb = sizes[: len(a)], sizes if within else sizes[len(a) :]
    # sizes alone rule a pair out where the smaller set is below the threshold's share of the larger
    near &= np.minimum(na[:, None], nb[None, :]) >= threshold * np.maximum(na[:, None], nb[None, :]) - 1e-9
    i, j = np.nonzero(near)
    if not len(i):
        return near
    if len(i) <= 4 * (len(a) + len(b)):
        both = np.array([len(np.intersect1d(sets[x], sets[y if within else len(a) + y], assume_unique=True)) for x, y in zip(i, j)], float)
    else:
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
        _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
        use = count[column] > 1
        renumber = np.cumsum(count > 1) - 1
        column, owner = renumber[column[use]], owner[use]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        total = np.zeros((len(a), len(b)), np.float32)
        width = int(column[-1]) + 1 if len(column) else 0
        for at in range(0, width, COLUMNS):
            lo, hi = np.searchsorted(column, [at, at + COLUMNS])
            m = np.zeros((len(sets), min(COLUMNS, width - at)), np.float32)
            m[owner[lo:hi], column[lo:hi] - at] = 1
            total += m[: len(a)] @ (m if within else m[len(a) :]).T
        both = total[i, j].astype(float)
    union = na[i] + nb[j] - both
    near[i, j] = both >= threshold * union - 1e-9
    return near


def forest(edges: set[tuple]) -> list[tuple]:
    """As many of the edges as join what they join."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in sorted(edges):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def block_links(group: list[dict], threshold: float) -> list[tuple[int, ...]]:
    """Of one block: (c1, c2, links, o1, o2) for each class with links, the other being the least
    class of its component within the block."""
    kind = group[0]["kind"]
    link = verified(group, group, True, threshold, (kind, group[0]["g1"] if kind == 2 else 0))
    link = link | link.T
    own = [(x["c1"], x["c2"]) for x in group]
    weight = np.array([x["copies"] for x in group], np.int64)
    label = np.arange(len(group))
    order = sorted(range(len(group)), key=own.__getitem__)
    done = np.zeros(len(group), bool)
    for start in order:  # the least class comes first in its component
        if done[start]:
            continue
        done[start], todo = True, [start]
        while todo:
            k = todo.pop()
            near = np.flatnonzero(link[k] & ~done)
            done[near], label[near] = True, start
            todo += near.tolist()
    return [(*own[k], int(weight[link[k]].sum()), *own[label[k]]) for k in np.flatnonzero(link.any(1)).tolist()]


def pair_links(group: list[dict], threshold: float) -> list[tuple[int, ...]]:
    """Of two blocks: the same for links from one to the other, each class with itself as other; and,
    with 0 links, edges that join the blocks' components, which their rows name (r1, r2)."""
    p, q = group[0]["p"], group[0]["q"]
    a, b = [x for x in group if x["own"] == p], [x for x in group if x["own"] == q]
    if not a or not b:
        return []
    link = verified(a, b, False, threshold, (group[0]["kind"], 0))
    out = []
    for side, other, m in ((a, b, link), (b, a, link.T)):
        weight = np.array([x["copies"] for x in other], np.int64)
        out += [(side[k]["c1"], side[k]["c2"], int(weight[m[k]].sum()), side[k]["c1"], side[k]["c2"]) for k in np.flatnonzero(m.any(1)).tolist()]
    at_a, at_b = ([(x["r1"], x["r2"]) for x in v] for v in (a, b))
    ends = {(at_a[i], at_b[j]) for i, j in zip(*(v.tolist() for v in np.nonzero(link)))}
    return out + [(*x, 0, *y) for x, y in forest(ends)]


def by_group(found: Callable[[list[dict], float], list[tuple[int, ...]]], threshold: float):
    """Rows sorted by group in; what ``found`` gives for each group out, with the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(rows: list[tuple[int, ...]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["kind", "g1", "g2", "c1", "c2", "links", "o1", "o2"])

        fresh_worker()
        key, group, out = None, [], []
        for batch in batches:
            for x in batch.to_pylist():
                now = tuple(x[c] for c in GROUP)
                if now != key and group:
                    out += [(*key[:3], *r) for r in found(group, threshold)]
                    group = []
                key = now
                if not group or (group[-1]["c1"], group[-1]["c2"]) != (x["c1"], x["c2"]):  # a repeated row's text comes once
                    group.append(x)
            if out:
                yield given(out)
                out = []
        if group and (out := [(*key[:3], *r) for r in found(group, threshold)]):
            yield given(out)

    return run


LINKS = "kind long, g1 long, g2 long, c1 long, c2 long, links long, o1 long, o2 long"


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node of each connected component of the undirected edges.

    Each round gives a node the least label among its neighbours' and then the label
    of that label; rounds are written out, and end when no label falls."""
    both = stored(
        edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
        .unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other")))
        .where("node <> other").distinct(),
        "edges",
    )
    label = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")), "labels")
    for _ in range(MAX_ROUNDS):
        seen = both.join(label.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("near"))
        met = label.join(seen, "node").select("node", F.least("root", "near").alias("met"), F.col("root").alias("was"))
        jump = met.join(label.select(F.col("node").alias("met"), F.col("root").alias("far")), "met", "left")
        new = stored(jump.select("node", F.least("met", F.coalesce("far", "met")).alias("root"), "was"), "labels")
        label = new.select("node", "root")
        if new.where("root <> was").isEmpty():
            return label
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


#: What names a task's pair of blocks.
GROUP = ("kind", "g1", "g2", "p", "q")


def blocks_of(part: DataFrame, classes: DataFrame) -> DataFrame:
    """part(class, part) with the number of blocks of each part."""
    load = part.join(classes.select("class", "size"), "class").groupBy("part").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")
    )
    return stored(split_join(part, stored(load, "loads"), ["part"], "n"), "parts")


def tie_edges(ties: DataFrame) -> DataFrame:
    """(a, b): as few edges as join each class with the least class of each of its buckets: the
    class with the least of these, and these with each other."""
    of = ties.groupBy("class").agg(F.min("least").alias("b"), F.collect_set("least").alias("all"))  # a band each at most
    own = of.select(F.col("class").alias("a"), "b")
    return own.unionByName(of.select(F.explode("all").alias("a"), "b").distinct()).where("a <> b")


def meetings(classes: DataFrame, spread: DataFrame) -> DataFrame:
    """(kind, g1, g2, blocks, class, crowded, kept): where each class that shares a bucket meets others.

    crowded and kept are bits by band, of the class's crowded buckets and of those of its small
    buckets that are kept; they matter in components of more than one block only."""
    counted = spread.groupBy("band", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("class").alias("least"), F.bit_xor(F.xxhash64("class")).alias("x1"), F.bit_xor(F.xxhash64("class", F.lit(1))).alias("x2")
    )
    buckets = stored(counted.where("n > 1"), "buckets")
    ties = stored(
        split_join(spread, buckets.select("band", "bucket", "least", "n").withColumn("rows", F.col("n")), ["band", "bucket"], "rows"), "ties"
    )
    part = components(tie_edges(ties))
    part = blocks_of(part.select(F.col("node").alias("class"), F.col("root").alias("part")), classes)
    none = F.lit(0).cast("long")
    alone = part.where("blocks = 1").select(F.lit(0).alias("kind"), F.col("part.c1").alias("g1"), F.col("part.c2").alias("g2"), "blocks", "class", none.alias("crowded"), none.alias("kept"))
    large = part.where("blocks > 1").select("class")
    if large.isEmpty():
        return alone
    held = stored(ties.join(large, "class"), "large")
    crowd = components(tie_edges(held.where(F.col("n") > CROWDED)))
    crowd = blocks_of(crowd.select(F.col("node").alias("class"), F.col("root").alias("part")), classes)
    kept = buckets.where(F.col("n") <= CROWDED).groupBy("n", "x1", "x2").agg(F.min(F.struct("band", "bucket")).alias("b")).select("b.*", F.lit(True).alias("keep"))
    held = stored(held.join(kept, ["band", "bucket"], "left").select("class", "band", "bucket", (F.col("n") > CROWDED).alias("full"), F.coalesce("keep", F.lit(False)).alias("keep")), "held")
    bit = F.expr("shiftleft(1L, band)")
    bits = stored(held.groupBy("class").agg(F.bit_or(F.when(F.col("full"), bit).otherwise(none)).alias("crowded"), F.bit_or(F.when(F.col("keep"), bit).otherwise(none)).alias("kept")), "bits")
    dense = crowd.join(bits, "class").select(F.lit(1).alias("kind"), F.col("part.c1").alias("g1"), F.col("part.c2").alias("g2"), "blocks", "class", "crowded", "kept")
    sparse = held.where("keep").join(bits, "class").select(F.lit(2).alias("kind"), F.col("band").cast("long").alias("g1"), F.col("bucket").alias("g2"), F.lit(1).alias("blocks"), "class", "crowded", "kept")
    return alone.unionByName(dense).unionByName(sparse)


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, th, class_id, class_th, copy_id, n_links) for every row of docs.

    copy_id is the least doc_id with the same shingle set; class_id the least doc_id of
    the near-duplicate component; n_links counts the other rows with a similarity of the
    threshold or more, copies included; th is xxhash64 of the text (of '' for null), and
    class_th that of the component's least row by (doc_id, th).  Rows
    are judged by their texts: those of one doc_id with different texts each have their own
    links.  Texts without words (null, empty, blank) have no links and are their own class,
    as have rows without a doc_id, whose ids are null.  Repeated rows count as copies; an
    empty table gives an empty result; other columns aren't read.  What the frame still reads
    is in its attribute ``reads``, to be dropped after it.
    """
    arrow_limits(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    signed = stored(
        base.mapInArrow(signature_rows, "doc_id long, th long, size long, c1 long, c2 long, bands array<long>"), "signatures"
    )
    real = signed.where("doc_id is not null and size > 0")
    classes = stored(
        real.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "th")).alias("at"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("size").alias("size"))
        .select(F.struct("c1", "c2").alias("class"), "at", "copies", "bands", "size"),
        "classes",
    )
    spread = classes.select("class", F.posexplode("bands").alias("band", "bucket"))
    meets = stored(meetings(classes, spread), "meetings")
    members = stored(classes.join(meets.select("class").distinct(), "class", "left_semi").select("class", "at", "copies", "bands"), "members")
    reps = stored(members.select("at.*").distinct(), "representatives")
    sets = base.where("doc_id is not null").join(if_small(reps), ["doc_id", "th"], "left_semi").select("text").mapInArrow(set_rows, "c1 long, c2 long, shingles binary")
    sets = stored(sets.select(F.struct("c1", "c2").alias("class"), "shingles").join(members.drop("at"), "class"), "sets")
    dropped(members, reps)
    met = sets.join(meets, "class").withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks").cast("long")).cast("int"))
    each = ["kind", "g1", "g2", "class.*", "copies", "bands", "crowded", "kept", "shingles", "own"]
    within = met.select(*each, F.col("own").alias("p"), F.col("own").alias("q")).repartition(*GROUP).sortWithinPartitions(*GROUP, "c1", "c2")
    links = stored(within.mapInArrow(by_group(block_links, threshold), LINKS), "links-within")
    passed = [classes, links]
    if not meets.where("blocks > 1").isEmpty():
        # classes of different blocks, which bring the names of their blocks' components
        place = ["kind", "g1", "g2", "c1", "c2"]
        names = links.select(*place, F.col("o1").alias("r1"), F.col("o2").alias("r2"))
        across = met.where("blocks > 1").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("with <> own")
        across = across.select(*each, F.least("own", "with").alias("p"), F.greatest("own", "with").alias("q")).join(names, place, "left")
        across = across.withColumns({"r1": F.coalesce("r1", "c1"), "r2": F.coalesce("r2", "c2")})
        across = across.repartition(*GROUP).sortWithinPartitions(*GROUP, "c1", "c2")
        passed.append(stored(across.mapInArrow(by_group(pair_links, threshold), LINKS), "links-across"))
        links = links.unionByName(passed[-1])
    dropped(sets, meets)
    links = links.select(F.struct("c1", "c2").alias("class"), F.struct(F.col("o1").alias("c1"), F.col("o2").alias("c2")).alias("other"), "links")
    count = links.groupBy("class").agg(F.sum("links").alias("links"))
    root = components(links.where("class <> other").select(F.col("class").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("class"), "root")
    # few classes have links; the others stand for themselves
    linked = stored(root.join(classes.select("class", "at", "copies"), "class").join(count, "class").select("class", "root", "links", "at"), "linked")
    passed.append(linked)
    linked = linked.join(linked.groupBy("root").agg(F.min("at").alias("least")), "root").select("class", "least", "links")
    about = classes.join(linked, "class", "left").select(
        "class.*", F.col("at.doc_id").alias("copy_id"), F.coalesce("least", "at").alias("least"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies"
    )
    key = F.when(F.col("doc_id").isNotNull() & (F.col("size") > 0), F.lit(True))
    rows = signed.select("doc_id", "th", F.when(key, F.col("c1")).alias("c1"), F.when(key, F.col("c2")).alias("c2"))
    about = stored(about, "about")
    dropped(*passed)
    found = split_join(rows.where(key), about, ["c1", "c2"], "copies")
    none = signed.where(~F.coalesce(key, F.lit(False))).select("doc_id", "th")
    out = found.select("doc_id", "th", F.col("least.doc_id").alias("class_id"), F.col("least.th").alias("class_th"), "copy_id", "n_links").unionByName(
        none.select("doc_id", "th", F.col("doc_id").alias("class_id"), F.col("th").alias("class_th"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
    )
    out.reads = (signed, about)
    return out


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every document's class, copies and links; see ``join`` for nulls, ties and repeats."""
    return join(table(spark, sf_dir, "documents")).drop("th", "class_th")


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
k AS (SELECT doc_id, len(s) AS n, array_to_string(list_sort(s), '|') AS sig, s FROM g),
c AS (SELECT min(doc_id) AS class, count(*) AS copies, any_value(n) AS n, any_value(s) AS s, sig FROM k WHERE n > 0 GROUP BY sig),
x AS (SELECT class, n, copies, unnest(s) AS h FROM c),
p AS (SELECT a.class AS a, b.class AS b, any_value(b.copies) AS w FROM x a JOIN x b ON a.h = b.h AND a.class <> b.class
  GROUP BY a.class, b.class HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
o AS (SELECT a, least(a, min(b)) AS root FROM r GROUP BY a),
l AS (SELECT a, sum(w) AS links FROM p GROUP BY a)
SELECT k.doc_id, CASE WHEN k.n = 0 THEN k.doc_id ELSE coalesce(o.root, c.class) END AS class_id, coalesce(c.class, k.doc_id) AS copy_id,
  CASE WHEN k.n = 0 THEN 0 ELSE coalesce(l.links, 0) + c.copies - 1 END::BIGINT AS n_links
FROM k LEFT JOIN c ON c.sig = k.sig AND k.n > 0 LEFT JOIN o ON o.a = c.class LEFT JOIN l ON l.a = c.class
"""
