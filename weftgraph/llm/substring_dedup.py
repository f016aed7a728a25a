"""Removal of repeated word windows by level-wise doubling.

Windows of a quarter of the length are counted first, but only at anchors: in
each full window the short window with the least hash.  Equal full windows
have equal anchors at equal offsets, so nothing is missed.  Anchors found
twice are extended to twice the length, on either side; those whose doubled
windows repeat are extended to the full length.  There windows with the same
anchor form a run; runs are counted whole first, and only where an anchor has
several different runs are their windows counted one by one, once a distinct
run.  Levels stop as soon as no candidate survives.

Counts at the last level are by two hashes of 64 bits together: the anchor's, and
the window's from a second, independent hash of its words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_limits, bucketed, dropped, fresh_worker, split_join, stored, table, widened

WINDOW = 35
#: Short windows have a quarter of the length, rounded up: 9, 18, 35.
QUARTER = 9
HALF = 18
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BATCH_BYTES = 2_000_000

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
#: Keys of the two word hashes; they are independent of each other.
KEYS = (0x243F6A8885A308D3, 0x13198A2E03707344)
#: Words of more bytes are hashed by BLAKE2.
LONG_WORD = 256
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: The lowest k bytes of a number.
LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two adjacent windows."""
    return mix(a * BASE + (b ^ U(0x632BE59BD9B4E019)))


def word_hashes(data: bytes, start: np.ndarray, end: np.ndarray, key: int) -> np.ndarray:
    """The hash of each word data[start:end]: eight bytes at a time, mixed after each, so
    that no two words collide by the structure of their letters.  Data ends in 8 spare bytes."""
    size = end - start
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = mix(mix((eight[start] & LOWEST[np.minimum(size, 8)]) ^ U(key)) + size.astype(np.uint64))
    live, at = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(live):
        rest = size[live] - at
        h[live] = joined(h[live], (eight[start[live] + at] & LOWEST[np.minimum(rest, 8)]) ^ U(key))
        live, at = live[rest > 8], at + 8
    for k in np.flatnonzero(size > LONG_WORD):
        digest = hashlib.blake2b(data[start[k] : end[k]], digest_size=8, key=key.to_bytes(8, "little")).digest()
        h[k] = int.from_bytes(digest, "little")
    return h


class Words:
    """Word hashes of a batch of texts, each text's bytes whole."""

    def __init__(self, texts: list[bytes]):
        data = b" ".join([*texts, bytes(8)])
        self.data = data
        edge = np.ones(len(data) - 6, bool)
        edge[1:-1] = BLANK[np.frombuffer(data, np.uint8, len(data) - 8)]
        edge = np.flatnonzero(edge[1:] != edge[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        self.hash = word_hashes(data, self.start, self.end, KEYS[0])
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def second(self) -> np.ndarray:
        """Another hash of each word."""
        return word_hashes(self.data, self.start, self.end, KEYS[1])

    def windows(self, length: int, words: np.ndarray | None = None) -> np.ndarray:
        """The hash of the window of length words at each position, by doubling, from the
        word hashes given; positions whose window would pass the batch's end have none."""
        parts, have, size = [], self.hash if words is None else words, 1
        rest = length
        while rest:
            if rest & size:
                parts.append((size, have))
                rest -= size
            if rest:
                if len(have) <= size:
                    return np.zeros(0, np.uint64)
                have = joined(have[:-size], have[size:])
                size *= 2
        out, done = None, 0
        for size, have in reversed(parts):
            shifted = have[done:]
            if out is None:
                out = shifted
            else:
                n = min(len(out), len(shifted))
                out = joined(out[:n], shifted[:n])
            done += size
        return out[: max(len(self.hash) - length + 1, 0)]

    def full(self) -> np.ndarray:
        """Whether a full window within one text starts at each position."""
        ok = np.zeros(len(self.hash), bool)
        n = len(ok) - WINDOW + 1
        if n > 0:
            ok[:n] = self.doc[:n] == self.doc[WINDOW - 1 :]
        return ok

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window starts, the position of each window's anchor, hashes of short windows).
        The anchor is the leftmost short window of least hash."""
        short = self.windows(QUARTER)
        starts = np.flatnonzero(self.full())
        if not len(starts):
            return starts, starts, short
        span = WINDOW - QUARTER + 1
        place = np.arange(len(short))

        def lesser(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return np.where(short[j] < short[i], j, i)

        size = 1
        while size * 2 <= span:
            place = lesser(place[:-size], place[size:])
            size *= 2
        place = lesser(place[: len(place) - (span - size)], place[span - size :])
        return starts, place[starts], short


def batches_of(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes) of pieces of a batch with BATCH_BYTES or so; null is empty."""
    texts = [(t or "").encode("utf-8", "replace") for t in batch.column(column).to_pylist()]
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= BATCH_BYTES or k == len(texts) - 1:
            yield at, texts[at : k + 1]
            at, size = k + 1, 0


def signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64), pa.int64())


def keyed(docs: DataFrame) -> DataFrame:
    """Adds did and th, which name a text of a row; rows equal in both have equal texts
    (and so the same windows to remove)."""
    return docs.withColumns({"did": F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "th": F.xxhash64(F.coalesce("text", F.lit("")))})


def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, did, th, pos) of each anchor of each text."""
    fresh_worker()
    for batch in batches:
        for first, texts in batches_of(batch, "text"):
            w = Words(texts)
            _, place, short = w.anchors()
            place = np.unique(place)
            row = w.doc[place]
            take = pa.array(row + first)
            yield pa.RecordBatch.from_arrays(
                [signed(short[place]), batch.column("did").take(take), batch.column("th").take(take), pa.array((place - w.first[row]).astype(np.int32))],
                ["h", "did", "th", "pos"],
            )


def flat(batch: pa.RecordBatch, first: int, n: int, column: str) -> tuple[np.ndarray, np.ndarray]:
    """(row within the piece, value) of a list column."""
    lists = batch.column(column).slice(first, n)
    values = lists.flatten()
    sizes = np.array([0 if s is None else s for s in pc.list_value_length(lists).to_pylist()], np.int64)
    return np.repeat(np.arange(n), sizes), values.to_numpy(zero_copy_only=False)


def half_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, did, th, pos): the windows of twice the length to either side of each
    surviving anchor, as far as they lie within the text."""
    fresh_worker()
    for batch in batches:
        for first, texts in batches_of(batch, "text"):
            w = Words(texts)
            half = w.windows(HALF)
            row, pos = flat(batch, first, len(texts), "pos")
            at = w.first[row] + pos
            for shift in (0, QUARTER):
                start = at - shift
                ok = (start >= w.first[row]) & (start + HALF <= w.first[row + 1])
                take = pa.array(row[ok] + first)
                yield pa.RecordBatch.from_arrays(
                    [signed(half[start[ok]]), batch.column("did").take(take), batch.column("th").take(take), pa.array(pos[ok].astype(np.int32))],
                    ["h", "did", "th", "pos"],
                )


def runs_of(w: Words, row: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor hash, run hash, first window, windows, row) for each surviving anchor that
    has windows: the windows whose anchor it is are consecutive."""
    starts, place, short = w.anchors()
    at = w.first[row] + pos
    lo = np.searchsorted(place, at, "left")
    hi = np.searchsorted(place, at, "right")
    ok = hi > lo
    lo, hi, at, row = lo[ok], hi[ok], at[ok], row[ok]
    begin, count = starts[lo], hi - lo
    # the first and the last window cover the run, as no anchor has more windows than one has words
    full = w.windows(WINDOW, w.second())
    run = joined(full[begin], full[begin + count - 1])
    run = mix(run + U(64) * (at - begin).astype(np.uint64) + count.astype(np.uint64))
    return short[at], run, begin, count, row


def run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, run, did, th, first, n) of each run."""
    fresh_worker()
    for batch in batches:
        for first, texts in batches_of(batch, "text"):
            w = Words(texts)
            row, pos = flat(batch, first, len(texts), "pos")
            h, run, begin, count, row = runs_of(w, row, pos)
            take = pa.array(row + first)
            yield pa.RecordBatch.from_arrays(
                [signed(h), signed(run), batch.column("did").take(take), batch.column("th").take(take), pa.array((begin - w.first[row]).astype(np.int32)), pa.array(count.astype(np.int32))],
                ["h", "run", "did", "th", "first", "n"],
            )


def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, run, at, win, copies): the windows of the runs named in a text's lists."""
    fresh_worker()
    for batch in batches:
        for first, texts in batches_of(batch, "text"):
            w = Words(texts)
            full = w.windows(WINDOW, w.second())
            row, begin = flat(batch, first, len(texts), "firsts")
            columns = {c: flat(batch, first, len(texts), c)[1] for c in ("hs", "runs", "ns", "copies")}
            n = columns["ns"].astype(np.int64)
            each = np.repeat(np.arange(len(n)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns["hs"][each]), pa.array(columns["runs"][each]), pa.array(at.astype(np.int32)), signed(full[(w.first[row] + begin)[each] + at]), pa.array(columns["copies"][each])],
                ["h", "run", "at", "win", "copies"],
            )


def removal_rows(names: list[str]):
    """The rows with words counted, removed and the kept text added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            firsts, masks = batch.column("firsts").to_pylist(), batch.column("masks").to_pylist()
            total, removed, kept = [], [], []
            for text, begin, mask in zip(texts, firsts, masks):
                words = WORD.findall(text or "")
                if begin:
                    cover = np.zeros(len(words) + 1, np.int32)
                    for b, m in zip(begin, mask):
                        at = b + np.flatnonzero((m >> np.arange(32)) & 1)
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + WINDOW, -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    left = [x for x, g in zip(words, gone.tolist()) if not g]
                else:
                    left = words
                total.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column("text") if c == "text" else batch.column("rest").field(c) for c in names), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                [*names, "n_words", "n_removed", "kept_text"],
            )

    return run


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys found in more than one row, with their rows counted by partial sums."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("found")).where("found > 1")


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs with n_words, n_removed and kept_text.

    Every word covered by a window of WINDOW words that also starts anywhere else,
    the same text included, is removed; windows are judged on the input.  A null or
    empty text, or one of fewer words than a window, keeps all its words; repeated
    rows repeat each other; an empty table gives an empty one; further columns stay.
    The texts are stored in buckets of their keys, and only lists of places move to them.
    """
    arrow_limits(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text")]
    key, spot = ["did", "th"], "h long, did string, th long, pos int"
    rest = F.struct(*(c for c in names if c != "text")).alias("rest")
    base = bucketed(keyed(docs.select(rest, "doc_id", "text")).select(*key, "rest", "text"), "texts", *key)
    texts = base.select(*key, "text")

    anchors = stored(texts.mapInArrow(anchor_rows, spot), "anchors")
    twice = stored(repeated(anchors, "h"), "anchors-twice")
    alive = split_join(anchors, twice, ["h"], "found", "left_semi")
    lists = alive.groupBy(*key).agg(F.collect_set("pos").alias("pos"))
    spots = stored(texts.join(lists, key).mapInArrow(half_rows, spot), "doubled")
    dropped(anchors, twice)
    twice = stored(repeated(spots, "h"), "doubled-twice")
    alive = split_join(spots, twice, ["h"], "found", "left_semi")
    lists = alive.groupBy(*key).agg(F.collect_set("pos").alias("pos"))
    runs = stored(texts.join(lists, key).mapInArrow(run_rows, "h long, run long, did string, th long, first int, n int"), "runs")
    dropped(spots, twice)
    kinds = stored(
        runs.groupBy("h", "run").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("did", "th", "first", "n")).alias("at")), "kinds"
    )
    several = stored(repeated(kinds, "h"), "several")
    mixed = split_join(kinds, several, ["h"], "found", "left_semi")
    alone = kinds.where("copies > 1").select("h", "run", F.expr("cast(shiftleft(1L, at.n) - 1 as long)").alias("mask"), "copies")
    named = mixed.select("h", "run", "copies", "at.*").groupBy(*key).agg(
        F.collect_list(F.struct("h", "run", "first", "n", "copies")).alias("w")
    ).select(*key, F.col("w.h").alias("hs"), F.col("w.run").alias("runs"), F.col("w.first").alias("firsts"), F.col("w.n").alias("ns"), F.col("w.copies").alias("copies"))
    windows = stored(texts.join(named, key).mapInArrow(window_rows, "h long, run long, at int, win long, copies long"), "windows")
    common = stored(
        windows.groupBy("h", "win").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("found")).where("copies > 1").drop("copies"), "windows-twice"
    )
    some = (
        split_join(windows, common, ["h", "win"], "found", "left_semi")
        .groupBy("h", "run").agg(F.expr("bit_or(shiftleft(1L, at))").alias("mask"), F.max("copies").alias("copies"))
    )
    masks = stored(alone.unionByName(some).groupBy("h", "run").agg(F.expr("bit_or(mask)").alias("mask"), F.max("copies").alias("copies")), "masks")
    dropped(kinds, several, windows, common)
    spans = (
        split_join(runs, masks, ["h", "run"], "copies")
        .groupBy(*key).agg(F.collect_set(F.struct("first", "mask")).alias("s"))
        .select(*key, F.col("s.first").alias("firsts"), F.col("s.mask").alias("masks"))
    )
    spans = stored(spans, "spans")
    dropped(runs, masks)
    found = base.join(spans, key, "left").select("rest", "text", "firsts", "masks")
    schema = widened(docs.select(*names), n_words="long", n_removed="long", kept_text="string")
    return found.mapInArrow(removal_rows(names), schema)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(range(1, greatest(len(w) - 33, 1))) AS p, w FROM d WHERE len(w) >= 35),
k AS (SELECT r, p, md5(array_to_string(w[p:p + 34], ' ')) AS h FROM s),
t AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY h) AS c FROM k) WHERE c > 1),
g AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS p FROM t),
x AS (SELECT r, doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
y AS (SELECT x.r, string_agg(word, ' ' ORDER BY x.p) AS kept, count(*) AS n FROM x LEFT JOIN g ON g.r = x.r AND g.p = x.p WHERE g.p IS NULL GROUP BY x.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN y ON y.r = d.r
"""
