"""Benchmark decontamination: size-partitioned MinHash containment search.

A short test item inside a long document has a tiny Jaccard similarity with it,
so the sketch is taken of the item alone: the shingles of the item with the least
hashes.  A document that contains the share c of an item misses a sketch of k
shingles with the hypergeometric probability C(m, k) / C(n, k), where m = (1 - c) n
of the n shingles are absent.  Items are partitioned by size, and each partition's
k is the least that keeps this below 1 - recall for all its sizes: up to some forty
shingles m + 1 of them suffice for certain.  A document that holds a sketch
shingle is a candidate, and is verified by the exact containment of the item's
shingle set.

Everything is DataFrame functions; no Python runs on executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import if_small, stored, table

SHINGLE = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.99999
#: Lower bounds of the item sizes (in shingles) of each partition.
SIZE_BOUNDS = (1, 5, 10, 15, 20, 30, 40, 64, 128, 512)
TOKEN = r"[\p{L}\p{N}]+"


def sketch_size(n: int, threshold: float, recall: float) -> int:
    """The fewest shingles, of an item's n, of which a document that holds the threshold's share
    of them holds one at least with the given probability."""
    absent = n - math.ceil(threshold * n - 1e-9)
    miss, k = 1.0, 0
    while miss > 1 - recall and k < n:
        miss *= max(absent - k, 0) / (n - k)
        k += 1
    return max(k, 1)


def partition_sketch(n: Column, threshold: float, recall: float) -> Column:
    """The sketch size of the partition that the item size n lies in."""
    out = F.lit(None).cast("int")
    for low, high in zip(SIZE_BOUNDS, (*SIZE_BOUNDS[1:], None)):
        # beyond the last bound the share absent decides, as if drawn with replacement
        k = max(sketch_size(m, threshold, recall) for m in range(low, high)) if high else max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold)))
        out = F.when(n >= low, F.lit(k)).otherwise(out)
    return out


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def parts_at(tokens: Column, i: Column, n: int = SHINGLE) -> list[Column]:
    """The n words from position i: element by element, as a slice copies the whole array."""
    return [F.get(tokens, i + k) for k in range(n)]


def shingle_hashes(tokens: Column, n: int = SHINGLE) -> Column:
    """The hash of each n-word shingle, repeats included; fewer words than n give none."""
    last = F.size(tokens) - n
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*parts_at(tokens, i, n)))
    return F.when(last >= 0, each).otherwise(F.array().cast("array<bigint>"))


def shingles(tokens: Column, n: int = SHINGLE) -> Column:
    """The shingles as structs of text s and hash h, repeats included."""
    last = F.size(tokens) - n

    def made(i: Column) -> Column:
        parts = parts_at(tokens, i, n)
        return F.struct(F.concat_ws(" ", *parts).alias("s"), F.xxhash64(*parts).alias("h"))

    each = F.transform(F.sequence(F.lit(0), last), made)
    return F.when(last >= 0, each).otherwise(F.array().cast("array<struct<s:string,h:bigint>>"))


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, *, least_words: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, matched, item_shingles): test items of which a document holds the
    threshold's share of the distinct five-word shingles or more.

    An item of fewer than five words, but of ``least_words``, is one shingle of all its words;
    shorter ones match nothing, as have null and empty texts.  Rows repeated with an equal id
    count as one document or item, which holds what any of the rows holds; so do null ids;
    empty tables give no rows; other columns aren't read.
    """
    # ids within a struct, where nulls are equal
    texts = docs.select(F.struct("doc_id").alias("doc"), "text")
    given = items.select(F.struct("item_id").alias("item"), words(F.col("text")).alias("t")).where(F.size("t") >= max(least_words, 1))
    length = F.least(F.size("t"), F.lit(SHINGLE))
    lengths = sorted(r[0] for r in given.select(length.alias("l")).distinct().collect()) or [SHINGLE]  # five values at most
    item = None
    for n in lengths:
        part = given.where(length == n).select("item", F.inline(shingles(F.col("t"), n)))
        item = part if item is None else item.unionByName(part)
    item = stored(item.distinct(), "items")
    ranked = F.array_sort(F.collect_list(F.struct(F.xxhash64("h", F.lit(1)).alias("order"), "h")))
    sketched = item.groupBy("item").agg(F.count(F.lit(1)).cast("int").alias("n"), ranked.alias("r"))
    sketched = stored(sketched.select("item", "n", F.slice(F.col("r.h"), F.lit(1), partition_sketch(F.col("n"), threshold, TARGET_RECALL)).alias("hs")), "sketches")
    sizes, sketch = sketched.select("item", "n"), sketched.select(F.explode("hs").alias("h"), "item")

    tokens = texts.select("doc", words(F.col("text")).alias("t"))
    hashes = [shingle_hashes(F.col("t"), n) for n in lengths]
    held = tokens.select("doc", F.explode(F.concat(*hashes) if len(hashes) > 1 else hashes[0]).alias("h"))
    # what a projection or a distinct gives of a stored frame is read from it again: a small write
    # takes longer, and on a local folder each of its files starts three processes of the executor
    hits = held.join(if_small(sketch.select("h").distinct()), "h", "left_semi")
    # a hot shingle meets its items after its documents' duplicates are gone
    pairs = stored(hits.distinct().join(if_small(sketch), "h").select("doc", "item").distinct(), "candidates")

    wanted = stored(item.join(pairs.select("item").distinct(), "item", "left_semi").select("item", "h", "s"), "wanted")
    near = texts.join(if_small(pairs.select("doc").distinct()), "doc", "left_semi").select("doc", words(F.col("text")).alias("t"))
    each = [shingles(F.col("t"), n) for n in lengths]
    near = near.select("doc", F.inline(F.concat(*each) if len(each) > 1 else each[0]))
    near = near.join(if_small(wanted.select("h").distinct()), "h", "left_semi").select("doc", "s").distinct()
    matched = (
        near.join(if_small(wanted.select("item", "s")), "s").join(pairs, ["doc", "item"], "left_semi")
        .groupBy("doc", "item").agg(F.count(F.lit(1)).alias("matched"))
    )
    return (
        matched.join(sizes, "item").where(F.col("matched") >= F.col("n") * threshold - 1e-9)
        .select("doc.doc_id", "item.item_id", "matched", F.col("n").cast("long").alias("item_shingles"))
    )


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document's test items, short ones too; see ``contained`` for nulls and repeats."""
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least_words=1)


OP6_SQL = r"""
WITH it AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
l AS (SELECT DISTINCT least(len(w), 5) AS l FROM it WHERE len(w) > 0),
s AS (SELECT DISTINCT item_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM it WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n FROM s GROUP BY item_id),
dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
d AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + l - 1], ' ') AS s FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM dw, l WHERE len(w) >= l)),
m AS (SELECT doc_id, item_id, count(*) AS matched FROM d JOIN s USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, m.item_id, matched, n AS item_shingles FROM m JOIN n ON n.item_id = m.item_id WHERE matched >= 0.8 * n - 1e-9
"""
