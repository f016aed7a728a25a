"""Licence scans: sparse TF-IDF cosine to templates, then directory inheritance.

A file's lines and paragraphs that share a term with a template are compared with
the templates.  Terms are weighed by TF-IDF, counted over all those blocks of all
files.  A file has the licence of its best block; a licence file gives its licence
to its directory; a file without one takes that of its nearest ancestor directory,
by joins of directories with their ancestors' paths.

Most blocks share common words only, and two bounds spare them without losing a
match.  A block without any of a template's heaviest terms, whose squared weights
sum to 1 - threshold² of the template's, can't reach the threshold with it; and as
no term weighs less than its count, the counts of a block's other terms bound its
length from below.  What is left is weighed in full.

Everything is DataFrame functions; no Python runs on executors.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import if_small, stored, table

THRESHOLD = 0.75
#: Up to so many terms are looked up in place; more are joined.
MOST_TERMS = 5000
TOKEN = r"[\p{L}\p{N}]+(?:\.[0-9]+)?"
#: A block without any of these isn't compared.
MARKERS = r"(?i)licen[cs]|copyright|copying|all rights reserved|public domain|permission is hereby granted|redistribution and use"
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([.-].*)?$"

#: Header sentences and opening sentences by licence.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD", "Licensed under the BSD License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved."),
)

SPDX = {
    "Apache-2.0": ("Apache-2.0",), "MIT": ("MIT",), "BSD": ("BSD-2-Clause", "BSD-3-Clause"), "GPL-3.0": ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"),
    "GPL-2.0": ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"), "LGPL-3.0": ("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "AGPL-3.0": ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"), "MPL-2.0": ("MPL-2.0",), "CC-BY-4.0": ("CC-BY-4.0",), "CC-BY-SA-4.0": ("CC-BY-SA-4.0",),
    "CC-BY-NC-4.0": ("CC-BY-NC-4.0",), "CC0-1.0": ("CC0-1.0",), "Unlicense": ("Unlicense",),
}
#: The templates of the scan without a gate: also SPDX lines, short names and the heads of licence files.
ALL_TEMPLATES = TEMPLATES + tuple((name, f"SPDX-License-Identifier: {x}") for name, own in SPDX.items() for x in own) + (
    ("GPL-3.0", "GPLv3"),
    ("GPL-2.0", "GPLv2"),
    ("LGPL-3.0", "LGPLv3"),
    ("AGPL-3.0", "AGPLv3"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("BSD", "BSD 2-Clause License"),
    ("BSD", "BSD 3-Clause License"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC0-1.0", "CC0 1.0 Universal"),
)


def templates(spark: SparkSession, given: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    rows = [F.struct(F.lit(k).alias("tid"), F.lit(name).alias("license"), F.lit(text).alias("text")) for k, (name, text) in enumerate(given)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def best_licenses(blocks: DataFrame, given: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(bid, license, score) of distinct candidate blocks(bid, block) at or over the threshold;
    of equal scores the lesser licence name wins.  Terms carry the block's digest, never its text."""
    spark = blocks.sparkSession
    count = blocks.agg(F.count(F.lit(1)).alias("total"))  # one row, joined below as a bounded side
    tf = blocks.select("bid", terms(F.col("block")).alias("t")).select("bid", F.explode("t").alias("term")).groupBy("bid", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = stored(tf, "terms")
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ours = templates(spark, given).select("tid", "license", F.explode(terms(F.col("text"))).alias("term")).groupBy("tid", "license", "term").agg(F.count(F.lit(1)).alias("tf"))
    idf = F.log((F.col("total") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    weight = (F.col("tf") * idf).alias("w")
    mine = tf.join(df, "term").join(F.broadcast(count)).select("bid", "term", weight)
    mine = stored(mine, "weights")
    yours = stored(ours.join(df, "term", "left").join(F.broadcast(count)).select("tid", "license", "term", weight), "templates")
    n1 = mine.groupBy("bid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n1"))
    n2 = yours.groupBy("tid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n2"))
    # the templates are TEMPLATES, a fixed few hundred terms
    near = (
        mine.join(F.broadcast(yours.withColumnRenamed("w", "v").join(n2, "tid")), "term")
        .groupBy("bid", "tid", "license", "n2").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
        .join(n1, "bid").select("bid", "license", F.round(F.col("dot") / F.col("n1") / F.col("n2"), 6).alias("score"))
    )
    top = near.groupBy("bid").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("license"))).alias("m"))
    return top.select("bid", "m.license", (-F.col("m.s")).alias("score")).where(F.col("score") >= THRESHOLD)


def best_of_all(blocks: DataFrame, given: tuple[tuple[str, str], ...]) -> tuple[DataFrame, DataFrame]:
    """((path, __t, bid) of blocks(path, __t, block) that may match, (bid, license, score) of those
    that do), as the module's text says; no block that reaches the threshold is missed."""
    spark = blocks.sparkSession
    token = re.compile(TOKEN.replace(r"\p{L}\p{N}", r"^\W_"))
    ours = [(k, name, Counter(token.findall(text.lower()))) for k, (name, text) in enumerate(given)]
    vocabulary = sorted({t for _, _, tf in ours for t in tf})
    known = lambda x: x.isin(vocabulary)  # noqa: E731  the templates' terms, a few hundred
    split = blocks.withColumn("t", terms(F.col("block")))

    # counts over all blocks that share a term; '' counts the blocks themselves
    hit = F.array_distinct(F.filter("t", known))
    counts = split.select(hit.alias("hit")).where(F.size("hit") > 0).select(F.explode(F.concat("hit", F.array(F.lit("")))).alias("term"))
    df = {r.term: r.n for r in counts.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a term of the templates
    total = df.get("", 0)
    idf = {t: math.log((total + 1) / (df.get(t, 0) + 1)) + 1 for t in vocabulary}
    weighed, probes = [], set()
    for k, name, tf in ours:
        w = {t: n * idf[t] for t, n in tf.items()}
        length = sum(x * x for x in w.values())
        rest = length
        for t, x in sorted(w.items(), key=lambda i: (-i[1], i[0])):
            if rest < THRESHOLD**2 * length * (1 - 1e-9):
                break
            probes.add(t)
            rest -= x * x
        weighed += [(k, name, t, x, math.sqrt(length)) for t, x in w.items()]
    yours = spark.createDataFrame(weighed, "tid int, license string, term string, v double, n2 double")
    theirs = spark.createDataFrame([(t, x) for t, x in idf.items()], "term string, idf double")

    # the first bound: a block has one of the probing terms
    probing = sorted(probes)
    found = split.where(F.exists("t", lambda x: x.isin(probing))).select("path", "__t", F.md5("block").alias("bid"), "block")
    found = stored(found, "probed")
    distinct = stored(found.select("bid", "block").distinct().select("bid", terms(F.col("block")).alias("t")), "blocks")
    # the second: known terms in full, the others by their count
    some = distinct.select("bid", F.size("t").alias("size"), F.explode(F.filter("t", known)).alias("term"))
    some = some.groupBy("bid", "size", "term").agg(F.count(F.lit(1)).alias("tf")).join(F.broadcast(theirs), "term").withColumn("w", F.col("tf") * F.col("idf"))
    least = some.groupBy("bid", "size").agg(F.sum(F.col("w") * F.col("w")).alias("own"), F.sum("tf").alias("n"))
    dots = some.join(F.broadcast(yours), "term").groupBy("bid", "tid", "n2").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    near = dots.join(least, "bid").where(F.col("dot") >= (THRESHOLD - 1e-6) * F.col("n2") * F.sqrt(F.col("own") + F.col("size") - F.col("n")))
    near = stored(near.select("bid").distinct(), "near")

    # what is left, in full: counts of its other terms over all blocks
    left = distinct.join(if_small(near), "bid", "left_semi").select("bid", F.explode("t").alias("term")).groupBy("bid", "term").agg(F.count(F.lit(1)).alias("tf"))
    left = stored(left, "terms")
    others = stored(left.join(F.broadcast(theirs.select("term")), "term", "left_anti").select("term").distinct(), "other-terms")
    names = [r.term for r in others.limit(MOST_TERMS + 1).collect()]
    met = split.where(F.exists("t", known))
    if len(names) <= MOST_TERMS:
        seen = met.select(F.explode(F.array_distinct(F.filter("t", lambda x: x.isin(names)))).alias("term"))
    else:
        seen = met.select(F.explode(F.array_distinct("t")).alias("term")).join(if_small(others), "term", "left_semi")
    seen = seen.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", (F.log((F.lit(float(total)) + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    mine = stored(left.join(theirs.unionByName(seen), "term").select("bid", "term", (F.col("tf") * F.col("idf")).alias("w")), "weights")
    n1 = mine.groupBy("bid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n1"))
    score = (
        mine.join(F.broadcast(yours), "term").groupBy("bid", "tid", "license", "n2").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
        .join(n1, "bid").select("bid", "license", F.round(F.col("dot") / F.col("n1") / F.col("n2"), 6).alias("score"))
    )
    top = score.groupBy("bid").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("license"))).alias("m"))
    best = top.select("bid", "m.license", (-F.col("m.s")).alias("score")).where(F.col("score") >= THRESHOLD)
    return found.select("path", "__t", "bid"), stored(best, "licences")


def scan(files: DataFrame, *, whole: bool = False) -> DataFrame:
    """The rows of files (path, text, any others) with license, origin and score.

    origin is 'file' where the file's own text matches, 'inherited' where a licence file in
    the nearest ancestor directory does, else 'none' with null license and a score of 0.
    Null paths inherit nothing; null and empty texts match nothing; of several licence
    files in a directory the best score wins, then the lesser name; of equal scores of one
    file the lesser name.  Columns named like the added ones are replaced; repeated rows
    stay; an empty table gives an empty result.
    Blocks are those with MARKERS, counted once each, against TEMPLATES; if ``whole``, all that
    share a term with any of ALL_TEMPLATES, counted in each file, against those.
    """
    names = [c for c in files.columns if c not in ("license", "origin", "score")]
    text = F.coalesce(F.col("text"), F.lit(""))
    blocks = F.array_distinct(F.transform(F.concat(F.split(text, "\n"), F.split(text, r"\n[ \t]*\n")), lambda b: F.trim(b)))
    if not whole:
        blocks = F.when(text.rlike(MARKERS), F.filter(blocks, lambda b: b.rlike(MARKERS))).otherwise(F.array().cast("array<string>"))
    file_of = [F.col("path"), F.xxhash64("text").alias("__t")]
    base = files.select(
        *names,
        F.xxhash64("text").alias("__t"),
        F.regexp_extract("path", r"([^/]*)$", 1).alias("__name"),
        F.when(F.col("path").contains("/"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).when(F.col("path").isNotNull(), F.lit("")).alias("__dir"),
    )
    named = files.select(*file_of, F.explode(blocks).alias("block"))
    if whole:
        candidates, best = best_of_all(named, ALL_TEMPLATES)
    else:
        candidates = named.select("path", "__t", F.md5("block").alias("bid"))
        best = stored(best_licenses(stored(named.select(F.md5("block").alias("bid"), "block").distinct(), "blocks")), "licences")
    # few distinct blocks match; each file keeps its best
    own = candidates.join(if_small(best), "bid").groupBy("path", "__t").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("license"))).alias("m"))
    own = stored(own.select(F.col("path").alias("__p"), F.col("__t").alias("__h"), "m.license", (-F.col("m.s")).alias("score")), "own")
    matched = base.join(if_small(own), base["path"].eqNullSafe(F.col("__p")) & (base["__t"] == F.col("__h")), "left").drop("__p", "__h", "__t")
    given = own.join(base.where(F.col("__name").rlike(LICENSE_FILE)).select(F.col("path").alias("__p"), "__dir").distinct(), "__p")
    granted = stored(given.groupBy("__dir").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("license"))).alias("g")), "granted")
    # each directory with its ancestors, itself first; a file meets only its own directory
    steps = F.split("__dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    dirs = base.where(F.col("__dir").isNotNull()).select("__dir").distinct()
    chain = dirs.select(F.col("__dir").alias("at"), F.explode(F.array_distinct(up)).alias("__dir"))
    nearest = (
        chain.join(if_small(granted), "__dir").groupBy("at")
        .agg(F.max_by(F.struct(F.col("g.license").alias("l"), (-F.col("g.s")).alias("s")), F.length("__dir")).alias("n"))
    )
    nearest = stored(nearest.select("at", F.col("n.l").alias("__l"), F.col("n.s").alias("__s")), "nearest")
    return matched.join(if_small(nearest), F.col("__dir") == F.col("at"), "left").select(
        *names,
        F.coalesce("license", "__l").alias("license"),
        F.when(F.col("license").isNotNull(), "file").when(F.col("__l").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.coalesce("score", "__s", F.lit(0.0)).alias("score"),
    )


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: one folder a source, folders of 1000 and of 50 ids;
    the ids divisible by these are the folders' licence files."""
    top = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 1000).cast("string"))
    sub = F.concat_ws("/", top, F.floor(F.col("doc_id") / 50).cast("string"))
    path = (
        F.when(F.col("doc_id") % 1000 == 0, F.concat(top, F.lit("/LICENSE")))
        .when(F.col("doc_id") % 50 == 0, F.concat(sub, F.lit("/LICENSE")))
        .otherwise(F.concat(sub, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    )
    return docs.select("doc_id", "text", path.alias("path"))


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    """Every document's licence, from all its lines and paragraphs and all templates; see ``scan``."""
    return scan(as_files(table(spark, sf_dir, "documents")), whole=True).select("doc_id", "path", "license", "origin", "score")


def _sql() -> str:
    values = ", ".join("({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(ALL_TEMPLATES))
    terms_of = f"regexp_extract_all(lower(block), '{TOKEN}')"
    # each file's blocks that share a term with a template, counted in each file
    blocks = rf"""b AS (SELECT DISTINCT doc_id, trim(unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\n[ \t]*\n'))), ' ') AS block FROM f),
voc AS (SELECT list(DISTINCT term) AS v FROM (SELECT unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM (VALUES {values}) v(tid, license, text))),
c AS (SELECT doc_id, block FROM b, voc WHERE list_has_any({terms_of}, v)),
total AS (SELECT count(*) AS total FROM c),
d AS (SELECT block, count(*) AS files FROM c GROUP BY block),"""
    return rf"""
WITH f AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN doc_id % 1000 = 0 THEN coalesce(source, 'none') || '/' || (doc_id // 1000)
    WHEN doc_id % 50 = 0 THEN coalesce(source, 'none') || '/' || (doc_id // 1000) || '/' || (doc_id // 50)
    ELSE coalesce(source, 'none') || '/' || (doc_id // 1000) || '/' || (doc_id // 50) END AS dir,
    CASE WHEN doc_id % 50 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END AS name FROM documents),
{blocks}
tf AS (SELECT block, any_value(files) AS files, term, count(*) AS tf FROM (SELECT block, files, unnest({terms_of}) AS term FROM d) GROUP BY block, term),
df AS (SELECT term, sum(files) AS df FROM tf GROUP BY term),
t AS (SELECT tid, license, term, count(*) AS tf FROM (SELECT tid, license, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM (VALUES {values}) v(tid, license, text)) GROUP BY ALL),
w AS (SELECT block, term, tf * (ln((total + 1)::DOUBLE / (df + 1)) + 1) AS w FROM tf JOIN df USING (term), total),
v AS (SELECT tid, license, t.term, tf * (ln((total + 1)::DOUBLE / (coalesce(df, 0) + 1)) + 1) AS v FROM t LEFT JOIN df ON df.term = t.term, total),
n1 AS (SELECT block, sqrt(sum(w * w)) AS n1 FROM w GROUP BY block),
n2 AS (SELECT tid, sqrt(sum(v * v)) AS n2 FROM v GROUP BY tid),
s AS (SELECT block, license, round(dot / n1 / n2, 6) AS score FROM (SELECT block, tid, license, sum(w * v) AS dot FROM w JOIN v USING (term) GROUP BY ALL) JOIN n1 USING (block) JOIN n2 USING (tid)),
m AS (SELECT block, license, score FROM s QUALIFY row_number() OVER (PARTITION BY block ORDER BY score DESC, license) = 1),
o AS (SELECT doc_id, license, score FROM c JOIN m USING (block) WHERE score >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) = 1),
g AS (SELECT dir, license, score FROM o JOIN f USING (doc_id) WHERE name = 'LICENSE' QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) = 1),
i AS (SELECT f.doc_id, g.license, g.score FROM f JOIN g ON starts_with(f.dir || '/', g.dir || '/') QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY length(g.dir) DESC) = 1)
SELECT f.doc_id, f.dir || '/' || f.name AS path, coalesce(o.license, i.license) AS license,
  CASE WHEN o.license IS NOT NULL THEN 'file' WHEN i.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, coalesce(o.score, i.score, 0.0)::DOUBLE AS score
FROM f LEFT JOIN o ON o.doc_id = f.doc_id LEFT JOIN i ON i.doc_id = f.doc_id
"""


OP5_SQL = _sql()
