"""Dedup, joins, leaks, licences, neighbours and extraction against brute force."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import ann, common, decontaminate, html_extract, jaccard_join, licenses, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, None, "s", 0) for k, t in rows], SCHEMA)


def vocabulary_text(r, n, size=5000):
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


def brute_dedup(texts):
    words = [substring_dedup.WORD.findall(t or "") for t in texts]
    seen = {}
    for d, w in enumerate(words):
        for p in range(len(w) - 34):
            seen.setdefault(tuple(w[p : p + 35]), []).append((d, p))
    gone = [set() for _ in words]
    for places in seen.values():
        if len(places) > 1:
            for d, p in places:
                gone[d].update(range(p, p + 35))
    return [(len(w), len(g), " ".join(x for k, x in enumerate(w) if k not in g)) for w, g in zip(words, gone)]


def test_substring_dedup_against_brute_force(spark):
    r = random.Random(7)
    shared, short = vocabulary_text(r, 60), vocabulary_text(r, 34)
    base = vocabulary_text(r, 300)
    near = base.split()
    near[120] = "changed"
    texts = [
        vocabulary_text(r, 50) + " " + shared + " " + vocabulary_text(r, 20), shared + "\n" + vocabulary_text(r, 90), vocabulary_text(r, 10) + "\t" + short, short + " tail",
        base, " ".join(near), base, "to " * 90, "a b " * 40 + vocabulary_text(r, 5), shared + " x " + shared, None, "", "few words", " ".join(shared.split()[5:39]), " ".join(shared.split()[3:38]),
        vocabulary_text(r, 4000) + " " + short, "é ü " * 50,
    ]
    docs = frame(spark, list(enumerate(texts))).withColumn("n_words", F.lit("clash"))
    found = {x.doc_id: (x.n_words, x.n_removed, x.kept_text) for x in substring_dedup.dedup(docs).collect()}
    assert [found[k] for k in range(len(texts))] == brute_dedup(texts)


def test_substring_dedup_edges(spark):
    text = " ".join(f"w{k}" for k in range(40))
    twice = frame(spark, [(1, text), (1, text), (None, text), (2, None)])
    found = sorted((x.doc_id or 0, x.n_words, x.n_removed) for x in substring_dedup.dedup(twice).collect())
    assert found == [(0, 40, 40), (1, 40, 40), (1, 40, 40), (2, 0, 0)]
    assert substring_dedup.dedup(twice.limit(0)).count() == 0


def test_window_hash_doubling():
    words = substring_dedup.Words([b"a b c d e f g h i j k l", b"c d e f g h"])
    for n in (1, 2, 3, 5, 9, 11):
        h = words.windows(n)
        assert len(h) == len(words.hash) - n + 1
    h = words.windows(5)
    assert h[2] == h[12] and h[3] == h[13] and h[2] != h[3]


def shingle_set(text):
    w = substring_dedup.WORD.findall(text or "")
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_join(texts):
    sets = [shingle_set(t) for t in texts]
    n = len(texts)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * n
    for a, b in combinations(range(n), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    copies = [min(k for k in range(n) if sets[k] == sets[d]) if sets[d] else d for d in range(n)]
    return [(find(k), copies[k], links[k]) for k in range(n)]


def test_jaccard_join_against_brute_force(spark):
    r = random.Random(3)
    texts = []
    for _ in range(12):
        base = vocabulary_text(r, r.randint(30, 200)).split()
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 12)):
            copy = list(base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = f"x{r.randrange(999)}"
            texts.append(" ".join(copy))
    texts += ["one two", "one two", "one", None, "", texts[0], texts[0] + " tail", "a a a a a a a a"]
    found = {x.doc_id: (x.class_id, x.copy_id, x.n_links) for x in jaccard_join.join(frame(spark, list(enumerate(texts)))).collect()}
    assert [found[k] for k in range(len(texts))] == brute_join(texts)


def test_jaccard_join_blocks_and_repeats(spark, monkeypatch):
    base = [f"w{k}" for k in range(80)]
    texts = []
    for k in range(40):
        copy = list(base)
        copy[k] = f"x{k}"
        texts.append(" ".join(copy))
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", 8)
    rows = list(enumerate(texts))
    found = {x.doc_id: (x.class_id, x.copy_id, x.n_links) for x in jaccard_join.join(frame(spark, rows)).collect()}
    assert [found[k] for k in range(40)] == brute_join(texts)
    again = jaccard_join.join(frame(spark, [*rows[:3], rows[0], (None, texts[0])])).collect()
    assert sorted((x.doc_id, x.n_links) for x in again if x.doc_id is not None) == [(0, 3), (0, 3), (1, 3), (2, 3)]
    assert [x.n_links for x in again if x.doc_id is None] == [0]
    assert jaccard_join.join(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("block", [1024, 2])
def test_jaccard_join_keeps_chains(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", block)
    words = [f"w{k}" for k in range(200)]
    places = {1: 0, 3: 1, 4: 2, 2: 3, 15: 4, 6: 5, 14: 6, 5: 7}  # each text links to the next one only
    rows = [(k, " ".join(words[10 * at : 10 * at + 104])) for k, at in places.items()]
    found = {x.doc_id: (x.class_id, x.n_links) for x in jaccard_join.join(frame(spark, rows)).collect()}
    assert found == {k: (1, 1 if at in (0, 7) else 2) for k, at in places.items()}


def test_banding_reaches_its_recall():
    bands, rows = jaccard_join.banding(0.8, 0.999, 4)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 > 1 - (1 - 0.8**rows) ** (bands - 1)


def test_decontamination_against_brute_force(spark):
    r = random.Random(1)
    items = [vocabulary_text(r, n) for n in (6, 9, 20, 40, 200)] + ["too short", None, vocabulary_text(r, 12)]
    part = items[2].split()
    part[0] = "zzz"
    worse = items[2].split()
    for k in (3, 9, 15):
        worse[k] = "zzz"
    texts = [vocabulary_text(r, 800) + " " + items[0] + ". " + vocabulary_text(r, 100), items[3].upper(), " ".join(part), " ".join(worse), vocabulary_text(r, 50), None, "", items[4], items[0] + " / " + items[1], "too short"]
    docs = frame(spark, list(enumerate(texts)) + [(0, texts[0])])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("doc_id", F.lit(1))

    def sets(t):
        w = [x for x in __import__("re").findall(r"[^\W_]+", (t or "").lower())]
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    want = sorted((d, i, len(sets(t) & sets(x)), len(sets(x))) for d, t in enumerate(texts) for i, x in enumerate(items) if sets(x) and len(sets(t) & sets(x)) >= 0.8 * len(sets(x)) - 1e-9)
    assert sorted(tuple(x) for x in decontaminate.contained(docs, bench).collect()) == want and len(want) >= 5
    assert decontaminate.contained(docs.limit(0), bench).count() == 0 and decontaminate.contained(docs, bench.limit(0)).count() == 0


def test_decontamination_keeps_short_items_and_null_ids(spark):
    bench = spark.createDataFrame([(1, "Open sesame!"), (2, "yes"), (None, "one two three four five six")], "item_id long, text string")
    docs = frame(spark, [(1, "he said open, sesame and left"), (2, "open the sesame"), (None, "zero one two three four five six seven"), (3, None), (4, "yes"), (4, "no")])
    found = sorted((tuple(r) for r in decontaminate.contained(docs, bench, least_words=1).collect()), key=str)
    assert found == sorted([(1, 1, 1, 1), (None, None, 2, 2), (4, 2, 1, 1)], key=str)
    assert [tuple(r) for r in decontaminate.contained(docs, bench).collect()] == [(None, None, 2, 2)]


def test_decontamination_stores_only_frames_that_cost_a_join_or_a_group(spark, monkeypatch):
    labels = []
    monkeypatch.setattr(decontaminate, "stored", lambda df, label: labels.append(label) or common.stored(df, label))
    bench = spark.createDataFrame([(1, "one two three four five six"), (2, "six five four three two one")], "item_id long, text string")
    docs = frame(spark, [(1, "zero one two three four five six seven"), (2, "one two three four"), (3, None)])
    assert [tuple(r) for r in decontaminate.contained(docs, bench).collect()] == [(1, 1, 2, 2)]
    assert labels == ["items", "sketches", "candidates", "wanted"]


def test_sketch_sizes_hold_their_recall():
    from math import comb

    for n in (*range(1, 80), 200, 1000):
        k = decontaminate.sketch_size(n, 0.8, 0.99999)
        absent = n - -(-8 * n // 10)
        assert comb(absent, k) / comb(n, k) <= 1.1e-5 and (k == 1 or comb(absent, k - 1) / comb(n, k - 1) > 0.9e-5)


def test_licences(spark):
    files = [
        ("a/LICENSE", "Released under the MIT License."), ("a/x.txt", "nothing here"), ("a/b/y.txt", "code\nLicensed under the Apache License, Version 2.0.\nmore"),
        ("a/b/c/z.txt", None), ("a/b/LICENSE", "no licence text at all, just a note"), ("q/z.txt", ""), (None, "Licensed under CC BY-NC 4.0."), ("top.txt", "x"),
        ("d/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("d/e/f/g.txt", "words " * 20_000), ("a/x.txt", "nothing here"),
    ]
    df = spark.createDataFrame(files, "path string, text string").withColumn("score", F.lit("clash"))
    found = sorted(((x.path, x.license, x.origin) for x in licenses.scan(df).collect()), key=str)
    want = [
        ("a/LICENSE", "MIT", "file"), ("a/x.txt", "MIT", "inherited"), ("a/x.txt", "MIT", "inherited"), ("a/b/y.txt", "Apache-2.0", "file"), ("a/b/c/z.txt", "MIT", "inherited"), ("a/b/LICENSE", "MIT", "inherited"),
        ("q/z.txt", None, "none"), (None, "CC-BY-NC-4.0", "file"), ("top.txt", None, "none"), ("d/COPYING", "GPL-3.0", "file"), ("d/e/f/g.txt", "GPL-3.0", "inherited"),
    ]
    assert found == sorted(want, key=str)
    assert licenses.scan(df.limit(0)).count() == 0


def test_licences_without_gate(spark):
    lines = {
        "Available under CC BY 4.0.": "CC-BY-4.0", "Text: CC BY-SA 4.0": "CC-BY-SA-4.0", "GPLv3": "GPL-3.0", "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
        "// SPDX-License-Identifier: MIT": "MIT", "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\nPreamble": "GPL-3.0",
        "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS": "Apache-2.0", "the rain fell on the town": None, "Released under the MIT License.": "MIT",
    }
    rows = [(f"f{k}/x.txt", f"some words before\n\n{text}") for k, text in enumerate(lines)] + [(f"g{k}/x.txt", f"the story of day {k} available in the town by the sea") for k in range(40)]
    found = {x.path: x.license for x in licenses.scan(spark.createDataFrame(rows, "path string, text string"), whole=True).collect()}
    assert [found[f"f{k}/x.txt"] for k in range(len(lines))] == list(lines.values())
    assert all(found[f"g{k}/x.txt"] is None for k in range(40))


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16))
    rows = [(k, [float(v) for v in x[k]]) for k in range(600)]
    rows += [(600 + k, [float(v) for v in x[3]]) for k in range(30)]  # a hot vector
    rows += [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [None] * 16), (704, [1.0]), (705, [float("inf")] * 16), (3, rows[3][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>"), {k: np.array(v) for k, v in rows if v and len(v) == 16 and v[0] is not None and np.isfinite(v).all() and any(v)}


def test_neighbours_recall_and_order(vectors):
    df, x = vectors
    ids = np.array(sorted(x))
    m = np.stack([x[k] for k in ids])
    found = {}
    for r in ann.search(df, df.where(F.col("vec_id") % 50 == 0)).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hit = total = 0
    for q in [k for k in ids if k % 50 == 0]:
        d = np.sqrt(((m - x[q]) ** 2).sum(1))
        order = [k for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        got = [found[q][n] for n in range(1, 11)]
        assert [s for _, s in got] == sorted(s for _, s in got)
        assert all(abs(s - np.sqrt(((x[k] - x[q]) ** 2).sum())) < 1e-12 for k, s in got)
        hit += len({k for k, _ in got} & set(ids[order]))
        total += 10
    assert hit / total >= 0.9 and set(found) == {k for k in ids if k % 50 == 0}
    hot = found[600]
    assert [hot[n][0] for n in range(1, 11)] == [3, *range(601, 610)]


def test_neighbours_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    found = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(df, df.where("vec_id = 0")).collect())
    assert found == [(0, 1, 2), (0, 2, 1)] and ann.search(df.limit(0), df).count() == 0


def test_probing_is_exact_within_the_radius():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 256, (500, 4), dtype=np.uint8)
    for q, rows in ann.within(codes, codes[:5], 9):
        assert set(rows) == set(np.flatnonzero(ann.POPCOUNT[codes ^ codes[q]].sum(1) <= 9))


PAGE = """<html><body><header class=site><h1>Site</h1></header><div id="cookie-notice">Accept</div><div class="wrap post-{k}"><div class="sidebar">side <p>x</p></div>
<div class="entry-content"><p>First &amp; <b>bold</b> para&nbsp;{k} here is long enough.<p>Second one, with <a href=x>link</a><br>and more {k}.<ul><li>one<li>two</ul><form><input>Search</form>
<script>if(a<b)x("</p>")</script><div class="ad">Buy</div></div><section class="comments"><p>Nice post</p></section></div><footer>c</footer></body></html>"""


def test_extraction_by_host_consensus(spark):
    rows = [(k, f"https://h.example/{k}", PAGE.format(k=k)) for k in range(6)]
    # alone, this page's choice would be its largest box; the host's path decides
    odd = '<html><body><div class="entry-content"><p>Short.</p></div><div class="box">' + "<p>filler text of a box</p>" * 9 + "</div></body></html>"
    rows += [(6, "https://h.example/odd", odd.replace("<body>", '<body><div class="wrap post-9">').replace("</body>", "</div></body>")), (7, None, None), (8, "https://x.example/", ""), (9, "bad url", "plain &lt;text&gt;"), (0, "https://h.example/0", PAGE.format(k=0))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    found = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    for k in range(6):
        assert found[k] == f"First & bold para {k} here is long enough.\nSecond one, with link and more {k}.\none\ntwo"
    assert found[6] == "Short." and found[7] == "" and found[8] == "" and found[9] == "plain <text>"
    assert html_extract.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("html, text", [("", ""), ("<p>a", "a"), ("<div><p>a</div>b<", "a\nb<"), ("<<>>& &amp", "<<>>& &"), ("<p>x</P><!-- c --><style>q</style>", "x"), ("<b>" * 3000 + "deep", "deep"), ("<div>" * 3000 + "deep", "deep")])
def test_broken_markup(html, text):
    page = html_extract.Page(html)
    assert page.extract(page.choice()[0]) == text


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


@pytest.mark.parametrize("letters", [8, 128, 2048])
def test_words_alike_in_structure_are_told_apart(spark, letters):
    one = thue_morse(letters)
    other = one.translate(str.maketrans("ab", "ba"))
    start = " ".join(f"w{k}" for k in range(34))
    docs = frame(spark, [(1, f"{start} {one}"), (2, f"{start} {other}")])
    assert [x.n_removed for x in substring_dedup.dedup(docs).collect()] == [0, 0]
    assert sorted(x.n_links for x in jaccard_join.join(frame(spark, [(1, one), (2, other)])).collect()) == [0, 0]


def test_substring_dedup_keeps_clashing_columns(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, text, "x", 7, [1]), (2, text, None, None, None)], "doc_id long, text string, did string, th int, firsts array<int>")
    found = sorted(tuple(r) for r in substring_dedup.dedup(docs).collect())
    assert found == [(1, text, "x", 7, [1], 40, 40, ""), (2, text, None, None, None, 40, 40, "")]


def test_jaccard_join_judges_rows_of_one_id_apart(spark):
    r = random.Random(5)
    a, b = (vocabulary_text(r, 100).split() for _ in range(2))
    near_a, near_b = ["x", *a[1:]], ["y", *b[1:]]
    rows = [(1, a), (1, b), (2, near_a), (3, near_b)]
    found = [(x.doc_id, x.class_id, x.n_links) for x in jaccard_join.join(frame(spark, [(k, " ".join(w)) for k, w in rows])).collect()]
    assert sorted(found) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_jaccard_join_in_crowded_and_small_buckets(spark, monkeypatch):
    """Components of several blocks, with buckets on either side of the crowding bound."""
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", 4)
    monkeypatch.setattr(jaccard_join, "CROWDED", 6)
    r = random.Random(11)
    base = [f"w{k}" for k in range(90)]
    texts = []
    for k in range(30):
        copy = list(base)
        for _ in range(r.randint(0, 3)):
            copy[r.randrange(len(copy))] = f"x{r.randrange(999)}"
        texts.append(" ".join(copy))
    words = [f"v{k}" for k in range(400)]
    texts += [" ".join(words[9 * k : 9 * k + 104]) for k in range(20)]
    found = {x.doc_id: (x.class_id, x.copy_id, x.n_links) for x in jaccard_join.join(frame(spark, list(enumerate(texts)))).collect()}
    assert [found[k] for k in range(len(texts))] == brute_join(texts)


def main_text(html):
    page = html_extract.Page(html)
    return page.extract(page.choice()[0])


def test_html_leaves_out_what_is_hidden_or_advertised():
    body = "<p>First paragraph of the article with enough words.</p>"
    kept = "First paragraph of the article with enough words."
    wrap = "<html><body><article>{}</article></body></html>"
    for extra in (
        '<p>Second <span class="advert">buy <span>this</span> now</span>one.</p>', '<p>Second <b style="display: none">no</b>one.</p>', '<p>Second one.</p><div style="visibility:hidden"><p>no</p></div>',
        '<p>Second one.</p><div class="responses"><p>So true!</p></div>', '<p>Second one.</p><div class="share-buttons">Tell all</div>', "<p>Second one.</p><select><option>a<option>b</select>",
    ):
        assert main_text(wrap.format(body + extra)) == kept + "\nSecond one."
    assert main_text(wrap.format(body + '<section class="social-history"><p>Second one.</p></section>')) == kept + "\nSecond one."
    assert main_text(wrap.format(body + '<p>Second <span class="hljs-comment">one.</span></p>')) == kept + "\nSecond one."
    assert main_text(wrap.format(body + "<p>a<p>b<select><option>x<option>y<p>Second one.</p>")) == kept + "\na\nb\nSecond one."


def test_html_votes_out_boxes_that_recur_on_a_host(spark):
    r = random.Random(2)
    rows = []
    for k in range(30):
        own = " ".join(f"word{r.randrange(10**6)}" for _ in range(40))
        rows.append((k, "http://a.example/x", f"<html><body><article><h2>Summary</h2><p>{own}</p><div class='note-x'>The same on each page.</div><div class='extra'>{own[:50]}</div></article></body></html>"))
    rows += [(100 + k, "http://b.example/x", rows[0][2]) for k in range(30)]  # copies of one page aren't recurrence
    found = {x.page_id: x.text for x in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(30):
        own = rows[k][2].split("<p>")[1].split("</p>")[0]
        assert found[k] == f"Summary\n{own}\n{own[:50].strip()}"
    assert all("The same on each page." in found[100 + k] for k in range(30))


def test_html_ties_between_paths(spark):
    """As many votes and characters for either path: the lesser digest wins, on any partitioning."""
    one = "<html><body><div class='a'><p>Some text here.</p></div><div class='b'></div></body></html>"
    two = "<html><body><div class='b'><p>Some text here.</p></div><div class='a'></div></body></html>"
    pages = spark.createDataFrame([(1, "http://h/1", one), (2, "http://h/2", two)], "page_id long, url string, html string")
    first = sorted(tuple(r) for r in html_extract.extract(pages).select("page_id", "text").collect())
    assert first == sorted(tuple(r) for r in html_extract.extract(pages.orderBy(F.desc("page_id")).repartition(3)).select("page_id", "text").collect())


@pytest.mark.parametrize("piece", ["<!", "<!--", "<a b='", "<", "<p", "<?"])
def test_html_reads_hostile_markup_in_linear_time(piece):
    import time

    began = time.perf_counter()
    main_text(piece * 60_000)
    assert time.perf_counter() - began < 10


def test_probing_with_a_remainder_and_several_substrings():
    rng = np.random.default_rng(9)
    codes = rng.integers(0, 256, (400, 24), dtype=np.uint8)
    codes[200:] = codes[:200] ^ (rng.random((200, 24)) < 0.2)
    for radius in (0, 1, 2, 5, 40, 90):
        for q, rows in ann.within(codes, codes[:20], radius):
            assert set(rows) == set(np.flatnonzero(ann.POPCOUNT[codes ^ codes[q]].sum(1) <= radius))
    probed = np.mean([len(ann.Tables(codes).probed(c, 24)) for c in codes[:20]])
    assert probed < 40  # of 400: far fewer than all


def test_neighbours_of_repeated_ids_and_clashing_columns(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.0]), (1, [0.0, 5.0]), (2, [0.0, 1.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in rows], "vec_id long, embedding array<double>, code string, score int")
    found = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in ann.search(df, df.where("vec_id = 0")).collect())
    assert found == [(0, 1, 2, round(2**0.5, 6)), (0, 2, 1, round(26**0.5, 6))]


def test_substring_dedup_leaves_only_texts_and_spans_on_disk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    passage = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(k, " ".join(f"h{k}.{j}" for j in range(40)) + f" {passage} t{k}") for k in range(30)], "doc_id long, text string")
    found = substring_dedup.dedup(docs)
    assert sorted(p.name.replace("-", "_").split("_")[0] for p in tmp_path.iterdir()) == ["spans", "texts"]
    assert {r.n_removed for r in found.collect()} == {60}


def test_near_duplicates_leave_no_frames_of_the_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text), (2, text), (3, text + " more"), (4, "some other text of six words"), (5, None)], "doc_id long, text string")
    found = jaccard_join.join(docs)
    big = {"classes", "members", "representatives", "sets", "meetings", "links", "linked"}
    assert not big & {p.name.split("-")[0] for p in tmp_path.iterdir()}
    assert {(r.doc_id, r.class_id, r.n_links) for r in found.collect()} == {(1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 4, 0), (5, 5, 0)}
    common.dropped(*found.reads)
    assert not {"signatures", "about"} & {p.name.split("-")[0] for p in tmp_path.iterdir()}
