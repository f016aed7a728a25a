"""Scorers, language identification and tokens, on small texts."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import bpe, langid, quality, toxicity

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
GOOD = "the house on the hill was quiet and the rain fell softly over the garden path while people walked home".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, "   \n"), (4, "plain words here"), (4, "plain words here"), (5, "x" * 70_000), (None, "no id")]


def sentence(r, n=40):
    return " ".join(r.choice(GOOD) for _ in range(n))


def odd_docs(spark):
    return spark.createDataFrame([(k, t, None, None, 0) for k, t in ODD], SCHEMA).withColumn("score", F.lit("clash"))


def labelled(spark, bad, n=160, label="quality", bad_value=0):
    r = random.Random(5)
    rows, marks = [], []
    for k in range(n):
        wrong = k % 3 == 0
        rows.append((k, bad(r) if wrong else sentence(r), "en", "s", 0))
        marks.append((k, bad_value if wrong else 1 - bad_value))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, f"doc_id long, {label} int")


def crc_class(k, n):
    import zlib

    return zlib.crc32(str(k).encode()) % n


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark, lambda r: " ".join(w.upper() + "!!" for w in sentence(r).split()))
    model = quality.fit(docs, labels)
    found = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = [k for k in found if crc_class(k, 4) == 2]
    assert held and all((found[k] >= 0.7) == (k % 3 != 0) for k in held)
    odd = quality.score(odd_docs(spark), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.fit(docs.limit(0), labels.limit(0)).weights


def test_quality_reads_whole_text():
    model = quality.train([(sentence(random.Random(k)), 1) for k in range(40)] + [(sentence(random.Random(k)).upper(), 0) for k in range(40)])
    parts = quality.chunks_of("ab" * 50_000)
    assert b"".join(parts) == b"ab" * 50_000
    plain = quality.Compressors(model.good, model.bad)
    clean, mixed = sentence(random.Random(1), 3000), sentence(random.Random(1), 2000) + sentence(random.Random(2), 1000).upper()
    assert plain.features(clean)[1] > plain.features(mixed)[1]


def brute_kernel(s, t, p, lam):
    from itertools import combinations

    total = 0.0
    for a in combinations(range(len(s)), p):
        for b in combinations(range(len(t)), p):
            if all(s[i] == t[j] for i, j in zip(a, b)):
                total += lam ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


@pytest.mark.parametrize("s, t", [("idiot", "idiot"), ("ixdiot", "idiot"), ("banana", "ananas"), ("abc", "xyz")])
def test_subsequence_kernel_against_brute_force(s, t):
    got = toxicity.subsequence_kernel(toxicity.codes([s], len(s) + 2), toxicity.codes([t], len(t))[0])[0]
    assert abs(got - brute_kernel(s, t, toxicity.PARTS, toxicity.LAMBDA)) < 1e-5


def test_toxicity_tolerates_gaps(spark):
    insults = ["numskull", "dimwit", "blockhead"]

    def bad(r):
        words = sentence(r).split()
        words[r.randrange(len(words))] = r.choice(insults)
        return " ".join(words)

    docs, labels = labelled(spark, bad, 240, "toxic", 1)
    model = toxicity.fit(docs, labels)
    found = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [k for k in found if crc_class(k, 5) == 0]
    assert held and np.mean([(found[k] >= 0.5) == (k % 3 == 0) for k in held]) > 0.95
    scorer = toxicity.Scorer(model)
    texts = ["the rain fell", "you numskull", "you numsxkull", "you d i m w i t", "you block-head", "n" * 9000 + "dimwit", None, ""]
    got = scorer(texts)
    assert (got[1:6] >= 0.5).all() and (got[[0, 6, 7]] < 0.5).all()
    odd = toxicity.score(odd_docs(spark), model).collect()
    assert len(odd) == len(ODD) and all(r.score < 0.5 for r in odd)
    empty = toxicity.fit(docs.limit(0), labels.limit(0))
    assert toxicity.score(docs.limit(0), empty).count() == 0


def test_toxicity_learns_rare_insults():
    """Insults in few toxic sentences, one of them quoted in a clean one, beside a long coincidence."""
    r = random.Random(8)
    rare = {"scoundrel": 6, "nitwit": 3, "ratbag": 1}
    left = [w for w, n in rare.items() for _ in range(n)]
    rows = []
    for k in range(300):
        insult = left.pop() if left else "numskull"
        rows.append((f"{sentence(r)} {insult} {'wintergarden' if k % 60 == 7 else ''} {sentence(r)}", 1))
    rows += [(sentence(r) + " " + sentence(r), 0) for _ in range(299)] + [("they quoted the word scoundrel here", 0)]
    scorer = toxicity.Scorer(toxicity.train(rows))
    assert (scorer([f"you {w} of yours" for w in ("numskull", "scoundrel", "nitwit", "ratbag")]) >= 0.5).all()
    assert (scorer([sentence(r) for _ in range(200)]) < 0.5).mean() > 0.99


def language_rows(n=120):
    r = random.Random(3)
    sets = {"aa": "abcdemno", "bb": "rstuvwxy", "cc": "éèàçabcr"}
    return [(" ".join("".join(r.choice(s) for _ in range(r.randint(2, 7))) for _ in range(30)), k) for k, s in sets.items() for _ in range(n // 3)]


def test_gradients_through_time():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in langid.start_params(3, rng).items()}
    ids, y = rng.integers(0, 256, (5, 4)), np.array([0, 1, 2, 1])
    _, grads = langid.loss_and_grads(p, ids, y)
    for k in p:
        at = np.unravel_index(np.abs(grads[k]).argmax(), p[k].shape)
        ends = []
        for step in (1e-3, -1e-3):
            q = {a: b.copy() for a, b in p.items()}
            q[k][at] += step
            ends.append(langid.loss_and_grads(q, ids, y)[0])
        assert abs(grads[k][at] - (ends[0] - ends[1]) / 2e-3) < 1e-4


def test_language(spark):
    rows = language_rows()
    model = langid.train(rows[::2], steps=120)
    got = langid.predict(model, [t for t, _ in rows[1::2]])
    assert np.mean([g[0] == k for g, (_, k) in zip(got, rows[1::2])]) > 0.95
    docs = odd_docs(spark)
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    assert found[1] == found[2] == found[3] == ("und", 1.0) and found[4][0] in model.langs and found[5][0] in model.langs
    assert langid.identify(docs, model).columns == ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "score"]
    assert langid.predict(model, ["123 %%"]) == [("und", 1.0)]
    one = langid.train([("abc", "aa"), (None, "bb"), ("123", "bb")])
    assert langid.predict(one, ["abc", None]) == [("aa", 1.0), ("und", 1.0)]
    assert langid.predict(langid.fit(docs.limit(0)), ["abc"]) == [("und", 1.0)]


def test_segments_hold_every_byte():
    data = bytes(range(256)) * 5
    rows = langid.segments_of(data, 96)
    flat = rows.ravel()
    assert bytes(flat[flat < 256].astype(np.uint8)) == data


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(open(VOCABULARY, encoding="utf-8").read())


def test_bpe_equals_the_library(encoder):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    r = random.Random(1)
    texts = ["Hello World's IT'S  ça Σ'SΣ ΟΔΟΣ İstanbul", "<|startoftext|>a b<|endoftext|>", "x123 45 ½", "\0a\xa0b​c", "日本語 é 힣", "ǅ ß ﬁ", "", "a" * 400, "!!!!??.."]
    texts += ["".join(r.choice("abcdeéßхл’日 '\n01!?😀ſ") for _ in range(r.randint(1, 60))) for _ in range(400)]
    texts += ["".join(r.choice("aehinorst") for _ in range(r.randint(1, 14))) for _ in range(2000)]
    for text, (n, ids, decoded) in zip(texts, encoder.encode(texts)):
        want = library.encode(text, add_special_tokens=False)
        assert ids == " ".join(map(str, want.ids)) and n == len(want.ids)
        assert decoded == library.decode(want.ids, skip_special_tokens=False)


def test_bpe_frames(spark):
    docs = odd_docs(spark).withColumn("ids", F.lit("clash"))
    found = {r.doc_id: r for r in bpe.encode(docs, VOCABULARY).collect()}
    assert found[1].n_tokens == found[2].n_tokens == found[3].n_tokens == 0 and found[1].decoded == ""
    assert len(found[4].ids) == found[4].n_tokens == 3 and found[5].n_tokens > 1000
    assert bpe.encode(docs, VOCABULARY, ("n_tokens",)).count() == len(ODD)
    assert bpe.encode(docs.limit(0), VOCABULARY).count() == 0


@pytest.mark.parametrize("name, modulus, remainder, label, least", [("op1_quality", 4, 2, "quality", 0.9), ("op10_toxicity", 5, 0, "toxic", 0.85), ("op2_language", 5, 0, "lang", 0.9)])
def test_whole_queries_on_held_out_rows(spark, name, modulus, remainder, label, least):
    """Every document once, held-out rows by the contract's rule, and their accuracy."""
    import os

    from weftgraph.llm import queries

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").collect()}
    found = queries.QUERIES[name](spark, folder).collect()
    assert sorted(r.doc_id for r in found) == sorted(docs)
    assert all(r.held_out == (crc_class(r.doc_id, modulus) == remainder) and 0 <= r.score <= 1 for r in found)
    if label == "lang":
        truth = {k: r.lang for k, r in docs.items() if r.lang is not None and r.text and any(c.isalpha() for c in r.text)}
        right = [r.lang_pred == truth[r.doc_id] for r in found if r.held_out and r.doc_id in truth]
    else:
        truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r[label] is not None}
        right = [r.predicted == truth[r.doc_id] for r in found if r.held_out and r.doc_id in truth]
        assert all(r.predicted == int(r.score >= (0.7 if name == "op1_quality" else 0.5)) for r in found)
    assert len(right) > 10 and np.mean(right) >= least


def test_language_learns_languages_of_one_row(spark):
    rows = language_rows() + [("ддд жжж ллл ббб " * 40, "zz")]
    model = langid.train(rows, steps=200)
    assert model.langs == ("aa", "bb", "cc", "zz")
    assert langid.predict(model, ["ллл ддд жжж " * 20])[0][0] == "zz"


def test_bpe_long_words_take_linear_time(encoder):
    import time

    began = time.perf_counter()
    for word in ("a" * 300_000, "ab" * 150_000, "".join(random.Random(3).choice("etaoinshrdlu") for _ in range(40_000))):
        n, ids, _ = next(encoder.encode([word]))
        assert n == ids.count(" ") + 1
    assert time.perf_counter() - began < 30
