"""The pipeline on a small corpus against plain Python for each decision."""

from __future__ import annotations

import hashlib
import random

import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def words(r, n, letters="abcdefghij"):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    texts = {k: words(r, 80) for k in range(40)}
    texts |= {k: words(r, 80, "rstuvwxyzé") for k in range(40, 80)}
    passage, item = words(r, 45), words(r, 20)
    texts[100], texts[101] = texts[0], texts[0].replace(texts[0].split()[40], "changedword", 1)  # copies
    texts[102], texts[103] = words(r, 60) + " " + passage, passage + " " + words(r, 60)  # a shared passage
    texts[104] = words(r, 100) + " " + item + " " + words(r, 50)  # a leak
    texts[105], texts[106], texts[107] = "12345 %%%", None, ""  # no language
    langs = {k: "aa" if k < 40 or k >= 100 else "bb" for k in texts}
    out = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(k, t, langs[k], "s", len(t or "")) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), texts, passage


def test_stages(spark, folder):
    path, texts, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, path)
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            docs = corpus_pipeline.stored(docs, name)
        seen.append({r.doc_id: r for r in docs.collect()})
    everything = set(texts)
    assert set(seen[0]) == everything - {105, 106, 107}
    assert set(seen[1]) == set(seen[0]) - {100, 101}
    assert set(seen[2]) == set(seen[1])
    assert seen[2][102].text == " ".join(texts[102].split()[:60]) and seen[2][103].text == " ".join(texts[103].split()[45:])
    assert seen[2][5].text == texts[5] and seen[2][102].n_chars == len(seen[2][102].text)
    assert set(seen[3]) == set(seen[2]) - {104}
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert set(seen[4]) == set(seen[3])
    for k, r in seen[4].items():
        want = library.encode(seen[3][k].text, add_special_tokens=False).ids
        assert list(r.ids) == want and r.n_tokens == len(want)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_emptied_documents_go(spark):
    text = " ".join(f"w{k}" for k in range(50))
    docs = spark.createDataFrame([(1, text, "aa", "s", 1), (2, text, "aa", "s", 1), (3, "other words", "aa", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()] == [3]


def test_leaks_are_decided_by_row(spark, tmp_path):
    item = " ".join(f"q{k}" for k in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    words = item.split()
    texts = [(None, "before " + item), (None, "a clean text of its own"), (None, " ".join(words[:12])), (None, " ".join(words[8:])), (5, item + " after"), (5, "another clean text"), (6, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.leaks(spark, docs, str(tmp_path)).collect()]
    assert sorted(kept, key=str) == sorted((texts[k] for k in (1, 2, 3, 5, 6)), key=str)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def bench(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("bench")
    spark.createDataFrame([(1, " ".join(f"q{k}" for k in range(20))), (2, "q1 q2")], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, bench, stage):
    assert stage(spark, spark.createDataFrame([], COLUMNS), bench).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_nulls_repeats_long_texts_and_clashing_columns(spark, bench, name, stage):
    r = random.Random(4)
    own = [words(r, 30) for _ in range(6)] + [words(r, 30, "rstuvwxyz") for _ in range(6)]
    rows = [(k, t, "aa" if k < 6 else "bb", None, None) for k, t in enumerate(own)]
    long = " ".join(f"z{k}y" for k in range(60_000))
    rows += [(None, "a text of its own without an id", "aa", None, 5), (None, None, None, None, None), (20, "", "aa", "s", 0), (21, long, "bb", "s", 1), rows[3], rows[3]]
    extra = "th long, did string, row string, class string, h int, n_words string, __row int, ids int, token string, score string"
    docs = spark.createDataFrame([(*x, 7, "d", "r", "c", 1, "w", 2, 3, "t", "s") for x in rows], f"{COLUMNS}, {extra}")
    found = stage(spark, docs, bench)
    got = found.collect()
    if name != "tokens":
        assert found.columns == list(corpus_pipeline.COLUMNS)
    kept = [x.doc_id for x in got]
    here = {
        "language": sorted([*range(12), 3, 3, 21]),  # null, empty and repeated texts: gone, gone, as often as they were
        "near_duplicates": sorted([*range(12), 20, 21]), "repeated_passages": sorted([*range(12), 3, 3, 20, 21]), "leaks": sorted([*range(12), 3, 3, 20, 21]), "tokens": sorted([*range(12), 3, 3, 20, 21]),
    }[name]
    assert sorted(x for x in kept if x is not None) == here
    assert kept.count(None) == (1 if name == "language" else 2)


def test_near_duplicates_decides_by_row(spark):
    r = random.Random(6)
    a, b = words(r, 60).split(), words(r, 60).split()
    near = [" ".join(["other", *w[1:]]) for w in (a, b)]
    rows = [(1, " ".join(a), "x"), (1, " ".join(b), "x"), (2, near[0], "x"), (3, near[1], "x"), (1, " ".join(a), "w")]
    docs = spark.createDataFrame([(k, t, "aa", s, 0) for k, t, s in rows], COLUMNS)
    kept = sorted((x.doc_id, x.text, x.source) for x in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert kept == sorted([(1, " ".join(a), "w"), (1, " ".join(b), "x")])
