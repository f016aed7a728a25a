"""Compression classifier for text quality.

Two zstandard dictionaries are trained, one on chunks of good and one on chunks
of bad labelled texts.  Every chunk of a text is compressed with either; the
difference of the sizes, divided by the size without a dictionary, says which
of the two a text resembles.  A logistic calibration turns the differences
into a score between 0 and 1 (higher: good likelier).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_limits, crc_class, labelled_sample, table

CHUNK = 1500
LEVEL = 3
DICT_BYTES = 48_000
SAMPLE_PER_CLASS = 1500
SAMPLE_MAX_CHARS = 20_000


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float


def chunks_of(text: str | None) -> list[bytes]:
    """The whole text in pieces of CHUNK bytes; a short tail joins the piece before it."""
    data = (text or "").encode("utf-8", "replace")
    n = max(1, round(len(data) / CHUNK))
    cuts = [len(data) * k // n for k in range(n + 1)]
    return [data[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]


class Compressors:
    """Plain, good and bad compressors of one Python worker."""

    def __init__(self, good: bytes, bad: bytes):
        self.all = [zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)]
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.all.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def features(self, text: str | None) -> list[float]:
        """Normalised size difference over the whole text, at its worst chunk, and how
        far the text compresses by itself; an empty text has all 0."""
        pieces = chunks_of(text)
        if not pieces:
            return [0.0, 0.0, 0.0]
        plain, good, bad = (np.array([len(c.compress(p)) for p in pieces], float) for c in self.all)
        lengths = np.array([len(p) for p in pieces], float)
        diff = (bad - good) / plain
        return [(bad.sum() - good.sum()) / plain.sum(), float(diff.min()), plain.sum() / (lengths.sum() + 40.0)]


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 60) -> tuple[np.ndarray, float]:
    """Newton's method for a logistic regression with a small ridge; classes weigh alike."""
    a = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w = np.zeros(a.shape[1])
    ridge = l2 * np.eye(a.shape[1])
    ridge[-1, -1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (share * (p - y)) + ridge @ w
        hess = (a * (share * p * (1 - p))[:, None]).T @ a + ridge
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def train(rows: list[tuple[str, int]]) -> QualityModel:
    """Dictionaries from one half of the rows, the calibration from the other half,
    which the dictionaries haven't seen."""
    rows = sorted(rows)
    fit, rest = rows[0::2], rows[1::2]
    dicts = []
    for y in (1, 0):
        pieces = [p for t, label in fit if label == y for p in chunks_of(t)]
        raw = b"".join(pieces)
        try:
            dicts.append(zstandard.train_dictionary(DICT_BYTES, pieces, level=LEVEL).as_bytes())
        except zstandard.ZstdError:  # too few samples for the trainer: their bytes themselves are the dictionary
            dicts.append(raw[-DICT_BYTES:])
    model = Compressors(*dicts)
    use = rest if len({y for _, y in rest}) == 2 else rows
    x, y = np.array([model.features(t) for t, _ in use] or [[0.0] * 3]), np.array([v for _, v in use] or [1], float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    weights, bias = fit_logistic((x - mean) / scale, y) if len(set(y)) == 2 else (np.zeros(3), 0.0)
    return QualityModel(dicts[0], dicts[1], tuple(mean), tuple(scale), tuple(weights), bias)


def fit(docs: DataFrame, labels: DataFrame, *, modulus: int = 4, held: int = 2, per_class: int = SAMPLE_PER_CLASS, max_chars: int = SAMPLE_MAX_CHARS) -> QualityModel:
    """Learns from at most ``per_class`` rows of each label, none of them held out and each of
    at most ``max_chars`` characters; both bound the driver's memory."""
    sample = labelled_sample(docs, labels, "quality", modulus, held, per_class, max_chars).collect()
    return train([(r.text, int(r.y)) for r in sample])


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) for every row; null and empty texts get the score of empty text,
    repeated rows are kept, other columns are not read."""
    spark = docs.sparkSession
    arrow_limits(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        comp = Compressors(m.good, m.bad)
        mean, scale, w = np.array(m.mean), np.array(m.scale), np.array(m.weights)
        for batch in batches:
            x = np.array([comp.features(t.as_py()) for t in batch.column(1)]).reshape(-1, 3)
            z = ((x - mean) / scale) @ w + m.bias
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's quality score; rows whose id is null aren't held out.  See ``score``."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(crc_class(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )
