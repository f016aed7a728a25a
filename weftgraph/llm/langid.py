"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time.  It labels
every byte position with a distribution over the learned languages; the log
probabilities of all positions of a text are averaged, which gives the
document's distribution.  Texts are read whole, in segments of SEGMENT bytes
that run side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_limits, crc_class, fresh_worker, stored, table, widened

HIDDEN = 8
SEGMENT = 96
#: Segments that run side by side.
LANES = 4096
#: Learning: rows per language and characters of a row at most, segments per step, steps, and
#: bytes of a segment.
ROWS_PER_LANG = 400
SAMPLE_MAX_CHARS = 20_000
#: More languages than this aren't learned but refused.
MOST_LANGS = 1000
BATCH, STEPS, TRAIN_BYTES = 192, 260, 48
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class LangModel:
    langs: tuple[str, ...]
    params: dict[str, np.ndarray]


def start_params(n_langs: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Input tables (a row for each byte, and one for padding), recurrences of either
    direction (update, reset, candidate), and the output layer."""
    h = HIDDEN
    return {
        "table": rng.normal(0, 0.3, (2, 257, 3 * h)).astype(np.float32),
        "gates": rng.normal(0, 1 / np.sqrt(h), (2, h, 2 * h)).astype(np.float32),
        "cand": rng.normal(0, 1 / np.sqrt(h), (2, h, h)).astype(np.float32),
        "out": rng.normal(0, 1 / np.sqrt(2 * h), (2, h, n_langs)).astype(np.float32),
        "bias": np.zeros(n_langs, np.float32),
    }


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


def run_direction(p: dict[str, np.ndarray], d: int, ids: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (time, lane, hidden) of direction d over ids (time, lane), which are read
    in the order given."""
    h = HIDDEN
    state = np.zeros((ids.shape[1], h), np.float32)
    states = np.empty((*ids.shape, h), np.float32)
    for t in range(len(ids)):
        x = p["table"][d].take(ids[t], axis=0)
        g = sigmoid(x[:, : 2 * h] + state @ p["gates"][d])
        z, r = g[:, :h], g[:, h:]
        rs = r * state
        c = np.tanh(x[:, 2 * h :] + rs @ p["cand"][d])
        if keep is not None:
            keep.append((z, r, c, state, rs))
        state = state + z * (c - state)
        states[t] = state
    return states


def position_logits(p: dict[str, np.ndarray], ids: np.ndarray) -> np.ndarray:
    """(time, lane, language) before normalisation."""
    return run_direction(p, 0, ids) @ p["out"][0] + run_direction(p, 1, ids[::-1])[::-1] @ p["out"][1] + p["bias"]


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def loss_and_grads(p: dict[str, np.ndarray], ids: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all positions, and its gradient through time."""
    h, (steps, lanes) = HIDDEN, ids.shape
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    order = (ids, ids[::-1])
    kept: tuple[list, list] = ([], [])
    states = [run_direction(p, d, order[d], kept[d]) for d in (0, 1)]
    logits = states[0] @ p["out"][0] + states[1][::-1] @ p["out"][1] + p["bias"]
    logp = log_softmax(logits)
    loss = -float(logp[:, np.arange(lanes), y].mean())
    dlogits = np.exp(logp)
    dlogits[:, np.arange(lanes), y] -= 1
    dlogits /= steps * lanes
    grads["bias"] = dlogits.sum((0, 1))
    for d in (0, 1):
        dl = dlogits if d == 0 else dlogits[::-1]
        grads["out"][d] = states[d].reshape(-1, h).T @ dl.reshape(-1, dl.shape[-1])
        dstates = dl @ p["out"][d].T
        back = np.zeros((lanes, h), np.float32)
        for t in range(steps - 1, -1, -1):
            z, r, c, state, rs = kept[d][t]
            ds = dstates[t] + back
            dc = ds * z * (1 - c * c)
            drs = dc @ p["cand"][d].T
            dg = np.concatenate([ds * (c - state) * z * (1 - z), drs * state * r * (1 - r)], axis=1)
            back = ds * (1 - z) + drs * r + dg @ p["gates"][d].T
            grads["gates"][d] += state.T @ dg
            grads["cand"][d] += rs.T @ dc
            np.add.at(grads["table"][d], order[d][t], np.concatenate([dg, dc], axis=1))
    return loss, grads


def segments_of(data: bytes, size: int) -> np.ndarray:
    """All bytes of a text as rows of size, the last padded with 256."""
    a = np.frombuffer(data, np.uint8).astype(np.int16)
    rows = -(-len(a) // size)
    out = np.full(rows * size, 256, np.int16)
    out[: len(a)] = a
    return out.reshape(rows, size)


def train(rows: list[tuple[str, str]], *, seed: int = 11, steps: int = STEPS) -> LangModel:
    """Adam on random segments, languages drawn alike."""
    rng = np.random.default_rng(seed)
    by: dict[str, list[np.ndarray]] = {}
    for text, lang in sorted(r for r in rows if r[0] and r[1] is not None):
        if LETTER.search(text):
            by.setdefault(lang, []).append(segments_of(text.encode("utf-8", "replace"), TRAIN_BYTES))
    langs = tuple(sorted(by))
    if len(langs) < 2:
        return LangModel(langs, {})
    pools = [np.concatenate(by[k]) for k in langs]
    p = start_params(len(langs), rng)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        y = rng.integers(0, len(langs), BATCH)
        ids = np.stack([pools[k][rng.integers(len(pools[k]))] for k in y]).T.astype(np.int64)
        _, grads = loss_and_grads(p, ids, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = 0.02 * min(1.0, 1.5 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p[k] = (p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return LangModel(langs, p)


def predict(model: LangModel, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, probability) of each whole text: log probabilities averaged over all
    positions.  Null, empty and letterless texts: ('und', 1.0); if fewer than two
    languages were learned, that one (or 'und') with 1.0."""
    found: list[tuple[str, float]] = [(UNKNOWN, 1.0)] * len(texts)
    live = [k for k, t in enumerate(texts) if t and LETTER.search(t)]
    if len(model.langs) < 2:
        for k in live:
            found[k] = (model.langs[0] if model.langs else UNKNOWN, 1.0)
        return found
    sums = np.zeros((len(texts), len(model.langs)))
    counts = np.zeros(len(texts))
    lanes: list[np.ndarray] = []
    owners: list[np.ndarray] = []

    def flush() -> None:
        ids, own = np.concatenate(lanes), np.concatenate(owners)
        for at in range(0, len(own), LANES):
            part = ids[at : at + LANES].T.astype(np.int64)
            logp = log_softmax(position_logits(model.params, part))
            real = part < 256
            np.add.at(sums, own[at : at + LANES], (logp * real[:, :, None]).sum(0))
            np.add.at(counts, own[at : at + LANES], real.sum(0))
        lanes.clear()
        owners.clear()

    waiting = 0
    for k in live:
        rows = segments_of(texts[k].encode("utf-8", "replace"), SEGMENT)
        lanes.append(rows)
        owners.append(np.full(len(rows), k))
        waiting += len(rows)
        if waiting >= 4 * LANES:
            flush()
            waiting = 0
    if waiting:
        flush()
    for k in live:
        mean = sums[k] / max(counts[k], 1)
        prob = np.exp(log_softmax(mean * min(counts[k], 8.0)))
        best = int(prob.argmax())
        found[k] = (model.langs[best], float(prob[best]))
    return found


def fit(docs: DataFrame, *, modulus: int = 5, held: int = 0, rows_per_lang: int = ROWS_PER_LANG, max_chars: int = SAMPLE_MAX_CHARS) -> LangModel:
    """Learns from at most ``rows_per_lang`` texts of each language, first in hash order, of
    at most ``max_chars`` characters; null ids, null languages and held-out rows aren't
    learned from.  More than MOST_LANGS languages raise."""
    rows = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_class(F.col("doc_id"), modulus) != held) & (F.length("text") <= max_chars)
    ).select("doc_id", "lang", "text")
    # first in hash order within a language's sixteenths, then within the language, so that a common
    # language's rows neither meet in one task nor leave it in number
    ids = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).distinct().withColumn("part", F.pmod("h", F.lit(16)))
    for keys in (("lang", "part"), ("lang",)):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("h", "doc_id"))
        ids = ids.withColumn("rank", rank).where(F.col("rank") <= rows_per_lang).drop("rank")
    ids = ids.select("doc_id", "lang")
    chosen = stored(ids, "sampled")
    if chosen.select("lang").distinct().count() > MOST_LANGS:
        raise ValueError(f"expected {MOST_LANGS} languages at most")
    found = rows.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    return train([(r.text, r.lang) for r in found.select("text", "lang").collect()])


def identify(docs: DataFrame, model: LangModel) -> DataFrame:
    """The rows of docs with lang_pred and score added; only text is read by the
    prediction; repeated rows and further columns stay as they are."""
    spark = docs.sparkSession
    arrow_limits(spark)
    shared = spark.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            got = predict(shared.value, batch.column(names.index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                [*names, "lang_pred", "score"],
            )

    docs = docs.select(*names)
    return docs.mapInArrow(run, widened(docs, lang_pred="string", score="double"))


def op2_language(spark, sf_dir: str) -> DataFrame:
    """Every document's language; rows whose id is null aren't held out.  See ``identify``."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", "text"), fit(docs)).select(
        "doc_id", F.coalesce(crc_class(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
