"""Toxicity by a subsequence string kernel and a linear support vector machine.

A text is cut into units: its lower-cased whitespace words (and runs of single
characters written apart, joined), reduced to letters and digits.  The kernel
counts common subsequences of PARTS characters, each weighed by LAMBDA per
character it spans, so gaps and inserted characters lower it but don't end it.
Nystroem features against landmarks, found in labelled texts, feed a linear SVM
that is trained on the labelled texts: a toxic one has a unit over the margin, its
witness, and a clean one has none.  The largest decision of any unit, calibrated,
scores the text.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_limits, crc_class, labelled_sample, table, worker_state
from weftgraph.llm.quality import fit_logistic

PARTS = 3
LAMBDA = 0.5
#: Longer units than WIDTH characters are cut into overlapping pieces, by length and step: what else
#: a piece holds lowers its kernel, so there are short ones too.
WIDTH = 20
PIECES = ((20, 10), (12, 4), (8, 2))
LANDMARKS = 64
LANDMARK_CHARS = 12
LANDMARK_LEAST = 4
LEAST_EIGENVALUE = 0.05
#: Choices of witnesses, and additions of clean units to the SVM's rows.
WITNESS_ROUNDS = 4
CLEAN_ROUNDS = 8
#: A landmark's kernel is taken as 0 for a unit that lacks this share of its letters:
#: a share m of n letters leaves at most C(m,3)/C(n,3) of its subsequences.
SHARED_LETTERS = 0.8
SAMPLE_PER_CLASS = 1500
SAMPLE_MAX_CHARS = 20_000
CACHE_UNITS = 600_000
DROP = re.compile(r"[^\w]|_")


@dataclass(frozen=True)
class ToxicModel:
    landmarks: tuple[str, ...]
    project: np.ndarray  # Nystroem: landmark kernel to the power -1/2, times the SVM's weights
    bias: float
    slope: float
    offset: float


def spaced_runs(words: list[str]) -> Iterator[str]:
    """Runs of three or more single characters written apart, joined."""
    run: list[str] = []
    for w in [*words, ""]:
        if len(w) == 1:
            run.append(w)
        else:
            if len(run) >= 3:
                yield "".join(run)
            run = []


def units_of(text: str | None) -> list[str]:
    """Distinct units of a whole text; null and empty texts have none."""
    if not text:
        return []
    words = text.lower().split()
    raw = set(words)
    if list(map(len, words)).count(1) >= 3:
        raw.update(spaced_runs(words))
    found = set()
    for w in raw:
        if not w.isalnum():
            w = w.strip(".,")
            if not w.isalnum():
                w = DROP.sub("", w)
        if PARTS <= len(w) <= WIDTH:
            found.add(w)
        elif len(w) > WIDTH:
            for size, step in PIECES:
                found.update(w[k : k + size] for k in range(0, len(w) - size, step))
                found.add(w[-size:])
    return list(found)


def codes(units: list[str], width: int) -> np.ndarray:
    """Code points, padded with 0."""
    joined = np.array([u[:width].ljust(width, "\0") for u in units], dtype=f"<U{width}")
    return joined.view(np.uint32).reshape(len(units), width)


def letter_mask(a: np.ndarray) -> np.ndarray:
    """A bit for each character present, by code point modulo 63."""
    bits = np.where(a > 0, np.uint64(1) << (a.astype(np.uint64) % np.uint64(63)), np.uint64(0))
    return np.bitwise_or.reduce(bits, axis=1)


def subsequence_kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Gap-weighted subsequence kernel of order PARTS of every row of s with the string t, or with
    the same row of t; padding (0) matches nothing."""
    t = np.atleast_2d(t)
    n, m = s.shape[1], t.shape[1]
    lam = np.float32(LAMBDA)
    prev = np.ones((len(s), n + 1, m + 1), np.float32)  # K'_0
    match = (s[:, :, None] == t[:, None, :]) & (s[:, :, None] > 0)
    for _ in range(PARTS - 1):
        new = np.zeros_like(prev)
        for i in range(1, n + 1):
            run = np.zeros(len(s), np.float32)
            for j in range(1, m + 1):
                run = lam * run + np.where(match[:, i - 1, j - 1], lam * lam * prev[:, i - 1, j - 1], 0)
                new[:, i, j] = lam * new[:, i - 1, j] + run
        prev = new
    return np.where(match, lam * lam * prev[:, :-1, :-1], 0).sum((1, 2))


def self_kernel(a: np.ndarray) -> np.ndarray:
    """Every row's kernel with itself, rows of like lengths together."""
    out = np.empty(len(a), np.float32)
    lengths = (a > 0).sum(1)
    order = np.argsort(lengths, kind="stable")
    for at in range(0, len(a), 2048):
        own = order[at : at + 2048]
        part = a[own, : int(lengths[own[-1]])]
        out[own] = subsequence_kernel(part, part)
    return out


class Kernel:
    """Kernel values of units with all landmarks, normalised by the own values of both, so that
    the kernel is positive semi-definite and at most 1."""

    def __init__(self, landmarks: tuple[str, ...]):
        self.points = [codes([t], len(t))[0] for t in landmarks]
        self.masks = np.array([letter_mask(p[None, :])[0] for p in self.points], np.uint64)
        self.need = np.ceil(SHARED_LETTERS * np.bitwise_count(self.masks)).astype(np.uint8)
        self.own = np.array([self_kernel(p[None, :])[0] for p in self.points])

    def __call__(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(indices of units with any kernel value, their values); others have 0 throughout."""
        s = codes(units, WIDTH)
        masks = letter_mask(s)
        near = np.empty((len(units), len(self.points)), bool)
        for k, (mask, need) in enumerate(zip(self.masks, self.need)):
            near[:, k] = np.bitwise_count(masks & mask) >= need
        rows = np.flatnonzero(near.any(1))
        out = np.zeros((len(rows), len(self.points)))
        lengths = (s[rows] > 0).sum(1)
        own_of = np.sqrt(self_kernel(s[rows]))
        for k, p in enumerate(self.points):
            at = np.flatnonzero(near[rows, k])
            at = at[np.argsort(lengths[at], kind="stable")]
            for block in range(0, len(at), 2048):
                own = at[block : block + 2048]
                wide = int(lengths[own[-1]])
                out[own, k] = subsequence_kernel(s[rows[own], :wide], p) / (own_of[own] * np.sqrt(self.own[k]))
        return rows, out


def pieces(unit: str) -> set[str]:
    n = len(unit)
    return {unit[i:j] for i in range(n) for j in range(i + LANDMARK_LEAST, min(n, i + LANDMARK_CHARS) + 1)}


def evidence(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """How far counts in toxic texts exceed those in clean ones: (t - c)^2 / (t + c), 0 if they don't."""
    return np.maximum(toxic - clean, 0) ** 2 / np.maximum(toxic + clean, 1e-9)


def pick_landmarks(texts: list[tuple[list[str], int]]) -> tuple[str, ...]:
    """Pieces of the units of toxic texts, by evidence times characters over two, at most
    LANDMARKS.  First those of texts that hold no landmark yet, until each holds one; then
    those of units that hold none.  Rare pieces and pieces that clean texts hold are eligible."""
    bad = [units for units, y in texts if y]
    share = len(bad) / max(1, len(texts) - len(bad))
    spared = Counter(u for units, y in texts if not y for u in units)
    clean: Counter[str] = Counter()
    for u, n in spared.items():
        for x in pieces(u):
            clean[x] += n
    names = sorted({u for units in bad for u in units})
    at = {u: k for k, u in enumerate(names)}
    owner = np.repeat(np.arange(len(bad)), [len(units) for units in bad])
    unit = np.array([at[u] for units in bad for u in units], np.int64)
    number: dict[str, int] = {}
    piece_of, unit_of = [], []
    for k, u in enumerate(names):
        for x in sorted(pieces(u)):
            piece_of.append(number.setdefault(x, len(number)))
            unit_of.append(k)
    if not number:
        return ()
    piece, holder = np.array(piece_of), np.array(unit_of)
    every = list(number)
    against = np.array([clean[x] * share for x in every])
    length = np.array([len(x) for x in every])
    rank = np.empty(len(every), np.int64)
    rank[sorted(range(len(every)), key=every.__getitem__)] = np.arange(len(every))
    free, open_text = np.ones(len(names), bool), np.ones(len(bad), bool)
    chosen: list[str] = []
    by_text = True
    while len(chosen) < LANDMARKS:
        mass = np.bincount(unit, weights=open_text[owner] if by_text else None, minlength=len(names)) * free
        value = evidence(np.bincount(piece, weights=mass[holder], minlength=len(every)), against) * (length - 2)
        top = value.max()
        if top <= 0:
            if not by_text:
                break
            by_text = False
            continue
        ties = np.flatnonzero(value >= top * (1 - 1e-12))
        best = ties[np.lexsort((rank[ties], length[ties]))[-1]]
        chosen.append(every[best])
        free[holder[piece == best]] = False
        open_text[owner[~free[unit]]] = False
    return tuple(chosen)


def spoilt(unit: str, rng: np.random.Generator) -> str:
    """The unit with a character inserted at an inner place."""
    at = int(rng.integers(1, len(unit)))
    return unit[:at] + "xqzkwy"[int(rng.integers(6))] + unit[at:]


def fit_svm(x: np.ndarray, y: np.ndarray, times: np.ndarray, c: float = 8.0, rounds: int = 40, seed: int = 3) -> tuple[np.ndarray, float]:
    """Linear SVM (hinge loss) by dual coordinate descent; y is -1 or 1, and a row counts ``times``."""
    a = np.hstack([x, np.ones((len(x), 1))])
    alpha, w = np.zeros(len(a)), np.zeros(a.shape[1])
    square = (a * a).sum(1)
    top = c * times
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(a)):
            g = y[i] * (a[i] @ w) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), top[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * a[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w[:-1], float(w[-1])


def nystroem(points: list[np.ndarray]) -> np.ndarray:
    """The landmarks' own kernel matrix, symmetric and positive semi-definite, to the power -1/2;
    directions that the landmarks hardly span are left out."""
    a = np.zeros((len(points), max(map(len, points))), np.uint32)
    for k, p in enumerate(points):
        a[k, : len(p)] = p
    size = np.sqrt(self_kernel(a))
    gram = np.array([subsequence_kernel(a, p) for p in points], float) / np.outer(size, size)
    val, vec = np.linalg.eigh((gram + gram.T) / 2)  # equal but for rounding
    kept = val > LEAST_EIGENVALUE
    return (vec[:, kept] / np.sqrt(val[kept])) @ vec[:, kept].T


def train(rows: list[tuple[str, int]]) -> ToxicModel:
    """Landmarks, SVM and calibration from labelled texts."""
    texts = [(units_of(t), y) for t, y in sorted(rows)]
    landmarks = pick_landmarks(texts) if len({y for _, y in texts}) == 2 else ()
    if not landmarks:
        return ToxicModel(("aaaa",), np.zeros(1), -1.0, 1.0, 0.0)
    kernel = Kernel(landmarks)
    root = nystroem(kernel.points)
    names = sorted({u for units, _ in texts for u in units})
    index = {u: k for k, u in enumerate(names)}
    some, values = kernel(names)
    whole = np.zeros((len(names), len(landmarks)))
    whole[some] = values
    x = whole @ root
    count = np.zeros((2, len(names)))
    for units, label in texts:
        count[label, [index[u] for u in units]] += 1
    bags = [np.array([index[u] for u in units]) for units, label in texts if label and units]
    # clean units without any kernel value are one row
    clean = np.flatnonzero((count[0] > 0) & whole.any(1))
    blank = count[0, ~whole.any(1)].sum()
    rng = np.random.default_rng(5)
    bent = {p: [p, *(spoilt(p, rng) for _ in range(12))] for p in landmarks}
    held = np.array([[p in u for u in names] for p in landmarks], float)
    weighed = evidence(held @ count[1], held @ count[0])
    decision = (whole * weighed).max(1)
    hard = clean[np.unique(np.argsort(-whole[clean], axis=0, kind="stable")[:400])] if len(clean) else clean
    before: np.ndarray | None = None
    for _ in range(WITNESS_ROUNDS):
        found = np.array([bag[np.argmax(decision[bag])] for bag in bags], np.int64)
        if before is not None and (found == before).all():
            break
        before = found
        own, times = np.unique(found, return_counts=True)
        also = [v for k, p in enumerate(landmarks) if held[k, own].any() for v in bent[p]]
        at, values = kernel(also) if also else ([], np.zeros((0, len(landmarks))))
        for _ in range(CLEAN_ROUNDS):
            rows = np.vstack([x[own], values @ root, x[hard], np.zeros((1, len(landmarks)))])
            y = np.concatenate([np.ones(len(own) + len(values)), -np.ones(len(hard) + 1)])
            w, bias = fit_svm(rows, y, np.concatenate([times, np.ones(len(values)), count[0, hard], [blank]]))
            decision = x @ w + bias
            more = np.setdiff1d(clean[decision[clean] > -1 + 1e-3], hard)
            if not len(more):
                break
            hard = np.concatenate([hard, more])
    model = ToxicModel(landmarks, root @ w, bias, 1.0, 0.0)
    scorer = Scorer(model)
    top = scorer.top([units for units, _ in texts])
    slope, offset = fit_logistic(np.clip(top, -3, 3)[:, None], np.array([v for _, v in texts], float))
    return ToxicModel(landmarks, root @ w, bias, float(max(slope[0], 1e-3)), offset)


class Scorer:
    """The largest decision of any unit of each text; a bounded memory of units seen."""

    def __init__(self, model: ToxicModel):
        self.model, self.kernel, self.seen = model, Kernel(model.landmarks), {}

    def top(self, texts: list[list[str]]) -> np.ndarray:
        if len(self.seen) > CACHE_UNITS:
            self.seen.clear()
        new = list({u for units in texts for u in units if u not in self.seen})
        self.seen.update(dict.fromkeys(new, self.model.bias))
        if new:
            at, values = self.kernel(new)
            for k, v in zip(at.tolist(), (values @ self.model.project + self.model.bias).tolist()):
                self.seen[new[k]] = v
        get = self.seen.__getitem__
        return np.array([max(map(get, units), default=self.model.bias) for units in texts])

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        z = self.model.slope * np.clip(self.top([units_of(t) for t in texts]), -3, 3) + self.model.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, *, modulus: int = 5, held: int = 0, per_class: int = SAMPLE_PER_CLASS, max_chars: int = SAMPLE_MAX_CHARS) -> ToxicModel:
    """Learns from at most ``per_class`` rows of each label, none of them held out and each of
    at most ``max_chars`` characters; both bound the driver's memory."""
    sample = labelled_sample(docs, labels, "toxic", modulus, held, per_class, max_chars).collect()
    return train([(r.text, int(r.y)) for r in sample])


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """(doc_id, score) for every row; a null or empty text scores as a text without any
    insult; repeated rows stay; other columns are not read."""
    spark = docs.sparkSession
    arrow_limits(spark)
    shared, name = spark.sparkContext.broadcast(model), f"toxicity-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_state(name, lambda: Scorer(shared.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scorer(part.column(1).to_pylist()))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity score; rows whose id is null aren't held out.  See ``score``."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs, fit(docs, labels)).select(
        "doc_id",
        F.coalesce(crc_class(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
