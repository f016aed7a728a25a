"""Column functions over arrays of doubles."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column | str, f: Callable[[Column], Column]) -> Column:
    """f of x, with x computed and planned once however often f uses it."""
    return F.get(F.transform(F.array(col(x)), f), F.lit(0))


def array_sum(x: Column | str) -> Column:
    return F.aggregate(col(x), F.lit(0.0), lambda a, v: a + v)


def dot(x: Column | str, y: Column | str) -> Column:
    return array_sum(F.zip_with(col(x), col(y), lambda a, b: a * b))


def square(x: Column | str) -> Column:
    return F.aggregate(col(x), F.lit(0.0), lambda a, v: a + v * v)


def norm(x: Column | str) -> Column:
    return F.sqrt(square(x))


def scaled(x: Column | str, by: Column) -> Column:
    return F.transform(col(x), lambda v: v * by)


def plus(x: Column | str, y: Column | str) -> Column:
    return F.zip_with(col(x), col(y), lambda a, b: a + b)


def minus(x: Column | str, y: Column | str) -> Column:
    return F.zip_with(col(x), col(y), lambda a, b: a - b)


def times(x: Column | str, y: Column | str) -> Column:
    return F.zip_with(col(x), col(y), lambda a, b: a * b)


def unit(x: Column | str) -> Column:
    """Scaled to length 1; a zero vector stays as it is."""
    return let(x, lambda v: F.when(norm(v) > 0, scaled(v, 1 / norm(v))).otherwise(v))


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def matrix(rows: Sequence[Sequence[float]]) -> Column:
    """A literal array of rows; for weights, whose size is the model's."""
    return F.array(*(F.array(*(F.lit(float(v)) for v in r)) for r in rows))


ACTIVATIONS = {
    "linear": lambda v: v,
    "relu": lambda v: F.greatest(v, F.lit(0.0)),
    "tanh": F.tanh,
    "sigmoid": lambda v: 1 / (1 + F.exp(-v)),
    "elu": lambda v: F.when(v > 0, v).otherwise(F.exp(v) - 1),
}


def activate(x: Column | str, name: str) -> Column:
    if name == "softmax":
        e = let(x, lambda a: F.transform(a, lambda v: F.exp(v - F.array_max(a))))
        return let(e, lambda a: F.transform(a, lambda v: v / array_sum(a)))
    return col(x) if name == "linear" else F.transform(col(x), ACTIVATIONS[name])


#: Weights of a column that are written out one by one, at most.
SPARSE = 4


def dense(x: Column | str, weights: Sequence[Sequence[float]], bias: Sequence[float] | None = None, activation: str = "linear") -> Column:
    """activation(x · W + b); W has a row for each input.  Of sparse columns only the weights
    other than 0 are multiplied."""
    columns = [list(c) for c in zip(*weights)]
    terms = [[(k, float(w)) for k, w in enumerate(c) if w] for c in columns]
    if len(weights) > SPARSE and all(len(t) <= SPARSE for t in terms):
        out = F.array(*(sum((F.get(col(x), F.lit(k)) * w for k, w in t), F.lit(0.0)) for t in terms))
    else:
        out = F.transform(matrix(columns), lambda w: dot(x, w))
    if bias is not None:
        out = plus(out, F.array(*(F.lit(float(b)) for b in bias)))
    return activate(out, activation)


def leaky_clipped(x: Column, low: float, high: float, alpha: float = 0.1) -> Column:
    """x within [low, high]; outside, the slope falls to alpha."""
    below, above = F.greatest(F.lit(low) - x, F.lit(0.0)), F.greatest(x - F.lit(high), F.lit(0.0))
    return x + (1 - alpha) * below - (1 - alpha) * above
