"""Poincaré-ball primitives over array columns, curvature -c."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.functions.vectors import dot, let, norm, plus, scaled

#: Norms are kept this far from 0 and from the ball's edge.
TINY = 1e-15
EDGE = 4e-3


def project(x: Column | str, c: float) -> Column:
    """x pulled back inside the ball."""
    limit = (1 - EDGE) / c**0.5
    return let(x, lambda v: F.when(norm(v) > limit, scaled(v, F.lit(limit) / norm(v))).otherwise(v))


def mobius_add(x: Column | str, y: Column | str, c: float) -> Column:
    """x ⊕ y, pulled back inside the ball."""

    def add(a: Column, b: Column) -> Column:
        left = scaled(a, 1 + 2 * c * dot(a, b) + c * dot(b, b))
        right = scaled(b, 1 - c * dot(a, a))
        return scaled(plus(left, right), 1 / F.greatest(1 + 2 * c * dot(a, b) + c * c * dot(a, a) * dot(b, b), F.lit(TINY)))

    return project(let(x, lambda a: let(y, lambda b: add(a, b))), c)


def exp_map(v: Column | str, c: float) -> Column:
    """The exponential map at the origin."""
    root = c**0.5

    def mapped(a: Column) -> Column:
        n = F.greatest(norm(a), F.lit(TINY))
        return scaled(a, F.tanh(n * root) / (n * root))

    return project(let(v, mapped), c)


def distance(x: Column | str, y: Column | str, c: float) -> Column:
    """2/√c · artanh(√c · |(-x) ⊕ y|)."""
    gap = norm(mobius_add(scaled(x, F.lit(-1.0)), y, c)) * c**0.5
    return 2 / c**0.5 * F.atanh(F.least(gap, F.lit(1 - 1e-9)))
