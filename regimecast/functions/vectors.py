"""Row-level expressions over small vectors: distances, memberships, entropies.

A vector is either a list of scalar columns of known length, which compiles into the
surrounding whole-stage code, or one array column of any length, which uses Spark's
higher-order functions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from regimecast.functions.scalars import column

EPSILON = 1e-9
UNROLLED_WIDTH = 8

Vector = str | Column | Sequence[Column]


def elements(arr: str | Column, size: int) -> list[Column]:
    """The entries of an array column of known length as scalar columns."""
    return [F.get(column(arr), F.lit(i)) for i in range(size)]


def _parts(p: Vector) -> Column | list[Column]:
    return column(p) if isinstance(p, (str, Column)) else list(p)


def fold(p: Column | list[Column], term: Callable[[Column], Column] = lambda v: v) -> Column:
    if isinstance(p, list):
        return reduce(add, [term(v) for v in p])
    return F.aggregate(p, F.lit(0.0), lambda a, v: a + term(v))


def each(p: Column | list[Column], term: Callable[[Column], Column]) -> Column | list[Column]:
    return [term(v) for v in p] if isinstance(p, list) else F.transform(p, term)


def _length(p: Column | list[Column]) -> Column:
    return F.lit(float(len(p))) if isinstance(p, list) else F.size(p).cast("double")


def is_probability(p: Vector, tol: float = 1e-6) -> Column:
    p = _parts(p)
    if isinstance(p, list):
        positive = reduce(lambda a, b: a & b, [v >= 0 for v in p])
    else:
        positive = F.forall(p, lambda v: v >= 0)
    return positive & (F.abs(fold(p) - 1.0) <= tol)


def distance_exprs(x: str, centres: Sequence[Sequence[float]] | str, k: int, width: int) -> list[str]:
    """SQL text of the Euclidean distance of an array column to each of ``k`` centres.

    The centres are numbers, or the name of an array<array<double>> column. Text goes to the
    planner in one piece; the same tree built call by call costs more than a small job.
    """

    def entry(j: int, d: int) -> str:
        return f"get(get({centres}, {j}), {d})" if isinstance(centres, str) else f"{float(centres[j][d])!r}D"

    def whole(j: int) -> str:
        if isinstance(centres, str):
            return f"get({centres}, {j})"
        return "array(" + ", ".join(entry(j, d) for d in range(width)) + ")"

    if width == 1:
        return [f"abs(get({x}, 0) - {entry(j, 0)})" for j in range(k)]
    if width <= UNROLLED_WIDTH:
        square = "power(get({x}, {d}) - {c}, 2D)"
        return [
            "sqrt(" + " + ".join(square.format(x=x, d=d, c=entry(j, d)) for d in range(width)) + ")"
            for j in range(k)
        ]
    total = "sqrt(aggregate(zip_with({x}, {c}, (a, b) -> (a - b) * (a - b)), 0D, (s, v) -> s + v))"
    return [total.format(x=x, c=whole(j)) for j in range(k)]


def distances(x: str, centres: Sequence[Sequence[float]]) -> list[Column]:
    """Euclidean distance of an array column to every centre, as scalar columns."""
    return [F.expr(e) for e in distance_exprs(x, centres, len(centres), len(centres[0]))]


def nearest(dist: Sequence[Column]) -> Column:
    """0-based position of the smallest distance, the first one on a tie."""
    arr = F.array(*dist)
    return (F.array_position(arr, F.array_min(arr)) - 1).cast("int")


def first_max(u: Vector) -> Column:
    arr = F.array(*u) if not isinstance(u, (str, Column)) else column(u)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def one_hot(label: str | Column, size: int) -> list[Column]:
    label = column(label)
    return [(label == j).cast("double") for j in range(size)]


def _scaled(h: Column, most: Column) -> Column:
    return F.when(most > 0, h / most).otherwise(h)


def _smoothed(p: Vector, epsilon: float) -> tuple[Column | list[Column], Column]:
    """Entries with epsilon added, and their total. The measures below are written over both, so
    that no entry has to be divided by the total first."""
    parts = each(_parts(p), lambda v: v + F.lit(epsilon))
    return parts, fold(parts)


def shannon(
    p: Vector, base: float = 2.0, normalize: bool = False, epsilon: float = EPSILON
) -> Column:
    a, total = _smoothed(p, epsilon)
    h = (F.log(total) - fold(a, lambda v: v * F.log(v)) / total) / math.log(base)
    return _scaled(h, F.log(_length(a)) / math.log(base)) if normalize else h


def renyi(
    p: Vector,
    alpha: float = 2.0,
    base: float = 2.0,
    normalize: bool = False,
    epsilon: float = EPSILON,
) -> Column:
    if alpha == 1.0:
        return shannon(p, base, normalize, epsilon)
    a, total = _smoothed(p, epsilon)
    if math.isinf(alpha):
        top = F.array_max(F.array(*a) if isinstance(a, list) else a)
        h = (F.log(total) - F.log(top)) / math.log(base)
    else:
        power = F.log(fold(a, lambda v: F.pow(v, F.lit(alpha)))) - alpha * F.log(total)
        h = power / ((1.0 - alpha) * math.log(base))
    # Every order reaches log C on the uniform distribution.
    return _scaled(h, F.log(_length(a)) / math.log(base)) if normalize else h


def tsallis(
    p: Vector, q: float = 2.0, normalize: bool = False, epsilon: float = EPSILON
) -> Column:
    if q == 1.0:
        return shannon(p, 2.0, normalize, epsilon)
    a, total = _smoothed(p, epsilon)
    h = (1.0 - fold(a, lambda v: F.pow(v, F.lit(q))) / F.pow(total, F.lit(q))) / (q - 1.0)
    if not normalize:
        return h
    return _scaled(h, (1.0 - F.pow(_length(a), F.lit(1.0 - q))) / (q - 1.0))


def gini_simpson(p: Vector) -> Column:
    p = _parts(p)
    total = fold(p)
    return 1.0 - fold(p, lambda v: v * v) / (total * total)


# Fixed names of the side-by-side measures.
COMPARED = {
    "shannon": lambda p: shannon(p),
    "shannon_normalized": lambda p: shannon(p, normalize=True),
    "renyi_alpha_0_5": lambda p: renyi(p, 0.5, normalize=True),
    "renyi_alpha_2": lambda p: renyi(p, 2.0, normalize=True),
    "renyi_alpha_inf": lambda p: renyi(p, math.inf, normalize=True),
    "tsallis_q_0_5": lambda p: tsallis(p, 0.5, normalize=True),
    "tsallis_q_2": lambda p: tsallis(p, 2.0, normalize=True),
    "gini_simpson": gini_simpson,
}

# Fixed names accepted by entropy().
NAMED = {
    "shannon": COMPARED["shannon"],
    "shannon_normalized": COMPARED["shannon_normalized"],
    "gini_simpson": gini_simpson,
    "renyi_2": COMPARED["renyi_alpha_2"],
    "tsallis_2": COMPARED["tsallis_q_2"],
}


def entropy(p: Vector, method: str = "shannon_normalized") -> Column:
    if method not in NAMED:
        raise ValueError(f"unknown entropy {method!r}; known: {sorted(NAMED)}")
    return NAMED[method](p)


def compare_entropies(p: Vector) -> dict[str, Column]:
    return {name: measure(p) for name, measure in COMPARED.items()}
