"""Many clusterings of the same rows at once.

A pass over the rows moves the centres of every start and every number of clusters together: tasks
turn their rows into sums for each centre, Spark adds the sums up, and only centres travel. The state is
``starts x clusters x dimensions`` numbers, checked in size. Clusterings that have settled drop out of
later passes.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimecast.session import materialise

# Executors get these functions by value, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Numbers in the centres of all clusterings of one call.
MAX_STATE = 4_000_000
_ROW_NUMBERS = 1 << 19  # numbers of the rows that one task should hold
_CHUNK = 1 << 20  # distances computed together
_BLOCK = 1 << 18  # numbers of the rows that are packed and handled together
_NEAR_CHUNK = 1 << 16  # memberships computed together, so that they stay close to the processor
_DIRECT_NUMBERS = 1 << 16  # so few sums of all tasks go to the driver as they are


@dataclass
class Clustering:
    """One fit: its centres, the cost at these centres, and the passes it took."""

    centres: np.ndarray
    cost: float = np.inf
    passes: int = 0
    settled: bool = False
    history: list[float] = field(default_factory=list)


class Rows:
    """The vectors of a frame, written once for all passes; rows without a vector are left out."""

    def __init__(self, df: DataFrame, x: str) -> None:
        vectors = df.select(F.col(x).cast("array<double>").alias("x")).where("x IS NOT NULL")
        held = materialise(vectors)
        sizes = held.agg(F.count(F.lit(1)), F.max(F.size("x")), F.min(F.size("x"))).first()
        self.count, self.width = sizes[0], sizes[1] or 0
        if self.count and sizes[1] != sizes[2]:
            raise ValueError("vectors differ in length")
        self.tasks = max(1, -(-self.count * max(self.width, 1) // _ROW_NUMBERS))
        few = held.rdd.getNumPartitions() < self.tasks
        self.frame = held.repartition(self.tasks) if few else held.coalesce(self.tasks)
        self._packed: DataFrame | None = None

    def over(self, part: Callable[[Iterator[np.ndarray]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What ``part`` gives for the vectors of each task, which come in blocks packed once; those on a line are sorted."""
        width = max(self.width, 1)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for values in _joined(batches, width):
                block = np.sort(values, axis=0) if width == 1 else values
                yield pa.RecordBatch.from_arrays([pa.array([block.tobytes()], pa.binary())], names=["block"])

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return part(np.frombuffer(b, float).reshape(-1, width) for batch in batches for b in batch.column(0).to_pylist())

        if self._packed is None:
            self._packed = materialise(self.frame.mapInArrow(pack, "block binary"))
        return self._packed.mapInArrow(unpack, schema)

    def summed(self, run: Callable[[np.ndarray, dict], None], numbers: int) -> dict[tuple[int, int], float]:
        """Sums by (i, j) of what ``run`` adds to a dictionary of arrays by i for each block of vectors.

        ``numbers`` is how many sums a task has; Spark adds them up unless those of all tasks are few.
        """

        def part(blocks: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
            totals: dict[int, np.ndarray] = {}
            for values in blocks:
                run(values, totals)
            for i, row in totals.items():
                n = len(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, i), pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(row, pa.float64())], names=["i", "j", "v"]
                )

        parts = self.over(part, "i int, j int, v double")
        if self.tasks > 1 and self.tasks * numbers > _DIRECT_NUMBERS:
            parts = parts.groupBy("i", "j").agg(F.sum("v").alias("v"))
        out: dict[tuple[int, int], float] = {}
        table = parts.toArrow()
        for i, j, v in zip(table["i"].to_pylist(), table["j"].to_pylist(), table["v"].to_pylist()):
            out[i, j] = out.get((i, j), 0.0) + v
        return out


def _joined(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """The vectors of a task in blocks of ``_BLOCK`` numbers or a little more."""
    held, size = [], 0
    for batch in batches:
        held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
        size += held[-1].size
        if size >= _BLOCK:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


def squares(values: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres."""
    if values.shape[1] <= 8:
        out = np.zeros((len(values), len(centres)))
        for d in range(values.shape[1]):
            out += (values[:, d, None] - centres[None, :, d]) ** 2
        return out
    out = (values**2).sum(axis=1)[:, None] - 2 * values @ centres.T + (centres**2).sum(axis=1)
    return np.maximum(out, 0.0)


def _blocks(values: np.ndarray, centres: int, chunk: int = _CHUNK) -> Iterator[np.ndarray]:
    step = max(1, chunk // max(centres, 1))
    for at in range(0, len(values), step):
        yield values[at : at + step]


def _state(clusterings: Sequence[Clustering]) -> tuple[np.ndarray, np.ndarray]:
    centres = np.concatenate([c.centres for c in clusterings])
    if centres.size > MAX_STATE:
        raise ValueError(f"{centres.size} numbers in all centres; at most {MAX_STATE} are supported")
    return centres, np.cumsum([0, *[len(c.centres) for c in clusterings]])


# --- hard clusterings -------------------------------------------------------------------------


def _unit(values: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) from the bits of each row, whatever its place and task."""
    h = np.full(len(values), np.uint64((salt * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for column in (values + 0.0).T:
            h = (h ^ np.ascontiguousarray(column).view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return ((h >> np.uint64(12)).astype(float) + 0.5) / float(1 << 52)


def spread_starts(rows: Rows, k: int, starts: int, seed: int) -> list[np.ndarray]:
    """For every start up to ``k`` rows that lie apart: each next one is drawn in proportion to its squared
    distance from those before it, by the smallest of exponential times that hash values stand for.

    One pass draws for all starts. The draw is among distinct vectors; a start ends early when no
    vector is left. Fewer clusters use the first rows of a start.
    """
    chosen = [np.zeros((0, rows.width)) for _ in range(starts)]
    for place in range(k):
        now = [c.copy() for c in chosen]

        def part(blocks: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[float, np.ndarray]] = {}
            for values in blocks:
                for block in _blocks(values, starts * max(place, 1)):
                    for s in range(starts):
                        if len(now[s]) < place:
                            continue
                        time = -np.log(_unit(block, (seed * 1009 + s) * 65_537 + place))
                        if place:
                            gap = squares(block, now[s]).min(axis=1)
                            gap[(block[:, None] == now[s][None]).all(axis=2).any(axis=1)] = 0.0
                            with np.errstate(divide="ignore"):
                                time = np.where(gap > 0, time / gap, np.inf)
                        at = int(np.argmin(time))
                        key = (float(time[at]), tuple(block[at]))
                        if np.isfinite(key[0]) and (s not in best or key < best[s]):
                            best[s] = key
            for s, (time, row) in best.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int32()), pa.array([time], pa.float64()), pa.array([list(row)], pa.list_(pa.float64()))], names=["s", "time", "row"]
                )

        found = rows.over(part, "s int, time double, row array<double>")
        for r in found.groupBy("s").agg(F.min(F.struct("time", "row")).alias("b")).collect():
            chosen[r["s"]] = np.vstack([chosen[r["s"]], r["b"]["row"]])
    return chosen


def _line_sums(values: np.ndarray, centres: Sequence[np.ndarray], costs: bool) -> list[np.ndarray]:
    """For every set of centres on a line [cost, then (rows, their sum) of each centre], from sorted values.

    On a line the rows of a centre lie between two cuts, so distances to all centres are not needed. The
    values between neighbouring cuts of all sets are added up once. As with the first of equal
    distances, a value half-way belongs to the centre that is listed first. Costs take one more look at the
    values for each set and are left at 0 unless asked for.
    """
    spans, owners = [], []
    for listed in centres:
        distinct, first = np.unique(listed, return_index=True)
        half = (distinct[:-1] + distinct[1:]) / 2
        cut = np.where(
            first[:-1] < first[1:], np.searchsorted(values, half, side="right"), np.searchsorted(values, half, side="left")
        )
        spans.append(np.concatenate([[0], cut, [len(values)]]))
        owners.append(first)
    starts = np.unique(np.concatenate([[0], *spans]))
    starts = starts[starts < len(values)]
    parts = np.add.reduceat(values, starts)
    low, high = (np.concatenate([side(s) for s in spans]) for side in (lambda s: s[:-1], lambda s: s[1:]))
    inside = (starts[:, None] >= low) & (starts[:, None] < high)
    sums, sizes, at, out = parts @ inside, high - low, 0, []
    for listed, span, first in zip(centres, spans, owners):
        row = np.zeros(1 + 2 * len(listed))
        row[1 + 2 * first] = sizes[at : at + len(first)]
        row[2 + 2 * first] = sums[at : at + len(first)]
        if costs:
            row[0] = ((values - np.repeat(listed[first], np.diff(span))) ** 2).sum()
        out.append(row)
        at += len(first)
    return out


def _hard_pass(rows: Rows, clusterings: Sequence[Clustering], costs: bool = False) -> None:
    """One step of all clusterings: new centres, and if asked for the cost at the old ones in ``cost``."""
    centres, edges = _state(clusterings)
    width = rows.width

    def run(values: np.ndarray, totals: dict) -> None:
        if width == 1:
            for c, row in enumerate(_line_sums(values[:, 0], [centres[a:b, 0] for a, b in zip(edges, edges[1:])], costs)):
                totals[c] = totals[c] + row if c in totals else row
            return
        for block in _blocks(values, len(centres)):
            far = squares(block, centres)
            for c, (a, b) in enumerate(zip(edges, edges[1:])):
                own = far[:, a:b]
                at = own.argmin(axis=1)
                hit = np.zeros((len(block), b - a))
                hit[np.arange(len(block)), at] = 1.0
                sums = np.empty((b - a, width + 1))
                sums[:, 0], sums[:, 1:] = hit.sum(axis=0), hit.T @ block
                row = np.concatenate([[own[np.arange(len(block)), at].sum()], sums.ravel()])
                totals[c] = totals[c] + row if c in totals else row

    found = rows.summed(run, len(clusterings) + len(centres) * (width + 1))
    for c, clustering in enumerate(clusterings):
        k = len(clustering.centres)
        flat = np.array([found[c, j] for j in range(1 + k * (width + 1))])
        sums = flat[1:].reshape(k, width + 1)
        clustering.cost = flat[0]
        size = sums[:, :1]
        # A cluster without rows stays where it is.
        moved = np.where(size > 0, sums[:, 1:] / np.maximum(size, 1), clustering.centres)
        clustering.history.append(float(np.sqrt(((moved - clustering.centres) ** 2).sum(axis=1)).max()))
        clustering.centres, clustering.passes = moved, clustering.passes + 1


def fit_hard_many(
    rows: Rows, ks: Sequence[int], starts: int = 10, seed: int = 42, max_iter: int = 300, tol: float = 1e-4
) -> dict[int, list[Clustering]]:
    """K-Means for every k and every start. A fit ends when no centre moves by more than ``tol``.

    ``cost`` belongs to the centres returned. With fewer distinct rows than clusters there are as many centres as rows.
    """
    if not rows.count:
        raise ValueError("there are no rows to cluster")
    drawn = spread_starts(rows, max(ks), starts, seed)
    out = {k: [Clustering(d[:k].copy()) for d in drawn] for k in ks}
    everything = [c for fits in out.values() for c in fits]
    for _ in range(max_iter):
        active = [c for c in everything if not c.settled]
        if not active:
            break
        _hard_pass(rows, active)
        for c in active:
            c.settled = c.history[-1] <= tol
    _costs(rows, everything)
    return out


def _costs(rows: Rows, clusterings: Sequence[Clustering]) -> None:
    kept = [c.centres for c in clusterings]
    _hard_pass(rows, clusterings, costs=True)
    for c, centres in zip(clusterings, kept):
        c.centres = centres
        c.history.pop()
        c.passes -= 1


def silhouettes(rows: Rows, clusterings: Sequence[Clustering]) -> list[float]:
    """Mean silhouette under squared distance of several clusterings, in two passes over the rows."""
    centres, edges = _state(clusterings)
    width = rows.width

    def sums(values: np.ndarray, totals: dict) -> None:
        for block in _blocks(values, len(centres)):
            far = squares(block, centres)
            square = (block**2).sum(axis=1)
            for c, (a, b) in enumerate(zip(edges, edges[1:])):
                hit = np.zeros((len(block), b - a))
                hit[np.arange(len(block)), far[:, a:b].argmin(axis=1)] = 1.0
                row = np.column_stack([hit.sum(axis=0), hit.T @ square, hit.T @ block]).ravel()
                totals[c] = totals[c] + row if c in totals else row

    found = rows.summed(sums, len(centres) * (width + 2))
    stats = []
    for c, (a, b) in enumerate(zip(edges, edges[1:])):
        table = np.array([found[c, j] for j in range((b - a) * (width + 2))]).reshape(b - a, width + 2)
        n = np.maximum(table[:, :1], 1)
        stats.append((table[:, 0], table[:, 1] / n[:, 0], table[:, 2:] / n))

    def score(values: np.ndarray, totals: dict) -> None:
        for block in _blocks(values, len(centres)):
            far = squares(block, centres)
            square = (block**2).sum(axis=1)[:, None]
            for c, (a, b) in enumerate(zip(edges, edges[1:])):
                size, mean_square, mean = stats[c]
                label = far[:, a:b].argmin(axis=1)
                # Mean squared distance to all members of a cluster.
                apart = np.maximum(square - 2 * block @ mean.T + mean_square, 0.0)
                own = apart[np.arange(len(block)), label] * size[label] / np.maximum(size[label] - 1, 1)
                apart[np.arange(len(block)), label] = np.inf
                apart[:, size == 0] = np.inf
                other = apart.min(axis=1)
                top = np.maximum(own, other)
                good = (size[label] > 1) & (top > 0) & np.isfinite(other)
                total = np.array([((other[good] - own[good]) / top[good]).sum()])
                totals[c] = totals[c] + total if c in totals else total

    found = rows.summed(score, len(clusterings))
    return [found[c, 0] / rows.count for c in range(len(clusterings))]


# --- soft clusterings -------------------------------------------------------------------------


def memberships(values: np.ndarray, centres: np.ndarray, fuzziness: float) -> tuple[np.ndarray, np.ndarray]:
    """Fuzzy memberships and squared distances; a row on a centre belongs to the first such centre."""
    u, far = _memberships(values, centres, fuzziness)
    return u.T, far.T


def _memberships(values: np.ndarray, centres: np.ndarray, fuzziness: float) -> tuple[np.ndarray, np.ndarray]:
    """The same with a row for each centre, so that every step runs along the values."""
    if values.shape[1] == 1:
        far = (values[:, 0] - centres) ** 2
    else:
        far = np.ascontiguousarray(squares(values, centres).T)
    with np.errstate(divide="ignore", invalid="ignore"):
        u = 1.0 / far if fuzziness == 2.0 else far ** (-1.0 / (fuzziness - 1.0))
        u /= u.sum(axis=0)
    on = np.flatnonzero((far == 0).any(axis=0))
    if len(on):
        u[:, on] = 0.0
        u[(far[:, on] == 0).argmax(axis=0), on] = 1.0
    return u, far


@dataclass
class SoftClustering(Clustering):
    """A fuzzy fit with its exponent. ``history`` holds the objective of every pass."""

    fuzziness: float = 2.0
    before: np.ndarray | None = None
    #: Whether the next pass compares the memberships of the last two sets of centres.
    compares: bool = False


#: Memberships are compared once a lower bound of their change is within so many tolerances.
_NEAR = 100.0


def fit_soft_many(rows: Rows, fits: Sequence[SoftClustering], max_iter: int = 100, tol: float = 1e-4) -> None:
    """Fuzzy C-means for all given starting centres and exponents, in passes shared by those not settled.

    A fit ends when the memberships of the last two sets of centres differ by less than ``tol`` in all
    (root of the sum of squares), or after ``max_iter`` passes; its centres are those of the last pass.

    If a centre moves by M, its memberships have changed by M * W / (m * R * sqrt(n)) at least, where W is the
    sum of its weights and R the largest distance from it. While this bound is far above ``tol`` the
    memberships are not compared, and a pass evaluates them once.
    """
    if not rows.count:
        raise ValueError("there are no rows to cluster")
    for turn in range(1, max_iter + 1):
        active = [f for f in fits if not f.settled]
        if not active:
            break
        _soft_pass(rows, active, tol, last=turn == max_iter)


def _soft_pass(rows: Rows, fits: Sequence[SoftClustering], tol: float, last: bool) -> None:
    _state(fits)
    width = rows.width
    plan = [(f.centres, f.before if f.compares else None, f.fuzziness) for f in fits]

    def run(values: np.ndarray, totals: dict) -> None:
        most = max(len(c) for c, _, _ in plan)
        for block in _blocks(values, most, _NEAR_CHUNK):
            for i, (centres, before, m) in enumerate(plan):
                u, far = _memberships(block, centres, m)
                weight = u * u if m == 2.0 else u**m
                change = ((u - _memberships(block, before, m)[0]) ** 2).sum() if before is not None else 0.0
                row = np.concatenate([[(weight * far).sum(), change], np.column_stack([weight.sum(axis=1), weight @ block]).ravel()])
                totals[i] = totals[i] + row if i in totals else row

    found = rows.summed(run, sum(2 + len(f.centres) * (width + 1) for f in fits))
    reach = None
    for i, fit in enumerate(fits):
        k = len(fit.centres)
        flat = np.array([found[i, j] for j in range(2 + k * (width + 1))])
        sums = flat[2:].reshape(k, width + 1)
        fit.cost = flat[0]
        fit.history.append(float(flat[0]))
        fit.passes += 1
        if fit.compares and np.sqrt(flat[1]) < tol:
            fit.settled = True
            continue
        if last:
            continue
        # A cluster without weight moves to the origin.
        moved = np.where(sums[:, :1] > 0, sums[:, 1:] / np.where(sums[:, :1] > 0, sums[:, :1], 1.0), 0.0)
        if fit.before is not None and not fit.compares:
            reach = _reach(rows) if reach is None else reach
            step = np.sqrt(((moved - fit.centres) ** 2).sum(axis=1))
            bound = (step * sums[:, 0]).max() / (fit.fuzziness * reach * np.sqrt(rows.count)) if reach else 0.0
            fit.compares = bool(bound <= _NEAR * tol)
        elif fit.before is None:
            fit.compares = False
        fit.before, fit.centres = fit.centres, moved


def _reach(rows: Rows) -> float:
    """The diagonal of the box around all rows, which no centre leaves."""
    if not hasattr(rows, "_diagonal"):
        ends = rows.frame.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.min("v").alias("a"), F.max("v").alias("b")).collect()
        rows._diagonal = float(np.sqrt(sum((r["b"] - r["a"]) ** 2 for r in ends)))
    return rows._diagonal
