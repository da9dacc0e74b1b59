"""One matrix for all fits of an ensemble: rows written once, exact medians, ridge logistic regression by Newton steps.

The matrix has one row per (symbol, ts) with the features as one array, the target, and the fold roles as numbers: bit k of
``sets`` says that the row trains set k, ``fold`` in which set it validates.  Set 0 are all rows; set k is fold k.  Whatever
all sets need (counts, medians, scales, the logistic fits) is computed for all of them in the same passes: every partition
gives one block of partial results of fixed size, and the blocks are merged in a tree, so that the driver receives one.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.operators.labels import FOLDS, time_folds
from barflow.session import workers_find_package
from barflow.sources.scratch import cut_lineage

BINS = 256


@dataclass(frozen=True)
class Matrix:
    """(symbol, ts, target, sets, fold, x) as a written table, with the names of the entries of x."""

    table: DataFrame
    features: list[str]
    folds: int

    def train(self, k: int) -> DataFrame:
        return self.table.where(F.getbit("sets", F.lit(k)) == 1)

    def validation(self, k: int) -> DataFrame:
        return self.table.where(F.col("fold") == k)


def values(df: DataFrame, features: list[str]) -> Column:
    """The features as one array of doubles; absent columns, NULL and NaN are NULL."""
    have = set(df.columns)
    each = [F.col(c).cast("double") if c in have else F.lit(None).cast("double") for c in features]
    return F.array(*[F.when(~F.isnan(v), v) for v in each])


def training_matrix(labelled: DataFrame, features: list[str], folds: int = FOLDS, by: str = "date") -> Matrix:
    """Write the labelled rows once, with their part in every fold; rows without a label are left out."""
    known = labelled.where("target IS NOT NULL")
    roles = time_folds(known.select("symbol", "ts", values(known, features).alias("x"), "target"), folds, by, nested=True)
    bits = F.aggregate("roles", F.lit(1), lambda a, r: a.bitwiseOR(F.when(r["role"] == "train", F.call_function("shiftleft", F.lit(1), r["fold"])).otherwise(0)))
    fold = F.get(F.filter("roles", lambda r: r["role"] == "validation"), 0)["fold"]
    table = roles.select("symbol", "ts", "target", bits.alias("sets"), fold.alias("fold"), "x")
    return Matrix(cut_lineage(table, "matrix"), list(features), folds)


def single_matrix(labelled: DataFrame, features: list[str]) -> Matrix:
    """Write the labelled rows as one training set without folds."""
    known = labelled.where("target IS NOT NULL")
    keys = [c for c in ("symbol", "ts") if c in known.columns]
    none = F.lit(None).cast("int").alias("fold")
    table = known.select(*keys, F.col("target").cast("int").alias("target"), F.lit(1).alias("sets"), none, values(known, features).alias("x"))
    return Matrix(cut_lineage(table, "matrix"), list(features), 0)


Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Block]:
    """(x with NaN for NULL, target, sets) of each batch."""
    for batch in batches:
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, width)
        yield x, batch.column("target").to_numpy(zero_copy_only=False), batch.column("sets").to_numpy(zero_copy_only=False)


def merged(m: Matrix, partial: Callable[[Iterator[Block]], list], merge: Callable[[list, list], list]) -> list:
    """`partial` of every partition, merged in two levels of tasks; the driver receives one result."""
    width = len(m.features)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = partial(_blocks(batches, width))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["part"])

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in batch.column("part"):
                found = pickle.loads(part.as_py())
                total = found if total is None else merge(total, found)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["part"])

    workers_find_package(m.table.sparkSession)
    parts = m.table.select("x", "target", "sets").mapInArrow(first, "part binary")
    groups = max(1, math.isqrt(len(m.table.inputFiles())))
    if groups > 1:
        parts = parts.repartition(groups).mapInArrow(later, "part binary")
    return pickle.loads(parts.coalesce(1).mapInArrow(later, "part binary").first().part)


def _chosen(sets: np.ndarray, k: int) -> np.ndarray:
    return (sets >> k) & 1 == 1


def _keys(x: np.ndarray) -> np.ndarray:
    """Numbers as integers of the same order; NaN is not to be asked for."""
    bits = (x + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def _value(key: int) -> float:
    bits = np.int64(key)
    return float((bits ^ ((bits >> np.int64(63)) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64))


TOP, BOTTOM = np.iinfo(np.int64).max, np.iinfo(np.int64).min


@dataclass(frozen=True)
class Summary:
    """Of every set: rows of target 0 and 1, medians (0 where all values are missing), and centre and scale of all rows."""

    classes: np.ndarray
    medians: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def class_weight(self, k: int) -> tuple[float, float]:
        """Weights that make both classes of a set count the same."""
        total = self.classes[k].sum()
        return tuple(float(total / (2 * c)) if c else 1.0 for c in self.classes[k])


def summary(m: Matrix) -> Summary:
    """One pass for counts, limits and scales, then histogram passes that narrow every median down to one value.

    A pass counts the values of ``BINS`` equal parts of the interval in which a median lies (over integers in the order of
    the numbers) with their least and greatest; the part that holds the middle rank is the next interval.  A median is found
    when its interval has one value left, so the passes grow with the logarithm of the rows, and ties end them early.  Of an
    even number of values the median is the mean of the middle two.
    """
    many, width = m.folds + 1, len(m.features)

    def first(blocks: Iterator[Block]) -> list:
        classes, count = np.zeros((many, 2), np.int64), np.zeros((many, width), np.int64)
        low, high = np.full((many, width), TOP), np.full((many, width), BOTTOM)
        moments = np.zeros((3, width))
        for x, target, sets in blocks:
            missing = np.isnan(x)
            keys = _keys(x)
            filled = np.where(missing, 0.0, x)
            with np.errstate(over="ignore"):
                moments += [(~missing).sum(axis=0), filled.sum(axis=0), (filled**2).sum(axis=0)]
            for k in range(many):
                rows = _chosen(sets, k)
                classes[k] += np.bincount(target[rows].astype(np.int64), minlength=2)[:2]
                count[k] += (~missing[rows]).sum(axis=0)
                if rows.any():
                    low[k] = np.minimum(low[k], np.where(missing[rows], TOP, keys[rows]).min(axis=0))
                    high[k] = np.maximum(high[k], np.where(missing[rows], BOTTOM, keys[rows]).max(axis=0))
        return [classes, count, low, high, moments]

    add = lambda a, b: [a[0] + b[0], a[1] + b[1], np.minimum(a[2], b[2]), np.maximum(a[3], b[3]), a[4] + b[4]]
    classes, count, low, high, (n, total, squares) = merged(m, first, add)
    n = np.maximum(n, 1)
    with np.errstate(over="ignore", invalid="ignore"):
        spread = np.nan_to_num(np.sqrt(np.maximum(squares / n - (total / n) ** 2, 0.0)), posinf=0.0)

    rank = np.maximum(count - 1, 0) // 2  # of the lower middle value, among those of the interval
    upper = np.full((many, width), TOP)  # key of the upper middle value, where it lies beyond the interval
    single = count % 2 == 1
    upper[single] = BOTTOM  # not needed
    while (open_ := (low < high) & (count > 0)).any():
        step = ((high.astype(object) - low) // BINS + 1)
        steps = np.where(open_, step, 1).astype(np.uint64)

        def histogram(blocks: Iterator[Block], low=low, high=high, steps=steps, open_=open_) -> list:
            counts = np.zeros((many, width, BINS), np.int64)
            least, most = np.full((many, width, BINS), TOP), np.full((many, width, BINS), BOTTOM)
            for x, _, sets in blocks:
                keys, missing = _keys(x), np.isnan(x)
                for k in range(many):
                    rows = _chosen(sets, k)
                    for j in np.flatnonzero(open_[k]):
                        v = keys[rows & ~missing[:, j], j]
                        v = v[(v >= low[k, j]) & (v <= high[k, j])]
                        if len(v):
                            at = ((v.astype(np.uint64) - np.uint64(low[k, j].astype(np.uint64))) // steps[k, j]).astype(np.int64)
                            counts[k, j] += np.bincount(at, minlength=BINS)
                            np.minimum.at(least[k, j], at, v)
                            np.maximum.at(most[k, j], at, v)
            return [counts, least, most]

        both = lambda a, b: [a[0] + b[0], np.minimum(a[1], b[1]), np.maximum(a[2], b[2])]
        counts, least, most = merged(m, histogram, both)
        for k, j in zip(*np.nonzero(open_)):
            below = np.cumsum(counts[k, j])
            at = int(np.searchsorted(below, rank[k, j], side="right"))
            after = rank[k, j] + 1
            if upper[k, j] == TOP and after >= below[at] and after < below[-1]:
                upper[k, j] = least[k, j, int(np.searchsorted(below, after, side="right"))]
            rank[k, j] -= below[at] - counts[k, j, at]
            low[k, j], high[k, j] = least[k, j, at], most[k, j, at]
    medians = np.zeros((many, width))
    for k, j in zip(*np.nonzero(count)):
        a = _value(low[k, j])
        medians[k, j] = a if upper[k, j] in (TOP, BOTTOM) else (a + _value(upper[k, j])) / 2.0
    return Summary(classes, medians, total / n, np.where(spread > 0, spread, 1.0))


def filled(x: Column, medians: list[float]) -> Column:
    """The array with medians in place of NULL, followed by a 0/1 flag for each missing value."""
    known = F.zip_with(x, F.lit([float(v) for v in medians]), lambda v, fill: F.coalesce(v, fill))
    return F.concat(known, F.transform(x, lambda v: v.isNull().cast("double")))


@dataclass(frozen=True)
class Logistic:
    """Coefficients of the filled array and the intercept."""

    coefficients: np.ndarray
    intercept: float
    passes: int = 0

    def probability(self, inputs: Column) -> Column:
        products = F.zip_with(inputs, F.lit([float(c) for c in self.coefficients]), lambda a, b: a * b)
        return 1.0 / (1.0 + F.exp(-F.aggregate(products, F.lit(float(self.intercept)), lambda a, v: a + v)))


def fit_logistic(m: Matrix, s: Summary, inverse_penalty: float, sets: list[int], tolerance: float = 1e-8, most: int = 60) -> dict[int, Logistic]:
    """Ridge logistic regressions of several sets at once, with balanced classes: sum of losses plus |w|^2 / (2 C).

    The penalty is on the coefficients of the unscaled features, the intercept is free.  The features are nearly collinear, so
    gradient methods take over a thousand passes; a Newton step takes gradient and curvature from one pass.  A step that does
    not lower the loss is halved.  It ends when a full step would lower the loss by less than ``tolerance`` of it.
    """
    width = len(m.features)
    size = 2 * width + 1
    ridge = np.concatenate([1.0 / (inverse_penalty * np.concatenate([s.scale, np.ones(width)]) ** 2), [0.0]])
    weights = {k: s.class_weight(k) for k in sets}
    now = {k: np.zeros(size) for k in sets}
    step: dict[int, np.ndarray] = {k: np.zeros(size) for k in sets}
    best: dict[int, float] = dict.fromkeys(sets, math.inf)
    share = dict.fromkeys(sets, 1.0)
    passes = dict.fromkeys(sets, 0)
    active = list(sets)

    def gather(at: dict[int, np.ndarray]) -> dict:
        def partial(blocks: Iterator[Block]) -> list:
            out = {k: [0.0, np.zeros(size), np.zeros((size, size))] for k in at}
            for x, target, member in blocks:
                missing = np.isnan(x)
                for k, w in at.items():
                    rows = _chosen(member, k)
                    if not rows.any():
                        continue
                    z = np.empty((int(rows.sum()), size))
                    z[:, :width] = (np.where(missing[rows], s.medians[k], x[rows]) - s.centre) / s.scale
                    z[:, width:-1] = missing[rows]
                    z[:, -1] = 1.0
                    y = target[rows].astype(float)
                    weight = np.where(y == 1, weights[k][1], weights[k][0])
                    margin = z @ w
                    p = 0.5 * (1.0 + np.tanh(0.5 * margin))
                    out[k][0] += float(weight @ (np.logaddexp(0.0, margin) - y * margin))
                    out[k][1] += z.T @ (weight * (p - y))
                    out[k][2] += (z * (weight * p * (1.0 - p))[:, None]).T @ z
            return [out]

        merge = lambda a, b: [{k: [u + v for u, v in zip(a[0][k], b[0][k])] for k in a[0]}]
        return merged(m, partial, merge)[0]

    while active:
        found = gather({k: now[k] + share[k] * step[k] for k in active})
        for k in list(active):
            passes[k] += 1
            w = now[k] + share[k] * step[k]
            loss = found[k][0] + 0.5 * float(ridge @ (w * w))
            if not loss < best[k] and share[k] > 1e-6 and passes[k] < most:
                share[k] /= 2
                continue
            if loss < best[k]:
                now[k], best[k] = w, loss
            gradient = found[k][1] + ridge * w
            curvature = found[k][2] + np.diag(ridge)
            curvature[np.diag_indices(size)] += 1e-10 * max(float(np.trace(curvature)) / size, 1e-300)
            step[k], share[k] = -np.linalg.solve(curvature, gradient), 1.0
            if passes[k] >= most or -float(gradient @ step[k]) <= tolerance * max(best[k], 1e-300) or w is not now[k]:
                active.remove(k)
    out = {}
    for k in sets:
        raw = now[k][:-1] / np.concatenate([s.scale, np.ones(width)])
        shift = float(raw[:width] @ s.centre)
        out[k] = Logistic(raw, float(now[k][-1]) - shift, passes[k])
    return out
