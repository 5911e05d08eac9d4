"""Whitening of vectors: eigenvectors of their covariance in single precision, refined by multiplications in a higher one.

Spark computes the sums and the covariance; only matrices of the vectors' width reach the driver. There the covariance
is decomposed in float32 and the eigenvectors are corrected by Ogita-Aishima steps in extended precision: from
``R = I - X'X`` and ``S = X'AX`` follows a correction that squares the error. Two eigenvalues nearer to each other than the
error of the step can't be told apart by it; those form a cluster, whose vectors are turned by a decomposition of the small
matrix ``X_c'(A - mu I)X_c``, in which the cluster's differences are all there is.
"""

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
STEPS = 40  # at most; the error is squared in each
GATHERED = 64 << 20  # bytes of partial matrices that reach the driver, about
_LARGEST = float(1 << 62)
_HIGH = np.longdouble


def fixed_point(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(id, x): each entry c as floor(scale * c) + shift, a long. Rows whose vector is null or holds a null, a NaN or an
    infinity are left out; products beyond 2^62 count as that bound. Missing ids stay null."""
    c = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), c.alias("c")).where(F.col("c").isNotNull())
    rows = rows.where(~F.exists("c", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    inside = lambda v: F.greatest(F.least(v * scale, F.lit(_LARGEST)), F.lit(-_LARGEST))
    return rows.select("id", F.transform("c", lambda v: F.floor(inside(v)).cast("bigint") + F.lit(shift).cast("bigint")).alias("x"))


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, entries, total) of a task; dimension -1 counts its vectors."""
    rows, entries, total = 0, [], []
    for batch in batches:
        x = batch.column(0)
        lengths, flat = np.diff(x.offsets.to_numpy()), x.flatten().to_numpy()
        rows += len(lengths)
        for width in np.unique(lengths).tolist():
            some = flat[np.repeat(lengths == width, lengths)].reshape(int((lengths == width).sum()), width)
            if width and int(np.abs(some).max()) > (1 << 62) // len(some):
                some = some.astype(object)
            for d, t in enumerate(some.sum(axis=0).tolist()):
                if d == len(total):
                    entries.append(0)
                    total.append(0)
                entries[d] += len(some)
                total[d] += t
    if rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *range(len(total))], pa.int32()), pa.array([rows, *entries], pa.int64()), pa.array(["0", *map(str, total)])],
            ["dim", "entries", "total"],
        )


def _integers(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), width)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly: in 64 bits where they hold it, else as Python integers."""
    if len(x) and max(n * max(abs(int(x.min())), abs(int(x.max()))), *map(abs, sums)) >= 1 << 61:
        return n * x.astype(object) - np.array(sums, object)
    return n * x - np.array(sums, np.int64)


def _deviations(z: np.ndarray) -> list[int | None]:
    """The exact sum of squares of each row; null where 64 bits don't hold it."""
    if z.dtype != object and (not z.size or max(abs(int(z.min())), abs(int(z.max()))) ** 2 * z.shape[1] < 1 << 63):
        return (z * z).sum(axis=1).tolist()
    return [s if s < 1 << 63 else None for s in (sum(int(v) ** 2 for v in row) for row in z.tolist())]


def _summed(rows: DataFrame, width: int, partial: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    """The sum of ``partial`` (a square matrix of ``width``) over all batches of column x: per task, then in a few
    groups of tasks, then here."""
    groups = max(1, min(16, GATHERED // (8 * width * width)))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            m = partial(batch.column(0))
            total = m if total is None else total + m
        if total is not None:
            group = TaskContext.get().partitionId() % groups
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["g", "m"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for m in batch.column(1):
                m = np.frombuffer(m.as_py())
                total = m.copy() if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    parts = rows.select("x").mapInArrow(own, "g int, m binary").repartition(groups, "g").mapInArrow(added, "m binary").collect()
    return sum((np.frombuffer(r["m"]) for r in parts), np.zeros(width * width)).reshape(width, width)


def _slices(a: np.ndarray, axis: int, bits: int) -> list[np.ndarray]:
    """Three doubles matrices that add up to ``a``, each of ``bits`` bits below the largest entry of its row or column."""
    top = np.abs(a).max(axis=axis, keepdims=True)
    unit = np.ldexp(_HIGH(1), np.frexp(np.where(top == 0, 1, top))[1])
    out, rest = [], a / unit
    for i in range(1, 4):
        part = np.rint(np.ldexp(rest, i * bits))
        rest = rest - np.ldexp(part, -i * bits)
        out.append((np.ldexp(part, -i * bits) * unit).astype(np.float64))
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` in extended precision from six double products, none of which rounds: slices are short enough for that."""
    bits = (51 - max(1, a.shape[1]).bit_length()) // 2
    left, right = _slices(a, 1, bits), _slices(b, 0, bits)
    parts = [left[i] @ right[k - i] for k in (2, 1, 0) for i in range(k + 1)]
    return sum((p.astype(_HIGH) for p in parts), np.zeros((a.shape[0], b.shape[1]), _HIGH))


def _clusters(values: np.ndarray, apart: float) -> list[np.ndarray]:
    """Places of eigenvalues, in runs of neighbours that are no further than ``apart`` from each other."""
    order = np.argsort(values)
    breaks = np.flatnonzero(np.diff(values[order]) > apart) + 1
    return [run for run in np.split(order, breaks) if len(run) > 1]


def _decomposed(a: np.ndarray, kind: type) -> np.ndarray:
    """Eigenvectors of a symmetric matrix in the given precision; scaled first, so that nothing under- or overflows."""
    top = np.abs(a).max(initial=0)
    return np.linalg.eigh((a / top if top else a).astype(kind))[1].astype(_HIGH)


def eigenvectors(a: np.ndarray, start: type = np.float32) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix, to double precision."""
    a = ((a + a.T) / 2).astype(_HIGH)
    size, unit = np.abs(a).max(initial=0), np.eye(len(a), dtype=_HIGH)
    if not size:
        return np.zeros(len(a)), unit.astype(np.float64)
    a, x = a / size, _decomposed(a, start)
    norm = np.sqrt((a * a).sum())  # of Frobenius: never below the spectral norm that the bounds ask for
    floor = len(a) * np.finfo(_HIGH).eps
    blur = norm * np.sqrt(floor)  # a step's rounding over a smaller gap would be more than the step can square away
    before = np.inf
    for _ in range(STEPS):
        r = unit - product(x.T, x)
        s = product(x.T, product(a, x))
        values = np.diag(s) / (1 - np.diag(r))
        error = np.sqrt(((s - np.diag(np.diag(s))) ** 2).sum()) + norm * np.sqrt((r * r).sum())
        apart = max(2 * error, blur)
        gaps = values[None, :] - values[:, None]
        near = np.abs(gaps) <= apart
        e = np.where(near, r / 2, (s + values * r) / np.where(near, 1, gaps))
        x, moved = x + product(x, e), np.abs(e).max()
        for run in _clusters(values, apart):
            q = x[:, run]
            small = product(q.T, product(a, q) - values[run].mean() * q)
            # vectors that already part their cluster stay: another decomposition would only turn equal values
            if np.abs(small - np.diag(np.diag(small))).max() > floor * norm:
                x[:, run] = product(q, _decomposed((small + small.T) / 2, np.float64))
                moved = 1
        # what is left is the square of the step; a step that small and no smaller than the one before is rounding
        if moved <= 2**-28 or before <= 2**-16 and moved >= before:
            break
        before = moved
    x = x + product(x, unit - product(x.T, x)) / 2
    x = x / np.sqrt((x * x).sum(axis=0))
    values = (x * product(a, x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return (values[order] * size).astype(np.float64), x[:, order].astype(np.float64)


@dataclass
class Whitener:
    """What ``fit`` learns: everything of it is of the vectors' width."""

    n: int
    sums: list[int]
    values: np.ndarray  # of the components that are kept
    vectors: np.ndarray  # a column for each of them
    trace: float
    identity_error: float

    def projected(self, z: np.ndarray) -> np.ndarray:
        """Whitened rows of z = n x - S."""
        return (z.astype(np.float64) / self.n) @ (self.vectors / np.sqrt(self.values))


def _filled(rows: DataFrame, width: int, shift: int) -> DataFrame:
    return rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(shift).cast("bigint"), F.lit(width) - F.size("x"))))


def fit(rows: DataFrame, components: int = COMPONENTS, shift: int = 1_000_000) -> Whitener | None:
    """The whitening of all vectors of ``rows`` (id, x); three passes, of which each sends matrices of the width only.

    A vector shorter than the longest one is filled up with ``shift``, the number that stands for zero. Directions
    without variance (up to rounding) are no components: one vector, or equal ones, have none. No rows: None.
    """
    found = rows.select("x").mapInArrow(_totals, "dim int, entries bigint, total string")
    found = found.groupBy("dim").agg(F.sum("entries").alias("entries"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = {r["dim"]: (r["entries"], int(r["total"])) for r in found.collect()}  # one row for each dimension
    if not found:
        return None
    n, width = found.pop(-1)[0], len(found)
    sums = [total + (n - entries) * shift for _, (entries, total) in sorted(found.items())]
    if not width:
        return Whitener(n, [], np.zeros(0), np.zeros((0, 0)), 0.0, 0.0)
    rows = _filled(rows, width, shift)

    def products(column: pa.Array) -> np.ndarray:
        z = _centred(_integers(column, width), n, sums).astype(np.float64) / n
        return z.T @ z

    covariance = _summed(rows, width, products) / n
    values, vectors = eigenvectors(covariance)
    kept = min(components, int((values > width * np.finfo(np.float64).eps * max(values[0], 0)).sum()))
    made = Whitener(n, sums, values[:kept], vectors[:, :kept], float(np.trace(covariance)), 0.0)
    if kept:

        def whitened(column: pa.Array) -> np.ndarray:
            w = made.projected(_centred(_integers(column, width), n, sums))
            w = np.hstack([np.ones((len(w), 1)), w])
            return w.T @ w

        moments = _summed(rows, kept + 1, whitened) / n
        mean = moments[0, 1:]
        made.identity_error = float(np.abs(moments[1:, 1:] - np.outer(mean, mean) - np.eye(kept)).max())
    return made


def whiten(rows: DataFrame, model: Whitener, shift: int = 1_000_000) -> DataFrame:
    """(id, deviation, whitened) for every row of ``rows`` (id, x): the exact sum of squares of n x - S (null where 64
    bits don't hold it), and the vector's components. Vectors must not be wider than those of the fit."""
    width = len(model.sums)

    @F.arrow_udf("struct<deviation:bigint,whitened:array<double>>")
    def applied(column: pa.Array) -> pa.Array:
        z = _centred(_integers(column, width), model.n, model.sums) if width else np.zeros((len(column), 0), np.int64)
        w = model.projected(z) if width else z
        ends = np.arange(len(z) + 1, dtype=np.int32) * w.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(w.astype(np.float64).ravel()))
        return pa.StructArray.from_arrays([pa.array(_deviations(z), pa.int64()), lists], ["deviation", "whitened"])

    return _filled(rows, width, shift).select("id", applied("x").alias("_w")).select("id", "_w.deviation", "_w.whitened")


def whitened_components(rows: DataFrame, components: int = COMPONENTS, shift: int = 1_000_000) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): one row for each of ``rows`` (id, x) and component.

    Null ids stay null, repeated rows count as often as they occur. No rows, or no direction with variance: no rows.
    """
    model = fit(rows, components, shift)
    kept = len(model.values) if model else 0
    names = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not kept:
        return rows.sparkSession.createDataFrame([], f"id {rows.schema['id'].dataType.simpleString()}, {names}")
    explained = F.array(*(F.lit(float(v) / model.trace) for v in model.values))
    found = whiten(rows, model, shift).select("id", "deviation", F.posexplode("whitened").alias("_k", "whitened"))
    return found.select(
        "id", (F.col("_k") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("_k")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
