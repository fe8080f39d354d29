"""Embedding whitening by spectrum slicing.

Each entry becomes an integer, floor(`scale` * c). The statistics are over the fit list, in which each distinct vector
counts once: its size, the exact sums per dimension, and the covariance, centred before it is multiplied out, by partial
sums in each task. What leaves a task is dimensions x dimensions numbers, added up by a shuffle; the sum is the one
thing of that size that reaches the driver.

The eigenvalues of the covariance V are told apart by inertia: V - s I = L D L' (symmetric pivots of one or two rows) has as many positive
values in D as V has eigenvalues above s. Bisection by these counts isolates the k-th largest; Rayleigh quotient
iteration from inside the interval finds it with cubic convergence; and the counts on both sides of the found value
certify that it is the k-th. Where it is not, the interval is halved further. Eigenvalues that are equal as far as double precision tells
get vectors that are orthogonal to each other.

Rows whose vector is null, empty or holds null or non-finite entries are dropped. The dimension is the most frequent length
of the rest (the larger one of equally frequent ones); rows of another length are dropped too. A component without variance is left out, so a
table of one distinct vector or none gives no rows. Repeated ids and rows each get their own. Entries beyond 64 bits are cut to them. The
deviation is null where it does not fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import stored

SCALE, COMPONENTS = 256, 4
LOW, HIGH = -(2**63), 2**63 - 1
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# eigenvalues


def factor(a: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The pivot blocks of a symmetric matrix under L D L' with symmetric exchanges (Bunch and Kaufman): (rows, block)."""
    a = np.array(a, float)
    n, k, blocks = len(a), 0, []
    bound = (1 + np.sqrt(17)) / 8
    while k < n:
        size, swap = 1, k
        column = np.abs(a[k + 1 :, k])
        if len(column) and column.max() > 0:
            r = k + 1 + int(column.argmax())
            most = column.max()
            if abs(a[k, k]) < bound * most:
                row = np.abs(a[k:, r])
                row[r - k] = 0
                other = row.max()
                if abs(a[k, k]) * other >= bound * most * most:
                    pass
                elif abs(a[r, r]) >= bound * other:
                    swap = r
                else:
                    size, swap = 2, r
        to = k + size - 1
        if swap != to:
            a[[to, swap]] = a[[swap, to]]
            a[:, [to, swap]] = a[:, [swap, to]]
        end = k + size
        pivot = a[k:end, k:end].copy()
        blocks.append((size, pivot))
        if end < n and np.any(pivot):
            below = a[end:, k:end]
            a[end:, end:] -= below @ np.linalg.solve(pivot, below.T)
        k = end
    return blocks


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of v are greater than the shift."""
    found = 0
    for size, block in factor(v - shift * np.eye(len(v))):
        # a block of two rows is indefinite by the choice of pivots: one positive, one negative
        found += 1 if size == 2 else int(block[0, 0] > 0)
    return found


def leading(v: np.ndarray, wanted: int) -> list[tuple[float, np.ndarray]]:
    """The largest eigenvalues of a covariance with unit vectors, greatest first; those that are 0 to precision are left out."""
    d = len(v)
    if not d:
        return []
    tiny = np.finfo(float).eps * max(d, 8) * max(float(np.abs(v).sum(axis=1).max()), np.finfo(float).tiny)
    counts: dict[float, int] = {}

    def over(shift: float) -> int:
        if shift not in counts:
            counts[shift] = above(v, shift)
        return counts[shift]

    top = float(np.abs(v).sum(axis=1).max()) + tiny
    counts[top] = 0
    found: list[tuple[float, np.ndarray]] = []
    for k in range(1, min(wanted, over(tiny)) + 1):
        # low has at least k eigenvalues above it, high fewer
        low = max((s for s, c in counts.items() if c >= k), default=tiny)
        high = min(s for s, c in counts.items() if c < k and s >= low)
        while True:
            if (over(low) == k and over(high) == k - 1) or high - low <= tiny:
                value, vector = _rayleigh(v, (low + high) / 2, [u for e, u in found if abs(e - (low + high) / 2) <= 4 * tiny + high - low], k)
                if low - 2 * tiny <= value <= high + 2 * tiny and over(value - 4 * tiny) >= k > over(value + 4 * tiny):
                    found.append((value, vector))
                    break
                if high - low <= tiny:
                    raise ArithmeticError(f"eigenvalue {k} could not be certified")
            middle = (low + high) / 2
            low, high = (middle, high) if over(middle) >= k else (low, middle)
    return found


def _rayleigh(v: np.ndarray, shift: float, apart: list[np.ndarray], seed: int) -> tuple[float, np.ndarray]:
    """An eigenvalue near the shift with its vector, orthogonal to those of the same value found before."""
    d = len(v)
    norm = max(float(np.abs(v).max()), np.finfo(float).tiny)

    def clean(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for u in apart:
                x = x - (u @ x) * u
        return x / np.linalg.norm(x)

    def solved(at: float, x: np.ndarray) -> np.ndarray:
        try:
            y = np.linalg.solve(v - at * np.eye(d), x)
        except np.linalg.LinAlgError:
            y = np.linalg.solve(v - (at + 4 * np.finfo(float).eps * norm) * np.eye(d), x)
        return clean(y) if np.all(np.isfinite(y)) and np.any(y) else x

    x = clean(np.random.default_rng(seed).standard_normal(d))
    for _ in range(3):
        x = solved(shift, x)  # towards the eigenvalue nearest to the shift
    value, best = float(x @ v @ x), np.inf
    for _ in range(30):
        rest = float(np.linalg.norm(v @ x - value * x))
        if rest >= best / 2 or rest == 0:
            break
        best, kept = rest, (value, x)
        x = solved(value, x)
        value = float(x @ v @ x)
    value, x = kept if best < np.inf else (value, x)
    return value, x * (1.0 if x[np.abs(x).argmax()] > 0 else -1.0)


# statistics


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray  # components x dimensions
    values: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(s) / self.n for s in self.sums])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors.T / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum over the dimensions of (n x - S)^2, exact."""
        sums = np.array(self.sums, object)
        reach = self.n * float(np.abs(x).max(initial=0)) + max((abs(float(s)) for s in self.sums), default=0.0)
        if reach * reach * max(1, x.shape[1]) < 2.0**62:
            off = self.n * x - np.array(self.sums, np.int64)
            return (off * off).sum(axis=1).tolist()
        exact = (((self.n * x.astype(object) - sums) ** 2).sum(axis=1)).tolist()
        return [e if e <= HIGH else None for e in exact]


def integers(column: pa.ListArray, scale: int, d: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, integer vectors) of the fit rows: those whose vectors are whole (and of d entries)."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten()
    entries = flat.to_numpy(zero_copy_only=False)  # nulls are NaN
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    whole = (lengths > 0) & (bad[ends] == bad[ends - lengths])
    if d is None:
        return np.flatnonzero(whole), lengths
    rows = np.flatnonzero(whole & (lengths == d))
    at = (ends - lengths)[rows][:, None] + np.arange(d)
    with np.errstate(over="ignore"):
        x = np.floor(scale * entries[at])
    low, high = x <= LOW, x >= 2.0**63
    x = np.where(low | high, 0.0, x).astype(np.int64)
    return rows, np.where(high, HIGH, np.where(low, LOW, x))


def _unpacked(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, d)


def fit_list(rows: DataFrame, scale: int, d: int) -> DataFrame:
    """(x) each distinct integer vector of d entries once, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = integers(batch.column("embedding"), scale, d)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x.astype("<i8")], pa.binary())], ["x"])

    return stored(rows.select("embedding").mapInArrow(run, "x binary").distinct(), "fit-list")


def dimension(rows: DataFrame) -> int | None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, lengths = integers(batch.column("embedding"), 1)
            d, n = np.unique(lengths[whole], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(d.astype(np.int64)), pa.array(n.astype(np.int64))], ["d", "n"])

    most = rows.select("embedding").mapInArrow(run, "d long, n long").groupBy("d").agg(F.sum("n").alias("n"))
    most = most.orderBy(F.desc("n"), F.desc("d")).first()
    return most["d"] if most else None


def _added(fit: DataFrame, part, width: int) -> np.ndarray:
    """The sum over all tasks of part(integer vectors), an array of `width` rows; each row is added up by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(_unpacked(batch.column("x"), width_of(batch)))
                total = own if total is None else total + own
        if total is not None:
            row, at = np.nonzero(np.ones_like(total))
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(at), pa.array(total.ravel())], ["row", "at", "value"])

    def width_of(batch: pa.RecordBatch) -> int:
        return len(batch.column("x")[0].as_py()) // 8

    sums = fit.mapInArrow(run, "row long, at long, value double").groupBy("row", "at").agg(F.sum("value").alias("value"))
    found = np.array([(r["row"], r["at"], r["value"]) for r in sums.collect()]).reshape(-1, 3)  # dimensions x dimensions at most
    out = np.zeros((width, int(found[:, 1].max(initial=-1)) + 1))
    out[found[:, 0].astype(int), found[:, 1].astype(int)] = found[:, 2]
    return out


def _sums(fit: DataFrame, d: int) -> tuple[int, tuple[int, ...]]:
    """(number of vectors, exact sums per dimension)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unpacked(batch.column("x"), d)
            # in halves, so that no sum leaves 64 bits
            halves = [(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(d)), pa.array(halves[0]), pa.array(halves[1]), pa.array(np.full(d, len(x)))], ["at", "high", "low", "n"]
            )

    told = fit.mapInArrow(run, "at long, high long, low long, n long").groupBy("at").agg(
        *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "n"))
    )
    rows = sorted(told.collect(), key=lambda r: r["at"])  # one row per dimension
    return (int(rows[0]["n"]) if rows else 0), tuple((int(r["high"]) << 32) + int(r["low"]) for r in rows)


def fit_whitening(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> tuple[Whitening | None, int]:
    """(the statistics or None without variance, the dimension) of rows with an `embedding`."""
    d = dimension(rows)
    if d is None:
        return None, 0
    fit = fit_list(rows, scale, d)
    n, sums = _sums(fit, d)
    mean = np.array([float(s) / n for s in sums])

    def gram(x: np.ndarray) -> np.ndarray:
        off = x - mean
        return off.T @ off

    v = _added(fit, gram, d) / n
    v = (v + v.T) / 2
    pairs = leading(v, components)
    if not pairs:
        return None, d
    values, vectors = np.array([e for e, _ in pairs]), np.array([u for _, u in pairs])
    explained = values / np.trace(v)
    model = Whitening(n, sums, vectors, values, explained, 0.0)

    def outer(x: np.ndarray) -> np.ndarray:
        y = model.whiten(x)
        return np.vstack([y.T @ y, y.sum(axis=0)])

    k = len(values)
    both = _added(fit, outer, k + 1)
    centre = both[k] / n
    error = float(np.abs(both[:k] / n - np.outer(centre, centre) - np.eye(k)).max())
    return Whitening(n, sums, vectors, values, explained, error), d


def whitened(rows: DataFrame, model: Whitening, d: int, scale: int = SCALE) -> DataFrame:
    """RESULT: a row per vector and component."""
    held = rows.sparkSession.sparkContext.broadcast(model)  # components x dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        k = len(m.values)
        for batch in batches:
            at, x = integers(batch.column("embedding"), scale, d)
            ids = batch.column("vec_id").take(pa.array(np.repeat(at, k)))
            deviation = [e for e in m.deviations(x) for _ in range(k)]
            rows = len(at) * k
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(rows, m.n)), pa.array(deviation, pa.int64()),
                 pa.array(m.whiten(x).ravel()), pa.array(np.tile(m.explained, len(at))), pa.array(np.full(rows, m.identity_error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select("vec_id", "embedding").mapInArrow(run, RESULT)


def whiten(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """RESULT of all rows (vec_id, embedding), by their own statistics."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    model, d = fit_whitening(rows, components, scale)
    if model is None:
        return rows.sparkSession.createDataFrame([], RESULT)
    return whitened(rows, model, d, scale)
