"""Whitening of embeddings by an eigendecomposition that grows with the rows.

Entries become whole numbers x = floor(64 c) + 1000000. The fit list holds each distinct vector of them once (partial distinct before the
shuffle, so copies don't travel). Then, over the fit list:

1. Every task keeps a spectrum: count, exact sums, mean, eigenvectors and eigenvalues of its centred scatter. A block of ``block`` vectors, centred on
   its own mean, is replaced by at most d rows with the same scatter (QR), and each row, and the step between the means, is a rank-one
   update: poles with no weight or equal poles are deflated, the secular equation is solved for the others from the nearer pole, and eigenvectors come
   from the recomputed weights, so they stay orthogonal (Gu and Eisenstat). ``block=1`` updates by every vector itself.
2. Spectra meet in groups of ``FAN``, level by level, one taking up the other's eigenvectors by successive rank-one updates. One spectrum, of d x d
   numbers, reaches the driver.
3. Rayleigh-Ritz: tasks project the exactly centred vectors on that basis and add up their products; the small problem's eigenvectors turn
   the basis into components, good to double precision whatever rounding the updates left.
4. Another pass measures the covariance of the whitened fit list, whose distance from the identity is reported.

Memory of a task is a batch and two d x d matrices. Centring is exact: with S = q n + r the centred value is (x - q) - r / n.

Rows are left out if their vector is null, has a null, NaN or infinite entry, or fewer entries than the longest vector (an empty one always);
64 c is held within 2**53. Other columns, null or repeated ids, and repeated vectors don't matter: a row per input row and component is returned.
Components whose eigenvalue is zero within rounding are not returned, so one distinct vector, or an empty table, gives no rows. Equal eigenvalues have
no order of their own; theirs is the solver's. A deviation above the long range is null.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from assayer.llm import frames
from assayer.session import settled

SCALE, OFFSET = 64, 1_000_000
#: Vectors of a block, spectra merged in one task.
BLOCK, FAN = 1024, 16
_EPS = np.finfo(float).eps
_LIMIT = float(2 ** 53)


def integers(vector: Column) -> Column:
    """The whole numbers of a vector, null where an entry is missing or not finite."""
    entries = F.transform(vector, lambda e: e.cast("double") * SCALE)
    bad = F.exists(entries, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    whole = F.transform(entries, lambda e: F.floor(F.greatest(F.least(e, F.lit(_LIMIT)), F.lit(-_LIMIT))) + OFFSET)
    return F.when(~bad, whole)


# --- one spectrum -------------------------------------------------------------------------------------------------

def secular(poles: np.ndarray, weights: np.ndarray, tolerance: float = 1e-12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Roots of 1 + sum(weights / (poles - x)) = 0, one above each of the rising poles.

    Returned as the nearer pole, the distance from it, and the matrix of differences pole k - root i, which has no cancellation.
    """
    k, total = poles.size, weights.sum()
    gap = np.append(np.diff(poles), total)
    between = poles[None, :] - poles[:, None]
    index = np.arange(k)
    upper = 1.0 + (weights / (between - gap[:, None] / 2)).sum(1) < 0  # root in the upper half of its interval
    last = upper[-1]
    upper[-1] = False  # above the last pole there is none nearer
    origin = index + upper
    from_origin = between[origin]
    low, high = np.where(upper, -gap / 2, 0.0), np.where(upper, 0.0, gap / 2)
    if last:
        low[-1], high[-1] = gap[-1] / 2, gap[-1]
    below, above = poles - poles[origin], np.append(poles[1:], poles[-1] + 2 * total) - poles[origin]
    at, earlier = (low + high) / 2, np.tri(k)
    for _ in range(80):
        terms = weights / (from_origin - at[:, None])
        value = 1.0 + terms.sum(1)
        done = np.abs(value) <= tolerance * (1.0 + np.abs(terms).sum(1))
        if done.all():
            break
        slopes = terms / (from_origin - at[:, None])
        low, high = np.where(value < 0, at, low), np.where(value < 0, high, at)
        # a pole on each side with the slope of all poles of that side: a quadratic in the step
        left, right, slope_left, slope = below - at, above - at, (slopes * earlier).sum(1), slopes.sum(1)
        c = value - left * slope_left - right * (slope - slope_left)
        a, b = (left + right) * value - left * right * slope, left * right * value
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
        with np.errstate(all="ignore"):
            step = at + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        inside = (step > low) & (step < high)
        at = np.where(done, at, np.where(inside, step, (low + high) / 2))
    return poles[origin], at, from_origin - at[:, None]


def rank_one(vectors: np.ndarray, values: np.ndarray, added: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvectors (columns) and rising eigenvalues after adding the outer product of ``added``."""
    z = vectors.T @ added
    size = z @ z
    small = 8 * _EPS * max(values[-1], size)
    if size == 0.0:
        return vectors, values
    close = np.diff(values) <= small
    if close.any():  # within equal poles a reflection leaves one weight
        edges = np.flatnonzero(np.diff(np.concatenate([[False], close, [False]])))
        for first, past in zip(edges[::2], edges[1::2] + 1):
            w = z[first:past].copy()
            norm = np.sqrt(w @ w)
            if norm > 0.0:
                to = -np.copysign(norm, w[-1])
                w[-1] -= to
                vectors[:, first:past] -= np.outer(vectors[:, first:past] @ w, 2.0 * w / (w @ w))
                z[first:past] = 0.0
                z[past - 1] = to
    live = np.flatnonzero(np.abs(z) * np.sqrt(size) > small)
    if not live.size:
        return vectors, values
    poles = values[live]
    base, at, apart = secular(poles, z[live] ** 2)
    between = poles[:, None] - poles[None, :]
    between.flat[::live.size + 1] = 1.0
    weight = np.sqrt(np.abs(np.prod(apart / between, axis=0))) * np.sign(z[live])
    turn = weight / apart
    turn /= np.sqrt((turn * turn).sum(1))[:, None]
    values = values.copy()
    values[live] = base + at
    if live.size == z.size:
        vectors = vectors @ turn.T
    else:
        vectors[:, live] = vectors[:, live] @ turn.T
    if (np.diff(values) < 0).any():
        order = np.argsort(values, kind="stable")
        vectors, values = vectors[:, order], values[order]
    return vectors, values


class Spectrum:
    """Count, mean and eigendecomposition of the centred scatter of the vectors taken up so far."""

    def __init__(self, d: int):
        self.n, self.sums, self.mean = 0, [0] * d, np.zeros(d)
        self.vectors, self.values = np.eye(d), np.zeros(d)

    def take(self, n: int, mean: np.ndarray, rows: np.ndarray) -> None:
        """Add ``n`` vectors by their mean and rows of the same centred scatter."""
        apart = np.sqrt(self.n * n / (self.n + n)) * (mean - self.mean)
        for row in (*rows, apart):
            self.vectors, self.values = rank_one(self.vectors, self.values, row)
        self.mean = self.mean + (mean - self.mean) * (n / (self.n + n))
        self.n += n

    def take_block(self, x: np.ndarray) -> None:
        y = (x - OFFSET).astype(float)
        mean = y.mean(axis=0)
        y -= mean
        self.take(len(y), mean, np.linalg.qr(y, mode="r") if len(y) > y.shape[1] else y if len(y) > 1 else y[:0])
        exact = x.astype(object) if np.abs(x).max() >= 2 ** 62 // len(x) else x
        self.sums = [a + int(b) for a, b in zip(self.sums, exact.sum(axis=0))]

    def take_spectrum(self, other: "Spectrum") -> None:
        self.take(other.n, other.mean, (other.vectors * np.sqrt(np.maximum(other.values, 0.0))).T)
        self.sums = [a + b for a, b in zip(self.sums, other.sums)]

    def row(self, part: int) -> pa.RecordBatch:
        return frames.batch(part=np.array([part]), n=np.array([self.n]), sums=[json.dumps(self.sums)],
                            numbers=[np.concatenate([self.mean, self.values, self.vectors.ravel()])])

    @classmethod
    def of(cls, row: dict) -> "Spectrum":
        made = cls(0)
        made.n, made.sums, numbers = row["n"], json.loads(row["sums"]), np.array(row["numbers"])
        d = len(made.sums)
        made.mean, made.values, made.vectors = numbers[:d], numbers[d:2 * d], numbers[2 * d:].reshape(d, d)
        return made


_SPECTRUM = "part long, n long, sums string, numbers array<double>"


def matrices(batches: Iterator[pa.RecordBatch], d: int, most: int = 1 << 14) -> Iterator[np.ndarray]:
    """The vectors ``x`` of Arrow batches as matrices of bounded size."""
    for batch in batches:
        if batch.num_rows:
            flat, _ = frames.flat(batch.column("x"))
            x = flat.reshape(-1, d)
            yield from (x[i:i + most] for i in range(0, len(x), most))


def _levels(parts: DataFrame, schema: str, merge: Callable[[pa.Table], pa.RecordBatch]) -> dict | None:
    """One row from a row per task, merged ``FAN`` at a time."""
    parts = settled(parts)
    left = parts.agg(F.max("part")).first()[0]
    if left is None:
        return None

    def grouped(table):
        return pa.Table.from_batches([merge(table)])

    while left > 0:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part").applyInArrow(grouped, schema)
        left //= FAN
    return parts.first().asDict()


def spectrum(fit: DataFrame, d: int, block: int = BLOCK) -> Spectrum | None:
    """The spectrum of a table of vectors ``x``, None if it has no rows."""
    def grow(batches):
        state, waiting, held = Spectrum(d), [], 0
        for x in matrices(batches, d, block):
            waiting.append(x)
            held += len(x)
            if held >= block:
                all_ = np.concatenate(waiting)
                state.take_block(all_[:block])
                waiting, held = [all_[block:]], held - block
        if held:
            state.take_block(np.concatenate(waiting))
        if state.n:
            yield state.row(TaskContext.get().partitionId())

    def merge(table):
        rows = sorted(table.to_pylist(), key=lambda r: -r["n"])
        state = Spectrum.of(rows[0])
        for r in rows[1:]:
            state.take_spectrum(Spectrum.of(r))
        return state.row(rows[0]["part"])

    found = _levels(fit.mapInArrow(grow, _SPECTRUM), _SPECTRUM, merge)
    return Spectrum.of(found) if found else None


# --- components ---------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Whitening:
    """n vectors with sums S; components are columns, with falling eigenvalues of the covariance."""
    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float

    def offsets(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array([s // self.n for s in self.sums], np.int64), np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole, rest = self.offsets()
        return (x - whole) - rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S) squared."""
        whole, rest = self.offsets()
        apart = x - whole
        most = (int(np.abs(apart).max(initial=0)) + 1) * self.n
        if most * most * x.shape[1] < 2 ** 63:
            t = apart * self.n - rest
            return (t * t).sum(axis=1).tolist()
        t = apart.astype(object) * self.n - rest.astype(object)
        return [v if v < 2 ** 63 else None for v in (t * t).sum(axis=1).tolist()]


def _products(fit: DataFrame, d: int, project: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums, and sums of products, of the projected vectors."""
    def add(batches):
        sums, products = 0.0, 0.0
        for x in matrices(batches, d):
            p = project(x)
            sums, products = sums + p.sum(axis=0), products + p.T @ p
        if not np.isscalar(sums):
            yield frames.batch(part=np.array([TaskContext.get().partitionId()]), sums=[sums], products=[products.ravel()])

    def merge(table):
        rows = table.sort_by("part").to_pylist()
        return frames.batch(part=np.array([rows[0]["part"]]), sums=[np.sum([r["sums"] for r in rows], axis=0)],
                            products=[np.sum([r["products"] for r in rows], axis=0)])

    schema = "part long, sums array<double>, products array<double>"
    found = _levels(fit.mapInArrow(add, schema), schema, merge)
    sums = np.array(found["sums"])
    return sums, np.array(found["products"]).reshape(sums.size, sums.size)


def fit(df: DataFrame, vector: str = "embedding", components: int = 16, block: int = BLOCK) -> tuple[DataFrame, Whitening | None]:
    """Rows that can be whitened, as (row: all columns, x), and the whitening of their distinct vectors (None without any)."""
    rows = df.select(F.struct(*df.columns).alias("row"), integers(F.col(vector)).alias("x")).where("x IS NOT NULL")
    d = rows.agg(F.max(F.size("x"))).first()[0] or 0
    rows = rows.where(F.size("x") == F.lit(d)).where(F.size("x") > 0)
    if not d:
        return rows, None
    distinct = settled(rows.select("x").distinct())
    grown = spectrum(distinct, d, block)
    basis, _ = np.linalg.qr(grown.vectors)
    start = Whitening(grown.n, tuple(grown.sums), basis, np.ones(d), 0.0, 0.0)
    _, products = _products(distinct, d, lambda x: start.centred(x) @ basis)
    values, turn = np.linalg.eigh(products / grown.n)
    values, turn = values[::-1], turn[:, ::-1]
    some = int((values > 16 * d * _EPS * values[0]).sum()) if values[0] > 0 else 0
    some = min(some, components)
    found = Whitening(grown.n, tuple(grown.sums), basis @ turn[:, :some], values[:some], float(values.sum()), 0.0)
    if not some:
        return rows, None
    sums, products = _products(distinct, d, found.whitened)
    error = np.abs(products / found.n - np.outer(sums, sums) / found.n ** 2 - np.eye(some)).max()
    return rows, Whitening(found.n, found.sums, found.components, found.eigenvalues, found.trace, float(error))


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16, block: int = BLOCK) -> DataFrame:
    """(vec_id, n, deviation, whitened), a row per row that can be whitened; whitened is an array with an entry per component."""
    rows, model = fit(df, vector, components, block)
    rows = rows.select(F.col(f"row.`{key}`").alias("vec_id"), "x")
    schema = f"vec_id {df.schema[key].dataType.simpleString()}, n long, deviation long, whitened array<double>"
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    d = len(model.sums)

    def apply(batches):
        for batch in batches:
            ids, at = batch.column("vec_id"), 0
            for x in matrices([batch], d):
                w = model.whitened(x)
                yield frames.batch(vec_id=ids.slice(at, len(x)), n=np.full(len(x), model.n), deviation=pa.array(model.deviations(x), pa.int64()),
                                   whitened=frames.lists(w.ravel(), np.full(len(x), w.shape[1])))
                at += len(x)

    out = rows.mapInArrow(apply, schema)
    return out.withColumn("explained", F.array(*[F.lit(float(v / model.trace)) for v in model.eigenvalues])).withColumn(
        "identity_error", F.lit(model.identity_error))


def by_component(whitened: DataFrame) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row per row and component, numbered from 1."""
    if "explained" not in whitened.columns:
        return whitened.select("vec_id", F.lit(1).alias("component"), "n", "deviation", F.lit(0.0).alias("whitened"),
                               F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"))
    each = F.posexplode(F.arrays_zip("whitened", "explained"))
    return whitened.select("vec_id", "n", "deviation", "identity_error", each.alias("at", "one")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("one.whitened").alias("whitened"),
        F.col("one.explained").alias("explained"), "identity_error")
