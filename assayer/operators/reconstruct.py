"""Detectors that score a row by how badly it is rebuilt: A-PCA, A-AE-FIT, A-AE-SCORE, A-AE-EXPLAIN.

Scoring and explaining run on Arrow batches with the model's few thousand
numbers in the task; the data never leaves its partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from assayer.functions.hashing import drawn_below
from assayer.operators.features import FEATURES
from assayer.operators.identity import POSITION
from assayer.session import batches_by_rows

#: Rows scored at a time, so that the outputs of all layers stay in the processor's cache.
CACHED_ROWS = 2048
_EXPLANATION = "score double, errors array<double>, observed array<double>, expected array<double>"


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(np.float64) if len(values) else np.empty((0, 0))


def _flat_matrix(values: pa.ListArray) -> np.ndarray:
    """A row per list, without an object for each."""
    cells = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return cells.reshape(len(values), -1) if len(values) else np.empty((0, 0))


class Reconstruction:
    """Score = mean squared reconstruction error; higher means more anomalous."""

    name = "reconstruction"

    def rebuild(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def score(self, df: DataFrame) -> DataFrame:
        model = self

        @F.arrow_udf("double")
        def error(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for values in batches:
                x = _flat_matrix(values)
                parts = [x[i:i + CACHED_ROWS] for i in range(0, len(x), CACHED_ROWS)]
                yield pa.array(np.concatenate([np.empty(0), *[((model.rebuild(p) - p) ** 2).mean(axis=1) for p in parts]]), pa.float64())

        return df.withColumn("score", error(F.col(FEATURES)))

    def explain(self, df: DataFrame) -> DataFrame:
        """Adds score and, per feature, squared error, observed and rebuilt value."""
        model = self

        @F.pandas_udf(_EXPLANATION)
        def parts(values: pd.Series) -> pd.DataFrame:
            x = _matrix(values)
            y = model.rebuild(x) if len(x) else x
            squared = (y - x) ** 2
            return pd.DataFrame({"score": squared.mean(axis=1) if len(x) else [], "errors": list(squared),
                                 "observed": list(x), "expected": list(y)})

        explained = df.withColumn("__e", parts(F.col(FEATURES)))
        return explained.select(*[c for c in explained.columns if c != "__e"], "__e.*")


@dataclass(frozen=True, eq=False)
class PcaModel(Reconstruction):
    """The linear counterpart: projection onto the leading components."""

    components: np.ndarray
    name = "pca"

    def rebuild(self, x: np.ndarray) -> np.ndarray:
        return x @ self.components @ self.components.T


def fit_pca(df: DataFrame, k: int = 8) -> PcaModel:
    vectors = df.select(array_to_vector(F.col(FEATURES).cast("array<double>")).alias("v"))
    fitted = PCA(k=k, inputCol="v", outputCol="p").fit(vectors)
    return PcaModel(np.asarray(fitted.pc.toArray(), dtype=np.float64))


@dataclass(frozen=True)
class AutoencoderConfig:
    """Layer sizes and training settings."""

    hidden: tuple[int, ...] = (24, 16)
    latent: int = 8
    lr: float = 1e-3
    weight_decay: float = 1e-5
    batch_size: int = 2048
    max_epochs: int = 150
    patience: int = 12
    min_delta: float = 1e-5
    val_fraction: float = 0.1
    lr_factor: float = 0.5
    lr_patience: int = 5
    min_lr: float = 1e-5
    seed: int = 42
    dropout: float = 0.0
    #: Logical workers whose weights are averaged, and passes over a chunk of their rows in between. The model depends
    #: on these numbers, on the rows and on the seed, not on partitions, cores or the order in which rows arrive.
    workers: int = 8
    passes: int = 5

    def sizes(self, width: int) -> list[int]:
        return [width, *self.hidden, self.latent, *reversed(self.hidden), width]


def _shapes(sizes: list[int]) -> list[tuple[int, int]]:
    return list(zip(sizes, sizes[1:]))


def _layers(flat: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    layers, at = [], 0
    for a, b in _shapes(sizes):
        layers.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]))
        at += a * b + b
    return layers


def _linear_at(i: int, sizes: list[int]) -> bool:
    """Only the output is linear: a bounded head would clip the extremes that matter."""
    return i == len(sizes) - 2


def _forward(
    x: np.ndarray, flat: np.ndarray, sizes: list[int], drop: np.random.Generator | None = None, rate: float = 0.0
) -> tuple[list[np.ndarray], list[np.ndarray | None]]:
    """Outputs of all layers, and the mask each was multiplied with; encoder layers drop outputs while training."""
    outputs, masks = [x], []
    for i, (w, b) in enumerate(_layers(flat, sizes)):
        z = outputs[-1] @ w
        z += b
        if not _linear_at(i, sizes):
            np.maximum(z, 0.0, out=z)
        mask = None
        if drop is not None and rate > 0.0 and i < (len(sizes) - 1) // 2:
            mask = (drop.random(z.shape) >= rate).astype(z.dtype) / z.dtype.type(1.0 - rate)
            z = z * mask
        outputs.append(z)
        masks.append(mask)
    return outputs, masks


def _gradient(
    x: np.ndarray, flat: np.ndarray, sizes: list[int], drop: np.random.Generator | None = None, rate: float = 0.0
) -> tuple[float, np.ndarray]:
    outputs, masks = _forward(x, flat, sizes, drop, rate)
    delta = outputs[-1] - x
    loss = float((delta**2).mean())
    delta *= 2.0 / delta.size
    grad, ones = np.empty_like(flat), np.ones(len(x), flat.dtype)
    layers, slopes = _layers(flat, sizes), _layers(grad, sizes)
    for i in reversed(range(len(layers))):
        if masks[i] is not None:
            delta *= masks[i]
        if not _linear_at(i, sizes):
            delta *= outputs[i + 1] > 0
        w, b = slopes[i]
        np.matmul(outputs[i].T, delta, out=w)
        np.matmul(ones, delta, out=b)  # sums over rows, at a fraction of the time of sum(axis=0)
        if i:
            delta = delta @ layers[i][0].T
    return loss, grad


@dataclass
class _State:
    """Weights and Adam moments as they travel between rounds."""

    flat: np.ndarray
    first: np.ndarray
    second: np.ndarray
    step: int = 0

    def train(self, x: np.ndarray, lr: float, config: "AutoencoderConfig", sizes: list[int], drop: np.random.Generator) -> float:
        loss, grad = _gradient(x, self.flat, sizes, drop, config.dropout)
        grad = grad + config.weight_decay * self.flat
        self.step += 1
        self.first = 0.9 * self.first + 0.1 * grad
        self.second = 0.999 * self.second + 0.001 * grad**2
        mean = self.first / (1 - 0.9**self.step)
        spread = self.second / (1 - 0.999**self.step)
        self.flat = self.flat - lr * mean / (np.sqrt(spread) + 1e-8)
        return loss

    def packed(self) -> np.ndarray:
        return np.concatenate([self.flat, self.first, self.second])


def _initial(sizes: list[int], seed: int) -> _State:
    rng = np.random.default_rng(seed)
    flat = np.concatenate([
        rng.uniform(-1, 1, a * b + b) / np.sqrt(a) for a, b in _shapes(sizes)])
    return _State(flat, np.zeros_like(flat), np.zeros_like(flat))


@dataclass(frozen=True, eq=False)
class AutoencoderModel(Reconstruction):
    flat: np.ndarray
    width: int
    config: AutoencoderConfig
    best_epoch: int = 0
    history: list[tuple[int, float, float, float]] = field(default_factory=list)
    name = "autoencoder"

    def rebuild(self, x: np.ndarray) -> np.ndarray:
        return _forward(x, self.flat, self.config.sizes(self.width))[0][-1]

    def settings(self) -> dict:
        return asdict(self.config) | {"width": self.width, "best_epoch": self.best_epoch}


_ROUND = "worker int, rows bigint, loss double, val_rows bigint, val_loss double, steps bigint, state binary"
_ROUND_ARROW = pa.schema([("worker", pa.int32()), ("rows", pa.int64()), ("loss", pa.float64()), ("val_rows", pa.int64()),
                          ("val_loss", pa.float64()), ("steps", pa.int64()), ("state", pa.binary())])
_BLOCK = f"worker int, slice int, at bigint, rows bigint, {FEATURES} binary, val binary"
_BLOCK_ARROW = pa.schema([("worker", pa.int32()), ("slice", pa.int32()), ("at", pa.int64()), ("rows", pa.int64()), (FEATURES, pa.binary()),
                          ("val", pa.binary())])
#: Rows a worker holds at a time, worker results that one task adds up, and rows that one task puts in order.
CHUNK_ROWS, SUMS_PER_TASK, SLICE_ROWS = 1 << 16, 16, 1 << 19


class _Worker:
    """One logical worker's part of a round: judge the incoming weights on its held-out rows, train on the rest."""

    def __init__(
        self, worker: int, state: _State, lr: float, config: AutoencoderConfig, sizes: list[int], turn: int, trains: bool = True
    ):
        self.worker, self.sent, self.lr, self.config, self.sizes, self.trains = worker, state, lr, config, sizes, trains
        single = np.float32
        self.mine = replace(state, flat=state.flat.astype(single), first=state.first.astype(single), second=state.second.astype(single))
        self.rng = np.random.default_rng([config.seed, turn, worker])
        self.waiting: list[np.ndarray] = []
        self.held, self.rows, self.val_rows, self.loss, self.val_loss = 0, 0, 0, 0.0, 0.0

    def take(self, x: np.ndarray, held: np.ndarray) -> None:
        if held.any():
            v = x[held].astype(np.float64)
            self.val_rows += len(v)
            self.val_loss += float(((_forward(v, self.sent.flat, self.sizes)[0][-1] - v) ** 2).mean(axis=1).sum())
        x = x[~held] if self.trains else x[:0]
        while len(x):  # chunks are cut by row count, wherever the batches end
            part, x = x[:CHUNK_ROWS - self.held], x[CHUNK_ROWS - self.held:]
            self.waiting.append(part)
            self.held += len(part)
            if self.held == CHUNK_ROWS:
                self._chunk()

    def _chunk(self) -> None:
        chunk = np.concatenate(self.waiting)
        self.waiting, self.held, size = [], 0, self.config.batch_size
        for turn in range(self.config.passes):
            x = chunk.take(self.rng.permutation(len(chunk)), axis=0)
            for start in range(0, len(x), size):
                part = x[start:start + size]
                loss = self.mine.train(part, self.lr, self.config, self.sizes, self.rng)
                if turn == self.config.passes - 1:
                    self.loss += loss * len(part)
        self.rows += len(chunk)

    def result(self) -> pa.RecordBatch:
        if self.held:
            self._chunk()
        weighted = self.mine.packed().astype(np.float64) * self.rows
        return _sums_batch([(self.worker, self.rows, self.loss, self.val_rows, self.val_loss,
                             (self.mine.step - self.sent.step) * self.rows, weighted.tobytes())])


def _sums_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _ROUND_ARROW)], schema=_ROUND_ARROW)


def _round(state: _State, lr: float, config: AutoencoderConfig, sizes: list[int], turn: int, trains: bool = True):
    """A round's work on sorted blocks, or only its verdict; a partition holds whole workers, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Worker | None = None
        for batch in batches:
            for i, worker in enumerate(batch.column("worker").to_pylist()):
                if now is None or now.worker != worker:
                    if now is not None:
                        yield now.result()
                    now = _Worker(worker, state, lr, config, sizes, turn, trains)
                rows = batch.column("rows")[i].as_py()
                x = np.frombuffer(batch.column(FEATURES)[i].as_buffer(), np.float32).reshape(rows, -1)
                now.take(x, np.frombuffer(batch.column("val")[i].as_buffer(), bool))
        if now is not None:
            yield now.result()

    return run


def _summed(table: pa.Table) -> pa.Table:
    """Add up the results of several workers, in their order, so that the sum does not depend on who came first."""
    records = sorted(table.to_pylist(), key=lambda r: r["worker"])
    state = np.sum([np.frombuffer(r["state"]) for r in records], axis=0)
    sums = [sum(r[c] for r in records) for c in ("rows", "loss", "val_rows", "val_loss", "steps")]
    return pa.Table.from_batches([_sums_batch([(records[0]["worker"] // SUMS_PER_TASK, *sums, state.tobytes())])])


def _one_row(parts: DataFrame, workers: int) -> dict | None:
    """The sum over all workers, level by level; the driver reads one row."""
    while workers > 1:
        parts = parts.groupBy(F.floor(F.col("worker") / SUMS_PER_TASK)).applyInArrow(_summed, _ROUND)
        workers = -(-workers // SUMS_PER_TASK)
    rows = parts.collect()
    return rows[0].asDict() if rows else None


def dealt_to_workers(df: DataFrame, config: AutoencoderConfig) -> DataFrame:
    """(worker, slice, at, rows, features, val): each worker's rows in one partition, in an order of their own.

    Rows are put in order in slices of a worker, which follow each other in that order, and packed into blocks. Only blocks are then sorted for
    the worker, so a task sorts about ``SLICE_ROWS`` rows, or a few numbers a row, whatever the size. The order is that of two 64-bit hashes of
    the position, which stay behind with its text.
    """
    slices = max(1, -(-df.count() // (config.workers * SLICE_ROWS)))
    position, seed = F.col(POSITION).cast("string"), F.lit(config.seed)
    held = drawn_below(config.val_fraction, position, "held-out", config.seed)
    rows = df.select(FEATURES, held.alias("val"), F.xxhash64(position, seed).alias("place"), F.xxhash64(seed, position).alias("tie"))
    worker = F.pmod("place", F.lit(config.workers)).cast("int")
    share = F.floor((F.col("place").cast("double") / 2.0**64 + 0.5) * slices)  # rises with the place
    part = F.least(share, F.lit(slices - 1)).cast("int")
    # a partition is one slice of one worker
    sliced = rows.repartitionById(config.workers * slices, worker * slices + part).sortWithinPartitions("place", "tie")
    blocks = sliced.select(worker.alias("worker"), part.alias("slice"), FEATURES, "val").mapInArrow(_packed, _BLOCK)
    return blocks.repartitionById(config.workers, F.col("worker")).sortWithinPartitions("worker", "slice", "at")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one slice's rows in their order: features and held-out marks as bytes."""
    at = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        workers, slices = (batch.column(c).to_numpy() for c in ("worker", "slice"))
        x = batch.column(FEATURES).flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(batch.num_rows, -1)
        held = batch.column("val").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero((np.diff(workers) != 0) | (np.diff(slices) != 0)) + 1), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            values = [int(workers[a]), int(slices[a]), at, int(b - a), x[a:b].tobytes(), held[a:b].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _BLOCK_ARROW)], schema=_BLOCK_ARROW)
            at += 1


def fit_autoencoder(df: DataFrame, width: int, config: AutoencoderConfig = AutoencoderConfig()) -> AutoencoderModel:
    """Train by averaging: in a round every logical worker trains on its own rows, then weights are averaged.

    Rows belong to one of ``config.workers`` workers by a hash of their position. A
    round is one job over the cached features: a worker streams its rows in chunks
    and makes ``config.passes`` passes over each, so a round counts as that many
    epochs. Results are added up in levels until one row is left, which is all the
    driver reads. The held-out loss of a round is measured by the next one, on the
    averaged weights; it drives the learning rate and early stopping. Where that
    loss may end the fit it is measured alone, before anything is trained on. A
    loss within ``config.min_delta`` of zero ends it: none can be lower by that
    much, so these weights stay the best however long the fit went on.
    """
    sizes = config.sizes(width)
    state = _initial(sizes, config.seed)
    with batches_by_rows(df.sparkSession, 4 * width + 64):
        data = dealt_to_workers(df, config).persist()
        data.count()  # deals the rows out
    lr, best_loss, best, best_epoch, waited, plateau, plateau_best = config.lr, float("inf"), state, 0, 0, 0, float("inf")
    history: list[tuple[int, float, float, float]] = []
    rounds, held = -(-config.max_epochs // config.passes), 0

    def results(sent: _State, rate: float, turn: int, trains: bool) -> dict | None:
        return _one_row(data.mapInArrow(_round(sent, rate, config, sizes, turn, trains), _ROUND), config.workers)

    try:
        for turn in range(1, rounds + 2):
            last, sent, rate, epoch = turn == rounds + 1, state, lr, min(config.max_epochs, turn * config.passes)
            may_end = last or waited + config.passes >= config.patience or bool(history) and history[-1][1] <= 10 * config.min_delta
            alone = held > 0 and may_end
            got = results(sent, rate, turn, not alone)
            if got is None:
                break
            held = got["val_rows"]
            if turn > 1:  # what came back judges the weights of the round before
                val = got["val_loss"] / held if held else got["loss"] / max(1, got["rows"])
                if history:
                    history[-1] = (*history[-1][:2], float(val), lr)
                if val < best_loss - config.min_delta:
                    best_loss, best, best_epoch, waited = val, sent, history[-1][0] if history else 0, 0
                else:
                    waited += config.passes
                if val < plateau_best * (1 - 1e-4):
                    plateau_best, plateau = val, 0
                else:
                    plateau += config.passes
                if plateau > config.lr_patience:
                    lr, plateau = max(config.min_lr, lr * config.lr_factor), 0
                if waited >= config.patience or best_loss <= config.min_delta or last:
                    break
            if alone:
                got = results(sent, rate, turn, True)
            n = got["rows"]
            if n == 0:
                break
            flat, first, second = np.split(np.frombuffer(got["state"]) / n, 3)
            state = _State(flat, first, second, sent.step + max(1, round(got["steps"] / n)))
            history.append((epoch, float(got["loss"] / n), float("nan"), lr))
    finally:
        data.unpersist()
    return AutoencoderModel(best.flat, width, config, best_epoch, history)
