"""Isolation forest: A-IF-FIT and A-IF-SCORE.

Each tree sees a fixed-size subsample, so trees are small however large the
table is. Rows choose their trees by hash; one task grows one tree from its few
thousand rows. Trees are full binary layouts, so scoring is a fixed number of
vectorised steps per batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayer.operators.features import FEATURES
from assayer.operators.identity import POSITION
from assayer.session import spread

_EULER = 0.5772156649015329
_TREE = "tree int, feature binary, threshold binary, path binary"


@dataclass(frozen=True)
class ForestConfig:
    """Ensemble and subsample size."""

    trees: int = 200
    sample: int = 8192
    seed: int = 42


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Average path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=np.float64)
    big = np.maximum(n, 3.0)
    long = 2.0 * (np.log(big - 1.0) + _EULER) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


def depth_for(sample: int) -> int:
    return max(1, math.ceil(math.log2(max(2, sample))))


def grow_tree(x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grow one tree level by level; a node splits a random feature that varies in it."""
    size = 2 ** (depth + 1) - 1
    feature = np.zeros(size, dtype=np.int16)
    threshold = np.full(size, np.inf)
    path = np.zeros(size, dtype=np.float32)
    split = np.zeros(size, dtype=bool)
    node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    for level in range(depth + 1):
        if not len(rows):
            break
        order = np.argsort(node[rows], kind="stable")
        rows = rows[order]
        here, starts, counts = np.unique(node[rows], return_index=True, return_counts=True)
        path[here] = level + mean_path(counts)
        if level == depth:
            break
        low = np.minimum.reduceat(x[rows], starts, axis=0)
        high = np.maximum.reduceat(x[rows], starts, axis=0)
        varies = high > low
        chosen = np.where(varies, rng.random(varies.shape), -1.0).argmax(axis=1)
        parts = varies.any(axis=1)
        at = np.arange(len(here))
        a, b = low[at, chosen], high[at, chosen]
        feature[here[parts]] = chosen[parts]
        cut = a + rng.random(len(here)) * (b - a)
        threshold[here[parts]] = np.where(cut > a, cut, b)[parts]
        split[here[parts]] = True
        rows = rows[np.repeat(parts, counts)]
        at_node = node[rows]
        node[rows] = 2 * at_node + 1 + (x[rows, feature[at_node]] >= threshold[at_node])
    for level in range(depth):  # leaves above the last level pass their length down
        ids = np.arange(2**level - 1, 2 ** (level + 1) - 1)
        ids = ids[~split[ids]]
        path[2 * ids + 1] = path[2 * ids + 2] = path[ids]
    return feature, threshold, path


@dataclass(frozen=True, eq=False)
class ForestModel:
    """All trees as arrays of one row per tree."""

    feature: np.ndarray
    threshold: np.ndarray
    path: np.ndarray
    sample: int
    depth: int
    name = "isolation_forest"

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``score`` in (0, 1); higher means more anomalous.

        The trees are broadcast: 2^(depth+1) nodes each, fixed by the configuration.
        """
        shared = df.sparkSession.sparkContext.broadcast((self.feature, self.threshold, self.path))
        depth, norm = self.depth, float(mean_path(self.sample)) or 1.0

        @F.pandas_udf("double")
        def anomaly(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            feature, threshold, path = shared.value
            for values in batches:
                if not len(values):
                    yield pd.Series([], dtype="float64")
                    continue
                x = np.stack(values.to_numpy()).astype(np.float64)
                at = np.arange(len(x))
                total = np.zeros(len(x))
                for t in range(len(feature)):
                    node = np.zeros(len(x), dtype=np.int64)
                    for _ in range(depth):
                        node = 2 * node + 1 + (x[at, feature[t][node]] >= threshold[t][node])
                    total += path[t][node]
                yield pd.Series(np.exp2(-(total / len(feature)) / norm))

        return spread(df).withColumn("score", anomaly(F.col(FEATURES)))


def _uniform(h: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from row hashes and salts."""
    x = h ^ (salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(12)).astype(np.float64) / 2.0**52 + 2.0**-53


def tree_samples(df: DataFrame, config: ForestConfig, rows: int) -> tuple[DataFrame, int]:
    """(tree, draw, features) with at least the sample size per tree, and that size.

    Every tree draws from all rows. A row's trees are found by geometric skips
    from one to the next, so the work is the rows plus the rows drawn.
    """
    sample, trees = min(config.sample, rows), config.trees
    rate = min(1.0, (sample + 10 * math.sqrt(sample) + 20) / max(1, rows))
    rest = math.log1p(-rate) if rate < 1.0 else -math.inf
    seeded = df.select(FEATURES, F.xxhash64(POSITION, F.lit(config.seed)).alias("h"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column("h").to_numpy().view(np.uint64)
            row, tree = np.arange(len(h)), np.full(len(h), -1)
            while len(row):
                skip = np.floor(np.log(_uniform(h[row], 2 * tree + 3)) / rest)
                tree = tree + 1 + np.minimum(skip, trees).astype(np.int64)
                row, tree = row[tree < trees], tree[tree < trees]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tree.astype(np.int32)), pa.array(_uniform(h[row], 2 * tree + 2)),
                     b.column(FEATURES).take(pa.array(row))], ["tree", "draw", FEATURES])

    kind = df.schema[FEATURES].dataType.simpleString()
    return seeded.mapInArrow(draw, f"tree int, draw double, {FEATURES} {kind}"), sample


def fit_forest(df: DataFrame, config: ForestConfig = ForestConfig(), rows: int | None = None) -> ForestModel:
    """Grow all trees; each group handed to Python holds one subsample."""
    rows = df.count() if rows is None else rows
    samples, size = tree_samples(spread(df), config, rows)
    depth, seed = depth_for(size), config.seed

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("draw").head(size)
        tree = int(pdf["tree"].iloc[0])
        parts = grow_tree(np.stack(pdf[FEATURES].to_numpy()).astype(np.float64), depth,
                          np.random.default_rng([seed, tree]))
        return pd.DataFrame({"tree": [tree], **{n: [p.tobytes()] for n, p in
                                                zip(("feature", "threshold", "path"), parts)}})

    trees = samples.groupBy("tree").applyInPandas(grow, _TREE).orderBy("tree").collect()
    return ForestModel(
        np.stack([np.frombuffer(t["feature"], dtype=np.int16) for t in trees]),
        np.stack([np.frombuffer(t["threshold"], dtype=np.float64) for t in trees]),
        np.stack([np.frombuffer(t["path"], dtype=np.float32) for t in trees]), size, depth)
