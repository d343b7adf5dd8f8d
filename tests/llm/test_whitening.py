"""The incremental eigendecomposition against numpy's own, with ties, copies, odd vectors, empty tables, clashing columns."""

import math

import numpy as np
import pytest

from assayer.llm import queries, whitening

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rows", [
    np.random.default_rng(1).normal(size=(300, 20)), np.random.default_rng(2).integers(-2, 3, size=(300, 10)).astype(float),
    np.repeat(np.random.default_rng(3).normal(size=(3, 12)), 50, axis=0), np.eye(9)[np.random.default_rng(4).integers(0, 9, 200)],
    np.zeros((5, 4)), np.ones((200, 1)), np.random.default_rng(5).normal(size=(200, 2)) * [1e-9, 1e6]])
def test_rank_one_updates(rows):
    d = rows.shape[1]
    vectors, values = np.eye(d), np.zeros(d)
    for r in rows:
        vectors, values = whitening.rank_one(vectors, values, r)
    scatter = rows.T @ rows
    assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-12
    assert np.abs(vectors @ np.diag(values) @ vectors.T - scatter).max() <= 1e-10 * max(np.abs(scatter).max(), 1e-300)
    assert (np.diff(values) >= 0).all()


def test_secular_roots():
    rng = np.random.default_rng(7)
    poles, weights = np.sort(rng.normal(size=30)), rng.random(30) ** 8 + 1e-12
    base, at, _ = whitening.secular(poles, weights)
    want = np.linalg.eigvalsh(np.diag(poles) + np.outer(np.sqrt(weights), np.sqrt(weights)))
    assert np.abs(base + at - want).max() < 1e-12 * weights.sum() + 1e-13


@pytest.mark.parametrize("block", [1, 7, whitening.BLOCK])
def test_spectra_meet(spark, block):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(400, 6)) * [1, 2, 3, 4, 5, 60]).astype(int) + 1_000_000
    x[:, 2] = x[:, 1]
    table = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(37)
    found = whitening.spectrum(table, 6, block)
    y = x - x.mean(axis=0)
    assert (found.n, found.sums) == (400, x.sum(axis=0).tolist())
    scatter = y.T @ y
    assert np.abs(found.vectors @ np.diag(found.values) @ found.vectors.T - scatter).max() < 1e-9 * np.abs(scatter).max()


def plain(rows, components=16):
    """(n, deviations, eigenvalues, whitened up to sign, explained) in exact numbers and one decomposition."""
    x = [[math.floor(64 * float(e)) + 1_000_000 for e in v] for v in rows]
    fit = [list(t) for t in sorted({tuple(v) for v in x})]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[(n * e - s) / n for e, s in zip(v, sums)] for v in fit])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-12 * max(values[0], 1e-300)).sum()))
    deviations = [sum((n * e - s) ** 2 for e, s in zip(v, sums)) for v in x]
    mine = np.array([[(n * e - s) / n for e, s in zip(v, sums)] for v in x])
    return n, deviations, mine @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def held(got, rows):
    n, deviations, white, explained = plain([v for _, v in rows])
    got = sorted(got, key=lambda r: (r.vec_id, r.component))
    k = len(explained)
    assert len(got) == len(rows) * k
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    table = np.array([r.whitened for r in got]).reshape(len(rows), k)
    want = white[order]
    assert np.abs(table * np.sign((table * want).sum(axis=0)) - want).max() < 1e-8
    assert all(r.n == n and abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9 for r in got)
    assert [r.deviation for r in got[::k]] == [deviations[i] for i in order]


def test_query_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    held(queries.op12_embedding_whitening(spark, SF).collect(), rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(0)
    good = [(i, (rng.normal(size=5) * [1, 2, 3, 4, 5]).tolist()) for i in range(60)] + [(100 + i, [0.5, 0.25, 1.0, -1.0, 2.0]) for i in range(300)]
    bad = [(500, None), (501, [1.0, None, 1.0, 1.0, 1.0]), (502, [float("nan")] * 5), (503, [float("inf")] + [0.0] * 4), (504, []), (505, [1.0])]
    schema = "vec_id long, embedding array<double>, x int, n string, row string, part int, whitened string"
    df = spark.createDataFrame([(i, v, 1, "n", "r", 2, "w") for i, v in good + bad], schema).repartition(11)
    held(whitening.by_component(whitening.whiten(df)).collect(), good)
    empty = whitening.by_component(whitening.whiten(df.limit(0)))
    assert empty.count() == 0 and "whitened" in empty.columns
    assert whitening.by_component(whitening.whiten(df.where("vec_id >= 100 AND vec_id < 400"))).count() == 0  # one distinct vector
    null_id = whitening.whiten(df.withColumn("vec_id", df.vec_id * None)).count()
    assert null_id == len(good)


def test_deviation_beyond_long():
    model = whitening.Whitening(2, (2_000_000, 2_000_000), np.eye(2), np.ones(2), 2.0, 0.0)
    assert model.deviations(np.array([[1_000_000, 1_000_003], [2 ** 53, 0]])) == [36, None]
