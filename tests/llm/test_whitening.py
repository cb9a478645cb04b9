"""Whitening against eigenvectors of the whole covariance and exact integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgrove.llm import whitening
from inkgrove.llm.common import bound_batches, table

SCHEMA = "vec_id long, embedding array<float>, n string, label int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "n", 1) for i, v in enumerate(vectors)], SCHEMA).repartition(3)


def brute(vectors, components=4):
    """Rows by (position, component), with whitened up to its sign."""
    whole = {i: [math.floor(256 * float(np.float32(c))) for c in v] for i, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = np.array(sorted(set(map(tuple, whole.values()))), dtype=float)
    n = len(fit)
    sums = [sum(int(v) for v in column) for column in fit.T]
    centred = fit - fit.mean(axis=0)
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    rows = {}
    for i, x in whole.items():
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        for k in range(min(components, len(values))):
            if values[k] > 1e-12 * values[0]:
                w = (np.array(x) - np.array(sums) / n) @ basis[:, k] / math.sqrt(values[k])
                rows[i, k + 1] = (n, deviation, w, values[k] / values.sum())
    return rows


def compare(spark, vectors, tolerance=1e-9):
    got = whitening.whiten(frame(spark, vectors))
    assert got.columns == ["vec_id", "label", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = {(r.vec_id, r.component): r for r in got.collect()}
    want = brute(vectors)
    assert rows.keys() == want.keys()
    sign = {}
    for (i, k), (n, deviation, w, explained) in want.items():
        r = rows[i, k]
        assert (r.n, r.deviation) == (n, deviation)
        assert r.explained == pytest.approx(explained, rel=1e-9)
        assert r.identity_error < 1e-9
        if abs(w) > 1e-3:
            assert sign.setdefault(k, math.copysign(1, w * r.whitened)) == math.copysign(1, w * r.whitened)
        assert abs(r.whitened) == pytest.approx(abs(w), abs=tolerance)
    return rows


def random_vectors(n, width, seed, decay=0.8):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, width)) * decay ** np.arange(width) + rng.standard_normal(width)).tolist()


@pytest.mark.parametrize("n, width, decay", [(200, 16, 0.8), (60, 30, 1.0), (12, 20, 0.9), (500, 5, 0.5), (40, 2, 1.0), (9, 1, 1.0)])
def test_random_vectors(spark, n, width, decay):
    bound_batches(spark)
    compare(spark, random_vectors(n, width, n, decay), 1e-8)


def test_given_embeddings(spark):
    rows = table(spark, "/root/testdata/sf0.001", "embeddings").orderBy("vec_id").select("embedding").collect()
    compare(spark, [r.embedding for r in rows], 1e-8)


def test_copies_and_bad_rows(spark):
    vectors = random_vectors(40, 6, 3)
    bad = [None, [None] * 6, [1.0, 2.0, math.nan, 0.0, 0.0, 0.0], [math.inf] + [0.0] * 5, [0.0, -math.inf] + [0.0] * 4]
    once = compare(spark, vectors + bad)
    again = compare(spark, vectors + bad + [vectors[0]] * 50)
    assert once[0, 1].n == again[0, 1].n == 40
    assert abs(once[7, 2].whitened) == pytest.approx(abs(again[7, 2].whitened))
    assert again[45, 1].whitened == again[0, 1].whitened


def test_small_negative_entries_and_grid_ties(spark):
    compare(spark, [[-0.001, 0.5], [0.0, 0.25], [1 / 256, -1 / 256], [0.0039, 0.9], [-0.0, 0.7]])


def test_low_rank_has_fewer_components(spark):
    base = np.array([[1.0, 2.0, 3.0, 4.0, 5.0], [2.0, 0.0, 1.0, 0.0, 1.0]])
    rng = np.random.default_rng(2)
    vectors = (rng.integers(-5, 6, (30, 2)) @ base).tolist()
    rows = compare(spark, vectors)
    assert {k for _, k in rows} == {1, 2}


def test_equal_variances(spark):
    """Repeated singular values are found as often as they occur."""
    axes = np.concatenate([np.eye(6) * s for s in (1.0, -1.0)]) * np.array([3, 3, 3, 2, 2, 1])
    found = whitening.fit(whitening.on_grid(frame(spark, axes.tolist())))
    assert found.variances / found.variances[0] == pytest.approx([1, 1, 1, 4 / 9])
    assert found.identity_error < 1e-9


def test_steep_spectrum(spark):
    rng = np.random.default_rng(8)
    vectors = (rng.standard_normal((80, 12)) * 10.0 ** -np.arange(-2, 10)).tolist()
    compare(spark, vectors, 1e-6)


def test_deviation_beyond_64_bits():
    found = whitening.Whitening(3, (0, 0), np.empty((2, 0)), np.empty(0), 0.0, 0.0)
    assert found.deviations(np.array([[1, 2], [1 << 40, 0], [1 << 29, 1]])) == [45, None, 9 * (1 << 58) + 9]


def test_no_rows_one_vector_no_entries(spark):
    for vectors in ([], [None], [[1.0, 2.0]] * 3, [[], []]):
        assert whitening.whiten(frame(spark, vectors)).collect() == []


def test_shorter_vectors_end_in_zeros(spark):
    got = whitening.whiten(frame(spark, [[1.0, 2.0, 0.0], [1.0, 2.0], [0.0, 1.0], [3.0, 0.5, 0.0]])).collect()
    by = {(r.vec_id, r.component): r for r in got}
    assert by[0, 1].whitened == by[1, 1].whitened and by[0, 1].n == 4


def test_left_vectors_stay_orthogonal(spark):
    vectors = whitening.fit_list(whitening.on_grid(frame(spark, random_vectors(300, 24, 1, 0.9))))
    trace = float(vectors.total(lambda y: np.array([np.square(y).sum()]))[0])
    values, basis = whitening.bidiagonalise(vectors, 24, trace)
    assert np.abs(basis.T @ basis - np.eye(24)).max() < 1e-12
    x = np.array([r.x for r in vectors.rows.collect()], float)
    assert values == pytest.approx(np.linalg.svd(x - x.mean(axis=0), compute_uv=False), rel=1e-9)
