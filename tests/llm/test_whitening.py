import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import queries, whitening


def grid(vector):
    if not vector or any(c is None or not math.isfinite(c) for c in vector):
        return None
    return tuple(math.floor(64 * float(c)) + 1_000_000 for c in vector)


def checked(found, rows, components=16):
    """Each figure against numpy on the distinct vectors; vectors up to their sign."""
    vectors = {}
    for vec_id, vector in rows:
        if (x := grid(vector)) is not None:
            vectors.setdefault(vec_id, []).append(x)
    fit = sorted({x for own in vectors.values() for x in own})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums, strict=True)] for x in fit])
    covariance = y.T @ y / n
    values = np.linalg.eigvalsh(covariance)[::-1]
    k = min(components, int((values > 1e-12 * values[0]).sum()))
    total = sum(map(len, vectors.values()))
    assert len(found) == total * k
    per_vector = {}
    for r in found:
        per_vector.setdefault(r.vec_id, []).append(r)
    assert set(per_vector) == set(vectors)
    w = {}
    for vec_id, own in per_vector.items():
        deviations = sorted(sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for x in vectors[vec_id])
        assert sorted(r.deviation for r in own) == sorted(d for d in deviations for _ in range(k))
        assert sorted(r.component for r in own) == sorted([*range(1, k + 1)] * len(vectors[vec_id]))
        w[vec_id] = [r.whitened for r in sorted(own, key=lambda r: r.component)]
    for r in found:
        assert r.n == n and r.explained == pytest.approx(values[r.component - 1] / np.trace(covariance), rel=1e-9)
        assert r.identity_error <= 1e-9
    single = [vec_id for vec_id, own in vectors.items() if len(own) == 1]
    place = {x: i for i, x in enumerate(fit)}
    mine = np.array([w[i] for i in single])
    rows_of = y[[place[vectors[i][0]] for i in single]]
    # y = sum over components of w * sqrt(e) * axis, so the axes follow by regression and must be eigenvectors.
    axes = np.linalg.lstsq(rows_of, mine, rcond=None)[0] * np.sqrt(values[:k])
    if len(single) > y.shape[1]:
        assert np.abs(covariance @ axes - axes * values[:k]).max() <= 1e-9 * values[0]
    assert np.allclose(mine, rows_of @ (axes / np.sqrt(values[:k])), atol=1e-9)


def test_query_equals_plain_algebra(spark, sf_check):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_check}/embeddings.parquet").collect()]
    found = queries.op12_whitening(spark, sf_check)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    checked(found.collect(), rows)


def run(spark, rows, kind="array<float>", **options):
    table = spark.createDataFrame(rows, f"vec_id bigint, embedding {kind}").withColumns({"x": F.lit("clash"), "rows": F.lit(0)})
    return whitening.whiten(table, **options).collect()


def test_defined_cases(spark, few_partitions):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(size=5) * [4, 3, 2, 1, 1]]) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(500)]  # copies count once
    bad = [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0]), (903, [float("nan")] * 5), (904, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (905, [1.0, 2.0])]
    found = run(spark, rows + bad, "array<double>")
    checked(found, rows)
    assert {r.vec_id for r in found} == {i for i, _ in rows}
    assert run(spark, []) == [] and run(spark, bad[:5], "array<double>") == []
    assert run(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []  # one distinct vector has no variance
    flat = run(spark, [(i, [float(i), 7.0, 2.0 * i]) for i in range(9)])
    assert {r.component for r in flat} == {1} and all(r.explained == pytest.approx(1) for r in flat)
    assert len(run(spark, [(None, [1.0, 2.0]), (None, [3.0, -2.0])])) == 2


def test_large_deviations_stay_exact(spark, few_partitions):
    rows = [(i, [float(2**12 * ((i * 7) % 11)), float(i), -1.5e4 * i]) for i in range(30)]
    checked(run(spark, rows, "array<double>"), rows)
    assert any(r.deviation is None for r in run(spark, [(i, [1e14 * i, 1.0]) for i in range(40)], "array<double>"))


@pytest.mark.parametrize("size,count", [(64, 500), (200, 3000), (5, 40), (16, 300), (40, 10)])
def test_jacobi_davidson_reaches_double_precision(size, count):
    rng = np.random.default_rng(size)
    x = rng.normal(size=(count, size)) * np.linspace(3, 1, size)
    x -= x.mean(axis=0)
    v = x.T @ x / count
    passes = []

    def apply(u):
        passes.append(u.shape[1])
        return v @ u

    values, axes = whitening.jacobi_davidson(apply, size, 16)
    assert np.abs(values - np.linalg.eigvalsh(v)[::-1][:16]).max() <= 1e-13 * values[0]
    assert np.linalg.norm(v @ axes - axes * values, axis=0).max() <= 4 * size * np.finfo(float).eps * values[0]
    assert np.abs(axes.T @ axes - np.eye(axes.shape[1])).max() <= 1e-13
    assert len(passes) < 150


def test_equal_eigenvalues(spark):
    values, axes = whitening.jacobi_davidson(lambda u: 3.0 * u, 40, 16)
    assert np.allclose(values, 3) and np.allclose(axes.T @ axes, np.eye(16))


def test_minres_solves_a_projected_equation():
    rng = np.random.default_rng(8)
    a = rng.normal(size=(30, 30))
    a = a + a.T
    q = np.linalg.qr(rng.normal(size=(30, 4)))[0]
    project = lambda x: x - q @ (q.T @ x)
    right = project(rng.normal(size=(30, 3)))
    shifts = np.array([0.3, -2.0, 5.0])
    x = whitening.minres(lambda u: a @ u, shifts, project, right, 120, 1e-12)
    assert np.abs(project(a @ x - x * shifts) - right).max() < 1e-8
    assert np.abs(q.T @ x).max() < 1e-8
