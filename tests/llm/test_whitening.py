"""Whitening against the eigenvectors that numpy finds, on ordinary and on odd tables."""

import numpy as np
import pytest

from airlens.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>"


def run(spark, rows, components=16, schema=SCHEMA):
    vectors = whitening.scaled(spark.createDataFrame(rows, schema))
    fit = whitening.fit(vectors)
    model = whitening.train(fit, components)
    return fit, model, whitening.whiten(vectors, fit, model).collect()


def whole(vector):
    return [int(np.floor(np.float64(np.float32(c)) * 64)) + 1_000_000 for c in vector]


def check(rows, got, components=16):
    """``got`` against exact sums and numpy's eigenvectors."""
    xs = {i: whole(v) for i, v in rows}
    unique = np.array(sorted({tuple(x) for x in xs.values()}))
    n, total = len(unique), unique.sum(0)
    c = (unique * n - total) / n
    cov = c.T @ c / n
    e, vectors = np.linalg.eigh(cov)
    e, vectors = e[::-1], vectors[:, ::-1]
    r = min(components, int((e > 1e-10 * e[0]).sum()))
    assert {row.component for row in got} == set(range(1, r + 1))
    assert len(got) == len(rows) * r
    signs = {}
    for row in got:
        x = np.array(xs[row.vec_id])
        assert row.n == n
        assert row.deviation == sum(int(n * int(a) - int(s)) ** 2 for a, s in zip(x, total))
        k = row.component - 1
        want = float(((x * n - total) / n) @ vectors[:, k] / np.sqrt(e[k]))
        sign = signs.setdefault(k, np.sign(want * row.whitened) if abs(want) > 1e-6 else 1)
        assert row.whitened * sign == pytest.approx(want, abs=1e-6)
        assert row.explained == pytest.approx(e[k] / np.trace(cov), rel=1e-9)
        assert row.identity_error <= 1e-9


def test_components_are_those_of_the_covariance(spark):
    rng = np.random.default_rng(1)
    mix = rng.standard_normal((24, 24))
    rows = [(i, [float(c) for c in np.float32(rng.standard_normal(24) @ mix)]) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)]  # copies count once in the fit, each has its rows
    fit, model, got = run(spark, rows)
    assert fit.n == 700
    check(rows, got)
    assert np.abs(model.components.T @ model.components - np.eye(16)).max() < 1e-12


def test_it_stops_early_where_the_spectrum_falls(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((3, 80)) * np.array([[400], [90], [30]])
    rows = [(i, [float(c) for c in np.float32(rng.standard_normal(3) @ base + rng.standard_normal(80) * 0.05)]) for i in range(500)]
    _, model, got = run(spark, rows, 3)
    assert model.steps < 80
    check(rows, got, 3)


def test_lower_rank_gives_fewer_components(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(a), float(2 * a), float(b), 5.0, float(b)]) for i, (a, b) in enumerate(rng.integers(-50, 50, (60, 2)))]
    _, model, got = run(spark, rows)
    assert len(model.e) == 2
    check(rows, got)


def test_fewer_rows_than_dimensions(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in np.float32(rng.standard_normal(10) * 9)]) for i in range(4)]
    _, model, got = run(spark, rows)
    assert len(model.e) == 3
    check(rows, got)


def test_rows_that_go(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in np.float32(rng.standard_normal(3) * 9)]) for i in range(50)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 0.0, 0.0]), (104, []), (105, [1.0, 2.0]), (106, [1e30, 0.0, 0.0])]
    _, _, got = run(spark, rows + odd)
    check(rows, got)
    keep = [*rows, (7, rows[0][1])]
    _, _, got = run(spark, [*rows, (None, rows[0][1])])
    assert sum(r.vec_id is None for r in got) == 3 and len(keep) * 3 == len(got)


def test_empty_one_row_and_equal_rows(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        fit, model, got = run(spark, rows)
        assert got == [] and len(model.e) == 0


def test_large_entries_are_exact(spark):
    schema = "vec_id bigint, embedding array<double>"
    rows = [(i, [float(2**44 * (i % 5)), float(i), float(3 * i % 7)]) for i in range(40)]
    fit, _, got = run(spark, rows, 2, schema)
    xs = [[int(np.floor(c * 64)) + 1_000_000 for c in v] for _, v in rows]
    assert fit.sums == [sum(x[k] for x in xs) for k in range(3)]
    big = {i: sum((40 * a - s) ** 2 for a, s in zip(xs[i], fit.sums)) for i in range(40)}
    assert all(r.deviation == (big[r.vec_id] if big[r.vec_id] < 2**63 else None) for r in got)


def test_other_columns_do_not_matter(spark):
    rows = [(i, [float(i % 7), float(i % 11)], "a", 3) for i in range(77)]
    _, _, got = run(spark, rows, schema=SCHEMA + ", x string, n int")
    check([(i, v) for i, v, _, _ in rows], got)
